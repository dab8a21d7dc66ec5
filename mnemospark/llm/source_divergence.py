"""Divergence of sources by term shares: chunks counted per document, each distinct chunk tokenized once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Runs of ASCII letters and of anything beyond ASCII; none of it is white space, so no term crosses a chunk.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A share is 1 + floor(WHOLE * (count + SMOOTH) / (N + SMOOTH * V)).
WHOLE, SMOOTH = 1_000_000_000, 5
#: Bytes of text whose chunks are counted at once; a longer text is by itself.
FLUSH = 32 << 20
#: An entry of a posting is a group, a document inside its block and a count, of so many bits; larger counts are split. Entries take 32 bits
#: where the groups of the corpus fit in, else 64.
_NARROW, _WIDE = (12, 16, 4), (22, 20, 20)
#: Groups up to which they are sent to every task; more are joined by their keys.
SENT = 100_000
#: Partitions whose blocks meet in one place per term: few enough for one task to hold the most frequent term of them.
_TOGETHER = 64


def numbered_groups(docs: DataFrame) -> DataFrame:
    """(lang, source, gid) of every group, numbered from 0; one task passes a slim row for each of the groups, whose pairs are the result."""
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return stored(stored(found).coalesce(1).withColumn("gid", F.monotonically_increasing_id()))


def layout(count: int) -> tuple[int, int, int]:
    """Bits of group, document and count in an entry for so many groups."""
    if count > 1 << _WIDE[0]:
        raise ValueError("too many groups for the entries of a posting")
    return _NARROW if count <= 1 << _NARROW[0] else _WIDE


def chunk_postings(docs: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """(block, chunk, entries): in which documents of a block a chunk occurs, and how often, with the group of each.

    A block is some documents of one partition, numbered inside it; every row of ``docs`` is a document of its own.
    """
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    known = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "gid")
    bits, known = layout(count), F.broadcast(known) if count <= SENT else known
    texts = texts.join(known, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).select("text", "gid")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, turn = TaskContext.get().partitionId() << 32, 0
        held, size, rows = [], 0, 0
        for batch in batches:
            at = 0
            while at < len(batch):
                lengths = pc.binary_length(batch["text"].slice(at)).to_numpy(zero_copy_only=False).cumsum()
                to = min(at + max(1, int(np.searchsorted(lengths, FLUSH - size, "right"))), at + (1 << bits[1]) - rows)
                held.append(batch.slice(at, to - at))
                size, rows = size + int(lengths[to - at - 1]), rows + to - at
                at = to
                if at < len(batch):
                    yield from _postings(held, place + turn, bits)
                    held, size, rows, turn = [], 0, 0, turn + 1
        if held:
            yield from _postings(held, place + turn, bits)

    return texts.mapInArrow(read, f"block long, chunk string, entries array<{'int' if bits == _NARROW else 'long'}>")


def _postings(held: list[pa.RecordBatch], block: int, bits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    group = table["gid"].to_numpy()
    words = pc.ascii_split_whitespace(pc.cast(table["text"], pa.large_string())).combine_chunks()
    doc = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(words))
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del words
    blank = pc.index(names, pa.scalar("", names.type)).as_py()
    if blank >= 0:
        doc, code = doc[code != blank], code[code != blank]
    if not len(code):
        return
    key, n = np.unique(code * len(group) + doc, return_counts=True)
    most = (1 << bits[2]) - 1
    parts = -(-n // most)
    if parts.max() > 1:  # the last part has the rest
        last = np.cumsum(parts) - 1
        key, n = np.repeat(key, parts), np.where(np.isin(np.arange(parts.sum()), last), np.repeat(n - (parts - 1) * most, parts), most)
    code, doc = key // len(group), key % len(group)
    entries = (group[doc] << (bits[1] + bits[2])) | (doc << bits[2]) | n
    entries = entries.astype(np.uint32).view(np.int32) if bits == _NARROW else entries
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    ends = np.append(first, len(code))
    for at in range(0, len(first), 65536):
        to = min(at + 65536, len(first))
        low, high = ends[at], ends[to]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(to - at, block)), names.take(pa.array(code[first[at:to]])).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - low, pa.int32()), pa.array(entries[low:high])),
        ], ["block", "chunk", "entries"])


def _united(bits: tuple[int, int, int]):
    """Rows sorted by (term, place): documents of all chunks of a term are united, counts added up, per group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            runs = _runs(table)
            cut = int(np.searchsorted(runs, runs[-1]))
            if cut:
                yield _sums(table.slice(0, cut), runs[:cut], bits)
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield _sums(rest, _runs(rest), bits)

    return run


def _runs(table: pa.Table) -> np.ndarray:
    term = pc.dictionary_encode(table["term"].combine_chunks()).indices.to_numpy(zero_copy_only=False)
    place = table["place"].to_numpy()
    return np.concatenate(([0], np.cumsum((term[1:] != term[:-1]) | (place[1:] != place[:-1]))))


def _sums(table: pa.Table, run: np.ndarray, bits: tuple[int, int, int]) -> pa.RecordBatch:
    lists = table["entries"].combine_chunks()
    entries = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    entries = entries.view(np.uint32).astype(np.int64) if bits == _NARROW else entries
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    own, block = np.repeat(run, lengths), np.repeat(table["block"].to_numpy(), lengths)
    n = (entries & ((1 << bits[2]) - 1)) * np.repeat(table["times"].to_numpy(), lengths)
    order = np.lexsort((block, entries >> bits[2], own))
    own, doc, block, n = own[order], (entries >> bits[2])[order], block[order], n[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))
    gid = doc >> bits[1]
    cell = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (gid[1:] != gid[:-1]))))
    head = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1))
    return pa.RecordBatch.from_arrays([
        table["term"].combine_chunks().take(pa.array(head[own[cell] - run[0]])), pa.array(gid[cell]), pa.array(np.add.reduceat(new.astype(np.int64), cell)),
        pa.array(np.add.reduceat(n, cell)),
    ], ["term", "gid", "docs", "n"])


def terms_of(chunk: Column) -> Column:
    return F.transform(F.regexp_extract_all(chunk, F.lit(TERM), F.lit(0)), lambda t: F.translate(t, _UPPER, _LOWER))


def candidates(postings: DataFrame, min_docs: int) -> DataFrame:
    """(c, term, times) of every chunk with a term that ``min_docs`` documents may have.

    Each distinct chunk is tokenized once. The documents of all chunks of a term, documents with several of them counted again, are at least
    those of the term, so what stays below can't be kept in any lang: an exact cut that spares the rare chunks their way.
    """
    tallied = postings.groupBy("chunk").agg(F.sum(F.size("entries").cast("long")).alias("m"))
    single = tallied.select("chunk", "m", F.explode(F.array(terms_of(F.col("chunk")))).alias("terms")).select("chunk", "m", F.explode("terms").alias("term"))
    counted = single.groupBy(F.col("chunk").alias("c"), "term").agg(F.count("*").alias("times"), F.max("m").alias("m"))
    return counted.withColumn("most", F.sum("m").over(W.partitionBy("term"))).filter(F.col("most") >= min_docs).select("c", "term", "times")


def group_counts(docs: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, docs, occurrences) of every term that ``min_docs`` documents may have.

    The terms of distinct chunks are joined back to the postings. Chunks that share a term meet by term and place, the blocks of
    ``_TOGETHER`` partitions, where their documents are united; places then only add up. A hot chunk or term has one
    row for each block of about ``FLUSH`` bytes.
    """
    count = groups.count()
    postings = chunk_postings(docs, groups, count)
    wanted = stored(candidates(postings, min_docs))
    met = postings.join(wanted, F.col("chunk") == F.col("c")).select(
        "term", F.expr(f"cast(block div {_TOGETHER << 32} as int)").alias("place"), "block", "times", "entries")
    united = met.repartition("term", "place").sortWithinPartitions("term", "place").mapInArrow(_united(layout(count)), "term string, gid long, docs long, n long")
    summed = united.groupBy("term", "gid").agg(F.sum("docs").alias("docs"), F.sum("n").alias("occurrences"))
    return summed.join(groups, "gid").select("lang", "source", "term", "docs", "occurrences")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """In whole numbers beyond a long, so that no rounding decides."""
    above = F.lit(WHOLE).cast("decimal(11,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, (total + SMOOTH * kept).cast("decimal(20,0)"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language differ in their terms.

    A lang keeps its V terms found in at least ``min_docs`` of its documents. A group (lang, source), and a lang, gives each kept term
    p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N being its count of all kept terms. Part ``pair``: for each
    other source of the lang the sum of |p - q| over all kept terms, all ranks. Part ``term``: kept terms that
    the group has with p over the lang's q, by p - q, the first ``top`` ranks. Ranks go by value falling, then item.

    Null text, lang and source count as ''. Every row is a document, whatever its doc_id, so repeated rows count twice. A group
    without terms takes part in pairs, a lang without kept terms has values 0, a lang with one source no pairs, an
    empty table no rows. Texts of any length are read whole; extra columns are not read.
    """
    groups = numbered_groups(docs)
    counts = stored(group_counts(docs, groups, min_docs))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("in_lang")).filter(F.col("docs") >= min_docs)
    kept = stored(of_lang.select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "in_lang"))
    held = counts.join(kept, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).select("lang", "source", "term", "occurrences", "in_lang")
    held = stored(held)
    sizes = kept.groupBy("k_lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    totals = held.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(F.sum("occurrences").alias("n"))
    known = groups.drop("gid").join(totals, (F.col("lang") == F.col("t_lang")) & (F.col("source") == F.col("t_source")), "left").join(sizes, F.col("lang") == F.col("k_lang"), "left")
    known = stored(known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "lang_n")]))

    facts = known.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "n", "v", "lang_n")
    shared = held.join(facts, (F.col("lang") == F.col("f_lang")) & (F.col("source") == F.col("f_source")))
    p = _share(F.col("occurrences"), F.col("n"), F.col("v"))
    shared = shared.select("lang", "source", "term", "in_lang", "v", "lang_n", p.alias("p"))

    over = shared.withColumn("value", F.col("p") - _share(F.col("in_lang"), F.col("lang_n"), F.col("v"))).filter(F.col("value") > 0)
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    over = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # A source without the term has the share of count 0, so a term carries the others only; the sources of a lang ride along in order.
    none = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    line = known.groupBy(F.col("lang").alias("l_lang")).agg(F.array_sort(F.collect_list(F.struct("source", none.alias("none")))).alias("line"))
    by_term = shared.groupBy("lang", "term").agg(F.collect_list("source").alias("sources"), F.collect_list("p").alias("shares"))
    spread = by_term.join(line, F.col("lang") == F.col("l_lang")).select("lang", "line.source", "line.none", "sources", "shares")
    far = spread.mapInPandas(_differences, "lang string, source string, item string, value long")
    far = far.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = known.select(F.col("lang").alias("o_lang"), F.col("source").alias("o_source"))
    pairs = known.join(others, (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("o_source"))).select("lang", "source", F.col("o_source").alias("item"))
    summed = far.select(F.col("lang").alias("d_lang"), F.col("source").alias("d_source"), F.col("item").alias("d_item"), "value")
    pairs = pairs.join(summed, (F.col("lang") == F.col("d_lang")) & (F.col("source") == F.col("d_source")) & (F.col("item") == F.col("d_item")), "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    ordered = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))
    return pairs.unionByName(over)


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of |p - q| over the terms of a batch for all pairs of sources of their lang."""
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            names, none = rows["source"].iloc[0], np.asarray(rows["none"].iloc[0], np.int64)
            at = {name: i for i, name in enumerate(names)}
            total = np.zeros((len(names), len(names)), np.int64)
            step = max(1, (1 << 22) // max(1, len(names) ** 2))
            for start in range(0, len(rows), step):
                part = rows.iloc[start : start + step]
                p = np.tile(none, (len(part), 1))
                for i, (sources, shares) in enumerate(zip(part["sources"], part["shares"])):
                    p[i, [at[s] for s in sources]] = shares
                total += np.abs(p[:, :, None] - p[:, None, :]).sum(0)
            i, j = np.nonzero(~np.eye(len(names), dtype=bool))
            yield pd.DataFrame({"lang": lang, "source": np.asarray(names, object)[i], "item": np.asarray(names, object)[j], "value": total[i, j]})
