"""Ranking, neighbour search and ordered folds that survive hot keys.

Every helper here keeps a task's share bounded: windows are cut to k rows per
key before the shuffle, neighbour search works on blocks, and ordered folds go
through chunks of the sequence number before they meet per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mnemospark.functions import text as T

CHUNK = 4096
#: Left rows whose products with a block a task holds at once.
TILE = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only where it names none (tests), one in its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed exactly once per row.

    A plain column is copied into filters that get pushed below it, and generated
    code of a broadcast join evaluates it once per match; a generator stops both.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Fan slim id rows out before texts are joined to them; a fixed partition count
    is not coalesced again for being small in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None,
                rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key (None: all, ranked). Spark trims to k per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    if k is None:
        return df.withColumn(rank, F.row_number().over(window))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def block_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str,
                left_rows: int = CHUNK, right_rows: int = CHUNK):
    """Both sides cut into blocks of about so many rows per key, ready to meet block by block.

    ``on`` names key columns of either side. Returns the two grouped frames for ``cogroup``; their
    columns are prefixed ``l_`` and ``r_``. A hot key becomes many block pairs.
    """
    counts = left.groupBy(*on).agg(F.ceil(F.count("*") / left_rows).alias("_nl")).join(
        right.groupBy(*on).agg(F.ceil(F.count("*") / right_rows).alias("_nr")), list(on)) if on else left.agg(
        F.ceil(F.count("*") / left_rows).alias("_nl")).crossJoin(right.agg(F.ceil(F.count("*") / right_rows).alias("_nr")))

    def dealt(df: DataFrame, prefix: str, ident: str, own: str, other: str):
        sized = df.join(counts, list(on)) if on else df.crossJoin(F.broadcast(counts))  # counts: one row without keys
        placed = (sized.withColumn(f"_b{own}", F.pmod(F.xxhash64(ident), F.greatest(f"_n{own}", F.lit(1))))
                  .withColumn(f"_b{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(f"_n{other}", F.lit(1)) - 1)))
                  .drop("_nl", "_nr"))
        named = placed.select(*[F.col(c).alias(f"{prefix}_{c}") for c in placed.columns])
        return named.groupBy(*[f"{prefix}_{c}" for c in (*on, "_bl", "_br")])

    return dealt(left, "l", left_id, "l", "r"), dealt(right, "r", right_id, "r", "l")


def large_keys(left: DataFrame, right: DataFrame, on: Sequence[str], block_rows: int) -> DataFrame:
    """One row that tells how many blocks of about ``block_rows`` rows the keys with more rows than that have on either side; read by :func:`blocks_of`.

    Such keys are as few as the rows over ``block_rows``, so the row can go to all tasks, and no other row is shuffled to learn its block.
    """

    def large(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows)
        return counted.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*on), F.ceil(F.col("_n") / block_rows).cast("int")))).alias(name))

    return large(left, "_large_l").crossJoin(F.broadcast(large(right, "_large_r")))  # one row each


def blocks_of(side: str, on: Sequence[str]) -> Column:
    """Blocks of the key of a row on the left (l) or right (r) side, beside the row of :func:`large_keys`."""
    return F.coalesce(F.try_element_at(F.col(f"_large_{side}"), F.struct(*on)), F.lit(1))


def tiled_blocks(left: DataFrame, right: DataFrame, on: Sequence[str], match: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                 block_rows: int, tile: int, prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                 finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """What ``match`` makes of each pair of tiles of ``left`` and ``right``, whose keys ``on`` agree.

    Both sides have the same columns, among them id. A row is sent out once for each block of about ``block_rows`` rows of the other side, while
    a task works on, and holds the result of, only ``tile`` rows of either side at a time: large blocks cost no memory but their rows. ``match`` gets the columns
    prefixed ``l_`` and ``r_``; ``prepare`` adds columns to a block once. ``finish`` reduces what the tiles of a block give; it is also used on parts of it and
    on what it gave.
    """
    columns = [c for c in left.columns if c != "id"]
    kinds = {"l_id": dict(left.dtypes)["id"], "r_id": dict(right.dtypes)["id"]}
    blocks = large_keys(left, right, on, block_rows)

    def dealt(df: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        # The id of the other side is a placeholder that is not null: a column of numbers with nulls would become one of doubles.
        ids = [(F.col("id") if c == ident else F.lit("0").cast(kind)).alias(c) for c, kind in kinds.items()]
        placed = df.dropna(subset=list(on)).crossJoin(F.broadcast(blocks)).withColumn(f"_b{own}", F.pmod(F.xxhash64("id"), blocks_of(own, on)).cast("int")).withColumn(
            f"_b{other}", F.explode(F.sequence(F.lit(0), blocks_of(other, on) - 1)))
        return placed.select(*columns, *ids, "_bl", "_br", F.lit(ident == "l_id").alias("_left"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches), ignore_index=True)
        if block["_left"].all() or not block["_left"].any():
            return
        if prepare is not None:
            block = prepare(block)
        own = [c for c in block.columns if c not in ("_bl", "_br", "_left", "l_id", "r_id")]
        sides = [block[block["_left"] == first][[f"{p}id", *own]].rename(columns={c: p + c for c in own}) for first, p in ((True, "l_"), (False, "r_"))]
        held, rows, most = [], 0, 200_000
        for x in range(0, len(sides[0]), tile):
            for y in range(0, len(sides[1]), tile):
                found = match(*(d.iloc[z:z + tile].reset_index(drop=True) for d, z in zip(sides, (x, y))))
                if len(found) and finish is None:
                    yield found
                elif len(found):
                    held.append(finish(found))
                    rows += len(held[-1])
                    if rows > most:
                        held = [finish(pd.concat(held, ignore_index=True))]
                        rows, most = len(held[0]), max(most, 2 * len(held[0]))
        if held:
            yield finish(pd.concat(held, ignore_index=True))

    rows = dealt(left, "l_id", "l", "r").unionByName(dealt(right, "r_id", "r", "l"))
    # The fixed count of partitions is not coalesced: blocks are small in bytes and long in work.
    return spread_ids(rows, *on, "_bl", "_br").groupBy(*on, "_bl", "_br").applyInPandas(work, schema)


def _rank_block(k: int, earlier_only: bool, floor: float | None = None, tile: int = TILE):
    """Best k fitting right rows for each left row of one block pair, by ``tile`` left rows at a time."""

    def unit(vectors: pd.Series) -> np.ndarray:
        full = np.stack(vectors.to_numpy()).astype(np.float64)
        return full / np.linalg.norm(full, axis=1, keepdims=True)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "similarity": [], "right_weight": []})
        right = right.sort_values(["right_weight", "right_id"], ascending=[False, True], ignore_index=True)
        b = unit(right["vector"])
        return pd.concat([best_of(left.iloc[x:x + tile], right, b) for x in range(0, len(left), tile)], ignore_index=True)

    def best_of(left: pd.DataFrame, right: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        a = unit(left["vector"])
        sims = np.round(a @ b.T, 9)
        if earlier_only:
            later = right["position"].to_numpy()[None, :] >= left["position"].to_numpy()[:, None]
            sims[later] = -np.inf
        sims[left["position"].to_numpy()[:, None] >= right["until"].to_numpy()[None, :]] = -np.inf
        if floor is not None:
            sims[sims < floor] = -np.inf
        if sims.shape[1] > k:
            cut = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero(sims >= cut[:, None])
        else:
            rows, cols = np.nonzero(np.isfinite(sims))
        found = sims[rows, cols]
        keep = np.isfinite(found)
        rows, cols, found = rows[keep], cols[keep], found[keep]
        order = np.lexsort((cols, -found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        first = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - first < k
        rows, cols, found = rows[best], cols[best], found[best]
        return pd.DataFrame({
            "left_id": left["left_id"].to_numpy()[rows],
            "right_id": right["right_id"].to_numpy()[cols],
            "similarity": found,
            "right_weight": right["right_weight"].to_numpy()[cols],
        })

    return match


def nearest_neighbours(
    left: DataFrame, right: DataFrame, k: int, *, on: Sequence[str] = ("project_id",),
    left_vector: str = "context_vector", right_vector: str = "context_vector",
    left_id: str = "id", right_id: str = "id", weight: str | None = "weight",
    earlier: tuple[str, str] | None = None, until: str | None = None, floor: float | None = None, block_rows: int = CHUNK,
) -> DataFrame:
    """Exact cosine top-k of ``right`` for each row of ``left`` sharing ``on``.

    Both sides are cut into blocks of about ``block_rows`` rows per key and each
    pair of blocks is one matrix product, so a key that holds a third of all
    rows spreads over many tasks and only k rows per (row, block) are shuffled
    onward. ``earlier=(left_col, right_col)`` keeps only right rows whose column
    is strictly smaller; with it, a right row counts only for left rows before its ``until`` (null: always).
    Rows below ``floor`` never match. All conditions hold before the k are taken. Ties: weight descending, then id. Rows without a signal
    never match. Columns: left_id, right_id, similarity (9 decimals), rank.
    """
    keys = [f"_k{i}" for i in range(len(on))] + ["_dim"]

    def side(df: DataFrame, ident: str, vector: str, role: str) -> DataFrame:
        cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
        cols += [F.size(vector).alias("_dim"), F.col(ident).alias(f"{role}_id"), F.col(vector).alias("vector")]
        if role == "right":
            cols.append((F.col(weight) if weight else F.lit(0.0)).cast("double").alias("right_weight"))
        position = F.col(earlier[0 if role == "left" else 1]).cast("double") if earlier else F.lit(0.0)
        cols.append(position.alias("position"))
        if role == "right":
            cols.append(F.coalesce(F.col(until).cast("double") if until else F.lit(None), F.lit(float("inf"))).alias("until"))
        return df.filter(F.exists(vector, lambda x: x != 0)).select(*cols)

    lefts, rights = side(left, left_id, left_vector, "left"), side(right, right_id, right_vector, "right")
    n_left = lefts.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("_nl"))
    n_right = rights.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("_nr"))
    blocks = n_left.join(n_right, keys)

    def spread(df: DataFrame, ident: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return (
            df.join(blocks, keys)
            .withColumn(own, F.pmod(F.xxhash64(ident), F.col(own_n)))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_n) - 1)))
            .drop("_nl", "_nr")
        )

    grouped = [*keys, "_bl", "_br"]
    l_blocks = spread(lefts, "left_id", "_bl", "_nl", "_br", "_nr").groupBy(*grouped)
    r_blocks = spread(rights, "right_id", "_br", "_nr", "_bl", "_nl").groupBy(*grouped)
    id_l, id_r = lefts.schema["left_id"].dataType, rights.schema["right_id"].dataType
    found = l_blocks.cogroup(r_blocks).applyInPandas(
        _rank_block(k, earlier is not None, floor),
        f"left_id {id_l.simpleString()}, right_id {id_r.simpleString()}, similarity double, right_weight double",
    )
    order = [F.desc("similarity"), F.desc("right_weight"), F.asc("right_id")]
    return top_per_key(found, ["left_id"], order, k).drop("right_weight")


def _overlap_block(k: int, per_name: float, tile: int = TILE):
    """Best k right rows by bigram overlap for each left row of one block pair, by ``tile`` left rows at a time."""
    shared = T.bigram_kernel()[1]

    def named(refs: list[list[str]], names: pd.Series) -> np.ndarray:
        """How many references of a left row occur in the name of a right row."""
        owner = np.repeat(np.arange(len(refs)), [len(r) for r in refs])
        at, words = pd.factorize(np.array([w for r in refs for w in r], dtype=object))
        of, known = pd.factorize(names.fillna("").str.lower())
        asked = np.zeros((len(refs), len(words)))
        np.add.at(asked, (owner, at), 1)
        inside = np.array([[w in name for name in known] for w in words], dtype=float).reshape(len(words), len(known))
        return (asked @ inside)[:, of]

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "score": [], "at": []})
        right = right.sort_values("r_id", ignore_index=True)
        b = [np.asarray(g, np.int64) for g in right["r_grams"]]
        return pd.concat([best_of(left.iloc[x:x + tile], right, b) for x in range(0, len(left), tile)], ignore_index=True)

    def best_of(left: pd.DataFrame, right: pd.DataFrame, b: list[np.ndarray]) -> pd.DataFrame:
        a = [np.asarray(g, np.int64) for g in left["l_grams"]]
        total = np.array([len(g) for g in a])[:, None] + np.array([len(g) for g in b])[None, :]
        score = 2.0 * shared(a, b) / np.maximum(total, 1)
        if per_name:
            score = score + per_name * named([list(r) for r in left["l_refs"]], right["r_name"])
        # Half up, as SQL rounds.
        score = np.floor(score * 1e9 + 0.5) / 1e9
        when, after, before = (f.to_numpy(np.float64) for f in (right["r_at"], left["l_after"], left["l_before"]))
        fits = (score > 0) & (np.isnan(after)[:, None] | (when[None, :] >= after[:, None])) & (np.isnan(before)[:, None] | (when[None, :] <= before[:, None]))
        score[~fits] = -np.inf
        if score.shape[1] > k:
            fits &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1][:, None]
        rows, cols = np.nonzero(fits)
        order = np.lexsort((cols, -score[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        rows, cols = rows[best], cols[best]
        return pd.DataFrame({"left_id": left["l_id"].to_numpy()[rows], "right_id": right["r_id"].to_numpy()[cols], "score": score[rows, cols], "at": when[cols]})

    return match


def overlap_topk(left: DataFrame, right: DataFrame, k: int, on: Sequence[str] = ("project_id",), per_name: float = 0.0,
                 block_rows: int = CHUNK) -> DataFrame:
    """left_id, right_id, score, rank, at: best k of ``right`` by Dice overlap of bigram sets, block by block.

    Both sides have id, ``on`` and grams (a null one takes no part). ``left`` may have refs, each of which adds ``per_name`` where it occurs in
    the right row's name, and after and before, inclusive bounds of the right row's at (timestamps; null: open). All conditions
    hold before the k are taken. A block sends on k rows for each left row, so a key that holds a third of all rows costs its
    products, spread over tasks, and no pair is stored. Scores are positive, with 9 decimals; ties go to the lesser id.
    """

    def side(df: DataFrame, times: Sequence[str], texts: dict[str, str]) -> DataFrame:
        def given(name: str, kind: str) -> Column:
            return F.col(name) if name in df.columns else F.lit(None).cast(kind)

        cols = [F.unix_micros(given(t, "timestamp")).cast("double").alias(t) for t in times]
        return df.filter(F.col("grams").isNotNull()).select("id", *on, "grams", *cols, *[given(t, kind).alias(t) for t, kind in texts.items()])

    lefts = side(left, ["after", "before"], {"refs": "array<string>"}).withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    l_blocks, r_blocks = block_pairs(lefts, side(right, ["at"], {"name": "string"}), on, "id", "id", block_rows, block_rows)
    l_type, r_type = (df.schema["id"].dataType.simpleString() for df in (left, right))
    found = l_blocks.cogroup(r_blocks).applyInPandas(_overlap_block(k, per_name), f"left_id {l_type}, right_id {r_type}, score double, at double")
    best = top_per_key(found, ["left_id"], [F.desc("score"), F.asc("right_id")], k)
    return best.withColumn("at", F.when(~F.isnan("at"), F.timestamp_micros(F.col("at").cast("bigint"))))


def in_order(df: DataFrame, keys: Sequence[str], seq: str, chunk: int = CHUNK) -> DataFrame:
    """Rows with ``_at``, their place in the order of (keys, seq), and ``_chunk``, which holds at most ``chunk`` neighbours.

    Places come from a range sort, so it doesn't matter how far apart the values of ``seq`` lie, and a key that holds a third of all rows
    spreads over partitions. The bits of ``_at`` above the 33rd are the partition. The rows are stored, since a range sort
    that is run again may draw other borders.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys, seq).sortWithinPartitions(*keys, seq)
    return durable(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_chunk", F.expr(f"_at div {chunk}")))


def carry_forward(df: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str,
                  chunk: int = CHUNK) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its key, in ``seq`` order.

    ``seq`` is unique within its key and may be sparse. Rows meet in chunks of the order; only one
    summary row per (key, chunk) takes part in the second, per-key window.
    """
    cut = in_order(df.withColumn("_v", value), keys, seq, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across))
        .select(*keys, "_chunk", "_carry")
    )
    return (
        cut.withColumn("_here", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop("_v", "_at", "_chunk", "_here", "_carry")
    )


def ordinal(df: DataFrame, keys: Sequence[str], seq: str, name: str, chunk: int = CHUNK, first: str | None = None) -> DataFrame:
    """1-based position of each row within its key by ``seq``, which is unique within its key and may be sparse.

    Rows are numbered inside chunks of the order; a key's chunks then only
    add up their counts. ``first`` names a column for the least ``seq`` of the key.
    """
    cut = in_order(df, keys, seq, chunk)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    least = [F.min("_least").over(whole).alias(first)] if first else []
    offsets = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_c"), F.min(seq).alias("_least")).select(
        *keys, "_chunk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"), *least)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    return cut.withColumn("_here", F.row_number().over(inside)).join(offsets, [*keys, "_chunk"]).withColumn(
        name, F.col("_offset") + F.col("_here")).drop("_at", "_chunk", "_here", "_offset")


def ordered_parts(rows: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = "\n", items: int = CHUNK) -> DataFrame:
    """keys, part (from 0), items, content, offset: texts of each key joined by ``sep`` in ``order``, in parts of at most ``items`` texts.

    ``order`` is unique within its key. ``sep`` between the parts gives the whole text, in which a part starts at character ``offset``; a null text counts as
    empty. No row holds more than a part, however long the text of a key is.
    """
    slim = rows.select(*keys, F.col(order).alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    placed = ordinal(slim, keys, "_order", "_n").withColumn("part", F.expr(f"(_n - 1) div {items}"))
    texts = F.array_sort(F.collect_list(F.struct("_n", "_text")))
    parts = placed.groupBy(*keys, "part").agg(F.count("*").alias("items"), F.array_join(F.transform(texts, lambda x: x["_text"]), sep).alias("content"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select(*keys, "part", (F.length("content") + len(sep)).alias("_size")).withColumn(
        "offset", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("bigint")).drop("_size")
    return parts.join(sizes, [*keys, "part"])


def clamped_sum(events: DataFrame, key: str, seq: str, delta: str, low: float = 0.0, high: float = 1.0,
                chunk: int = CHUNK) -> DataFrame:
    """Compose ``x -> clamp(x + delta)`` over each key's events in ``seq`` order.

    Clamped steps do not commute, but their composition is again a shift and two
    bounds, so it is built per chunk of neighbours, then per partition of the order, then
    per key; ``seq`` may be sparse, and no row holds more than a chunk, the chunks of a partition or the
    partitions. Returns key, shift, floor, ceiling, events; apply with :func:`apply_clamped`.
    """

    def compose(rows: Column) -> Column:
        # A double far outside any weight stands for "no bound yet".
        start = F.struct(
            F.lit(0.0).alias("shift"), F.lit(-1e300).alias("floor"), F.lit(1e300).alias("ceiling"),
            F.lit(0).cast("bigint").alias("events"),
        )

        def step(acc: Column, x: Column) -> Column:
            def bound(c: Column) -> Column:
                return F.greatest(x["floor"], F.least(x["ceiling"], c + x["shift"]))

            return F.struct(
                (acc["shift"] + x["shift"]).alias("shift"), bound(acc["floor"]).alias("floor"),
                bound(acc["ceiling"]).alias("ceiling"), (acc["events"] + x["events"]).alias("events"),
            )

        return F.aggregate(rows, start, step)

    slim = events.select(key, F.col(seq).alias("_seq"), F.col(delta).alias("shift"))
    part = in_order(slim, [key], "_seq", chunk).select(
        key, "_at", "_chunk", "shift", F.lit(low).alias("floor"), F.lit(high).alias("ceiling"), F.lit(1).cast("bigint").alias("events"))
    for group in ([F.col("_chunk")], [F.shiftright("_at", 33).alias("_part")], []):
        rows = F.array_sort(F.collect_list(F.struct("_at", "shift", "floor", "ceiling", "events")))
        part = part.groupBy(key, *group).agg(F.min("_at").alias("_at"), compose(rows).alias("f")).select(key, "_at", "f.*")
    return part.drop("_at")


def apply_clamped(value: Column, shift: Column, floor: Column, ceiling: Column) -> Column:
    """Result of the composed steps; an untouched key keeps its value."""
    moved = F.greatest(floor, F.least(ceiling, value + shift))
    return F.when(shift.isNull(), value).otherwise(moved)


def nearest_rank_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float],
                             buckets: int = 256) -> DataFrame:
    """Smallest value whose rank reaches ceil(p/100 * n), per key; exact.

    Values are counted first, then dealt into buckets between approximate quantiles of the key, so
    that an outlier doesn't gather all others in one bucket. Counts are exact, and only the
    bucket that contains the wanted rank is looked into: no key is sorted as a whole.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    counted = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    span = known.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), steps, 10 * buckets).alias("_edges"), F.count("*").alias("_n"))
    bucket = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    placed = (counted.join(span, keys) if keys else counted.crossJoin(F.broadcast(span))).withColumn("_b", bucket).drop("_edges")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_b", "_n").agg(F.sum("_c").alias("_t")).withColumn(
        "_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    wanted = totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn(
        "_rank", F.greatest(F.lit(1).cast("bigint"), F.least(F.col("_n"), F.ceil(F.col("p") / 100 * F.col("_n"))))
    ).filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_t")))
    rows = placed.select(*keys, "_b", "_v", "_c").join(wanted, [*keys, "_b"])
    running = Window.partitionBy(*keys, "_b", "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.withColumn("_upto", F.col("_before") + F.sum("_c").over(running)).filter("_upto >= _rank")
    return reached.groupBy(*keys, "p").agg(F.min("_v").alias("percentile"), F.first("_n").alias("n"))
