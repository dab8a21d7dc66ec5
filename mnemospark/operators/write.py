"""Write path: neighbours, separation, merge, create, links, touches, feedback."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, vectors as X, weights as W
from mnemospark.operators import token_links
from mnemospark.operators.ranking import apply_clamped, clamped_sum, durable, nearest_neighbours, pinned, spread_ids, tiled_blocks, top_per_key


def similar_memories(events: DataFrame, memories: DataFrame, k: int = V.NEIGHBOUR_K) -> DataFrame:
    """event_id, id, similarity, rank: the k most similar active memories of the project."""
    active = memories.filter(F.col("obsoleted_at").isNull())
    found = nearest_neighbours(events, active, k, left_id="event_id")
    return found.withColumnsRenamed({"left_id": "event_id", "right_id": "id"})


def separation(events: DataFrame, memories: DataFrame, neighbours: DataFrame,
               threshold: float = V.MERGE_COSINE) -> DataFrame:
    """Why each neighbour is or is not the same memory; first failing check wins."""
    e = events.select("event_id", "seq", F.col("project_id").alias("_ep"), F.col("language").alias("_el"),
                      F.col("entity_group").alias("_ee"))
    m = memories.select("id", "project_id", "language", "entity_group")
    reason = (
        F.when(F.col("similarity") < threshold, F.lit("below_similarity_threshold"))
        .when(F.col("_ep") != F.col("project_id"), F.lit("different_project"))
        .when(~F.col("_el").eqNullSafe(F.col("language")), F.lit("different_language"))
        .when(~F.col("_ee").eqNullSafe(F.col("entity_group")), F.lit("different_entity"))
        .otherwise(F.lit("same_entity_same_context"))
    )
    return neighbours.join(e, "event_id").join(m, "id").select(
        "event_id", "seq", "id", "similarity", "rank", reason.alias("reason"))


def merge_targets(judged: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """event_id, seq, id, similarity of the first mergeable neighbour; ``covered``
    pairs (event_id, id) are superseded and never merged into."""
    fit = judged.filter(F.col("reason") == "same_entity_same_context")
    if covered is not None:
        fit = fit.join(covered.select("event_id", "id"), ["event_id", "id"], "left_anti")
    best = fit.groupBy("event_id").agg(F.min_by(F.struct("seq", "id", "similarity"), "rank").alias("b"))
    return best.select("event_id", "b.*")


def _judge_block(threshold: float, earlier: bool, placed: bool = False):
    """Covered pairs, and the best fitting row of each new row, of one block pair."""
    _, common = T.bigram_kernel()

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("new_id", "old_id", "covers", "cosine", "weight", "shared", "total", "new_at", "old_at",
                                                 "polarity_new", "polarity_old")})
        right = right.sort_values(["r_weight", "r_id"], ascending=[False, True], ignore_index=True)

        def meet(name: str) -> tuple[np.ndarray, np.ndarray]:
            return left[f"l_{name}"].to_numpy()[:, None], right[f"r_{name}"].to_numpy()[None, :]

        def codes(name: str) -> tuple[np.ndarray, np.ndarray]:
            both = pd.factorize(pd.concat([left[f"l_{name}"], right[f"r_{name}"]]))[0]
            return both[:len(left), None], both[None, len(left):]

        (new_id, old_id), (new_at, old_at) = meet("id"), meet("at")
        allowed = (new_id != old_id).astype(bool)
        if earlier:
            position = meet("position")
            allowed &= position[1] < position[0]
        entity, polar, fit, bare = codes("entity"), codes("polarity"), codes("fit"), meet("entity")
        spoken = [p != "neutral" for p in meet("polarity")]
        flip = spoken[0] & spoken[1] & (polar[0] != polar[1])
        sets = [list(d) for d in (left["l_grams"], right["r_grams"])]
        sizes = [np.array([len(g) for g in s]) for s in sets]
        shared, total = common(*sets), sizes[0][:, None] + sizes[1][None, :]
        # NaN (no time) compares false.
        covers = (allowed & ((bare[0] == "") | (bare[1] == "") | (entity[0] == entity[1])) & (new_at > old_at)
                  & (shared > 0) & (8 * shared >= total) & (flip | (20 * shared < 9 * total)))
        # A text inside another shares all of its bigrams.
        maybe = covers & ~flip & (shared == np.minimum(sizes[0][:, None], sizes[1][None, :]))
        said, heard = left["l_summary"].to_numpy(), right["r_summary"].to_numpy()
        for i, j in zip(*np.nonzero(maybe)):
            covers[i, j] = not (heard[j] in said[i] or said[i] in heard[j])
        a, b = (np.stack(d.to_numpy()).astype(np.float64) for d in (left["l_vector"], right["r_vector"]))
        cosine = np.round((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 9)
        sims = np.where(allowed & ~covers & (fit[0] == fit[1]) & (cosine >= threshold), cosine, -np.inf)
        best = np.argmax(sims, axis=1)  # the first of equals: right rows stand by weight and id
        at = np.flatnonzero(np.isfinite(sims[np.arange(len(left)), best]))
        i, j = (np.concatenate(x) for x in zip(np.nonzero(covers), (at, best[at])))
        return pd.DataFrame({
            "new_id": left["l_id"].to_numpy()[i], "old_id": right["r_id"].to_numpy()[j], "covers": covers[i, j], "cosine": cosine[i, j],
            "weight": right["r_weight"].to_numpy()[j], "shared": shared[i, j], "total": total[i, j],
            "new_at": left["l_at"].to_numpy()[i], "old_at": right["r_at"].to_numpy()[j], **({"position": left["l_position"].to_numpy()[i]} if placed else {}),
            "polarity_new": left["l_polarity"].to_numpy()[i], "polarity_old": right["r_polarity"].to_numpy()[j]})

    return match


def _counted(match):
    """How many covered pairs of one pair of tiles each row is in, as the new one (carrier) or the old one."""

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = match(left, right)
        pairs = pairs[pairs["covers"].astype(bool)]
        per = [(carrier, pairs[c].value_counts(sort=False)) for carrier, c in ((True, "new_id"), (False, "old_id"))]
        return pd.concat([pd.DataFrame({"id": n.index.astype(str), "carrier": carrier, "edges": n.to_numpy(np.int64)}) for carrier, n in per], ignore_index=True)

    return count


_SETTLED = ["new_id", "old_id", "covers", "cosine", "weight", "position"]


def _settled(found: pd.DataFrame) -> pd.DataFrame:
    """Of the rows each new row may merge into the best, and of the covered pairs two different ones of each row (where it has them) and an old row's earliest."""
    covers = found["covers"].astype(bool).to_numpy()
    best = found[~covers].sort_values(["cosine", "weight", "old_id"], ascending=[False, False, True], kind="stable").drop_duplicates("new_id")
    pairs = found[covers]
    new, old = (pd.factorize(pairs[c])[0] for c in ("new_id", "old_id"))
    kept = np.zeros(len(pairs), bool)
    for row, by in ((new, old), (old, new), (old, pairs["position"].to_numpy())):
        order = np.lexsort((by, row))
        edge = np.flatnonzero(np.diff(row[order], prepend=-2, append=-2))
        kept[order[edge[:-1]]] = True
        kept[order[edge[1:] - 1]] = True
    return pd.concat([best, pairs[kept]], ignore_index=True)[_SETTLED]


def directed(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction: only these are judged."""
    return rows.filter(F.exists("context_vector", lambda x: x != 0))


def covered_counts(new: DataFrame, old: DataFrame, **options) -> DataFrame:
    """id, carrier, edges: the rows that cover others (carrier) or are covered, and in how many pairs of :func:`covered_found`; no pair is stored."""
    return judge(new, old, counted=True, **options).groupBy("id", "carrier").agg(F.sum("edges").alias("edges"))


def judge(new: DataFrame, old: DataFrame, threshold: float = V.MERGE_COSINE, earlier: str | None = None, block_rows: int = 8192, counted: bool = False,
          settled: bool = False) -> DataFrame:
    """Every row of ``new`` against every active row of ``old`` of its project: the pairs it covers (``covers``) and, per
    pair of blocks, the most similar row it may merge into. Split by :func:`covered_found` and :func:`merge_found`.

    Both sides carry a vector of one size, as in :func:`similar_memories`. Entity, time, subject, language and
    threshold are judged inside the blocks before anything is ranked, so no nearer row that doesn't fit hides one that does.
    Covered rows are as in :func:`evolve.covered_pairs`. With ``earlier`` only rows before count. ``settled`` gives, with the position of the new row, no more than
    some pairs for each row of a block: which rows cover and are covered, by which position first, and the merges are those of all pairs.
    """

    def side(df: DataFrame) -> DataFrame:
        at = F.unix_micros(F.coalesce("occurred_at", "created_at")).cast("double")
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(0.0)
        return directed(df).select(
            "project_id", F.size("context_vector").alias("dim"), "id", F.col("context_vector").alias("vector"), "summary",
            F.coalesce("entity_group", F.lit("")).alias("entity"), T.polarity(F.coalesce("summary", F.lit(""))).alias("polarity"),
            F.to_json(F.struct("language", "entity_group")).alias("fit"), at.alias("at"), weight.alias("weight"),
            (F.col(earlier).cast("double") if earlier else F.lit(0.0)).alias("position"))

    lefts, rights = side(new), side(old.filter(F.col("obsoleted_at").isNull()))
    bigrams, _ = T.bigram_kernel()

    def prepare(block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(grams=[bigrams(s if s is not None else "") for s in block["summary"]])

    if counted:
        return tiled_blocks(lefts, rights, ["project_id", "dim"], _counted(_judge_block(threshold, earlier is not None)), "id string, carrier boolean, edges bigint",
                            block_rows, 1024, prepare)
    ids = f"new_id {lefts.schema['id'].dataType.simpleString()}, old_id {rights.schema['id'].dataType.simpleString()}, covers boolean, cosine double, weight double"
    if settled:
        return tiled_blocks(lefts, rights, ["project_id", "dim"], _judge_block(threshold, earlier is not None, placed=True), f"{ids}, position double",
                            block_rows, 1024, prepare, _settled)
    return tiled_blocks(
        lefts, rights, ["project_id", "dim"], _judge_block(threshold, earlier is not None),
        f"{ids}, shared bigint, total bigint, new_at double, old_at double, polarity_new string, polarity_old string",
        block_rows, 1024, prepare)


def covered_found(found: DataFrame) -> DataFrame:
    """The covered pairs of :func:`judge`, for :func:`evolve.apply_updates`."""
    at = {f"{side}_occurred_at": F.timestamp_micros(F.col(f"{side}_at").cast("bigint")) for side in ("new", "old")}
    flip = (F.col("polarity_new") != "neutral") & (F.col("polarity_old") != "neutral") & (F.col("polarity_new") != F.col("polarity_old"))
    return found.filter("covers").select(
        "new_id", "old_id", *[c.alias(n) for n, c in at.items()], "polarity_new", "polarity_old", flip.alias("polarity_flip"),
        F.round(2.0 * F.col("shared") / F.col("total"), 9).alias("similarity"))


def merge_found(found: DataFrame) -> DataFrame:
    """new_id, id, similarity: the row of :func:`judge` that each new row merges into."""
    order = [F.desc("cosine"), F.desc("weight"), F.asc("old_id")]
    best = top_per_key(found.filter(~F.col("covers")), ["new_id"], order, 1)
    return best.select("new_id", F.col("old_id").alias("id"), F.col("cosine").alias("similarity"))


def batch_joins(rows: DataFrame, covered: DataFrame, threshold: float = V.MERGE_COSINE) -> DataFrame:
    """memory_id, id, similarity: which earlier new row a new row joins, as if written one after another.

    ``rows`` are new memories with ``seq``; ``covered`` (new_id, old_id, new_seq) are supersessions among
    them. A row joins the most similar earlier row of its project, language and entity that joined nothing
    itself and wasn't superseded before, by this row or an earlier one. Rows without an undecided earlier
    look-alike are settled as standing; whatever looks like a standing row is settled as joining; this
    repeats for the rest. A round settles at least the first row of every key, a group of near copies
    takes one. Whether an earlier row fits is decided before the most similar is taken.
    """
    on = ("project_id", "language", "entity_group")
    rows = rows.join(covered.groupBy(F.col("old_id").alias("id")).agg(F.min("new_seq").alias("_gone")), "id", "left")

    def alike(left: DataFrame, right: DataFrame) -> DataFrame:
        # A row that this one supersedes is gone at its own turn, too.
        return nearest_neighbours(left, right, 1, on=on, earlier=("seq", "seq"), until="_gone", floor=threshold)

    def without(df: DataFrame, ids: DataFrame, name: str = "left_id") -> DataFrame:
        return df.join(ids.select(F.col(name).alias("id")).distinct(), "id", "left_anti")

    waiting, standing = rows, None
    while True:
        settled = durable(without(waiting, alike(waiting, waiting)))
        standing = settled if standing is None else durable(standing.unionByName(settled))
        rest = without(waiting, settled, "id")
        waiting = durable(without(rest, alike(rest, settled)))
        if waiting.isEmpty():
            break
    best = alike(without(rows, standing, "id"), standing)
    return best.select(F.col("left_id").alias("memory_id"), F.col("right_id").alias("id"), "similarity")


def merge_append(memories: DataFrame, events: DataFrame, targets: DataFrame, now: datetime | Column) -> DataFrame:
    """Updated rows of the memories that absorbed events, appended in seq order."""
    at = now if isinstance(now, Column) else F.lit(now)
    joined = targets.join(events.select("event_id", "summary", "occurred_at", "is_correction", "surprise_score"),
                          "event_id")
    per_memory = joined.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "event_id", "summary"))).alias("_texts"),
        F.max_by("similarity", "seq").alias("_similarity"), F.min("occurred_at").alias("_occurred"),
        F.bool_or("is_correction").alias("_correction"), F.max("surprise_score").alias("_surprise"))
    effective = F.coalesce("occurred_at", "created_at")
    appended = F.array_join(F.transform("_texts", lambda t: t["summary"]), "\n")
    return memories.join(per_memory, "id").withColumns({
        "summary": F.concat_ws("\n", "summary", appended),
        "weight": W.clamp01(F.col("_similarity") + 0.1),
        "last_accessed_at": at,
        "occurred_at": F.when(F.col("_occurred") < effective, F.col("_occurred")).otherwise(F.col("occurred_at")),
        "is_correction": F.col("is_correction") | F.coalesce("_correction", F.lit(False)),
        "surprise_score": F.greatest("surprise_score", "_surprise"),
    }).drop("_texts", "_similarity", "_occurred", "_correction", "_surprise")


def create_new(events: DataFrame, now: datetime | Column) -> DataFrame:
    """Fresh episodic rows: one access now, so weight and frequency are 1."""
    at = now if isinstance(now, Column) else F.lit(now)
    none = F.lit(None).cast("timestamp")
    return events.select(
        T.stable_id("episodic", F.col("project_id"), F.col("event_id")).alias("id"), "project_id", "language",
        "task_type", "summary", F.lit("LLM").alias("source_type"), F.lit(V.TRUST_DEFAULT).alias("trust_level"),
        F.lit(1.0).alias("weight"), F.lit(1.0).alias("effective_frequency"), "entity_group", "context_vector",
        F.lit(None).cast("string").alias("full_snapshot_uri"), "is_correction", "surprise_score",
        at.alias("created_at"), none.alias("last_accessed_at"), none.alias("obsoleted_at"),
        F.coalesce("occurred_at", at).alias("occurred_at"))


def related_links(new: DataFrame, memories: DataFrame, candidates: int | None = None, block_rows: int = 20480) -> DataFrame:
    """RELATES_TO edges to the memories of the project (with ``candidates``, its heaviest): cosine where both
    sides carry a vector, token overlap otherwise.

    Both sides are cut into blocks, which meet tile by tile (:func:`token_links.linked`): frequent tokens and vectors as products of matrices, rare tokens
    pair by pair. A hot project spreads over many tasks and only links leave them. Tokens are compared by their hashes of 64 bits.
    """
    pool = memories.filter(F.col("obsoleted_at").isNull())
    if candidates is not None:
        pool = top_per_key(pool, ["project_id"], [F.desc("weight"), F.asc("id")], candidates, "_top")

    def side(df: DataFrame) -> DataFrame:
        return df.select("project_id", "id", F.col("context_vector").alias("vector"), F.col("summary").alias("text"))

    found = token_links.linked(side(new), side(pool), ["project_id"], V.SAME_INFORMATION_COSINE, V.TOKEN_LINK_JACCARD, block_rows)
    return found.select("from_id", "to_id", F.lit("RELATES_TO").alias("edge_type"), "strength")


def as_edges(links: DataFrame, now: datetime | Column, **properties: Column) -> DataFrame:
    """Edge rows with string properties."""
    at = now if isinstance(now, Column) else F.lit(now)
    pairs = [x for name, value in properties.items() for x in (F.lit(name), value.cast("string"))]
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return links.select(F.col("from_id").cast("string"), F.col("to_id").cast("string"), "edge_type",
                        props.alias("properties"), at.alias("created_at"))


def triggered_pitfalls(new: DataFrame, pitfalls: DataFrame, block_rows: int = 4096, listed: int = 8192) -> DataFrame:
    """TRIGGERED_PITFALL edges of debug memories to the active pitfalls of their entity.

    The memories of an entity are dealt by their id over parts of about ``block_rows`` (8 parts at least), and its pitfalls go to each part as lists of at most ``listed`` ids: the
    edges of few entities are the work of many tasks, and a pitfall goes out only as often as its entity has parts.
    """
    keys = ["project_id", "entity_id"]
    debug = new.filter((F.col("task_type") == "debug") & (F.col("entity_group") != "")).select(
        F.col("id").alias("from_id"), "project_id", F.col("entity_group").alias("entity_id"))
    active = pitfalls.filter(F.col("obsoleted_at").isNull()).select(F.col("id").alias("to_id"), *keys)
    least = min(8, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = debug.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / block_rows), F.lit(least)).alias("_parts"))
    # A null id is wrapped, as lists leave out nulls.
    lists = active.join(active.groupBy(*keys).agg(F.ceil(F.count("*") / listed).alias("_lists")), keys).groupBy(
        *keys, F.pmod(F.xxhash64("to_id"), F.col("_lists")).alias("_list")).agg(F.collect_list(F.struct("to_id")).alias("_to"))
    met = lists.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).select(*keys, "_part", "_to")
    dealt = debug.join(parts, keys).select("from_id", *keys, F.pmod(F.xxhash64("from_id"), F.col("_parts")).alias("_part"))
    found = spread_ids(dealt, *keys, "_part").join(spread_ids(met, *keys, "_part"), [*keys, "_part"])
    return found.select("from_id", F.inline("_to")).select("from_id", "to_id", F.lit("TRIGGERED_PITFALL").alias("edge_type"))


def touch(memories: DataFrame, touches: DataFrame, now: datetime | Column) -> DataFrame:
    """Touched rows: accessed now, weight restarted from 1 and aged, frequency + count."""
    at = now if isinstance(now, Column) else F.lit(now)
    counts = touches.groupBy("id").agg(F.count("*").alias("_n"))
    return memories.join(counts, "id").withColumns({
        "last_accessed_at": at,
        "weight": W.decayed_weight(F.lit(1.0), F.col("created_at"), at, at),
        "effective_frequency": F.col("effective_frequency") + F.col("_n"),
    }).drop("_n")


def typed_lookup(ids: DataFrame, episodic: DataFrame, semantic: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """id, kind, weight, frequency; episodic before semantic before pitfall."""
    tagged = [
        episodic.select("id", F.lit(0).alias("_p"), F.lit("episodic").alias("kind"), "weight",
                        F.col("effective_frequency").alias("frequency")),
        semantic.select("id", F.lit(1).alias("_p"), F.lit("semantic").alias("kind"), "weight",
                        F.col("effective_frequency").alias("frequency")),
        pitfalls.select("id", F.lit(2).alias("_p"), F.lit("pitfall").alias("kind"), "weight",
                        F.lit(1.0).alias("frequency")),
    ]
    found = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).join(ids.select("id").distinct(), "id")
    best = found.groupBy("id").agg(F.min_by(F.struct("kind", "weight", "frequency"), "_p").alias("b"))
    return best.select("id", "b.*")


def apply_feedback(targets: DataFrame, feedback: DataFrame) -> DataFrame:
    """New weight and frequency of each target (id, kind, weight, frequency).

    ``feedback`` has memory_id, seq (unique, however sparse), action. Events of one
    memory apply in seq order with the weight clamped to [0, 1] after each;
    unknown actions are dropped.
    """
    delta = W.feedback_delta(F.col("action"), F.col("action") == "corrected")
    valid = feedback.filter(F.col("action").isin(V.SEARCH_ACTIONS)).select(
        F.col("memory_id").alias("id"), "seq", delta.alias("delta"))
    steps = clamped_sum(valid, "id", "seq", "delta")
    moved = valid.groupBy("id").agg(F.sum(F.abs("delta")).alias("_moved"))
    out = targets.join(steps, "id").join(moved, "id")
    weight = apply_clamped(F.col("weight"), F.col("shift"), F.col("floor"), F.col("ceiling"))
    return out.select("id", "kind", weight.alias("weight"), (F.col("frequency") + F.col("_moved")).alias("frequency"),
                      "events")


def invalid_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(~F.col("action").isin(V.SEARCH_ACTIONS) | F.col("action").isNull())
