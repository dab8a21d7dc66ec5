"""Retrieval for tables of questions: every question is answered in one job."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, vectors as X, weights as W
from mnemospark.operators import linkage
from mnemospark.operators.ranking import block_pairs, durable, nearest_neighbours, overlap_topk, pinned, top_per_key


def structured_filter(
    memories: DataFrame, *, project_id: str | None = None, language: str | None = None,
    task_type: str | None = None, min_weight: float = 0.0, include_obsolete: bool = False,
    occurred_after: datetime | None = None, occurred_before: datetime | None = None,
) -> DataFrame:
    """Optional equality, weight and inclusive event-time conditions; pushed to the scan."""
    out = memories
    for name, value in (("project_id", project_id), ("language", language), ("task_type", task_type)):
        if value:
            out = out.filter(F.col(name) == value)
    if min_weight > 0:
        out = out.filter(F.col("weight") >= min_weight)
    if not include_obsolete:
        out = out.filter(F.col("obsoleted_at").isNull())
    if occurred_after is not None:
        out = out.filter(F.col("occurred_at") >= F.lit(occurred_after))
    if occurred_before is not None:
        out = out.filter(F.col("occurred_at") <= F.lit(occurred_before))
    return out


def structured_topk(memories: DataFrame, k: int = 10, newest: bool = False, **conditions) -> DataFrame:
    order = F.desc("occurred_at") if newest else F.desc("weight")
    return structured_filter(memories, **conditions).orderBy(order, F.asc("id")).limit(k)


def surprise_topk(memories: DataFrame, k: int, boost: float, **conditions) -> DataFrame:
    """Weight times (1 + boost * surprise), best first."""
    scored = structured_filter(memories, **conditions).withColumn(
        "score", F.col("weight") * (1 + boost * F.col("surprise_score")))
    return scored.orderBy(F.desc("score"), F.desc("weight"), F.asc("id")).limit(k)


def score_topk(scores: DataFrame, k: int, keys: list[str], score: str = "score", index: str = "index") -> DataFrame:
    """Best k scores per key, lower index first on ties; none for k <= 0."""
    return top_per_key(scores, keys, [F.desc(score), F.asc(index)], k)


def recent_scan(memories: DataFrame, since: datetime | Column, limit: int | None = None) -> DataFrame:
    """Active memories created since, with ``scan_rank`` to order them newest first: a key that falls with time,
    or the rank per project where only the ``limit`` newest are asked for."""
    at = since if isinstance(since, Column) else F.lit(since)
    recent = memories.filter((F.col("created_at") >= at) & F.col("obsoleted_at").isNull())
    if limit is None:
        return recent.withColumn("scan_rank", -F.unix_micros("created_at"))
    return top_per_key(recent, ["project_id"], [F.desc("created_at"), F.asc("id")], limit, "scan_rank")


def cosine_topk(questions: DataFrame, memories: DataFrame, k: int, surprise_boost: float = 0.0,
                on: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """question_id, id, similarity, rank. ``surprise_boost`` reorders by boosted cosine."""
    if surprise_boost <= 0:
        found = nearest_neighbours(
            questions, memories, k, on=on, left_id="question_id", left_vector="query_vector")
        return found.withColumnsRenamed({"left_id": "question_id", "right_id": "id"})
    pairs = _heads(questions, _scored_memories(memories, on), on, k, surprise_boost).withColumnRenamed("sem", "similarity")
    order = [F.desc("similarity"), F.desc("weight"), F.asc("id")]
    return top_per_key(pairs, ["question_id"], order, k).select("question_id", "id", "similarity", "rank")


def vector_then_filter(questions: DataFrame, memories: DataFrame, k: int, conditions: Column) -> DataFrame:
    """Global top 3k by cosine first, then the conditions, then the best k of what is left."""
    pool = nearest_neighbours(questions, memories, 3 * k, on=(), left_id="question_id", left_vector="query_vector")
    pool = pool.withColumnsRenamed({"left_id": "question_id", "right_id": "id", "rank": "pool_rank"})
    kept = pool.join(memories, "id").filter(conditions)
    order = [F.desc("similarity"), F.desc("weight"), F.asc("id")]
    return top_per_key(kept, ["question_id"], order, k).select("question_id", "id", "similarity", "pool_rank", "rank")


# --- gating ------------------------------------------------------------------

def gated_pairs(contexts: DataFrame, memories: DataFrame, cooling: float = V.COOLING_THRESHOLD) -> DataFrame:
    """Hard gate (project, active, not cooled) and soft boost for each context."""
    alive = memories.filter(F.col("obsoleted_at").isNull() & (F.col("weight") >= cooling))
    ctx = contexts.select("question_id", "project_id", F.col("language").alias("context_language"),
                          F.col("task_type").alias("context_task"))
    mem = alive.select("id", "project_id", "language", "weight")
    boost = W.gating_boost(F.col("context_task"), F.col("context_language"), F.col("language"))
    return ctx.join(mem, "project_id").withColumn("boosted", F.col("weight") * boost)


def gate_and_rank(contexts: DataFrame, memories: DataFrame, cap: int | None = None, cooling: float = V.COOLING_THRESHOLD) -> DataFrame:
    """All gated pairs, or the best ``cap`` of each context with their rank.

    With a cap no pair beyond twice the cap is made: the boost depends on whether the task is known and the languages agree, so rows are
    ranked once per (project, task known) and once per (project, task known, language). Who is ahead of a row there is ahead of it in
    every context that gives it that boost, since agreeing languages only raise a row; so the two heads hold the best ``cap``.
    """
    if cap is None:
        return gated_pairs(contexts, memories, cooling)
    alive = memories.filter(F.col("obsoleted_at").isNull() & (F.col("weight") >= cooling)).select("id", "project_id", "language", "weight")
    alive = alive.withColumn("_known", F.explode(F.array(F.lit(False), F.lit(True))))
    ctx = contexts.select("question_id", "project_id", F.col("language").alias("context_language"), F.col("task_type").alias("context_task"),
                          F.coalesce(F.col("task_type").isin(V.TASK_TYPES), F.lit(False)).alias("_known"))
    task = F.when(F.col("_known"), F.lit(V.TASK_TYPES[0]))

    def heads(keys: list[str], spoken: Column) -> DataFrame:
        boosted = F.col("weight") * W.gating_boost(task, spoken, F.col("language"))
        return top_per_key(alive.withColumn("_boosted", boosted), keys, [F.desc("_boosted"), F.asc("id")], cap).drop("_boosted", "rank")

    anyone = ctx.join(heads(["project_id", "_known"], F.lit("")), ["project_id", "_known"])
    agreeing = heads(["project_id", "_known", "language"], F.col("language")).withColumn("context_language", F.col("language"))
    agreed = ctx.filter("context_language <> ''").join(agreeing, ["project_id", "_known", "context_language"])
    pairs = anyone.unionByName(agreed).drop("_known").dropDuplicates(["question_id", "id"])
    boost = W.gating_boost(F.col("context_task"), F.col("context_language"), F.col("language"))
    return top_per_key(pairs.withColumn("boosted", F.col("weight") * boost), ["question_id"], [F.desc("boosted"), F.asc("id")], cap)


def two_stage(questions: DataFrame, memories: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """Gate, then rank what passes (with ``cap``, its heaviest rows) by cosine.

    The gate depends on the memory alone but for its order, so without a cap the
    blocked neighbour search runs over what is alive and no pair is stored.
    """
    if cap is None:
        alive = memories.filter(F.col("obsoleted_at").isNull() & (F.col("weight") >= V.COOLING_THRESHOLD))
        found = nearest_neighbours(questions, alive, k, left_id="question_id", left_vector="query_vector", weight=None)
        return found.withColumnsRenamed({"left_id": "question_id", "right_id": "id"}).select("question_id", "id", "similarity", "rank")
    gated = gate_and_rank(questions, memories, cap).select("question_id", "id")
    scored = (
        gated.join(memories.select("id", "context_vector"), "id")
        .join(questions.select("question_id", "query_vector"), "question_id")
        .filter(F.col("context_vector").isNotNull())
        .withColumn("similarity", F.round(X.cosine(F.col("query_vector"), F.col("context_vector")), 9))
    )
    best = top_per_key(scored, ["question_id"], [F.desc("similarity"), F.asc("id")], k)
    return best.select("question_id", "id", "similarity", "rank")


def gate_stats(questions: DataFrame, memories: DataFrame, cap: int | None = None) -> DataFrame:
    """total_candidates and after_filter per question, from counts alone."""
    alive = F.col("obsoleted_at").isNull() & (F.col("weight") >= V.COOLING_THRESHOLD)
    per_project = memories.groupBy("project_id").agg(
        F.count("*").alias("total_candidates"),
        F.least(F.sum(alive.cast("bigint")), F.lit(2**62 if cap is None else cap)).alias("after_filter"))
    stats = questions.select("question_id", "project_id").join(per_project, "project_id", "left")
    return stats.select("question_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                         for c in ("total_candidates", "after_filter")])


# --- rank fusion -------------------------------------------------------------

def _scored_memories(memories: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Active memories with vector, bigram set and what ranking needs."""
    return memories.filter(F.col("obsoleted_at").isNull()).select(
        "id", *on, F.col("context_vector").alias("vector"), T.char_bigrams(F.col("summary"), fold_case=True).alias("grams"), "weight",
        F.coalesce("surprise_score", F.lit(0.0)).alias("surprise_score"), F.unix_micros("occurred_at").alias("at"))


def _scored_blocks(questions: DataFrame, scored: DataFrame, on: tuple[str, ...], *extra: str):
    """Question and memory blocks with vectors, bigram sets and what ranking needs; ``extra`` question columns ride along."""
    def at(name: str) -> Column:
        return (F.unix_micros(name) if name in questions.columns else F.lit(None).cast("bigint")).alias(name)

    q = questions.select("question_id", *on, F.col("query_vector").alias("vector"), T.char_bigrams(F.col("query"), fold_case=True).alias("grams"),
                         at("occurred_after"), at("occurred_before"), *extra)
    return block_pairs(q, scored, on, "question_id", "id", 256, 2048)


def _block_scores(left: pd.DataFrame, right: pd.DataFrame, lexical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and bigram overlap of every pair of two blocks at nine decimals; NaN where there is none."""
    shape = (len(left), len(right))
    sem, lex = np.full(shape, np.nan), np.full(shape, np.nan)
    for size in {len(v) for v in left["l_vector"] if v is not None}:
        def unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            at = np.array([i for i, v in enumerate(column) if v is not None and len(v) == size], np.int64)
            x = np.array([column.iloc[i] for i in at], np.float64).reshape(len(at), size)
            norm = np.sqrt((x * x).sum(1))
            return at[norm > 0], x[norm > 0] / norm[norm > 0, None]

        (i, x), (j, y) = unit(left["l_vector"]), unit(right["r_vector"])
        sem[np.ix_(i, j)] = np.round(x @ y.T, 9)
    if lexical:
        def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sets = [np.zeros(0, np.int64) if g is None else np.asarray(g, np.int64) for g in column]
            sizes = np.array([len(g) for g in sets])
            return np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.zeros(0, np.int64)]), sizes

        (own_l, gram_l, size_l), (own_r, gram_r, size_r) = flat(left["l_grams"]), flat(right["r_grams"])
        known = np.unique(gram_l)
        shared = np.zeros(shape, np.float32)
        at_l = np.searchsorted(known, gram_l)
        at_r = np.minimum(np.searchsorted(known, gram_r), max(len(known) - 1, 0))
        hit = known[at_r] == gram_r if len(known) else np.zeros(0, np.bool_)
        own_r, at_r = (own_r[hit], at_r[hit]) if len(known) else (own_r[:0], at_r[:0])
        for start in range(0, len(known), 4096):
            width = min(4096, len(known) - start)
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            here = (at_l >= start) & (at_l < start + width)
            a[own_l[here], at_l[here] - start] = 1
            here = (at_r >= start) & (at_r < start + width)
            b[own_r[here], at_r[here] - start] = 1
            shared += a @ b.T
        # Half up, as SQL rounds.
        dice = np.floor(2.0 * shared.astype(np.float64) / np.maximum(size_l[:, None] + size_r[None, :], 1) * 1e9 + 0.5) / 1e9
        lex = np.where(dice > 0, dice, np.nan)
    after, before = (left[f"l_occurred_{w}"].to_numpy(np.float64, na_value=np.nan)[:, None] for w in ("after", "before"))
    at = right["r_at"].to_numpy(np.float64, na_value=np.nan)[None, :]
    outside = (~np.isnan(after) & ~(at >= after)) | (~np.isnan(before) & ~(at <= before))
    sem[outside], lex[outside] = np.nan, np.nan
    return sem, lex


def _first(values: np.ndarray, weight: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one question: value, weight descending, then id."""
    at = np.flatnonzero(~np.isnan(values))
    if len(at) > k:
        at = at[values[at] >= np.partition(values[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((code[at], -weight[at], -values[at]))[:k]]


def _head_rows(depth: int, boost: float | None):
    """Rows that may be among the first ``depth`` of a channel; with ``boost`` the one channel is boosted cosine."""

    def heads(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("question_id", "id", "weight", "surprise_score", "occurred_at", "sem", "lex")}
        if len(left) and len(right):
            sem, lex = _block_scores(left, right, boost is None)
            weight, surprise = right["r_weight"].to_numpy(np.float64), right["r_surprise_score"].to_numpy(np.float64)
            ids, code = right["r_id"].to_numpy(), pd.factorize(right["r_id"], sort=True)[0]
            channels = (sem, lex) if boost is None else (np.round(sem * (1 + boost * surprise), 9),)
            rows, cols = [], []
            for i in range(len(left)):
                at = np.unique(np.concatenate([_first(c[i], weight, code, depth) for c in channels]))
                rows.append(np.full(len(at), i))
                cols.append(at)
            i, j = np.concatenate(rows), np.concatenate(cols)
            out = {"question_id": left["l_question_id"].to_numpy()[i], "id": ids[j], "weight": weight[j], "surprise_score": surprise[j],
                   "occurred_at": right["r_at"].to_numpy()[j], "sem": channels[0][i, j] if boost is not None else sem[i, j], "lex": lex[i, j]}
        return pd.DataFrame(out)

    return heads


def _count_rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """How many pairs of a block come right behind each number of the question's thresholds, by channel."""
    out: dict[str, list] = {"question_id": [], "channel": [], "at": [], "n": []}
    if len(left) and len(right):
        sem, lex = _block_scores(left, right)
        weight, ids = right["r_weight"].to_numpy(np.float64), right["r_id"].to_numpy()
        for i in range(len(left)):
            for channel, values in (("sem", sem[i]), ("lex", lex[i])):
                key_s, key_w, key_i = (left[f"l_{channel}_{f}"].iloc[i] for f in "swi")
                at = np.flatnonzero(~np.isnan(values))
                if key_s is None or not len(key_s) or not len(at):
                    continue
                s, w = np.concatenate((key_s, values[at])), np.concatenate((key_w, weight[at]))
                code = pd.factorize(np.concatenate((np.asarray(key_i, ids.dtype), ids[at])), sort=True)[0]
                pair = np.arange(len(s)) >= len(key_s)
                order = np.lexsort((pair, code, -w, -s))
                passed = np.cumsum(~pair[order])[pair[order]]
                place, n = np.unique(passed, return_counts=True)
                out["question_id"] += [left["l_question_id"].iloc[i]] * len(place)
                out["channel"] += [channel] * len(place)
                out["at"] += place.tolist()
                out["n"] += n.tolist()
    return pd.DataFrame(out).astype({"channel": object})


def _heads(questions: DataFrame, scored: DataFrame, on: tuple[str, ...], depth: int, boost: float | None = None) -> DataFrame:
    left, right = _scored_blocks(questions, scored, on)
    kinds = dict(questions.dtypes) | dict(scored.select("id").dtypes)
    found = left.cogroup(right).applyInPandas(_head_rows(depth, boost), (
        f"question_id {kinds['question_id']}, id {kinds['id']}, weight double, surprise_score double, occurred_at bigint, sem double, lex double"))
    return found.withColumns({"occurred_at": F.timestamp_micros("occurred_at"), "sem": F.nanvl("sem", F.lit(None)), "lex": F.nanvl("lex", F.lit(None))})


def fusion_depth(k: int, rrf_k: int, boost: float) -> int:
    """How deep each channel must be read so that the fused top k cannot be missed.

    A row below depth L in both channels scores at most (1+b)*2/(K+L+1); the
    first k of either channel score at least 1/(K+k). L = ceil(2(1+b)(K+k)) - K
    puts the first below the second, so such a row is never in the top k.
    Surprise lies in [0, 1].
    """
    return max(k, math.ceil(2 * (1 + boost) * (rrf_k + k)) - rrf_k)


def rrf_topk(questions: DataFrame, memories: DataFrame, k: int = V.EPISODE_TOP, rrf_k: int = V.RRF_K,
             surprise_boost: float = 0.0, on: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Reciprocal rank fusion of cosine and bigram overlap; exact top k per question.

    Ranking a question's whole project in a window would put an unbounded group
    into one task. Instead questions and memories meet in blocks, as matrix
    products, and each block sends on its first L rows of either channel (see
    :func:`fusion_depth`); the other-channel rank of those few candidates is found
    by a second pass that sends on only how many pairs beat them. Both passes read the
    memories' bigram sets from one table, so no text is looked at twice.
    Columns: question_id, id, score, rank, sem_rank, lex_rank, occurred_at.
    """
    depth = fusion_depth(k, rrf_k, surprise_boost)
    scored = linkage.durable(_scored_memories(memories, on))
    pairs = durable(_heads(questions, scored, on, depth))
    tie = [F.desc("weight"), F.asc("id")]
    columns = ["question_id", "id", "weight", "surprise_score", "occurred_at", "sem", "lex"]

    channels = F.filter(F.array(
        F.struct(F.lit("sem").alias("channel"), F.col("sem").alias("value")),
        F.struct(F.lit("lex").alias("channel"), F.col("lex").alias("value"))), lambda c: c["value"].isNotNull())
    both = pairs.select(*columns, F.inline(channels))
    heads = top_per_key(both, ["question_id", "channel"], [F.desc("value"), *tie], depth)
    candidates = heads.groupBy(*columns).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in ("sem", "lex")])

    # Best-first thresholds of the candidates whose rank in a channel is still open.
    def open_keys(channel: str) -> Column:
        key = F.struct(F.col(channel).alias("s"), F.col("weight").alias("w"), F.col("id").alias("i"))
        return F.collect_list(F.when(F.col(f"{channel}_rank").isNull() & F.col(channel).isNotNull(), key))

    def best_first(rows: Column) -> Column:
        return F.array_sort(rows, lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] > b["s"], -1).otherwise(1))
                            .when(a["w"] != b["w"], F.when(a["w"] > b["w"], -1).otherwise(1))
                            .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))

    thresholds = candidates.groupBy("question_id").agg(
        best_first(open_keys("sem")).alias("sem_keys"), best_first(open_keys("lex")).alias("lex_keys"))

    thresholds = durable(thresholds)
    parts = {f"{c}_{f}": F.col(f"{c}_keys.{f}") for c in ("sem", "lex") for f in "swi"}
    keyed = questions.join(thresholds.select("question_id", *[c.alias(n) for n, c in parts.items()]), "question_id")
    left, right = _scored_blocks(keyed, scored, on, *parts)
    beaten = left.cogroup(right).applyInPandas(
        _count_rows, f"question_id {dict(questions.dtypes)['question_id']}, channel string, at int, n bigint",
    ).groupBy("question_id", "channel", "at").agg(F.sum("n").alias("n"))
    opened = thresholds.select("question_id", F.explode(F.array(
        F.struct(F.lit("sem").alias("channel"), F.col("sem_keys").alias("keys")),
        F.struct(F.lit("lex").alias("channel"), F.col("lex_keys").alias("keys")))).alias("o")
    ).select("question_id", "o.channel", F.posexplode("o.keys").alias("at", "key"))
    upto = Window.partitionBy("question_id", "channel").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        opened.join(beaten, ["question_id", "channel", "at"], "left")
        .withColumn("r", 1 + F.sum(F.coalesce("n", F.lit(0))).over(upto))
        .groupBy("question_id", F.col("key.i").alias("id"))
        .agg(F.max(F.when(F.col("channel") == "sem", F.col("r"))).alias("sem_counted"),
             F.max(F.when(F.col("channel") == "lex", F.col("r"))).alias("lex_counted"))
    )
    ranked = candidates.join(counted, ["question_id", "id"], "left").select(
        *columns, F.coalesce("sem_rank", "sem_counted").cast("bigint").alias("sem_rank"),
        F.coalesce("lex_rank", "lex_counted").cast("bigint").alias("lex_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))

    fused = ranked.withColumn("score", F.round(
        (share("sem_rank") + share("lex_rank")) * (1 + surprise_boost * F.col("surprise_score")), 12))
    best = top_per_key(fused, ["question_id"], [F.desc("score"), *tie], k)
    return best.select("question_id", "id", "score", "rank", "sem_rank", "lex_rank", "occurred_at")


def newest_first(ranked: DataFrame, when: Column | None = None) -> DataFrame:
    """Re-order each question's top k by event time where ``when`` holds (default everywhere)."""
    flag = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    window = Window.partitionBy("question_id").orderBy(
        F.when(flag, F.col("occurred_at")).desc_nulls_last(), F.asc("rank"))
    return ranked.withColumn("display_rank", F.row_number().over(window))


def lexical_topk(questions: DataFrame, memories: DataFrame, k: int = V.EPISODE_TOP,
                 pool: int | None = None) -> DataFrame:
    """Bigram overlap with the memories (with ``pool``, the most recent ones) of the question's project, best k."""
    active = memories.filter(F.col("obsoleted_at").isNull())
    if pool is not None:
        active = top_per_key(active, ["project_id"], [F.desc("created_at"), F.asc("id")], pool, "_recent")
    m = pinned(active, grams=T.char_bigrams(F.col("summary"), True)).withColumn("at", F.col("occurred_at"))
    q = pinned(questions, grams=T.char_bigrams(F.col("query"), True)).withColumn("id", F.col("question_id"))
    q = q.withColumns({n: F.col(f"occurred_{n}") for n in ("after", "before") if f"occurred_{n}" in questions.columns})
    best = overlap_topk(q, m, k)
    return best.select(F.col("left_id").alias("question_id"), F.col("right_id").alias("id"), "score", "rank", F.col("at").alias("occurred_at"))


def token_matches(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id) whose texts share enough tokens, found through the tokens.

    Both sides have id, text and ``on``. Sharing one token is necessary, so the
    join runs on the token and pairs without any never meet; matches add up in
    the map-side part of the aggregation.
    """
    lt = left.select(F.col("id").alias("left_id"), *on, T.tokens(F.col("text")).alias("_t")).select(
        "left_id", *on, F.size("_t").alias("_ls"), F.explode(F.array_distinct("_t")).alias("token"))
    rt = right.select(F.col("id").alias("right_id"), *on, T.tokens(F.col("text")).alias("_t")).select(
        "right_id", *on, F.size("_t").alias("_rs"), F.explode("_t").alias("token"))
    shared = rt.join(lt, [*on, "token"]).groupBy("left_id", "right_id", "_ls", "_rs").agg(F.count("*").alias("_m"))
    return shared.filter(T.enough_tokens(F.col("_m"), F.col("_ls"), F.col("_rs"))).select("left_id", "right_id")


def heaviest(questions: DataFrame, memories: DataFrame, k: int, hard_language: bool = False) -> DataFrame:
    """question_id, id, weight: the k heaviest rows that pass each question's hard gate; with ``hard_language`` of its language, if it names one.

    What passes depends on the project and the language alone, so rows are ranked once for each of these and only k meet a question.
    """
    alive = memories.filter(F.col("obsoleted_at").isNull() & (F.col("weight") >= V.COOLING_THRESHOLD)).select("id", "project_id", "language", "weight")
    asked = questions.select("question_id", "project_id", "language")

    def heads(rows: DataFrame, keys: list[str]) -> DataFrame:
        first = top_per_key(alive, keys, [F.desc("weight"), F.asc("id")], k).select(*keys, "id", "weight")
        return rows.join(first, keys).select("question_id", "id", "weight")

    if not hard_language:
        return heads(asked, ["project_id"])
    return heads(asked.filter("language = ''"), ["project_id"]).unionByName(heads(asked.filter("language <> ''"), ["project_id", "language"]))


def mixed_search(questions: DataFrame, memories: DataFrame, rules: DataFrame, pitfalls: DataFrame, k: int,
                 hard_language: bool = False) -> DataFrame:
    """Gated episodes (relevance = weight), overlapping rules (0.5), entity pitfalls (0.6).

    Each branch is trimmed to k per question before the union, since no branch
    can place more than k rows.
    """
    def best(df: DataFrame) -> DataFrame:
        order = [F.desc("relevance"), F.asc("kind"), F.asc("id")]
        return top_per_key(df, ["question_id"], order, k)

    episodes = heaviest(questions, memories, k, hard_language).select(
        "question_id", F.lit("episodic").alias("kind"), "id", F.col("weight").alias("relevance"))
    semantic = token_matches(
        questions.select(F.col("question_id").alias("id"), "project_id", F.col("query").alias("text")),
        rules.filter(F.col("obsoleted_at").isNull()).select("id", "project_id", F.col("content").alias("text")),
        on=("project_id",),
    ).select(F.col("left_id").alias("question_id"), F.lit("semantic").alias("kind"), F.col("right_id").alias("id"),
             F.lit(0.5).alias("relevance"))
    anchored = questions.filter("entity_id <> ''").select("question_id", "project_id", "entity_id").join(
        pitfalls.filter(F.col("obsoleted_at").isNull()), ["project_id", "entity_id"])
    top_pitfalls = top_per_key(anchored, ["question_id"], pitfall_priority(), V.PITFALL_TOP).select(
        "question_id", F.lit("pitfall").alias("kind"), "id", F.lit(0.6).alias("relevance"))
    branches = [best(b).drop("rank") for b in (episodes, semantic, top_pitfalls)]
    return best(branches[0].unionByName(branches[1]).unionByName(branches[2]))


def pitfall_priority() -> list[Column]:
    """User-corrected first, then occurrences, then weight."""
    return [F.desc("was_user_corrected"), F.desc("occurrence_count"), F.desc("weight"), F.asc("id")]
