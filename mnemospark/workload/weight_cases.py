"""Weights, decay, gating flags, text functions."""

from pyspark.sql import functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, vectors as X, weights as W
from mnemospark.operators import evaluate, retrieve
from mnemospark.operators.ranking import nearest_rank_percentiles
from mnemospark.workload import oracle_views as O
from mnemospark.workload.registry import big, case, r6
from mnemospark.workload.views import NOW


def at():
    return F.lit(NOW)


@case("effective_frequency", f"""
SELECT user_id AS id, count(*) AS accesses,
 round(sum(exp(-0.1::DOUBLE * {O.days('ts', O.NOW)})), 6) AS effective_frequency
FROM events GROUP BY user_id""")
def effective_frequency(v):
    return v.table("events").groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("accesses"), r6(F.sum(W.access_contribution(F.col("ts"), at()))).alias("effective_frequency"))


@case("full_weight", f"""
WITH f AS (SELECT user_id AS id, sum(exp(-0.1::DOUBLE * {O.days('ts', O.NOW)})) AS freq, min(ts) AS created, max(ts) AS accessed
 FROM events GROUP BY user_id)
SELECT c_custkey AS id, round(coalesce(freq, 0.0::DOUBLE), 6) AS frequency,
 round(coalesce(freq * exp(-0.005::DOUBLE * {O.days('created', O.NOW)}) * exp(-0.05::DOUBLE * {O.days('accessed', O.NOW)}), 0.0::DOUBLE), 6) AS weight
FROM customer LEFT JOIN f ON id = c_custkey""")
def full_weight(v):
    """Customers are the memories; those without an access weigh 0."""
    freq = v.table("events").groupBy(F.col("user_id").alias("id")).agg(
        F.sum(W.access_contribution(F.col("ts"), at())).alias("f"), F.min("ts").alias("c"), F.max("ts").alias("a"))
    joined = v.table("customer").select(F.col("c_custkey").alias("id")).join(freq, "id", "left")
    weight = W.decayed_weight(F.col("f"), F.col("c"), F.col("a"), at())
    return joined.select("id", r6(F.coalesce("f", F.lit(0.0))).alias("frequency"),
                         r6(F.coalesce(weight, F.lit(0.0))).alias("weight"))


@case("surprise_decay", O.with_views("epi") + f"""
SELECT id, round(1.0::DOUBLE / (1.0::DOUBLE + 2.0::DOUBLE * surprise_score), 6) AS scale,
 round(weight * exp(-0.005::DOUBLE * {O.days('created_at', O.NOW)} / (1 + 2 * surprise_score))
  * exp(-0.05::DOUBLE * {O.days('created_at', O.NOW)} / (1 + 2 * surprise_score)), 6) AS weight
FROM v_epi""")
def surprise_decay(v):
    s = F.col("surprise_score")
    return v.epi().select("id", r6(W.surprise_scale(s)).alias("scale"), r6(W.decayed_weight(
        F.col("weight"), F.col("created_at"), F.col("created_at"), at(), s)).alias("weight"))


@case("weight_detail", O.with_views("epi") + f"""
SELECT id, round(effective_frequency, 6) AS frequency_part, round(exp(-0.005::DOUBLE * {O.days('created_at', O.NOW)}), 6) AS age_part,
 round(exp(-0.05::DOUBLE * {O.days('created_at', O.NOW)}), 6) AS idle_part FROM v_epi""")
def weight_detail(v):
    days = W.days_between(F.col("created_at"), at())
    return v.epi().select("id", r6("effective_frequency").alias("frequency_part"),
                          r6(F.exp(-V.ALPHA_AGE * days)).alias("age_part"), r6(F.exp(-V.BETA_IDLE * days)).alias("idle_part"))


@case("protection_decay", O.with_views("pit") + f"""
SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * exp(-{O.days('last_occurred_at', O.NOW)} / 30.0::DOUBLE * pow(2.0::DOUBLE, -least(3, protection_level))))), 6) AS weight
FROM v_pit""")
def protection_decay(v):
    days = W.days_between(F.col("last_occurred_at"), at())
    return v.pit().select("id", r6(W.protection_decayed_weight(F.col("weight"), F.col("protection_level"), days)).alias("weight"))


@case("cooled_flags", O.with_views("epi") + f"""
SELECT project_id, count(*) AS memories, CAST(sum(CASE WHEN w < 0.01::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS cooled
FROM (SELECT project_id, weight * exp(-0.055::DOUBLE * {O.days('created_at', O.NOW)}) AS w FROM v_epi) GROUP BY 1""")
def cooled_flags(v):
    weight = W.decayed_weight(F.col("weight"), F.col("created_at"), F.col("created_at"), at())
    return v.epi().groupBy("project_id").agg(
        F.count("*").alias("memories"), F.sum(big(W.is_cooled(weight))).alias("cooled"))


@case("feedback_delta", O.with_views("feedback") + f"""
SELECT memory_id, seq, action, round({O.feedback_delta('action')}, 6) AS delta FROM v_feedback""")
def feedback_delta(v):
    action = F.col("action")
    return v.feedback().select("memory_id", "seq", "action", r6(W.feedback_delta(action, action == "corrected")).alias("delta"))


@case("surprise_score", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE,
 CASE WHEN event_type = 'error' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN value > 100 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) END AS surprise
FROM events""")
def surprise_score(v):
    kind = F.col("event_type")
    return v.table("events").select("event_id", r6(W.surprise_score(
        kind == "signup", kind == "error", F.col("value") > 100)).alias("surprise"))


@case("source_trust", """
SELECT p_partkey AS id, s AS source_type, CASE s WHEN 'USER' THEN 5 WHEN 'AST' THEN 4 WHEN 'DEBUG' THEN 3 WHEN 'INFERRED' THEN 2
 WHEN 'LLM' THEN 1 ELSE 3 END::BIGINT AS trust
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'USER' WHEN 1 THEN 'AST' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFERRED' WHEN 4 THEN 'LLM' ELSE 'DELEGATION' END AS s FROM part)""")
def source_trust(v):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("USER", "AST", "DEBUG", "INFERRED", "LLM", "DELEGATION")]),
                        (F.col("p_size") % 6 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), kind.alias("source_type"),
                                  big(W.source_trust(kind)).alias("trust"))


@case("interference", O.with_views("pit") + f"""
SELECT id, ({O.normal_status('status')}) AS status, CAST({O.injectable()} AS INTEGER) AS injectable,
 round(CASE WHEN times_shown <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, times_suppressed / times_shown::DOUBLE) END, 6) AS rate
FROM v_pit""")
def interference(v):
    return v.pit().select(
        "id", W.normal_status(F.col("status")).alias("status"),
        W.injectable(F.col("status"), F.col("occurrence_count"), F.col("weight")).cast("int").alias("injectable"),
        r6(W.interference_rate(F.col("times_shown"), F.col("times_suppressed"))).alias("rate"))


@case("latency_percentile", """
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
 count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT unnest([50.0, 95.0, 99.0])::DOUBLE AS p)
SELECT event_type, p, round(min(value), 6) AS percentile, n FROM n, p WHERE r >= ceil(p / 100 * n) GROUP BY event_type, p, n""")
def latency_percentile(v):
    return nearest_rank_percentiles(v.table("events"), ["event_type"], "value", [50, 95, 99]).withColumn(
        "percentile", r6("percentile"))


@case("arm_rates", """
WITH o AS (SELECT 'p' || (user_id % 10) AS project_id, event_type = 'error' AS b, event_type = 'error' AND value > 50 AS g,
 event_type = 'error' AND value > 150 AS m, value > 20 AS i, value > 20 AND event_type = 'click' AS u, value > 20 AND event_type = 'view' AS s FROM events),
t AS (SELECT project_id, count(*) AS edits, sum(b::INT) AS b, sum(g::INT) AS g, sum(m::INT) AS m, sum(i::INT) AS i, sum(u::INT) AS u, sum(s::INT) AS s FROM o GROUP BY 1)
SELECT project_id, edits, round((b - m) / b::DOUBLE, 6) AS reduction_rate, round((b - g) / b::DOUBLE, 6) AS generic_reduction_rate,
 round(u / i::DOUBLE, 6) AS useful_rate, round(s / i::DOUBLE, 6) AS false_rate,
 round((edits + m + i * 0.03::DOUBLE) / (edits + b), 6) AS time_ratio, round(1 + i * 0.03::DOUBLE / edits, 6) AS token_overhead FROM t""")
def arm_rates(v):
    e, val = F.col("event_type"), F.col("value")
    outcomes = v.table("events").select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_id"), (e == "error").alias("baseline_error"),
        ((e == "error") & (val > 50)).alias("generic_error"), ((e == "error") & (val > 150)).alias("memory_error"),
        (val > 20).alias("injected"), ((val > 20) & (e == "click")).alias("useful"),
        ((val > 20) & (e == "view")).alias("suppressed"))
    rates = ["reduction_rate", "generic_reduction_rate", "useful_rate", "false_rate", "time_ratio", "token_overhead"]
    return evaluate.arm_rates(outcomes, "project_id").select("project_id", "edits", *[r6(c).alias(c) for c in rates])


# --- text ---------------------------------------------------------------------

@case("token_overlap", O.with_views("q", ("d", f"SELECT doc_id, {O.tokens('text')} AS t FROM documents"),
                                    ("b", f"SELECT question_id, {O.tokens('query')} AS t FROM v_q")) + f"""
SELECT question_id, doc_id FROM b JOIN d ON {O.overlap('b.t', 'd.t')}""")
def token_overlap(v):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), "text")
    found = retrieve.token_matches(v.q().select(F.col("question_id").alias("id"), F.col("query").alias("text")), docs)
    return found.select(F.col("left_id").alias("question_id"), F.col("right_id").alias("doc_id"))


@case("expand_query", O.with_views("q", ("x", f"""
SELECT question_id, trim(query) AS q, list_concat(
 list_transform(regexp_extract_all(query, {O.quoted(V.ENTITY_PATTERN)}), lambda r: lower(regexp_replace(r, '^@', ''))),
 list_transform(regexp_extract_all(query, {O.quoted(V.LATIN_PATTERN)}), lambda r: lower(r))) AS terms FROM v_q""")) + """
SELECT question_id, q || CASE WHEN len(terms) > 0 THEN ' ' || array_to_string(
 list_filter(terms, lambda t, i: list_position(terms, t) = i), ' ') ELSE '' END AS expanded FROM x""")
def expand_query(v):
    return v.q().select("question_id", T.expand_query(F.col("query")).alias("expanded"))


def _timed(text):
    return F.concat(F.element_at(F.array(F.lit("what happened last week: "), F.lit("and yesterday? "), F.lit("the latest news "),
                                         F.lit("最近一周 "), F.lit("")), (F.col("item_id") % 5 + 1).cast("int")), text)


@case("relative_time", f"""
WITH t AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'what happened last week: ' WHEN 1 THEN 'and yesterday? ' WHEN 2 THEN 'the latest news '
 WHEN 3 THEN '最近一周 ' ELSE '' END || text AS x FROM benchmark)
SELECT item_id, CAST(CASE WHEN regexp_matches(x, {O.quoted(V.LAST_WEEK_PATTERN)}) THEN epoch_us({O.NOW}) - 604800000000
  WHEN regexp_matches(x, {O.quoted(V.YESTERDAY_PATTERN)}) THEN epoch_us({O.NOW}) - 86400000000 END AS BIGINT) AS after_us,
 CAST(CASE WHEN regexp_matches(x, {O.quoted(V.LAST_WEEK_PATTERN)}) OR regexp_matches(x, {O.quoted(V.YESTERDAY_PATTERN)}) THEN epoch_us({O.NOW}) END AS BIGINT) AS before_us,
 CAST(regexp_matches(x, {O.quoted(V.NEWEST_PATTERN)}) AS INTEGER) AS newest FROM t""")
def relative_time(v):
    w = T.relative_time(_timed(F.col("text")), NOW)
    return v.table("benchmark").select("item_id", w.alias("w")).select(
        "item_id", F.unix_micros("w.after").alias("after_us"), F.unix_micros("w.before").alias("before_us"),
        F.col("w.sort_newest").cast("int").alias("newest"))


@case("derive_events", O.with_views("turns") + f"""
SELECT event_id, {O.derive_summary('content')} AS summary, CAST({O.confirmed('content')} AS INTEGER) AS confirmed,
 CAST({O.correction('content')} AS INTEGER) AS correction FROM v_turns""")
def derive_events(v):
    c = F.col("content")
    return v.turn().select("event_id", T.derive_summary(c).alias("summary"), T.is_confirmed(c).cast("int").alias("confirmed"),
                           T.is_correction(c).cast("int").alias("correction"))


@case("polarity", O.with_views("rule") + f"""
SELECT id, {O.polarity('content')} AS polarity FROM v_rule""")
def polarity(v):
    return v.rule().select("id", T.polarity(F.col("content")).alias("polarity"))


@case("estimate_tokens", f"""
SELECT doc_id, CAST({O.estimate_tokens("'权重。' || text")} AS BIGINT) AS tokens FROM documents""")
def estimate_tokens(v):
    return v.table("documents").select("doc_id", big(T.estimate_tokens(F.concat(F.lit("权重。"), F.col("text")))).alias("tokens"))


@case("one_line_text", f"""
SELECT page_id, md5({O.one_line('html')}) AS digest, sha256(html) AS content_hash, substr(sha256(html), 1, 8) AS entry_hash FROM pages""")
def one_line_text(v):
    h = F.col("html")
    return v.table("pages").select("page_id", F.md5(T.one_line(h)).alias("digest"), T.content_hash(h).alias("content_hash"),
                                   T.entry_hash(h).alias("entry_hash"))


@case("keyword_embedding", O.with_views("", ("g", f"""
SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN length(text) = 1 THEN [text] ELSE
 list_transform(list_zip((string_split(text, ''))[:-2], (string_split(text, ''))[2:]), lambda z: z[1] || z[2]) END) AS b
 FROM documents) GROUP BY ALL"""), ("u", "SELECT DISTINCT b FROM g"), ("h", """
SELECT b, list_reduce(list_transform(range(0, length(hex(encode(b))) // 2), lambda i: ('0x' || substr(hex(encode(b)), i * 2 + 1, 2))::HUGEINT),
  lambda acc, x: (xor(acc, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h,
 list_reduce(list_transform(range(0, length(hex(encode('s' || b))) // 2), lambda i: ('0x' || substr(hex(encode('s' || b)), i * 2 + 1, 2))::HUGEINT),
  lambda acc, x: (xor(acc, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS hs FROM u"""),
    ("s", """SELECT doc_id, CAST(h % 1536 AS BIGINT) AS slot, sum(CASE WHEN hs % 2 = 1 THEN -n ELSE n END)::DOUBLE AS v
 FROM g JOIN h USING (b) GROUP BY ALL""")).replace("WITH RECURSIVE ", "WITH ") + """
SELECT doc_id, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS slots, round(max((v::FLOAT / norm::FLOAT)::DOUBLE), 5) AS top,
 round(sum((v::FLOAT / norm::FLOAT)::DOUBLE * (slot % 97)), 4) AS weighted
FROM s JOIN (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""")
def keyword_embedding(v):
    """Non-zero slots, largest component and a slot-weighted sum of each text's vector."""
    vec = F.col("vec")
    slots = F.zip_with(vec, F.sequence(F.lit(0), F.lit(V.EMBEDDING_DIM - 1)), lambda x, i: x.cast("double") * (i % 97))
    return v.table("documents").select("doc_id", X.keyword_vector(F.col("text")).alias("vec")).select(
        "doc_id", big(F.size(F.filter(vec, lambda x: x != 0))).alias("slots"),
        F.round(F.array_max(vec).cast("double"), 5).alias("top"),
        F.round(F.aggregate(slots, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


@case("dual_channel", O.with_views("vec") + """
SELECT documents.doc_id, CASE WHEN embedding IS NOT NULL THEN 64 ELSE 8 END::BIGINT AS dim
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def dual_channel(v):
    """Stored vector where there is one, keyword vector elsewhere."""
    joined = v.table("documents").join(v.table("embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    chosen = X.choose_vector(F.col("embedding"), X.keyword_vector(F.col("text"), 8))
    return joined.select("doc_id", big(F.size(chosen)).alias("dim"))
