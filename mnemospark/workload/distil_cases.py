"""Consolidation into rules and pitfalls, prompts and responses."""

from datetime import datetime

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import distil, retrieve as R
from mnemospark.plans import pipelines
from mnemospark.streaming import sinks
from mnemospark.workload import oracle_views as O
from mnemospark.workload.registry import big, case, r6
from mnemospark.workload.views import NOW

START = datetime(2024, 1, 1)
_SCAN = ("scan", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS scan_rank FROM v_epi
 WHERE obsoleted_at IS NULL AND created_at >= TIMESTAMP '2024-01-01 00:00:00')""")
_RULES = ("rules", """
SELECT project_id, task_type, count(*) AS members, 'Pattern in ' || project_id || '/' || task_type || ':' || chr(10) || string_agg('- ' || summary, chr(10) ORDER BY scan_rank) AS content
FROM scan GROUP BY 1, 2 HAVING count(*) >= 3""")
_LETTERS = "aeir0247"


def letter_counts(c):
    """A native stand-in for an embedding: how often each of a few characters occurs."""
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("float") for x in _LETTERS])


def _letters_sql(x):
    return "[" + ", ".join(f"length(regexp_replace({x}, '[^{c}]', '', 'g'))::DOUBLE" for c in _LETTERS) + "]"


_TESTED = (("rv", f"SELECT project_id, task_type, {_letters_sql('content')} AS v FROM rules"),
           ("sv", f"SELECT project_id, task_type, {_letters_sql('summary')} AS v FROM scan"), ("tested", """
SELECT r.project_id, r.task_type, avg(list_cosine_similarity(r.v, s.v)) AS accuracy
FROM rv r JOIN sv s ON s.project_id = r.project_id AND s.task_type = r.task_type GROUP BY 1, 2"""))


def _scan(v):
    return R.recent_scan(v.epi(), START)


@case("pattern_clusters", O.with_views("epi") + """
SELECT project_id, task_type, count(*) AS members, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM v_epi GROUP BY 1, 2 HAVING count(*) >= 3""")
def pattern_clusters(v):
    return distil.pattern_clusters(v.epi()).select("project_id", "task_type", "members", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@case("rule_text", O.with_views("epi", _SCAN, _RULES) + "SELECT project_id, task_type, members, md5(content) AS digest FROM rules")
def rule_text(v):
    return distil.rule_text(_scan(v)).select("project_id", "task_type", big("members").alias("members"), F.md5("content").alias("digest"))


@case("backtest", O.with_views("epi", _SCAN, _RULES, *_TESTED) + "SELECT project_id, task_type, round(accuracy, 6) AS accuracy FROM tested")
def backtest(v):
    scan = _scan(v)
    return distil.backtest(distil.rule_text(scan), scan, letter_counts).select("project_id", "task_type", r6("backtest_accuracy").alias("accuracy"))


@case("persist_rules", O.with_views("epi", _SCAN, _RULES, *_TESTED) + """
SELECT sha256('rule' || chr(1) || 'run' || chr(1) || project_id || chr(1) || task_type) AS id, 'consolidation:' || project_id || ':' || task_type AS entity_group, members AS edges, round(accuracy, 6) AS accuracy
FROM rules JOIN tested USING (project_id, task_type) WHERE accuracy >= 0.7""")
def persist_rules(v):
    scan = _scan(v)
    rules = distil.rule_text(scan)
    tested = rules.join(distil.backtest(rules, scan, letter_counts), ["project_id", "task_type"])
    semantic, edges = distil.persist_rules(tested, "run", F.lit(NOW))
    per = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("edges"))
    return semantic.join(per, "id").select("id", "entity_group", "edges", r6("backtest_accuracy").alias("accuracy"))


_GROUPS = ("groups", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, entity_group ORDER BY scan_rank, id) AS position, count(*) OVER (PARTITION BY project_id, entity_group) AS group_size
 FROM scan WHERE task_type = 'debug' AND entity_group <> '') WHERE group_size >= 2""")


def _groups(v):
    return distil.entity_groups(_scan(v))


@case("entity_groups", O.with_views("epi", _SCAN, _GROUPS) + "SELECT project_id, entity_group, id, position, group_size FROM groups")
def entity_groups(v):
    return _groups(v).select("project_id", "entity_group", "id", big("position").alias("position"), "group_size")


@case("entity_types", """
SELECT p_partkey AS id, CASE p_size % 6 WHEN 1 THEN 'MODULE' WHEN 2 THEN 'API' WHEN 3 THEN 'CONFIG' WHEN 4 THEN 'QUERY' ELSE 'FUNCTION' END AS entity_type FROM part""")
def entity_types(v):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("func:", "module:", "api:", "config:", "query:", "")]), (F.col("p_size") % 6 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), T.infer_entity_type(F.concat(prefix, "p_name")).alias("entity_type"))


def _clusters(v):
    groups = _groups(v)
    return distil.cluster_entities(groups).join(groups.select(F.col("id").cast("string").alias("id"), "summary", "language"), "id")


@case("hac_clusters")
def hac_clusters(v):
    return distil.cluster_entities(_groups(v))


@case("representative", O.with_views("epi", _SCAN, _GROUPS, ("g", f"SELECT project_id, entity_group, id, position, {O.bigrams('summary')} AS g FROM groups"), ("s", f"""
SELECT a.project_id, a.entity_group, a.id, a.position, CAST(sum(CASE WHEN a.id <> b.id THEN round({O.dice('a.g', 'b.g')} * 1000000) END) AS BIGINT) AS total, count(*) AS size
FROM g a JOIN g b ON a.project_id = b.project_id AND a.entity_group = b.entity_group GROUP BY 1, 2, 3, 4"""), ("r", """
SELECT *, row_number() OVER (PARTITION BY project_id, entity_group ORDER BY total DESC, position) AS r FROM s""")) + """
SELECT project_id, entity_group, id, size, round(total / ((size - 1) * 1000000.0::DOUBLE), 6) AS mean_overlap FROM r WHERE r = 1""")
def representative(v):
    """Each entity group taken as one cluster."""
    members = _groups(v).withColumn("member", F.col("position"))
    return distil.representatives(members, ("project_id", "entity_group")).select("project_id", "entity_group", "id", "size", r6("mean_overlap").alias("mean_overlap"))


@case("heuristic_pitfalls")
def heuristic_pitfalls(v):
    found = distil.heuristic_pitfalls(_clusters(v), F.lit(NOW))
    return found.select("id", "entity_id", "entity_type", "project_id", "signature", "occurrence_count")


def _candidates(v):
    """Pitfalls of one run, one per grouped episode, without vectors."""
    none = F.lit(None)
    return _groups(v).select(
        "id", F.col("entity_group").alias("entity_id"), "project_id", "position", F.col("summary").alias("signature"),
        none.cast("array<float>").alias("signature_embedding"), (1 + F.col("id") % 7).alias("occurrence_count"),
        F.concat(F.lit("fix"), F.repeat(F.lit("x"), (F.col("id") % 11).cast("int"))).alias("fix_strategy"),
        F.col("created_at").alias("last_occurred_at"), (F.col("id") % 5 == 0).alias("was_user_corrected"),
        F.array(F.col("id").cast("string")).alias("source_episodic_ids"), none.cast("timestamp").alias("obsoleted_at")
    ).withColumn("id", F.col("id").cast("string"))


_LEADERS = ("leaders", "SELECT *, arg_min(id, position) OVER (PARTITION BY project_id, entity_group, summary) AS leader FROM groups")


@case("pitfall_dedup", O.with_views("epi", _SCAN, _GROUPS, _LEADERS) + "SELECT id::VARCHAR AS id, leader::VARCHAR AS leader_id FROM leaders")
def pitfall_dedup(v):
    return distil.dedup_pitfalls(_candidates(v))


@case("pitfall_merge", O.with_views("epi", _SCAN, _GROUPS, _LEADERS, ("p", """
SELECT *, 1 + id % 7 AS occ, coalesce(sum(1 + id % 7) OVER (PARTITION BY leader ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM leaders""")) + """
SELECT arg_max(id, position) FILTER (occ > before) ::VARCHAR AS id, CAST(sum(occ) AS BIGINT) AS occurrence_count, count(*) AS members, max(3 + id % 11) AS fix_length,
 epoch_us(max(created_at)) AS last_us, CAST(bool_or(id % 5 = 0) AS INTEGER) AS corrected FROM p GROUP BY leader""")
def pitfall_merge(v):
    rows = _candidates(v)
    merged = distil.merge_pitfalls(rows, distil.dedup_pitfalls(rows))
    return merged.select("id", big("occurrence_count").alias("occurrence_count"), big(F.size("source_episodic_ids")).alias("members"),
                         big(F.length("fix_strategy")).alias("fix_length"), F.unix_micros("last_occurred_at").alias("last_us"),
                         F.col("was_user_corrected").cast("int").alias("corrected"))


_PARTS = """SELECT project_id, task_type, part, items, md5(content) AS digest,
 CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY project_id, task_type ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT project_id, task_type, (place - 1) // 50 AS part, count(*) AS items, string_agg(line, chr(10) ORDER BY place) AS content
 FROM (SELECT *, row_number() OVER (PARTITION BY project_id, task_type ORDER BY section, n) AS place FROM lines) GROUP BY 1, 2, 3)"""
_NUMBERED = ("numbered", """
SELECT * FROM (SELECT project_id, task_type, summary, row_number() OVER (PARTITION BY project_id, task_type ORDER BY scan_rank, id) - 1 AS n,
 count(*) OVER (PARTITION BY project_id, task_type) AS c FROM scan) WHERE c >= 3""")
_RULE_LINES = """SELECT project_id, task_type, 0 AS section, n, '{lead}Pattern in ' || project_id || '/' || task_type || ':' AS line FROM numbered WHERE n = 0
UNION ALL SELECT project_id, task_type, 1, n, '- ' || summary FROM numbered"""


@case("rule_parts", O.with_views("epi", _SCAN, _NUMBERED, ("lines", _RULE_LINES.format(lead=""))) + _PARTS)
def rule_parts(v):
    return distil.rule_parts(_scan(v), items=50).select("project_id", "task_type", "part", "items", "offset", F.md5("content").alias("digest"))


@case("validation_parts", O.with_views("epi", _SCAN, _NUMBERED, ("lines", _RULE_LINES.format(lead="Candidate rule: ") + """
UNION ALL SELECT project_id, task_type, 2, n, chr(10) || 'Notes it should describe:' FROM numbered WHERE n = 0
UNION ALL SELECT project_id, task_type, 3, n, '[' || n || '] ' || summary FROM numbered
UNION ALL SELECT project_id, task_type, 4, n, chr(10) || 'Answer with one number from 0 (not at all) to 1 (fully).' FROM numbered WHERE n = 0""")) + _PARTS)
def validation_parts(v):
    return distil.validation_parts(_scan(v), items=50).select("project_id", "task_type", "part", "items", "offset", F.md5("content").alias("digest"))


@case("rule_prompts", O.with_views("epi", _SCAN) + """
SELECT project_id, task_type, md5('Notes of project ' || project_id || ', task ' || task_type || ':' || chr(10) || string_agg('[' || n || '] ' || summary || chr(10), '' ORDER BY n)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, task_type ORDER BY scan_rank) - 1 AS n FROM scan) GROUP BY 1, 2 HAVING count(*) >= 3""")
def rule_prompts(v):
    return distil.rule_prompts(_scan(v)).select("project_id", "task_type", F.md5("prompt").alias("digest"))


@case("prompt_table", O.with_views("epi", _SCAN, _GROUPS) + """
SELECT project_id, entity_group, md5('Entity: ' || entity_group || chr(10) || 'Project: ' || project_id || ' | Language: ' || arg_min(language, position) || chr(10) || 'Sessions: ' || count(*) || chr(10) || chr(10)
 || string_agg('[' || (position - 1) || '] ' || summary || chr(10), '' ORDER BY position)
 || chr(10) || 'Name what went wrong repeatedly, why, and how to avoid it.' || chr(10)) AS digest FROM groups GROUP BY 1, 2""")
def prompt_table(v):
    return distil.pitfall_prompts(_groups(v)).select("project_id", "entity_group", F.md5("prompt").alias("digest"))


@case("response_ingest", """
WITH d AS (SELECT doc_id, doc_id % 6 AS k, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents)
SELECT doc_id, CAST(k <> 5 AS INTEGER) AS parsed, CASE WHEN k = 5 THEN NULL WHEN k = 1 AND c < 0.6 THEN 'second' ELSE 'sig ' || doc_id END AS signature,
 CASE WHEN k IN (4, 5) THEN 'UNKNOWN' WHEN k = 1 AND c < 0.6 THEN 'LOGIC_ERROR' ELSE 'CONFIG' END AS category,
 round(CASE WHEN k = 5 THEN 0 WHEN k = 1 THEN greatest(c, 0.6) ELSE c END, 6) AS confidence FROM d""")
def response_ingest(v):
    """Model answers in every accepted shape, numbered by document."""
    d, k = F.col("doc_id"), F.col("doc_id") % 6
    kind = F.when(k == 4, "SOMETHING").otherwise("CONFIG")
    obj = F.concat(F.lit('{"signature": "sig '), d.cast("string"), F.lit('", "root_cause_category": "'), kind, F.lit('", "fix_strategy": "f", "confidence": '),
                   ((d % 10) / 10).cast("string"), F.lit("}"))
    other = F.lit('{"signature": "second", "root_cause_category": "LOGIC_ERROR", "fix_strategy": "g", "confidence": 0.6}')
    text = (F.when(k == 1, F.concat(F.lit("["), obj, F.lit(", "), other, F.lit("]"))).when(k == 2, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(k == 3, F.concat(F.lit("Here it is: "), obj, F.lit(" as asked."))).when(k == 5, F.lit("no idea")).otherwise(obj))
    return distil.parse_responses(v.table("documents").select("doc_id", text.alias("response"))).select(
        "doc_id", F.col("parsed").cast("int").alias("parsed"), "signature", F.col("root_cause_category").alias("category"), r6("confidence").alias("confidence"))


@case("rule_scores", """
SELECT event_id, round(CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END, 6) AS score FROM events""")
def rule_scores(v):
    answer = F.concat(F.lit(" "), (F.col("value") / 100).cast("decimal(18,10)").cast("string"), F.lit(" because"))
    return v.table("events").select("event_id", r6(distil.parse_rule_score(answer)).alias("score"))


@case("window_sums", O.with_views("epi") + """
SELECT time_bucket(INTERVAL 1 DAY, created_at)::DATE::VARCHAR AS day, project_id, task_type, entity_group, count(*) AS members, epoch_us(min(created_at)) AS first_us, round(sum(weight), 6) AS weight
FROM v_epi GROUP BY ALL""")
def window_sums(v):
    """The additive state of rolling consolidation, over the whole table at once."""
    return sinks.window_sums(v.epi()).select(
        F.to_date("window_start").cast("string").alias("day"), "project_id", "task_type", "entity_group", "members", F.unix_micros("first_at").alias("first_us"), r6("weight").alias("weight"))


@case("windows_due", O.with_views("epi", ("s", "SELECT created_at::DATE::VARCHAR AS day, project_id, task_type, entity_group, count(*) AS n FROM v_epi GROUP BY ALL")) + """
SELECT day, project_id FROM s GROUP BY day, project_id, task_type HAVING sum(n) >= 3
UNION SELECT day, project_id FROM s WHERE task_type = 'debug' AND entity_group <> '' AND n >= 2""")
def windows_due(v):
    return sinks.worth_consolidating(sinks.window_sums(v.epi())).select(F.to_date("window_start").cast("string").alias("day"), "project_id")


def _vector_pitfalls(v):
    """All pitfalls of the event log, in the order of their numbers; some have a vector, the rest compare by signature."""
    return v.pit().select(F.col("id").cast("string").alias("id"), F.lit("e").alias("entity_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("project_id"), F.col("id").alias("position"),
                          F.concat(F.lit("module "), F.col("id") % 5).alias("signature"), F.slice("signature_embedding", 1, 3).alias("signature_embedding"))


@case("pitfall_leaders", O.with_views("pit", ("r", "SELECT id AS k, 'p' || (id % 3) AS project_id, 'module ' || (id % 5) AS s, signature_embedding[1:3] AS e, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS n FROM v_pit"),
    ("m", """SELECT b.project_id, b.n, list(a.k ORDER BY a.n) AS alike FROM r a JOIN r b ON a.project_id = b.project_id AND a.n < b.n
 AND CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN round(list_cosine_similarity(a.e, b.e), 9) >= 0.9 ELSE a.s = b.s END GROUP BY ALL"""),
    ("fold", """SELECT project_id, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::BIGINT AS lead, []::BIGINT[] AS leaders FROM (SELECT DISTINCT project_id FROM r)
UNION ALL SELECT project_id, n, k, coalesce(lead, k), CASE WHEN lead IS NULL THEN list_append(leaders, k) ELSE leaders END FROM (
 SELECT r.project_id, r.n, r.k, f.leaders, list_filter(coalesce(m.alike, []), lambda x: list_contains(f.leaders, x))[1] AS lead
 FROM fold f JOIN r ON r.project_id = f.project_id AND r.n = f.n + 1 LEFT JOIN m ON m.project_id = r.project_id AND m.n = r.n)""")).replace("fold AS MATERIALIZED", "fold AS") + """
SELECT k::VARCHAR AS id, lead::VARCHAR AS leader_id FROM fold WHERE k IS NOT NULL""")
def pitfall_leaders(v):
    """Deduplication by vectors where there are any, over every pitfall."""
    return distil.dedup_pitfalls(_vector_pitfalls(v), 0.9)


@case("consolidation_run")
def consolidation_run(v):
    """Rules and pitfalls of the whole month in one run."""
    done = pipelines.consolidate(v.epi().withColumn("id", F.col("id").cast("string")), "run", NOW, hours=31 * 24.0, embed=letter_counts)
    return done.run.drop("started_at", "completed_at", "rules_error", "pitfall_error")
