"""The views of ``views`` as DuckDB common table expressions, plus SQL snippets."""

from __future__ import annotations

from mnemospark import fixed_values as V

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_MARK = "CASE doc_id % 3 WHEN 0 THEN 'never ' WHEN 1 THEN 'always ' ELSE '' END"
_MINUTE = "make_timestamp(1704067200000000 + doc_id * 60000000)"

VIEWS = {
    "epi": """
SELECT event_id AS id, 'p' || (user_id % 10) AS project_id,
 CASE user_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE '' END AS language,
 CASE event_type WHEN 'error' THEN 'debug' WHEN 'click' THEN 'feature' WHEN 'view' THEN 'review' ELSE 'refactor' END AS task_type,
 event_type || ' ' || props AS summary, 1 + user_id % 5 AS trust_level, least(1.0::DOUBLE, value / 100) AS weight,
 1.0::DOUBLE AS effective_frequency, 'func:f' || (user_id % 20) || '.py' AS entity_group,
 event_type = 'error' AS is_correction,
 CASE event_type WHEN 'error' THEN 0.7::DOUBLE WHEN 'signup' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS surprise_score,
 ts AS created_at, CASE WHEN value < 5 THEN ts END AS obsoleted_at, ts AS occurred_at
FROM events""",
    "vec": f"""
SELECT doc_id AS id, 'p' || coalesce(label, doc_id % 10) AS project_id, lang AS language,
 CASE lang WHEN 'en' THEN 'debug' WHEN 'fr' THEN 'feature' WHEN 'de' THEN 'review' ELSE 'refactor' END AS task_type,
 {_MARK} || text AS summary, 1 + doc_id % 5 AS trust_level, least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE) AS weight,
 1.0::DOUBLE AS effective_frequency, 'doc:' || (doc_id % 50) AS entity_group, embedding::DOUBLE[] AS context_vector,
 false AS is_correction, (doc_id % 5) / 5.0::DOUBLE AS surprise_score, {_MINUTE} AS created_at,
 CASE WHEN n_chars < 100 THEN {_MINUTE} END AS obsoleted_at, {_MINUTE} AS occurred_at
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "new": f"""
SELECT doc_id + 1000000 AS event_id, doc_id AS seq, 'p' || coalesce(label, doc_id % 10) AS project_id,
 CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS language, 'debug' AS task_type,
 CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'doc:new' ELSE 'doc:' || (doc_id % 50) END AS entity_group,
 CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'always ' WHEN 1 THEN 'never ' ELSE '' END ELSE {_MARK} END
  || text || ' again' AS summary,
 CASE WHEN embedding IS NOT NULL THEN list_concat(embedding[1:56], [0,0,0,0,0,0,0,0]::FLOAT[])::DOUBLE[] END AS context_vector,
 doc_id % 6 = 0 AS is_correction, CASE WHEN doc_id % 6 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS surprise_score,
 CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' ELSE make_timestamp(1706745600000000 + doc_id * 60000000) END AS occurred_at
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "rule": f"""
SELECT doc_id AS id, source AS project_id, CASE WHEN doc_id % 2 = 0 THEN 'RULE' ELSE 'CONSTRAINT' END AS type,
 {_MARK} || text AS content, 1 + doc_id % 5 AS trust_level, least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE) AS weight,
 1.0::DOUBLE AS effective_frequency, 'rules:' || source AS entity_group, {_MINUTE} AS created_at,
 CASE WHEN n_chars < 100 THEN {_MINUTE} END AS obsoleted_at
FROM documents""",
    "turns": """
SELECT conv_id * 1000 + turn AS event_id, 'p' || (conv_id % 10) AS project_id, conv_id * 1000 + turn AS seq,
 conv_id AS session_id, role,
 CASE (conv_id + turn) % 7 WHEN 0 THEN 'remember this: ' WHEN 1 THEN 'that''s wrong, ' WHEN 2 THEN '继续：' ELSE '' END || text AS content,
 CASE turn % 3 WHEN 0 THEN '2024-01-15 10:00:00' WHEN 1 THEN '2024-01-16T10:30:00Z' ELSE 'soon' END AS chat_time
FROM conversations""",
    "pit": """
SELECT k AS id, 'func:f' || (k % 20) || '.py' AS entity_id, 'FUNCTION' AS entity_type, 'p' || (k % 10) AS project_id,
 'python' AS language, 'the timeout ' || k || ' in module ' || (k % 5) AS signature,
 e.embedding::DOUBLE[] AS signature_embedding,
 CASE k % 6 WHEN 0 THEN 'CONCURRENCY' WHEN 1 THEN 'RESOURCE_EXHAUSTION' WHEN 2 THEN 'CONFIG' WHEN 3 THEN 'CONTRACT_VIOLATION' WHEN 4 THEN 'LOGIC_ERROR' ELSE 'UNKNOWN' END AS root_cause_category,
 'raise limit ' || (k % 7) AS fix_strategy, k % 3 = 0 AS was_user_corrected, n AS occurrence_count, last AS last_occurred_at,
 1 + k % 5 AS trust_level, least(1.0::DOUBLE, top / 150) AS weight, first AS created_at,
 CASE WHEN k % 13 = 0 THEN last END AS obsoleted_at, [e1, e2, -1] AS source_episodic_ids,
 CASE k % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'proposed' WHEN 2 THEN 'suppressed' ELSE '' END AS status,
 n AS times_shown, low AS times_suppressed, 0 AS times_adopted, k % 4 AS protection_level
FROM (SELECT user_id AS k, count(*) AS n, max(ts) AS last, min(ts) AS first, max(value) AS top,
  CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS BIGINT) AS low, min(event_id) AS e1, max(event_id) AS e2
 FROM events WHERE event_type = 'error' GROUP BY 1) LEFT JOIN embeddings e ON e.vec_id = k""",
    "q": """
SELECT item_id AS question_id, 'p' || label AS project_id, text || ' see @f' || (item_id % 20) || '.py' AS query,
 embedding::DOUBLE[] AS query_vector, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS language,
 CASE WHEN item_id % 2 = 0 THEN 'debug' ELSE 'other' END AS task_type,
 CASE WHEN item_id % 2 = 0 THEN 'func:f' || (item_id % 20) || '.py' ELSE '' END AS entity_id
FROM benchmark JOIN embeddings ON item_id = vec_id""",
    "edge": """
SELECT l_orderkey AS from_id, l_partkey * 6 AS to_id,
 CASE WHEN l_linenumber % 2 = 1 THEN 'DERIVED_FROM' ELSE 'RELATES_TO' END AS edge_type
FROM lineitem""",
    "correction": """
SELECT o_orderkey AS correction_id, o_orderkey AS id, o_orderkey AS seq,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'episodic' WHEN '2' THEN 'pitfall' WHEN '3' THEN 'pitfall' ELSE 'semantic' END AS kind,
 o_orderpriority AS corrected_to, o_orderstatus = 'F' AS user_corrected
FROM orders""",
    "feedback": """
SELECT user_id AS memory_id, event_id AS seq,
 CASE event_type WHEN 'error' THEN 'corrected' WHEN 'click' THEN 'used' WHEN 'view' THEN 'ignored' WHEN 'signup' THEN 'confirmed' ELSE 'liked' END AS action
FROM events""",
}

_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def with_views(names: str, *ctes: tuple[str, str]) -> str:
    """``WITH`` clause of the named views (prefixed v_) and further expressions."""
    parts = [f"v_{n} AS MATERIALIZED ({VIEWS[n]}\n)" for n in names.split()]
    parts += [f"{n} AS MATERIALIZED ({body}\n)" for n, body in ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]{{4,}}'), lambda t: lower(t))"


def overlap(a: str, b: str) -> str:
    hits = f"len(list_filter({b}, lambda t: list_contains({a}, t)))"
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({hits} >= 3 OR {hits} * 10 > least(len({a}), len({b})) * 3))"


def bigrams(x: str) -> str:
    chars = f"string_split({x}, '')"
    return (f"CASE WHEN length({x}) = 0 THEN []::VARCHAR[] WHEN length({x}) = 1 THEN [{x}] ELSE list_distinct("
            f"list_transform(list_zip(({chars})[:-2], ({chars})[2:]), lambda z: z[1] || z[2])) END")


def dice(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END")


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 9)"


def days(a: str, b: str) -> str:
    return f"(abs(epoch_us({b}) - epoch_us({a})) / 86400000000.0::DOUBLE)"


def polarity(x: str) -> str:
    pro, aff = quoted("|".join(V.PROHIBITIVE)), quoted("|".join(V.AFFIRMATIVE))
    return (f"CASE WHEN regexp_matches(lower({x}), {pro}) THEN 'prohibitive' "
            f"WHEN regexp_matches(lower({x}), {aff}) THEN 'affirmative' ELSE 'neutral' END")


def normal_status(x: str) -> str:
    return f"CASE WHEN {x} IN ('proposed','confirmed','suppressed','obsolete') THEN {x} ELSE 'proposed' END"


def injectable(p: str = "") -> str:
    s = normal_status(f"{p}status")
    return f"(({s}) = 'confirmed' OR (({s}) = 'proposed' AND {p}occurrence_count >= 2 AND {p}weight >= 0.6))"


def contribution(p: str = "") -> str:
    when = f"{p}last_occurred_at"
    age = f"(epoch_us({NOW}) - epoch_us({when})) / 86400000000.0::DOUBLE"
    return (f"least(1.0::DOUBLE, {p}occurrence_count / 3.0::DOUBLE) * ({p}trust_level / 5.0::DOUBLE) "
            f"* coalesce(exp(-({age}) / 30.0::DOUBLE), 1.0::DOUBLE)")


def feedback_delta(a: str) -> str:
    return (f"CASE {a} WHEN 'used' THEN 0.1::DOUBLE WHEN 'corrected' THEN 0.8::DOUBLE "
            f"WHEN 'confirmed' THEN 0.2::DOUBLE WHEN 'ignored' THEN -0.05::DOUBLE END")


def confirmed(x: str) -> str:
    return f"regexp_matches({x}, {quoted(V.CONFIRMED_PATTERN)})"


def correction(x: str) -> str:
    return (f"(NOT {confirmed(x)} AND regexp_matches({x}, {quoted(V.CORRECTION_PATTERN)}))")


def derive_summary(x: str) -> str:
    body = f"regexp_replace({trim_space(x)}, '^{V.CONTINUE_PREFIX}', '')"
    return f"regexp_replace({body}, '^[{V.LEADING_FILLER}]+', '')"


def estimate_tokens(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^\\x{{3000}}-\\x{{9FFF}}]', '', 'g'))"
    return f"({cjk} + (length({x}) - {cjk} + 3) // 4)"
