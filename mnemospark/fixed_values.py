"""Fixed values.

Thresholds, word lists, patterns and text formats below decide results, so they
are stated here as plain text and used everywhere else by name.
"""

# --- enumerations -----------------------------------------------------------
SOURCE_TYPES = ["AST", "LLM", "USER", "DEBUG", "INFERRED", "USER_DECLARED", "SUMMARIZED", "DELEGATION"]
TASK_TYPES = ["debug", "feature", "refactor", "review"]
MEMORY_TYPES = ["RULE", "FACT", "PATTERN", "CONSTRAINT"]
SEARCH_ACTIONS = ["used", "corrected", "ignored", "confirmed"]
ENTITY_TYPES = ["FUNCTION", "MODULE", "API", "CONFIG", "QUERY"]
ROOT_CAUSES = ["CONCURRENCY", "RESOURCE_EXHAUSTION", "CONFIG", "CONTRACT_VIOLATION", "LOGIC_ERROR", "UNKNOWN"]
PITFALL_STATUSES = ["proposed", "confirmed", "suppressed", "obsolete"]
PITFALL_FEEDBACK = ["adopted", "ignored", "recurred"]
CONFLICT_STATUSES = ["pending", "auto_resolved", "manual_resolved", "dismissed"]
CONFLICT_BASES = ["polarity", "llm"]
TRUST_MIN, TRUST_MAX, TRUST_DEFAULT = 1, 5, 3

# --- weights ----------------------------------------------------------------
LAMBDA_ACCESS = 0.1
ALPHA_AGE = 0.005
BETA_IDLE = 0.05
COOLING_THRESHOLD = 0.01
SURPRISE_STRETCH = 2.0
CORRECTION_SURPRISE = 0.7
BEHAVIOUR_SURPRISE = 0.5
TASK_BOOST = 0.2
LANGUAGE_BOOST = 0.1
FEEDBACK_DELTAS = {"used": 0.10, "corrected": 0.50, "confirmed": 0.20, "ignored": -0.05}
FEEDBACK_USER_EXTRA = 0.30
PITFALL_DELTAS = {"adopted": 0.1, "ignored": -0.1, "recurred": 0.05}
PROTECTION_MAX = 3
DECAY_DAYS = 30.0
SOURCE_TRUST = {
    "USER": 5, "USER_DECLARED": 5, "AST": 4, "DEBUG": 3,
    "INFERRED": 2, "SUMMARIZED": 2, "LLM": 1,
}

# --- similarity -------------------------------------------------------------
EMBEDDING_DIM = 1536
SAME_INFORMATION_COSINE = 0.7
MERGE_COSINE = 0.85
TOKEN_LINK_JACCARD = 0.15
SUBJECT_DICE = 0.25
RESTATEMENT_DICE = 0.9
CORRECTION_BOOST = 1.5
PITFALL_MERGE_COSINE = 0.85
PITFALL_MERGE_DICE = 0.3
PITFALL_DEDUP_COSINE = 0.9
RRF_K = 60

# --- bounds that are part of the operators' meaning -------------------------
WORKING_MEMORY_SIZE = 20
NEIGHBOUR_K = 5
PITFALL_TOP = 3
EPISODE_TOP = 5
CONTEXT_TOKENS = 2048
PATTERN_MIN_SIZE = 3
BACKTEST_MIN = 0.7
BACKTEST_NO_SIGNAL = 0.5
INJECTION_OVERHEAD = 0.03

# --- wording of stored reasons, rules and blocks (fixed values) --------------
CONFLICT_REASON = "trust {} > {} — lower-trust rule retired"
CONFLICT_SIDE = '"{}" ({}, trust {})'
CONFLICT_PAIR = "{} vs {}"
UPDATE_REASON = "newer memory (occurred {}) covers older memory (occurred {}): same-subject bigram similarity {}"
UPDATE_FLIP = "; directive polarity flip {} -> {}"
RULE_HEADING = "Pattern in {}/{}:"
PITFALL_HEADING = "Entity: {}\nProject: {} | Language: {}\nSessions: {}"
EPISODE_LANGUAGE = " (lang: {})"
PITFALL_LINES = "- {}: {}\n  root cause: {} · 曾于 {} 发生 · confidence: {}"
PITFALL_FIX = "  Fix: {}"

# --- text patterns (syntax shared by Java and RE2) --------------------------
PROHIBITIVE = [
    "不要", "禁止", "别用", "不要用", "别再用", "避免", "不应", "不能", "不可", "不该",
    "never", "don't", "do not", "must not", "mustn't", "avoid", "forbid", "禁止使用",
]
AFFIRMATIVE = [
    "应该", "应当", "必须", "一定要", "始终", "总是", "always", "must", "should",
    "使用", "采用", "选用", "需要",
]
CONFIRMED_PATTERN = "(?i)记住|记得|以后都|记一下|记到|remember this|remember that"
CORRECTION_PATTERN = (
    "(?i)不对|错了|不是这样的|应该是|实际上应该是|actually|别用|不要用|别再用|改成|改回|纠正|"
    "should be|don'?t use|not true|that'?s wrong|那个不对"
)
CONTINUE_PREFIX = "继续"
LEADING_FILLER = " \t\n\r：:，,。.；;！!？?…—"
ENTITY_PATTERN = r"(?i)@?[\w./-]+\.(?:go|proto|ts|tsx|js|py|java|rs)"
MENTION_PATTERN = r"@[\w./-]+\.(?:go|proto|ts|tsx|js|py|java|rs)"
LATIN_PATTERN = r"[a-zA-Z][a-zA-Z0-9]*|\d{2,}"
LAST_WEEK_PATTERN = "(?i)last week|上周|过去一周|最近一周|一周内"
YESTERDAY_PATTERN = "(?i)yesterday|昨天"
NEWEST_PATTERN = "(?i)most recent|latest|最近一次|最近|最新"

# Keyword -> language, first hit wins; fixed order.
LANGUAGE_KEYWORDS = [
    ("go", "go"), ("golang", "go"), ("proto", "proto"), ("protobuf", "proto"),
    ("typescript", "typescript"), ("ts", "typescript"), ("tsx", "typescript"),
    ("python", "python"), ("py", "python"), ("rust", "rust"), ("rs", "rust"),
    ("java", "java"), ("javascript", "javascript"), ("js", "javascript"),
]
LANGUAGE_FALLBACK = "zh"
TASK_KEYWORDS = [
    ("debug", ["bug", "错误", "报错", "error", "panic", "debug", "修复", "fix", "crash", "崩溃"]),
    ("refactor", ["重构", "refactor", "拆分", "extract", "rename", "重命名"]),
    ("review", ["review", "审核", "检查", "审计", "audit"]),
]
ENTITY_PREFIXES = [
    ("func:", "FUNCTION"), ("module:", "MODULE"), ("api:", "API"),
    ("config:", "CONFIG"), ("query:", "QUERY"),
]
ENTRY_DELIMITER = "\n§\n"
PATH_SKIPPED_DIRECTORIES = ["memory", "memories", "projects"]
