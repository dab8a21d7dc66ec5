"""Text columns built from Spark's own expressions."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from mnemospark import fixed_values as V

# Unicode white space; Java's \s is ASCII only and Spark's trim strips blanks only.
SPACE = "[\\t\\n\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def one_line(c: Column) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def truncate(c: Column, limit: int, ellipsis: str = "") -> Column:
    if not ellipsis:
        return F.substring(c, 1, limit)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ellipsis))).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs of four or more characters, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]{4,}"), F.lit(0)), F.lower)


def token_kernel():
    """The :func:`tokens` of a text, as bytes, for use inside tasks, where they cost a fraction; none for a null text.

    Closures travel to the workers by value.
    """
    # Every byte but those of ASCII letters and digits parts two runs; only ASCII letters are lowered.
    plain = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in bytes(range(256)).lower())

    def split(text: str | None) -> list[bytes]:
        return [] if text is None else [run for run in text.encode().translate(plain).split() if len(run) >= 4]

    return split


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens of ``b``, repeats counted, occur in ``a``.

    The one-element transform binds the intersection to a lambda variable; an
    outer expression inside a lambda would be evaluated again per element.
    """
    def count(common: Column) -> Column:
        return F.size(F.filter(b, lambda t: F.array_contains(common, t)))

    return F.element_at(F.transform(F.array(F.array_intersect(a, b)), count), 1)


def token_overlap(a: Column, b: Column) -> Column:
    """At least three shared tokens, or more than 30 % of the shorter list.

    Three distinct shared tokens decide by themselves, so the counting branch
    only ever probes a list of at most two.
    """
    return (
        F.when(F.least(F.size(a), F.size(b)) <= 0, F.lit(False))
        .when(F.size(F.array_intersect(a, b)) >= 3, F.lit(True))
        .otherwise(enough_tokens(shared_tokens(a, b), F.size(a), F.size(b)))
    )


def filled(template: str, *values: Column) -> Column:
    """A fixed text with a column in place of each pair of braces; null where one is."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def enough_tokens(matches: Column, size_a: Column, size_b: Column) -> Column:
    return (matches >= 3) | (matches * 10 > F.least(size_a, size_b) * 3)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens counted over ``a`` divided by the multiset union."""
    inter = shared_tokens(b, a)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(
        inter / (F.size(a) + F.size(b) - inter)
    )


def bigram_kernel():
    """(codes, shared) for use inside tasks: the sorted set of the character bigrams of a text, as in :func:`char_bigrams`,
    and how many of them each set of one list shares with each of another, as matrix products over parts of the bigrams.

    Closures travel to the workers by value.
    """

    def codes(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        return np.unique(points[:-1] * 2097152 + points[1:]) if len(points) > 1 else points

    def placed(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        return owner[hit], at[hit]

    def incidence(owner: np.ndarray, at: np.ndarray, rows: int, low: int, width: int) -> np.ndarray:
        full, here = np.zeros((rows, width), np.float32), (at >= low) & (at < low + width)
        full[owner[here], at[here] - low] = 1
        return full

    def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        known, out = np.intersect1d(np.concatenate(a), np.concatenate(b)), np.zeros((len(a), len(b)), np.float32)
        if len(known):
            left, right = placed(a, known), placed(b, known)
            for low in range(0, len(known), 2048):
                width = min(2048, len(known) - low)
                out += incidence(*left, len(a), low, width) @ incidence(*right, len(b), low, width).T
        return out.astype(np.int64)

    return codes, shared


def char_bigrams(c: Column, fold_case: bool = False) -> Column:
    """Set of character bigrams as numbers (first code point * 2**21 + second); a single
    character stands for itself. Case is kept unless ``fold_case``: retrieval folds,
    conflict, update and cluster comparisons do not.

    Done in numpy on Arrow batches: one JVM string per character made this the
    dominant cost of every text comparison.
    """
    one, _ = bigram_kernel()

    @F.pandas_udf("array<bigint>")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return codes(F.lower(c) if fold_case else c)


def shared_bigrams(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two bigram sets, 0 when either is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(2.0 * shared_bigrams(a, b) / total)


def dice_at_least(a: Column, b: Column, percent: int) -> Column:
    """``dice >= percent/100`` in integers, so no rounding decides a tie."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (
        200 * shared_bigrams(a, b) >= percent * (F.size(a) + F.size(b))
    )


def expand_query(question: Column) -> Column:
    """Question followed by its distinct entity references, Latin words and numbers."""
    q = trim_space(question)
    refs = F.transform(
        F.regexp_extract_all(q, F.lit(V.ENTITY_PATTERN), F.lit(0)),
        lambda r: F.lower(F.regexp_replace(r, "^@", "")),
    )
    words = F.transform(F.regexp_extract_all(q, F.lit(V.LATIN_PATTERN), F.lit(0)), F.lower)
    terms = F.array_distinct(F.concat(refs, words))
    return F.when(F.size(terms) > 0, F.concat_ws(" ", q, F.array_join(terms, " "))).otherwise(q)


def entity_references(question: Column) -> Column:
    """Lower-cased entity references, repeats kept, leading @ dropped."""
    return F.transform(
        F.regexp_extract_all(question, F.lit(V.ENTITY_PATTERN), F.lit(0)),
        lambda r: F.regexp_replace(F.lower(r), "^@", ""),
    )


def relative_time(question: Column, now: datetime | Column) -> Column:
    """struct(after, before, sort_newest) implied by a question asked at ``now``."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    week, day = question.rlike(V.LAST_WEEK_PATTERN), question.rlike(V.YESTERDAY_PATTERN)
    return F.struct(
        F.when(week, at - F.expr("interval 7 days")).when(day, at - F.expr("interval 1 day")).alias("after"),
        F.when(week | day, at).alias("before"),
        question.rlike(V.NEWEST_PATTERN).alias("sort_newest"),
    )


def derive_summary(text: Column, chars: int | None = None) -> Column:
    """Trimmed message without the continue filler and leading punctuation, cut only if ``chars`` says so."""
    body = F.regexp_replace(trim_space(text), "^" + V.CONTINUE_PREFIX, "")
    whole = F.regexp_replace(body, f"^[{V.LEADING_FILLER}]+", "")
    return whole if chars is None else truncate(whole, chars)


def is_confirmed(text: Column) -> Column:
    return text.rlike(V.CONFIRMED_PATTERN)


def is_correction(text: Column, shorter_than: int | None = None) -> Column:
    """Message with a correction phrase; an explicit instruction is not a correction.
    ``shorter_than`` restricts it to short messages where that is wanted."""
    short = F.lit(True) if shorter_than is None else F.length(trim_space(text)) < shorter_than
    return ~is_confirmed(text) & short & text.rlike(V.CORRECTION_PATTERN)


def polarity(text: Column) -> Column:
    """prohibitive before affirmative before neutral."""
    low = F.lower(text)
    return (
        F.when(low.rlike("|".join(V.PROHIBITIVE)), F.lit("prohibitive"))
        .when(low.rlike("|".join(V.AFFIRMATIVE)), F.lit("affirmative"))
        .otherwise(F.lit("neutral"))
    )


def estimate_tokens(text: Column) -> Column:
    """One per CJK character, one per started group of four others."""
    cjk = F.length(F.regexp_replace(text, "[^\\u3000-\\u9FFF]", ""))
    return cjk + F.floor((F.length(text) - cjk + 3) / 4)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def entry_hash(text: Column) -> Column:
    return F.substring(content_hash(text), 1, 8)


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair of ids."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def stable_id(kind: str, *parts: Column) -> Column:
    """Deterministic id, so a rerun of a job writes the same rows."""
    return F.sha2(F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def infer_entity_type(entity_id: Column) -> Column:
    out = F.lit("FUNCTION")
    for prefix, kind in reversed(V.ENTITY_PREFIXES):
        out = F.when(entity_id.startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def infer_language(project_id: Column, content: Column) -> Column:
    text = F.lower(F.concat_ws(" ", project_id, content))
    return F.coalesce(
        *[F.when(text.contains(word), F.lit(lang)) for word, lang in V.LANGUAGE_KEYWORDS],
        F.lit(V.LANGUAGE_FALLBACK),
    )


def infer_task_type(content: Column) -> Column:
    text = F.lower(content)
    return F.coalesce(
        *[F.when(text.rlike("|".join(words)), F.lit(task)) for task, words in V.TASK_KEYWORDS],
        F.lit("feature"),
    )


def mentioned_entity(content: Column) -> Column:
    """First @-mentioned file without the @, empty when there is none."""
    return F.regexp_replace(F.regexp_extract(content, V.MENTION_PATTERN, 0), "^@", "")
