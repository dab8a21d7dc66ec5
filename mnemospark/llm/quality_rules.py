"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, let

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, each word counted once.

    Windows are compared by 64-bit hashes inside one text. Only a text with a repeated window sorts them.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == e["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["p"], e["p"] + 1, e["p"] + 2)))))

    def repeats(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(by_hash, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, repeats)).cast("long")


class Counts:
    """The counts of a text as expressions; each is evaluated only where a rule asks for it."""

    def __init__(self, text: Column):
        text = F.coalesce(text, F.lit(""))
        self.text = text
        self._words = words(text)

    n_words = property(lambda self: F.size(self._words).cast("long"))
    word_chars = property(lambda self: F.length(F.array_join(self._words, "")).cast("long"))
    n_symbols = property(lambda self: F.regexp_count(self.text, F.lit(SYMBOLS)).cast("long"))
    n_repeat_words = property(lambda self: let(self._words, repeat_words))
    n_upper = property(lambda self: F.regexp_count(self.text, F.lit(r"\p{Lu}")).cast("long"))

    @property
    def n_dup_lines(self) -> Column:
        with_word = F.filter(F.split(self.text, "\n", -1), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))
        return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


class Measured(Counts):
    """The same counts as columns that are there already."""

    def __init__(self, text: Column, names: Mapping[str, str]):
        self.text, self._names = F.coalesce(text, F.lit("")), names

    n_words = property(lambda self: F.col(self._names["n_words"]))
    word_chars = property(lambda self: F.col(self._names["word_chars"]))
    n_symbols = property(lambda self: F.col(self._names["n_symbols"]))
    n_dup_lines = property(lambda self: F.col(self._names["n_dup_lines"]))
    n_repeat_words = property(lambda self: F.col(self._names["n_repeat_words"]))


Rule = Callable[[Counts], Column]

#: A rule is true for a text that it rejects.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda c: c.n_words < 50,
    "repetitive": lambda c: 100 * c.n_repeat_words > 50 * c.n_words,
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": lambda c: 20 * c.n_symbols > c.word_chars,
    "shouting": lambda c: 2 * c.n_upper > c.word_chars,
    "repeated_lines": lambda c: 10 * c.n_dup_lines > 5 * c.n_words,
    "long_words": lambda c: c.word_chars > 30 * c.n_words,
}


def order_rules(docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Names of the rules by rejection per cost, both estimated on about ``sample_rows`` sampled rows.

    Selectivity is the share of the sample that a rule rejects; cost is the time the rule takes on the
    kept sample beyond an empty pass. The order decides the work, never the verdict. An empty table
    keeps the given order.
    """
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / total), seed=seed).persist()

    def run(condition: Column) -> tuple[int, int, float]:
        start = time.perf_counter()
        row = sample.agg(F.count("*"), F.count_if(condition)).first()
        return row[0], row[1], time.perf_counter() - start

    try:
        run(F.col("text").isNull())
        idle = run(F.col("text").isNull())[2]
        gain = {}
        for name, rule in rules.items():
            n, rejected, seconds = run(rule(Counts(F.col("text"))))
            gain[name] = rejected / max(n, 1) / max(seconds - idle, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda name: -gain[name])


def cascade(counts: Counts, rules: Mapping[str, Rule], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, else null; later rules aren't evaluated then."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name](counts), F.lit(name)).otherwise(verdict)
    return verdict


def measure(docs: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """doc_id with the counts of every whole text, ``base_failed`` and ``kept``.

    Null and empty texts have no word and fail; ties and repeated rows each keep their row; extra
    columns are not read. One pass, no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pinned = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.explode(F.array(words(F.col("text")))).alias("words"))
    c, w = Counts(F.col("text")), F.col("words")
    counted = pinned.select(
        "doc_id", "text",
        F.inline(F.array(F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            c.n_symbols.alias("n_symbols"), c.n_dup_lines.alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"),
        ))),
    )
    have = Measured(F.col("text"), {k: k for k in COUNTS})
    order = order_rules(docs, rules)
    return counted.select(
        "doc_id", *COUNTS, (BASE_RULES["few_words"](have) | BASE_RULES["repetitive"](have)).alias("base_failed"),
        cascade(have, rules, order).alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull())


def filter_documents(docs: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with all their columns; each text pays only up to its first rejection."""
    name = fresh(docs, "_rejected")
    counts = Counts(F.col("text"))
    return docs.withColumn(name, cascade(counts, rules, order_rules(docs, rules))).filter(F.col(name).isNull()).drop(name)
