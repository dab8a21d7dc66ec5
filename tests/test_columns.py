"""Literal cases of the column functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T, vectors as X, weights as W

NOW = datetime(2024, 5, 4, 12)


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def L(x):
    return F.lit(x)


@pytest.mark.parametrize("text,want", [
    ("", 0), ("hello world", 3), ("aaaa", 1), ("aaaaa", 2), ("你好世界", 4), ("。", 1), ("你好 hello", 4), ("abc", 1)])
def test_estimate_tokens(spark, text, want):
    assert one(spark, T.estimate_tokens(L(text))) == want


@pytest.mark.parametrize("text,want", [
    ("Redis MaxOpenConns 不要设为 100", "prohibitive"), ("数据库连接池 应该按负载调整大小", "affirmative"),
    ("并发问题通常出在锁粒度", "neutral"), ("不要使用文本 gsub 覆写脚本", "prohibitive"), ("Don't use global state", "prohibitive")])
def test_polarity(spark, text, want):
    assert one(spark, T.polarity(L(text))) == want


def test_bigrams_and_dice(spark):
    def d(a, b, fold=True):
        return one(spark, T.dice(T.char_bigrams(L(a), fold), T.char_bigrams(L(b), fold)))

    assert d("OpenClash", "openclash") == 1.0 and d("", "x") == 0.0 and d("量子引力", "菜谱烹饪") < 0.1
    assert d("OpenClash", "openclash", fold=False) < 1.0 and d("😀", "😀") == 1.0
    assert abs(d("The user prefers PostgreSQL", "The user now prefers SQLite", False) - 0.694) < 1e-3
    assert d("abcd", "cdab") == d("cdab", "abcd")


def test_tokens(spark):
    assert one(spark, T.tokens(L("The quick_brown fox: Abcd1 ab"))) == ["quick", "brown", "abcd1"]
    pairs = [("alpha beta gamma", "gamma alpha beta", True), ("alpha words here", "other stuff alpha", True), ("", "alpha", False),
             ("alpha beta gamma delta", "omega sigma kappa alpha", False)]
    for a, b, want in pairs:
        assert one(spark, T.token_overlap(T.tokens(L(a)), T.tokens(L(b)))) is want
    assert one(spark, T.token_jaccard(T.tokens(L("alpha alpha beta")), T.tokens(L("alpha gamma")))) == pytest.approx(2 / 3)


def test_expansion(spark):
    assert one(spark, T.expand_query(L("  "))) == "" and one(spark, T.expand_query(L("最近怎么样"))) == "最近怎么样"
    assert one(spark, T.expand_query(L("pgvector pgvector 报错"))).count("pgvector") == 3
    assert "clawfeed-push-v3.py" in one(spark, T.expand_query(L("CLAWFEED-PUSH-V3.PY 推送")))


@pytest.mark.parametrize("text,days,newest", [
    ("what happened last week", 7, False), ("上周做了什么", 7, False), ("yesterday?", 1, False), ("the most recent", None, True),
    ("最近一次", None, True), ("最近一周", 7, True), ("plain", None, False)])
def test_relative_time(spark, text, days, newest):
    w = one(spark, T.relative_time(L(text), NOW))
    assert w["sort_newest"] is newest
    assert w["after"] == (NOW - timedelta(days=days) if days else None) and w["before"] == (NOW if days else None)


@pytest.mark.parametrize("text,confirmed,correction", [
    ("记住：软路由在客厅", True, False), ("Remember this: use tabs", True, False), ("不对，evaluator 写错了", False, True),
    ("Actually it's port 80", False, True), ("Don't use that script", False, True), ("actually " + "x" * 200, False, True), ("hello", False, False)])
def test_derivation_flags(spark, text, confirmed, correction):
    assert one(spark, T.is_confirmed(L(text)), T.is_correction(L(text))) == (confirmed, correction)
    short = correction and len(text) < 200
    assert one(spark, T.is_correction(L(text), shorter_than=200)) is short


def test_derive_summary(spark):
    assert one(spark, T.derive_summary(L(" 继续：检查 openclash 缓存是否污染\n"))) == "检查 openclash 缓存是否污染"
    assert len(one(spark, T.derive_summary(L("x" * 900)))) == 900
    assert len(one(spark, T.derive_summary(L("x" * 900), 500))) == 500


def test_weights(spark):
    def ago(days):
        return F.lit(NOW - timedelta(days=days)).cast("timestamp")

    def freq(*days):
        return one(spark, sum((W.access_contribution(ago(d), L(NOW)) for d in days), L(0.0)))

    assert freq(1, 0) == pytest.approx(1.9048, abs=1e-4) and freq(10, 10, 10) == pytest.approx(1.1036, abs=1e-4)
    assert freq(7, 5, 2, 1) == pytest.approx(2.8266, abs=1e-4)
    assert one(spark, W.decayed_weight(L(2.0), ago(100), ago(20), L(NOW))) == pytest.approx(0.4463, abs=1e-4)
    assert one(spark, W.is_cooled(L(0.01))) is False
    assert one(spark, W.surprise_scale(L(1.0))) == pytest.approx(1 / 3)
    assert one(spark, W.surprise_score(L(False), L(True), L(True))) == 1.0 and one(spark, W.surprise_score(L(True), L(True), L(True))) == 0.0
    assert one(spark, W.protection_decayed_weight(L(1.0), L(9), L(30.0))) == pytest.approx(2.718281828 ** -0.125)
    assert one(spark, W.interference_rate(L(10), L(3)), W.interference_rate(L(0), L(3))) == (pytest.approx(0.3), 0.0)
    assert one(spark, W.source_trust(L("USER")), W.source_trust(L("DELEGATION"))) == (5, 3)


def test_vectors(spark):
    a = F.array(*[L(float(x)) for x in (3, 4, 0)]).cast("array<float>")
    b = F.array(*[L(float(x)) for x in (4, 3, 0)]).cast("array<float>")
    zero = F.array(L(0.0), L(0.0), L(0.0)).cast("array<float>")
    assert one(spark, X.cosine(a, b), X.cosine(a, zero), X.dot(X.unit(a), X.unit(b))) == (pytest.approx(0.96), 0.0, pytest.approx(0.96))
    assert one(spark, X.has_magnitude(zero), X.has_magnitude(a)) == (False, True)


def test_keyword_vector_hash(spark):
    assert X._fnv1a(b"") == 14695981039346656037 and X._fnv1a(b"a") == 0xAF63DC4C8601EC8C
    rows = spark.createDataFrame([("你好世界",), ("",), ("x",)], "s string").select(X.keyword_vector(F.col("s"), 64).alias("v")).collect()
    assert [round(sum(x * x for x in r.v), 5) for r in rows] == [1.0, 0.0, 1.0]
