from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import regex
from mnemospark.llm import queries

SPACE = r"[\x20\x09-\x0D]"
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch maple north ochre pearl quartz ridge stone tidal umber vales wharf yards zones".split()


def corpus() -> list[tuple]:
    """Documents for every stage: junk, shared lines, copies, personal data, an empty and a null text, a long one."""
    rng = random.Random(5)
    words = [a + b for a in WORDS for b in ("", "s", "ing", "ed", "er", "ful")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(80, 200)) + "\n" + text(30)) for i in range(1, 90)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 1) + " again") for i in range(10)]
    rows += [(120 + i, text(90) + "\nThis line is in all of them.\n" + text(20)) for i in range(8)]
    rows += [(140 + i, text(90) + f" write to ann.lee{i % 3}@mail.example or call +1 (555) 201-45{i:02d} now") for i in range(9)]
    rows += [(160, "short"), (161, "### $$$ " * 60), (162, "same three words " * 40), (163, ""), (164, None), (165, text(9000))]
    rows += [(170, rows[0][1]), (171, "ONLY CAPITALS " + text(100).upper())]
    return rows


def fails(text: str) -> bool:
    words = re.findall(rf"[^\x20\x09-\x0D]+", text)
    chars, lines = sum(map(len, words)), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {p for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    upper = len(regex.findall(r"\p{Lu}", text))
    return (len(words) < 50 or 100 * len(repeated) > 50 * len(words) or 20 * len(re.findall(r"[#*$%&|<>]", text)) > chars or 2 * upper > chars
            or 10 * (len(lines) - len(set(lines))) > 5 * len(words) or chars > 30 * len(words))


def without_shared(rows: dict[int, str]) -> dict[int, str]:
    key = lambda line: re.sub(rf"^{SPACE}+|{SPACE}+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    held: dict[str, set] = {}
    for i, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in text.split("\n") if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i) for i, text in rows.items()}


def without_copies(rows: dict[int, str]) -> dict[int, str]:
    """Plain shingle sets; the corpus has nothing near 0.8, where weights would matter."""
    sets = {i: {tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in rows.items())}
    gone = set()
    for a, b in combinations(sorted(rows), 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert not 0.6 < alike < 0.9
        if alike >= 0.8:
            gone.add(b)
    return {i: t for i, t in rows.items() if i not in gone}


def padding(ends, lengths) -> int:
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def least_padding(lengths: list[int], buckets: int) -> int:
    sizes = sorted(set(lengths))
    n = Counter(lengths)
    best = {-1: 0}
    for _ in range(min(buckets, len(sizes))):
        best = {j: min(best[i] + sum((sizes[j] - sizes[k]) * n[sizes[k]] for k in range(i + 1, j + 1)) for i in best if i < j) for j in range(len(sizes)) if any(i < j for i in best)}
    return best[len(sizes) - 1]


def test_run_equals_a_plain_chain(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = without_copies(without_shared({i: t or "" for i, t in rows if not fails(t or "")}))
    assert set(got) == set(kept) and not {160, 161, 162, 163, 164, 171} & set(got) and not {100 + i for i in range(10)} & set(got)
    # Surrogates keep the number of tokens, so lengths follow from the texts before.
    lengths = [len(regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", t)) + 1 for _, t in sorted(kept.items())]
    assert [got[i]["n_tokens"] for i in sorted(got)] == lengths
    ends = {r["bucket_tokens"] for r in got.values()}
    assert padding(ends, lengths) == least_padding(lengths, 16)
    assert all(sum(r["n_tokens"] <= e for e in ends) and r["bucket_tokens"] == min(e for e in ends if e >= r["n_tokens"]) for r in got.values())
    batches = Counter((r["bucket"], r["batch"], r["bucket_tokens"]) for r in got.values())
    assert all(n * tokens <= 16384 or n == 1 for (_, _, tokens), n in batches.items())


def test_surrogates_inside_the_pipeline(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = {r["doc_id"]: r for r in corpus_pipeline.private(spark, docs, "").collect()}
    mail, phone = r"\S+@\S+\.\w+", r"\+1 \(\d{3}\) \d{3}-\d{4}"
    stand_ins = {}
    for i, text in rows:
        new = got[i]["text"]
        if i < 140 or i > 148:
            assert new == text
            continue
        assert re.sub(mail, "M", re.sub(phone, "P", new)) == re.sub(mail, "M", re.sub(phone, "P", text)) and got[i]["n_chars"] == len(new)
        for kind in (mail, phone):
            assert stand_ins.setdefault(re.search(kind, text)[0], re.search(kind, new)[0]) == re.search(kind, new)[0]
    assert len(stand_ins) == 12 == len(set(stand_ins.values())) and not set(stand_ins) & set(stand_ins.values())


def test_stages_keep_the_columns_of_documents(make, spark, odd, empty):
    body = " ".join(f"word{i} other{i * 7 % 31}" for i in range(60))
    near = body.replace("word3 ", "wurd3 ")
    docs = make([(1, body + "\nmail me@example.org", "en"), (2, near + " end", "en"), (3, "short", "en"), (4, body.upper(), "en"), (5, "x" + body[::-1], "en")])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, "")
        if k < 4:
            assert docs.columns == columns, name
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 5]


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        n = stage(spark, odd, "").count()
        assert n == odd.count() if name in ("line_dedup", "pii", "packing") else n < odd.count()


def test_queries_are_the_dealt_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 1 + len(queries.QUERIES)))
