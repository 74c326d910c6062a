"""Large catalogs and long cues against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from cuesmith.operators import context as C
from cuesmith.operators import metrics as M
from cuesmith.plans import streams


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé中") for _ in range(rng.randrange(40))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randrange(len(a) + 1)] + b[:3] + a[rng.randrange(len(a) + 1) :]
        assert M.edit_distance(a, b) == M.edit_distance(b, a) == plain_distance(a, b)


def test_long_cues():
    """20,000 words each: numbers with a bit a character, no table."""
    import tracemalloc

    rng = random.Random(4)
    a = " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(20_000))
    b = a.replace("four t", "for t", 300)[40:]
    tracemalloc.start()
    assert 300 <= M.edit_distance(a, b) <= 340
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("n, percent", [(152, 9.92), (223, 14.55), (241, 15.72)])
def test_published_rates(spark, n, percent):
    """The published totals from rows: 222 cues of 1,533 characters in four clips; tags, space, marks and case count for nothing."""
    sizes = [6] * 221 + [1533 - 6 * 221]
    rows, left = [], n
    for i, size in enumerate(sizes):
        wrong = min(left, size, 2 if i < 221 else size)
        left -= wrong
        rows.append((i % 4, "<i>" + "A, " * size + "</i>", "b" * wrong + "{\\an8}" + "a." * (size - wrong)))
    assert left == 0
    out = M.error_rate(spark.createDataFrame(rows, "clip int, ref string, hyp string"), M.subtitle_key(F.col("ref")), M.subtitle_key(F.col("hyp")), ["clip"], M.edits)
    total = out.filter("clip is null").first()
    assert (total.edits, total.chars, total.percent) == (n, 1533, percent)


def test_rates_of_documents(spark):
    got = {r.lang: (r.edits, r.chars) for r in streams.cer_documents(spark, SF).collect()}
    short = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 400")
    one = M.error_rate(short, M.subtitle_key(F.col("text")), M.subtitle_key(F.regexp_replace("text", "th|qu", "t")), ["lang"], M.edits).filter("lang is null").first()
    two = M.error_rate(short, M.subtitle_key(F.col("text")), M.subtitle_key(F.regexp_replace("text", "th|qu", "t")), ["lang"]).filter("lang is null").first()
    assert one == two and len(got) > 3


def test_catalog_is_the_glossary(spark):
    rng = random.Random(9)
    letters = ["a", "b", "_", " ", "é", "天", "气", ".", "\\", "E", "Q", "𝒳"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    sources = sorted({word(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 20])) for _ in range(150)})
    rng.shuffle(sources)
    terms = spark.createDataFrame([(i, s, f"t{i}") for i, s in enumerate(sources)], "pos int, source string, target string")
    rows = [(i, "".join(word(rng.randrange(1, 30)) + rng.choice(["", " ", *sources]) for _ in range(rng.randrange(8)))) for i in range(150)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    key = lambda df: sorted(tuple(r) for r in df.select("id", "place", "source", "target").collect())
    got = key(C.match_catalog(texts, terms, "id", most=5))
    assert got == key(C.match_glossary(texts, terms, "id", most=5)) and len(got) > 300


def test_catalog_of_many_terms(spark):
    """100,000 terms: no nested loop, no pattern for each term and text."""
    terms = spark.range(0, 100_000).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("name"), F.col("id")).alias("source"), F.col("id").cast("string").alias("target"))
    texts = spark.createDataFrame([(1, "name7 met name99999 and name100000, not xname5."), (2, "nothing here")], "id int, text string")
    out = C.match_catalog(texts, terms, "id")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [(r.id, r.source) for r in out.orderBy("place").collect()] == [(1, "name99999"), (1, "name7")]


def test_texts_meet_a_catalog_by_words(spark):
    """A text costs its distinct words, not its characters: what is joined has no row for each of them."""
    terms = spark.createDataFrame([(0, "needle"), (1, "a hay"), (2, "天气")], "pos int, source string").withColumn("target", F.upper("source"))
    texts = spark.createDataFrame([(1, "hay " * 20_000 + "needle"), (2, "a hay, 天气."), (3, "needles haya hay")], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    from unittest.mock import patch

    explode = F.explode
    with patch.object(C.F, "explode", lambda c: explode(F.udf(lambda x: seen.add(len(x)) or x, "array<string>")(c))):
        got = C.match_catalog(texts, terms, "id").select("id", "source").collect()
    assert sorted(map(tuple, got)) == [(1, "needle"), (2, "a hay"), (2, "天气")] and 0 < seen.value < 40_000


def test_a_long_text_with_few_edits_is_fast():
    """Rows near the diagonal are enough: what is done is no square of the length."""
    import time

    rng = random.Random(3)
    b = "".join(rng.choice("abcdefgh") for _ in range(120_000))
    a = "".join("xy" if i % 3000 == 7 else "" if i % 1000 == 9 else c for i, c in enumerate(b))
    began = time.process_time()
    near = M.edit_distance(a, b)
    assert time.process_time() - began < 2 and 100 <= near <= 200


def test_edit_distance_near_the_diagonal(monkeypatch):
    rng = random.Random(8)
    for k in range(1500):
        b = [rng.choice("abcé") for _ in range(rng.randrange(70))]
        a = list(b)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(a) + 1)
            a[i : i + rng.randrange(2)] = rng.choice(["", "a", "x"])
        a, b = "".join(a), "".join(b)
        monkeypatch.setattr(M, "NEAR", 10**9)
        whole = M.edit_distance(a, b)
        monkeypatch.setattr(M, "NEAR", 1 + k % 4)
        monkeypatch.setattr(M, "BLOCK", 8)
        assert M.edit_distance(a, b) == whole
