"""Values carried from block to block and pointers that double, against one pass over each stream."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import audio as A
from cuesmith.operators import scans as S
from cuesmith.operators import stability as B


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_blocks(spark, width):
    rng = random.Random(width)
    rows = [(s, i, i * 10 + rng.randrange(8), rng.choice([None, *range(5)]), rng.choice([None, 0.2, 0.4, 0.6])) for s in (None, "a", "b", "c") for i in range(-5, 60) if rng.random() < (0.3 if s == "b" else 0.9)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, start long, n long, p double").withColumn("end", F.when(F.col("n").isNotNull(), F.col("start") + F.col("n")))
    gaps = {(r.stream_id, r.seq): (r.missing, r.epoch) for r in A.packet_gaps(df, "stream_id", ["seq"], "start", "end", width).collect()}
    active = {(r.stream_id, r.seq): r.active for r in A.hysteresis(df, "stream_id", ["seq"], F.col("p"), width=width).collect()}
    sums = {(r.stream_id, r.seq): r.before for r in S.running_sum(df, ["stream_id"], ["seq"], F.col("n"), "before", width).collect()}
    assert len(gaps) == len(active) == len(sums) == len(rows)
    for s in (None, "a", "b", "c"):
        end, epoch, on, total = None, 0, False, 0
        for _, seq, start, n, p in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            missing = max(0, start - end) if end is not None else 0
            epoch += missing > 0
            on = on if p is None else p >= 0.5 or (on and p >= 0.35)
            assert gaps[s, seq] == (missing, epoch) and active[s, seq] == on and sums[s, seq] == total
            end, total = (start + n if n is not None else None), total + (n or 0)
    assert set(A.packet_gaps(df, "stream_id", ["seq"], "start", "end", width).columns) == {*df.columns, "missing", "epoch"}


@pytest.mark.parametrize("gap, step, width", [(5.0, 3.0, 4.0), (5.0, 40.0, None), (0.5, 0.2, 3.0)])
def test_jumps(spark, gap, step, width):
    rng = random.Random(int(gap * 10 + step))
    rows, t = [], {"a": 0.0, "b": 0.0, "c": -50.0}
    for n in range(600):
        k = rng.choice("aaab") if n % 50 else "c"
        t[k] += rng.choice([0.0, rng.random() * step])
        rows.append((k, t[k], n))
    df = spark.createDataFrame([*rows, (None, 1.0, 900), ("a", None, 901)], "k string, t double, n long")
    got = sorted((r.k, r.t, r.n) for r in S.throttled_by_jumps(df, "k", "t", gap, ["n"], width).collect())
    want = sorted((r.k, r.t, r.n) for r in B.throttled(df.filter("k is not null and t is not null"), "k", "t", gap, ["n"]).collect())
    assert got == want and len(want) > 5
    assert S.throttled_by_jumps(df.limit(0), "k", "t", gap).collect() == []


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(S, "written", lambda df, real=S.written: rounds.append(1) or real(df))
    df = spark.range(0, 3000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    assert S.throttled_by_jumps(df, "k", "t", 3.0, width=50.0).count() == 1000 and len(rounds) <= 12


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_unions(spark, width):
    rng = random.Random(width)
    rows = [(s, a, a + rng.choice([-2, 0, 1, 5, 30])) for s in (None, "a", "b") for a in [rng.randrange(0, 300) for _ in range(40)]] + [("a", 10, 15)] * 3
    df = spark.createDataFrame(rows, "stream string, start long, end long")
    covered = {r.stream: r.covered for r in A.covered_length(df, "stream", "start", "end", width).collect()}
    found = {}
    for r in A.islands(df, "stream", "start", "end", width).collect():
        found.setdefault(r.stream, []).append((r.start, r.end))
    for s in (None, "a", "b"):
        merged = []
        for _, a, z in sorted(r for r in rows if r[0] == s and r[2] > r[1]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        assert sorted(found[s]) == [tuple(m) for m in merged]
        assert covered[s] == sum(z - a for a, z in merged)
