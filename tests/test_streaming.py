"""Streams give what the batch operators give, over randomly split files."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from cuesmith.operators import audio as A
from cuesmith.operators import stability as B
from cuesmith.operators import state as T
from cuesmith.plans.captions import changelog
from cuesmith.plans.streams import _frames
from cuesmith.streaming import twins


def stream(spark, rows, folder, order, parts=4):
    """rows written in order of batches, read one file at a time."""
    n = rows.count()
    rows = rows.withColumn("_n", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(parts):
        rows.filter((F.col("_n") > n * i / parts) & (F.col("_n") <= n * (i + 1) / parts)).drop("_n").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.drop("_n").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def collected(df, folder, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_utterances(spark, tmp_path):
    frames = _frames(spark, SF).filter("stream_id < 4")
    out = collected(twins.utterances(stream(spark, frames, tmp_path, "frame_idx"), "stream_id"), tmp_path)
    key = lambda df: sorted((r.stream_id, r.first_frame, r.last_frame, r.n_voiced) for r in df.collect())
    assert key(out) == key(A.utterances(frames, "stream_id"))


def test_throttle(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 6").select("user_id", "event_id")
    out = collected(twins.throttled(stream(spark, e, tmp_path, "event_id"), "user_id", "event_id", 50), tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, B.throttled(e, "user_id", "event_id", 50).collect()))


def test_caption_changes(spark, tmp_path):
    log = changelog(spark, SF).filter("session_id < 6").drop("value")
    out = collected(twins.caption_changes(stream(spark, log, tmp_path, "seq")), tmp_path)
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.seq):
        last[r.session_id, r.segment_id] = None if r.removed else (r.revision, r.is_final, r.text)
    want = {(r.session_id, r.segment_id): (r.revision, r.is_final, r.text) for r in T.caption_state(log, ["text"]).collect()}
    assert {k: v for k, v in last.items() if v} == want


def test_drafts_by_timer(spark, tmp_path):
    """A sentence seen twice is published by the timer, without another row; one seen once is not."""
    import time

    rows = spark.createDataFrame([("a", 1, 0.0, "observation", "Hello."), ("a", 2, 0.1, "observation", "Hello."), ("b", 1, 0.0, "observation", "Once.")], "turn string, seq long, t double, kind string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = twins.drafts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.outputMode("append").format("memory").queryName("drafts_by_timer").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (got := spark.table("drafts_by_timer").collect()):
            time.sleep(0.5)
        time.sleep(2)
        got = spark.table("drafts_by_timer").collect()
    finally:
        q.stop()
    assert [(r.turn, r.segment_id, r.text, r.is_final) for r in got] == [("a", 1, "Hello.", False)]


def test_caption_entries_are_those_of_the_batch(spark, tmp_path):
    """Random logs: the last accepted rows are the batch state, and a batch writes the entries of its own segments only."""
    import random

    rng = random.Random(11)
    rows, many = [], 400
    for seq in range(1200):  # first all segments of one session once, then rows of a few
        segment = seq if seq < many else rng.randrange(6)
        rows.append((1, segment, rng.randrange(4) if seq >= many else 0, rng.random() < 0.3, rng.random() < 0.02, seq, f"t{seq}"))
    rows += [(None, 1, 1, True, False, 1201, "x"), (1, None, 1, True, False, 1202, "x")]
    log = spark.createDataFrame(rows, "session_id long, segment_id long, revision long, is_final boolean, removed boolean, seq long, text string")
    changes = twins.caption_changes(stream(spark, log, tmp_path, "seq", 3))
    q = changes.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    last = {}
    for r in sorted(spark.read.schema(changes.schema).parquet(f"{tmp_path}/out").collect(), key=lambda r: r.seq):
        last[r.session_id, r.segment_id] = None if r.removed else (r.revision, r.is_final, r.text)
    want = {(r.session_id, r.segment_id): (r.revision, r.is_final, r.text) for r in T.caption_state(log, ["text"]).collect()}
    assert {k: v for k, v in last.items() if v} == want and len(want) > 300
    wrote = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(wrote) == 3 and wrote[0] >= many and max(wrote[1:]) < 60


def test_caption_entries_go_after_their_time(spark, tmp_path):
    """A removed segment that comes back once its entry is gone is new."""
    import time

    kind = "session_id long, segment_id long, revision long, is_final boolean, removed boolean, seq long, text string"
    add = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add([(1, 1, 1, False, True, 1, "gone"), (1, 2, 5, True, False, 2, "two")])
    out = twins.caption_changes(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 1_000)
    q = out.writeStream.format("memory").queryName("entries").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()

    def wait(n):
        until = time.time() + 60
        while time.time() < until and spark.table("entries").count() < n:
            time.sleep(0.3)
        return sorted(r.seq for r in spark.table("entries").collect())

    try:
        assert wait(2) == [1, 2]
        time.sleep(2)
        add([(1, 1, 1, False, False, 3, "new"), (1, 2, 1, False, False, 4, "two")])
        assert wait(4) == [1, 2, 3, 4]
    finally:
        q.stop()
