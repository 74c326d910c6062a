"""Sources entry by entry, retries that ask once, and the state sink."""

import itertools
import json
import random

from pyspark.sql import functions as F

from cuesmith.operators import context as C
from cuesmith.sources import io


def caption(segment, **changes):
    return {"timestamp": "2024-05-01T10:00:00Z", "session_id": "one", "segment_id": segment, "source_text": f"s{segment}", "text": f"t{segment}", "is_final": False, "revision": 1, **changes}


def test_history_entry_by_entry(spark, tmp_path):
    faults = ["junk", None, 7, [], {}, caption(1, is_final="yes"), caption(1, is_final=1), caption(1, text=None), caption(1, text="x" * 6001), caption(1, revision=-1), caption(1, revision=True), caption(1, revision=1.0), caption(1, revision=2**63), caption(1, segment_id=None), caption(1, timestamp="2024-05-01T10:00:00"), caption(1, timestamp=5), caption(1, session_id=" "), caption(1, language=3)]
    why = ["object", "object", "object", "object", "timestamp", "is_final", "is_final", "text", "text", "revision", "revision", "revision", "revision", "segment_id", "timestamp", "timestamp", "session_id", "language"]
    fine = [caption(5), caption("6", revision="2"), caption(5, text="again"), caption(7, status="failed", translation_status=9, extra=[1]), caption(8, translation_status="late")]
    entries = [x for pair in itertools.zip_longest(faults, fine, fillvalue=faults[0]) for x in pair]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(entries), encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"timestamp":')
    (tmp_path / "c.json").write_text('{"timestamp": 1}')
    (tmp_path / "d.json").write_text(" " * (4 << 20) + json.dumps([caption(1)]))
    (tmp_path / "e.json").write_bytes(b"[\xff]")
    (tmp_path / "f.json").write_text("[]")
    good, bad = io.read_history(spark, str(tmp_path))
    got = [(r.file[-6:], r.segment_id, r.revision, r.status, r.text) for r in good.orderBy("file", "place").collect()]
    assert got == [("a.json", 5, 1, "ok", "t5"), ("a.json", 6, 2, "ok", "t6"), ("a.json", 7, 1, "failed", "t7"), ("a.json", 8, 1, "late", "t8")]
    none = io.history_rows(spark.createDataFrame([("x", ""), ("y", None)], "file string, value string"))[1]
    assert sorted(map(tuple, none.collect())) == [("x", None, "file"), ("y", None, "file")]
    rows = {(r.file[-6:], r.pos): r.reason for r in bad.collect()}
    assert {k: v for k, v in rows.items() if k[1] is None} == {(f"{n}.json", None): "file" for n in "bcde"}
    assert [rows["a.json", 2 * i] for i in range(len(faults))] == why and len(rows) == len(entries) - len(fine) + 4


def test_glossary_entry_by_entry(spark, tmp_path):
    entries = [{"source": "师娘", "target": "사모님"}, "junk", {"source": " AI ", "target": "ai"}, {"source": "AI", "target": "other"}, {"source": "x" * 65, "target": "y"}, {"source": "a b", "target": "y"}, {"source": "ok"}, {"source": "ok", "target": 3}, None] + [{"source": f"s{i}", "target": "t"} for i in range(200)]
    (tmp_path / "g.json").write_text(json.dumps(entries))
    terms, issues = C.glossary(io.read_glossary(spark, str(tmp_path)))
    assert [(r.pos, r.source, r.target) for r in terms.orderBy("pos").limit(2).collect()] == [(0, "师娘", "사모님"), (2, "AI", "ai")] and terms.count() == 2 + 191
    assert sorted((r.pos, r.reason) for r in issues.collect()) == [(1, "source"), (3, "repeated"), (4, "source"), (5, "source"), (6, "target"), (7, "target"), (8, "source")] + [(i, "beyond") for i in range(200, 209)]


def test_retries_ask_once(spark, tmp_path):
    """A model that never answers alike twice: each row comes out once, and only rejected rows are asked again."""
    asked, again = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        again.add(sum(p.startswith("retry") for p in prompts))
        return ["" if random.random() < 0.5 else f"{p}/{random.random()}" for p in prompts]

    work = spark.range(0, 2000, numPartitions=5).select("id", F.concat(F.lit("first "), "id").alias("p"), F.concat(F.lit("retry "), "id").alias("q"), F.lit("mine").alias("status"))
    out = C.infer_checked(work, model, "p", lambda c: F.when(c == "", "empty").otherwise("ok"), 3, "q")
    rows = out.collect()
    first = asked.value
    out.count()
    out.collect()
    assert sorted(r.id for r in rows) == list(range(2000)) and asked.value == first
    bad = sum(r.status != "ok" for r in rows)
    late = sum(r.result.startswith("retry") for r in rows)
    assert 2000 + again.value == first and 100 < bad < 400 and again.value >= late + bad and all((r.result == "") == (r.status == "empty") for r in rows)


def test_state_is_there_in_every_batch(spark, tmp_path):
    """A reader beside 50 batches always finds a whole version; a batch that comes again changes nothing."""
    import threading

    folder, stop, seen, faults = str(tmp_path / "state"), threading.Event(), [], []
    merge = lambda old, batch: (batch if old is None else old.unionByName(batch))
    sink = io.state_sink(folder, merge, keep=4)

    def read():
        while not stop.is_set():
            try:
                state = io.read_state(spark, folder)
                seen.append(state.count() if state is not None else 0)
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(50):
            sink(spark.range(i * 4, i * 4 + 4, numPartitions=1), i)
            if i % 10 == 3:
                sink(spark.range(1000, 1004, numPartitions=1), i)
                sink(spark.range(1000, 1004, numPartitions=1), i - 2)
    finally:
        stop.set()
        reader.join(60)
    assert not faults and seen and all(n % 4 == 0 for n in seen) and seen == sorted(seen)
    assert sorted(r.id for r in io.read_state(spark, folder).collect()) == list(range(200))
    assert sum(p.name.startswith("version=") for p in (tmp_path / "state").iterdir()) == 4


def test_state_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 5, i * 5 + 5, numPartitions=1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = io.state_sink(f"{tmp_path}/state", lambda old, batch: batch if old is None else old.unionByName(batch))
    for _ in range(2):
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.id for r in io.read_state(spark, f"{tmp_path}/state").collect()) == list(range(15))


def test_history_file_is_replaced_and_kept_once(spark, tmp_path):
    file = tmp_path / "h.json"
    file.write_text(json.dumps(["junk", caption(3), caption(4, text='quo"te\n한')]))
    good, bad = io.read_history(spark, str(file))
    io.write_history(good, str(file), faulty=bad.count() > 0)
    assert json.loads((tmp_path / "h.json.corrupt").read_text())[0] == "junk"
    again, none = io.read_history(spark, str(file))
    assert none.count() == 0 and [(r.segment_id, r.text) for r in again.orderBy("place").collect()] == [(3, "t3"), (4, 'quo"te\n한')]
    io.write_history(again.filter("segment_id = 4"), str(file))
    assert [x["segment_id"] for x in json.loads(file.read_text())] == [4] and json.loads((tmp_path / "h.json.corrupt").read_text())[0] == "junk"


def test_files_are_read_once(spark):
    """Captions and what is bad come from one pass over a history; a file that is no list is one row."""
    from conftest import SF
    from cuesmith.plans import records

    plan = records.history_files(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("try_parse_json") + plan.count("tryParseJson") <= 2


def test_glossaries_are_read_once(spark):
    from conftest import SF
    from cuesmith.plans import records

    assert records.glossary_files(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
