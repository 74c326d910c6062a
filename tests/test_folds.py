import random

import numpy as np
from pyspark.sql import functions as F

from cuesmith.operators import audio as A
from cuesmith.operators import commit as K
from cuesmith.operators import context as C
from cuesmith.operators import metrics as M
from cuesmith.operators import state as T
from cuesmith.sources import io


def test_hysteresis(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.49, 0.5, 0.4, 0.35, 0.34))], "s int, i int, p double")
    assert [r.active for r in A.hysteresis(df, "s", ["i"], F.col("p")).orderBy("i").collect()] == [False, True, True, True, False]


def plain_windows(bits, cut):
    """The same rule over one list, frame by frame."""
    out, prefix, frames, silent, voiced, overlap = [], [], [], 0, 0, False
    for i, v in enumerate(bits):
        if not frames:
            if not v:
                prefix = (prefix + [i])[-cut.prefix :]
                continue
            frames, prefix = prefix, []
        frames = frames + [i]
        voiced += v
        silent = 0 if v else silent + 1
        forced = len(frames) >= cut.most
        if silent >= cut.silence or forced:
            if voiced >= cut.voiced:
                out.append((frames[0], frames[-1], voiced, overlap))
            if forced and silent < cut.silence:
                frames, overlap = frames[-cut.carry :], True
            else:
                prefix, frames, overlap = frames[-cut.prefix :], [], False
            voiced = silent = 0
    return out


def test_utterances_in_islands(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for s in range(12):
        bits = []
        while len(bits) < 900:
            bits += [rng.random() < rng.choice((0.3, 0.8))] * rng.randint(1, 6) if rng.random() < 0.97 else [False] * rng.randint(20, 70)
        rows += [(s, i, v) for i, v in enumerate(bits)]
        want |= {(s, *w) for w in plain_windows(bits, A.DEFAULT)}
    df = spark.createDataFrame(rows, "s int, frame_idx long, voiced boolean")
    got = {(r.s, r.first_frame, r.last_frame, r.n_voiced, r.overlaps_previous) for r in A.utterances(df, "s").collect()}
    assert got == want and any(w[4] for w in want)


def plain_requests(bits, use):
    """The rule of rechecks over lists of frames, one frame at a time from a queue."""
    queue, prefix, frames, out, silent, voiced, probed, overlap = list(enumerate(bits)), [], [], [], 0, 0, 0, False
    while queue:
        i, v = queue.pop(0)
        if not frames:
            if not v:
                prefix = [*prefix, (i, v)][-20:]
                continue
            frames, prefix = prefix, []
        frames = [*frames, (i, v)]
        voiced, silent = voiced + v, 0 if v else silent + 1
        natural = silent >= 25
        if not natural and len(frames) < (250 if probed else 200):
            continue
        forced = not natural
        if voiced >= 10:
            out.append((frames[0][0], i, voiced, forced and not probed, bool(probed), forced, overlap))
            if forced and not probed:
                probed = len(frames)
                continue
            if probed and not use(frames[0][0], i):
                queue, frames, forced = frames[probed:] + queue, frames[:probed], True
        frames, prefix, overlap = (frames[-10:], prefix, True) if forced else ([], frames[-20:], False)
        silent = voiced = probed = 0
    return out


def test_rechecks(spark):
    rng = random.Random(7)
    use = lambda a, z: (a + z) % 3 != 0
    rows, want = [], set()
    for s in range(12):
        bits = []
        while len(bits) < 1200:
            bits += [rng.random() < rng.choice((0.3, 0.9))] * rng.randint(1, 6) if rng.random() < 0.97 else [False] * rng.randint(15, 70)
        rows += [(s, i, v) for i, v in enumerate(bits)]
        want |= {(s, *w) for w in plain_requests(bits, use)}
    df = spark.createDataFrame(rows, "s int, frame_idx long, voiced boolean")
    got = {tuple(r) for r in A.rechecked_utterances(df, "s", use).collect()}
    assert got == want and len({w[4:6] for w in want}) == 3
    assert [(a, z, p, r) for a, z, _, p, r, _, _ in A.checked_windows([True] * 250, use)][:2] == [(0, 199, True, False), (0, 249, False, True)]


def test_long_windows(spark):
    """12 s windows without overlap, an endpoint that closes and never opens, and the end of the stream."""
    bits = [True] * 700 + [False] * 60 + [True] * 15 + [False] * 5 + [True] * 12
    ends = [i in (705, 740, 777) for i in range(len(bits))]
    df = spark.createDataFrame([(1, i, v, e) for i, (v, e) in enumerate(zip(bits, ends))], "s int, frame_idx long, voiced boolean, endpoint boolean")
    got = [(r.first_frame, r.last_frame, r.reason, r.overlaps_previous) for r in A.utterances(df, "s", cut=A.LONG, endpoint="endpoint").orderBy("first_frame").collect()]
    assert got == [(0, 599, "maximum", False), (600, 705, "endpoint", False), (740, 777, "endpoint", False), (760, 791, "end", False)]


def test_frame_energy_across_packets(spark):
    x = (np.sin(np.arange(2000)) * 3000).astype("<i2")
    cuts = [0, 100, 700, 701, 1500, 2000]
    packets = [("a", i, x[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = A.packet_positions(spark.createDataFrame(packets, "stream_id string, seq long, pcm binary"))
    got = {r.frame_idx: r.rms for r in A.frame_energy(df).collect()}
    want = {i: float(np.sqrt((x[i * 320 : i * 320 + 320].astype(float) ** 2).mean()) / 32768) for i in range(6)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_draft_publisher():
    p = K.DraftPublisher()
    run = lambda t, text, kind="observation": p.row({"t": t, "kind": kind, "text": text})["updates"]
    assert run(0, "Hello.") == [] and run(0.1, "Hello.") == [] and run(0.5, "", "tick") == []
    assert run(0.6, "", "tick") == [(1, "Hello.", False, False)]
    assert run(0.9, "Hello.") == [] and run(1.5, "", "tick") == []
    assert run(2, "Hello. Bye.", "final") == [(1, "Hello.", True, False), (2, "Bye.", True, False)]
    q = K.DraftPublisher()
    q.row({"t": 0, "kind": "observation", "text": "Once."})
    assert q.row({"t": 9, "kind": "tick", "text": ""})["updates"] == []


def test_word_commit():
    f = K.WordCommit()
    row = lambda end, words, final=False: f.row({"audio_end": end, "is_final": final, "speculative": False, "voiced": len(words), "words": words})
    assert row(1, [(0.1, 0.7, "Hello.")])["segments"] == []
    two = row(2, [(0.1, 0.7, "Hello."), (0.9, 1.8, " More")])
    assert two["segments"] == ["Hello."] and two["pending"] == "More"
    assert row(3, [(0.1, 0.7, "Hello."), (0.9, 1.8, " More")], True)["segments"] == ["More"]
    assert row(4, [(5, 4, "x")])["warnings"] == ["invalid_words"]


def test_cumulative_commit():
    f = K.CumulativeCommit()
    row = lambda end, text, final=False: f.row({"audio_end": end, "is_final": final, "text": text})
    assert row(1.2, "你好世界。后面继续")["segments"] == []
    assert row(2.2, "你好世界。后面继续说话")["segments"] == ["你好世界。"]
    assert row(3.2, "你好世界。后面继续说话。", True)["segments"] == ["后面继续说话。"]
    g = K.CumulativeCommit()
    g.row({"audio_end": 1, "is_final": False, "text": "今天 是 一个 好日子。明天"})
    assert g.row({"audio_end": 2, "is_final": False, "text": "今天是一个好日子。明天也好"})["segments"] == ["今天是一个好日子。"]


def test_preview():
    assert K.preview_text("One two. Three") == "One two." and K.preview_text("first part, and more") == "first part," and K.preview_text("...") == ""
    assert len(K.preview_text("word " * 50)) <= 96


def test_history_rotation(spark):
    rows = [("o", "s", i, 1, True, False, i) for i in range(1, 106)] + [("o", "s", 1, 9, True, False, 200), ("o", "s", 50, 2, True, False, 201), ("o", "s", 60, 1, True, True, 202), ("o", "s", 60, 5, True, False, 203)]
    df = spark.createDataFrame(rows, "owner string, session_id string, segment_id long, revision long, is_final boolean, removed boolean, seq long")
    got = T.bounded_history(df, "owner", "owner string, session_id string, segment_id long, revision long, is_final boolean, arrived long, position long").orderBy("position").collect()
    assert [r.segment_id for r in got] == [i for i in range(105, 5, -1) if i != 60]
    assert next(r for r in got if r.segment_id == 50).arrived == 50


def test_glossary(spark):
    bad = [(0, "", "x"), (1, "a" * 65, "x"), (2, "a\nb", "x"), (3, None, "x"), (4, "AI", "人工"), (5, "AI", "again"), (6, "AI model", "y"), (7, "天气", "z")]
    terms, issues = C.glossary(spark.createDataFrame(bad, "pos int, source string, target string"))
    assert sorted(r.source for r in terms.collect()) == ["AI", "AI model", "天气"] and issues.count() == 5
    texts = spark.createDataFrame([(1, "SAID AI model"), (2, "SAID"), (3, "今天天气好"), (4, None)], "id int, text string")
    assert [(r.id, r.source) for r in C.match_glossary(texts, terms, "id").orderBy("id", "place").collect()] == [(1, "AI model"), (1, "AI"), (3, "天气")]


def test_hints(spark):
    rows = [("a", i, f"t{i}") for i in range(33)] + [("b", 0, " x "), ("b", 1, "x"), ("b", 2, ""), ("b", 3, "y")] + [("c", 0, "z" * 49)]
    got = {r.owner: (r.ok, r.terms) for r in M.hint_lists(spark.createDataFrame(rows, "owner string, pos int, term string")).collect()}
    assert got == {"a": (False, None), "b": (True, ["x", "y"]), "c": (False, None)}
    rows = [("n", 0, "e\u0301"), ("n", 1, "\u00e9"), ("m", 0, "a <|end|>"), ("k", 0, "a\tb"), *(("r", i, f"t{i % 5}") for i in range(40)), *(("s", i, "x" * 47 + str(i)) for i in range(11)), ("e", 0, " ")]
    got = {r.owner: (r.ok, r.terms) for r in M.hint_lists(spark.createDataFrame(rows, "owner string, pos int, term string")).collect()}
    assert got == {"n": (True, ["\u00e9"]), "m": (False, None), "k": (False, None), "r": (False, None), "s": (False, None), "e": (True, [])}


def test_recovery_rows(spark):
    ok = '{"session_id":"' + "a" * 32 + '","stage":"asr","code":"buffer_recovered","dropped_items":3}'
    lines = [ok, ok.replace("asr", "none"), ok.replace("dropped_items", "other"), "no json", ok.replace(":3", ":-1"), ok.replace("a" * 32, "A" * 32)]
    good, bad = io.checked_recovery(spark.createDataFrame([(x,) for x in lines], "json string"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["dropped_items", "field", "json", "session_id", "stage"]


def test_history_file(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"timestamp":"2024-01-01T00:00:00Z","session_id":"s","segment_id":"2","text":"b","revision":"3","extra":1},{"timestamp":"2024-01-01T00:00:00Z","session_id":"s","segment_id":2,"text":"old"},{"timestamp":"2024-01-01T00:00:00","session_id":"s","segment_id":3},{"session_id":"s","segment_id":4}]')
    good, bad = io.read_history(spark, str(tmp_path / "h.json"))
    assert [(r.segment_id, r.text, r.revision, r.status) for r in good.collect()] == [(2, "b", 3, "ok")] and bad.count() == 2


def test_envelopes_and_words(spark):
    df = spark.createDataFrame([('{"serverContent":{"inputTranscription":{"text":"a"},"interim_input_transcription":{"text":"b"}}}',), ('{"server_content":{"interimInputTranscription":{"text":"c"}}}',), ("x",)], "json string")
    assert sorted((r.part, r.text) for r in io.provider_envelopes(df).collect()) == [(0, "a"), (1, "b"), (1, "c")]
    seg = spark.createDataFrame([(1, [(0.0, 1.0, "hi", 0.1, -0.2, 1.0, [(0.0, 0.4, "h"), (0.4, 1.0, "i")]), (1.0, 2.0, "yo", 0.1, -0.2, 1.0, None)])], "id int, segments array<struct<" + io.SEGMENT + ">>")
    assert [r.text for r in io.recognizer_words(seg, "id").orderBy("seg", "start").collect()] == ["h", "i", "yo"]


def test_state_versions(spark, tmp_path):
    assert io.read_state(spark, str(tmp_path)) is None
    io.write_state(spark.range(3), str(tmp_path), 1)
    io.write_state(spark.range(5), str(tmp_path), 2)
    io.write_state(spark.range(9), str(tmp_path), 2)
    assert io.read_state(spark, str(tmp_path)).count() == 5


def plain_accepted(rows):
    """Indices of the results of one segment that may be shown, from the whole list each time."""
    out, visible, done = [], -1, False
    for i, r in enumerate(rows):
        if r[0] != "result" or done:
            continue
        jobs = [x for x in rows[:i] if x[0] == "job"]
        own = next((n for n, x in enumerate(jobs) if x[1] == r[1]), None)
        if own is None or any(x[0] == "result" and x[1] == r[1] for x in rows[:i]):
            continue
        extended = all(x[4] == jobs[own][4] and (x[2] == jobs[own][2] or K.extends(jobs[own][2], x[2])) for x in jobs[own + 1 :])
        if own == len(jobs) - 1 or (extended and not r[3] and not jobs[-1][3] and r[1] > visible):
            out.append(i)
            visible, done = r[1], r[3]
    return out


def test_accepted_results(spark):
    from cuesmith.operators import stability as B

    rng = random.Random(8)
    rows, want = [], set()
    for s in range(150):
        events, jobs, text = [], [], "hello"
        for rev in range(1, rng.randint(2, 7)):
            text = rng.choice([text + " you", text + "x", text, "other"])
            job = ("job", rev, text, rng.random() < 0.15, rng.choice(["ko"] * 8 + ["en"]))
            events.append(job)
            jobs.append(job)
            while jobs and rng.random() < 0.5:
                j = jobs.pop(rng.randrange(len(jobs)))
                events.append(("result", *j[1:]))
        rows += [(s, 0, i, *e) for i, e in enumerate(events)]
        want |= {(s, i) for i in plain_accepted(events)}
    df = spark.createDataFrame(rows, "session_id int, segment_id int, seq int, kind string, revision int, source string, is_final boolean, language string")
    got = {(r.session_id, r.seq) for r in B.accepted_results(df, same=("language",)).collect()}
    assert got == want and len(want) > 100
    late = [(0, 0, 0, "job", 1, "hello wor", False), (0, 0, 1, "job", 2, "hello world", False), (0, 0, 2, "result", 1, "hello wor", False)]
    assert B.accepted_results(spark.createDataFrame(late, "session_id int, segment_id int, seq int, kind string, revision int, source string, is_final boolean")).count() == 0


def test_deadline_and_final_pieces():
    row = lambda f, end, words, final=False: f.row({"audio_end": end, "is_final": final, "speculative": False, "voiced": len(words), "words": words})
    f = K.WordCommit()
    words = [(i * 0.5, i * 0.5 + 0.4, f" w{chr(97 + i)}") for i in range(24)]
    assert row(f, 12.2, words, True)["segments"] and all(len(p.split()) <= 7 for p in K.WordCommit().row({"audio_end": 12.2, "is_final": True, "speculative": False, "voiced": 1, "words": words})["segments"])
    g = K.WordCommit()
    for end in range(1, 8):
        assert row(g, end, [(0.1, end - 0.6, f" changing{end}")])["segments"] == []
    late = row(g, 9, [(0.1, 8.0, " changing9")])
    assert late["segments"] == ["changing9"] and late["warnings"] == ["deadline"]


def test_reconcile_counts(spark):
    from cuesmith.operators import stability as B

    base = spark.createDataFrame([(1, i, f"s{i}.") for i in range(5)], "k int, place int, text string")
    out = B.reconcile(base.filter("place <> 2").withColumn("segment_id", F.col("place").cast("long") + 1), base, ["k"])
    assert out.count() == len(out.collect()) == 5


def test_rejected_preview_is_offered_again():
    p = K.PreviewPublisher()
    row = lambda t, text, rejected=None, segments=(), final=False: p.row({"window_id": 0, "audio": t, "t": t, "pending": text, "segments": list(segments), "is_final": final, "rejected": rejected})["updates"]
    text = "a longer pending text, and"
    assert row(1.3, text) == [(1, "a longer pending text,", False, False)] and row(3.0, text) == []
    assert row(3.2, text, 1) == [(1, "a longer pending text,", False, False)] and row(3.4, text, 1) == [] and row(4.1, text) == [(1, "a longer pending text,", False, False)]
    assert row(5.0, "", 9, ["done."]) == [(1, "done.", True, False)] and row(5.1, "", 1, (), True) == []


def test_folding_of_long_texts_is_that_of_short_ones(monkeypatch):
    """Tables for long texts, keys alone, and keys of what is left give what is folded letter by letter."""
    from cuesmith.operators import commit as K
    from cuesmith.operators import stability as B

    rng = random.Random(4)
    parts = [*"ab Az09.,:-_ \t\n?'", "é", "ß", "ﬁ", "½", "ͺ", "ﷺ", " ", "1.5", " - ", "天", "の", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        B.folded.cache_clear()
        monkeypatch.setattr(B, "LONG", 10**9)
        key, offsets = B.folded(text)
        B.folded.cache_clear()
        monkeypatch.setattr(B, "LONG", 1)
        assert B.folded(text) == (key, offsets) and B.folded_key(text) == key
        given = K.Published()
        given.key = key[: rng.randrange(len(key) + 1)]
        rest = given.rest(text)[0]
        assert rest is None or tuple(map(list, given.rest_folded(text))) == tuple(map(list, B.folded(rest)))


def test_a_hypothesis_is_made_where_it_is_folded(spark):
    """A document is one row of what is shuffled, not one for each time it is heard."""
    from conftest import SF
    from cuesmith.plans import folds

    plan = folds.cumulative_commit(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan
    from cuesmith.operators import commit as K

    class Plain(K.CumulativeCommit):
        def row(self, r):
            return super().row({"audio_end": r["t"], "is_final": r["is_final"], "text": r["text"]})

    schema = "seq long, segments array<string>, replacement array<string>, pending string, agreed string, warnings array<string>"
    plain = K.folded_rows(folds.hypotheses(spark, SF), ["turn"], "seq", Plain, schema, lambda r, o: [(r["seq"], o["segments"], o["replacement"], o["pending"], o["agreed"], o["warnings"])])
    out = folds.cumulative_commit(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_texts_are_split_a_few_at_a_time():
    """What a worker holds follows the length of texts, not the rows of a batch."""
    import pyarrow as pa

    from cuesmith.functions import sentences as S

    class Docs:
        dtypes = [("doc_id", "bigint"), ("text", "string")]
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    texts = [None, "", "One. Two", *["Three! " * (i % 50) for i in range(2000)], "Long. " * 200_000, "End"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(S.split_documents(Docs(), "doc_id")([batch]))
    assert len(out) >= 5 and max(b.num_rows for b in out) <= S.SPLIT_TEXTS
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], [(s["text"], s["complete"]) for s in r["sentences"]]) for r in rows] == [(i, S.split(t)) for i, t in enumerate(texts)]


def test_drafts_and_finals_come_from_one_pass(spark):
    """Texts are split once, and turns aren't data frames of their own."""
    from conftest import SF
    from cuesmith.plans import streams

    plan = streams.reconcile_ids(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.count("parquet") == 1


def test_a_turn_is_moved_once(spark):
    """A turn is one row of what is shuffled for commit_hypotheses, not one for each second that is heard; keys of words stand side by side."""
    from conftest import SF
    from cuesmith.plans import folds

    assert "Generate" not in folds.commit_hypotheses(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rng = random.Random(9)
    for _ in range(2000):
        words = [(0.0, 0.0, rng.choice(("", " ")) + "".join(rng.choices(["a", "É", "e", "́", "ß", "가", "ᄀ", "ᅡ", " ", "."], k=rng.randint(1, 3)))) for _ in range(rng.randint(0, 6))]
        assert K.joined_key(words) == K.agreement_key("".join(w[2] for w in words))
    said = "One two. three four, five six seven eight nine ten 1 , 000 www.a.org 你好 今天 是 é x y z".split(" ")
    rows = [x for x in folds.heard(said * 3) if x[3]]
    assert [w[2] for w in rows[-1][3]] == [" " + w for w in (said * 3)[-len(rows[-1][3]) :]] and all(w[1] <= at - 0.1 for _, at, _, ws in rows for w in ws)
    assert {w for w, *_ in rows} == set(range(-(-len(said) * 3 // folds.WINDOW_WORDS))) and sum(last for _, _, last, _ in rows) == len({w for w, *_ in rows})


def test_previews_get_a_row_a_window(spark):
    from conftest import SF
    from cuesmith.plans import folds

    out = folds.preview_publisher(spark, SF)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    at = F.col("turn").cast("long") * 1_000_000 + F.col("seq")
    rows = folds.commit_hypotheses(spark, SF).select("conv_id", F.floor(at / folds.PLACES).alias("window_id"), at.alias("seq"), (F.col("seq") % folds.PLACES).cast("double").alias("audio"), at.cast("double").alias("t"), "pending", "segments", "is_final")
    plain = K.folded_rows(rows, ["conv_id"], "seq", K.PreviewPublisher, folds.UPDATES, folds.updates_of)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "window#" in plan.split("MapInArrow")[1]  # what goes to the sessions are windows
