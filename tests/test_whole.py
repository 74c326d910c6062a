"""Queries that must treat whole texts and tables, against the same rules by brute force on small tables."""

import random

from pyspark.sql import functions as F

from cuesmith.operators import stability as B
from cuesmith.plans import folds, streams


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plain_stable(obs):
    """{(pos, obs, text)} of one turn: obs is {number: (t, {pos: text})}."""
    out = set()
    for p in {p for _, texts in obs.values() for p in texts}:
        before, run, given = None, [], False
        for o in sorted(obs):
            t, texts = obs[o]
            if p not in texts:
                continue
            key = tuple((q, texts[q]) for q in sorted(texts) if q <= p)
            if not run or run[-1] != (o - 1, key):
                run, since, given = [], t, False
            run.append((o, key))
            if len(run) >= 2 and t - since >= 0.6 and not given:
                given = True
                if before != texts[p]:
                    out.add((p, o, texts[p]))
                before = texts[p]
    return out


def test_stable_prefixes_brute(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for turn in range(40):
        obs, texts = {}, {}
        for o in range(1, 13):
            if rng.random() < 0.1:
                continue
            if rng.random() < 0.4:
                texts = {p: x for p, x in texts.items() if rng.random() < 0.9} | {rng.randrange(6): rng.choice("ab")}
            obs[o] = (o * 0.4, dict(texts))
            rows += [(turn, p, o, o * 0.4, x) for p, x in texts.items()]
        want |= {(turn, *x) for x in plain_stable(obs)}
    df = spark.createDataFrame(rows, "turn int, pos long, obs long, t double, text string")
    got = {(r.turn, r.pos, r.obs, r.text) for r in B.stable_prefixes(df).collect()}
    assert got == want and len(want) > 50


def test_documents_to_their_last_sentence(spark, tmp_path):
    """stable_prefix, cumulative_commit, draft_publisher, revised_publisher."""
    docs = {n: [f"Line number {i} of text {n} ends here." for i in range(n)] for n in (1, 4, 6, 7, 12, 13, 50)}
    folder = saved(spark, tmp_path, "documents", [(n, " ".join(s)) for n, s in docs.items()], "doc_id long, text string")
    rows = streams.observations(spark, folder).collect()
    assert all(max(r.pos for r in rows if r.turn == n) == n - 1 for n in docs) and len([r for r in rows if r.turn == 50]) < 7 * 50
    stable = {(r.turn, r.pos): r.text for r in streams.stable_prefix(spark, folder).orderBy("obs").collect()}
    assert stable == {(n, i): s for n, d in docs.items() for i, s in enumerate(d)}
    heard = {(r.turn, r.seq): r for r in folds.hypotheses(spark, folder).collect()}
    for (turn, seq), h in heard.items():
        if not h.is_final:
            assert h.text == " ".join(r.text for r in sorted(rows, key=lambda r: r.pos) if (r.turn, r.obs) == (turn, seq))
    assert {t: h.text for (t, _), h in heard.items() if h.is_final} == {n: " ".join(d) for n, d in docs.items()}
    commits = folds.cumulative_commit(spark, folder).orderBy("seq").collect()
    assert {n: [s for r in commits if r.turn == n for s in r.segments] for n in docs} == docs
    for query in (folds.draft_publisher, folds.revised_publisher):
        final = {(r.turn, r.segment_id): r.text for r in query(spark, folder).filter("is_final and not removed").collect()}
        assert all(sorted(x for (t, _), x in final.items() if t == n) == sorted(d) for n, d in docs.items())


def dense(sentences):
    """{number: (t, {pos: text})}: an observation for each sentence, in full."""
    obs = {}
    for o in range(1, max(6, len(sentences) + 3) + 1):
        texts = dict(enumerate(sentences[:o]))
        if o % 2 and o <= len(sentences):
            texts[o - 1] = texts[o - 1][: max(1, len(texts[o - 1]) - 3)]
        obs[o] = (o * 0.4, texts)
    return obs


def test_stable_prefix_hears_every_sentence(spark, tmp_path):
    """An observation for each sentence, whatever their number; sentences of one character are never cut short."""
    docs = {n: [("?", "Is it?", f"Line number {i} of text {n} ends here.")[i % 7 % 3] for i in range(n)] for n in (1, 2, 5, 6, 7, 12, 13, 25, 90)}
    rows = [(n, " ".join(s)) for n, s in docs.items()] + [(1000, None), (1001, ""), (1002, "  ")]
    folder = saved(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = [tuple(r) for r in streams.stable_prefix(spark, folder).collect()]
    want = {(n, *x) for n, s in docs.items() for x in plain_stable(dense(s))}
    assert {(n, p, o, x) for n, p, o, _, x in got} == want and len(got) == len(want)
    assert all(t == o * 0.4 for _, _, o, t, _ in got)


def test_stable_changes_brute():
    """Sentences that come, go and change, and observations that are missing, against whole observations."""
    rng, found = random.Random(6), 0
    for _ in range(400):
        obs, changes, texts, before = {}, [], {}, {}
        for o in range(1, rng.randrange(3, 40)):
            if rng.random() < 0.1:
                continue
            if rng.random() < 0.4:
                texts = {p: x for p, x in texts.items() if rng.random() < 0.9} | {rng.randrange(6): rng.choice("ab")}
            obs[o] = (o * 0.4, dict(texts))
            changes.append((o, o * 0.4, [(p, texts.get(p)) for p in before | texts if before.get(p) != texts.get(p)]))
            before = texts
        got = [(p, o, x) for p, o, _, x in B.stable_changes(changes)]
        assert set(got) == plain_stable(obs) and len(got) == len(set(got))
        found += len(got)
    assert found > 500


def test_turns_to_their_last_word(spark, tmp_path):
    """phrase_islands, commit_hypotheses, preview_publisher."""
    texts = {0: " ".join(f"word{i}" for i in range(150)), 1: " ".join(f"late{i}" for i in range(400)), 2: "The end."}
    folder = saved(spark, tmp_path, "conversations", [(7, t, "user", x) for t, x in texts.items()], "conv_id long, turn int, role string, text string")
    phrases = folds.phrase_islands(spark, folder).orderBy("turn", "pos").collect()
    assert {t: " ".join(r.text for r in phrases if r.turn == t) for t in texts} == texts
    commits = folds.commit_hypotheses(spark, folder).orderBy("turn", "seq").collect()
    assert {t: " ".join(s for r in commits if r.turn == t for s in r.segments) for t in texts} == texts
    shown = folds.preview_publisher(spark, folder).filter("is_final and not removed").orderBy("seq", "segment_id").collect()
    assert " ".join(r.text for r in shown) == " ".join(texts.values())


def test_words_of_all_turns(spark, tmp_path):
    """stable_words: every word of every turn; stable_turns: every turn."""
    texts = {t: " ".join(f"w{i}" for i in range(n)) for t, n in enumerate((3, 70, 13, 1))}
    folder = saved(spark, tmp_path, "conversations", [(7, t, "user", x) for t, x in texts.items()], "conv_id long, turn int, role string, text string")
    got = streams.stable_words(spark, folder).orderBy("obs").collect()
    last = {(r.turn, r.pos): r.text for r in got}
    assert last == {(7000 + t, i): w for t, x in texts.items() for i, w in enumerate(x.split(" "))}
    again = {}
    for r in got:
        again.setdefault((r.turn, r.pos), []).append(r.text)
    assert all(a != b for texts in again.values() for a, b in zip(texts, texts[1:]))
    assert {r.pos: r.text for r in streams.stable_turns(spark, folder).orderBy("obs").collect() if r.pos != 3} == {t: x for t, x in texts.items() if t != 3}


def test_ids_of_all_sentences(spark, tmp_path):
    """reconcile_ids, behind the fortieth sentence too; ids stay apart."""
    docs = {n: [f"Line number {i} of text {n} ends here." for i in range(n)] for n in (1, 40, 43, 130)}
    folder = saved(spark, tmp_path, "documents", [(n, " ".join(s)) for n, s in docs.items()], "doc_id long, text string")
    rows = streams.reconcile_ids(spark, folder).collect()
    for n, want in docs.items():
        kept = sorted((r.place, r.text, r.segment_id) for r in rows if r.doc_id == n and not r.removed)
        assert [k[:2] for k in kept] == list(enumerate(want)) and len({k[2] for k in kept}) == n
        assert all(i // 100 == p // 40 for p, _, i in kept)


def test_reconcile_one_side(spark):
    drafts = spark.createDataFrame([(1, 5, 0, "a")], "k int, segment_id long, place int, text string")
    finals = spark.createDataFrame([(2, 0, "b")], "k int, place int, text string")
    assert {tuple(r) for r in B.reconcile(drafts, finals, ["k"]).collect()} == {(1, -1, 5, "a", True), (2, 0, 1, "b", False)}


def test_recheck_of_whole_items(spark, tmp_path):
    """recheck_choice: texts that differ from their reverse only behind the 80th character."""
    text = "a" * 80 + "bcdefghij" * 40
    folder = saved(spark, tmp_path, "benchmark", [(i, text) for i in range(3)], "item_id long, text string")
    got = {r.item_id: (r.give_back, r.differs, r.n) for r in folds.recheck_choice(spark, folder).collect()}
    assert got == {0: (True, False, 440), 1: (False, True, 440), 2: (False, False, 445)}
