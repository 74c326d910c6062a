"""The numbered operators against brute force, and their edge cases."""

import hashlib
import os
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from conftest import SF
from cuesmith.llm import benchmark_clean, components, jaccard_join, language_id, line_dedup, mixing, queries, scratch, substring_dedup, token_counts, token_store, topk_search, url_filter
from oracle import compare

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "a  b\n\n c ", "<|endoftext|>x <|startoftext|>", "İstanbul ß ﬁ", "don't 'sing it's. ''s s.", "é x\ty\x1cq \x0b", "中文 字符。 42,7 ... !? a.b", "x " * 3000, "\0 a\0b", "y" * 5000, "A B C D", "a b c d", "same text here now", "same text here now"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string, hits string, words string, label string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with the operators' own names."""
    rows = [(i if i != 7 else None, t, "en" if i % 2 else None, [None, "", "s1", "s2"][i % 4], len(t or ""), "w", "r", "h", "x", "l", "s") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[3:4], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, SF)


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


# 1


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        j = np.arange(n)
        p = mixing.permute(j, np.full(n, n), np.full(n, 99))
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permute(p, np.full(n, n), np.full(n, 99), inverse=True) == j).all()


def filled(sizes, weights, total, most):
    """Shares by weight; what is over a cap goes to the others until none is over."""
    out, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(out[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix(spark, docs):
    rows = mixing.taken_by_document(docs, queries.WEIGHTS, block_words=16, shard_blocks=64).collect()
    source, text = {r.doc_id: r.source for r in docs.collect()}, {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(re.findall(mixing.WORD, text[r.doc_id])) and r.source == source[r.doc_id] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    weights = {s: queries.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    taken = {}
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.taken_by_document(docs.repartition(7), queries.WEIGHTS, block_words=16, shard_blocks=64).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_spans(spark, docs):
    rows = spark.createDataFrame([(i, f"s{i % 3}", 10 + i) for i in range(60)], "row long, source string, size long")
    spans, _ = mixing.mix(rows, [1.0, 1.0, 8.0], block_words=8, shard_blocks=16)
    got = spans.collect()
    size = {i: 10 + i for i in range(60)}
    seen = {}
    for r in got:
        assert 0 <= r.start and r.start + r.words <= size[r.row]
        for w in range(r.start, r.start + r.words):
            assert (r.row, r.turn, w) not in seen
            seen[r.row, r.turn, w] = 1
    assert len({r.shard for r in got}) > 1 and len({(r.shard, r.place) for r in got}) > 3


def test_mixed_documents(spark, docs):
    out = mixing.mix_documents(docs, queries.WEIGHTS, block_words=32)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert out.columns == docs.columns
    for r in rows:
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id] or set(r.text.split()) <= set(text[r.doc_id].split()))


def test_mix_edges(spark, odd):
    rows = mixing.taken_by_document(odd, queries.WEIGHTS).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    clash = odd.selectExpr("*", "1 as _row", "2 as _size", "3 as _of", "4 as spans", "5 as size", "6 as part")
    mixed = mixing.mix_documents(clash, queries.WEIGHTS).collect()
    assert mixed and all((r._row, r._size, r._of, r.spans, r["size"], r.part, r.row, r.words) == (1, 2, 3, 4, 5, 6, "r", "x") and r.text and r.n_chars == len(r.text) for r in mixed)
    assert mixing.taken_by_document(odd.limit(0), queries.WEIGHTS).count() == 0 and mixing.mix_documents(odd.limit(0), queries.WEIGHTS).count() == 0


# 2 and 5


def test_pieces_add_up():
    t = Tokenizer.from_file(BYTES)
    for x in ODD:
        parts = token_counts.pieces(x or "")
        assert "".join(parts) == (x or "")
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in parts) == len(t.encode(x or "", add_special_tokens=False))


def test_counts_by_hypothesis():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    t, w = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(list("ab Zé'.,!\n\t\r\x0b\x0c12\x85　\x1c中<|endoftext|>s")), max_size=40))
    def check(x):
        assert token_counts.count_column(pa.array([x], pa.string()), BYTES) == [len(t.encode(x, add_special_tokens=False))]
        assert token_store.encode_batch([x], WORDS)[0].tolist() == w.encode(x, add_special_tokens=False).ids

    check()


def test_token_counts(spark, odd, docs):
    t = Tokenizer.from_file(BYTES)
    for df in (odd, docs):
        for r in token_counts.with_token_counts(df, BYTES).collect():
            n = len(t.encode(r.text or "", add_special_tokens=False))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)
    piece = P.path("piece_bpe_32k.model")
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert all(r.n_tokens == len(m.encode(r.text or "")) for r in token_counts.with_token_counts(odd, piece).collect())
    assert token_counts.with_token_counts(odd.limit(0), BYTES).count() == 0


def test_token_store(spark, docs, odd):
    t = Tokenizer.from_file(WORDS)
    manifest = token_store.write_store(docs.repartition(6), WORDS, 1)
    got = {r.doc_id: r for r in token_store.read_store(manifest, with_ids=True).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids) == (at, len(ids), ids) and g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    few = token_store.lookup(manifest, [0, 57, 10**9, -5]).collect()
    assert {r.doc_id: r.ids for r in few} == {i: got[i].ids for i in (0, 57)}
    rows = token_store.read_store(token_store.write_store(odd, WORDS, 1)).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    assert len(rows) == odd.count() and [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert token_store.read_store(token_store.write_store(odd.limit(0), WORDS, 1)).count() == 0


def test_shard_blocks(tmp_path):
    path = str(tmp_path / "x.sst")
    with open(path, "wb") as f:
        w = token_store.ShardWriter(f, 4)
        keys = sorted([-(2**63), -1, 0, 5, 5, *range(10, 4000)])
        for k in keys:
            w.add(token_store.key_bytes(k), np.full(40, k & 0xFFFF, "<u4"))
        w.close()
    r = token_store.ShardReader(path)
    assert len(r.blocks()) > 3 and [token_store.key_value(k) for k, _ in r.scan()] == keys
    assert len(r.get(token_store.key_bytes(5))) == 2 and r.get(token_store.key_bytes(7)) == [] and r.get(token_store.key_bytes(3999))[0][0] == 3999


# 3


def test_lines_brute(spark, odd):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\ny"), (3, "a\nb\nc\na\nb"), (4, None), (5, ""), (6, "w " * 60), (7, "z\n" + "w " * 60 + "\nq"), (8, "a"), (None, "b\nc"), (3, "a\nb\nc\na\nb")]
    for n in (1, 2, 3):
        got = sorted((r.doc_id or 99, r.n_lines, r.n_removed, r.n_runs, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), n).collect())
        seen, first, want = {}, {}, []
        for d, t in sorted({(d or 99, t) for d, t in rows}, key=lambda x: (x[0], x[1] or "")):
            ls = (t or "").split("\n")
            for i in range(len(ls)):
                if i + n <= len(ls):
                    seen.setdefault(tuple(ls[i : i + n]), (d, i))
                first.setdefault(ls[i], (d, i))
        for d, t in [(d or 99, t) for d, t in rows]:
            ls = (t or "").split("\n")
            gone = set()
            for i in range(len(ls)):
                if i + n <= len(ls) and seen[tuple(ls[i : i + n])] != (d, i):
                    gone |= set(range(i, i + n))
                if len(ls[i].split()) >= 50 and first[ls[i]] != (d, i):
                    gone.add(i)
            runs = sum(i in gone and i - 1 not in gone for i in range(len(ls)))
            want.append((d, len(ls), len(gone), runs, t if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)))
        assert [g[:4] for g in got] == sorted(w[:4] for w in want) and sorted(str(g) for g in got) == sorted(str(w) for w in want)
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 4


def test_urls(spark):
    rules = spark.createDataFrame(queries.RULES + [("allow", "a.b", "/"), ("block", "a.b", "/")], "action string, host string, path string")
    urls = {"http://x.ORG/a?b": ("x.org", "/a", "org/", "allow"), "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "https://m.example.org/en/12#x": ("m.example.org", "/en/12", "example.org/en/1", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"), "http://a.net/": ("a.net", "/", None, "allow"), "http://x.org?y": ("x.org", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"), "http://c.a.b/": ("c.a.b", "/", "a.b/", "block"), "http://org/": ("org", "/", "org/", "allow")}
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, *urls])], "page_id int, url string, verdict string")
    for r in url_filter.filter_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r
    assert url_filter.filter_urls(df, rules).count() == 2 * len(urls) and url_filter.filter_urls(df, rules.limit(0)).filter("rule is null and verdict = 'allow'").count() == 2 * len(urls)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


# 6


def brute_bytes(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                gone[i : i + n] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 14, rng.integers(1, 9)))[::-1]
        x = np.zeros((len(sizes), sizes[0]), np.uint8)
        for i, n in enumerate(sizes):
            x[i, sizes[0] - n :] = rng.integers(97, 100, n)
        place, common = substring_dedup.suffix_order(x, sizes, 5)
        every = sorted((place[i, j], bytes(x[i, sizes[0] - j :]) if j else b"") for i, n in enumerate(sizes) for j in range(n + 1))
        assert [p for p, _ in every] == list(range(len(every))) and all(a[1] <= b[1] for a, b in zip(every, every[1:]))
        assert common.tolist() == [0, *(min(5, len(os.path.commonprefix((a[1], b[1])))) for a, b in zip(every, every[1:]))]


def test_repeats(spark, texts, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdé ")) for _ in range(rng.integers(60, 400)))
    parts = [word() for _ in range(8)]
    rows = [(i, "".join(parts[j] for j in rng.integers(0, 8, 3)) + word()) for i in range(60)] + [(100, None), (101, ""), (102, "z" * 5000), (103, "z" * 99), (104, parts[0] * 5), (105, "q" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy in (substring_dedup.HEAVY, 6):
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(df.repartition(5)).collect()}
        assert got == brute_bytes(rows, 100)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_of_documents(spark, docs, texts):
    got = {r[0]: tuple(r[1:]) for r in queries.op6_substring_dedup(spark, SF).collect()}
    assert got == brute_bytes(list(texts.items()), 100)


def test_repeats_edges(spark, odd):
    out = substring_dedup.remove_repeats(odd, rebuild=True)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.kept_text == "" for r in rows if r.n_bytes == 0)


# 7


def test_search(spark, monkeypatch):
    for name, size in (("SHARD_ROWS", 40), ("LEAF_ROWS", 8), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(topk_search, name, size)
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(0, 0.3, 6).round(1)]) for i in range(300)]
    v += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (450, [0.5, 0.5]), (451, [0.1, 0.2]), (None, [0.1] * 6), (500, []), (501, []), (50, v[50][1])]
    df = spark.createDataFrame(v, "id long, e array<double>").select("id", topk_search.quantised(F.col("e")).alias("v"))
    got = {}
    for r in topk_search.top_k(df, df.filter("id % 50 = 0"), 5, first=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    good = {i: np.floor(256 * np.array(e)) for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    rows = [(i, good[i]) for i, e in v if i in good]
    want = {q: sorted(((int(good[q] @ x), i) for i, x in rows if i != q and len(x) == len(good[q])), key=lambda s: (-s[0], s[1]))[:5] for q in good if q % 50 == 0}
    assert got == {q: w for q, w in want.items() if w}
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(0)
    x = (np.repeat(rng.normal(0, 300, (20, 8)), 100, axis=0) + rng.normal(0, 5, (2000, 8))).astype(np.int64)
    tree = topk_search.Tree(np.arange(2000), x, 64)
    best = tree.search(x[:1].astype(float), np.array([0]), 5, np.array([-np.inf]))
    assert [i for _, i in best[0]] == sorted(range(1, 2000), key=lambda i: (-int(x[i] @ x[0]), i))[:5]


# 8


def test_language(spark, docs, odd):
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).select("lang", "lang_pred", "score", language_id.held_out(F.col("doc_id")).alias("out"), "doc_id").collect()
    apart = [r for r in rows if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.95 * len(apart) and all(0 <= r.score <= 1 for r in rows)
    got = language_id.identify(odd, model).collect()
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got) and len(got) == odd.count()
    named = language_id.identify(odd.withColumn("_predicted", F.lit(7)), model)
    assert {r._predicted for r in named.collect()} == {7}
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_language_learns_only_from_its_rows(spark, docs):
    a = language_id.train(docs)
    b = language_id.train(docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z")))
    assert a.langs == b.langs and np.allclose(a.weights, b.weights) and a.temperature == b.temperature


def plain_ftrl(rows, labels, n_langs, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, passes=3):
    """One number at a time, with dictionaries."""
    z, n = {}, {}

    def weight(f, k):
        x, pen = z.get((f, k), 0.0), 0.0 if f == "bias" else l1
        return 0.0 if abs(x) <= pen else -(x - (pen if x > 0 else -pen)) / ((beta + n.get((f, k), 0.0) ** 0.5) / alpha + l2)

    for _ in range(passes):
        for (at, v), y in zip(rows, labels):
            feats = [*zip(at.tolist(), v.tolist()), ("bias", 1.0)]
            w = {(f, k): weight(f, k) for f, _ in feats for k in range(n_langs)}
            s = [sum(x * w[f, k] for f, x in feats) for k in range(n_langs)]
            e = [np.exp(x - max(s)) for x in s]
            for k in range(n_langs):
                for f, x in feats:
                    g = x * (e[k] / sum(e) - (k == y))
                    old = n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[f, k]
                    n[f, k] = old + g * g
    return {(f, k): weight(f, k) for f, k in z}


def test_language_model_brute(texts):
    some = [t[:300] for t in list(texts.values())[:50]]
    labels = np.arange(50) % 3
    idf = np.ones(language_id.SIZE)
    rows = [language_id.vector(t, idf) for t in some]
    w, b = language_id.ftrl(rows, labels, 3)
    want = plain_ftrl(rows, labels, 3)
    assert all(abs((b[k] if f == "bias" else w[f, k]) - x) < 1e-9 for (f, k), x in want.items()) and sum(x != 0 for x in want.values()) > 20
    logits = np.array([v @ w[at] + b for at, v in rows])
    loss = lambda t: float(np.mean([np.log(np.exp(x / t - (x / t).max()).sum()) + (x / t).max() - (x / t)[y] for x, y in zip(logits, labels)]))
    best = min(np.exp(np.linspace(-3, 3, 2001)), key=loss)
    assert loss(language_id.temperature(logits, labels)) <= loss(best) + 1e-9


def test_language_sample_is_bounded(spark):
    rows = [(1, "la casa roja", "es")] * 300 + [(i, f"the red house {i}", "en") for i in range(2, 60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20)
    assert model.langs == ["en", "es"] and model.predict(["the red house"])[0] == ["en"]


# 9


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(vocab, rng.integers(3, 80)))
        for _ in range(8):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(rng.choice(vocab, 40))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choice(vocab, i % 9))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "b a"), (906, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df.repartition(3), k, percent).collect()}
        assert got == brute_components(rows, k, percent)
    kept = jaccard_join.one_of_each_group(df.unionAll(df.limit(30)), 5, 80)
    want = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][1] == i) and kept.columns == df.columns
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_edges(spark, odd):
    assert jaccard_join.jaccard_components(odd).count() == odd.count()
    clash = odd.selectExpr("*", "1 as _id", "2 as _n", "3 as id", "4 as _t")
    kept = jaccard_join.one_of_each_group(clash).collect()
    assert kept and all((r._id, r._n, r.id, r._t, r.row) == (1, 2, 3, 4, "r") for r in kept)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64) * np.uint64(2)
        x = np.unique(base[rng.random(len(base)) < 0.9])
        y = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        a, b = (np.frombuffer(s.as_buffer(), np.uint8) for s in jaccard_join._sketches(np.concatenate([x, y]), np.array([len(x), len(y)])))
        assert jaccard_join.differences(a, b) <= len(np.setxor1d(x, y))
        # a query and the box of two members: no more buckets apart than from either
        both = np.array(jaccard_join._boxes(np.concatenate([x, y, base := np.unique(base)]), np.array([len(x), len(y), len(base)])).to_pylist())
        q, every, some = both[0], both[1] & both[2], both[1] | both[2]
        apart = int(np.bitwise_count(((q ^ every) & ~(every ^ some)).view(np.uint64)).sum())
        assert apart <= min(len(np.setxor1d(x, y)), len(np.setxor1d(x, base))) and both.shape == (3, jaccard_join.BOX)


def test_boxes_move_once(spark, monkeypatch):
    """The matrix join moves the wide rows of a class and token in one exchange, which both sides read."""
    plans, cut = [], scratch.Tables.cut

    def seen(self, df, name="table"):
        if name == "opened":
            plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return cut(self, df, name)

    monkeypatch.setattr(scratch.Tables, "cut", seen)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        jaccard_join.jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string"))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    wide = [int(n) for n in re.findall(r"\) Exchange\nInput \[(\d+)\]", plans[0])]
    assert sum(n > jaccard_join.BOX for n in wide) == 1


def test_brief_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*"))
    before, was = files(), spark.conf.get(name)
    out = scratch.Tables(spark, brief=True).cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name) == was
    assert sum(r["count"] for r in out.collect()) == 1000


def test_near_copies_of_one_text(spark):
    """A large cluster with many members on both sides of the threshold, and a passage in many other texts."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        t = list(base)
        for j in rng.integers(0, len(t), rng.integers(0, 7)):
            t[j] = f"x{rng.integers(0, 40)}"
        if i % 3 == 0:
            del t[: rng.integers(0, 12)]
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join([f"r{j}" for j in rng.integers(0, 9999, rng.integers(2, 30))] + base[:60])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (5, 100), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[100] == 0 and all(got[i] == i // 10 * 10 for i in range(40))


# 10


def test_contamination_paths(spark, odd):
    bench = spark.createDataFrame([(1, "A b c d e f g h i j k"), (2, "short One"), (3, None), (4, ""), (5, "b c d e f g h i j k")], "item_id long, text string")
    d = spark.createDataFrame([(1, "xx a B, c. d e f g h i j k zz"), (2, "nothing"), (3, None), (4, "a short one. short ONE short one"), (5, "a b c d e f g h i"), (1, "xx a B, c. d e f g h i j k zz")], "doc_id long, text string")
    for limit in (benchmark_clean.INLINE, 0):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in benchmark_clean.contamination(d, bench, inline_limit=limit).collect())
        assert got == sorted([(1, 13, 11, 2, ["1", "5"], True), (2, 1, 0, 0, [], False), (3, 0, 0, 0, [], False), (4, 7, 6, 1, ["2"], True), (5, 9, 0, 0, [], False), (1, 13, 11, 2, ["1", "5"], True)])
        assert sorted(r.doc_id for r in benchmark_clean.decontaminated(d, bench, inline_limit=limit).collect()) == [2, 3, 5]
        spans = {r.doc_id: r.text for r in benchmark_clean.decontaminated(d, bench, remove="spans", inline_limit=limit).collect()}
        assert spans == {1: "xx zz", 2: "nothing", 3: None, 4: "a", 5: "a b c d e f g h i"}
    assert benchmark_clean.contamination(odd, bench).count() == odd.count()
    assert benchmark_clean.decontaminated(odd, bench.limit(0)).columns == odd.columns and benchmark_clean.contamination(d.limit(0), bench).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    read = spark.read.parquet(f"{SF}/documents.parquet")
    kept = read
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != "token_output":
            assert kept.columns == read.columns
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = brute_components(rows, 5, 80)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][1] == i)
        if name == "benchmark_decontamination":
            dirty = {r.doc_id for r in benchmark_clean.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - dirty
    assert sorted(corpus_pipeline.run(spark, SF).columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]


def test_pipeline_odd_rows(spark, docs, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names through all stages, and an empty table."""
    import corpus_pipeline

    named = docs.limit(60).select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars", *(F.lit(c).alias(c) for c in ("n_words", "row", "hits", "words", "label", "score"))).toDF(*odd.columns)
    both = odd.unionByName(named)
    for start in (both, both.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{start is both}"
            stage(spark, kept, SF).write.parquet(path)
            kept = spark.read.parquet(path)
            if name == "language_id":
                assert all(r.text and any(map(str.isalpha, r.text)) for r in kept.collect())
            if name == "source_mix":
                assert all(r.text.strip() for r in kept.collect())
            if name != "token_output":
                assert kept.columns == odd.columns
        assert (kept.count() > 0) == (start is both)


# names and bounds


def test_clashing_names(spark):
    """Columns named as those made inside stay as they are."""
    extra = ["_doc", "_th", "_rd", "_rt", "_runs", "_b_host", "_b_path", "row", "__row", "Words", "hits", "of_row"]
    rows = [(1, "a\nb\nq", "http://x.org/a"), (2, "a\nb\nz", "http://a.com/de/"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").select("*", *(F.lit(c).alias(c) for c in extra))
    bench = spark.createDataFrame([(1, "z")], "item_id long, text string")
    rules = spark.createDataFrame(queries.RULES, "action string, host string, path string")
    made = {
        "lines": line_dedup.dedup_lines(df),
        "urls": url_filter.filter_urls(df, rules),
        "found": benchmark_clean.contamination(df, bench),
        "joined": benchmark_clean.contamination(df, bench, inline_limit=0),
        "clean": benchmark_clean.decontaminated(df, bench),
    }
    for name, out in made.items():
        got = out.collect()
        assert out.columns[: len(df.columns)] == df.columns, name
        assert len(got) == 3 - (name == "clean") and all(r[c] == c for r in got for c in extra), name
    assert {r.doc_id: r.text for r in made["lines"].collect()} == {1: "a\nb\nq", 2: "z", 3: None}


def test_no_language_goes(spark):
    rows = [(i, f"w{i % 9} some text {i % 9}", f"l{i % 9}") for i in range(1, 200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20, sample_rows=40)
    assert model.langs == [f"l{i}" for i in range(9)]


def test_long_pieces_are_not_kept():
    texts = pa.array(["字" * 20_000, "ab " + "q" * 500 + " ab", None])
    want = [len(Tokenizer.from_file(BYTES).encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
    assert token_counts.count_column(texts, BYTES) == want == token_counts.count_column(texts, BYTES)
    assert max(map(len, token_counts._worker(BYTES)[1])) <= token_counts.LONGEST
    list(token_store.encode_column(texts.fill_null(""), WORDS))
    made = token_store._encoder(WORDS)
    assert all(len(w) <= token_store.LONGEST for w in [*made.young, *made.old])


def test_words_stay_known_in_little_memory(monkeypatch):
    """220,000 words in short runs, twice: the second time none is encoded, and keeping them takes some 20 bytes a word."""
    monkeypatch.setitem(token_store._encoders, WORDS, token_store._Encoder(WORDS))
    made, asked = token_store._encoder(WORDS), []
    batch = made.batch
    monkeypatch.setattr(made, "batch", lambda texts: asked.append(len(texts)) or batch(texts))
    letters = "abcdefghijklmnopqrst"
    word = lambda i: "".join(letters[i // 20**k % 20] for k in range(5))
    texts = pa.array([" ".join(map(word, range(i, i + 2_000))) for i in range(0, 220_000, 2_000)])
    list(token_store.encode_column(pa.array(["warm"]), WORDS))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    first = [x.tobytes() for x, _ in token_store.encode_column(texts, WORDS, 1 << 18)]
    held = tracemalloc.get_traced_memory()[0] - sum(map(len, first)) + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert asked and held < 16 << 20
    asked.clear()
    assert [x.tobytes() for x, _ in token_store.encode_column(texts, WORDS, 1 << 18)] == first and not asked
    want = Tokenizer.from_file(WORDS).encode(texts[7].as_py(), add_special_tokens=False).ids
    assert token_store.encode_batch([texts[7].as_py()], WORDS)[0].tolist() == want


def test_length_is_bounded(docs):
    for n in (20, 300):
        with pytest.raises(ValueError, match="length"):
            substring_dedup.remove_repeats(docs, n)
