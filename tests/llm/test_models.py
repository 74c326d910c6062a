"""Phrase graph, whitening and language-model scores against brute force, and their edge cases."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import SF
from cuesmith.llm import collocations, language_model, queries, whitening
from cuesmith.llm.scratch import Tables

# 11


def phrases(rows, least, most, cover=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        longer = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * longer[p] < cover * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


ODD = [("en", "A b c d, e f g. " * 3), ("en", "a b\tc d e f\x0bg a b"), ("de", "a a a a a a"), (None, "x y z x y z x y z"), ("und", "x y"), ("en", None), (None, ""), ("fr", "., ; : !"), ("en", "é ü \x1c ß é ü \x1c ß"), ("en", "a b c d"), ("en", "a b c d")]


@pytest.mark.parametrize("least, most, bits", [(1, 50, 25), (2, 3, 25), (3, 100, 6)])
def test_collocations(spark, monkeypatch, least, most, bits):
    """A set of 64 bits lets nearly all words and pairs pass: the result stays."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    docs = spark.createDataFrame([(x, t, 1, "n") for x, t in ODD], "lang string, text string, a int, phrase string")
    got = collocations.collocations(docs, least, most)
    assert got.dtypes[0] == ("lang", "string") and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == phrases(ODD, least, most)


def test_collocations_of_the_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 4, 500).collect())) == phrases(rows, 4, 500)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_long_text_in_units(monkeypatch):
    monkeypatch.setattr(collocations, "UNIT", 50)

    class Batch:
        def __init__(self, lang, text):
            import pyarrow as pa

            self.columns = [pa.array([lang]), pa.array([text])]

        def column(self, i):
            return self.columns[i]

    text = "aa bb cc. " * 40 + "dd"
    units = list(collocations.units(iter([Batch("en", text)])))
    assert len(units) > 5 and sum(int(u.real.sum()) for u in units) == 121 and sum(int(u.pair.sum()) for u in units) == 80


def test_paths(spark):
    """Edges come back whole, a chain is few rows, a ring and a knot end."""
    docs = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(200)) + "."), ("x", "p q r s p q r s p q r s"), ("x", "a a a a a a")], "lang string, text string")
    tables = Tables(spark)
    runs = collocations.phrase_runs(docs, 1, tables)
    edges = runs.filter("next is not null").select("lang", "node", "next", "weight")
    made = collocations.paths(edges, tables).collect()
    back = Counter()
    for r in made:
        assert len(r.words) == len(r.weights) + 3
        back.update({tuple(r.words[i : i + 4]): w for i, w in enumerate(r.weights)})
    assert back == Counter({(*e.node.split(" "), e.next): e.weight for e in edges.collect()})
    assert len(made) < 60


# 12


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "thin", "near"])
def test_right_vectors(kind):
    rng = np.random.default_rng(1)
    d = 24
    x = rng.standard_normal((200, d))
    x = {"plain": x, "graded": x * 10.0 ** -np.arange(d), "equal": np.vstack([np.eye(d), -np.eye(d)]), "thin": x[:5], "near": x[:, :1] + 1e-6 * x}[kind]
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    values, vectors = whitening.right_vectors(r, 4)
    sizes = np.append(np.linalg.svd(x, compute_uv=False), np.zeros(d))[:d]
    assert np.abs(values - sizes**2).max() < 1e-13 * values[0] and np.abs(values[:4] / sizes[:4] ** 2 - 1).max() < 1e-12
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-11
    assert np.abs(x.T @ (x @ vectors.T) - vectors.T * values[:4]).max() < 1e-12 * values[0]


def test_dqds_is_accurate_for_small_values():
    a, b = 10.0 ** -np.arange(20.0), 0.5 * 10.0 ** -np.arange(19.0)
    got = whitening.dqds(a, b)
    from fractions import Fraction

    product = math.prod(Fraction(x) ** 2 for x in a.tolist())
    assert abs(math.prod(map(Fraction, got.tolist())) / product - 1) < 1e-10


def test_whitening_of_the_table(spark):
    got = queries.op12_whitening(spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array([np.floor(256 * np.asarray(v, float)) for v in raw.embedding]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (u - s / n).T @ (u - s / n) / n
    values, vectors = np.linalg.eigh(c)
    w = ((x - s / n) @ vectors[:, ::-1][:, :4]) / np.sqrt(values[::-1][:4])
    for i in range(4):
        part = got[got.component == i + 1].set_index("vec_id").loc[raw.vec_id]
        mine = part.whitened.to_numpy()
        assert min(np.abs(mine - w[:, i]).max(), np.abs(mine + w[:, i]).max()) < 1e-8
        assert part.deviation.tolist() == ((n * x - s) ** 2).sum(axis=1).tolist() and set(part.n) == {n}
        assert np.abs(part.explained - values[::-1][i] / values.sum()).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and len(got) == 4 * len(raw)


def test_whitening_of_odd_rows(spark):
    inf, nan, big = float("inf"), float("nan"), 3e38
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [0.5, -0.0]), (9, [-3.0, 0.25])]
    docs = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "id long, e array<float>, n int, row string").withColumn("vector", whitening.quantised(F.col("e")))
    got = whitening.whiten(docs, "vector", 4).collect()
    x = np.array([[256, 512], [768, -256], [128, 0], [-768, 64]])
    assert sorted((r.id or 0, r.component) for r in got) == [(i, k) for i, twice in ((0, 1), (1, 1), (2, 2), (9, 1)) for k in (1, 2) for _ in range(twice)]
    assert {r.n for r in got} == {4} and {r.row for r in got} == {"x"} and abs(sum(r.explained for r in got if r.id == 1) - 1) < 1e-12
    assert next(r.deviation for r in got if r.id == 1) == int(((4 * x[0] - x.sum(axis=0)) ** 2).sum())
    one = whitening.whiten(docs.filter("id = 1"), "vector", 4).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, 0.0, 0.0, 0)] * 2
    assert whitening.whiten(docs.filter("id = 99"), "vector").collect() == [] and whitening.whiten(docs.filter("id = 8"), "vector").collect() == []
    huge = spark.createDataFrame([(1, [big, 1.0]), (2, [-big, 1.0]), (3, [0.0, 2.0])], "id long, e array<float>").withColumn("vector", whitening.quantised(F.col("e")))
    far = whitening.whiten(huge, "vector", 1).collect()
    assert len(far) == 3 and [r.deviation for r in far if r.id == 1] == [None] and all(abs(r.whitened) < 2 for r in far)


def test_triangles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = spark.range(0, 300, numPartitions=13).select("id", F.expr("array(id * id % 97, id * 7 % 31, id % 5)").alias("vector"))
    x = np.unique(np.array([r.vector for r in rows.collect()]), axis=0)
    centre = whitening.Centre(len(x), x.sum(axis=0).tolist(), 97)
    fit = rows.select(F.col("vector").alias("x")).distinct().repartition(9)
    r = whitening.triangle(fit, 3, centre)
    away = x - x.mean(axis=0)
    assert np.abs(r.T @ r - away.T @ away).max() < 1e-8


# 13


def ppm(texts, learned, order):
    """log10 probabilities of texts by tables of contexts, with the symbols to exclude held as a set."""
    def symbols(t):
        return [language_model.START] * order + [bytes([c]) for c in t.translate(language_model.LOWER)] + [language_model.END]

    longest = Counter()
    for t in learned:
        s = symbols(t)
        longest.update(tuple(s[i - order : i + 1]) for i in range(order, len(s)))
    levels = {order: longest}
    for k in range(order - 1, -1, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    trie = {k: defaultdict(dict) for k in levels}
    for k, grams in levels.items():
        for g, c in grams.items():
            trie[k][g[:-1]][g[-1]] = c
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                seen = {x: c for x, c in trie[k].get(tuple(s[i - k : i]), {}).items() if x not in gone}
                n = sum(seen.values())
                if s[i] in seen:
                    total += math.log10((2 * seen[s[i]] - 1) / (2 * n))
                    break
                if n:
                    total += math.log10(len(seen) / (2 * n))
                gone |= set(seen)
            else:
                total -= math.log10(language_model.SYMBOLS - len(gone))
        out.append(total)
    return out


TEXTS = ["The cat sat on the mat. The cat sat.", "the dog sat on\nthe log", "", None, " \t ", "Élan ß 中文 the cat", "zzzz zzzz", "the cat", "the cat", "a" * 300, "The mat sat on the cat\x0b\x0c."]


def held(key):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


@pytest.mark.parametrize("chunk, block", [(64 << 20, 4 << 20), (40, 20)])
def test_scores(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(language_model, "CHUNK", chunk)
    monkeypatch.setattr(language_model, "BLOCK", block)
    rows = [(i if i != 6 else None, t, "s", 1.0, False) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, score double, held boolean").repartition(3)
    got = language_model.score_texts(docs, held("doc_id")).collect()
    text = lambda i: (TEXTS * 3)[i if i is not None else 6]
    learns = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1
    raw = lambda t: (t or "").encode()
    ids = [r[0] for r in rows]
    assert any(not learns(i) for i in ids) and sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i in ids)
    counts = Counter(w for i in ids if learns(i) for w in [*raw(text(i)).lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = ppm([raw(text(r.doc_id)) for r in got], [raw(text(i)) for i in ids if learns(i)], language_model.ORDER)
    for r, score in zip(got, want, strict=True):
        words = [*raw(text(r.doc_id)).lower().split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(r.doc_id), len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, -base) and abs(r.score - score) < 1e-9 * max(1, -score)


def test_scores_without_training(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.lit(True)).collect()}
    assert abs(got[1].score + 4 * math.log10(249)) < 1e-12 and (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (2, 0, 0, 0.0)
    assert abs(got[2].score + math.log10(249)) < 1e-12
    assert language_model.score_texts(docs.limit(0), F.lit(True)).collect() == []


def traced(work):
    """(result, bytes held after, most bytes meanwhile) of work: Python's and NumPy's, and what Arrow still holds."""
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        out = work()
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return out, held + pa.total_allocated_bytes() - arrow, most


def test_distinct_words_take_little_memory():
    """A chunk of nothing but distinct words, 400,000 of them: no Python object for each."""

    def fill():
        chunk = language_model._Chunk(4)
        for i in range(0, 400_000, 40_000):
            chunk.add([f"{j:x}".encode() * 2 for j in range(i, i + 40_000)], np.arange(40_000) % 5 == 1)
        return chunk

    chunk, held, _ = traced(fill)
    assert held < 50 << 20
    rows = chunk.rows(7)
    words = dict(zip(rows["words"].combine_chunks().flatten().to_pylist(), rows["times"].combine_chunks().flatten().to_pylist(), strict=True))
    assert len(words) == 400_000 and all(words[f"{j:x}".encode() * 2] == (j % 5 != 1) for j in range(400_000))


def test_scoring_a_block_takes_little_memory():
    """A block of 2 MB: its grams are not held all at once, and scores are those of its texts one by one."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"abc "), n)) for n in [10_000] * 200 + [0, 1, 300_000]]
    keys = np.unique(language_model.grams_of(texts))
    ps = -rng.random(len(keys))
    words = sorted({w for t in texts for w in t.split()})
    ends = np.cumsum([len(t) for t in texts])
    block = {"keys": list(range(len(texts))), "held": [False] * len(texts), "ends": ends.tolist(), "data": zstandard.compress(b"".join(texts))}
    answers = [{"grams": language_model.packed(keys), "ps": ps.tobytes()}, {"words": words, "times": [1] * len(words)}]
    kinds = {"grams": pa.binary(), "ps": pa.binary(), "words": pa.list_(pa.binary()), "times": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "ends": pa.list_(pa.int64()), "data": pa.binary()}
    rows = pa.Table.from_pylist([*answers, block], pa.schema(list(kinds.items())))
    got, _, most = traced(lambda: language_model._scores(rows, 10))
    assert most < 120 << 20
    for i, t in enumerate(texts):
        assert abs(got["score"][i].as_py() - ps[np.searchsorted(keys, language_model.grams_of([t]))].sum()) < 1e-6
    assert got["n_tokens"].to_pylist() == [len(t.split()) + 1 for t in texts]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abcd "), 60)) for _ in range(30)]
    keys, counts = np.unique(language_model.grams_of(texts), return_counts=True)
    pairs, n = np.unique(np.unique(keys & language_model.mask(4)) & language_model.mask(3), return_counts=True)
    low = language_model.low_levels(pairs, n)
    for context in rng.choice(keys >> np.uint64(8), 5):
        asked = np.array([(int(context) << 8) | s for s in [*range(248), 255]], np.uint64)
        every, c = language_model.summed(np.append(keys, asked), np.append(counts, np.zeros(len(asked), np.int64)))
        p = language_model.probabilities(every, c, low)
        assert abs((10.0 ** p[np.searchsorted(every, asked)]).sum() - 1) < 1e-12


def test_model_beats_words_on_the_table(spark):
    """Held-out texts with words that training texts lack: the byte model knows their parts."""
    got = queries.op13_lm_scores(spark, SF).toPandas()
    assert (got.score < 0).all() and got.score[~got.held_out].sum() > got.base_score[~got.held_out].sum()
