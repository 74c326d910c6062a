"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased code points, hashed into 2**15 buckets, as log(1 + count) * idf
with unit length. Weights are learned by follow-the-regularised-leader (per-coordinate steps, L1 and L2
penalties) on a bounded sample of labelled rows; document frequencies are counted over all of them. A
temperature fitted on a part of the sample that the weights did not see calibrates the probabilities.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.memory import give_back, tidy
from cuesmith.llm.scratch import cut, small_batches
from cuesmith.llm.textbatches import by_bytes

BITS = 15
SIZE = 1 << BITS
#: Rows for each language that the weights and the temperature are fitted on, and rows of all languages together: with
#: more than 256 languages each has fewer, but no language goes.
SAMPLE_PER_LANG, SAMPLE_ROWS = 800, 800 * 256
UNKNOWN = "und"
#: Code points of a text, and bytes of texts, taken at a time, so that long texts and batches need bounded memory.
STEP, HELD = 1 << 20, 4 << 20


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character 1- to 3-grams, and their counts."""
    total = np.zeros(SIZE, np.int64)
    text = text.lower()
    for at in range(0, len(text), STEP):
        c = np.frombuffer(text[at : at + STEP + 2].encode("utf-32-le", "replace"), np.uint32)
        own = min(STEP, len(text) - at)  # grams that begin here
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] + np.uint32(0x9E3779B9))) * np.uint32(2246822519)
        three = (two[:-1] ^ (c[2:] + np.uint32(0x7F4A7C15))) * np.uint32(3266489917)
        total += np.bincount(np.concatenate([x[:own] for x in (one, two, three)]) >> np.uint32(32 - BITS), minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: buckets and TF-IDF weights of unit length."""
    at, n = grams(text)
    v = np.log1p(n) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE x languages
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, v = vector(text, self.idf)
        return (v @ self.weights[at] + self.bias) / self.temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            if not t or not any(map(str.isalpha, t)) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = self.logits(t)
            p = np.exp(z - z.max())
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(float(p[k] / p.sum()))
        return langs, scores


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases (biases without penalties). Rows are taken in the given order."""
    z, n = np.zeros((SIZE + 1, n_langs)), np.zeros((SIZE + 1, n_langs))
    penalty = np.full((SIZE + 1, 1), l1)
    penalty[SIZE] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        x = z[at]
        return np.where(np.abs(x) <= penalty[at], 0, -(x - np.sign(x) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for (at, v), y in zip(rows, labels, strict=True):
            at, v = np.append(at, SIZE), np.append(v, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(key: Column) -> Column:
    """Every row whose key's CRC leaves no remainder by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows that are not held out and have key, text and language.

    Two passes: thresholds of a hash order over (key, text) choose per_lang rows of each language; then one scan
    counts every labelled row's document frequencies and brings the features (not the texts) of the chosen rows
    to the driver: at most sample_rows rows (or one a language, if there are more languages) of at most 2**15 buckets.
    With more than sample_rows / per_lang languages, all of them get fewer rows alike. Rows equal in key, text and
    language are one row of the sample. The driver holds two numbers for each bucket and language.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)))
    order, th = F.xxhash64(F.col(key).cast("string")), F.xxhash64(F.col(text))
    one = rows.select(F.col(lang).alias("l"), order.alias("h"), th.alias("th"))
    ranked = one.withColumn("r", F.dense_rank().over(Window.partitionBy("l").orderBy("h", "th"))).filter(F.col("r") <= per_lang)
    # rows equal in key, text and language share a rank: they count once
    chosen = ranked.distinct().groupBy("l").agg(F.max(F.struct("h", "th")).alias("last"), F.count("*").alias("n")).collect()
    if per_lang > 1 and len(chosen) * per_lang > sample_rows:
        return train(docs, key, text, lang, min(per_lang - 1, max(1, sample_rows // len(chosen))), sample_rows)
    langs = sorted(x.l for x in chosen)
    if not langs:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    upto = {x.l: (x.last.h, x.last.th) for x in chosen}
    none = (-(1 << 63), -(1 << 63) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, taken = np.zeros(SIZE, np.int64), 0, []
        for batch in batches:
            rows = (r for a, b in by_bytes(batch.column(0), HELD) for r in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True))
            for t, l, *h in rows:
                at, count = grams(t)
                df[at] += 1
                n += 1
                if tuple(h) <= upto.get(l, none):
                    taken.append((*h, l, at.astype("<u2").tobytes(), count.astype("<u4").tobytes()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": [*at.tolist(), -1], "n": [*df[at].tolist(), n], "h": [None] * (len(at) + 1), "th": [None] * (len(at) + 1), "l": [None] * (len(at) + 1), "at": [None] * (len(at) + 1), "count": [None] * (len(at) + 1)}, schema=SCHEMA)
        for k in range(0, len(taken), 256):
            h, th, l, at, count = zip(*taken[k : k + 256], strict=True)
            yield pa.RecordBatch.from_pydict({"bucket": [-2] * len(h), "n": [0] * len(h), "h": h, "th": th, "l": l, "at": at, "count": count}, schema=SCHEMA)

    out = rows.select(text, lang, order.alias("h"), th.alias("th")).mapInArrow(tidy(scan), "bucket int, n long, h long, th long, l string, at binary, count binary")
    out = cut(out, "features")
    total = {x.bucket: x.n for x in out.filter("bucket >= -1").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most 2**15 + 1 rows
    idf = np.ones(SIZE)
    for b in range(SIZE):
        idf[b] = np.log((1 + total[-1]) / (1 + total.get(b, 0))) + 1
    sample = out.filter("bucket = -2").dropDuplicates(["h", "th", "l"]).select("h", "th", "l", "at", "count").toPandas().sort_values(["h", "th", "l"], kind="stable")
    return fit(sample, langs, idf)


SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("h", pa.int64()), ("th", pa.int64()), ("l", pa.string()), ("at", pa.binary()), ("count", pa.binary())])


def fit(sample: pd.DataFrame, langs: list[str], idf: np.ndarray) -> Model:
    """Weights on four fifths of the sample, temperature on the rest."""
    of = {l: i for i, l in enumerate(langs)}
    rows, labels = [], np.array([of[l] for l in sample["l"]])
    for a, c in zip(sample["at"], sample["count"], strict=True):
        at = np.frombuffer(a, "<u2").astype(np.int64)
        v = np.log1p(np.frombuffer(c, "<u4")) * idf[at]
        rows.append((at, v / max(np.sqrt(v @ v), 1e-12)))
    apart = np.arange(len(rows)) % 5 == 4
    w, b = ftrl([r for r, x in zip(rows, apart, strict=True) if not x], labels[~apart], len(langs))
    logits = np.array([v @ w[at] + b for (at, v), x in zip(rows, apart, strict=True) if x]).reshape(-1, len(langs))
    return Model(langs, idf, w, b, temperature(logits, labels[apart]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (replaced if there): the text's language and its probability.

    A null text, or one without a letter, is `und` with score 0. One narrow stage over whole texts; the model
    (2**15 weights a language) goes to the executors with the function.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            langs: list[str] = []
            scores: list[float] = []
            for a, b in by_bytes(column, HELD):
                some = shared.value.predict(column.slice(a, b - a).to_pylist())
                langs += some[0]
                scores += some[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        give_back()

    made = f"predicted_{uuid.uuid4().hex}"  # no column of docs has this name
    out = docs.drop("lang_pred", "score").withColumn(made, predict(F.col(text)))
    return out.withColumn("lang_pred", F.col(f"{made}.lang_pred")).withColumn("score", F.col(f"{made}.score")).drop(made)
