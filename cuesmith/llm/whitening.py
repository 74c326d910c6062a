"""PCA whitening of vectors by a singular value decomposition of the centred rows, never of their covariance.

1. Distinct integer vectors (the fit list) are written once; n and the sums by dimension are exact.
2. Each task centres its rows and reduces them to a triangle R by QR, block by block; triangles are stacked and reduced again in
   rounds of FAN, until one is left. R has the rows' singular values and right vectors, and dimensions x dimensions entries: what the
   driver gets is bounded by the dimension, whatever the number of rows.
3. Householder reflections make R bidiagonal; dqds with safe shifts finds the squared singular values of the bidiagonal to high
   relative accuracy.
4. A vector of the bidiagonal solves one twisted factorisation (stationary from the top, progressive from the bottom, joined where the
   twist element is smallest). Values closer to each other than CLOSE of their size are a cluster: there the factorisations are used
   for inverse iteration, orthogonal to the vectors of the cluster that are found already. Reflections turn vectors back.
5. Rows are projected in one narrow pass; the covariance of the projected fit list is measured over all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.memory import tidy
from cuesmith.llm.scratch import Tables, small_batches

#: Triangles that one task stacks at most, and their bytes.
FAN, FAN_BYTES = 32, 64 << 20
#: Relative distance under which neighbouring values are a cluster.
CLOSE = 1e-3
#: Singular values under this share of the largest are no variance.
TINY = 1e-12
EPS = np.finfo(float).eps


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for a null vector or one with a null or non-finite component.
    Values beyond 64 bits become the nearest long."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))

    def long(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(y >= 2.0**63, F.lit(2**63 - 1)).when(y <= -(2.0**63), F.lit(-(2**63))).otherwise(F.floor(y))

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, long))


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, descending, of the upper bidiagonal with diagonal a and b above it.

    Sweeps of the differential quotient-difference algorithm with a shift: one that leaves a negative element is undone and
    tried with a quarter of it, at last with none, which cannot fail.
    """
    found: list[float] = []
    parts = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while parts:
        q, e, taken = parts.pop()
        tries = 0
        while len(q) > 1:
            n = len(q)
            cut = n - 2 if e[-1] <= EPS * EPS * (taken + q[-1]) else next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * max(taken, q[i])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], taken))
                q, e, tries = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if tries == 0 and 2.25 * q[0] < q[-1]:  # seen from its other end the matrix has the same values, and the small ones come last
                q, e = q[::-1], e[::-1]
            shift = _shift(q, e) / 4**tries if tries < 4 else 0.0
            new = _sweep(q, e, shift)
            if new is None:
                tries += 1
                continue
            q, e, taken, tries = *new, taken + shift, 0
        found += [x + taken for x in q]
    return np.array(sorted(found, reverse=True))


def _shift(q: list[float], e: list[float]) -> float:
    """The lesser value of the last pair, less what the element before couples to it."""
    top, low = q[-2] + e[-1], q[-1]
    large = (top + low) / 2 + np.hypot((top - low) / 2, np.sqrt(e[-1] * low))
    small = q[-2] / large * low if large > 0 else 0.0
    if len(q) == 2:
        return small * (1 - 4 * EPS)
    across, rest = np.sqrt(e[-1] * low), low - small
    share = abs(rest) / np.hypot(across, rest) if across or rest else 0.0
    return max(0.0, small - np.sqrt(e[-2] * q[-2]) * share)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    d, out, off = q[0] - shift, [], []
    for i in range(len(q) - 1):
        if d < 0:
            return None
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        out.append(top)
        off.append(e[i] * ratio)
        d = (d * ratio if top else q[i + 1]) - shift
    return None if d < 0 else ([*out, d], off)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, elements above it, reflections from the right) of a square matrix, by Householder reflections."""
    m, right = r.astype(float).copy(), []
    n = len(m)

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x / scale if (scale := np.abs(x).max()) > 0 else x.copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / size if (size := np.linalg.norm(v)) > 0 else v

    for k in range(n):
        v = reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            w = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _factors(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, ...]:
    """Stationary (d, l) and progressive (p, u) factors of B^T B - value, and the twist elements."""
    n, small = len(a), max(np.finfo(float).tiny, EPS * EPS * value)
    safe = lambda x: x if abs(x) > small else small
    d, l_, u, s, p = (np.zeros(n) for _ in range(5))
    s[0] = -value
    for i in range(n):
        d[i] = safe(s[i] + a[i] * a[i])
        if i < n - 1:
            l_[i] = a[i] * b[i] / d[i]
            s[i + 1] = l_[i] * (b[i] / a[i]) * s[i] - value
    p[n - 1] = a[n - 1] ** 2 - value
    for i in range(n - 2, -1, -1):
        below = safe(b[i] * b[i] + p[i + 1])
        u[i] = a[i] * b[i] / below
        p[i] = p[i + 1] * (a[i] * a[i] / below) - value
    return d, l_, u, s + p + value


def twisted_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The first `count` unit right singular vectors (rows) of the bidiagonal, for its squared singular values, descending."""
    floor = EPS * max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    a = np.where(np.abs(a) < floor, floor, a)
    out: list[np.ndarray] = []
    for j in range(count):
        first = next((i for i in range(j, 0, -1) if values[i - 1] - values[i] > CLOSE * values[i - 1]), 0)
        d, l_, u, twist = _factors(a, b, float(values[j]))
        k = int(np.argmin(np.abs(twist)))
        z = np.zeros(len(a))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -l_[i] * z[i + 1]
        for i in range(k, len(a) - 1):
            z[i + 1] = -u[i] * z[i]
        z /= np.linalg.norm(z)
        if first < j:
            near = np.array(out[first:])
            x = np.random.default_rng(j).standard_normal(len(a))
            for _ in range(4):
                x -= near.T @ (near @ x)
                for i in range(len(a) - 1):
                    x[i + 1] -= l_[i] * x[i]
                x /= d
                for i in range(len(a) - 2, -1, -1):
                    x[i] -= l_[i] * x[i + 1]
                x /= np.abs(x).max()
                x -= near.T @ (near @ x)
                x -= near.T @ (near @ x)
                x /= np.linalg.norm(x)
            z = x
        out.append(z)
    return np.array(out).reshape(count, len(a))


def right_vectors(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values of a square matrix, descending; its first `count` right singular vectors as rows)."""
    scale = np.abs(r).max()
    if not scale > 0:
        return np.zeros(len(r)), np.zeros((count, len(r)))
    a, b, reflections = bidiagonal(r / scale)
    values = dqds(a, b)
    vectors = twisted_vectors(a, b, values, min(count, len(r)))
    for k in range(len(reflections) - 1, -1, -1):
        w = reflections[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ w, w)
    return values * scale * scale, vectors


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """n and the exact sums of the fit list; centred and squared distances of integer rows."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums = n, sums
        reach = 2 * n * max(1, most)
        self.fits = reach < 2**62
        self.squares = reach * reach * max(1, len(sums)) < 2**63

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as longs where they hold it, else as Python integers."""
        if self.fits:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.away(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        away = self.away(x) if self.squares else self.away(x).astype(object)
        out = (away * away).sum(axis=1).tolist() if len(x) else []
        return [v if v < 2**63 else None for v in out]


def _centre(fit: DataFrame, dim: int) -> Centre:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, [0] * dim, 0
        for batch in batches:
            x = matrix(batch.column(0), dim)
            n += len(x)
            large = int(max(abs(int(x.max())), abs(int(x.min())))) if len(x) else 0
            own = (x if large * len(x) < 2**62 else x.astype(object)).sum(axis=0).tolist()
            sums, most = [s + o for s, o in zip(sums, own, strict=True)], max(most, large)
        if n:
            kind = pa.decimal128(38)
            values = pa.array([*map(str, sums), str(n)]).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), values, pa.array([str(most)] * (dim + 1)).cast(kind)], ["i", "s", "most"])

    rows = fit.mapInArrow(partial, "i int, s decimal(38,0), most decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"), F.max("most").alias("most")).collect()
    by = {r.i: int(r.s) for r in rows}
    return Centre(by.get(dim, 0), [by.get(i, 0) for i in range(dim)], max((int(r.most) for r in rows), default=0))


def triangle(fit: DataFrame, dim: int, centre: Centre) -> np.ndarray:
    """R of the QR factorisation of the centred fit list."""
    fan = int(max(2, min(FAN, FAN_BYTES // (8 * dim * dim))))
    schema = "i long, r array<double>"

    def put(i: int, r: np.ndarray) -> pa.Table:
        return pa.table({"i": pa.array([i], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def reduced(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        return np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_ = np.zeros((0, dim)), False
        for batch in batches:
            if len(batch):
                r, any_ = reduced(r, centre.centred(matrix(batch.column(0), dim))), True
        if any_:
            yield from put(TaskContext.get().partitionId(), r).to_batches()

    def stacked(group: pa.Table) -> pa.Table:
        r = np.zeros((0, dim))
        for x in group["r"]:
            r = reduced(r, x.values.to_numpy().reshape(dim, dim))
        return put(group["i"][0].as_py() // fan, r)

    out = Tables(fit.sparkSession).cut(fit.mapInArrow(tidy(blocks), schema), "triangles")
    left = out.select(F.max("i")).first()[0] + 1
    while left > 1:
        out, left = out.groupBy(F.floor(F.col("i") / fan).alias("g")).applyInArrow(stacked, schema), -(-left // fan)
    return np.array(out.first().r).reshape(dim, dim)


NEW = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(rows: DataFrame, vector: str = "vector", components: int = 4) -> DataFrame:
    """rows, each once for every component up to `components` (and the dimension), with component (from 1, by falling variance), n
    (vectors fitted on), deviation (sum of (n * x - S)**2 over dimensions), whitened, explained (share of all variance) and identity_error.

    `vector` is an array of longs. The model is fitted on each distinct vector once. Rows with a null vector, and those of another
    length than most distinct vectors have (ties: the longest), are left out; so is everything where that length is 0. A component without
    variance (constant rows, fewer rows than dimensions) has a null whitened value and 0 explained, and no part in the error. A deviation beyond 64 bits is
    null. Columns of rows named like a new one are replaced. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    fit = tables.cut(rows.select(F.col(vector).alias("x")).filter("x is not null").distinct(), "fit")
    sizes = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dim = sizes[0]["size"] if sizes else 0
    kept = [c for c in rows.columns if c.lower() not in NEW]
    own = rows.select(F.struct(*(F.col(c) for c in rows.columns)).alias("row"), F.col(vector).alias("x")).filter(F.size("x") == dim)
    if not dim:
        kinds = ("int", "long", "long", "double", "double", "double")
        return own.filter("false").select(*(F.col("row")[c].alias(c) for c in kept), *(F.lit(None).cast(k).alias(c) for c, k in zip(NEW, kinds, strict=True)))
    fit = fit.filter(F.size("x") == dim)
    centre = _centre(fit, dim)
    values, vectors = right_vectors(triangle(fit, dim, centre), components)
    live = int((values[:components] > (TINY**2 * values[0] if values[0] > 0 else np.inf)).sum())
    turn = (vectors[:live] / np.sqrt(values[:live] / centre.n)[:, None]).T
    error = _identity_error(fit, dim, centre, turn)
    count = min(components, dim)

    @F.arrow_udf("struct<deviation:long,w:array<double>>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = matrix(column, dim)
            w = np.full((len(x), count), np.nan)
            w[:, :live] = centre.centred(x) @ turn
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(centre.deviations(x), pa.int64()), lists], ["deviation", "w"])

    total = values.sum()
    shares = F.array(*(F.lit(float(v / total) if total > 0 else 0.0) for v in values[:count]))
    out = own.select("row", project("x").alias("p")).select("row", "p.deviation", F.posexplode("p.w").alias("i", "whitened"))
    new = {"component": F.col("i") + 1, "n": F.lit(centre.n).cast("long"), "deviation": F.col("deviation"), "whitened": F.col("whitened"), "explained": F.get(shares, F.col("i")), "identity_error": F.lit(error)}
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *(v.alias(c) for c, v in new.items()))


def _identity_error(fit: DataFrame, dim: int, centre: Centre, turn: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity."""
    k = turn.shape[1]
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centre.centred(matrix(batch.column(0), dim)) @ turn
            sums += w.sum(axis=0)
            squares += w.T @ w
        both = np.append(sums, squares.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both)], ["i", "s"])

    got = np.array([r.s for r in fit.mapInArrow(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]) / centre.n
    mean, squares = got[:k], got[k:].reshape(k, k)
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max())
