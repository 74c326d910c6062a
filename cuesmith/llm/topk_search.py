"""Exact top-k inner-product search with KD-trees.

Candidates are packed into shards by nearness (median splits of the rows that a task holds), each with a KD-tree
(median splits of the widest dimension, tight boxes) that is built and stored once; queries are packed into blocks in
the same way. Blocks move to shards in two passes: the first takes each block to the shards with the highest bound
and gives every query a k-th score; the second takes blocks only to shards whose box can still hold a better score
for one of its queries. Within a shard, nodes are opened best-first by the largest inner product that a vector
inside the node's box could have.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.scratch import Tables

#: Rows of a shard, a leaf and a block of queries, rows that a packing task holds, shards that a block meets first.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, HELD_ROWS, FIRST = 4096, 128, 128, 1 << 16, 2
LIMIT = 2**31


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, or null where the vector takes no part: null, with null or non-finite
    components, or with components of 2**31 / 256 and more."""
    q = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= LIMIT / 256))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), q)


class Tree:
    """KD-tree over integer vectors: nodes in arrays, leaves as ranges of a permutation."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order, self.nodes = np.arange(len(ids)), []  # (begin, end, left, right)
        low, high = [], []

        def build(a: int, b: int) -> int:
            part = x[order[a:b]]
            at = len(self.nodes)
            lo, hi = part.min(axis=0), part.max(axis=0)
            low.append(lo)
            high.append(hi)
            self.nodes.append((a, b, -1, -1))
            if b - a > leaf and (hi > lo).any():
                d, m = int((hi - lo).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], m)]
                left = build(a, a + m)
                self.nodes[at] = (a, b, left, build(a + m, b))
            return at

        build(0, len(ids))
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        self.low, self.high = np.array(low, np.float64), np.array(high, np.float64)

    def search(self, q: np.ndarray, qids: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query up to k (-score, id), best first, of the scores that reach its floor."""
        exact = np.abs(q).max(initial=0) * np.abs(self.x).max(initial=0) * max(1, q.shape[1]) < 2**53
        whole = None if exact else self.x.astype(np.int64)
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        bounds += 1e-9 * np.abs(bounds)
        out = []
        for i, own in enumerate(qids):
            top, heap = [], [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                least = -top[-1][0] if len(top) == k else floor[i]
                if -bound < least:
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-bounds[i, left], left))
                    heapq.heappush(heap, (-bounds[i, right], right))
                    continue
                s = self.x[a:b] @ q[i] if exact else whole[a:b] @ q[i].astype(np.int64)
                ids = self.ids[a:b]
                at = np.flatnonzero((ids != own) & (s >= least))
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -s[at]))[:k]]
                if len(at):
                    top = sorted([*top, *((-int(s[j]), int(ids[j])) for j in at)])[:k]
            out.append(top)
        return out


def _near(x: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows `at` of x in parts of `size` at most, by median splits of the widest dimension."""
    if len(at) <= size:
        yield at
        return
    part = x[at]
    d = int((part.max(axis=0) - part.min(axis=0)).argmax()) if x.shape[1] else 0
    order = np.argpartition(part[:, d], len(at) // 2) if x.shape[1] else np.arange(len(at))
    yield from _near(x, at[order[: len(at) // 2]], size)
    yield from _near(x, at[order[len(at) // 2 :]], size)


def _pack(rows: DataFrame, size: int, trees: bool) -> DataFrame:
    """rows(id, v array of long) as rows(pack, dim, low, high, data): up to `size` near vectors of one length each, with
    the box around them; data is a pickled Tree or (ids, vectors)."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def out(dim: int) -> Iterator[pd.DataFrame]:
            nonlocal made
            rows = held.pop(dim)
            ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim)
            for at in _near(x, np.arange(len(ids)), size):
                made += 1
                data = Tree(ids[at], x[at]) if trees else (ids[at], x[at])
                low, high = (f(x[at], axis=0).astype("<i8").tobytes() for f in (np.min, np.max))
                yield pd.DataFrame({"pack": [task << 24 | made], "dim": [dim], "low": [low], "high": [high], "data": [pickle.dumps(data, 5)]})

        for part in parts:
            for i, v in zip(part["id"], part["v"], strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == HELD_ROWS:
                    yield from out(len(v))
        for dim in list(held):
            yield from out(dim)

    return rows.mapInPandas(pack, "pack long, dim int, low binary, high binary, data binary")


def _bounds(pairs: DataFrame, floors: bool) -> DataFrame:
    """pairs(block, shard, low, high, s_low, s_high[, floor]) as block, shard, bound: the highest inner product of a vector in
    one box and one in the other; with floors only where it reaches the block's lowest floor."""

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = []
            for a, z, c, d in zip(p["low"], p["high"], p["s_low"], p["s_high"], strict=True):
                a, z, c, d = (np.frombuffer(x, "<i8").astype(np.float64) for x in (a, z, c, d))
                most = float(np.max([a * c, a * d, z * c, z * d], axis=0).sum())
                at.append(most + 1e-9 * abs(most))
            out = pd.DataFrame({"block": p["block"], "shard": p["shard"], "bound": np.array(at, float)})
            yield out[out["bound"] >= p["floor"]] if floors else out

    return pairs.mapInPandas(bound, "block long, shard long, bound double")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both inputs have id (long) and v (array of long, from quantised()). Rows with a null id or vector take no
    part; vectors meet only vectors of their own length; a candidate with the query's id is the query's own row.
    Rows of queries that are repeated whole are one query; an empty input gives an empty result.

    What is joined by length of vector are boxes of shards and of blocks only, dealt over as many keys as there are
    shuffle partitions. A shard's tree moves once in each pass, to the blocks that meet it; a task holds one tree.
    """
    t = Tables(candidates.sparkSession)
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = t.cut(_pack(candidates.filter("id is not null and v is not null"), SHARD_ROWS, True), "shards")
    asked = queries.filter("id is not null and v is not null").dropDuplicates(["id", "v"])
    blocks = t.cut(_pack(asked, BLOCK_ROWS, False), "blocks")
    lane = F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")
    boxes = shards.select(F.col("pack").alias("shard"), "dim", lane.alias("lane"), F.col("low").alias("s_low"), F.col("high").alias("s_high"))
    asks = blocks.select(F.col("pack").alias("block"), "dim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lane"), "low", "high")
    pairs = asks.join(boxes, ["dim", "lane"])
    w = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
    chosen = _bounds(pairs, False).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first).select("block", "shard")
    chosen = t.cut(chosen, "chosen")
    found = t.cut(_searched(chosen, shards, blocks.withColumn("floors", F.lit(None).cast("binary")), k, n), "found")

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_row", F.col("score").alias("kth"))
    floors = kth.groupBy(F.shiftright("query_row", 10).alias("block")).agg(F.collect_list(F.struct((F.col("query_row") % 1024).cast("int").alias("at"), "kth")).alias("floors"))
    floors = t.cut(_floors(blocks.join(floors.withColumnRenamed("block", "b"), F.col("pack") == F.col("b"), "left").select("pack", "dim", "low", "high", "data", "floors")), "floors")
    rest = pairs.join(floors.select(F.col("pack").alias("p"), "floor"), F.col("block") == F.col("p"))
    more = _bounds(rest.select("block", "shard", "low", "high", "s_low", "s_high", "floor"), True).select("block", "shard")
    more = more.join(chosen, ["block", "shard"], "left_anti")
    found = found.unionByName(_searched(more, shards, floors.drop("floor"), k, n))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(blocks: DataFrame) -> DataFrame:
    """blocks with floors (a double for each query: its k-th score so far, or -infinity) and floor, the lowest of them."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = []
            for data, known in zip(p["data"], p["floors"], strict=True):
                at = np.full(len(pickle.loads(data)[0]), -np.inf)
                for x in [] if known is None else known:
                    at[x["at"]] = x["kth"]
                made.append(at)
            yield p.drop(columns="floors").assign(floors=[x.tobytes() for x in made], floor=[float(x.min()) for x in made])

    return blocks.mapInPandas(put, "pack long, dim int, low binary, high binary, data binary, floors binary, floor double")


def _searched(pairs: DataFrame, shards: DataFrame, blocks: DataFrame, k: int, n: int) -> DataFrame:
    """query_id, query_row (block and place in it), vec_id, score: what the blocks of pairs(block, shard) find there."""
    asks = pairs.join(blocks, F.col("block") == F.col("pack")).select("shard", F.lit(1).alias("side"), "block", "data", "floors")
    trees = shards.join(pairs.select(F.col("shard").alias("pack")).distinct(), "pack").select(F.col("pack").alias("shard"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("block"), "data", F.lit(None).cast("binary").alias("floors"))
    both = trees.unionByName(asks).repartition(n, "shard").sortWithinPartitions("shard", "side", "block")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if r.side == 0:
                    tree = pickle.loads(r.data)
                    continue
                ids, x = pickle.loads(r.data)
                floor = np.full(len(ids), -np.inf) if r.floors is None else np.frombuffer(r.floors, np.float64)
                rows += [(int(i), r.block << 10 | at, v, -s) for at, (i, top) in enumerate(zip(ids, tree.search(x.astype(np.float64), ids, k, floor), strict=True)) for s, v in top]
            yield pd.DataFrame(rows, columns=["query_id", "query_row", "vec_id", "score"])

    return both.mapInPandas(run, "query_id long, query_row long, vec_id long, score long")
