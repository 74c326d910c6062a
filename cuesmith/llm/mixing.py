"""Mixing sources to target weights.

The words of every source form one stream, packed into blocks of a fixed length. Each output shard gets
multinomially drawn numbers of blocks from the sources; a source's n-th slot goes through a pseudorandom
permutation of that source's block indices (another one in each pass over the source), and blocks join the
slots by index. A source's slots are drawn over the shards with its total held at its target, so what a source
gives is exact and the draws decide where it goes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.scratch import cut, small_batches

WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
BLOCK_WORDS, SHARD_BLOCKS = 256, 4096
ROUNDS = 6
STEPS = np.arange(ROUNDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Places of j under a keyed pseudorandom permutation of 0 .. n-1 (a Feistel network on the least even number
    of bits that holds n, walked until inside the range)."""
    j, n, key = (np.asarray(a, np.uint64) for a in (j, n, key))
    half = np.zeros(len(j), np.uint64)
    while (short := (np.uint64(1) << (2 * half)) < n).any():
        half[short] += np.uint64(1)
    half = np.maximum(half, np.uint64(1))
    low = (np.uint64(1) << half) - np.uint64(1)
    x = j.copy()
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                a, b = b ^ (_mix(a + k + STEPS[r]) & m), a
            else:
                a, b = b, a ^ (_mix(b + k + STEPS[r]) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _key(seed: int, source: str | None, turn: int) -> int:
    return zlib.crc32(f"{seed}/{turn}/{source!r}".encode()) << 20 | turn


def source_targets(rows: DataFrame, weights: list[float], share: float, most: float, source: str = "source") -> DataFrame:
    """source, place, source_size, target for rows(source, size).

    Sources stand in code-point order, null last; weights are dealt to them in turn. They share `share` times all
    sizes; none gets over `most` times its own size, and what is over goes to the others by weight. Solved at
    once: sorted by cap / weight, the level is the first at which no later source is capped. The windows have one
    row a source.
    """
    t = rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").cast("long").alias("source_size"))
    t = t.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    t = t.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    t = t.withColumns({"at": F.row_number().over(by), "before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    t = t.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    t = t.withColumn("first", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(Window.partitionBy()))
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("first.level")))
    return t.select("source", "place", "source_size", target.alias("target"))


def mix(rows: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(spans, targets) for rows(row unique and orderable, source, size long; other columns are ignored).

    spans: shard, slot, place (of the source), turn (pass over the source), block, row, start, words: a run of
    `words` words of a row from its word `start` (0-based). Each source's words sum to the floor of its target;
    whole passes take every word once, the last takes blocks in permuted order and ends within one, so no row is
    taken more often than `most` rounded up, and no word more often than ceil(target / size). Rows of size 0 have
    no span; an empty table gives none. Reruns agree, however the
    rows lie in files and partitions: order within a source comes from a hash of `row` alone.

    Source streams are laid out by hash buckets (about 4,096 rows each) whose totals are summed by a window of a
    row a bucket, so one source with most rows is spread over all tasks; blocks and slots meet on (source, block).
    """
    rows = rows.select("row", "source", F.col("size").cast("long").alias("size"))
    n_rows = rows.count()
    targets = cut(source_targets(rows, weights, share, most), "targets")
    buckets = max(1, -(-n_rows // 4096))
    placed = rows.join(targets.select(F.col("source").alias("s"), "place"), F.col("source").eqNullSafe(F.col("s"))).filter("size > 0").select("row", "place", "size", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    totals = placed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("place", "bucket", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("place", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["place", "bucket"])
    placed = placed.select("row", "place", "size", (F.col("offset") + F.col("before")).alias("begin"))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))))
    blocks = blocks.withColumns({"in_block": F.greatest(F.lit(0), F.col("begin") - F.col("block") * block_words), "start": F.greatest(F.lit(0), F.col("block") * block_words - F.col("begin"))})
    blocks = blocks.withColumn("words", F.least(F.col("size") - F.col("start"), F.lit(block_words) - F.col("in_block"))).select("place", "block", "row", "in_block", "start", "words")
    slots = draw_slots(targets, block_words, shard_blocks, seed)
    # slots come from a table of a row a source, so their size is underrated: without the hint they would be broadcast
    spans = slots.hint("merge").join(blocks, ["place", "block"]).withColumn("words", F.least("words", F.col("take") - F.col("in_block"))).filter("words > 0")
    return spans.select("shard", "slot", "place", "turn", "block", "row", "start", "words"), targets


def draw_slots(targets: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """shard, slot, place, turn, block, take (words from the block's start) for every slot of every source."""
    t = targets.filter("source_size > 0").withColumns({"want": F.floor("target"), "n": F.ceil(F.col("source_size") / block_words)})
    t = t.withColumns({"turns": F.floor(F.col("want") / F.col("source_size")), "rest": F.col("want") % F.col("source_size")})
    # the last pass may meet the short block, so it gets one slot more than the words alone need
    t = t.withColumn("slots", F.col("turns") * F.col("n") + F.when(F.col("rest") > 0, F.least(F.col("n"), F.ceil(F.col("rest") / block_words) + 1)).otherwise(0))
    total = t.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                left, first = int(r.slots), 0
                rng = np.random.default_rng([seed, int(r.place)])
                for at in range(0, shards, 1 << 16):  # a run of shards at a time: their share of what is left, then the split inside
                    some = min(1 << 16, shards - at)
                    here = rng.binomial(left, some / (shards - at))
                    count = rng.multinomial(here, np.full(some, 1 / some))
                    left -= here
                    begins = first + np.cumsum(count) - count
                    first += here
                    k = np.flatnonzero(count)
                    yield pd.DataFrame({"place": r.place, "shard": at + k, "first": begins[k], "count": count[k], "key": _key(seed, r.source, 0), "n": r.n, "source_size": r.source_size, "rest": r.rest, "turns": r.turns})

    drawn = t.mapInPandas(draw, "place int, shard long, first long, count long, key long, n long, source_size long, rest long, turns long")
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = drawn.repartition(n, "place", "shard")
    rows = drawn.select("place", "shard", "key", "n", "source_size", "rest", "turns", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n, key = p["n"].to_numpy(), p["key"].to_numpy()
            turn = p["slot"].to_numpy() // n
            j, key = p["slot"].to_numpy() % n, key + turn
            short = n * block_words - p["source_size"].to_numpy()  # words that the last block lacks
            block = permute(j, n, key)
            size = np.where(block == n - 1, block_words - short, block_words)
            before = j * block_words - np.where(permute(n - 1, n, key, inverse=True) < j, short, 0)
            take = np.where(turn < p["turns"].to_numpy(), size, np.clip(p["rest"].to_numpy() - before, 0, size))
            yield pd.DataFrame({"shard": p["shard"], "slot": p["slot"], "place": p["place"], "turn": turn, "block": block, "take": take})

    return rows.mapInPandas(fill, "shard long, slot long, place int, turn long, block long, take long").filter("take > 0")


def words_at(text: pa.Array, start: pa.Array, words: pa.Array) -> pa.Array:
    """The parts of texts that span `words` words from word `start` on, joined by blanks; touching parts are one."""
    out = []
    for t, starts, counts in zip(text.to_pylist(), start.to_pylist(), words.to_pylist(), strict=True):
        if t is None:
            out.append(None)
            continue
        at = [m.span() for m in WORDS.finditer(t)]
        runs: list[list[int]] = []
        for a, n in zip(starts, counts, strict=True):
            if runs and runs[-1][1] == a:
                runs[-1][1] = a + n
            else:
                runs.append([a, a + n])
        out.append(" ".join(t[at[a][0] : at[b - 1][1]] for a, b in runs))
    return pa.array(out, pa.string())


def named_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, source, size, doc (all columns) of docs: a row is named by hash, key, hash of its text and its number among
    rows that are equal in these, so its name doesn't depend on where it lies."""
    th = F.xxhash64(F.col(text))
    out = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), th, F.col("source")).alias("h"), F.col(key).alias("key"), th.alias("th"))
    n = F.row_number().over(Window.partitionBy("h", "key", "th", "source").orderBy(F.lit(0)))
    return out.withColumn("n", n).select(F.struct("h", "key", "th", "n").alias("row"), "source", "size", "doc")


def mix_documents(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass, its text cut to the words taken in that pass
    (whole texts stay as they are, with their white space); n_chars follows the text where docs have it.

    Documents whose words are not taken, and those without words (null, empty, white space), go; an empty table gives
    none. All columns stay, whatever their names. Rows stand in no order; the shards of the mix are in spans of mix().
    """
    small_batches(docs.sparkSession)
    rows = cut(named_rows(docs, key, text), "rows")
    spans, _ = mix(rows, weights, share, most, **how)
    taken = spans.groupBy(F.col("row").alias("of"), "turn").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"), F.sum("words").alias("words"))
    out = rows.join(taken, F.col("row") == F.col("of")).select("doc", "spans", F.col(f"doc.{text}").alias("whole"), (F.col("words") != F.col("size")).alias("part"))
    some = F.arrow_udf(words_at, "string")(F.when(F.col("part"), F.col("whole")), F.col("spans.start"), F.col("spans.words"))
    out = out.withColumn("some", some).withColumn("kept", F.when(F.col("part"), F.col("some")).otherwise(F.col("whole")))
    own = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def taken_by_document(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, size, source_size, target and taken (words of the row in the mix, repeats counted) for every row of docs."""
    rows = cut(named_rows(docs.select(key, "source", text), key, text).drop("doc"), "sizes")
    spans, targets = mix(rows, weights, share, most, **how)
    taken = spans.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"))
    out = rows.join(taken, F.col("row") == F.col("r"), "left").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("row.key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
