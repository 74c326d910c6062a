"""Exact removal of repeated byte strings (suffix-array deduplication) over whole texts.

Every 100-byte string is filed under its anchor, the least of the 32-byte grams inside it by hash, so that equal
strings are filed alike wherever they stand; neighbouring strings mostly share an anchor and travel as one run
(the bytes of all its strings together, 134 on average). The runs of an anchor that occurs once can repeat
nothing and stay where they are. The others meet in collections of whole anchors, equal runs as one, and the
suffixes of a collection are sorted by column-wise multi-document construction: each round puts one more symbol
in front of every run's suffix, whose place among all suffixes follows from its rank in the Burrows-Wheeler
transform, and extends the transform and the common prefixes of neighbouring suffixes. All but the earliest in
the corpus of suffixes with 100 bytes of common prefix are marked.

The named construction runs over collections that fit into memory (COLLECTION runs) rather than over the corpus
as one: its rounds are as many as the longest document has bytes, each over the whole transform.

An anchor with HEAVY runs and more is a common passage's. Its runs are cut into pieces of at most 8 starts, by their
distance to the anchor, and filed under the bytes that all strings of such a piece have in common (93 of 100): equal
strings again lie in pieces that are filed alike, copies of a piece combine before they move, and what is left of
a passage is spread over as many places as it has different surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.bits import bloom, maybe_in
from cuesmith.llm.memory import tidy
from cuesmith.llm.scratch import Tables, small_batches
from cuesmith.llm.shingles import spread, texts_of
from cuesmith.llm.textbatches import by_bytes

GRAM = 32
#: Bytes of text that a map task holds at a time (or one text), starts of a stretch, runs of a collection.
CHUNK, STRETCH, COLLECTION = 24 << 20, 1 << 16, 500
#: Anchors with so many runs are filed in pieces of PIECE starts.
HEAVY, PIECE = 4096, 8
FILTER_BITS = (22, 28)
TABLE = spread(np.arange(1, 257, dtype=np.uint64))
UNIT = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("at", "<i4"), ("more", "<u2"), ("size", "<u2")])
MARK = np.dtype([("doc", "<i8"), ("th", "<i8"), ("a", "<i4"), ("z", "<i4")])


def anchored(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the strings of `length` bytes in texts that lie one after the other in b (ends: behind each text): anchor
    hash, place of the anchor, first and last start."""
    parts = []
    short = np.zeros(len(b) + 1, np.int32)  # +1 where starts begin to lack bytes of their text, -1 behind
    begins = np.append(0, ends[:-1])
    np.add.at(short, np.maximum(begins, ends - length + 1), 1)
    np.add.at(short, ends, -1)
    lacks = np.cumsum(short[:-1], dtype=np.int32) > 0
    for s in range(0, len(b) - length + 1, STRETCH):
        ok = ~lacks[s : min(s + STRETCH, len(b) - length + 1)]
        if not ok.any():
            continue
        g, m = TABLE[b[s : s + STRETCH + length - 1]], 0x9E3779B97F4A7C15
        for i in range(5):  # grams of 2, 4 .. 32 bytes
            g, m = g[: -(1 << i)] * np.uint64(m) + g[1 << i :], m * m & (1 << 64) - 1
        h = spread(g)
        x, span, width = (h >> np.uint64(17) << np.uint64(17)) | np.arange(len(h), dtype=np.uint64), 1, length - GRAM + 1
        while span * 2 <= width:
            x, span = np.minimum(x[:-span], x[span:]), span * 2
        if width > span:
            x = np.minimum(x[: span - width], x[width - span :])
        at = (x & np.uint64((1 << 17) - 1)).astype(np.int64)
        at[~ok] = -1
        turns = np.flatnonzero(np.diff(at, prepend=-2))
        last = np.append(turns[1:], len(at)) - 1
        real = at[turns] >= 0
        lo, hi = turns[real], last[real]
        parts.append((h[at[lo]], at[lo] + s, lo + s, hi + s))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


class _Texts:
    """Texts of a run of rows that hold a string: the first of each text (docs, th, begin, end in b) and the others
    (copies), of rows (doc, th, text)."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        b, at = texts_of(batch.column(2))
        size = np.diff(at)
        doc, th = (batch.column(i).to_numpy() for i in (0, 1))
        rows = np.flatnonzero(size >= length)
        order = rows[np.lexsort((doc[rows], th[rows]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = th[order[1:]] != th[order[:-1]]
        first, rest = order[fresh], order[~fresh]
        again = np.r_[False, (doc[order[1:]] == doc[order[:-1]]) & ~fresh[1:]]  # rows that are equal whole
        self.copies = np.zeros(len(rest), MARK)
        self.copies["doc"], self.copies["th"], self.copies["z"] = doc[rest], th[rest], size[rest] - length
        self.copies = self.copies[~again[~fresh]]
        times = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        by = np.argsort(first)
        first = first[by]
        self.doc, self.th, self.times = doc[first], th[first], times[by]
        self.b = np.concatenate([b[at[i] : at[i + 1]] for i in first.tolist()]) if len(first) else np.zeros(0, np.uint8)
        self.end = np.cumsum(size[first])


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[_Texts]:
    for batch in batches:
        for a, z in by_bytes(batch.column(2), CHUNK):
            texts = _Texts(batch.slice(a, z - a), length)
            if len(texts.doc):
                yield texts


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys)."""
    own = (spread(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
    for i, (a, z) in enumerate(zip(ends[:-1], ends[1:])):
        if z > a:
            yield i, order[a:z]


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """h, n: anchors of more than one run, and how many. The runs of a text count as often as the text occurs."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, length):
            h, at, _, _ = anchored(t.b, t.end, length)
            times = t.times[np.searchsorted(t.end, at, "right")]
            order = np.argsort(h)
            h, times = h[order], times[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            h, k = h[first], np.add.reduceat(times, first) if len(first) else times
            rows = []
            for i, mine in _dealt(h, buckets):
                many = mine[k[mine] > 1]
                rows.append((i, h[mine[k[mine] == 1]].tobytes(), h[many].tobytes(), k[many].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["bucket", "once", "many", "times"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            once, many, times = (b"".join(batch.column(i).to_pylist()) for i in (1, 2, 3))
            hs += [np.frombuffer(once, "<u8"), np.frombuffer(many, "<u8")]
            ks += [np.ones(len(once) // 8, np.int64), np.frombuffer(times, "<i8")]
        h, k = np.concatenate(hs), np.concatenate(ks)
        order = np.argsort(h)
        h, k = h[order], k[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        h, k = h[first], np.add.reduceat(k, first) if len(first) else k
        yield pa.RecordBatch.from_arrays([pa.array(h[k > 1].view(np.int64)), pa.array(k[k > 1])], ["h", "n"])

    return texts.mapInArrow(tidy(count), "bucket int, once binary, many binary, times binary").repartition(n, "bucket").mapInArrow(tidy(total), "h long, n long")


def suffix_order(x: np.ndarray, sizes: np.ndarray, most: int = 254) -> tuple[np.ndarray, np.ndarray]:
    """(places, common) of all suffixes of the rows of x (right-aligned, sizes bytes each, longest first, no byte over
    254). places[i, j] is where row i's suffix of j bytes stands in the common order, common[p] how many bytes the
    suffix at p shares with the one before it (`most` at most). Built column by column from the last."""
    m, width = x.shape
    rows = np.arange(m)
    transform = np.zeros(m, np.uint8)  # one more than the symbol in front of each suffix in order; 0 where none is put yet
    common = np.zeros(m + 1, np.uint8)  # and one more behind the last
    place = rows.copy()  # where the rows' longest suffixes stand

    def ranked() -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(transform, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return order, rank

    for j in range(width):
        more = rows[: np.searchsorted(-sizes, -j)]
        if not len(more):
            break
        here = place[more]
        transform[here] = x[more, width - 1 - j] + 1
        order, rank = ranked()
        none = len(transform) - np.count_nonzero(transform)
        at = rank[here]
        # neighbours that begin with the same symbol: what they share is the least of what lies between, and the symbol
        before, after = order[at - 1], order[np.minimum(at + 1, len(order) - 1)]
        symbol = transform[here]
        left, right = (at > 0) & (transform[before] == symbol), (at + 1 < len(order)) & (transform[after] == symbol)
        lo, hi = np.concatenate([before[left], here[right]]) + 1, np.concatenate([here[left], after[right]]) + 1
        by = np.argsort(-lo)
        pairs = np.stack([lo[by], hi[by]], axis=1).ravel()
        least = np.minimum.reduceat(common, pairs)[::2] if len(pairs) else np.zeros(0, np.uint8)
        shared = np.empty(len(lo), np.uint8)
        shared[by] = np.minimum(least, most - 1) + 1
        new = at - none + m  # m empty suffixes come first
        old = np.ones(len(transform) + len(more), bool)
        old[new] = False
        kept = np.flatnonzero(old)
        grown, wider = np.zeros(len(old), np.uint8), np.zeros(len(old) + 1, np.uint8)
        grown[kept] = transform
        wider[kept] = common[:-1]
        wider[new[left]] = shared[: left.sum()]
        wider[new[right] + 1] = shared[left.sum() :]
        still = rows[len(more) :]  # rows that have ended keep their order among the old
        if len(still):
            place[still] = kept[place[still]]
        place[more] = new
        transform, common = grown, wider
    _, rank = ranked()
    rank += m - (len(transform) - np.count_nonzero(transform))
    out = np.zeros((m, width + 1), np.int64)
    out[:, 0] = rows
    for j in range(1, width + 1):
        more = rows[: np.searchsorted(-sizes, -j, side="right")]
        out[more, j] = rank[out[more, j - 1]]
    return out, common[:-1]


def later_strings(units: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """Marks of the strings in a collection of runs that another run of it has earlier."""
    by = np.argsort(-units["size"].astype(np.int64), kind="stable")
    sizes = units["size"][by].astype(np.int64)
    x = np.zeros((len(by), sizes[0]), np.uint8)
    for row, i in enumerate(by.tolist()):
        x[row, sizes[0] - sizes[row] :] = np.frombuffer(texts[i], np.uint8)
    place, common = suffix_order(x, sizes, length)
    n = sizes - length + 1
    row = np.repeat(np.arange(len(by)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = place[row, sizes[row] - off]
    full = common >= length
    some = np.flatnonzero(full[at] | np.append(full[1:], False)[at])
    group, row, off = np.cumsum(~full)[at[some]], row[some], off[some]
    # runs in corpus order; those of one text share no start, so their strings stand in the order of (run, offset)
    rank = np.empty(len(by), np.int64)
    rank[np.lexsort((units["at"], units["th"], units["doc"]))] = np.arange(len(by))
    unit = by[row]
    order = np.lexsort((rank[unit] << 16 | off, group))
    late = order[1:][group[order[1:]] == group[order[:-1]]]
    unit, start = unit[late], units["at"][unit[late]].astype(np.int64) + off[late]
    return _joined(units["doc"][unit], units["th"][unit], start)


def _joined(doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Single starts as marks, neighbours as one."""
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    first = np.ones(len(start), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.flatnonzero(first)
    out = np.zeros(len(begin), MARK)
    out["doc"], out["th"], out["a"] = doc[begin], th[begin], start[begin]
    out["z"] = start[np.append(begin[1:], len(start)) - 1] if len(start) else 0
    return out


def _combined(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first unit of each (h, c), and marks of all starts of the others."""
    order = np.lexsort((units["at"], units["th"], units["doc"], units["c"], units["h"]))
    u = units[order]
    first = np.ones(len(u), bool)
    first[1:] = (u["h"][1:] != u["h"][:-1]) | (u["c"][1:] != u["c"][:-1])
    late = u[~first]
    marks = np.zeros(len(late), MARK)
    marks["doc"], marks["th"], marks["a"], marks["z"] = late["doc"], late["th"], late["at"], late["at"] + late["more"].astype(np.int32)
    return order[first], marks


def _mark_rows(marks: list[np.ndarray]) -> pa.RecordBatch:
    """Marks by document: doc, th and pairs of first and last start."""
    m = np.concatenate([np.zeros(0, MARK), *marks])
    m = m[np.lexsort((m["th"], m["doc"]))]
    begin = np.flatnonzero(np.append(True, (m["doc"][1:] != m["doc"][:-1]) | (m["th"][1:] != m["th"][:-1]))) if len(m) else np.zeros(0, np.int64)
    pairs = np.stack([m["a"], m["z"]], axis=1).astype("<i4")
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.append(begin, len(m)) * 8).astype(np.int32)), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), -1, np.int32)), pa.array(m["doc"][begin]), pa.array(m["th"][begin]), data], ["bucket", "doc", "th", "data"])


ROWS = "bucket int, doc long, th long, data binary"


def _pieces(h: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of hot anchors as pieces (h, first and last start): starts 8k .. 8k + 7 before the anchor, filed under the
    bytes that strings from all of them hold."""
    low, high = (anchor - hi) // PIECE, (anchor - lo) // PIECE
    n = high - low + 1
    run = np.repeat(np.arange(len(h)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + low[run]
    top = anchor[run] - k * PIECE
    first, last = np.maximum(lo[run], top - PIECE + 1), np.minimum(hi[run], top)
    data = memoryview(b)
    core = np.array([xxhash.xxh3_64_intdigest(data[t : t + length - PIECE + 1]) for t in top.tolist()], np.uint64)
    return core ^ spread(k.astype(np.uint64) + np.uint64(1)), first, last


def marked_starts(texts: DataFrame, length: int, tables: Tables) -> DataFrame:
    """doc, th, data: runs of starts (first, last: little-endian int32) of strings that also start earlier.

    texts has doc (long, the order of documents), th (hash of the text) and text. A string is later if another
    equal one stands in a smaller (doc, th), or before it in the same text.
    """
    spark = texts.sparkSession
    anchors = tables.cut(repeated_anchors(texts, length), "anchors")
    heavy = anchors.filter(F.col("n") >= HEAVY)
    sized = lambda n: int(np.clip(np.ceil(np.log2(max(1, n) * 16)), *FILTER_BITS))
    n_all, n_heavy = anchors.agg(F.count("*"), F.count_if(F.col("n") >= HEAVY)).first()
    wanted = spark.sparkContext.broadcast((bloom(anchors.select("h"), sized(n_all)), bloom(heavy.select("h"), sized(n_heavy))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * n

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, hot = wanted.value
        for t in _chunks(batches, length):
            h, at, lo, hi = anchored(t.b, t.end, length)
            keep = np.flatnonzero(maybe_in(some, h))
            often = maybe_in(hot, h[keep])
            apart, keep = keep[often], keep[~often]
            pieces = _pieces(h[apart], at[apart], lo[apart], hi[apart], t.b, length)
            h, lo, hi = (np.concatenate([x[keep], y]) for x, y in zip((h, lo, hi), pieces, strict=True))
            of = np.searchsorted(t.end, lo, "right")
            u = np.zeros(len(h), UNIT)
            u["h"], u["doc"], u["th"], u["more"], u["size"] = h, t.doc[of], t.th[of], hi - lo, hi - lo + length
            u["at"] = lo - np.append(0, t.end)[of]
            data = memoryview(t.b)
            u["c"] = [xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
            first, marks = _combined(u)
            u, lo, hi = u[first], lo[first], hi[first] + length
            rows = []
            for i, mine in _dealt(u["h"], buckets):
                rows.append((i, np.int64(len(mine)).tobytes() + u[mine].tobytes() + b"".join([data[a:z] for a, z in zip(lo[mine].tolist(), hi[mine].tolist(), strict=True)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "doc", "th", "data"])
            yield _mark_rows([marks, t.copies])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            of = batch.column(0).to_numpy()
            passed = batch.filter(pa.array(of < 0))
            if passed.num_rows:
                yield passed
            for i in np.flatnonzero(of >= 0).tolist():
                if of[i] != bucket and held:
                    yield _sorted_bucket(held, length)
                    held = []
                bucket = of[i]
                held.append(batch.column(3)[i].as_py())
        if held:
            yield _sorted_bucket(held, length)

    filed = texts.mapInArrow(tidy(file), ROWS).withColumn("place", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("doc")))
    return filed.repartition(n, "place").select("bucket", "doc", "th", "data").sortWithinPartitions("bucket").mapInArrow(tidy(sort), ROWS).select("doc", "th", "data")


def _sorted_bucket(blobs: list[bytes], length: int) -> pa.RecordBatch:
    """Marks of the later strings among the units of a bucket."""
    parts, texts = [], []
    for blob in blobs:
        m = int(np.frombuffer(blob, "<i8", 1)[0])
        u = np.frombuffer(blob, UNIT, m, 8)
        ends = 8 + m * UNIT.itemsize + np.cumsum(u["size"].astype(np.int64))
        texts += [blob[z - n : z] for z, n in zip(ends.tolist(), u["size"].tolist(), strict=True)]
        parts.append(u)
    units = np.concatenate(parts)
    first, marks = _combined(units)
    out = [marks]
    units = units[first]
    begins = np.flatnonzero(np.append(True, units["h"][1:] != units["h"][:-1]))
    size = np.diff(np.append(begins, len(units)))
    alone = np.repeat(size == 1, size)
    units, which = units[~alone], first[~alone].tolist()
    ends = np.cumsum(size[size > 1]).tolist()  # of whole anchors
    a = 0
    for k, z in enumerate(ends):
        if z - a >= COLLECTION or k == len(ends) - 1:
            out.append(later_strings(units[a:z], [texts[i] for i in which[a:z]], length))
            a = z
    return _mark_rows(out)


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", rebuild: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (and kept_text with rebuild: what is left,
    undecodable bytes at cuts replaced).

    A byte goes if a string of `length` bytes over it also starts earlier: in a smaller key, or earlier in the same
    text; strings are judged on the input. Null texts are empty. Rows equal in key and text are one document and
    are treated alike; of different texts under one key the one with the smaller hash is first; a null key comes
    last. Keys are integers (a text that is none raises). An empty table gives an empty table. length is 32 to 255:
    anchors are grams of 32 bytes, common prefixes are held in bytes.
    """
    if not 32 <= length <= 255:
        raise ValueError("length must be 32 to 255")
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    marks = marked_starts(plain.select("doc", "th", "text"), length, Tables(docs.sparkSession)).groupBy(F.col("doc").alias("of_doc"), F.col("th").alias("of_th")).agg(F.collect_list("data").alias("runs"))
    both = plain.join(marks, (F.col("doc") == F.col("of_doc")) & (F.col("th") == F.col("of_th")), "left").select("id", "text", "runs")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            rows, left = [], []
            for a, z, runs in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                b = data[a:z]
                removed = spans = 0
                if runs:
                    r = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2)
                    depth = np.zeros(len(b) + 1, np.int64)
                    np.add.at(depth, r[:, 0], 1)
                    np.add.at(depth, r[:, 1] + length, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed, spans = int(np.count_nonzero(gone)), int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[0])
                    b = b[~gone]
                rows.append((z - a, removed, spans, hashlib.sha256(b).hexdigest()))
                left.append(b.tobytes().decode("utf-8", "replace") if rebuild else "")
            cols = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + rebuild], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + rebuild])

    kind = dict(docs.dtypes)[key]
    return both.mapInArrow(tidy(apply), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * rebuild).withColumnRenamed("id", key)
