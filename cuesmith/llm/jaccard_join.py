"""Exact Jaccard self-join of word-shingle sets by a token-group matrix, as connected components.

1. Documents of equal sets are one class; only a class's first row goes on.
2. Similar classes are partitioned into groups: classes that agree on a pair of minhashes are compared with
   the least class of that pair, those that share an index token with one class that has it, and verified links
   are contracted.
3. The token-group matrix holds, for each token, the groups whose union of index tokens has it. A query (a
   class) meets the groups by its own index tokens; the overlap with a group's union bounds the overlap with
   every member, and only groups that reach the bound are opened and their members verified.

Index tokens of a set are its first n - ceil(t n) + l tokens in one order for all sets, frequent tokens last;
two sets of similarity t and more have l of them in common, whatever the order, so nothing is lost. Pairs
inside a group are not looked at again: they cannot change the components.

Bounds. Let x and y share index tokens; all common tokens before one of these are shared index tokens too. So at
each of their first l common tokens, the overlap is at most what stands from there on in either set and the shared
tokens before it, l - 1 at most (`reach`). A set whose reach at a token is under ceil(t n) links through it with
nobody: the row goes before any join. So a near copy with too many words of its own meets nobody, however large
the group around it is.

The matrix also holds a box of parities for each token and group: the parities of a set's tokens in BOX buckets, as far
as all members with the token agree on them. Buckets in which a query differs from the box are tokens that it does not
share with any of these members, so sets of a large cluster that are below the threshold are parted before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.bits import maybe_in, shared_bloom
from cuesmith.llm.components import components
from cuesmith.llm.memory import tidy
from cuesmith.llm.scratch import Tables, small_batches
from cuesmith.llm.shingles import shingle_sets, spread

#: Common index tokens that a link must have (fewer for sets that small).
LEAST_COMMON = 3
BANDS = 4
SEEDS = spread(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Longs of the parities in the token-group matrix: 64 buckets each, a power of two of them.
BOX = 16
#: Bits of the approximate sets that executors get: a fixed size, whatever they hold.
FILTER_BITS = 25
#: A token is frequent from 16 sets or one in so many on; at most this many times the mean set size can be.
FREQUENT_SHARE = 20_000


def needed(n, percent: int):
    """Least intersection of a set of n with any set that it links with (n: numbers or a column)."""
    return -(-percent * n // 100) if not isinstance(n, Column) else F.ceil(n * percent / 100)


def frequent_tokens(texts: DataFrame, k: int, n_docs: int) -> Broadcast:
    """An approximate set of the tokens that many sets hold. Tasks count their own sets' tokens and pass on
    those they met at least 4 times; which tokens are marked affects speed only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(t[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

        for batch in batches:
            for _, tokens, _ in shingle_sets(batch.column(0), k):
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
            held.clear()

    many = texts.mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(16, n_docs // FREQUENT_SHARE))
    return shared_bloom(many.select("token"), FILTER_BITS)


def _digests(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs a set."""
    ends = np.cumsum(sizes).tolist()
    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(tokens[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)), "<i8").reshape(-1, 2)
    return d[:, 0], d[:, 1]


def _index(tokens: np.ndarray, sizes: np.ndarray, take: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first `take` tokens of each set, the rare ones before the frequent ones, each in the order of hashes."""
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.append(0, np.cumsum(~often))
    before = rare[:-1] - rare[ends - sizes][of]  # rare tokens of the set before each token
    place = np.where(often, (rare[ends] - rare[ends - sizes])[of] + np.arange(len(tokens)) - (ends - sizes)[of] - before, before)
    keep = np.flatnonzero(place < take[of])
    out = np.empty(int(take.sum()), np.int64)
    out[(np.cumsum(take) - take)[of[keep]] + place[keep]] = tokens[keep].view(np.int64)
    return out


def _sketches(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each set the parities of its tokens in 2n .. 4n buckets (a power of two, 64 at least), as bits."""
    out = []
    ends = np.cumsum(sizes).tolist()
    for a, z in zip([0, *ends[:-1]], ends, strict=True):
        bits = max(6, int(2 * (z - a) - 1).bit_length())
        odd = np.bincount((tokens[a:z] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return pa.array(out, pa.binary())


def _boxes(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each set the parities of its tokens in 64 * BOX buckets, as a list of BOX longs."""
    buckets = 64 * BOX
    of = np.repeat(np.arange(len(sizes)) * buckets, sizes)
    odd = np.bincount(of + (tokens >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=len(sizes) * buckets) & 1
    longs = np.packbits(odd.astype(bool)).view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BOX), pa.array(longs))


def differences(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens at least that are in one of two sets only, from their sketches (arrays of bytes): buckets whose parities
    differ, of the coarser sketch (neighbouring buckets of the finer one fall together there)."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):  # fold pairs of neighbouring bits
        bits = np.unpackbits(y)
        y = np.packbits(bits[::2] ^ bits[1::2])
    return int(np.bitwise_count(x ^ y).sum())


def features(texts: DataFrame, k: int, percent: int, frequent: Broadcast) -> DataFrame:
    """texts(doc_id, text) as row, doc_id, n, s1, s2 (hash of the set), bands, least, tokens (index tokens), sketch, box."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tokens, n in shingle_sets(batch.column(1), k):
                some = n > 0
                begin = (np.cumsum(n) - n)[some]
                low = [np.minimum.reduceat(tokens * x, begin) if len(begin) else np.zeros(0, np.uint64) for x in SEEDS]
                bands = np.stack([spread(low[2 * i] * np.uint64(3) + spread(low[2 * i + 1] + np.uint64(i))) for i in range(BANDS)], axis=1)
                common = np.minimum(LEAST_COMMON, needed(n, percent))
                take = n - needed(n, percent) + common
                index = _index(tokens, n, take, maybe_in(frequent.value, tokens))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat)) for size, flat in ((BANDS * some, bands.ravel().view(np.int64)), (take, index))]
                s1, s2 = _digests(tokens, n)
                cols = [batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), lists[0], pa.array(common.astype(np.int32)), lists[1], _sketches(tokens, n), _boxes(tokens, n)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "bands", "least", "tokens", "sketch", "box"])

    out = texts.mapInArrow(tidy(of), f"doc_id {dict(texts.dtypes)['doc_id']}, n int, s1 long, s2 long, bands array<long>, least int, tokens array<long>, sketch binary, box array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


class _Join:
    """One run of the join: its texts, parameters and written tables."""

    def __init__(self, texts: DataFrame, k: int, percent: int):
        self.texts, self.k, self.percent = texts, k, percent
        self.tables = Tables(texts.sparkSession, brief=True)
        self.classes = None

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs(a, b: classes) those whose sets link. Sketches part most that don't; the sets of the others are made
        anew from the texts of the classes' first rows and meet by their hashes."""
        k, percent, t = self.k, self.percent, self.tables
        of = lambda side: self.classes.select(*(F.col(c).alias(f"{side}_{c}") for c in ("rep", "n", "sketch", "s1", "s2")), F.xxhash64("rep_doc").alias(f"{side}_doc"))
        both = pairs.select("a", "b").distinct().join(of("a"), F.col("a") == F.col("a_rep")).join(of("b"), F.col("b") == F.col("b_rep"))
        keys = ["a", "b", "a_s1", "a_s2", "a_doc", "b_s1", "b_s2", "b_doc"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = (100 - percent) * (batch.column(8).to_numpy().astype(np.int64) + batch.column(9).to_numpy())
                least = [differences(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column(10), batch.column(11), strict=True)]
                yield batch.select(range(8)).filter(pa.array((100 + percent) * np.array(least, np.int64) <= most))

        near_pairs = t.cut(both.select(*keys, "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(tidy(near), ", ".join(f"{c} long" for c in keys)), "near")
        shared = shared_bloom(near_pairs.select(F.explode(F.array("a_doc", "b_doc"))), FILTER_BITS)

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()  # a task gives an equal set once
            for batch in batches:
                batch = batch.filter(pa.array(maybe_in(shared.value, batch.column(0).to_numpy().view(np.uint64))))
                for _, tokens, n in shingle_sets(batch.column(1), k):
                    s1, s2 = _digests(tokens, n)
                    items = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, 8 * np.cumsum(n)).astype(np.int32)), pa.py_buffer(tokens)])
                    fresh = [not (x in seen or seen.add(x)) for x in zip(s1.tolist(), s2.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), items], ["s1", "s2", "items"]).filter(pa.array(fresh, pa.bool_()))

        sets = self.texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(tidy(sets_of), "s1 long, s2 long, items binary")
        x, y = (sets.select(F.col("s1").alias(f"{side}_s1"), F.col("s2").alias(f"{side}_s2"), F.col("items").alias(f"{side}_items")) for side in "ab")
        meet = near_pairs.select("a", "b", "a_s1", "a_s2", "b_s1", "b_s2").join(x, ["a_s1", "a_s2"]).join(y, ["b_s1", "b_s2"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        links = t.cut(meet.select("a", "b", "a_items", "b_items").mapInArrow(tidy(compare), "a long, b long"), name)
        shared.destroy()
        t.drop(near_pairs)
        return links

    def sizes_fit(self, n: Column, low: Column, high: Column) -> Column:
        return (100 * high >= self.percent * n) & (100 * n >= self.percent * low)

    def parted(self, differ: list[Column], n_x: Column, n_y: Column) -> Column:
        """Whether sets of n_x and n_y are below the threshold by the buckets in which they differ (bits of longs)."""
        least = sum((F.bit_count(x) for x in differ[1:]), F.bit_count(differ[0]))
        return (100 + self.percent) * least > (100 - self.percent) * (n_x + n_y)

    def reaches(self, reach: Column, n_x: Column, n_y: Column) -> Column:
        """Whether sets of n_x and n_y link with an overlap of reach."""
        return (100 + self.percent) * reach >= self.percent * (n_x + n_y)

    def grouped(self) -> DataFrame:
        """Verified links of classes with the least class of each of their minhash pairs."""
        banded = self.classes.select("rep", "n", F.explode("bands").alias("band"))
        hubs = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("band", F.col("hub.rep").alias("a"), F.col("hub.n").alias("hub_n"))
        pairs = banded.join(hubs, "band").filter((F.col("rep") != F.col("a")) & self.sizes_fit(F.col("n"), F.col("hub_n"), F.col("hub_n")))
        return self.verified(pairs.select("a", F.col("rep").alias("b")), "grouped")

    def indexed(self, rows: DataFrame, name: str, boxes: bool = False) -> DataFrame:
        """rows(rep, n, least, group, alone, token, pos, size) of tokens that more than one group has, as queries: with own
        (tokens of the class's index that no other group has), reach and seen, without the rows that can link with nobody.

        seen holds hashes of threes of the class's tokens before the row's: the first, the second and the last three. Two
        classes with an equal one have three earlier tokens in common, so that token need not bring them together."""
        of = Window.partitionBy("rep")
        by = of.orderBy("pos")
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({"own": F.col("size") - F.count("*").over(of), "before": F.row_number().over(by) - 1})
        rows = rows.withColumn("reach", F.col("n") - F.col("pos") + F.least(F.col("before"), F.lit(LEAST_COMMON - 1)))
        for i, (fewest, three) in enumerate(((3, [F.nth_value("token", j).over(whole) for j in (1, 2, 3)]), (6, [F.nth_value("token", j).over(whole) for j in (4, 5, 6)]), (4, [F.lag("token", j).over(by) for j in (1, 2, 3)]))):
            rows = rows.withColumn(f"seen{i}", F.when(F.col("before") >= fewest, F.xxhash64(*three)))
        rows = rows.drop("before").filter(F.col("reach") >= needed(F.col("n"), self.percent)).withColumn("left", F.count("*").over(of))
        fewest = F.least(F.lit(LEAST_COMMON), needed(needed(F.col("n"), self.percent), self.percent))
        rows = rows.filter(F.col("left") >= fewest).drop("left")
        if boxes:  # b0, b1 ..: the longs of the class's box
            rows = rows.join(self.classes.select("rep", *(F.col("box")[i].alias(f"b{i}") for i in range(BOX))), "rep")
        return self.tables.cut(rows, name)

    def between(self, groups: DataFrame) -> DataFrame:
        """Queries (see indexed) of the classes' index tokens. An approximate set of the tokens of more than one group
        thins the index before it is moved again."""
        rows = self.classes.join(groups, F.col("rep") == F.col("node"), "left").select("rep", "n", "least", F.coalesce("label", "rep").alias("group"), F.col("label").isNull().alias("alone"), "tokens")
        between = rows.select("group", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 <> g1").select("token")
        between = self.tables.cut(between, "between")
        shared = shared_bloom(between, FILTER_BITS)

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(5)
                token, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                at = np.flatnonzero(maybe_in(shared.value, token.view(np.uint64)))
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(5)), pa.array(token[at]), pa.array(pos[at].astype(np.int32)), pa.array(size[row[at]].astype(np.int32))], ["rep", "n", "least", "group", "alone", "token", "pos", "size"])

        queries = rows.mapInArrow(tidy(thinned), "rep long, n int, least int, group long, alone boolean, token long, pos int, size int").join(between, "token", "left_semi")
        out = self.indexed(queries, "queries")
        shared.destroy()
        self.tables.drop(between)
        return out

    def regrouped(self, queries: DataFrame, groups: DataFrame) -> DataFrame:
        """queries with the groups as they are now, without tokens that are inside one group."""
        rows = queries.select("rep", "n", "least", "token", "pos", "size").join(groups, F.col("rep") == F.col("node"), "left")
        rows = rows.withColumns({"group": F.coalesce("label", "rep"), "alone": F.col("label").isNull()}).drop("node", "label")
        between = rows.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 <> g1").select("token")
        return self.indexed(rows.join(between, "token", "left_semi"), "regrouped", boxes=True)

    def starred(self, queries: DataFrame) -> DataFrame:
        """Verified links of classes with one class of another group for each of their tokens: one with the fewest tokens
        of its own, as the original of a group of copies has. Large clusters grow together here."""
        # sets link only within one size class (a factor of 100 / percent) or with the next
        level = F.floor(F.log("n") / F.log(F.lit(100 / self.percent)) + 1e-9).cast("int")
        hubs = queries.groupBy("token", level.alias("level")).agg(F.min(F.struct("own", "n", "rep", "group", "reach", "least")).alias("hub"))
        asked = queries.withColumn("level", F.explode(F.array(level, level - 1)))
        fits = self.sizes_fit(F.col("n"), F.col("hub.n"), F.col("hub.n")) & self.reaches(F.least("reach", "hub.reach"), F.col("n"), F.col("hub.n"))
        both = asked.join(hubs, ["token", "level"]).filter((F.col("group") != F.col("hub.group")) & fits)
        pairs = both.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.least("least", "hub.least").alias("least"))
        return self.verified(possible(pairs), "starred")

    def met(self, queries: DataFrame) -> DataFrame:
        """rep, other, only for the classes that meet a group in the token-group matrix; only is the class that alone holds
        all tokens at which they meet, else null.

        Boxes are wide, so rows are moved once: the matrix is made where the rows of a token lie, and the join reads the
        same exchange. For that both sides take the same columns and filters."""
        q = self.percent
        longs = [f"b{i}" for i in range(BOX)]
        seen = [f"seen{i}" for i in range(3)]
        sure = ["rep", "n", "least", "group", "token", "reach", *longs]  # never null; else one side alone would be filtered
        rows = queries.select(*sure, *seen).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in sure)).repartition("token")
        spare = (100 + q) * F.col("reach") - q * F.col("n")  # q times the largest set that the class can link with
        sole = F.min("rep") == F.max("rep")
        matrix = rows.groupBy("token", F.col("group").alias("other")).agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("most"), F.max(spare).alias("spare"), F.min("least").alias("l"), *(F.when(sole, F.min(c)).alias(f"its{i}") for i, c in enumerate(seen)), *(f(c).alias(f"{name}{i}") for i, c in enumerate(longs) for name, f in (("all", F.bit_and), ("any", F.bit_or))))
        # token-group rows in which a member could still link
        near = (F.col("group") < F.col("other")) & self.sizes_fit(F.col("n"), F.col("low"), F.col("high")) & self.reaches(F.least("reach", "most"), F.col("n"), F.col("low")) & (F.col("spare") >= q * F.col("n")) & self.unseen("its")
        # buckets in which the class differs from all members of the group with the token
        apart = [F.col(f"b{i}").bitwiseXOR(F.col(f"all{i}")).bitwiseAND(F.bitwise_not(F.col(f"all{i}").bitwiseXOR(F.col(f"any{i}")))) for i in range(BOX)]
        near = near & ~self.parted(apart, F.col("n"), F.col("high"))
        meets = rows.join(matrix, "token").filter(near)
        met = meets.groupBy("rep", "other").agg(F.count("*").alias("common"), F.min(F.least("least", "l")).alias("least"), F.min("first").alias("first"), F.max("last").alias("last"))
        return met.filter(F.col("common") >= F.col("least")).select("rep", "other", F.when(F.col("first") == F.col("last"), F.col("first")).alias("only"))

    def opened(self, queries: DataFrame) -> DataFrame:
        """Verified links between classes of different groups, found through the token-group matrix."""
        opened = self.met(queries)
        opened = self.tables.cut(opened, "opened")
        # members of an opened group must share as many index tokens themselves
        held = [F.col(f"seen{i}").alias(f"its{i}") for i in range(3)]
        members = queries.filter("not alone").select(F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("reach").alias("b_reach"), F.col("least").alias("b_least"), F.col("group").alias("other"), "token", *held, *(F.col(f"b{i}").alias(f"its_b{i}") for i in range(BOX)))
        fits = self.sizes_fit(F.col("n"), F.col("b_n"), F.col("b_n")) & self.reaches(F.least("reach", "b_reach"), F.col("n"), F.col("b_n")) & self.unseen("its")
        fits = fits & ~self.parted([F.col(f"b{i}").bitwiseXOR(F.col(f"its_b{i}")) for i in range(BOX)], F.col("n"), F.col("b_n"))
        asks = opened.filter("only IS NULL").select("rep", "other").join(queries.select("rep", "n", "least", "token", "reach", "seen0", "seen1", "seen2", *(f"b{i}" for i in range(BOX))), "rep")
        pairs = asks.join(members, ["other", "token"]).filter(fits).select(F.col("rep").alias("a"), "b", F.least("least", "b_least").alias("least"))
        pairs = possible(pairs).unionByName(opened.filter("only IS NOT NULL").select(F.col("rep").alias("a"), F.col("only").alias("b")))
        links = self.verified(pairs, "opened")
        self.tables.drop(opened)
        return links

    def unseen(self, its: str) -> Column:
        """Whether no three earlier tokens are known to be in common."""
        return ~F.coalesce(*[F.when(F.col(f"seen{i}") == F.col(f"{its}{i}"), F.lit(True)) for i in range(3)], F.lit(False))


def possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), of a row for each common index token, that have enough of them."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("least").alias("least")).filter(F.col("common") >= F.col("least")).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    n_shingles is the size of the row's set of distinct k-word shingles (see shingle_sets); component_id the least
    doc_id reachable by links of 100 * intersection >= percent * union, the row's own included. Null, empty and
    wordless texts have empty sets and link with nothing. Repeated rows are one class. A null doc_id is carried
    and is never the least where another is there; extra columns are ignored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    run = _Join(texts, k, percent)
    t = run.tables
    frequent = frequent_tokens(texts.select("text"), k, texts.count())
    found = t.cut(features(texts, k, percent, frequent), "features")
    frequent.destroy()
    firsts = t.cut(found.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("rep")), "firsts")
    run.classes = t.cut(found.withColumnRenamed("doc_id", "rep_doc").join(firsts.select("rep"), F.col("row") == F.col("rep")).drop("row"), "classes")
    nodes = t.cut(found.select("row", "doc_id", "n", "s1", "s2").join(firsts, ["s1", "s2"], "left").select("row", "doc_id", "n", "rep"), "nodes")
    t.drop(found, firsts)
    links = run.grouped()
    first = run.between(components(links, t))
    links = links.unionByName(run.starred(first))
    second = run.regrouped(first, components(links, t))
    t.drop(first)
    links = links.unionByName(run.opened(second))
    t.drop(second, run.classes)
    ends = components(links, t)
    nodes = nodes.join(ends, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("row")).alias("label"))
    least = nodes.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return nodes.join(least, F.col("label") == F.col("of")).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component of jaccard_components the row of the least key stays.

    Rows that are equal in key and text are one document and leave one row; of different texts under one key in a
    component the one with the smaller hash stays. Rows without words link with nothing and stay, as do all
    columns, whatever their names. Null keys count as the greatest.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th")).alias("doc_id"), F.col(text).alias("text"))
    ends = jaccard_components(held.select("doc_id", "text"), k, percent)
    winners = ends.filter("doc_id = component_id").groupBy(F.col("doc_id.id").alias("i"), F.col("doc_id.th").alias("t")).agg(F.count("*").alias("c"))
    winners = Tables(docs.sparkSession).cut(winners, "winners")
    left = held.join(winners.select("i", "t"), F.col("doc_id.id").eqNullSafe(F.col("i")) & F.col("doc_id.th").eqNullSafe(F.col("t")), "left_semi")
    if winners.filter("c > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id"])
    return left.select("row.*")
