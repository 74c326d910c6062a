"""Phrases of two to four words that come together more often than their parts, by a weighted de Bruijn graph of each language.

Nodes are runs of three words, an edge is a run of four between the two nodes that overlap in it, weighted by its occurrences.
Each word of a text gives one run, from it on: of four words, or of those that are left in its piece (a piece-end correction). The occurrences of a
shorter phrase are the sum of what leaves the nodes that it begins (their flow) and of the corrections that it begins.

1. Words, pairs and triples are counted by 64-bit hashes; those with `least` occurrences go into an approximate set of a fixed size. A
   phrase with `least` occurrences has only such parts, so a run is cut before the first word that makes a part that is not in the
   set, and what is left is one more correction. A full set, or two hashes that are alike, cut less; results stay exact.
2. Runs are summed by language, node and next word, in lists by bucket of the node; flows of nodes, pairs and words follow from each other.
3. Edges of `least` occurrences are a small graph. Paths through nodes with one edge in and one out are compacted: in each of
   ROUNDS rounds, two paths join at a node whose hash is below those of the paths' other ends. A path has 2**ROUNDS edges at most, so no row
   grows with the corpus. Phrases of four words are the windows of the paths.
4. Scores by joins of the cuts of a phrase with the phrases that are its parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.bits import maybe_in, shared_bloom
from cuesmith.llm.language_model import gram_counts, packed, packed_counts
from cuesmith.llm.memory import tidy
from cuesmith.llm.scratch import Tables, small_batches
from cuesmith.llm.shingles import spread

ROUNDS = 6
#: Bits of the set of frequent words, pairs and triples: 4 MB.
FILTER_BITS = 25
#: Bytes of text that are counted at once.
UNIT = 16 << 20
#: ASCII capitals lowered, marks that end a piece as a point, tabs as blanks.
PLAIN = bytes(ord(".") if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256)).lower()


#: Tasks that add up hashes, times the session's shuffle partitions: a task holds all its distinct ones.
FINER = 4


class Unit:
    """Words of texts of one language, one behind the other with a mark between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        words = b" . ".join([*texts, b""]).split()
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.lang, self.words, ids = lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        spoken = self.words.to_pylist()
        seed = zlib.crc32(lang.encode())
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in spoken], np.uint64)
        mark = spoken.index(b".") if b"." in spoken else -1
        self.ids, self.real = ids, ids != mark
        self.pair = self.real & np.append(self.real[1:], False)
        h, self.own = own[ids], own
        self.word_keys = spread(own)
        self.pair_keys = spread(self.word_keys[ids] * np.uint64(3) + np.append(h[1:], h[:1]))
        self.triple_keys = spread(self.pair_keys * np.uint64(5) + np.append(h[2:], h[:2])[: len(h)])
        self.triple = self.pair & np.append(self.pair[1:], False)

    def keys(self) -> np.ndarray:
        """Hashes of all occurrences of words, pairs and triples."""
        return np.concatenate([self.word_keys[self.ids[self.real]], self.pair_keys[self.pair], self.triple_keys[self.triple]])

    def runs(self, frequent: np.ndarray, buckets: int) -> pa.Table:
        """Distinct runs of one to four words and their occurrences, a row of lists for each bucket of nodes; a run ends before a word
        with which it is not frequent. A word that isn't frequent is a run of none."""
        word = maybe_in(frequent, self.word_keys)[self.ids] & self.real
        second, third = np.zeros(len(word), bool), np.zeros(len(word), bool)
        second[self.pair] = maybe_in(frequent, self.pair_keys[self.pair])
        second &= word & np.append(word[1:], False)
        third[self.triple] = maybe_in(frequent, self.triple_keys[self.triple])
        third &= second & np.append(second[1:], False)
        fourth = third & np.append(third[1:], False)
        none = len(self.words)
        at = [np.where(has, np.append(self.ids[k:], np.full(k, none))[: len(word)], none) for k, has in enumerate((word, second, third, fourth))]
        pairs = [pa.array(a * (none + 1) + b).dictionary_encode() for a, b in (at[:2], at[2:])]
        left, right = (p.indices.to_numpy().astype(np.int64) for p in pairs)
        kinds = max(1, len(pairs[1].dictionary))
        keys, counts = np.unique((left * kinds + right)[self.real], return_counts=True)
        made = [p.dictionary.to_numpy()[k] for p, k in zip(pairs, np.divmod(keys, kinds), strict=True)]
        at = [x for m in made for x in np.divmod(m, none + 1)]
        own = np.append(self.own, np.uint64(0))
        key = spread(spread(spread(own[at[0]]) * np.uint64(3) + own[at[1]]) * np.uint64(5) + own[at[2]])
        place = bucket_of(key, buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1))
        text = self.words.cast(pa.string())
        w = [text.take(pa.array(i[order], mask=i[order] == none)) for i in at]
        node = pc.binary_join_element_wise(pc.fill_null(w[0], ""), w[1], w[2], " ", null_handling="skip")  # a row of nulls alone would vanish
        used = np.flatnonzero(np.diff(cuts))
        ends = pa.array(np.append(cuts[used], len(counts)), pa.int32())
        lists = {n: pa.ListArray.from_arrays(ends, v) for n, v in (("node", node), ("next", w[3]), ("weight", pa.array(counts[order], pa.int64())))}
        return pa.table({"bucket": pa.array(used, pa.int32()), "lang": pa.array([self.lang] * len(used), pa.string()), **lists})


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    """Units of about UNIT bytes from batches of lang and text; a long text is split behind a mark."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = (text or b"").translate(PLAIN)
            while text:
                cut = text.find(b".", UNIT) + 1 if len(text) > UNIT else 0
                part, text = (text[:cut], text[cut:]) if cut else (text, b"")
                held.setdefault(lang, []).append(part.replace(b".", b" . "))
                size += len(part)
                if size >= UNIT:
                    yield from (Unit(k, v) for k, v in held.items())
                    held, size = {}, 0
    yield from (Unit(k, v) for k, v in held.items())


def frequent_keys(docs: DataFrame, least: int) -> DataFrame:
    """Hashes of words, pairs and triples with `least` occurrences and more, each one row (gram). docs has lang and text."""
    buckets = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            keys, counts = np.unique(unit.keys(), return_counts=True)
            cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            parts = [(i, a, z) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in parts], pa.int32()), pa.array([packed(keys[a:z]) for _, a, z in parts], pa.binary()),
                pa.array([packed_counts(counts[a:z]) for _, a, z in parts], pa.binary()),
            ], ["bucket", "grams", "seen"])

    asked = docs.mapInArrow(tidy(count), "bucket int, grams binary, seen binary").repartition(buckets, "bucket")
    return asked.select("grams", "seen").mapInArrow(tidy(gram_counts), "gram long, seen long").filter(F.col("seen") >= least).select("gram")


def phrase_runs(docs: DataFrame, least: int, tables: Tables) -> DataFrame:
    """lang, node, next, weight, flow, first: the summed runs; flow is that of the node, `first` marks one row of each node."""
    small_batches(docs.sparkSession)
    frequent = shared_bloom(frequent_keys(docs, least), FILTER_BITS)

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            yield from unit.runs(frequent.value, buckets).to_batches()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        by = lambda: pa.concat_tables(held).group_by(["lang", "node", "next"]).aggregate([("weight", "sum")]).rename_columns(["lang", "node", "next", "weight"])
        for batch in batches:
            lang, *lists = batch.columns
            sizes = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
            held.append(pa.table({"lang": lang.take(pa.array(np.repeat(np.arange(len(lang)), sizes))), **{n: x.flatten() for n, x in zip(("node", "next", "weight"), lists, strict=True)}}))
            size += len(held[-1])
            if size > 1 << 20:
                held, size = [by()], 0
        if held:
            yield from by().to_batches(1 << 16)

    by = Window.partitionBy("lang", "node")
    listed = docs.mapInArrow(tidy(run), "bucket int, lang string, node array<string>, next array<string>, weight array<long>").repartition(buckets, "bucket")
    made = listed.drop("bucket").mapInArrow(tidy(total), "lang string, node string, next string, weight long").repartition("lang", "node")
    summed_ = made.groupBy("lang", "node", "next").agg(F.sum("weight").alias("weight"))
    flows = summed_.withColumns({"flow": F.sum("weight").over(by), "first": F.row_number().over(by.orderBy(F.col("next").asc_nulls_first())) == 1})
    out = tables.cut(flows.filter(F.col("first") | ((F.col("weight") >= least) & F.col("next").isNotNull())), "runs")
    frequent.destroy()
    return out


def paths(edges: DataFrame, tables: Tables, rounds: int = ROUNDS) -> DataFrame:
    """lang, words, weights: the edges (lang, node, next, weight) as paths that are compacted through nodes with one edge in and
    one out; weights[i] counts words[i : i + 4]."""
    w = F.split("node", " ")
    tail = F.concat_ws(" ", w[1], w[2], F.col("next"))
    start = edges.select("lang", F.col("node").alias("head"), tail.alias("tail"), F.concat(w, F.array("next")).alias("words"), F.array("weight").alias("weights"))
    ends = start.select("lang", F.explode(F.array(F.struct(F.col("head").alias("node"), F.lit(1).alias("out")), F.struct(F.col("tail").alias("node"), F.lit(0).alias("out")))).alias("e"))
    unary = ends.groupBy("lang", "e.node").agg(F.sum("e.out").alias("leave"), F.sum(1 - F.col("e.out")).alias("enter")).filter("leave = 1 and enter = 1").select("lang", "node", F.lit(True).alias("unary"))
    out = start.join(unary.withColumnsRenamed({"node": "head", "unary": "open_head"}), ["lang", "head"], "left").join(unary.withColumnsRenamed({"node": "tail", "unary": "open_tail"}), ["lang", "tail"], "left")
    names = ["lang", "head", "tail", "words", "weights", "open_head", "open_tail"]
    out = tables.cut(out.select(*names[:5], *(F.coalesce(c, F.lit(False)).alias(c) for c in names[5:])), "paths")
    for i in range(rounds):
        before, after = (F.when(F.col(f"open_{c}"), F.xxhash64("lang", c, F.lit(i))) for c in ("head", "tail"))
        right = F.coalesce(after < before, after.isNotNull())
        active = out.filter("open_head or open_tail").withColumn("right", right)
        a, b = (active.filter(c).select(*(F.col(n).alias(f"{p}_{n}") for n in names)) for p, c in (("a", F.col("right")), ("b", ~F.col("right"))))
        met = a.join(b, (F.col("a_lang") == F.col("b_lang")) & (F.col("a_tail") == F.col("b_head")), "full")
        both = F.col("a_lang").isNotNull() & F.col("b_lang").isNotNull()
        joined = {"words": F.concat("a_words", F.slice("b_words", 4, F.size("b_words"))), "weights": F.concat("a_weights", "b_weights")}
        pick = {n: F.coalesce(*(F.col(f"{p}_{n}") for p in ("ba" if n in ("tail", "open_tail") else "ab"))) for n in names}
        out = tables.cut(out.filter("not open_head and not open_tail").unionByName(met.select(*(F.when(both, joined[n]).otherwise(pick[n]).alias(n) if n in joined else pick[n].alias(n) for n in names))), "paths")
    return out.select("lang", "words", "weights")


def phrase_counts(docs: DataFrame, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f of all phrases of one to four words with `least` occurrences; lang, n)."""
    runs = phrase_runs(docs, least, tables)
    nodes = runs.filter("first").select("lang", "node", "flow")
    shorter = lambda df, k: df.groupBy("lang", F.substring_index("node", " ", k).alias("node")).agg(F.sum("flow").alias("flow"))
    twos = shorter(nodes, 2)
    ones = shorter(twos, 1)
    edges = runs.filter((F.col("weight") >= least) & F.col("next").isNotNull()).select("lang", "node", "next", "weight")
    long = paths(edges, tables).select("lang", F.posexplode("weights").alias("i", "f"), "words").select("lang", F.array_join(F.slice("words", F.col("i") + 1, 4), " ").alias("phrase"), "f")
    own = lambda df, k: df.filter((F.col("flow") >= least) & (F.col("node") != "") & (F.size(F.split("node", " ")) == k)).select("lang", F.col("node").alias("phrase"), F.col("flow").alias("f"))
    made = long.unionByName(own(nodes, 3)).unionByName(own(twos, 2)).unionByName(own(ones, 1))
    counts = tables.cut(made.withColumn("words", F.split("phrase", " ")), "phrases")
    return counts, ones.groupBy("lang").agg(F.sum("flow").alias("n"))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, lang: str = "lang", text: str = "text", cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` phrases of two to four words with the highest scores.

    Texts (ASCII capitals lowered) fall into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs. a, l and r count a
    phrase with `least` occurrences and more and the two parts of its weakest cut (score floor(2,000,000 * a / (l + r)), the lowest, then the
    shortest first part). Phrases inside a longer one with `least` occurrences and `cover` percent of theirs are left out. Ranks go by score, a and phrase.
    A null language is `und`, a null text is empty; repeated rows count each; other columns play no part. An empty table gives an empty table.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts, totals = phrase_counts(rows, least, tables)
    found = counts.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> named_struct('k', k, 'left', array_join(slice(words, 1, k), ' '), 'right', array_join(slice(words, k + 1, size(words) - k), ' ')))")).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda side, to: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(to))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = found.filter(F.size("words") > 2).select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    big = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (big("longest", 100) < big("a", cover)))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", F.col("c.score").cast("long").alias("score"))
