"""Language-model scores of whole texts by prediction by partial matching (PPM), beside a unigram base score.

The model is a trie of byte contexts of up to ORDER symbols (bytes of the text, ASCII capitals lowered, behind ORDER
start marks and before an end mark). In a context, a symbol that was seen has (2c - 1) / 2n, a step to the next shorter context
q / 2n (escape method D: c its count, n all counts, q symbols seen). Symbols seen in the longer context are excluded
from n and q in the shorter one; as they are a subset of those of the shorter one, each context only needs their sums. Counts of
the longest contexts are occurrences, those of shorter ones the number of distinct longer ones (update exclusion). Behind the
empty context all symbols not seen there are alike.

The probability of a symbol is a function of its gram (ORDER symbols before it and itself), so the job is

1. texts, in input order, become chunks of CHUNK bytes: compressed blocks, each chunk's distinct grams and words, and how often training
   texts hold them. Everything else reads this written table.
2. grams go to buckets by hash and are summed; the trie is built for all contexts that share their last three symbols in one place; its
   orders below three hold 2**24 entries at most and are handed to all tasks.
3. each bucket answers the chunks that asked: log10 probabilities of grams, counts of words; a chunk then scores its own texts.

So what moves is in proportion to the distinct grams and words of the chunks, hot words and grams are one entry a chunk,
and no task or driver holds the model. Chunks in a bucket grow with the input: size spark.sql.shuffle.partitions for it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.memory import give_back, tidy
from cuesmith.llm.scratch import Tables, small_batches
from cuesmith.llm.shingles import spread
from cuesmith.llm.textbatches import by_bytes

#: Context symbols of a gram; with the symbol itself 8 bytes at most.
ORDER = 5
#: Bits of a symbol. UTF-8 has no bytes from 0xF8 on: START stands before a text, END behind it; 248 bytes and END may come.
BITS, START, END, SYMBOLS = 8, b"\xfe", b"\xff", 249
#: ASCII capitals as small letters; bytes that are in no UTF-8 text as one of them.
LOWER = bytes(range(248)).lower() + b"\xf7" * 8
#: The lowest order of the tries that are built apart; orders below are in every task.
LOW = 3
#: Bytes of text of a chunk, of a block, and of a run of texts that are scored at once: each byte takes some 80 then.
CHUNK, BLOCK, RUN = 64 << 20, 2 << 20, 256 << 10


def mask(symbols: int) -> np.uint64:
    return np.uint64((1 << (BITS * symbols)) - 1)


def grams_of(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The grams of all symbols of texts, one behind the other; a text has its bytes and END."""
    marked = START * order + (END + START * order).join(texts) + END + bytes(8)
    n = len(marked) - 8 - order
    grams = np.ndarray((n,), ">u8", marked, strides=(1,)).astype(np.uint64)
    grams >>= np.uint64(64 - BITS * (order + 1))
    return grams[np.frombuffer(marked, np.uint8, n, order) != START[0]] if texts else np.zeros(0, np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, one behind the other, and the number of words of each text. Arrow holds them: as Python objects
    the distinct words of a chunk take ten times their bytes."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    filled = pc.greater(pc.binary_length(cut.values), 0)
    upto = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[cut.offsets.to_numpy()]
    return cut.values.filter(filled).view(pa.binary()).dictionary_encode(), np.diff(upto)


def summed_words(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the sums of their counts."""
    met = pa.concat_arrays(words).dictionary_encode()
    return met.dictionary, np.bincount(met.indices.to_numpy(), np.concatenate(counts), len(met.dictionary)).astype(np.int64)


def at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a sorted table."""
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return i, table[i] == keys if len(table) else np.zeros(len(keys), bool)


class Level:
    """The contexts of one order: keys (context and symbol) with counts; n, q and the counts that their symbols have one
    order below (`above`, to be excluded there) by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.int64)
        context = keys >> np.uint64(BITS)
        self.first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[self.first]
        self.n = np.add.reduceat(self.counts, self.first) if len(keys) else self.counts
        self.q = np.diff(np.append(self.first, len(keys)))
        self.above = np.zeros(len(self.contexts), np.int64)

    def on(self, shorter: Level, symbols: int) -> None:
        i, _ = at(shorter.keys, self.keys & mask(symbols))
        self.above = np.add.reduceat(shorter.counts[i], self.first) if len(self.keys) else self.above

    def shorter(self, symbols: int) -> Level:
        keys, counts = np.unique(self.keys & mask(symbols), return_counts=True)
        return Level(keys, counts)


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 0 .. LOW - 1 from the entries of the highest of them."""
    levels = [Level(keys, counts)]
    for order in range(LOW - 2, -1, -1):
        levels.append(levels[-1].shorter(order + 1))
        levels[-2].on(levels[-1], order + 1)
    return levels[::-1]


def probabilities(grams: np.ndarray, seen: np.ndarray, low: list[Level], order: int = ORDER) -> np.ndarray:
    """log10 probabilities of sorted distinct grams; seen counts them in training texts. All training grams whose contexts
    share their last LOW symbols with one of them must be among them."""
    trained = seen > 0
    levels = [Level(grams[trained], seen[trained])]
    for k in range(order - 1, LOW - 1, -1):
        levels.append(levels[-1].shorter(k + 1))
        levels[-2].on(levels[-1], k + 1)
    levels[-1].on(low[-1], LOW)
    out, open_ = np.zeros(len(grams)), np.arange(len(grams))
    gone, kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k, level in zip(range(order, -1, -1), levels + low[::-1], strict=True):
        keys = grams[open_] & mask(k + 1)
        c, there = at(level.contexts, keys >> np.uint64(BITS))
        i, hit = at(level.keys, keys)
        n = np.where(there, level.n[c] if len(level.n) else 0, 0) - gone
        q = np.where(there, level.q[c] if len(level.q) else 0, 0) - kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            out[open_] += np.where(hit, np.log10((2 * (level.counts[i] if len(level.counts) else 0) - 1) / (2 * n)), np.where(n > 0, np.log10(q / (2 * n)), 0))
        gone, kinds = (np.where(there, x[c] if len(x) else 0, y)[~hit] for x, y in ((level.above, gone), (level.q, kinds)))
        open_ = open_[~hit]
    out[open_] -= np.log10(SYMBOLS - kinds)
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted longs as compressed differences."""
    return zstandard.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), 1)


def packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint64), dtype=np.uint64)


#: New grams or words that a task holds before it adds them up.
MERGED = 1 << 20


class _Chunk:
    """Distinct grams and words of the texts that come in, with their counts in training texts."""

    def __init__(self, buckets: int):
        self.buckets, self.bytes = buckets, 0
        self.keys, self.seen, self.new_keys = [], [], 0
        self.words, self.times, self.new_words = [], [], 0

    def add(self, texts: list[bytes], held: np.ndarray) -> None:
        for part, learns in ((held, False), (~held, True)):
            own = [t for t, h in zip(texts, part.tolist(), strict=True) if h]
            keys, counts = np.unique(grams_of(own), return_counts=True)
            self.keys.append(keys)
            self.seen.append(counts if learns else np.zeros_like(counts))
            words, _ = words_of(own)
            self.words.append(words.dictionary)
            self.times.append(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)) * learns)
            self.new_keys, self.new_words = self.new_keys + len(keys), self.new_words + len(words.dictionary)
        self.bytes += sum(map(len, texts))
        self.merge(MERGED)

    def merge(self, limit: int) -> None:
        """One table of grams and one of words, where more than limit new ones came."""
        if self.new_keys > limit:
            keys, seen = summed(np.concatenate(self.keys), np.concatenate(self.seen))
            self.keys, self.seen, self.new_keys = [keys], [seen], 0
        if self.new_words > limit:
            words, times = summed_words(self.words, self.times)
            self.words, self.times, self.new_words = [words], [times], 0

    def rows(self, chunk: int) -> pa.Table:
        self.merge(-1)
        (keys,), (seen,), (words,), (times,) = self.keys, self.seen, self.words, self.times
        place = (spread(keys) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        keys, seen, cuts = keys[order], seen[order], np.searchsorted(place[order], np.arange(self.buckets + 1))
        place = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(zlib.crc32, words.slice(i, 1 << 14).to_pylist()), np.int64) for i in range(0, len(words), 1 << 14))]) % self.buckets
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(self.buckets + 1))
        used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(ends) > 0))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(ends[used], len(values)) if len(used) else ends[:1], pa.int32()), values)
        return pa.table({
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()), "bucket": pa.array(used, pa.int32()),
            "grams": pa.array([packed(keys[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()), "seen": pa.array([packed_counts(seen[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
            "words": lists(words.take(pa.array(order))), "times": lists(pa.array(times[order])),
        })


def chunked(docs: DataFrame, key: str, buckets: int) -> DataFrame:
    """Step 1: rows of blocks (keys, held, ends, data) and rows (bucket, grams, seen, words, times) of each chunk. docs has
    key, held and text."""
    kind = dict(docs.dtypes)[key]
    schema = f"chunk long, bucket int, grams binary, seen binary, words array<binary>, times array<long>, keys array<{kind}>, held array<boolean>, ends array<long>, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        start, n, open_ = TaskContext.get().partitionId() << 32, 0, _Chunk(buckets)

        def full(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table[x.name].combine_chunks().cast(x.type) if x.name in table.column_names else pa.nulls(len(table), x.type) for x in names]
            yield from pa.Table.from_arrays(cols, schema=names).to_batches()

        for batch in batches:
            keys, held, texts = (batch.column(i) for i in range(3))
            names = names or pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("seen", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("keys", pa.list_(keys.type)), ("held", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
            for a, z in by_bytes(texts, BLOCK):
                part = [t.translate(LOWER) if t else b"" for t in texts.slice(a, z - a).cast(pa.binary()).to_pylist()]
                own = held.slice(a, z - a)
                open_.add(part, own.to_numpy(zero_copy_only=False))
                one = pa.array([0, z - a], pa.int32())
                ends = pa.array(np.cumsum([len(t) for t in part]), pa.int64())
                yield from full(pa.table({"chunk": pa.array([start + n]), "keys": pa.ListArray.from_arrays(one, keys.slice(a, z - a)), "held": pa.ListArray.from_arrays(one, own), "ends": pa.ListArray.from_arrays(one, ends), "data": pa.array([zstandard.compress(b"".join(part), 3)])}))
                if open_.bytes >= CHUNK:
                    yield from full(open_.rows(start + n))
                    n, open_ = n + 1, _Chunk(buckets)
        if open_.keys:
            yield from full(open_.rows(start + n))

    return docs.mapInArrow(tidy(cut), schema)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: distinct grams of the buckets of a task and their counts in training texts. Batches have grams and seen."""
    keys, seen, held = [], [], 0
    for batch in batches:
        for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(unpacked(g))
            seen.append(np.frombuffer(zstandard.decompress(s), np.int64))
            held += len(keys[-1])
            if held > MERGED:
                k, s = summed(np.concatenate(keys), np.concatenate(seen))
                keys, seen, held = [k], [s], 0
    if keys:
        k, s = summed(np.concatenate(keys), np.concatenate(seen))
        for a in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + (1 << 16)].view(np.int64)), pa.array(s[a : a + (1 << 16)], pa.int64())], ["gram", "seen"])


def low_orders(grams: DataFrame) -> list[Level]:
    """Levels below LOW of the whole model: 2**24 entries at most, 8 bytes each."""
    at_low = grams.filter("seen > 0").select(F.col("gram").bitwiseAND(F.lit(int(mask(LOW + 1)))).alias("k")).distinct()
    rows = at_low.groupBy(F.col("k").bitwiseAND(F.lit(int(mask(LOW)))).alias("k")).agg(F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.stack([c.to_numpy().astype("<u4") for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["data"])

    parts = [np.frombuffer(r.data, "<u4").reshape(2, -1) for r in rows.mapInArrow(pack, "data binary").toLocalIterator()]
    keys, counts = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), "<u4")
    order = np.argsort(keys)
    return low_levels(keys[order].astype(np.uint64), counts[order])


def model_rows(grams: DataFrame, buckets: int) -> DataFrame:
    """gram, bucket, p: log10 probability of each gram."""
    low = grams.sparkSession.sparkContext.broadcast(low_orders(grams))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not rows:
            return
        keys, seen = summed(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        p, place = probabilities(keys, seen, low.value), (spread(keys) % np.uint64(buckets)).astype(np.int32)
        for a in range(0, len(keys), 1 << 16):
            z = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:z].view(np.int64)), pa.array(place[a:z]), pa.array(p[a:z])], ["gram", "bucket", "p"])

    suffix = F.shiftright("gram", BITS).bitwiseAND(F.lit(int(mask(LOW))))
    return grams.repartition(buckets, suffix).mapInArrow(tidy(build), "gram long, bucket int, p double")


ANSWERS = "chunk long, grams binary, ps binary, words array<binary>, times array<long>"


def gram_answers(model: pa.Table, asked: pa.Table) -> pa.Table:
    """Step 3: for each chunk that asked in a bucket, its grams and their log10 probabilities."""
    keys = model["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, p = keys[order], model["p"].to_numpy()[order]
    ps = [p[np.searchsorted(keys, unpacked(g.as_py()))].tobytes() for g in asked["grams"]]
    return pa.table({"chunk": asked["chunk"], "grams": asked["grams"], "ps": pa.array(ps, pa.binary()), "words": pa.nulls(len(asked), pa.list_(pa.binary())), "times": pa.nulls(len(asked), pa.list_(pa.int64()))})


def word_answers(asked: pa.Table) -> pa.Table:
    """The same for words: their counts in all training texts. One more row, of no chunk, has the number of words with a count and their sum."""
    total: Counter = Counter()
    lists = list(zip(asked["words"].to_pylist(), asked["times"].to_pylist(), strict=True))
    for words, times in lists:
        for w, t in zip(words, times, strict=True):
            total[w] += t
    out = [list(map(total.__getitem__, words)) for words, _ in lists]
    sums = [sum(t > 0 for t in total.values()), sum(total.values())]
    none = pa.nulls(len(out) + 1, pa.binary())
    return pa.table({"chunk": pa.array([*asked["chunk"].to_pylist(), None], pa.int64()), "grams": none, "ps": none, "words": pa.array([*(w for w, _ in lists), []], pa.list_(pa.binary())), "times": pa.array([*out, sums], pa.list_(pa.int64()))})


def _scores(rows: pa.Table, trained: int) -> pa.Table:
    """One chunk's texts, scored by the answers it got. trained counts the training texts."""
    keys, ps, words, times, blocks = [], [], [], [], []
    for r in rows.select(["grams", "ps", "words", "times", "keys", "held", "ends", "data"]).to_batches():
        cols = [r.column(i) for i in range(8)]
        for i in range(len(r)):
            if cols[7][i].is_valid:
                blocks.append((cols[4][i].values, cols[5][i].values, cols[6][i].values.to_numpy(), cols[7][i].as_py()))
            elif cols[0][i].is_valid:
                keys.append(unpacked(cols[0][i].as_py()))
                ps.append(np.frombuffer(cols[1][i].as_py(), np.float64))
            else:
                words.append(cols[2][i].values)
                times.append(cols[3][i].values.to_numpy())
    keys, ps, times = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.uint64), (ps, np.float64), (times, np.int64)))
    order = np.argsort(keys)
    keys, ps = keys[order], ps[order]
    words = pa.concat_arrays(words) if words else pa.array([], pa.binary())
    logs, known = np.log10(times + 0.5), times > 0
    out = []
    for ids, held, ends, data in blocks:
        data = zstandard.decompress(data)
        texts = [data[a:z] for a, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        score = np.zeros(len(texts))
        for a, z in by_bytes(pa.array(texts, pa.binary()), RUN):
            met = pa.array(grams_of(texts[a:z]).view(np.int64)).dictionary_encode()
            p = ps[np.searchsorted(keys, met.dictionary.to_numpy().view(np.uint64))][met.indices.to_numpy()]
            score[a:z] = np.add.reduceat(p, np.append(0, np.cumsum([len(t) + 1 for t in texts[a : z - 1]])).astype(np.int64))
        spoken, sizes = words_of(texts)
        at_ = pc.index_in(spoken.dictionary, words).to_numpy()[spoken.indices.to_numpy()]
        upto = np.append(0, np.cumsum(sizes))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[upto])
        out.append(pa.table({"key": ids, "held_out": held, "n_tokens": sizes + 1, "n_known": sums(known[at_].astype(np.int64)) + (trained > 0), "weight": sums(logs[at_]) + np.log10(trained + 0.5), "score": score}))
    give_back()
    return pa.concat_tables(out).combine_chunks() if out else pa.table({"key": pa.nulls(0)})


def score_texts(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; texts where `held` is not true are learned from.

    score is the model's log10 probability of the text (ASCII capitals lowered) and its end. Tokens are words (runs without ASCII
    white space) and one end a text; base_score sums log10 of their smoothed relative frequencies. A null text is an empty one, with
    one token; repeated rows are learned from and scored each; without texts to learn from all symbols are alike. Columns of
    docs other than key and text play no part and aren't returned. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = Tables(spark)
    rows = tables.cut(chunked(docs.select(F.col(key).alias("key"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text")), "key", buckets), "chunks")
    learned = F.size(F.filter("held", lambda h: ~h))
    trained = rows.filter("data is not null").select(F.coalesce(F.sum(learned), F.lit(0))).first()[0]
    asked = rows.filter("bucket is not null")
    grams = tables.cut(asked.select("bucket", "grams", "seen").repartition(buckets, "bucket").select("grams", "seen").mapInArrow(tidy(gram_counts), "gram long, seen long"), "grams")
    by_gram = model_rows(grams, buckets).groupBy("bucket").cogroup(asked.select("bucket", "chunk", "grams").groupBy("bucket")).applyInArrow(gram_answers, ANSWERS)
    by_word = tables.cut(asked.select("bucket", "chunk", "words", "times").groupBy("bucket").applyInArrow(word_answers, ANSWERS), "words")
    sums = by_word.filter("chunk is null").select(F.coalesce(F.sum(F.element_at("times", 1)), F.lit(0)).alias("v"), F.coalesce(F.sum(F.element_at("times", 2)), F.lit(0)).alias("n")).first()
    tokens, kinds = sums.n + trained, sums.v + (trained > 0)
    blocks = rows.filter("data is not null").select("chunk", "keys", "held", "ends", "data")
    met = blocks.unionByName(by_gram.unionByName(by_word.filter("chunk is not null")), allowMissingColumns=True)
    kind = docs.schema[key].dataType.simpleString()
    out = met.groupBy("chunk").applyInArrow(lambda t: _scores(t, trained), f"key {kind}, held_out boolean, n_tokens long, n_known long, weight double, score double")
    base = F.col("weight") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (kinds + 1))))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
