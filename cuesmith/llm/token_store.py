"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    magic | blocks | block index | Bloom filter | footer

* block: zstd of entries; an entry is varint(shared) varint(rest) varint(size) key[shared:] ids, where shared
  counts the key bytes taken over from the entry before (prefix compression, starting anew in each block);
* block index: one entry a block with its first key, offset, length, entries and ids before it (sparse);
* Bloom filter: 10 bits and 7 probes a key;
* footer: fixed size, with the offsets of the parts, the numbers of documents and ids, id width and magic.

Keys are the document ids as 8 big-endian bytes with the sign bit flipped, so that byte order is number order;
a null id is the empty key and comes first. Ids are little-endian, 2 bytes each where the vocabulary allows it.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.memory import tidy
from cuesmith.llm.scratch import cut, scratch_dir, small_batches
from cuesmith.llm.textbatches import by_bytes

MAGIC = b"CUESST01"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK_BYTES = 1 << 17
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Bytes of a generation of words whose ids a worker keeps, with their ids (some 300,000 words), and characters of the longest word.
CACHE, LONGEST = 6 << 20, 64
_encoders: dict[str, _Encoder] = {}


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes one shard; add() takes keys in ascending order. Only a block and the keys' hashes are held."""

    def __init__(self, out, width: int):
        self.out, self.width, self.codec = out, width, pa.Codec("zstd", compression_level=1)
        self.block, self.prior, self.entries, self.first = bytearray(), b"", 0, b""
        self.index, self.keys, self.docs, self.ids, self.block_ids = bytearray(), [], 0, 0, 0
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if not self.entries:
            self.first, self.prior = key, b""
        shared = len(os.path.commonprefix((self.prior, key)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.prior, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            packed = self.codec.compress(bytes(self.block), asbytes=True)
            self.index += struct.pack("<B", len(self.first)) + self.first + struct.pack("<QQQQQ", self.at, len(packed), len(self.block), self.entries, self.block_ids)
            self._put(packed)
            self.block, self.entries, self.block_ids = bytearray(), 0, self.ids

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(bytes(self.index))
        bits = max(64, BLOOM_BITS * self.docs)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(bloom.tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.docs, self.ids, self.width, MAGIC))


class ShardReader:
    """Reads a shard by scan or by key."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        self.index_at, self.index_len, self.bloom_at, self.bits, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.codec, self._blocks = pa.Codec("zstd"), None

    def blocks(self) -> list[tuple]:
        if self._blocks is None:
            self.file.seek(self.index_at)
            data, at, out = self.file.read(self.index_len), 0, []
            while at < len(data):
                n = data[at]
                out.append((data[at + 1 : at + 1 + n], *struct.unpack_from("<QQQQQ", data, at + 1 + n)))
                at += 1 + n + 40
            self._blocks = out
        return self._blocks

    def entries(self, block: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, packed, size, n, _ = block
        self.file.seek(at)
        data, at, key = self.codec.decompress(self.file.read(packed), size, asbytes=True), 0, b""
        kind = "<u2" if self.width == 2 else "<u4"
        for _ in range(n):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            value, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, kind, value // self.width, at)
            at += value

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for b in self.blocks():
            yield from self.entries(b)

    def get(self, key: bytes) -> list[np.ndarray]:
        """All documents of a key, in order: Bloom filter, binary search in the block index, then one block (more only if the key's documents go on)."""
        self.file.seek(self.bloom_at)
        bloom = self.file.read((self.bits + 7) // 8)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        blocks = self.blocks()
        lo, hi = 0, len(blocks)
        while lo < hi:  # first block whose first key is not below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if blocks[mid][0] < key else (lo, mid)
        out = []
        for b in blocks[max(0, lo - 1) :]:
            if b[0] > key:
                break
            out += [ids for k, ids in self.entries(b) if k == key]
        return out


class _Known:
    """Words and their ids as Arrow arrays: some 20 bytes a word, where a dict takes 200."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        self.words, self.ids = words, ids

    def __len__(self) -> int:
        return len(self.words)

    def __iter__(self) -> Iterator[str]:
        return (w.as_py() for w in self.words)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of words is, -1 for those that are not here."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def with_more(self, words: pa.Array, ids: pa.ListArray) -> _Known:
        return _Known(pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids]))


class _Encoder:
    """A tokenizer and the ids of words that it was asked for. Words live in two generations: when the young one is full
    it becomes the old one, and a word that is met again moves over, so frequent words stay. A worker keeps them for its
    next tasks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        #: Whether the tokenizer drops white space, so that words between it can be encoded apart.
        self.words_apart = bool(t.normalizer) and "\\s+" in str(t.normalizer)
        #: Whether letters and punctuation are words of their own to it, in lower case.
        self.letters_apart = self.words_apart and "[\\\\p{L}]+|" in repr(str(t.pre_tokenizer)) and "Lowercase" in str(t.normalizer)
        self.ends = np.zeros(t.get_vocab_size(), bool)
        self.ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
        self.width = 2 if t.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.none = _Known(pa.array([], pa.string()), pa.array([], pa.list_(pa.from_numpy_dtype(self.kind))))
        self.young = self.old = self.none

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of distinct pieces."""
        place = self.young.places(pieces)
        new = np.flatnonzero(place < 0)
        place[new] = self.old.places(pieces.take(pa.array(new)))
        place[new] += np.where(place[new] < 0, 0, len(self.young))
        need = np.flatnonzero(place < 0)
        words = pieces.take(pa.array(need))
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & self.ends.any()
        made = [*self._plain(words.filter(pa.array(plain))), *self._apart(words.filter(pa.array(~plain)))]
        place[np.append(need[plain], need[~plain])] = len(self.young) + len(self.old) + np.arange(len(need))
        out = pa.concat_arrays([self.young.ids, self.old.ids, *made]).take(pa.array(place))
        new = pa.array(new).filter(pc.less_equal(pc.utf8_length(pieces.take(pa.array(new))), LONGEST))
        self.young = self.young.with_more(pieces.take(new), out.take(new))
        if self.young.words.nbytes + self.young.ids.nbytes > CACHE:
            self.old, self.young = self.young, self.none
        return out

    def _apart(self, words: pa.Array) -> Iterator[pa.ListArray]:
        for i in range(0, len(words), 4096):
            each = self.batch(words.slice(i, 4096).to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each)))

    def _plain(self, words: pa.Array) -> Iterator[pa.ListArray]:
        """Many words in one text, told apart by their last tokens."""
        cuts = pa.array(np.append(np.arange(0, len(words), 512), len(words)), pa.int32())
        for i, text in enumerate(pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").to_pylist() if len(words) else []):
            chunk, ids = words.slice(i * 512, 512), self.batch([text])[0]
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(chunk):
                yield pa.ListArray.from_arrays(pa.array(np.append(0, at), pa.int32()), pa.array(ids))
            else:
                yield from self._apart(chunk)


#: Letters below U+0130: no normal form or lower case changes their number or leaves a mark at an end. A plain word is one
#: word of the tokenizer's own pattern, whose last token and no other ends a word.
LETTER = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}]"
PLAIN = f"^{LETTER}+$"
EDGES = (f"({LETTER})([.,:;!?])", f"([.,:;!?])({LETTER})")


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between ASCII white space, dictionary-encoded, and the offsets of each text's words."""
    cut = pc.ascii_split_whitespace(texts)
    return cut.flatten().dictionary_encode(), cut.offsets.to_numpy()


def _lists(lists: pa.ListArray, words: pa.DictionaryArray, of: np.ndarray) -> pa.ListArray:
    """For each text the items of its words one after the other."""
    each = lists.take(words.indices)
    return pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[of]), each.values)


def encode_column(texts: pa.Array, path: str, run_bytes: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids a text) of runs of whole texts.

    Where the tokenizer drops white space, Arrow finds the distinct words of a run and the distinct pieces of these
    words: letters and common punctuation are parted, as the tokenizer parts them, and ASCII letters lower-cased where it
    lower-cases, but for words with a special string in them. Only pieces are encoded, and ids are taken by index.
    Other tokenizers get the texts as they are."""
    encoder = _encoder(path)
    for a, b in by_bytes(texts, run_bytes):
        part = texts.slice(a, b - a).fill_null("")
        if not encoder.words_apart:
            each = encoder.batch(part.to_pylist())
            yield np.concatenate(each), np.array([len(x) for x in each])
            continue
        words, of_text = _cut(part)
        parted = words.dictionary
        if encoder.letters_apart:
            special = pc.match_substring(parted, "<|")
            lower = pc.ascii_lower(parted)
            for edge in EDGES:
                lower = pc.replace_substring_regex(lower, edge, r"\1 \2")
            parted = pc.if_else(special, parted, lower)
        pieces, of_word = _cut(parted)
        out = _lists(_lists(encoder.ids_of(pieces.dictionary), pieces, of_word), words, of_text)
        yield out.values.to_numpy(), np.diff(out.offsets.to_numpy())


def encode_batch(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts; null is empty."""
    out: list[np.ndarray] = []
    for ids, n in encode_column(pa.array(texts, pa.string()), path):
        out += np.split(ids, np.cumsum(n)[:-1])
    return out


MANIFEST = "shard int, path string, n_docs long, n_tokens long, min_id long, max_id long, file_bytes long"


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every text and write shards in ascending key order; returns the manifest, one row a shard.

    docs are range-partitioned by key (and, among rows of one key, by the text's hash, so that a key with very
    many rows does not fill one shard), sorted within partitions and streamed into one file a partition. A file
    gets its final name only when whole; a task that runs again writes the same bytes under a name of its own
    and the manifest names the one that counts. Only key and text are moved. A null text is empty (just the end
    id); a null key sorts first; repeated rows are written each; an empty table gives an empty manifest.
    """
    small_batches(docs.sparkSession)
    folder = folder or f"{scratch_dir(docs.sparkSession)}/tokens"
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        shard, least, most = TaskContext.get().partitionId(), None, None
        where, top = fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.sst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                where.create_dir(top, recursive=True)
                sink = where.open_output_stream(f"{top}/.{name}")
                writer = ShardWriter(sink, _encoder(tokenizer_path).width)
            keys = batch.column(0).to_pylist()
            row = 0
            for ids, n in encode_column(batch.column(1), tokenizer_path):
                for part in np.split(ids, np.cumsum(n)[:-1]):
                    writer.add(key_bytes(keys[row]), part if end_id is None else np.append(part, part.dtype.type(end_id)))
                    row += 1
            seen = [k for k in keys if k is not None]
            least, most = min([*seen, *([] if least is None else [least])], default=None), max([*seen, *([] if most is None else [most])], default=None)
        if writer is not None:
            writer.close()
            sink.close()
            where.move(f"{top}/.{name}", f"{top}/{name}")
            row = [[shard], [f"{folder}/{name}"], [writer.docs], [writer.ids], [least], [most], [writer.at]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "path", "n_docs", "n_tokens", "min_id", "max_id", "file_bytes"])

    return cut(rows.mapInArrow(tidy(write), MANIFEST), "manifest")


def read_store(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, with_ids, ids. One task reads one shard; the manifest's running
    sum has a row a shard only."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, manifest.count())
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).cast("long")).select("shard", "path", "start").repartitionByRange(n, "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = ShardReader(path)
                for block in shard.blocks():
                    rows: list[tuple] = []
                    for key, ids in shard.entries(block):
                        wide = ids.astype("<u4")
                        rows.append((key_value(key), start, len(ids), zlib.crc32(wide.tobytes()), wide.astype("<i8") if with_ids else None))
                        start += len(ids)
                    cols = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array([x.tolist() for x in cols[4]], pa.list_(pa.int64()))] if with_ids else [])
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return files.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id, ids of the caller's keys: shards whose key range holds a key are opened and searched.

    A key asked for twice is answered once. The keys are the caller's own list, so each shard gets its keys by binary
    search in that list, sorted and sent to the executors once: no keys meet shards in a join."""
    asked = np.unique(np.array([int(k) for k in keys], np.int64))
    shared = manifest.sparkSession.sparkContext.broadcast(asked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shared.value[np.searchsorted(shared.value, low) : np.searchsorted(shared.value, high, "right")].tolist()
                shard = ShardReader(path) if own else None
                for i in range(0, len(own), 256):
                    out = [(k, ids.astype("<i8").tolist()) for k in own[i : i + 256] for ids in shard.get(key_bytes(k))]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc_id", "ids"])

    # a shard without an id (its only key is null) answers no key
    shards = manifest.filter("max_id is not null").select("path", F.coalesce("min_id", F.lit(-(1 << 63))).alias("min_id"), "max_id")
    return shards.repartition(max(1, manifest.count())).mapInArrow(find, "doc_id long, ids array<long>")
