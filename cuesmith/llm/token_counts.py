"""Token counts of whole texts by a public tokenizer, without keeping the ids.

Texts are cut where the byte-level pre-tokenizer always cuts (before a single space between two
non-space characters), so the pieces can be encoded apart and their lengths added. Special strings
hold no space and stay whole. A piece that was counted before is not encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.textbatches import by_bytes

#: Python's \s holds every white space of the tokenizers' own patterns, so these cuts are a subset of theirs.
ODD_SPACE = re.compile(r"\s |^ | \s| $")
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces whose counts a worker keeps, and characters of the longest that it keeps: their product bounds its memory.
CACHE, LONGEST = 600_000, 64
_workers: dict[str, tuple] = {}


def pieces(text: str) -> list[str]:
    """The text in pieces whose token counts add up to that of the text.

    >>> pieces("one two  three")
    ['one', ' two  three']
    """
    if ODD_SPACE.search(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else CUT.split(text)


def _worker(path: str) -> tuple:
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _workers[path] = (lambda batch: [len(x) for x in model.encode(batch, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _workers[path] = (lambda batch: [len(x) for x in t.encode_batch_fast(batch, add_special_tokens=False)], {})
    return _workers[path]


def count_column(texts: pa.Array, path: str, batch_bytes: int = 1 << 20) -> list[int]:
    """Token counts of texts; null counts as empty."""
    encode, known = _worker(path)
    out: list[int] = []
    for a, b in by_bytes(texts, batch_bytes):
        part = texts.slice(a, b - a).fill_null("").to_pylist()
        if known is None:  # sentencepiece: no cut is safe in every model, so whole texts
            out += encode(part)
            continue
        cut = [pieces(t) for t in part]
        new = list({p for ps in cut for p in ps if p not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({p for ps in cut for p in ps})
        for i in range(0, len(new), 4096):
            known.update(zip(new[i : i + 4096], encode(new[i : i + 4096]), strict=True))
        get = known.__getitem__
        out += [sum(map(get, ps)) for ps in cut]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
    return out


def token_count(text: Column | str, tokenizer_path: str, batch_bytes: int = 1 << 20) -> Column:
    """Number of tokens of a text column (long). The file must exist at tokenizer_path on every executor."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(count_column(column, tokenizer_path, batch_bytes), pa.int64())

    return count(text)


def with_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8 length), n_tokens and over_limit (n_tokens > limit), replacing columns so named.

    One narrow stage: rows are neither moved nor dropped. A null text counts as empty (0 bytes, 0 tokens);
    repeated rows are counted each; an empty table gives an empty table.
    """
    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
    out = out.withColumn("n_tokens", token_count(F.col(text), tokenizer_path))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
