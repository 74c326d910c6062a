"""Loss accounting, evaluation and log upkeep."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.functions.text import script_key


def overload_rollup(events: DataFrame, keys: list[str], seconds: str, items: str, buffer: str, timing: str, order: str) -> DataFrame:
    """Sums of dropped seconds and items (negative counts as 0), the largest buffer and the latest timing."""
    positive = lambda c: F.greatest(F.lit(0), F.col(c))
    return events.groupBy(*keys).agg(F.sum(positive(seconds)).alias("dropped_seconds"), F.sum(positive(items)).alias("dropped_items"), F.max(buffer).alias("max_buffer"), F.max_by(timing, order).alias("last_timing"), F.count("*").alias("reports"))


def counters(rows: DataFrame, session: str, reasons: dict[str, Column]) -> DataFrame:
    """Rows of each kind by session."""
    return rows.groupBy(session).agg(*[F.count_if(c).alias(n) for n, c in reasons.items()])


#: First bound of edits, and characters for which places in a text are taken at a time, at least.
NEAR, BLOCK = 32, 1024


def _near(a: str, b: str, most: int) -> int:
    """Edit distance of a and b (not shorter, by `most` at most) if it is `most` or less, else a larger number.

    Bit k of a column stands for the row of b that is k - `most` behind the column's place in a, so rows move along the diagonal:
    a way that leaves them has more than `most` edits.
    """
    width = 2 * most + 1
    full, edge, step = (1 << width) - 1, 1 << (width - 1), max(BLOCK, width)
    part = (1 << (step + width)) - 1
    rises, falls, distance, last = full >> most << most, 0, most, edge
    rows = len(b) - most  # columns before the last row comes into reach
    codes: dict[str, bytearray] = {}
    for i, c in enumerate(b):
        codes.setdefault(c, bytearray(len(b) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    where = {c: int.from_bytes(x, "little") for c, x in codes.items()}
    for begin in range(0, len(a), step):
        low, here = begin - most, {}
        for i, c in enumerate(a[begin : begin + step], begin):
            if c not in here:
                x = where.get(c, 0)
                here[c] = (x >> low if low >= 0 else x << -low) & part
            match = here[c] >> (i - begin) & full
            diagonal = (((match & rises) + rises) ^ rises) | match | falls
            diagonal &= full
            up, down = falls | (full & ~(diagonal | rises)), diagonal & rises
            if i < rows:
                distance += not diagonal & edge
            else:
                last >>= 1
                distance += bool(up & last) - bool(down & last)
            diagonal >>= 1
            rises, falls = down | (full & ~(diagonal | up)), diagonal & up
        if begin + step < rows and distance > 2 * most + len(a) - len(b):
            return most + 1
    return distance


def edit_distance(a: str, b: str) -> int:
    """Fewest insertions, deletions and replacements of characters that make b of a.

    A column of the table of distances is held as two numbers with a bit a character of a (where the distance rises and where it falls),
    so a character of b costs a few operations on them and memory is linear. Where few edits do, only the rows near the
    diagonal are held: as many as a bound asks for that is raised until the distance is within it.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = sorted((a[: len(a) - tail], b[: len(b) - tail]), key=len)
    if not a:
        return len(b)
    rest = iter(b)
    if all(c in rest for c in a):  # b with characters left out: no way is shorter
        return len(b) - len(a)
    most = max(NEAR, len(b) - len(a))
    while 2 * most + 1 < len(a):
        distance = _near(a, b, most)
        if distance <= most:
            return distance
        most *= 4
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        places.setdefault(c, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    where = {c: int.from_bytes(x, "little") for c, x in places.items()}
    full, end, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = full, 0
    for c in b:
        match = where.get(c, 0)
        level = match | falls
        diagonal = (((match & rises) + rises) ^ rises) | match
        up, down = falls | (full & ~(diagonal | rises)), rises & diagonal
        distance += bool(up & end) - bool(down & end)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rises, falls = down | (full & ~(level | up)), up & level
    return distance


def _edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else edit_distance(a, b) for a, b in zip(ref.to_pylist(), hyp.to_pylist(), strict=True)], pa.int64())


def edits(ref: Column, hyp: Column) -> Column:
    """edit_distance() of two columns of texts of any length; null where one is."""
    return F.arrow_udf(_edits, "long")(ref, hyp)


def subtitle_key(text: Column, variants: dict[str, str] | None = None) -> Column:
    """A cue as error rates compare it: without tags and override codes, case, space and marks, variants of letters as one."""
    return script_key(F.regexp_replace(text, r"<[^<>]*>|\{[^{}]*\}", ""), variants or {})


def error_rate(cues: DataFrame, ref: Column, hyp: Column, by: list[str], distance: Callable[[Column, Column], Column] = F.levenshtein) -> DataFrame:
    """Edits, reference characters and their quotient in percent for each group of a rollup of `by`: sums first, so
    totals are weighted by length. F.levenshtein is quadratic in a cue's length; `edits` is for whole documents."""
    rows = cues.select(*by, distance(ref, hyp).cast("long").alias("e"), F.length(ref).cast("long").alias("n"))
    out = rows.rollup(*by).agg(F.sum("e").alias("edits"), F.sum("n").alias("chars"))
    return out.withColumn("percent", F.round(F.col("edits") * 100.0 / F.nullif(F.col("chars"), F.lit(0)), 2))


def adequacy(cues: DataFrame, score: str, by: list[str], most: int = 2) -> DataFrame:
    """Mean score in percent of the highest, for each group of a rollup of `by`."""
    out = cues.rollup(*by).agg(F.sum(score).cast("long").alias("points"), F.count(score).alias("cues"))
    return out.withColumn("adequacy", F.round(F.col("points") * 100.0 / F.nullif(F.col("cues") * most, F.lit(0)), 1))


def first_entries(catalog: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key by position."""
    return catalog.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(pos))).filter("_r = 1").drop("_r")


def within_bytes(rows: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose sizes sum to the budget at most."""
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes_kept", F.sum(size.cast("long")).over(w)).filter(F.col("bytes_kept") <= budget)


# Fixed value: what models read as control sequences.
MODEL_TOKENS = r"(?i)<\||\|>|\[/?INST\]|<</?SYS>>|</?(?:asr_text|think|start_of_turn|end_of_turn)>"


def _nfc(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def hint_lists(terms: DataFrame, owner: str = "owner", most: int = 32, each: int = 48, total: int = 512) -> DataFrame:
    """owner, terms, ok: terms in order (NFC, without space around them), without blanks and repeats.

    A list is rejected whole (terms null) if it comes with more than `most` entries, repeats and blanks counted, if a
    term is longer than `each` or holds control characters or model tokens, or if the terms kept are longer than
    `total`. No more than the first `most` + 1 entries of an owner are gathered.
    """
    first = terms.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy("pos"))).filter(F.col("_r") <= most + 1)
    term = F.when(F.col("term").rlike(r"[^\x00-\x7f]"), F.pandas_udf(_nfc, "string")("term")).otherwise(F.col("term"))
    rows = first.select(owner, "_r", F.regexp_replace(F.coalesce(term, F.lit("")), r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$", "").alias("term"))
    bad = (F.length("term") > each) | F.col("term").rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]") | F.col("term").rlike(MODEL_TOKENS)
    lists = rows.groupBy(owner).agg(F.max("_r").alias("n"), F.bool_or(bad).alias("bad"), F.sort_array(F.collect_list(F.struct("_r", "term"))).alias("all"))
    kept = F.array_distinct(F.filter(F.transform("all", lambda x: x["term"]), lambda t: t != ""))
    size = F.aggregate("terms", F.lit(0), lambda a, t: a + F.length(t))
    out = lists.withColumn("terms", kept).withColumn("ok", (F.col("n") <= most) & ~F.col("bad") & (size <= total))
    return out.select(owner, F.when(F.col("ok"), F.col("terms")).alias("terms"), "ok")


def scrubbed(text: Column, secrets: list[str], mark: str = "[REDACTED]") -> Column:
    """text with every secret replaced, longer ones first."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit(mark))
    return text


def scrubbed_chunks(chunks: DataFrame, file: str, order: str, text: str, secrets: list[str]) -> DataFrame:
    """file, text: chunks of a file in order, joined and scrubbed, so that secrets across borders go too."""
    rows = chunks.groupBy(file).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_c"))
    return rows.select(file, scrubbed(F.array_join(F.transform("_c", lambda c: c[text]), ""), secrets).alias(text))
