"""Benchmark decontamination: exact word windows of test items inside training texts, in DataFrame functions.

A document is first probed with every g-th g-gram of its words (g at most 5, and small enough that each
occurrence of a window covers a probe whole); only documents with a probe in the items' g-grams have all their
windows looked up. Both lookups are sets inside the expression (grams by hash, windows word by word) while
there are at most `inline_limit` entries, and equi-joins beyond. Every hit is equal word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.scratch import cut, fresh

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words in a text whose A-Z still stand.
APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many grams and windows stand in the expression itself (about 100 bytes each).
INLINE = 20_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _starts(n: Column, size: Column, step: int = 1) -> Column:
    """0, step, 2 * step ... up to n - size; empty where n < size."""
    return F.when(n >= size, F.sequence(F.lit(0), (n - size).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, window (words joined by blanks), len: an item's runs of `size` words, or all its words if fewer."""
    w = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(size)))
    return w.select("item_id", "len", F.explode(F.transform(_starts(F.size("w"), F.col("len")), lambda i: F.array_join(F.slice("w", i + 1, F.col("len")), " "))).alias("window")).distinct()


def _grams(words: Column, g: int, step: int) -> Column:
    return F.transform(_starts(F.size(words), F.lit(g), step), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(g))))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", inline_limit: int = INLINE) -> tuple[DataFrame, DataFrame]:
    """(docs with row, words and hits: array of (start, len, window) in word positions; windows of the items)."""
    windows = cut(item_windows(benchmark, size), "windows")
    facts = windows.agg(F.min("len"), F.count_distinct("window")).first()
    shortest, n_windows = facts[0] or size, facts[1]
    g = max(1, min(5, (shortest + 1) // 2))
    lens = sorted(x.len for x in windows.select("len").distinct().collect())  # at most `size` values
    # the condition on the row number keeps the planner from moving the split into words into the windows' expressions
    docs = docs.withColumns({"words": words_of(F.col(text)), "row": F.monotonically_increasing_id()}).filter("row >= 0")
    grams = windows.select(F.explode(_grams(F.split("window", " "), g, 1)).alias("gram")).distinct()
    empty = F.array().cast("array<struct<start:int,len:int,window:string>>")
    if not n_windows:
        return docs.withColumn("hits", empty), windows

    def candidates(n: int) -> Column:
        return F.transform(_starts(F.size("words"), F.lit(n)), lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("window")))

    if n_windows + grams.count() <= inline_limit:
        probes = [x.gram for x in grams.collect()]
        texts = [x.window for x in windows.select("window").distinct().collect()]
        near = F.exists(_grams(F.col("words"), g, g), lambda h: h.isin(probes))
        hits = F.flatten(F.array(*[F.filter(candidates(n), lambda c: c["window"].isin(texts)) for n in lens]))
        return docs.withColumn("hits", F.when(near, hits).otherwise(empty)), windows
    # more windows than an expression should hold: the same two lookups as joins
    docs = cut(docs, "words")
    near = docs.select("row", F.explode(_grams(F.col("words"), g, g)).alias("gram")).join(grams, "gram", "left_semi").select("row").distinct()
    every = docs.join(near, "row", "left_semi").select("row", F.explode(F.flatten(F.array(*[candidates(n) for n in lens]))).alias("hit"))
    hits = every.join(windows.select(F.col("window").alias("w")).distinct(), F.col("hit.window") == F.col("w"), "left_semi").groupBy("row").agg(F.collect_list("hit").alias("hits"))
    return docs.join(hits, "row", "left").withColumn("hits", F.coalesce("hits", empty)), windows


def covered(hits: Column) -> Column:
    """Number of words inside hits (array of (start, len, ...), any order)."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["start"] + h["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(h["start"], end))).alias("n"))

    return F.aggregate(F.array_sort(hits), first, step, lambda a: a["n"])


RESULTS = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
INNER = ("words", "hits", "row", "of_row")


def _hidden(docs: DataFrame, names: tuple[str, ...], text: str) -> dict[str, str]:
    """New names for the columns of docs that are named as those made inside."""
    return {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in names and c != text}


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", carry: list[str] | None = None, inline_limit: int = INLINE) -> DataFrame:
    """The columns `carry` of docs (default: all) with n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated.

    Null or wordless texts have no words and no hits. Repeated rows are judged each; repeated item ids count
    once. An empty benchmark hits nothing. Columns of docs named as the results are replaced, all others are
    carried, whatever their names. What is found is written once, without the words; only rows with hits are then
    joined with the items.
    """
    hide = _hidden(docs, INNER, text)
    found, windows = find_hits(docs.drop(*[c for c in RESULTS if c != text]).withColumnsRenamed(hide), benchmark, size, text, inline_limit)
    keep = [hide.get(c, c) for c in (carry or docs.columns) if c not in RESULTS or c == text]
    none = F.array().cast("array<string>")
    found = cut(found.select(*keep, F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, F.col("hits")).alias("hits"), "row"), "found")
    clean = found.filter(F.col("hits").isNull()).select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    dirty = found.filter(F.col("hits").isNotNull())
    items = windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    seen = dirty.select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window")).join(items, "window")
    seen = seen.select(F.col("row").alias("of_row"), F.explode("items").alias("item")).groupBy("of_row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    dirty = dirty.join(seen, F.col("row") == F.col("of_row"), "left").withColumn("item_ids", F.coalesce("item_ids", none))
    out = clean.unionByName(dirty.select(*keep, "n_words", covered(F.col("hits")).cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.lit(True).alias("contaminated")))
    return out.withColumnsRenamed({v: k for k, v in hide.items()})


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", remove: str = "documents", inline_limit: int = INLINE) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the words of test windows.

    With spans, a removed word takes the separators before it along; documents stay, if only as an empty text.
    """
    hide = _hidden(docs, INNER, text)
    found, _ = find_hits(docs.withColumnsRenamed(hide), benchmark, size, text, inline_limit)
    if remove == "documents":
        found = found.filter(F.size("hits") == 0)
    else:
        parts = F.regexp_extract_all(F.col(text), F.lit(f"[{APART}]*[^{APART}]+|[{APART}]+"), F.lit(0))
        inside = lambda i: F.exists("hits", lambda h: (i >= h["start"]) & (i < h["start"] + h["len"]))
        found = found.withColumn(text, F.when(F.size("hits") == 0, F.col(text)).otherwise(F.array_join(F.filter(parts, lambda _, i: ~inside(i)), "")))
    return found.drop("words", "hits", "row").withColumnsRenamed({v: k for k, v in hide.items()}).select(*docs.columns)
