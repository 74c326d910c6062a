"""Line deduplication by a suffix order over line ids, in DataFrame functions.

Lines get ids in the order of their hashes; prefix doubling ranks the suffixes of every document's line sequence
by their first 2, 4 .. lines until runs of `min_lines` lines are told apart (deeper order cannot change which
lines go, so doubling ends there). Suffixes of equal rank are an interval of common prefix in the suffix order;
all members but the earliest mark the lines of the run, and overlapping marks join into maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.llm.scratch import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a group of equal first rank, so that one very common line is not ranked in one task.
PARTS = 1024


def _ranked(rows: DataFrame, first: str, second: str, span: int) -> DataFrame:
    """(first, second, rank, c) of the pairs that more than one row has; rank is first plus the rows of equal first
    and smaller second. second is below span, whose range is cut into PARTS parts in order."""
    pairs = rows.groupBy(first, second).agg(F.count("*").alias("c"))
    pairs = pairs.withColumn("part", F.floor(F.col(second) / F.lit(float(span)) * PARTS))
    parts = pairs.groupBy(F.col(first).alias("of"), F.col("part").alias("of_part")).agg(F.sum("c").alias("size"))
    before = parts.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = F.coalesce(F.sum("c").over(Window.partitionBy(first, "part").orderBy(second).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = pairs.withColumn("inside", inside).join(before, (F.col(first) == F.col("of")) & (F.col("part") == F.col("of_part")))
    return out.filter("c > 1").select(first, second, (F.col(first) + F.col("before") + F.col("inside")).alias("rank"))


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, runs: array of (first, last) line numbers (from 0) that repeat earlier lines."""
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("idx", "line"))
    digest = F.md5(F.col("line"))
    plain = plain.select("doc", "th", "idx", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("h"), F.conv(F.substring(digest, 13, 15), 16, 10).cast("long").alias("g"), (F.regexp_count("line", F.lit(WORD)) >= min_words).alias("long"))
    # rows equal in key and text are one document
    lines = cut(plain.groupBy("doc", "th", "idx").agg(F.min("h").alias("h"), F.min("g").alias("g"), F.max("long").alias("long")), "lines")
    total = lines.count()
    # ids: 48 bits of the digest are the first rank's parts (4096 in order), the whole digest the order inside
    ids = lines.groupBy("h", "g").agg(F.count("*").alias("c")).withColumn("part", F.shiftright("h", 36))
    parts = ids.groupBy(F.col("part").alias("of")).agg(F.sum("c").alias("size"))
    before = parts.select("of", F.coalesce(F.sum("size").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.withColumn("inside", inside).filter("c > 1").join(before, F.col("part") == F.col("of")).select("h", "g", (F.col("before") + F.col("inside")).alias("rank"))
    ranks = cut(lines.join(ids, ["h", "g"]).select("doc", "th", "idx", "long", "rank"), "ranks")
    marks = _later(ranks.filter("long"), 1)
    k, deep = 1, ranks.drop("long")
    while k < min_lines:
        step = min(k, min_lines - k)
        w = Window.partitionBy("doc", "th").orderBy("idx").rangeBetween(step, step)
        two = deep.withColumn("next", F.max("rank").over(w)).filter("next is not null")
        two = cut(two, "pairs")
        deep = cut(two.join(_pairs(two, total), ["rank", "next"]).select("doc", "th", "idx", F.col("new").alias("rank")), "ranks")
        k += step
    if min_lines > 1:
        marks = marks.unionByName(_later(deep, min_lines))
    else:
        marks = _later(deep, 1)
    # marks of a document as maximal runs
    w = Window.partitionBy("doc", "th").orderBy("first", "last")
    upto = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = marks.withColumn("new", F.when(F.col("first") <= upto + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("doc", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _pairs(two: DataFrame, total: int) -> DataFrame:
    """(rank, next, new): the rank of the pair (rank, next) where it repeats."""
    named = _ranked(two.withColumnRenamed("rank", "r1"), "r1", "next", max(1, total))
    return named.select(F.col("r1").alias("rank"), "next", F.col("rank").alias("new"))


def _later(ranks: DataFrame, n: int) -> DataFrame:
    """doc, th, first, last: the lines of suffixes (to depth n) that are not the earliest of their rank."""
    place = F.struct("doc", "th", "idx")
    firsts = ranks.groupBy(F.col("rank").alias("of")).agg(F.min(place).alias("earliest"), F.count("*").alias("c")).filter("c > 1").drop("c")
    late = ranks.join(firsts, F.col("rank") == F.col("of")).filter(place != F.col("earliest"))
    return late.select("doc", "th", F.col("idx").alias("first"), (F.col("idx") + n - 1).alias("last"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text left after removing repeated line runs, and n_lines, n_removed, n_runs (replaced if there).

    A line goes if it lies in a run of `min_lines` consecutive lines, or is a line of at least `min_words` words,
    that also stands earlier: in a smaller key, or earlier in the same text. Lines end at \\n and count as they are,
    empty ones too; runs are judged on the input. A null text stays null and has one empty line. Rows equal in key
    and text are one document and treated alike; of different texts under one key the smaller hash is first; a
    null key comes last. Keys are integers (a text that is none raises). Other columns are carried, whatever their names.
    """
    doc, th, of_doc, of_th, found = (fresh(docs, c) for c in ("_doc", "_th", "_rd", "_rt", "_runs"))
    runs = repeated_runs(docs, min_lines, min_words, key, text).withColumnsRenamed({"doc": of_doc, "th": of_th, "runs": found})
    plain = docs.drop("n_lines", "n_removed", "n_runs").withColumns({doc: F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), th: F.xxhash64(F.col(text))})
    out = plain.join(runs, (F.col(doc) == F.col(of_doc)) & (F.col(th) == F.col(of_th)), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    inside = lambda i: F.exists(found, lambda r: (i >= r["first"]) & (i <= r["last"]))
    gone = F.coalesce(F.aggregate(found, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    out = out.withColumns({"n_lines": F.size(lines).cast("long"), "n_removed": gone, "n_runs": F.when(F.col(found).isNull(), 0).otherwise(F.size(found)).cast("long")})
    left = F.when(F.col(found).isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~inside(i)), "\n"))
    return out.withColumn(text, left).drop(doc, th, of_doc, of_th, found)
