"""Running values over streams of any length, without one task for a stream.

A stream is cut into blocks by its order column (block = floor(order / width)). Each block is summed up in one row by partial aggregation, a window
over these rows (one a block, not one a row) hands on what stands before a block, and the rows of a block are finished from it. So a task holds a
block of a stream at most, and what is in one place for a whole stream is its summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cuesmith.sources.written import written

#: Width of a block in units of the order column.
WIDTH = 100_000


def block_of(order: str | Column, width: float = WIDTH) -> Column:
    return F.floor((F.col(order) if isinstance(order, str) else order) / F.lit(width))


class Blocks:
    """rows of streams (key columns) with their block, for windows within blocks and values carried into them. Names that begin
    with `_scan_` are the helper's own; rows with a null key or order make a stream and a block of their own."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], width: float = WIDTH):
        self.keys, self.order = keys, order
        self.rows = rows.withColumn("_scan_block", block_of(order[0], width))
        self.window: WindowSpec = Window.partitionBy(*keys, "_scan_block").orderBy(*order)
        self.so_far = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.by_block = Window.partitionBy(*keys).orderBy("_scan_block")
        self.before = self.by_block.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, value: Column, where: Column | None = None) -> Column:
        """Aggregate: value of the last row of a block (of those where the condition holds)."""
        at = F.struct(*self.order)
        return F.max_by(value, at if where is None else F.when(where, at))

    def first(self, value: Column) -> Column:
        return F.min_by(value, F.struct(*self.order))

    def carried(self, sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """The rows with the columns of `carry`: windows (self.by_block, self.before) over the blocks' sums."""
        own = [*self.keys, "_scan_block"]
        s = self.rows.groupBy(*own).agg(*(c.alias(n) for n, c in sums.items()))
        for n, c in carry.items():
            s = s.withColumn(n, c)
        s = s.select(*(F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(own)), *carry)
        on = F.lit(True)
        for i, k in enumerate(own):
            on &= F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
        return self.rows.join(s, on, "left").drop(*(f"_scan_k{i}" for i in range(len(own))))

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*(c for c in rows.columns if c.startswith("_scan_")))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: float = WIDTH) -> DataFrame:
    """rows with `name`: the sum of value over the rows before in the same stream (0 for the first)."""
    b = Blocks(rows, keys, order, width)
    out = b.carried({"_scan_sum": F.sum(value)}, {"_scan_before": F.coalesce(F.sum("_scan_sum").over(b.before), F.lit(0))})
    own = F.coalesce(F.sum(value).over(b.window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.done(out.withColumn(name, F.col("_scan_before") + own))


def furthest(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: float = WIDTH) -> DataFrame:
    """rows with `name`: the greatest value of the rows before in the same stream (null for the first)."""
    b = Blocks(rows, keys, order, width)
    out = b.carried({"_scan_max": F.max(value)}, {"_scan_before": F.max("_scan_max").over(b.before)})
    own = F.max(value).over(b.window.rowsBetween(Window.unboundedPreceding, -1))
    return b.done(out.withColumn(name, F.greatest(own, F.col("_scan_before"))))


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: float = WIDTH) -> DataFrame:
    """rows with `name`: the last value that is not null, of this row or one before in the same stream."""
    b = Blocks(rows, keys, order, width)
    out = b.carried({"_scan_last": b.last(value, value.isNotNull())}, {"_scan_before": F.last("_scan_last", ignorenulls=True).over(b.before)})
    return b.done(out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(b.so_far), F.col("_scan_before"))))


def gaps(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, width: float = WIDTH) -> DataFrame:
    """rows with missing (samples between the end of the row before and start) and epoch (gaps so far)."""
    b = Blocks(rows, keys, order, width)
    b.rows = b.rows.withColumns({"_scan_lag": F.lag(end).over(b.window), "_scan_n": F.row_number().over(b.window)})
    gap = lambda before: F.greatest(F.lit(0), F.coalesce(F.col(start) - before, F.lit(0)))
    sums = {"_scan_start": b.first(F.col(start)), "_scan_end": b.last(F.col(end)), "_scan_inner": F.count_if((F.col("_scan_n") > 1) & (gap(F.col("_scan_lag")) > 0))}
    ended = F.lag("_scan_end").over(b.by_block)
    entry = F.greatest(F.lit(0), F.coalesce(F.col("_scan_start") - F.col("_scan_ended"), F.lit(0))) > 0
    carry = {"_scan_ended": ended, "_scan_epoch": F.coalesce(F.sum(F.col("_scan_inner") + entry.cast("long")).over(b.before), F.lit(0))}
    out = b.carried(sums, carry)
    out = out.withColumn("missing", gap(F.when(F.col("_scan_n") == 1, F.col("_scan_ended")).otherwise(F.col("_scan_lag"))))
    return b.done(out.withColumn("epoch", F.col("_scan_epoch") + F.sum((F.col("missing") > 0).cast("long")).over(b.so_far)))


def following(rows: DataFrame, key: str, at: str, gap: float, width: float) -> DataFrame:
    """key, at, to, fresh of the distinct times of a key: `to` is the first time at least `gap` later (null: none), fresh tells that the
    time before is at least `gap` earlier or there is none."""
    times = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at")).distinct()
    probes = times.select("k", (F.col("at") + F.lit(gap)).alias("t"), F.col("at").alias("from"), F.lit(None).cast(dict(rows.dtypes)[at]).alias("at"))
    both = times.select("k", F.col("at").alias("t"), F.lit(None).cast(dict(rows.dtypes)[at]).alias("from"), "at").unionByName(probes)
    b = Blocks(both, ["k"], ["t", "at"], width)
    ahead = b.by_block.rowsBetween(1, Window.unboundedFollowing)
    out = b.carried({"_scan_first": F.min("at"), "_scan_top": F.max("at")}, {"_scan_next": F.first("_scan_first", ignorenulls=True).over(ahead), "_scan_prior": F.last("_scan_top", ignorenulls=True).over(b.before)})
    # probes (null at) come before times that are equal to them
    later = F.first("at", ignorenulls=True).over(b.window.rowsBetween(0, Window.unboundedFollowing))
    earlier = F.last("at", ignorenulls=True).over(b.window.rowsBetween(Window.unboundedPreceding, -1))
    out = out.select("k", "from", "at", F.coalesce(later, "_scan_next").alias("later"), F.coalesce(earlier, "_scan_prior").alias("earlier"))
    own = out.filter("at is not null").select("k", "at", (F.col("earlier").isNull() | (F.col("at") - F.col("earlier") >= gap)).alias("fresh"))
    to = out.filter("from is not null").select("k", F.col("from").alias("at"), F.col("later").alias("to"))
    return own.join(to, ["k", "at"])


def throttled_by_jumps(rows: DataFrame, key: str, at: str, gap: float, order: list[str] | None = None, width: float | None = None) -> DataFrame:
    """The rows that stability.throttled() gives, for keys of any weight: no task reads a whole key.

    A row after a silence of `gap` always passes, and whoever passes hands on to the first row at least `gap` later. So pointers to that row are
    made block by block, and those who pass are found by following them from the rows after silences, all at once and with pointers
    that double: as many rounds as the logarithm of the longest chain without such a silence. Each round is a written table. Of rows with
    equal key and time, the first by `order` counts. Rows with a null key or time don't pass; gap is above 0.
    """
    links = following(rows, key, at, gap, width or 1000 * gap)
    fresh = links.filter("fresh").select("k", F.col("at").alias("to"), F.lit(True).alias("again"))
    links = links.join(fresh, ["k", "to"], "left").select("k", "at", F.when(F.col("again").isNull(), F.col("to")).alias("to"), F.col("fresh").alias("passes"))
    links = written(links)
    while not links.filter("to is not null and passes").isEmpty():
        met = links.filter("passes and to is not null").select("k", F.col("to").alias("at"), F.lit(True).alias("met")).distinct()
        on = links.select("k", F.col("at").alias("to"), F.col("to").alias("further"))
        links = links.join(met, ["k", "at"], "left").withColumn("passes", F.col("passes") | F.coalesce("met", F.lit(False))).drop("met")
        links = written(links.join(on, ["k", "to"], "left").select("k", "at", F.col("further").alias("to"), "passes"))
    w = Window.partitionBy(key, at).orderBy(*(order or [at]))
    passing = links.filter("passes").select(F.col("k").alias("_scan_k"), F.col("at").alias("_scan_at"))
    first = rows.withColumn("_scan_n", F.row_number().over(w)).filter("_scan_n = 1")
    return first.join(passing, (F.col(key) == F.col("_scan_k")) & (F.col(at) == F.col("_scan_at")), "left_semi").drop("_scan_n")
