"""Caption changelogs: current state, retention, suppression and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["session_id", "segment_id"]


def caption_state(events: DataFrame, payload: list[str], first_seen: str = "seq") -> DataFrame:
    """Current caption of every live segment from a log of updates and removals.

    events: session_id, segment_id, revision, is_final, removed, seq (arrival order) and payload columns. The row
    with the highest (revision, is_final, seq) stands: a higher revision wins, at equal revision a draft never
    replaces a final, a later arrival replaces an equal one. A removed segment never comes back. `arrived` is the
    first arrival, kept through corrections. Unbounded mode: nothing is forgotten (see bounded_history()). One
    partially aggregated shuffle on the key; rows with a null key are not captions and are left out.
    """
    rows = events.filter(F.col("session_id").isNotNull() & F.col("segment_id").isNotNull())
    live = ~F.coalesce(F.col("removed"), F.lit(False))
    row = F.struct(*[F.col(c) for c in ("revision", "is_final", "seq", *payload)])
    order = F.struct("revision", "is_final", "seq")
    state = rows.groupBy(*KEY).agg(F.max_by(F.when(live, row), F.when(live, order)).alias("row"), F.min(F.when(live, F.col(first_seen))).alias("arrived"), F.bool_or(~live).alias("gone"))
    return state.filter(~F.col("gone") & F.col("row").isNotNull()).select(*KEY, "arrived", "row.*")


def latest_k(state: DataFrame, k: int = 100, per: list[str] | None = None, order: str = "arrived") -> DataFrame:
    """The k newest captions by first arrival, newest first, for each group of `per` (default: overall), with position.

    Spark limits each partition to k rows before the exchange (WindowGroupLimit), so a hot owner costs k rows a task.
    """
    w = Window.partitionBy(*(per or [])).orderBy(F.desc(order), *[F.desc(c) for c in KEY])
    return state.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


class Rotation:
    """A list of captions, newest first, cut to `limit`; keys that were evicted or removed are remembered (the last
    `memory` of them) and stay out while remembered. Rows are tuples that begin with session, segment, revision, final."""

    def __init__(self, limit: int, memory: int):
        self.limit, self.memory, self.rows, self.seen = limit, memory, {}, {}

    def take(self, row: tuple, removed: bool, seq: int) -> None:
        key = row[:2]
        if removed:
            self.rows.pop(key, None)
        elif key in self.rows:
            old = self.rows[key]
            if row[2:4] < old[0][2:4]:
                return
            self.rows[key] = (row, old[1])  # keeps its place
        elif key in self.seen:
            return
        else:
            self.rows[key] = (row, seq)
            if len(self.rows) > self.limit:
                del self.rows[next(iter(self.rows))]
        self.seen.pop(key, None)
        self.seen[key] = None
        if len(self.seen) > self.memory:
            del self.seen[next(iter(self.seen))]

    def newest_first(self) -> list[tuple]:
        """(row, arrived)."""
        return list(self.rows.values())[::-1]


def bounded_history(events: DataFrame, owner: str, schema: str, limit: int = 100, memory: int = 1000) -> DataFrame:
    """Sequential rotation per owner (see Rotation), with arrived and position; schema names the columns to return.

    Rows are sorted within partitions by owner and read in Arrow batches; the state is one owner's list and memory.
    """
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()
    keys = ["session_id", "segment_id", "revision", "is_final"]
    carried = [*keys, *(c for c in names if c not in (*keys, "arrived", "position"))]
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select(*dict.fromkeys([*carried, owner, "removed", "seq"])).repartition(n, owner).sortWithinPartitions(owner, "seq")

    def run(parts):
        now, state = None, None

        def out():
            rows = [dict(zip(carried, row)) | {"arrived": at, "position": i} for i, (row, at) in enumerate(state.newest_first(), 1)]
            return pd.DataFrame(rows, columns=names)

        for p in parts:
            rows = zip(*(p[c].tolist() for c in carried), strict=True)
            for who, row, removed, seq in zip(p[owner].tolist(), rows, p["removed"].tolist(), p["seq"].tolist(), strict=True):
                if state is None or who != now:
                    if state is not None:
                        yield out()
                    now, state = who, Rotation(limit, memory)
                state.take(row, removed, seq)
        if state is not None:
            yield out()

    return ordered.mapInPandas(run, schema)


def drop_repeats(transcripts: DataFrame, session: str, order: str, same: list[str], resets: Column, keep: Column) -> DataFrame:
    """Leave out interim rows equal to the row before them in their session; rows of `keep` (finals) always stay,
    and a row of `resets` (a removal) makes the next row count as new."""
    w = Window.partitionBy(session).orderBy(order)
    now = F.struct(*[F.col(c) for c in same])
    before, reset = F.lag(now).over(w), F.coalesce(F.lag(resets).over(w), F.lit(True))
    return transcripts.withColumn("_repeat", F.coalesce((now == before) & ~reset, F.lit(False))).filter(~F.col("_repeat") | keep).drop("_repeat")


def segment_ids(rows: DataFrame, session: str, *order: str) -> DataFrame:
    """Ids 1, 2 .. in order of first emission within a session. Order of display stays with the order columns."""
    return rows.withColumn("new_id", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))


def suppress_removed(rows: DataFrame, removed: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows whose key was not removed, without drafts of keys that have a final."""
    live = rows.join(removed.select(*key).distinct(), key, "left_anti")
    settled = F.max(F.col("is_final").cast("int")).over(Window.partitionBy(*key)) == 1
    return live.withColumn("_settled", settled).filter(F.col("is_final") | ~F.col("_settled")).drop("_settled")


def latest_revision(work: DataFrame, payload: list[str], key: list[str] = KEY) -> DataFrame:
    """Only the newest revision of each key of a work list, in the order the keys came first."""
    return work.groupBy(*key).agg(F.min("seq").alias("queued"), F.max_by(F.struct("revision", "seq", *payload), F.struct("revision", "seq")).alias("row")).select(*key, "queued", "row.*")


def retractions(previous: DataFrame, retained: DataFrame, key: list[str]) -> DataFrame:
    """Captions shown before that no longer stand; by id within a turn, never by text."""
    return previous.join(retained.select(*key).distinct(), key, "left_anti")


def confirmed_and_drafts(confirmed: DataFrame, drafts: DataFrame) -> DataFrame:
    """Confirmed sentences, then drafts, with the columns that order them."""
    return confirmed.withColumn("part", F.lit(0)).unionByName(drafts.withColumn("part", F.lit(1)))


def gap_restart(captions: DataFrame, gaps: DataFrame, session: str = "session_id") -> DataFrame:
    """Removal rows for drafts shown before a gap: epoch is the number of gaps up to a caption, current the last."""
    both = captions.select(session, "seq", "segment_id", "is_final", F.lit(0).alias("gap")).unionByName(gaps.select(session, "seq", F.lit(None).cast("long").alias("segment_id"), F.lit(False).alias("is_final"), F.lit(1).alias("gap")))
    w = Window.partitionBy(session)
    both = both.withColumn("epoch", F.sum("gap").over(w.orderBy("seq", F.desc("gap")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("current", F.sum("gap").over(w))
    own = both.filter("gap = 0").groupBy(session, "segment_id").agg(F.max_by(F.struct("epoch", "current", "is_final"), "seq").alias("last"))
    return own.filter(~F.col("last.is_final") & (F.col("last.epoch") < F.col("last.current"))).select(session, "segment_id", F.col("last.epoch").alias("epoch"), F.lit(True).alias("removed"))


def in_scope(events: DataFrame, active: DataFrame, session: str = "session_id") -> DataFrame:
    """Events of active sessions only."""
    return events.join(active.select(session).distinct(), session, "left_semi")
