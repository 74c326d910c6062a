"""Structured Streaming forms of the batch operators: the same folds and rules over streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuesmith.operators.audio import DEFAULT, WINDOW, Cutting, fold_frames

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Folded(StatefulProcessor):
    """Keeps a JSON state a key; step(state or None, rows) gives (rows out, state)."""

    def __init__(self, step: Callable, columns: list[str], key: str, order: list[str]):
        self.step, self.columns, self.key, self.order = step, columns, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        old = json.loads(self.state.get()[0]) if self.state.exists() else None
        out, new = self.step(old, batch)
        self.state.update((json.dumps(new),))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, step: Callable, schema: str, order: list[str]) -> DataFrame:
    from pyspark.sql.types import StructType

    full = f"{key} {dict(rows.dtypes)[key]}, {schema}"
    names = StructType.fromDDL(full).fieldNames()
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(_Folded(step, names, key, order), full, "append", "none")


def utterances(frames: DataFrame, stream: str, index: str = "frame_idx", voiced: str = "voiced", cut: Cutting = DEFAULT) -> DataFrame:
    """Windows as they close; frames of a stream must arrive in order of batches. The state is six numbers a stream."""

    def step(state: dict | None, batch: pd.DataFrame) -> tuple[list[tuple], dict]:
        return fold_frames(zip(batch[index].tolist(), batch[voiced].tolist(), [False] * len(batch), strict=True), cut, state)

    return _stateful(frames, stream, step, WINDOW, [index])


def throttled(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Times of the rows that pass a greedy throttle by key."""

    def step(state: dict | None, batch: pd.DataFrame) -> tuple[list[tuple], dict]:
        last, out = (state or {}).get("last"), []
        for t in batch[at].tolist():
            if last is None or t - last >= gap:
                last = t
                out.append((t,))
        return out, {"last": last}

    return _stateful(rows, key, step, f"{at} {dict(rows.dtypes)[at]}", [at])


class _Captions(StatefulProcessor):
    """Revision, finality and removal of each segment of a session, an entry of its own: a batch reads and writes the entries of
    its own segments only."""

    def __init__(self, columns: list[str], ttl_ms: int | None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "segment_id long", "revision long, is_final boolean, removed boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        now, out = {}, []
        for values in zip(*(batch[c].tolist() for c in self.columns[1:]), strict=True):
            segment, revision, final, _, removed, _ = values
            if segment not in now:
                now[segment] = self.seen.getValue((segment,)) if self.seen.containsKey((segment,)) else None
            old = now[segment]
            if old is not None and (old[2] or not removed and (revision, final) < (old[0], old[1])):
                continue
            now[segment] = (int(revision), bool(final), bool(removed))
            out.append((key[0], *values))
        for segment in {r[1] for r in out}:
            self.seen.updateValue((segment,), now[segment])
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def caption_changes(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Accepted caption rows by session as they change: a removed segment never returns, a draft never follows the
    final of its revision. What a session remembers of a segment goes ttl_ms after its last accepted row (None: never); a
    segment that comes again after that is new. Rows with a null key are left out. With ttl_ms Spark runs batches as long as
    the query does, so a trigger that waits for the end (availableNow) has none."""
    names = ["session_id", "segment_id", "revision", "is_final", "text", "removed", "seq"]
    rows = events.filter(F.col("session_id").isNotNull() & F.col("segment_id").isNotNull()).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_final", "removed")})
    schema = f"session_id {dict(events.dtypes)['session_id']}, segment_id long, revision long, is_final boolean, text string, removed boolean, seq long"
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("session_id").transformWithStateInPandas(_Captions(names, ttl_ms), schema, "append", "none" if ttl_ms is None else "processingTime")


def overload_windows(events: DataFrame, at: str, keys: list[str], seconds: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sums of dropped seconds by keys in event-time windows, closed by a watermark."""
    rows = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), *keys).agg(F.sum(F.greatest(F.lit(0), F.col(seconds))).alias("dropped_seconds"), F.count("*").alias("reports"))


class _Drafts(StatefulProcessor):
    """DraftPublisher with a timer: after each batch of a turn, and each time the timer fires, time passes for what is
    still waiting. A timer is no observation. Rows carry their own clock (t, seconds); a timer's time is the last row's
    and what has passed since it was handled."""

    WAIT_MS = 600

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "state string")

    def _load(self):
        from cuesmith.operators.commit import DraftPublisher

        p, old = DraftPublisher(), json.loads(self.state.get()[0]) if self.state.exists() else {}
        if old:
            p.next_id, p.parts, p.tail = old["next_id"], [tuple(x) for x in old["parts"]], tuple(old["tail"]) if old["tail"] else None
            p.shown = {int(k): tuple(v) for k, v in old["shown"].items()}
        return p, old

    def _keep(self, p, seq: int, t: float, at: int, now: int) -> None:
        waiting = any(n >= 2 and (i not in p.shown or p.shown[i][1] != text) for i, (text, _, n) in enumerate(p.parts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(now + self.WAIT_MS)
        self.state.update((json.dumps({"next_id": p.next_id, "parts": p.parts, "tail": p.tail, "shown": p.shown, "seq": seq, "t": t, "at": at}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, _ = self._load()
        batch, out = pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"), []
        for r in batch:
            out += [(key[0], r["seq"], *u) for u in p.row(r)["updates"]]
        now = timerValues.getCurrentProcessingTimeInMs()
        self._keep(p, int(batch[-1]["seq"]), float(batch[-1]["t"]), now, now)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p, old = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        out = [(key[0], old["seq"], *u) for u in p.row({"kind": "tick", "t": old["t"] + (now - old["at"]) / 1000, "text": ""})["updates"]]
        self._keep(p, old["seq"], old["t"], old["at"], now)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def drafts(rows: DataFrame, turn: str = "turn") -> DataFrame:
    """Draft updates of a turn's hypotheses (seq, t, kind, text) as they earn them. A processing-time timer publishes what
    became stable without new rows; a tick row passes time too."""
    schema = f"{turn} {dict(rows.dtypes)[turn]}, seq long, segment_id long, text string, is_final boolean, removed boolean"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(turn).transformWithStateInPandas(_Drafts([turn, "seq", "segment_id", "text", "is_final", "removed"]), schema, "append", "processingTime")
