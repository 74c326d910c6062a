"""Packets, frames, voice activity and utterance windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.operators.scans import WIDTH, furthest, gaps, last_known, running_sum

FRAME = 320
VOICED_RMS = 0.002
#: Bytes of audio that are squared at a time.
HELD_BYTES = 4 << 20


def checked_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad with reason): PCM of 1 .. 32,000 bytes and even length."""
    n = F.length("pcm")
    reason = F.when(F.col("pcm").isNull() | (n == 0), "empty").when(n % 2 != 0, "odd").when(n > 32000, "long")
    marked = packets.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


#: Samples that a client may report missing at once.
GAP = (1, 57_600_000)


def checked_gaps(gaps: DataFrame, samples: str = "samples") -> tuple[DataFrame, DataFrame]:
    """(good, bad) reports of missing samples: 1 .. 57,600,000 at once."""
    good = F.coalesce(F.col(samples).between(*GAP), F.lit(False))
    return gaps.filter(good), gaps.filter(~good)


def packet_positions(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """packets with start_sample: the samples before them in their stream, by seq. A stream is summed block by block of `width` seqs."""
    out = running_sum(packets, ["stream_id"], ["seq"], F.length("pcm") / 2, "start_sample", width)
    return out.withColumn("start_sample", F.col("start_sample").cast("long"))


def packet_gaps(packets: DataFrame, stream: str, order: list[str], start: str, end: str, width: float = WIDTH) -> DataFrame:
    """packets with missing (samples between the end of the packet before and start) and epoch (gaps so far); block by
    block of `width` of the first order column, which is a number."""
    return gaps(packets, [stream], order, start, end, width)


def gap_totals(gaps: DataFrame, stream: str) -> DataFrame:
    """Missing samples, gaps and the last epoch of each stream."""
    return gaps.groupBy(stream).agg(F.sum("missing").alias("missing"), F.count_if(F.col("missing") > 0).alias("gaps"), F.max("epoch").alias("epoch"))


def frame_energy(packets: DataFrame) -> DataFrame:
    """stream_id, frame_idx, rms, voiced for every whole frame of 320 samples, at absolute sample positions.

    A packet gives each frame it touches the sum of squares of its part; parts meet by (stream, frame), so frames
    that cross packets need no carry and packets may come in any order. Frames with missing samples are left out, as are
    empty packets and those that end inside a sample.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            groups = np.cumsum(size) // HELD_BYTES
            cuts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(size)]):  # packets of about HELD_BYTES at a time
                part, n = batch.slice(a, z - a), size[a:z] // 2
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i2").astype(np.int64)
                start = part.column(1).to_numpy()
                first = start // FRAME
                frames = (start + n - 1) // FRAME - first + 1
                packet = np.repeat(np.arange(len(n)), frames)
                frame = first[packet] + np.arange(len(packet)) - np.repeat(np.cumsum(frames) - frames, frames)
                begin = (np.cumsum(n) - n)[packet] + np.maximum(frame * FRAME - start[packet], 0)
                sums = [np.add.reduceat(x * x, begin), np.diff(np.append(begin, len(x)))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(packet)), pa.array(frame), *map(pa.array, sums)], ["stream_id", "frame_idx", "squares", "n"])

    kind = dict(packets.dtypes)["stream_id"]
    some = packets.filter((F.length("pcm") > 0) & (F.length("pcm") % 2 == 0)).select("stream_id", F.col("start_sample").cast("long"), "pcm")
    rows = some.mapInArrow(parts, f"stream_id {kind}, frame_idx long, squares long, n long")
    whole = rows.groupBy("stream_id", "frame_idx").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n")).filter(F.col("n") == FRAME)
    rms = F.sqrt(F.col("squares") / FRAME) / 32768
    return whole.select("stream_id", "frame_idx", rms.alias("rms"), (rms >= VOICED_RMS).alias("voiced"))


def hysteresis(rows: DataFrame, stream: str, order: list[str], p: Column, on: float = 0.5, off: float = 0.35, rms: Column | None = None, width: float = WIDTH) -> DataFrame:
    """rows with active: on from p >= on, off below off, held between; off where rms is below the voiced level. The state is
    carried block by block of `width` of the first order column, which is a number."""
    state = F.when(p >= on, 1).when(p < off, 0)
    if rms is not None:
        state = F.when(rms < VOICED_RMS, 0).otherwise(state)
    return last_known(rows, [stream], order, state, "active", width).withColumn("active", F.coalesce("active", F.lit(0)) == 1)


def covered_length(spans: DataFrame, stream: str, start: str, end: str, width: float = WIDTH) -> DataFrame:
    """stream, covered: the length of the union of [start, end), by the running furthest end, carried block by block of `width`."""
    rows = furthest(spans, [stream], [start, end], F.col(end), "_reach", width)
    new = rows.withColumn("_from", F.greatest(F.col(start), F.coalesce("_reach", F.col(start))))
    return new.groupBy(stream).agg(F.sum(F.greatest(F.lit(0), F.col(end) - F.col("_from"))).cast("long").alias("covered"))


def islands(spans: DataFrame, stream: str, start: str, end: str, width: float = WIDTH) -> DataFrame:
    """stream, start, end: the maximal intervals of the union of spans that are not empty; block by block of `width`."""
    some = spans.filter(F.col(end) > F.col(start)).select(stream, start, end).distinct()  # equal rows have no order
    rows = furthest(some, [stream], [start, end], F.col(end), "_reach", width)
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("long"))
    rows = running_sum(rows, [stream], [start, end], F.col("_new"), "_before", width).withColumn("_i", F.col("_before") + F.col("_new"))
    return rows.groupBy(stream, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def lost_samples(lost: DataFrame, kept: DataFrame, stream: str = "stream_id", bin_size: int = 160_000) -> DataFrame:
    """stream, lost: the samples in the union of lost that no kept interval covers.

    Both unions are cut at multiples of bin_size and meet by (stream, bin), so a long stream is spread over tasks
    and no pair of far intervals is looked at.
    """

    def binned(spans: DataFrame, a: str, b: str) -> DataFrame:
        u = islands(spans, stream, "start", "end")
        u = u.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
        return u.select(stream, "bin", F.greatest("start", F.col("bin") * bin_size).alias(a), F.least("end", (F.col("bin") + 1) * bin_size).alias(b))

    x, y = binned(lost, "a", "b"), binned(kept, "c", "d")
    both = x.join(y, [stream, "bin"]).select(stream, F.greatest(F.lit(0), F.least("b", "d") - F.greatest("a", "c")).alias("n"))
    rows = x.select(stream, (F.col("b") - F.col("a")).alias("n")).unionByName(both.select(stream, (-F.col("n")).alias("n")))
    return rows.groupBy(stream).agg(F.sum("n").cast("long").alias("lost"))


@dataclass(frozen=True)
class Cutting:
    """Frames kept before speech, silence that closes, length that forces a cut, frames carried over a forced cut,
    voiced frames a window needs (and after a forced cut), and whether the end of a stream closes a window."""

    prefix: int = 20
    silence: int = 25
    most: int = 200
    carry: int = 10
    voiced: int = 10
    voiced_after_cut: int = 10
    flush: bool = False


#: The variants: default windows, fast windows with short continuations, windows of 12 s without overlap.
DEFAULT, FAST, LONG = Cutting(), Cutting(voiced_after_cut=1), Cutting(most=600, carry=0, flush=True)


def fold_frames(frames: Iterator[tuple[int, bool, bool]], cut: Cutting, state: dict | None = None) -> tuple[list[tuple], dict]:
    """Windows (first, last, voiced, reason, overlaps) closed by frames (index, voiced, endpoint) in order, and the
    state to go on from. A missing index counts as unvoiced frames."""
    s = dict(state or {"open": -1, "voiced": 0, "silent": 0, "overlap": False, "next": None, "floor": 0})
    out: list[tuple] = []

    def close(at: int, reason: str, forced: bool) -> None:
        least = cut.voiced_after_cut if s["overlap"] else cut.voiced
        if s["voiced"] >= least:
            out.append((s["open"], at, s["voiced"], reason, s["overlap"]))
        if forced:
            s.update(open=at + 1 - cut.carry, voiced=0, silent=0, overlap=True)
            if not cut.carry:
                s.update(open=at + 1, overlap=False)
        else:
            s.update(open=-1, voiced=0, silent=0, overlap=False)
            # frames of a closed window may come again as the prefix of the next
            s["floor"] = at + 1 - cut.prefix

    def one(i: int, voiced: bool, endpoint: bool) -> None:
        if s["open"] < 0:
            if not voiced:
                return
            s["open"] = max(0, i - cut.prefix, s["floor"])
        s["voiced"] += voiced
        s["silent"] = 0 if voiced else s["silent"] + 1
        if s["silent"] >= cut.silence or (endpoint and not voiced):
            close(i, "silence" if s["silent"] >= cut.silence else "endpoint", False)
        elif i - s["open"] + 1 >= cut.most:
            close(i, "maximum", True)

    for i, voiced, endpoint in frames:
        k = i if s["next"] is None else s["next"]
        while k < i and s["open"] >= 0:
            one(k, False, False)
            k += 1
        one(i, bool(voiced), bool(endpoint))
        s["next"] = i + 1
    return out, s


def flush_frames(state: dict, cut: Cutting) -> list[tuple]:
    least = cut.voiced_after_cut if state["overlap"] else cut.voiced
    return [(state["open"], state["next"] - 1, state["voiced"], "end", state["overlap"])] if cut.flush and state["open"] >= 0 and state["voiced"] >= least else []


WINDOW = "first_frame long, last_frame long, n_voiced long, reason string, overlaps_previous boolean"


def utterances(frames: DataFrame, stream: str, index: str = "frame_idx", voiced: str = "voiced", cut: Cutting = DEFAULT, endpoint: str | None = None) -> DataFrame:
    """Utterance windows of every stream, from (stream, index, voiced) alone.

    After 2 * silence - 1 unvoiced frames the fold stands where it began, whatever came before; so streams are
    split there and islands are folded apart: a stream of any length is spread over many tasks.
    """
    apart = 2 * cut.silence - 1
    speech = frames.filter(F.col(voiced) | (F.col(endpoint) if endpoint else F.lit(False)))
    w = Window.partitionBy(stream).orderBy(index)
    new = (F.col(index) - F.lag(index).over(w) - 1 >= apart).cast("long")
    rows = speech.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = frames.groupBy(F.col(stream).alias("_s")).agg(F.max(index).alias("_end"))
    rows = rows.join(ends, F.col(stream) == F.col("_s")).select(stream, "island", F.col(index).alias("i"), F.col(voiced).alias("v"), (F.col(endpoint) if endpoint else F.lit(False)).alias("e"), "_end")
    kind = dict(frames.dtypes)[stream]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, end = pdf["i"].to_numpy(), int(pdf["_end"].iloc[0])
        frames = list(zip(i.tolist(), pdf["v"].tolist(), pdf["e"].tolist(), strict=True))
        last = min(end, int(i[-1]) + apart)
        if last > i[-1]:
            frames.append((last, False, False))
        out, state = fold_frames(frames, cut)
        out += flush_frames(state, cut) if last == end else []
        return pd.DataFrame([(pdf[stream].iloc[0], *r) for r in out], columns=[stream, "first_frame", "last_frame", "n_voiced", "reason", "overlaps_previous"])

    return rows.groupBy(stream, "island").applyInPandas(fold, f"{stream} {kind}, {WINDOW}")


def short_utterances(frames: DataFrame, stream: str, index: str = "frame_idx", voiced: str = "voiced", cut: Cutting = DEFAULT) -> DataFrame:
    """The same windows in SQL for streams whose speech never reaches a forced cut: speech parted by `silence`
    unvoiced frames, from up to `prefix` frames before it to the frame that closes it. Windows at the end of a
    stream that no silence closes are left out, as are those that a forced cut would have touched."""
    w = Window.partitionBy(stream).orderBy(index)
    speech = frames.filter(F.col(voiced))
    speech = speech.withColumn("_new", F.coalesce((F.col(index) - F.lag(index).over(w) - 1 >= cut.silence).cast("long"), F.lit(0)))
    speech = speech.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = speech.groupBy(stream, "_i").agg(F.min(index).alias("a"), F.max(index).alias("z"), F.count("*").alias("n_voiced"))
    ends = frames.groupBy(F.col(stream).alias("_s")).agg(F.max(index).alias("_end"))
    runs = runs.join(ends, F.col(stream) == F.col("_s"))
    last = F.col("z") + cut.silence
    first = F.greatest(F.lit(0), F.col("a") - cut.prefix)
    return runs.filter((last <= F.col("_end")) & (F.col("n_voiced") >= cut.voiced) & (last - first + 1 <= cut.most)).select(stream, first.cast("long").alias("first_frame"), last.cast("long").alias("last_frame"), "n_voiced")


#: Recheck windows: forced after 4 s, once more after a second more.
RECHECK, EXTRA = Cutting(), 50
CHECKED = "first_frame long, last_frame long, n_voiced long, probe boolean, rechecked boolean, forced boolean, overlaps_previous boolean"


def checked_windows(voiced: list[bool], use: Callable[[int, int], bool], cut: Cutting = RECHECK, extra: int = EXTRA) -> list[tuple]:
    """Recognition requests over the frames of one stretch of a stream. A window that reaches `most` frames is first asked
    for as a probe and again (rechecked) with up to `extra` frames more; use(first, last) tells whether the longer one
    counts. If not, the window ends at the probe and the frames behind it are heard again."""
    out: list[tuple] = []
    at, begin, floor, overlap = 0, -1, 0, False
    heard, silent, probed = 0, 0, 0  # voiced frames, unvoiced ones at the end, frames up to the probe
    while at < len(voiced):
        if begin < 0:
            if not voiced[at]:
                at += 1
                continue
            begin = max(floor, at - cut.prefix)
        heard, silent = heard + voiced[at], 0 if voiced[at] else silent + 1
        at += 1
        natural = silent >= cut.silence
        if not natural and at - begin < cut.most + (extra if probed else 0):
            continue
        asked, forced = heard >= cut.voiced, not natural
        probe = asked and forced and not probed
        if asked:
            out.append((begin, at - 1, heard, probe, bool(probed), forced, overlap))
        if probe:
            probed = at
            continue
        if asked and probed and not use(begin, at - 1):
            at, forced = probed, True
        begin, floor, overlap = (at - cut.carry, floor, True) if forced else (-1, at - cut.prefix, False)
        heard = silent = probed = 0
    return out


def rechecked_utterances(frames: DataFrame, stream: str, use: Callable[[int, int], bool], index: str = "frame_idx", voiced: str = "voiced", cut: Cutting = RECHECK, extra: int = EXTRA) -> DataFrame:
    """Requests of checked_windows() for every stream, folded by islands as utterances() does: 2 * silence - 1 unvoiced
    frames end every window, whatever was given back before them."""
    apart = 2 * cut.silence - 1
    w = Window.partitionBy(stream).orderBy(index)
    rows = frames.filter(F.col(voiced)).withColumn("_new", F.coalesce((F.col(index) - F.lag(index).over(w) - 1 >= apart).cast("long"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = frames.groupBy(F.col(stream).alias("_s")).agg(F.max(index).alias("_end"))
    rows = rows.join(ends, F.col(stream) == F.col("_s")).select(stream, "island", F.col(index).alias("i"), "_end")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        i = np.sort(pdf["i"].to_numpy())
        start = max(0, int(i[0]) - cut.prefix)
        bits = np.zeros(min(int(pdf["_end"].iloc[0]), int(i[-1]) + apart) - start + 1, bool)
        bits[i - start] = True
        out = checked_windows(bits.tolist(), lambda a, z: use(a + start, z + start), cut, extra)
        return pd.DataFrame([(pdf[stream].iloc[0], a + start, z + start, *r) for a, z, *r in out], columns=[stream, *(c.split(" ")[0] for c in CHECKED.split(", "))])

    return rows.groupBy(stream, "island").applyInPandas(fold, f"{stream} {dict(frames.dtypes)[stream]}, {CHECKED}")


def voice_probability(frames: DataFrame, detector: Callable[[list[bytes]], list[float]], pcm: str = "pcm", name: str = "p") -> DataFrame:
    """frames with the probability of voice that a pluggable detector gives each frame's PCM, in Arrow batches; see
    hysteresis() for what makes speech of it. A null frame has none."""

    @F.pandas_udf("double")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            some = s.notna()
            out = pd.Series(np.nan, index=s.index, dtype=object).where(some, None)
            out[some] = detector([bytes(x) for x in s[some]])
            yield out.astype("Float64")

    return frames.withColumn(name, call(F.col(pcm)))


def recognized(windows: DataFrame, recognizer: Callable[[list[bytes], list[str]], list[tuple[str, str]]], pcm: str = "pcm", language: str = "language") -> DataFrame:
    """windows with text and heard_language: a pluggable recognizer called on Arrow batches of PCM and languages. Windows
    without audio have an empty text in the language asked for and are not sent."""

    @F.pandas_udf("text string, heard_language string")
    def call(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for audio, asked in parts:
            rows: list[tuple] = [("", x) for x in asked]
            some = [i for i, x in enumerate(audio) if x is not None and len(x)]
            for i, x in zip(some, recognizer([bytes(audio.iloc[i]) for i in some], [asked.iloc[i] for i in some]) if some else [], strict=True):
                rows[i] = x
            yield pd.DataFrame(rows, columns=["text", "heard_language"])

    out = windows.withColumn("_heard", call(F.col(pcm), F.col(language)))
    return out.select(*windows.columns, "_heard.text", "_heard.heard_language")


def window_packets(windows: DataFrame, frames: int = 50, first: str = "first_frame", last: str = "last_frame") -> DataFrame:
    """windows as packets of so many frames (50 are 1 s, 16 are 0.32 s), from_frame .. to_frame; the last may be shorter
    and is marked final."""
    out = windows.withColumn("from_frame", F.explode(F.sequence(F.col(first), F.col(last), F.lit(frames).cast("long"))))
    out = out.withColumn("to_frame", F.least(F.col("from_frame") + (frames - 1), F.col(last)))
    return out.withColumn("final", F.col("to_frame") == F.col(last))
