"""Sources and sinks for event logs, caption histories, recovery logs, glossaries, packets and recognizer output.

Schemas are fixed. Rows that break a rule go to a second DataFrame with a reason.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT = (
    "type string, session_id string, segment_id string, text string, source_text string, translation string, language string, target_language string, status string, translation_status string, "
    "is_final boolean, preview boolean, revision string, code string, message string, timestamp string, seq long"
)
HISTORY = "timestamp string, source_text string, text string, language string, target_language string, status string, translation_status string, is_final boolean, revision string, session_id string, segment_id string"
RECOVERY = "session_id string, stage string, code string, dropped_audio_seconds double, buffer_seconds double, asr_seconds double, translation_seconds double, dropped_items long, queue_items long"
# What recovery rows may hold.
STAGES, CODES = ("input", "asr", "translation", "session"), ("input_backlog_dropped", "asr_backlog_dropped", "translation_backlog_dropped", "buffer_recovered", "session_error")
SEGMENT = "start double, `end` double, text string, no_speech_prob double, avg_logprob double, compression_ratio double, words array<struct<start:double,`end`:double,text:string>>"


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Tagged JSON messages, one a line, as one wide row each; unknown fields are dropped."""
    reader = (spark.readStream if streaming else spark.read).schema(EVENT)
    return reader.json(path)


def parsed_events(lines: DataFrame, json: str = "json") -> DataFrame:
    """The same rows from a column of messages; a line that is no JSON has nulls."""
    return lines.select(F.from_json(F.col(json), EVENT).alias("m")).select("m.*")


def integer(c: Column) -> Column:
    """Digits (at most 19) as a long within 0 .. 2**63 - 1, else null."""
    return F.when(c.rlike(r"^[0-9]{1,19}$"), c.try_cast("long"))


def judged_captions(rows: DataFrame) -> DataFrame:
    """Captions from rows of HISTORY, with the reason of bad ones or null: enumerated fields, defaults, bounds, digit strings as
    numbers, status from translation_status and then ok."""
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    limits = {"session_id": 128, "source_text": 6000, "text": 6000, "language": 32, "target_language": 32, "status": 64}
    out = rows.select(
        *[c for c in rows.columns if c in ("seq", "pos")], F.col("timestamp").alias("raw_timestamp"),
        F.when(F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp("timestamp")).alias("timestamp"),
        text("source_text", "").alias("source_text"), text("text", "").alias("text"), text("language", "auto").alias("language"), text("target_language", "ko").alias("target_language"),
        F.coalesce("status", "translation_status", F.lit("ok")).alias("status"), F.coalesce("is_final", F.lit(True)).alias("is_final"),
        integer(F.coalesce("revision", F.lit("1"))).alias("revision"), "session_id", integer(F.col("segment_id")).alias("segment_id"),
    )
    reason = F.when(F.col("session_id").isNull() | (F.trim("session_id") == ""), "session_id").when(F.col("segment_id").isNull(), "segment_id").when(F.col("revision").isNull(), "revision")
    for c, n in limits.items():
        reason = reason.when(F.length(c) > n, c)
    reason = reason.when(F.col("raw_timestamp").isNotNull() & F.col("timestamp").isNull(), "timestamp")
    return out.withColumn("reason", reason)


def canonical_captions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions, bad with reason) of judged_captions()."""
    marked = judged_captions(rows)
    return marked.filter("reason is null").drop("reason", "raw_timestamp"), marked.filter("reason is not null")


#: Bytes of a history and of a glossary file.
HISTORY_BYTES, GLOSSARY_BYTES = 4 << 20, 64 << 10


def listed(files: DataFrame, most_bytes: int) -> DataFrame:
    """file, broken, pos, e (a VARIANT): the entries of files (file, value) that hold a JSON array, each on its own.

    A file that is too large, no JSON or no array is one row with `broken` and no entry.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    parsed = files.select("file", F.when(F.octet_length("value") <= most_bytes, F.try_parse_json(text)).alias("v"))
    array = F.coalesce(F.schema_of_variant("v").startswith("ARRAY<"), F.lit(False))  # null: no JSON
    told = parsed.select("file", (~array).alias("broken"), "v")
    entries = F.when(~F.col("broken"), F.col("v")).cast("array<variant>")
    return told.select("file", "broken", F.posexplode_outer(entries).alias("pos", "e")).filter("broken or pos is not null")


def with_fields(entries: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """entries (with a VARIANT e) with, for each name, its value as a string or null and `wrong_` name, whether the entry has a value of
    another kind. A value is taken out once, its kind is told once: they stand in steps of their own."""
    kept = [c for c in entries.columns if c != "e"]
    raw = entries.select("*", *(F.variant_get(F.col("e"), f"$.{n}", "variant").alias(f"_{n}") for n in kinds))
    told = raw.select("*", *(F.schema_of_variant(f"_{n}").alias(f"_kind_{n}") for n in kinds))
    right = {n: F.coalesce(F.col(f"_kind_{n}").isin(*k), F.lit(False)) for n, k in kinds.items()}
    return told.select(*kept, *(F.when(right[n], F.col(f"_{n}").cast("string")).alias(n) for n in kinds), *((F.col(f"_{n}").isNotNull() & ~right[n]).alias(f"wrong_{n}") for n in kinds), F.col("e"))


# Fields of a caption in a history file and what they hold.
HISTORY_KINDS = {"timestamp": ("STRING",), "source_text": ("STRING",), "text": ("STRING",), "language": ("STRING",), "target_language": ("STRING",), "status": ("STRING",), "translation_status": ("STRING",), "is_final": ("BOOLEAN",), "revision": ("BIGINT", "STRING"), "session_id": ("STRING",), "segment_id": ("BIGINT", "STRING")}


def judged_history(files: DataFrame, limit: int = 100) -> DataFrame:
    """Captions newest first with file, pos and place of files (file, value) with a JSON array each, and rows with a reason for what is
    bad: the first of equal keys, at most `limit` captions a file. Files are read once.

    Entries are judged one by one: an entry that is no object (`object`), a field of another kind (an is_final that is no
    boolean, a number as a text, a null) or a value out of bounds is one bad row and costs no other; a file that is no list is one (`file`).
    """
    rows = with_fields(listed(files, HISTORY_BYTES), HISTORY_KINDS)
    wrong = F.when(F.col("broken"), "file").when(~F.coalesce(F.schema_of_variant("e").startswith("OBJECT<"), F.lit(False)), "object")
    for n in HISTORY_KINDS:
        other = F.col(f"wrong_{n}")
        # a translation_status counts only where there is no status
        wrong = wrong.when(other & F.col("status").isNull() & ~F.col("wrong_status") if n == "translation_status" else other, n)
    wrong = wrong.when(F.col("timestamp").isNull() | (F.length("timestamp") > 48), "timestamp")
    rows = rows.select(F.struct("file", "pos", wrong.alias("wrong")).alias("pos"), *(F.col(n).cast("boolean") if n == "is_final" else F.col(n) for n in HISTORY_KINDS))
    told = judged_captions(rows).withColumns({"reason": F.coalesce("pos.wrong", "reason"), "file": F.col("pos.file"), "pos": F.col("pos.pos")}).drop("raw_timestamp")
    good = F.col("reason").isNull()
    told = told.withColumn("_n", F.row_number().over(Window.partitionBy("file", "session_id", "segment_id", good).orderBy("pos"))).filter(~good | (F.col("_n") == 1)).drop("_n")
    return told.withColumn("place", F.row_number().over(Window.partitionBy("file", good).orderBy("pos"))).filter(~good | (F.col("place") <= limit))


def history_rows(files: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(captions with file and place, bad rows with file, pos, reason) of judged_history()."""
    told = judged_history(files, limit)
    return told.filter("reason is null").drop("reason", "pos"), told.filter("reason is not null").select("file", "pos", "reason")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (file, value); null for one that is not UTF-8. Spark's readers pass over files without a byte."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(F.col("path").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))


def read_history(spark: SparkSession, path: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """history_rows() of the files of a path."""
    return history_rows(_files(spark, path), limit)


def _fs(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop client; a classic session is needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n[8:]), f"{folder}/{n}") for n in names if n.startswith("version="))


def write_state(state: DataFrame, folder: str, version: int, keep: int = 3) -> str:
    """Make state the current version. It is written beside the others under a hidden name and renamed when it is whole: a reader sees a
    version or none of it. A version that is there already (a replayed batch) stays as it is. The last `keep` versions are
    kept, for readers that began before. The rename is atomic on HDFS and local disks; on an object store it is a copy.
    """
    spark, path = state.sparkSession, f"{folder}/version={version:012d}"
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return path
    made = f"{folder}/.made-{uuid.uuid4().hex}"
    state.write.parquet(made)
    if not fs.rename(_fs(spark, made)[1], at):
        fs.delete(_fs(spark, made)[1], True)
        if not fs.exists(at):  # else another writer of the same batch was first
            raise OSError(f"{made} can't be renamed to {path}")
    for _, old in _versions(spark, folder)[: -max(1, keep)]:
        fs.delete(_fs(spark, old)[1], True)
    return path


def read_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version, or None where there is none yet."""
    found = _versions(spark, folder)
    return spark.read.parquet(found[-1][1]) if found else None


def state_sink(folder: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: merge(current state or None, batch) becomes the version of the batch's id. A batch that comes again
    changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if all(n < batch_id for n, _ in _versions(spark, folder)):
            write_state(merge(read_state(spark, folder), batch), folder, batch_id, keep)

    return write


def write_history(captions: DataFrame, file: str, faulty: bool = False, limit: int = 100) -> None:
    """Replace a history file by a JSON array of the captions of lowest `place`, at most `limit`. The new file is written beside the old one
    and renamed. With faulty (the old one had bad rows) that one is kept as file.corrupt, once: a later call without it leaves it alone."""
    spark = captions.sparkSession
    names = [n for n in HISTORY_KINDS if n in captions.columns]
    stamp = {"timestamp": F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")}
    row = F.to_json(F.struct(*(stamp.get(n, F.col(n)).alias(n) for n in names)), {"ignoreNullFields": "false"})
    lines = captions.orderBy("place").limit(limit).agg(F.sort_array(F.collect_list(F.struct("place", row.alias("r")))).alias("l"))
    text = lines.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["r"]), ",\n"), F.lit("]")).alias("value"))
    made = f"{file}.made-{uuid.uuid4().hex}"
    text.coalesce(1).write.text(made)
    fs, at = _fs(spark, file)
    part = next(s.getPath() for s in fs.listStatus(_fs(spark, made)[1]) if s.getPath().getName().startswith("part-"))
    if fs.exists(at):
        kept = _fs(spark, f"{file}.corrupt")[1]
        if faulty:
            fs.delete(kept, False)
            fs.rename(at, kept)
        else:
            fs.delete(at, False)
    fs.rename(part, at)
    fs.delete(_fs(spark, made)[1], True)


def read_recovery(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of recovery logs in JSON lines; a row with an unknown field, a wrong value or no JSON is bad."""
    return checked_recovery(spark.read.text(path).withColumnRenamed("value", "json"))


def checked_recovery(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = [p.strip().split(" ")[0] for p in RECOVERY.split(",")]
    out = lines.withColumn("keys", F.json_object_keys("json")).withColumn("r", F.from_json("json", RECOVERY))
    seconds, counts = [c for c in names if c.endswith("seconds")], [c for c in names if c.endswith("items")]
    has = lambda c: F.array_contains("keys", c)
    reason = F.when(F.col("keys").isNull(), "json").when(F.size(F.array_except("keys", F.array(*map(F.lit, names)))) > 0, "field")
    reason = reason.when(~(has("session_id") & has("stage") & has("code")), "missing").when(~F.coalesce(F.col("r.session_id").rlike("^[0-9a-f]{32}$"), F.lit(False)), "session_id")
    reason = reason.when(~F.coalesce(F.col("r.stage").isin(*STAGES), F.lit(False)), "stage").when(~F.coalesce(F.col("r.code").isin(*CODES), F.lit(False)), "code")
    for c in seconds:
        reason = reason.when(has(c) & ~F.coalesce(F.col(f"r.{c}").between(0, 1e9), F.lit(False)), c)
    for c in counts:
        reason = reason.when(has(c) & ~F.coalesce(F.col(f"r.{c}").between(0, 2**31 - 1), F.lit(False)), c)
    marked = out.withColumn("reason", reason)
    return marked.filter("reason is null").select("r.*"), marked.filter("reason is not null").select("json", "reason")


def append_recovery(rows: DataFrame, folder: str) -> None:
    rows.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").json(folder)


def listed_terms(files: DataFrame) -> DataFrame:
    """file, broken, pos, source, target of files with a JSON array of terms each, see listed(). An entry that is no object, or a field
    that is no text, has nulls, which glossary() in operators.context reports."""
    return with_fields(listed(files, GLOSSARY_BYTES), {"source": ("STRING",), "target": ("STRING",)}).select("file", "broken", "pos", "source", "target")


def glossary_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, pos, source, target; file, reason of files that can't be used) of listed_terms()."""
    rows = listed_terms(files)
    return rows.filter("not broken").drop("broken"), rows.filter("broken").select("file", F.lit("file").alias("reason"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, source, target of the files of a path, see glossary_entries()."""
    return glossary_entries(_files(spark, path))[0]


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """PCM files as packets: stream_id is the folder, seq the order of names."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("stream_id"), "path", F.col("content").alias("pcm"))
    return f.withColumn("seq", F.row_number().over(Window.partitionBy("stream_id").orderBy("path")).cast("long")).drop("path")


def provider_envelopes(lines: DataFrame, json: str = "json") -> DataFrame:
    """lines with part (0 final, 1 interim) and text: one envelope may hold both, in either spelling of its keys."""
    kind = "struct<inputTranscription:struct<text:string,finished:boolean>,input_transcription:struct<text:string,finished:boolean>,interimInputTranscription:struct<text:string>,interim_input_transcription:struct<text:string>>"
    outer = F.from_json(F.col(json), f"serverContent {kind}, server_content {kind}")
    both = lines.withColumn("_c", F.coalesce(outer["serverContent"], outer["server_content"]))
    final = F.coalesce("_c.inputTranscription.text", "_c.input_transcription.text")
    interim = F.coalesce("_c.interimInputTranscription.text", "_c.interim_input_transcription.text")
    rows = both.withColumn("_p", F.explode(F.array(F.struct(F.lit(0).alias("part"), final.alias("text")), F.struct(F.lit(1).alias("part"), interim.alias("text")))))
    return rows.filter("_p.text is not null").select(*lines.columns, "_p.part", "_p.text")


def recognizer_words(segments: DataFrame, *keys: str) -> DataFrame:
    """keys, seg, start, end, text: a row a word; a segment without words is one word. segments has keys and an array
    `segments` of SEGMENT."""
    s = segments.select(*keys, F.posexplode("segments").alias("seg", "s"))
    w = s.select(*keys, "seg", "s", F.explode_outer("s.words").alias("w"))
    return w.select(*keys, "seg", F.coalesce("w.start", "s.start").alias("start"), F.coalesce("w.end", "s.end").alias("end"), F.coalesce("w.text", "s.text").alias("text"))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cues as CSV with a header."""
    return spark.read.schema("clip string, cue int, run int, asr string, mt string, ref string, hyp string, score int").csv(path, header=True)
