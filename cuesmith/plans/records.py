"""Queries over the given tables for sources, record checks, caption lists and failure handling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import text as X
from cuesmith.operators import audio as A
from cuesmith.operators import context as C
from cuesmith.operators import stability as B
from cuesmith.operators import state as T
from cuesmith.plans.captions import changelog, table
from cuesmith.sources import io


def caption_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as tagged JSON messages and read back: session, segment and revision as numbers, and the text."""
    log = changelog(spark, sf_dir)
    message = F.to_json(F.struct(F.when(F.col("removed"), "remove").otherwise("caption").alias("type"), F.col("session_id").cast("string").alias("session_id"), F.col("segment_id").cast("string").alias("segment_id"), F.col("revision").cast("string").alias("revision"), "text", "is_final", "seq", F.lit(1).alias("unknown")))
    rows = io.parsed_events(log.select(message.alias("json")))
    return rows.select("type", io.integer(F.col("session_id")).alias("session_id"), io.integer(F.col("segment_id")).alias("segment_id"), io.integer(F.col("revision")).alias("revision"), "text", "is_final", "seq")


def caption_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption rows with faults on purpose, checked: seq and the reason of the bad ones, seq, revision and status of the others."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    stamp = F.when(seq % 13 == 0, "yesterday").otherwise("2024-01-01T00:00:00Z")
    rows = e.select(
        seq.alias("seq"), stamp.alias("timestamp"), F.lit("s").alias("source_text"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("language"), F.when(seq % 7 == 0, F.repeat(F.lit("k"), F.lit(33))).alias("target_language"),
        F.lit(None).cast("string").alias("status"), F.when(seq % 3 == 0, "failed").alias("translation_status"), F.lit(None).cast("boolean").alias("is_final"), F.when(seq % 11 == 0, "-1").otherwise(F.when(seq % 2 == 0, seq.cast("string"))).alias("revision"),
        F.when(seq % 17 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("session_id"), F.when(seq % 19 == 0, "x").otherwise((seq % 20).cast("string")).alias("segment_id"),
    )
    good, bad = io.canonical_captions(rows)
    none = F.lit(None).cast("string")
    return good.select("seq", "revision", "status", none.alias("reason")).unionByName(bad.select("seq", F.lit(None).cast("long").alias("revision"), none.alias("status"), "reason"))


def recovery_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery lines derived from events, some with unknown fields or values: rows by stage and reason."""
    e = table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "click", "input").when(F.col("event_type") == "view", "asr").when(F.col("event_type") == "purchase", "translation").otherwise("other")
    field = F.when(F.col("event_id") % 9 == 0, '","extra":1,"stage":"').otherwise('","stage":"')
    line = F.concat(F.lit('{"session_id":"'), F.md5(F.col("user_id").cast("string")), field, stage, F.lit('","code":"buffer_recovered","dropped_items":'), F.col("event_id") % 6 - 1, F.lit("}"))
    good, bad = io.checked_recovery(e.select(line.alias("json")))
    rows = good.select("stage", F.lit("").alias("reason")).unionByName(bad.select(F.lit("").alias("stage"), "reason"))
    return rows.groupBy("stage", "reason").agg(F.count("*").alias("n"))


def provider_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as provider envelopes, in either spelling, every third with an interim text beside the final one."""
    t = table(spark, sf_dir, "conversations")
    odd = F.col("turn") % 2 == 1
    final = F.to_json(F.struct(F.col("text")))
    body = F.concat(F.when(odd, '"input_transcription":').otherwise('"inputTranscription":'), final, F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"interimInputTranscription":'), F.to_json(F.struct(F.left("text", F.lit(5)).alias("text"))))).otherwise(""))
    json = F.concat(F.when(odd, '{"server_content":{').otherwise('{"serverContent":{'), body, F.lit("}}"))
    return io.provider_envelopes(t.select("conv_id", "turn", json.alias("json"))).select("conv_id", "turn", "part", "text")


def recognized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as two recognizer segments, the second without word times and in some turns no speech: good ones' words."""
    t = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("array<struct<start:double,end:double,text:string>>")
    words = F.transform(F.split("text", " "), lambda w, i: F.struct((i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.4).cast("double").alias("end"), w.alias("text")))
    silent = F.when(F.col("turn") % 3 == 2, 0.9).otherwise(0.1)
    whole = lambda a, z, text, p, w: F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), text.alias("text"), p.alias("no_speech_prob"), F.lit(-1.5).alias("avg_logprob"), F.lit(1.0).alias("compression_ratio"), w.alias("words"))
    rows = t.select("conv_id", "turn", F.array(whole(0.0, 9.0, F.col("text"), F.lit(0.1), words), whole(9.0, 10.0, F.col("role"), silent, none)).alias("segments"))
    rows = rows.withColumn("segments", F.filter("segments", lambda s: X.good_segment(s["no_speech_prob"], s["avg_logprob"], s["compression_ratio"])))
    return io.recognizer_words(rows, "conv_id", "turn").select("conv_id", "turn", "seg", F.col("start").alias("at"), "text")


def packet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of every kind of size: how many pass, and why the others do not."""
    e = table(spark, sf_dir, "events")
    size = F.when(F.col("event_id") % 5 == 0, 0).when(F.col("event_id") % 7 == 0, 3).when(F.col("event_id") % 1000 == 1, 32002).otherwise(64).cast("int")
    good, bad = A.checked_packets(e.select("user_id", F.when(F.col("event_id") % 11 != 0, F.repeat(F.lit("a"), size).cast("binary")).alias("pcm")))
    rows = good.select("user_id", F.lit("").alias("reason")).unionByName(bad.select("user_id", "reason"))
    return rows.groupBy("user_id", "reason").agg(F.count("*").alias("n"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language codes as they come in, normalized and without region."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 == 1, "KO ").when(F.col("doc_id") % 5 == 2, "zh_Hant").when(F.col("doc_id") % 5 == 3, F.upper("lang"))
    return d.select("doc_id", X.normalized_language(code).alias("input"), X.normalized_language(code, "ko").alias("output"), X.base_language(code).alias("base"))


def envelope_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are the request itself, in a fence or not, beside texts that are none."""
    t = table(spark, sf_dir, "conversations")
    json = F.to_json(F.struct(F.col("text").alias("current_text"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("context")))
    answer = F.when(F.col("turn") % 4 == 0, json).when(F.col("turn") % 4 == 1, json).when(F.col("turn") % 4 == 2, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", X.leaked_envelope(answer).alias("leaked"))


def early_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finals that take the text of a speculative decode of the same window and revision, where that is not empty."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("revision"), F.col("event_type").alias("text"))
    early = e.filter("event_id % 4 < 2").select("user_id", "event_id", (F.col("event_id") % 2).alias("revision"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("early "), "text")).alias("text"))
    return B.reused_early_results(e, early, ["user_id", "event_id", "revision"]).select("user_id", "event_id", "revision", "text", "reused")


def shown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed captions, then the drafts that no removal or final ends."""
    live = T.suppress_removed((log := changelog(spark, sf_dir)).filter("not removed"), log.filter("removed")).select("session_id", "segment_id", "seq", "text", "is_final")
    return T.confirmed_and_drafts(live.filter("is_final").drop("is_final"), live.filter("not is_final").drop("is_final")).select("session_id", "segment_id", "seq", "text", F.col("part").cast("long").alias("part"))


def caption_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of the first half of the log that the second half does not carry on."""
    log = changelog(spark, sf_dir).filter("not removed").select("session_id", "segment_id", "seq")
    half = F.col("seq") % 2 == 0
    keys = ["session_id", "segment_id"]
    return T.retractions(log.filter(half).select(*keys).distinct(), log.filter(~half), keys)


def failure_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a turn's segments, some failed: what is shown, warned of and kept as context."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("segment_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_final"), F.when(F.col("value") > 20, "translation_empty").otherwise("ok").alias("status"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result"))
    return C.failure_policy(rows, "session_id", ["seq"]).select("session_id", "segment_id", "seq", "shown", "warning", "context_ok")


def _brief(prompts: list[str]) -> list[str]:
    """A model that gives no answer to long prompts with context; else a digest stands for the answer."""
    return ["" if not p or (p.startswith("context:") and len(p) > 200) else hashlib.md5(p.encode()).hexdigest() for p in prompts]


def retried_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is asked for again, without its context, where the answer fails its check."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("context: "), "role", F.lit(" "), "text").alias("prompt"))
    out = C.infer_checked(t, _brief, "prompt", lambda c: F.when(c == "", "translation_empty").otherwise("ok"), retry_prompt="text")
    return out.select("conv_id", "turn", F.col("result").alias("answer"), "status")


def _lists(spark: SparkSession, sf_dir: str, entry: Column, broken: Column) -> DataFrame:
    """file, value: JSON arrays of an entry for each of a user's events, 50 event numbers a file; broken ones are cut off."""
    e = table(spark, sf_dir, "events").withColumns({"file": F.concat("user_id", F.lit("/"), F.floor(F.col("event_id") / 50)), "entry": entry})
    files = e.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("event_id", "entry"))).alias("l"), F.first(broken).alias("broken"))
    value = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["entry"]), ","), F.when(F.col("broken"), "").otherwise("]"))
    return files.select("file", value.alias("value"))


def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption histories with junk, fields of a wrong kind and broken files among them: captions by place, and a row for each fault."""
    k = F.col("event_id") % 11
    parts = [
        F.when(k == 7, "").otherwise('"timestamp":"2024-01-01T00:00:00+09:00",'), F.lit('"session_id":"'), F.col("user_id"), F.lit('","segment_id":'), F.when(k == 8, F.concat(F.lit('"'), F.col("event_id") % 5, F.lit('"'))).otherwise((F.col("event_id") % 5).cast("string")),
        F.when(k == 3, ',"is_final":"yes"').when(k == 5, ',"is_final":false').otherwise(""), F.when(k == 6, ',"revision":1.5').otherwise(F.concat(F.lit(',"revision":'), "event_id")), F.lit(',"text":'), F.when(k == 4, "5").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))),
    ]
    entry = F.when(k == 0, '"junk"').when(k == 1, "null").otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    told = io.judged_history(_lists(spark, sf_dir, entry, F.col("user_id") % 7 == 6))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    captions = (good(F.col(c)).alias(c) for c in ("segment_id", "revision", "is_final", "text"))
    return told.select("file", *captions, good(F.col("place").cast("long")).alias("place"), F.when(F.col("reason").isNotNull(), F.col("pos").cast("long")).alias("pos"), "reason")


def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossaries with junk among the terms: terms, and the reason why an entry is left out."""
    k = F.col("event_id") % 7
    pair = lambda source, target: F.concat(F.lit('{"source":'), source, F.lit(',"target":'), target, F.lit("}"))
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    name = quoted(F.lit(" "), F.col("event_type"), F.col("event_id") % 3, F.lit(" "))
    entry = F.when(k == 0, "17").when(k == 1, pair(F.lit("5"), name)).when(k == 2, pair(name, F.lit('" "'))).when(k == 3, pair(F.lit('"a\\nb"'), name)).otherwise(pair(name, quoted("event_type")))
    told = C.judged_terms(io.listed_terms(_lists(spark, sf_dir, entry, F.col("user_id") % 7 == 6)), 5, ["file"])
    term = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    reason = F.when(F.col("pos").isNull(), "file").otherwise(F.col("reason"))  # a file that is no list has no entry
    return told.select("file", F.col("pos").cast("long").alias("pos"), term("source"), term("target"), reason.alias("reason"))


def promoted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finals that take over the result of provisional work, two sources in five having changed since."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("segment_id"), "event_id", F.col("event_type").alias("source"), F.when(F.col("event_id") % 7 > 0, "ko").alias("language"), F.floor(F.col("event_id") / 100).alias("epoch"), (F.col("event_id") % 2).cast("string").alias("context"), (F.col("event_id") % 9 > 0).alias("done"))
    early = e.filter("event_id % 3 < 2").withColumn("source", F.when(F.col("event_id") % 5 < 2, F.upper("source")).otherwise(F.col("source"))).withColumn("result", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    return C.promoted(e, early, "session_id", "segment_id", "event_id").select("session_id", "segment_id", "result")


def session_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption updates of the sessions that had an error."""
    log = changelog(spark, sf_dir)
    return T.in_scope(log, log.filter("text = 'error'")).select("session_id", "segment_id", "seq")


def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal but for case, marks and the variants of some letters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.script_key(F.col("text"), {"é": "e", "ü": "u", "ñ": "n"})).alias("k"))
    return d.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def seam_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut in CJK numerals spelled from their length: what is heard across the cut holds the overlap once or twice."""
    t = table(spark, sf_dir, "conversations")
    digits = F.translate(F.concat(F.length("text").cast("string"), F.lit("0"), (F.col("conv_id") % 1000 + 1000).cast("string"), F.col("turn").cast("string")), "0123456789", "零一二三四五六七八九")
    k = F.right(digits, F.lit(3))
    cuts = t.select("conv_id", "turn", F.concat(F.lit("开始"), digits).alias("previous"), F.concat(k, F.lit("以后的话")).alias("current"))
    heard = t.filter("turn % 3 < 2").select("conv_id", "turn", F.concat(F.lit("开始"), digits, F.when(F.col("turn") % 3 == 1, k).otherwise(""), F.lit("以后的话")).alias("seam"))
    return B.seams(cuts, heard, ["conv_id", "turn"]).select("conv_id", "turn", "decision", "joined")


def _loud(frames: list[bytes]) -> list[float]:
    return [int.from_bytes(f[:2], "little") / 65536 for f in frames]


def voice_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector over frames made of the events' values."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 10).cast("int").alias("a"))
    low, high = F.lpad(F.hex(F.col("a") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("a") / 256) % 256), 2, "0")
    out = A.voice_probability(e.withColumn("pcm", F.unhex(F.repeat(F.concat(low, high), F.lit(320)))), _loud)
    return out.select("user_id", "event_id", "p")


def _named(pcm: list[bytes], languages: list[str]) -> list[tuple[str, str]]:
    return [(f"{len(x)} bytes", "en" if lang == "auto" else lang) for x, lang in zip(pcm, languages, strict=True)]


def recognized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer over windows of audio made of the turns' texts; empty ones are not sent."""
    t = table(spark, sf_dir, "conversations")
    rows = t.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("text").cast("binary")).alias("pcm"), F.when(F.col("turn") % 2 == 0, "auto").otherwise("ko").alias("language"))
    return A.recognized(rows, _named).select("conv_id", "turn", "text", "heard_language")


QUERIES = {f.__name__: f for f in (caption_messages, caption_records, recovery_records, provider_texts, recognized_words, packet_checks, language_codes, envelope_leaks, early_results, shown_list, caption_retractions, failure_policy, retried_work, history_files, glossary_files, promoted_results, session_scope, variant_keys, seam_choice, voice_detector, recognized_windows)}

LOG = "l AS (SELECT user_id AS session_id, event_id % 20 AS segment_id, event_id % 7 AS revision, event_type = 'click' AS is_final, event_type = 'error' AND event_id % 5 = 0 AS removed, event_id AS seq, event_type AS text FROM events)"
LISTS = "e AS (SELECT event_id, user_id, event_type, user_id || '/' || (event_id // 50) AS file, row_number() OVER (PARTITION BY user_id, event_id // 50 ORDER BY event_id) - 1 AS pos, user_id % 7 = 6 AS broken FROM events)"
LIVE = f"{LOG}, a AS (SELECT *, bool_or(is_final) OVER (PARTITION BY session_id, segment_id) AS settled FROM l WHERE NOT removed AND (session_id, segment_id) NOT IN (SELECT (session_id, segment_id) FROM l WHERE removed))"

ORACLES = {
    "caption_messages": f"WITH {LOG} SELECT CASE WHEN removed THEN 'remove' ELSE 'caption' END AS type, session_id, segment_id, revision, text, is_final, seq FROM l",
    "caption_records": """
WITH r AS (SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'session_id' WHEN event_id % 19 = 0 THEN 'segment_id' WHEN event_id % 11 = 0 THEN 'revision' WHEN event_id % 7 = 0 THEN 'target_language' WHEN event_id % 13 = 0 THEN 'timestamp' END AS reason FROM events)
SELECT seq, CASE WHEN reason IS NULL THEN CASE WHEN seq % 2 = 0 THEN seq ELSE 1 END END AS revision, CASE WHEN reason IS NULL THEN CASE WHEN seq % 3 = 0 THEN 'failed' ELSE 'ok' END END AS status, reason FROM r""",
    "recovery_records": """
WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'input' WHEN 'view' THEN 'asr' WHEN 'purchase' THEN 'translation' ELSE 'other' END AS s, event_id % 9 = 0 AS extra, event_id % 6 = 0 AS below FROM events),
b AS (SELECT s, CASE WHEN extra THEN 'field' WHEN s = 'other' THEN 'stage' WHEN below THEN 'dropped_items' ELSE '' END AS reason FROM r)
SELECT CASE WHEN reason = '' THEN s ELSE '' END AS stage, reason, count(*) AS n FROM b GROUP BY 1, 2""",
    "provider_texts": """
SELECT conv_id, turn, 0 AS part, text FROM conversations UNION ALL SELECT conv_id, turn, 1, left(text, 5) FROM conversations WHERE turn % 3 = 0""",
    "recognized_words": """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT conv_id, turn, 0 AS seg, ((i - 1) * 0.5)::DOUBLE AS at, w[i] AS text FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w))) AS i FROM w)
UNION ALL SELECT conv_id, turn, 1, 9.0::DOUBLE, role FROM conversations WHERE turn % 3 <> 2""",
    "packet_checks": """
SELECT user_id, CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 THEN 'empty' WHEN event_id % 7 = 0 THEN 'odd' WHEN event_id % 1000 = 1 THEN 'long' ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1, 2""",
    "language_codes": """
WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh_hant' WHEN 3 THEN lower(lang) END AS c FROM documents)
SELECT doc_id, CASE WHEN coalesce(c, '') = '' THEN 'auto' WHEN c IN ('ko', 'en', 'zh', 'ja') THEN c END AS input, CASE WHEN coalesce(c, '') = '' THEN 'ko' WHEN c IN ('ko', 'en', 'zh', 'ja') THEN c END AS output,
  CASE WHEN coalesce(c, '') = '' THEN 'auto' WHEN c = 'zh_hant' THEN 'zh' ELSE c END AS base FROM c""",
    "envelope_leaks": "SELECT conv_id, turn, turn % 2 = 0 AS leaked FROM conversations",
    "early_results": """
SELECT user_id, event_id, event_id % 3 AS revision, CASE WHEN event_id % 4 = 1 AND event_id % 3 = 1 THEN 'early ' || event_type ELSE event_type END AS text, event_id % 4 = 1 AND event_id % 3 = 1 AS reused FROM events""",
    "shown_list": f"WITH {LIVE} SELECT session_id, segment_id, seq, text, CASE WHEN is_final THEN 0 ELSE 1 END::BIGINT AS part FROM a WHERE is_final OR NOT settled",
    "caption_retractions": f"WITH {LOG} SELECT DISTINCT session_id, segment_id FROM l WHERE NOT removed AND seq % 2 = 0 AND (session_id, segment_id) NOT IN (SELECT (session_id, segment_id) FROM l WHERE NOT removed AND seq % 2 = 1)",
    "failure_policy": """
WITH r AS (SELECT user_id AS session_id, event_id % 10 AS segment_id, event_id AS seq, event_type = 'purchase' AS f, NOT coalesce(value > 20, false) AS ok, 'r' || event_id AS result FROM events)
SELECT session_id, segment_id, seq, CASE WHEN ok THEN result WHEN f THEN '[unavailable]' ELSE last_value(CASE WHEN ok THEN result END IGNORE NULLS) OVER (PARTITION BY session_id, segment_id ORDER BY seq) END AS shown,
  CASE WHEN NOT ok AND f THEN 'translation_empty' END AS warning, ok AND f AS context_ok FROM r""",
    "retried_work": """
SELECT conv_id, turn, CASE WHEN length('context: ' || role || ' ' || text) <= 200 THEN md5('context: ' || role || ' ' || text) WHEN text = '' THEN '' ELSE md5(text) END AS answer,
  CASE WHEN text = '' AND length('context: ' || role || ' ' || text) > 200 THEN 'translation_empty' ELSE 'ok' END AS status FROM conversations""",
    "history_files": f"""
WITH {LISTS}, k AS (SELECT *, event_id % 11 AS k FROM e),
g AS (SELECT * FROM k WHERE NOT broken AND k NOT IN (0, 1, 3, 4, 6, 7) QUALIFY row_number() OVER (PARTITION BY file, event_id % 5 ORDER BY event_id) = 1)
SELECT file, event_id % 5 AS segment_id, event_id AS revision, k <> 5 AS is_final, event_type AS text, row_number() OVER (PARTITION BY file ORDER BY event_id) AS place, NULL::BIGINT AS pos, NULL AS reason FROM g
UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, pos, CASE k WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 3 THEN 'is_final' WHEN 4 THEN 'text' WHEN 6 THEN 'revision' ELSE 'timestamp' END FROM k WHERE NOT broken AND k IN (0, 1, 3, 4, 6, 7)
UNION ALL SELECT DISTINCT file, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL, NULL::BIGINT, NULL::BIGINT, 'file' FROM k WHERE broken""",
    "glossary_files": f"""
WITH {LISTS}, r AS (SELECT *, event_id % 7 AS k, event_type || (event_id % 3) AS source FROM e WHERE NOT broken),
m AS (SELECT *, CASE WHEN pos >= 5 THEN 'beyond' WHEN k IN (0, 1, 3) THEN 'source' WHEN k = 2 THEN 'target' END AS reason FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY file, source, reason IS NULL ORDER BY pos) AS n FROM m)
SELECT file, pos, CASE WHEN reason IS NULL AND n = 1 THEN source END AS source, CASE WHEN reason IS NULL AND n = 1 THEN event_type END AS target, CASE WHEN reason IS NULL AND n > 1 THEN 'repeated' ELSE reason END AS reason FROM n
UNION ALL SELECT DISTINCT file, NULL::BIGINT, NULL, NULL, 'file' FROM e WHERE broken""",
    "promoted_results": """
WITH e AS (SELECT user_id, event_id, event_id // 100 AS epoch, event_id % 9 > 0 AS done FROM events),
f AS (SELECT *, coalesce(bool_or(NOT done) OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM e)
SELECT user_id AS session_id, event_id AS segment_id, CASE WHEN NOT held AND event_id % 3 < 2 AND event_id % 5 >= 2 THEN 'r' || event_id END AS result FROM f""",
    "session_scope": f"WITH {LOG} SELECT session_id, segment_id, seq FROM l WHERE session_id IN (SELECT session_id FROM l WHERE text = 'error')",
    "variant_keys": """
WITH d AS (SELECT doc_id, md5(translate(regexp_replace(lower(text), '[\\s\\p{Z}\\p{P}]+', '', 'g'), 'éüñ', 'eun')) AS k FROM documents)
SELECT k, count(*) AS copies, min(doc_id) AS first_doc FROM d GROUP BY 1""",
    "voice_detector": "SELECT user_id, event_id, (CAST(floor(value * 10) AS BIGINT) % 65536 / 65536.0)::DOUBLE AS p FROM events",
    "recognized_windows": """
SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND strlen(text) > 0 THEN strlen(text) || ' bytes' ELSE '' END AS text,
  CASE WHEN turn % 2 = 1 THEN 'ko' WHEN turn % 4 <> 3 AND strlen(text) > 0 THEN 'en' ELSE 'auto' END AS heard_language FROM conversations""",
}
