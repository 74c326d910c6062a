"""Queries over the given tables for changelogs, context, routing and text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import sentences as S
from cuesmith.functions import text as X
from cuesmith.operators import context as C
from cuesmith.operators import state as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as caption updates: 20 segments a user, clicks final, every fifth error a removal."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 20).alias("segment_id"), (F.col("event_id") % 7).alias("revision"), (F.col("event_type") == "click").alias("is_final"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("removed"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), "value",
    )


def caption_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.caption_state(changelog(spark, sf_dir), ["text", "value"])


def caption_latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_k(caption_state(spark, sf_dir), 2, ["session_id"]).select("session_id", "segment_id", "arrived", "revision", "text", "position")


def caption_latest_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = caption_state(spark, sf_dir).orderBy(F.desc("arrived"), F.desc("session_id"), F.desc("segment_id")).limit(100)
    return top.select("session_id", "segment_id", "arrived", "revision", "text")


def caption_history_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir).withColumn("owner", F.col("session_id") % 16)
    return T.bounded_history(log, "owner", "owner long, session_id long, segment_id long, revision long, is_final boolean, arrived long, position long", 100, 1000)


def transcript_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    final, reset = F.col("event_type") == "purchase", F.col("event_type") == "error"
    return T.drop_repeats(e, "user_id", "event_id", ["event_type"], reset, final)


def latest_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_revision(changelog(spark, sf_dir), ["text", "is_final"])


def live_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return T.suppress_removed(log.filter("not removed"), log.filter("removed")).select("session_id", "segment_id", "seq", "is_final", "text")


def gap_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return T.gap_restart(log.filter("text <> 'error'"), log.filter("text = 'error'"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def context_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.prior_context(turns(spark, sf_dir), ["conv_id"], ["turn"], "text", F.col("role") == "user")
    return out.select("conv_id", "turn", F.array_join("context", "|").alias("context"), F.size("context").cast("long").alias("n_context"))


def rolling_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rolling_prompt(turns(spark, sf_dir), ["conv_id"], ["turn"], "text", 500).select("conv_id", "turn", "prompt")


def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.segment_ids(turns(spark, sf_dir).select("conv_id", "turn", "role"), "conv_id", "turn")


TERMS = ["the", "ing", "ent", "der", "que", "token", "MIT License", "License", "MIT", "Released under", "the MIT License", "los", "est", "tion", "and", "sch"]


def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(i, t, t.upper()) for i, t in enumerate(TERMS)], "pos int, source string, target string")
    return C.match_glossary(table(spark, sf_dir, "documents"), C.glossary(entries)[0], "doc_id")


def glossary_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of all words of the benchmark, as many as there are, against all texts."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("source")).distinct()
    terms = words.select(F.col("source").alias("pos"), "source", F.upper("source").alias("target"))
    return C.match_catalog(table(spark, sf_dir, "documents"), terms, "doc_id").select("doc_id", "source", "target", F.col("place").cast("long").alias("place"))


def work_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 3 == 0, "auto").otherwise(F.col("lang"))
    out = d.select("doc_id", X.source_language(F.col("text"), code).alias("source_language"), X.route(F.col("text"), code, F.lit("en"), F.lit("/models/HY-MT2-7B.gguf")).alias("route"))
    return out


def memo_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    work = t.select("conv_id", "turn", "role", "text").unionByName(t.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", "role", "text"))
    return C.memoized(work, ["role", "text"], lambda d: C.infer(d, lambda texts: [x.upper() if x.isascii() else x for x in texts], "text")).select("conv_id", "turn", F.md5("result").alias("result_md5"))


def output_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000).alias("id"), F.col("html").alias("text")))
    return d.select("id", X.output_status(F.col("text"), "en").alias("status"), F.length(X.neutral_tokens(F.col("text"))).cast("long").alias("n_neutral"))


def key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.sentence_key(F.col("text"))).alias("k"))
    return d.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def sentence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_corpus(table(spark, sf_dir, "documents"), "doc_id")


def sentence_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.length(F.regexp_replace("sentence", r"[\s\p{Z}]+", ""))
    return sentence_corpus(spark, sf_dir).groupBy("doc_id").agg(F.sum(per).cast("long").alias("n_visible"))


def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", X.reading_ms(F.col("text"), F.col("turn")).alias("ms"))


def short_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", X.short_fragment(F.col("text")).alias("short"), X.meaningful_clause(F.col("text")).alias("clause"))


QUERIES = {f.__name__: f for f in (caption_state, caption_latest_k, caption_latest_100, caption_history_bounded, transcript_dedup, latest_work, live_captions, gap_retractions, context_asof, rolling_prompt, segment_ids, glossary_match, glossary_catalog, work_routing, memo_infer, output_qa, key_duplicates, sentence_corpus, sentence_conservation, reading_time, short_turns)}

LOG = """
log AS (
  SELECT user_id AS session_id, event_id % 20 AS segment_id, event_id % 7 AS revision, event_type = 'click' AS is_final,
    event_type = 'error' AND event_id % 5 = 0 AS removed, event_id AS seq, event_type AS text, value FROM events)
"""
STATE = f"""{LOG},
state AS (
  SELECT session_id, segment_id, revision, is_final, seq, text, value,
    min(seq) OVER (PARTITION BY session_id, segment_id) AS arrived,
    row_number() OVER (PARTITION BY session_id, segment_id ORDER BY revision DESC, is_final DESC, seq DESC) AS r
  FROM log a WHERE NOT removed AND NOT EXISTS (SELECT 1 FROM log b WHERE b.removed AND b.session_id = a.session_id AND b.segment_id = a.segment_id))
"""

_TERM_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))

ORACLES = {
    "caption_state": f"WITH {STATE} SELECT session_id, segment_id, arrived, revision, is_final, seq, text, value FROM state WHERE r = 1",
    "caption_latest_k": f"""WITH {STATE}
SELECT session_id, segment_id, arrived, revision, text, CAST(row_number() OVER (PARTITION BY session_id ORDER BY arrived DESC, session_id DESC, segment_id DESC) AS INTEGER) AS position
FROM state WHERE r = 1 QUALIFY position <= 2""",
    "caption_latest_100": f"WITH {STATE} SELECT session_id, segment_id, arrived, revision, text FROM state WHERE r = 1 ORDER BY arrived DESC, session_id DESC, segment_id DESC LIMIT 100",
    "transcript_dedup": """
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
WHERE b IS NULL OR b <> event_type OR b = 'error' OR event_type = 'purchase'""",
    "latest_work": f"""WITH {LOG}
SELECT session_id, segment_id, min(seq) AS queued, max(revision) AS revision, arg_max(seq, (revision, seq)) AS seq, arg_max(text, (revision, seq)) AS text, arg_max(is_final, (revision, seq)) AS is_final
FROM log GROUP BY 1, 2""",
    "live_captions": f"""WITH {LOG},
a AS (SELECT * FROM log x WHERE NOT removed AND NOT EXISTS (SELECT 1 FROM log b WHERE b.removed AND b.session_id = x.session_id AND b.segment_id = x.segment_id)),
s AS (SELECT *, bool_or(is_final) OVER (PARTITION BY session_id, segment_id) AS settled FROM a)
SELECT session_id, segment_id, seq, is_final, text FROM s WHERE is_final OR NOT settled""",
    "gap_retractions": f"""WITH {LOG},
g AS (SELECT *, count(*) FILTER (text = 'error') OVER (PARTITION BY session_id ORDER BY seq) AS epoch, count(*) FILTER (text = 'error') OVER (PARTITION BY session_id) AS cur FROM log),
l AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_id ORDER BY seq DESC) AS r FROM g WHERE text <> 'error')
SELECT session_id, segment_id, epoch, true AS removed FROM l WHERE r = 1 AND NOT is_final AND epoch < cur""",
    "context_asof": """
WITH ok AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user'),
p AS (
  SELECT c.conv_id, c.turn, ok.t, ok.turn AS at, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY ok.turn DESC) AS r
  FROM conversations c LEFT JOIN ok ON ok.conv_id = c.conv_id AND ok.turn < c.turn),
w AS (
  SELECT conv_id, turn, max(CASE WHEN r = 1 THEN t END) AS a, max(CASE WHEN r = 2 THEN t END) AS b, max(CASE WHEN r = 3 THEN t END) AS c FROM p WHERE r <= 3 GROUP BY 1, 2),
f1 AS (SELECT *, coalesce(a <> '' AND length(a) <= 900, false) AS ka FROM w),
f2 AS (SELECT *, CASE WHEN ka THEN length(a) ELSE 0 END AS ua FROM f1),
f3 AS (SELECT *, coalesce(b <> '' AND ua + length(b) + CASE WHEN ka THEN 1 ELSE 0 END <= 900, false) AS kb FROM f2),
f4 AS (SELECT *, ua + CASE WHEN kb THEN length(b) + CASE WHEN ka THEN 1 ELSE 0 END ELSE 0 END AS ub FROM f3),
f5 AS (SELECT *, coalesce(c <> '' AND ub + length(c) + CASE WHEN ka OR kb THEN 1 ELSE 0 END <= 900, false) AS kc FROM f4)
SELECT conv_id, turn, concat_ws('|', CASE WHEN kc THEN c END, CASE WHEN kb THEN b END, CASE WHEN ka THEN a END) AS context,
  CAST(kc AS BIGINT) + CAST(kb AS BIGINT) + CAST(ka AS BIGINT) AS n_context
FROM f5""",
    "rolling_prompt": """
SELECT a.conv_id, a.turn, right(coalesce(string_agg(trim(b.text), ' ' ORDER BY b.turn) FILTER (trim(b.text) <> ''), ''), 500) AS prompt
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn GROUP BY 1, 2""",
    "segment_ids": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS new_id FROM conversations",
    "glossary_match": rf"""
WITH g(pos, source) AS (VALUES {_TERM_ROWS}),
h AS (
  SELECT doc_id, g.source, upper(g.source) AS target, pos FROM documents, g
  WHERE contains(text, g.source) AND regexp_matches(text, '(^|[^A-Za-z0-9_])\Q' || g.source || '\E($|[^A-Za-z0-9_])'))
SELECT doc_id, source, target, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(source) DESC, pos) AS INTEGER) AS place FROM h QUALIFY place <= 20""",
    "glossary_catalog": """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS source FROM benchmark),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS source FROM documents)
SELECT doc_id, source, upper(source) AS target, row_number() OVER (PARTITION BY doc_id ORDER BY length(source) DESC, source) AS place FROM w JOIN t USING (source) QUALIFY place <= 20""",
    "work_routing": r"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE lang END AS code FROM documents),
s AS (SELECT *, CASE WHEN code <> 'auto' THEN code WHEN regexp_matches(text, '[\x{3040}-\x{30ff}]') THEN 'ja' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[\x{ac00}-\x{d7af}]') THEN 'ko' ELSE 'en' END AS src FROM d)
SELECT doc_id, src AS source_language,
  CASE WHEN regexp_matches(text, '^[\s\p{Z}\p{P}\p{S}]*$') AND trim(text) <> '' AND length(trim(text)) <= 32 THEN 'literal' WHEN code = 'en' THEN 'passthrough' WHEN src NOT IN ('ko', 'en', 'zh', 'ja') THEN 'reject' ELSE 'hymt2' END AS route
FROM s""",
    "memo_infer": r"""
WITH w AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id + 1000000, turn, text FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(text, '[^\x00-\x7f]') THEN text ELSE upper(text) END) AS result_md5 FROM w""",
    "output_qa": r"""
WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id + 10000000, html FROM pages),
b AS (SELECT id, text, regexp_replace(trim(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')), '(?i)^(?:English(?:\s+translation)?|Translation)\s*[:：]\s*', '') AS body FROM d)
SELECT id, CASE WHEN trim(body) = '' OR contains(body, '<think>') OR regexp_matches(body, '^[\s\p{Z}\p{P}\p{S}]*$') THEN 'translation_empty'
  WHEN regexp_matches(body, '^[\s\p{Z}\p{N}\p{P}\p{S}\p{M}A-Za-z\x{c0}-\x{24f}]*$') AND regexp_matches(body, '[A-Za-z\x{c0}-\x{24f}]') THEN 'ok' ELSE 'translation_language' END AS status,
  length(regexp_replace(text, '<(\|?[A-Za-z_][A-Za-z0-9_./:|+-]*\|?)>', '＜\1＞', 'g')) AS n_neutral
FROM b""",
    "key_duplicates": r"""
WITH k AS (SELECT doc_id, md5(regexp_replace(lower(text), '[\s\p{Z}\p{P}]+', '', 'g')) AS k FROM documents)
SELECT k, count(*) AS copies, min(doc_id) AS first_doc FROM k GROUP BY k HAVING count(*) > 1""",
    "sentence_conservation": r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS n_visible FROM documents WHERE length(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) > 0",
    "reading_time": r"""
SELECT conv_id, turn, greatest(650.0, least(3500.0, 500 + 75.0 * length_grapheme(regexp_replace(text, '\s+', '', 'g'))))::DOUBLE * CASE WHEN turn >= 6 THEN 0.8::DOUBLE WHEN turn >= 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS ms
FROM conversations""",
    "short_turns": r"""
WITH t AS (SELECT conv_id, turn, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n, len(list_filter(regexp_split_to_array(trim(text), '[\s\p{Z}]+'), lambda w: w <> '')) AS words FROM conversations)
SELECT conv_id, turn, words <= 2 AND n <= 24 AS short, words >= 4 AS clause FROM t""",
}
