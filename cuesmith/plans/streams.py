"""Queries over the given tables for packets, voice activity, stability, evaluation and upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from cuesmith.functions import sentences as S
from cuesmith.operators import audio as A
from cuesmith.operators import commit as K
from cuesmith.operators import metrics as M
from cuesmith.operators import scans
from cuesmith.operators import scrub
from cuesmith.operators import stability as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a user as packets of 320 samples with irregular starts."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") * 10 + F.floor("value")
    return e.select(F.col("user_id").alias("stream_id"), "event_id", start.alias("start"), (start + 320).alias("end"))


def packet_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.packet_gaps(_packets(spark, sf_dir), "stream_id", ["event_id"], "start", "end", 2000).select("stream_id", "event_id", "missing", "epoch")


def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gap_totals(packet_gaps(spark, sf_dir), "stream_id")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream_id"), "event_type", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.floor(F.col("value") * 40)).alias("end"))


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.covered_length(_spans(spark, sf_dir), "stream_id", "start", "end")


def lost_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return A.lost_samples(s.filter("event_type <> 'click'"), s.filter("event_type = 'click'"), bin_size=5000)


def vad_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return A.hysteresis(e, "user_id", ["event_id"], F.col("value"), 50.0, 35.0, width=2000).select("user_id", "event_id", "active")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a group of users as voiced bits, in frames by order of event."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("stream_id"), "event_id", (F.col("value") >= 60).alias("loud"))
    w = Window.partitionBy("stream_id").orderBy("event_id")
    # speech comes in stretches: only every third stretch of 60 events may be voiced
    idx = (F.row_number().over(w) - 1).cast("long")
    return e.select("stream_id", idx.alias("frame_idx"), "loud").select("stream_id", "frame_idx", (F.col("loud") & (F.floor(F.col("frame_idx") / 60) % 3 == 0)).alias("voiced"))


def utterances_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.short_utterances(_frames(spark, sf_dir), "stream_id")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utterances(_frames(spark, sf_dir), "stream_id")


def utterances_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utterances(_frames(spark, sf_dir), "stream_id", cut=A.FAST)


def utterances_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 12 s without overlap, which an endpoint may close and never opens; what is open at the end closes too."""
    frames = _frames(spark, sf_dir).withColumn("endpoint", F.col("frame_idx") % 97 == 0)
    return A.utterances(frames, "stream_id", cut=A.LONG, endpoint="endpoint")


def _longer(first: int, last: int) -> bool:
    """Whether the recheck of a window counts, as a recognizer would tell."""
    return (first + last) % 3 != 0


def utterances_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4 s that are looked at once more with a second more, a third of which is given back."""
    return A.rechecked_utterances(_frames(spark, sf_dir), "stream_id", _longer)


def window_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows cut into packets of 0.32 s."""
    return A.window_packets(utterances_short(spark, sf_dir), 16).select("stream_id", "first_frame", "from_frame", "to_frame", "final")


def gap_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of missing samples by stream, good and bad."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 > 0, (F.floor("value") - 5) * 1_000_000).alias("samples"))
    good, bad = A.checked_gaps(e)
    return good.groupBy("user_id").agg(F.count("*").alias("n"), F.lit(True).alias("good")).unionByName(bad.groupBy("user_id").agg(F.count("*").alias("n"), F.lit(False).alias("good")))


def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 480 samples, each of one amplitude from the event's value."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).cast("int").alias("a"))
    low, high = F.lpad(F.hex(F.col("a") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("a") / 256) % 256), 2, "0")
    packets = A.packet_positions(e.select("stream_id", "seq", F.unhex(F.repeat(F.concat(low, high), F.lit(480))).alias("pcm")))
    return A.frame_energy(A.checked_packets(packets)[0])


def shown(obs: Column) -> Column:
    """Sentences that an observation shows at most: one more each time up to 6, then twice as many each time."""
    return F.when(obs <= 6, obs).otherwise(F.lit(6).cast("long") * F.pow(F.lit(2.0), obs - 6).cast("long"))


def first_shown(pos: Column) -> Column:
    """The first observation that shows the sentence at pos."""
    return F.when(pos < 6, pos + 1).otherwise(6 + F.length(F.bin(F.floor(pos / 6)))).cast("long")


def heard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn, sentences, n, whole (the first observation with all sentences) and observed (the last one: three later,
    so that the last sentences can become stable too). All of a turn stays in one partition."""
    d = S.split_documents(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("turn"), F.col("sentences.text").alias("sentences"))
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "turn").withColumn("n", F.size("sentences").cast("long")).filter("n > 0")
    d = d.withColumn("whole", first_shown(F.col("n") - 1))
    return d.withColumn("observed", F.greatest(F.lit(6).cast("long"), F.col("whole") + 3))


def cut_short(last: Column, obs: Column, whole: Column) -> Column:
    """The last sentence of an observation, cut short at odd observations that show it for the first time."""
    return F.when((obs % 2 == 1) & (obs <= whole), F.left(last, F.greatest(F.lit(1), F.length(last) - 3))).otherwise(last)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What commit folds and publishers hear: growing hypotheses over all sentences of a document, 0.4 s apart; at odd
    observations the last one is cut short. The steps grow, so a document of n sentences gives a number of rows in proportion to n."""
    d = heard_documents(spark, sf_dir).select("turn", "n", "whole", "observed", F.posexplode("sentences").alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    grown = d.withColumn("obs", F.explode(F.sequence(first_shown(F.col("pos")), F.col("observed")))).withColumn("t", F.col("obs") * 0.4)
    last = F.col("pos") == F.least(shown(F.col("obs")), F.col("n")) - 1
    return grown.select("turn", "pos", F.when(last, cut_short(F.col("text"), F.col("obs"), F.col("whole"))).otherwise(F.col("text")).alias("text"), "obs", "t")


def growing(sentences: list[str]) -> Iterator[tuple[int, float, list[tuple[int, str]]]]:
    """Observations of a document, 0.4 s apart, as what changes from one to the next: observation o shows the first o
    sentences, at odd ones with the last cut short. Three follow the last sentence, so that it can become stable too."""
    n = len(sentences)
    for obs in range(1, max(6, n + 3) + 1):
        changes = [(obs - 2, sentences[obs - 2])] if 2 <= obs <= n + 1 else []
        if obs <= n:
            last = sentences[obs - 1]
            changes.append((obs - 1, last[: max(1, len(last) - 3)] if obs % 2 else last))
        yield obs, obs * 0.4, changes


def stable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of all sentences of growing documents, an observation for each sentence. A document is moved once, before it is
    split, and folded where it is split."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("turn"), "text")
    schema = f"turn {dict(d.dtypes)['turn']}, pos long, obs long, t double, text string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = ((turn.as_py(), growing([s for s, _ in S.split(text.as_py())])) for batch in batches for turn, text in zip(*batch.columns))
        rows = ((turn, *x) for turn, heard in docs for x in B.stable_changes(heard))
        while out := list(islice(rows, K.OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    # dealt by document: a file of few row groups would be a few tasks' work
    return d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "turn").mapInArrow(run, schema)


def stable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule over conversations: whole turns as sentences, one more each time up to 6, then twice as many; every
    fourth turn is in doubt (upper case) at odd observations."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("turn"), F.col("turn").cast("long").alias("pos"), "text")
    grown = c.withColumn("obs", F.explode(F.sequence(first_shown(F.col("pos")), first_shown(F.col("pos")) + 5))).withColumn("t", F.col("obs") * 0.4)
    odd = (F.col("pos") % 4 == 3) & (F.col("obs") % 2 == 1)
    return B.stable_prefixes(grown.withColumn("text", F.when(odd, F.upper("text")).otherwise(F.col("text"))))


def stable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over all words of all turns: turn (conv_id * 1000 + turn), pos, obs, t, text. Observation o shows words
    1 .. 3o up to 18, then twice as many each time; as in observations(), three follow the last word."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), F.split("text", " ").alias("words"))
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "turn")
    first = lambda pos: first_shown(F.floor(pos / 3))
    words = c.select("turn", F.size("words").cast("long").alias("n"), F.posexplode("words").alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    grown = words.withColumn("obs", F.explode(F.sequence(first(F.col("pos")), F.greatest(F.lit(5).cast("long"), first(F.col("n") - 1) + 3)))).withColumn("t", F.col("obs") * 0.4)
    odd = (F.col("pos") % 5 == 3) & (F.col("obs") % 2 == 1) & (F.col("obs") <= first(F.col("n") - 1))
    return B.stable_prefixes(grown.withColumn("text", F.when(odd, F.upper("text")).otherwise(F.col("text"))))


def local_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("key", F.lower(F.regexp_replace("text", r"[^A-Za-z]+", "")))
    return B.local_agreement(c, ["conv_id"], "turn", "key").select("conv_id", "turn", "agreed")


def overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the last 20 characters of the turn before put in front, on every second turn marked as a cut."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    tail = F.right(F.trim(F.lag("text").over(w)), F.lit(20))
    rows = c.select("conv_id", "turn", F.when((F.col("turn") % 2 == 1) & F.lag("text").over(w).isNotNull(), F.concat(tail, F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    return B.with_cjk(rows, ["conv_id"], ["turn"], "text", F.col("turn") % 2 == 1).select("conv_id", "turn", F.md5("trimmed").alias("trimmed_md5"), F.length("trimmed").cast("long").alias("n"))


def reconcile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of a document, in turns of 40 that are aligned each for itself; a turn has 100 ids of its own."""
    s = S.sentence_corpus(table(spark, sf_dir, "documents"), "doc_id")
    place, text = F.col("pos") % 40, F.col("sentence")
    final = F.struct(F.lit(None).cast("long").alias("segment_id"), text.alias("text"), F.lit(True).alias("final"))
    draft = F.struct((F.col("block") * 100 + F.col("place") + 1).alias("segment_id"), F.when(F.col("place") % 5 == 3, F.concat(text, F.lit(" x"))).otherwise(text).alias("text"), F.lit(False).alias("final"))
    # drafts and finals from one pass over the texts
    both = F.explode(F.when(F.col("place") % 4 != 2, F.array(final, draft)).otherwise(F.array(final)))
    rows = s.withColumns({"block": F.floor(F.col("pos") / 40), "place": place}).select("doc_id", "block", "place", both.alias("x")).select("doc_id", "block", "place", "x.*")
    out = B.reconciled(rows, ["doc_id", "block"])
    return out.select("doc_id", F.when(F.col("removed"), F.col("place")).otherwise(F.col("block") * 40 + F.col("place")).cast("int").alias("place"), "segment_id", "text", "removed")


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return B.throttled(e, "user_id", "event_id", 500)


def throttle_by_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same times by pointers that double, no task with a whole user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return scans.throttled_by_jumps(e, "user_id", "event_id", 500)


def packet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a user in order of event, some empty or missing, by the samples before them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 > 0, F.repeat(F.lit("ab"), (F.col("event_id") % 11).cast("int")).cast("binary")).alias("pcm"))
    return A.packet_positions(e, 1000).select("stream_id", "seq", "start_sample")


def overload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("seconds", F.floor("value") - 20).withColumn("items", F.col("event_id") % 7 - 2)
    return M.overload_rollup(e, ["user_id", "event_type"], "seconds", "items", "value", "value", "event_id")


def endpoint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counters(table(spark, sf_dir, "events"), "user_id", {f"n_{k}": F.col("event_type") == k for k in ("click", "error", "purchase", "view")})


def cer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("clip", F.col("item_id") % 4)
    return M.error_rate(b, F.lower("text"), F.lower(F.regexp_replace("text", "th", "t")), ["clip"])


def cer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of whole documents of every language, by subtitle keys."""
    d = table(spark, sf_dir, "documents")
    return M.error_rate(d, M.subtitle_key(F.col("text")), M.subtitle_key(F.regexp_replace("text", "th|qu", "t")), ["lang"], M.edits)


def adequacy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "labels").withColumn("clip", F.col("doc_id") % 4)
    return M.adequacy(cues.withColumn("score", F.col("quality") + (1 - F.col("toxic"))), "score", ["clip"])


def retention_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "props")
    return M.within_bytes(e, "user_id", "event_id", F.octet_length("props"), 400).select("user_id", "event_id", "bytes_kept")


SECRETS = ["token", "key", "Released under the MIT License"]


def log_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.scrubbed(F.col("text"), SECRETS)).alias("text_md5"))


def log_scrub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return M.scrubbed_chunks(c, "conv_id", "turn", "text", ["the", "tion"]).select("conv_id", F.md5("text").alias("text_md5"))


#: Characters of a cell in the queries, below most conversations' length, so that secrets cross borders.
LOG_CELL = 500


def log_scrub_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs in chunks, scrubbed in cells: secrets that can't overlap themselves."""
    cells = scrub.scrubbed_cells(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["the", "tion", "is a"], cell=LOG_CELL)
    return cells.select("conv_id", "cell", F.md5("text").alias("text_md5"))


def log_scrub_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with secrets that can overlap themselves."""
    cells = scrub.scrubbed_cells(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["ss", "e ", "that"], cell=LOG_CELL)
    return cells.select("conv_id", "cell", F.md5("text").alias("text_md5"))


def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_entries(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


def hint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    terms = e.select((F.col("user_id") % 200).alias("owner"), F.col("event_id").alias("pos"), F.concat(F.col("event_type"), F.lit(" "), F.floor(F.col("value") / 8).cast("string")).alias("term"))
    out = M.hint_lists(terms)
    return out.select("owner", "ok", F.coalesce(F.array_join("terms", "|"), F.lit("")).alias("terms"))


def _cells_sql(secrets: list[str]) -> str:
    """Secrets of whole conversations become marks of equal length, so cells can be cut behind that."""
    text = "string_agg(text, '' ORDER BY turn)"
    for x in sorted(secrets, key=len, reverse=True):
        text = f"replace({text}, '{x}', chr(64976) || repeat(chr(64977), {len(x) - 1}))"
    j = f"SELECT conv_id, {text} AS t FROM conversations GROUP BY 1"
    c = f"SELECT conv_id, t, unnest(range((length(t) + {LOG_CELL - 1}) // {LOG_CELL})) AS cell FROM j"
    return f"WITH j AS ({j}), c AS ({c}) SELECT conv_id, cell, md5(replace(replace(substr(t, cell * {LOG_CELL} + 1, {LOG_CELL}), chr(64977), ''), chr(64976), '[REDACTED]')) AS text_md5 FROM c"


QUERIES = {f.__name__: f for f in (packet_gaps, gap_totals, interval_coverage, lost_samples, vad_hysteresis, utterances_short, utterances, utterances_fast, utterances_long, utterances_recheck, window_packets, gap_reports, frame_energy, stable_prefix, stable_turns, stable_words, local_agreement, overlap_trim, reconcile_ids, throttle, throttle_by_jumps, packet_positions, overload_rollup, endpoint_counters, cer_rollup, cer_documents, adequacy_rollup, retention_bytes, log_scrub, log_scrub_chunks, log_scrub_cells, log_scrub_chains, first_entries, hint_lists)}

SHORT = """
WITH e AS (SELECT user_id % 50 AS stream_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS i, value >= 60 AS loud FROM events),
f AS (SELECT stream_id, i, loud AND (i // 60) % 3 = 0 AS v FROM e),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY stream_id ORDER BY i) - 1 >= 25 THEN 1 ELSE 0 END AS new FROM f WHERE v),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY i) AS k FROM s),
r AS (SELECT stream_id, min(i) AS a, max(i) AS z, count(*) AS n_voiced FROM g GROUP BY stream_id, k)
SELECT r.stream_id, greatest(0, a - 20) AS first_frame, z + 25 AS last_frame, n_voiced
FROM r JOIN (SELECT stream_id, max(i) AS e FROM f GROUP BY 1) m ON m.stream_id = r.stream_id
WHERE z + 25 <= e AND n_voiced >= 10 AND z + 25 - greatest(0, a - 20) + 1 <= 200"""
GAPS = """
p AS (SELECT user_id AS stream_id, event_id, event_id * 10 + CAST(floor(value) AS BIGINT) AS a FROM events),
g AS (SELECT *, greatest(0, coalesce(a - lag(a + 320) OVER (PARTITION BY stream_id ORDER BY event_id), 0)) AS missing FROM p),
e AS (SELECT *, CAST(sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY event_id) AS BIGINT) AS epoch FROM g)
"""
SPANS = "s AS (SELECT user_id AS stream_id, event_type, event_id * 10 AS a, event_id * 10 + CAST(floor(value * 40) AS BIGINT) AS z FROM events)"
#: SQL of first_shown().
FIRST = "CASE WHEN {0} < 6 THEN {0} + 1 ELSE 6 + length(bin({0} // 6)) END"
STABLE = """
p AS (SELECT *, sum(hash(text, pos)::HUGEINT) OVER (PARTITION BY turn, obs ORDER BY pos) AS pre FROM o),
n AS (SELECT *, CASE WHEN lag(pre) OVER w = pre AND lag(obs) OVER w = obs - 1 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY turn, pos ORDER BY obs)),
i AS (SELECT *, sum(new) OVER (PARTITION BY turn, pos ORDER BY obs) AS isl FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY turn, pos, isl ORDER BY obs) AS k, min(t) OVER (PARTITION BY turn, pos, isl) AS since FROM i),
d AS (SELECT *, row_number() OVER (PARTITION BY turn, pos, isl ORDER BY obs) AS f FROM r WHERE k >= 2 AND t - since >= 0.6),
b AS (SELECT *, lag(text) OVER (PARTITION BY turn, pos ORDER BY obs) AS before FROM d WHERE f = 1)
SELECT turn, pos, obs, t, text FROM b WHERE before IS NULL OR before <> text
"""

ORACLES = {
    "packet_gaps": f"WITH {GAPS} SELECT stream_id, event_id, missing, epoch FROM e",
    "gap_totals": f"WITH {GAPS} SELECT stream_id, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (missing > 0) AS gaps, max(epoch) AS epoch FROM e GROUP BY 1",
    "interval_coverage": f"""WITH {SPANS},
m AS (SELECT *, greatest(a, coalesce(max(z) OVER (PARTITION BY stream_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS b FROM s)
SELECT stream_id, CAST(sum(greatest(0, z - b)) AS BIGINT) AS covered FROM m GROUP BY 1""",
    "lost_samples": f"""WITH {SPANS},
e AS (SELECT stream_id, a AS pt, 1 AS l, 0 AS k FROM s WHERE event_type <> 'click' AND z > a UNION ALL SELECT stream_id, z, -1, 0 FROM s WHERE event_type <> 'click' AND z > a
  UNION ALL SELECT stream_id, a, 0, 1 FROM s WHERE event_type = 'click' AND z > a UNION ALL SELECT stream_id, z, 0, -1 FROM s WHERE event_type = 'click' AND z > a),
t AS (SELECT stream_id, pt, sum(l) AS l, sum(k) AS k FROM e GROUP BY 1, 2),
c AS (SELECT stream_id, pt, lead(pt) OVER w AS nxt, sum(l) OVER w AS l, sum(k) OVER w AS k FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY pt))
SELECT stream_id, CAST(sum(CASE WHEN l > 0 AND k = 0 THEN nxt - pt ELSE 0 END) AS BIGINT) AS lost FROM c
WHERE stream_id IN (SELECT stream_id FROM s WHERE event_type <> 'click' AND z > a) GROUP BY 1""",
    "vad_hysteresis": """
SELECT user_id, event_id, coalesce(last_value(CASE WHEN value >= 50 THEN 1 WHEN value < 35 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS active FROM events""",
    "utterances_short": SHORT,
    "window_packets": f"""
SELECT stream_id, first_frame, from_frame, least(from_frame + 15, last_frame) AS to_frame, from_frame + 15 >= last_frame AS final
FROM (SELECT stream_id, first_frame, last_frame, unnest(generate_series(first_frame, last_frame, 16)) AS from_frame FROM ({SHORT}))""",
    "gap_reports": """
WITH r AS (SELECT user_id, CASE WHEN event_id % 3 > 0 THEN (CAST(floor(value) AS BIGINT) - 5) * 1000000 END AS samples FROM events)
SELECT user_id, count(*) AS n, coalesce(samples BETWEEN 1 AND 57600000, false) AS good FROM r GROUP BY 1, 3""",
    "frame_energy": """
WITH p AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, CAST(floor(value * 10) AS BIGINT) AS a FROM events),
f AS (SELECT s, r, a, unnest(generate_series(480 * r // 320, (480 * r + 479) // 320)) AS i FROM p),
o AS (SELECT s, i, r, a, least(320 * i + 320, 480 * r + 480) - greatest(320 * i, 480 * r) AS n FROM f),
e AS (SELECT s, i, sum(n * a * a)::DOUBLE AS e, sum(n) AS n FROM o GROUP BY 1, 2)
SELECT s AS stream_id, i AS frame_idx, sqrt(e / 320) / 32768 AS rms, sqrt(e / 320) / 32768 >= 0.002 AS voiced FROM e WHERE n = 320""",
    "stable_turns": f"""
WITH o AS (SELECT turn, pos, obs, obs * 0.4::DOUBLE AS t, CASE WHEN pos % 4 = 3 AND obs % 2 = 1 THEN upper(text) ELSE text END AS text
  FROM (SELECT conv_id AS turn, turn::BIGINT AS pos, text, unnest(generate_series({FIRST.format("turn")}, {FIRST.format("turn")} + 5))::BIGINT AS obs FROM conversations)),
{STABLE}""",
    "stable_words": f"""
WITH c AS (SELECT conv_id * 1000 + turn AS turn, string_split(text, ' ') AS w FROM conversations),
x AS (SELECT turn, w[j + 1] AS text, j::BIGINT AS pos, (len(w) - 1) // 3 AS top FROM (SELECT turn, w, unnest(generate_series(0, len(w) - 1)) AS j FROM c)),
g AS (SELECT turn, pos, text, top, unnest(generate_series({FIRST.format("(pos // 3)")}, greatest(5, ({FIRST.format("top")}) + 3)))::BIGINT AS obs FROM x),
o AS (SELECT turn, pos, obs, obs * 0.4::DOUBLE AS t, CASE WHEN pos % 5 = 3 AND obs % 2 = 1 AND obs <= {FIRST.format("top")} THEN upper(text) ELSE text END AS text FROM g),
{STABLE}""",
    "local_agreement": """
WITH k AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS k, coalesce(lag(lower(regexp_replace(text, '[^A-Za-z]+', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations)
SELECT conv_id, turn, coalesce(list_max(list_filter(generate_series(0, least(length(k), length(b))), lambda n: left(k, n) = left(b, n))), 0) AS agreed FROM k""",
    "overlap_trim": r"""
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND before IS NOT NULL THEN right(trim(before), 20) || ' ' || text ELSE text END AS text FROM c),
p AS (SELECT conv_id, turn, trim(text) AS cur, trim(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS prev FROM r),
n AS (SELECT *, list_max(list_filter(generate_series(4, least(length(cur), length(prev), 100)), lambda n: lower(right(prev, n)) = lower(left(cur, n)) AND (n = length(cur) OR n = length(prev)
    OR regexp_matches(left(cur, n), '[^\x00-\x7f]') OR NOT (regexp_matches(cur[n + 1], '[\p{L}\p{N}]') OR regexp_matches(prev[length(prev) - n], '[\p{L}\p{N}]'))))) AS n FROM p),
t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND n IS NOT NULL AND n <> length(cur) AND n <> length(prev) THEN regexp_replace(substr(cur, n + 1), '^[ ,.!?]+', '') ELSE cur END AS t FROM n)
SELECT conv_id, turn, md5(t) AS trimmed_md5, length(t) AS n FROM t""",
    "throttle": """
WITH RECURSIVE k(user_id, event_id) AS (
  SELECT user_id, min(event_id) FROM events GROUP BY 1
  UNION ALL
  SELECT user_id, nxt FROM (SELECT k.user_id, (SELECT min(e.event_id) FROM events e WHERE e.user_id = k.user_id AND e.event_id >= k.event_id + 500) AS nxt FROM k) WHERE nxt IS NOT NULL)
SELECT user_id, event_id FROM k""",
    "packet_positions": """
SELECT user_id AS stream_id, event_id AS seq, CAST(coalesce(sum(CASE WHEN event_id % 7 > 0 THEN event_id % 11 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample FROM events""",
    "overload_rollup": """
SELECT user_id, event_type, CAST(sum(greatest(0, CAST(floor(value) AS BIGINT) - 20)) AS BIGINT) AS dropped_seconds, CAST(sum(greatest(0, event_id % 7 - 2)) AS BIGINT) AS dropped_items, max(value) AS max_buffer, arg_max(value, event_id) AS last_timing, count(*) AS reports
FROM events GROUP BY 1, 2""",
    "endpoint_counters": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "view")) + " FROM events GROUP BY 1",
    "cer_rollup": r"""
WITH b AS (SELECT item_id % 4 AS clip, translate(lower(text), 'àáâäæçèéêëìíîïñòóôöœùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXY') AS r, translate(lower(replace(text, 'th', 't')), 'àáâäæçèéêëìíîïñòóôöœùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXY') AS h FROM benchmark)
SELECT clip, CAST(sum(levenshtein(r, h)) AS BIGINT) AS edits, CAST(sum(length(r)) AS BIGINT) AS chars, round(sum(levenshtein(r, h)) * 100.0 / sum(length(r)), 2)::DOUBLE AS percent FROM b GROUP BY ROLLUP (clip)""",
    "adequacy_rollup": """
SELECT doc_id % 4 AS clip, CAST(sum(quality + 1 - toxic) AS BIGINT) AS points, count(quality + toxic) AS cues, round(sum(quality + 1 - toxic) * 100.0 / (count(quality + toxic) * 2), 1)::DOUBLE AS adequacy
FROM labels GROUP BY ROLLUP (clip)""",
    "retention_bytes": """
SELECT user_id, event_id, CAST(b AS BIGINT) AS bytes_kept FROM (SELECT user_id, event_id, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE b <= 400""",
    "log_scrub": "SELECT doc_id, md5(replace(replace(replace(text, 'Released under the MIT License', '[REDACTED]'), 'token', '[REDACTED]'), 'key', '[REDACTED]')) AS text_md5 FROM documents",
    "log_scrub_cells": _cells_sql(["the", "tion", "is a"]),
    "log_scrub_chains": _cells_sql(["ss", "e ", "that"]),
    "log_scrub_chunks": "SELECT conv_id, md5(replace(replace(string_agg(text, '' ORDER BY turn), 'tion', '[REDACTED]'), 'the', '[REDACTED]')) AS text_md5 FROM conversations GROUP BY 1",
    "first_entries": "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1",
    "hint_lists": """
WITH e AS (SELECT user_id % 200 AS owner, event_id AS pos, trim(event_type || ' ' || CAST(floor(value / 8) AS BIGINT)) AS term FROM events),
t AS (SELECT owner, term, min(pos) AS pos, count(*) AS n FROM e GROUP BY 1, 2),
l AS (SELECT owner, string_agg(term, '|' ORDER BY pos) AS terms, sum(n) <= 32 AND max(length(term)) <= 48 AND sum(length(term)) <= 512 AS ok FROM t GROUP BY 1)
SELECT owner, ok, CASE WHEN ok THEN terms ELSE '' END AS terms FROM l""",
}
ORACLES["throttle_by_jumps"] = ORACLES["throttle"]
