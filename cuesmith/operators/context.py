"""Prior context, glossary matches and memoized work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.sources.written import written


def prior_context(rows: DataFrame, keys: list[str], order: list[str], text: str, ok: Column, n: int = 3, budget: int = 900) -> DataFrame:
    """rows with context: the last n texts of rows with `ok` strictly before, oldest first, whole texts within a
    budget of characters (one more between texts) counted from the newest; a text over the budget is passed over.

    An as-of join by window: each ok row carries its own last n, the newest such array is handed down. State in the
    window is one array, whatever the length of a session.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lasts = [F.lag(F.col(text), i).over(Window.partitionBy(*keys, "_ok").orderBy(*order)) for i in range(n - 1, 0, -1)]
    own = F.filter(F.array(*lasts, F.col(text)), lambda t: t.isNotNull())
    out = rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_own", F.when(F.col("_ok"), own))
    out = out.withColumn("_prior", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def take(acc: Column, t: Column) -> Column:
        cost = F.length(F.trim(t)) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        fits = (F.trim(t) != "") & (acc["used"] + cost <= budget)
        return F.when(fits, F.struct(F.concat(F.array(F.trim(t)), acc["kept"]).alias("kept"), (acc["used"] + cost).alias("used"))).otherwise(acc)

    empty = F.array().cast("array<string>")
    return out.withColumn("context", F.coalesce(F.aggregate(F.reverse(F.coalesce("_prior", empty)), start, take, lambda a: a["kept"]), empty)).drop("_ok", "_own", "_prior")


def rolling_prompt(rows: DataFrame, keys: list[str], order: list[str], text: str, size: int = 500, reset: Column | None = None) -> DataFrame:
    """rows with prompt: the last `size` characters of the texts before (joined by blanks) since the last reset.

    Each row gathers the texts that end within `size` characters before its own end, cut to `size` each (so about twice
    that at most), and hands them to the next row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    part = F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) if reset is not None else F.lit(0)
    own = F.right(F.nullif(F.trim(text), F.lit("")), F.lit(size))
    out = rows.withColumns({"_part": part, "_own": own})
    by = Window.partitionBy(*keys, "_part")
    out = out.withColumn("_end", F.sum(F.coalesce(F.length("_own") + 1, F.lit(0)).cast("long")).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    near = F.collect_list("_own").over(by.orderBy("_end").rangeBetween(-size, 0))
    out = out.withColumn("_held", F.right(F.array_join(near, " "), F.lit(size)))
    return out.withColumn("prompt", F.coalesce(F.lag("_held").over(by.orderBy(*order)), F.lit(""))).drop("_part", "_own", "_end", "_held")


#: White space of Unicode, around a text.
AROUND = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"


def judged_terms(entries: DataFrame, most: int = 200, by: list[str] | None = None) -> DataFrame:
    """Terms, with the reason of those that are left out or null, of lists of entries (pos, source, target; `by` names the list, default: one).

    Of each list the first `most` entries by pos count; those behind are issues (`beyond`), as are entries whose source or target is null, blank,
    longer than 64 characters or not on one line, and all but the first of equal sources (`repeated`). Space around a term is cut.
    """
    keys = by or []
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
        marked = entries.withColumn("_beyond", place > most)
    else:  # one list: the place of the last entry that counts, without a window over all of it
        last = entries.select("pos").orderBy("pos").limit(most).agg(F.max("pos").alias("_last"))
        marked = entries.join(F.broadcast(last)).withColumn("_beyond", F.col("pos") > F.col("_last")).drop("_last")
    marked = marked.withColumns({c: F.regexp_replace(c, AROUND, "") for c in ("source", "target")})
    bad = [F.col(c).isNull() | (F.col(c) == "") | (F.length(c) > 64) | F.col(c).rlike(r"[\p{Cc}\p{Cs}\p{Zl}\p{Zp}]") for c in ("source", "target")]
    marked = marked.withColumn("reason", F.when(F.col("_beyond"), "beyond").when(bad[0], "source").when(bad[1], "target"))
    good = F.col("reason").isNull()
    # rows that are left out already are dealt by pos: they may be many with the same source
    n = F.row_number().over(Window.partitionBy(*keys, "source", F.when(~good, F.col("pos"))).orderBy("pos"))
    told = marked.withColumn("_n", n).withColumn("reason", F.when(good & (F.col("_n") > 1), "repeated").otherwise(F.col("reason")))
    return told.select(*keys, "pos", "source", "target", "reason")


def glossary(entries: DataFrame, most: int = 200, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(terms, issues with reason) of judged_terms()."""
    told = judged_terms(entries, most, by)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def match_glossary(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", most: int = 20, catalog: int = 200) -> DataFrame:
    """key, source, target, place: the terms found in each text, longest first, then by catalog order, at most `most`.

    Matches are exact; an edge of a term that is an ASCII letter, digit or _ must stand at a word boundary. terms
    comes from glossary() and has at most `catalog` rows (more raise): they stand in the expression in the order of
    their places, each with a pattern of its own, so a text is matched in one narrow scan.
    """
    rows = terms.select("pos", "source", "target").limit(catalog + 1).collect()
    if len(rows) > catalog:
        raise ValueError(f"a glossary has at most {catalog} terms")
    word = re.compile("[A-Za-z0-9_]", re.A)
    found = []
    for r in sorted(rows, key=lambda r: (-len(r.source), r.pos)):
        edges = ("(?<![A-Za-z0-9_])" if word.match(r.source[0]) else "", "(?![A-Za-z0-9_])" if word.match(r.source[-1]) else "")
        hit = F.col(text).contains(r.source)
        if any(edges):
            hit &= F.col(text).rlike(edges[0] + r"\Q" + r.source.replace(r"\E", r"\E\\E\Q") + r"\E" + edges[1])
        found.append(F.when(hit, F.struct(F.lit(r.source).alias("source"), F.lit(r.target).alias("target"))))
    kept = F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most) if found else F.array().cast("array<struct<source:string,target:string>>")
    return texts.select(key, F.posexplode(kept).alias("place", "hit")).select(key, "hit.source", "hit.target", (F.col("place") + 1).alias("place"))


#: Lengths of the pieces by which terms without a letter, digit or _ of ASCII are found: such a term is filed under one piece of
#: the greatest length that fits.
PIECES = (1, 2, 4, 8)
#: What is a word at whose edges terms must stand.
WORD = "[A-Za-z0-9_]"


def catalog_index(terms: DataFrame) -> DataFrame:
    """pos, source, target, piece, whole, pattern: each term under that word of its own, or piece if it has no word, which the
    fewest terms have; whether the word is all of it; and the pattern it must match.

    A word in a term has other characters of the term around it, or stands at the term's edge, which must be a word boundary: so
    a text with the term has that word as a whole word.
    """
    n = F.length("source")
    size = F.lit(PIECES[0])
    for q in PIECES[1:]:
        size = F.when(n >= q, q).otherwise(size)
    pieces = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col("source"), i, size))  # terms are short
    words = F.regexp_extract_all("source", F.lit(f"{WORD}+"), F.lit(0))
    rows = terms.filter(n > 0).select("pos", "source", "target", F.posexplode(F.when(F.size(words) > 0, words).otherwise(pieces)).alias("at", "piece"))
    shared = rows.select("pos", "piece").distinct().groupBy("piece").agg(F.count("*").alias("terms"))
    best = Window.partitionBy("pos", "source").orderBy("terms", "at")
    chosen = rows.join(shared, "piece").withColumn("n", F.row_number().over(best)).filter("n = 1")
    edge = lambda place, pattern: F.when(F.col("source").rlike(place), pattern).otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("source"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(edge(f"^{WORD}", f"(?<!{WORD})"), quoted, edge(f"{WORD}$", f"(?!{WORD})"))
    return chosen.select("pos", "source", "target", "piece", (F.col("piece").rlike(WORD) & (F.col("piece") == F.col("source"))).alias("whole"), pattern.alias("pattern"))


def match_catalog(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", most: int = 20) -> DataFrame:
    """What match_glossary() gives, for catalogs of any size: key, source, target, place.

    Texts and terms meet by the distinct words of a text, and by pieces of up to 8 characters between its words in those
    lengths that the catalog asks for (an equi-join; Spark sends a small index to all tasks). A term that is one word is
    found by that; pairs with other terms are matched. key names a text; a null text has no terms.
    """
    index = catalog_index(terms)
    lengths = index.filter(~F.col("piece").rlike(WORD)).agg(F.collect_set(F.length("piece"))).scalar()
    between = [F.when(F.array_contains(lengths, q), F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=([^A-Za-z0-9_]{{{q}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>")) for q in PIECES]
    pieces = F.array_distinct(F.concat(F.regexp_extract_all(F.col(text), F.lit(f"{WORD}+"), F.lit(0)), *between))
    rows = texts.select(F.col(key).alias("_key"), F.explode(pieces).alias("piece")).filter("_key is not null")
    met = rows.join(index, "piece").select("_key", "pos", "source", "target", "pattern", "whole")
    other = met.filter("not whole").drop("whole").distinct().join(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key").filter(F.contains("_text", "source")).filter(F.expr("rlike(_text, pattern)"))
    columns = ["_key", "pos", "source", "target"]
    found = met.filter("whole").select(*columns).unionByName(other.select(*columns))
    order = Window.partitionBy("_key").orderBy(F.length("source").desc(), "pos")
    placed = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return placed.select(F.col("_key").alias(key), "source", "target", "place")


def memoized(work: DataFrame, keys: list[str], run: Callable[[DataFrame], DataFrame], result: str = "result") -> DataFrame:
    """work with a result made once for each distinct combination of keys and joined back (null-safe).

    run takes the distinct keys and returns them with the result column. The join may be skewed by a frequent key;
    Spark splits it at run time, as neither side is aggregated after it.
    """
    done = run(work.select(*keys).dropDuplicates())
    done = done.select(*[F.col(k).alias(f"_{k}") for k in keys], result)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    for c in on[1:]:
        on[0] = on[0] & c
    return work.join(done, on[0], "left").drop(*[f"_{k}" for k in keys])


def infer(work: DataFrame, fn: Callable[[list[str]], list[str]], prompt: str, result: str = "result", batch: int = 64) -> DataFrame:
    """work with fn(batch of prompts) as a column: a pluggable model, called on Arrow batches in the tasks."""

    @F.pandas_udf("string")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            values = s.tolist()
            yield pd.Series([x for i in range(0, len(values), batch) for x in fn(values[i : i + batch])], dtype=object)

    return work.withColumn(result, call(F.col(prompt)))


def infer_checked(work: DataFrame, fn: Callable[[list[str]], list[str]], prompt: str, status: Callable[[Column], Column], attempts: int = 2, retry_prompt: str | None = None) -> DataFrame:
    """work with result and status ('ok' or the reason of the check): the model is asked again, at most `attempts` times, for
    the rows whose answer fails the check, and is not shown that answer. retry_prompt names the column that later attempts
    ask with (without context, say); columns named result and status are replaced.

    Runs when called: every attempt is written before it is judged, so each row is asked once an attempt and comes out
    once, whatever the model answers another time.
    """
    todo, parts = work.drop("result", "status"), []
    for i in range(attempts):
        asked = prompt if i == 0 else retry_prompt or prompt
        out = written(infer(todo, fn, asked).withColumn("status", F.coalesce(status(F.col("result")), F.lit("failed"))))
        parts.append(out if i + 1 == attempts else out.filter("status = 'ok'"))
        todo = out.filter("status <> 'ok'").drop("result", "status")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def promoted(finals: DataFrame, provisional: DataFrame, session: str, segment: str, order: str) -> DataFrame:
    """finals with result: that of the provisional work of the same segment, source, language, epoch and context, which then
    isn't done again; null where there is none, or where an earlier final of the session's epoch is not done and may
    still change the context. finals has done; provisional has one row a work, good results only."""
    before = Window.partitionBy(session, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    free = ~F.coalesce(F.bool_or(~F.col("done")).over(before), F.lit(False))
    keys = [session, segment, "source", "language", "epoch", "context"]
    p = provisional.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("result").alias("_result"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = finals.withColumn("_free", free).join(p, on, "left")
    return out.withColumn("result", F.when(F.col("_free"), F.col("_result"))).drop("_free", "_result", *(f"_{k}" for k in keys))


def failure_policy(results: DataFrame, session: str, order: list[str]) -> DataFrame:
    """results(segment_id, is_final, status, result) with shown, warning and context_ok: a failed draft keeps the
    last good text of its segment; a failed final shows a placeholder and warns; only good finals become context."""
    w = Window.partitionBy(session, "segment_id").orderBy(*order)
    good = F.col("status") == "ok"
    last = F.last(F.when(good, F.col("result")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    shown = F.when(good, F.col("result")).when(F.col("is_final"), F.lit("[unavailable]")).otherwise(last)
    return results.withColumns({"shown": shown, "warning": F.when(~good & F.col("is_final"), F.col("status")), "context_ok": good & F.col("is_final")})
