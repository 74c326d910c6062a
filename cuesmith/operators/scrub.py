"""Secrets out of files that come in chunks, without a row or a task that holds a file.

A file is its chunks in order, one behind the other. It is laid out in cells of equally many characters; each cell is scrubbed
where it stands, and a mark belongs to the cell in which its secret begins. The cells of a file, joined in order, are the
scrubbed file: secrets go one after the other, longer ones first, each from left to right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.operators.scans import WIDTH, running_sum, throttled_by_jumps
from cuesmith.sources.written import written

#: Characters of a cell.
CELL = 65_536
# Noncharacters that stand for the first and the other characters of a secret that goes, and for those of them in a text.
FIRST, OTHER, OWN = "\ufdd0", "\ufdd1", "\ufdd2"


def overlaps_itself(secret: str) -> bool:
    """Whether two occurrences of a secret can share characters."""
    return any(secret.startswith(secret[i:]) for i in range(1, len(secret)))


def struck(secret: str) -> str:
    return FIRST + OTHER * (len(secret) - 1)


def laid_out(chunks: DataFrame, file: str, order: str, text: str, cell: int, margin: int, width: float) -> DataFrame:
    """_file, _cell, _head, _text: each cell with `margin` characters before it (_head of them, as many as there are) and behind it."""
    some = chunks.filter(F.length(text) > 0).select(F.col(file).alias("_file"), F.col(order).alias("_order"), F.col(text).alias("_text"), F.length(text).cast("long").alias("_n"))
    rows = running_sum(some, ["_file"], ["_order"], F.col("_n"), "_at", width)
    end = F.col("_at") + F.col("_n")
    first, last = F.floor(F.greatest(F.lit(0), F.col("_at") - margin) / cell), F.floor((end - 1 + margin) / cell)
    rows = rows.withColumn("_cell", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_at"), F.col("_cell") * cell - margin)
    upto = F.least(end, (F.col("_cell") + 1) * cell + margin)
    piece = F.substring("_text", (begin - F.col("_at") + 1).cast("int"), (upto - begin).cast("int"))
    cells = rows.select("_file", "_cell", begin.alias("_begin"), piece.alias("_piece")).groupBy("_file", "_cell").agg(F.sort_array(F.collect_list(F.struct("_begin", "_piece"))).alias("_pieces"))
    head = F.least(F.col("_cell") * cell, F.lit(margin)).cast("int")
    cells = cells.select("_file", "_cell", head.alias("_head"), F.array_join(F.col("_pieces")["_piece"], "").alias("_text"))
    return cells.filter(F.length("_text") > F.col("_head"))


def shown(text: Column, work: Column, mark: str) -> Column:
    """text with a mark for each FIRST of work and without what is OTHER there."""
    char = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), 0)
    each = F.zip_with(char(text), char(work), lambda t, w: F.when(w == FIRST, mark).when(w == OTHER, "").otherwise(t))
    plain = F.replace(F.replace(work, F.lit(OTHER), F.lit("")), F.lit(FIRST), F.lit(mark))
    return F.when(text.rlike(f"[{FIRST}{OTHER}{OWN}]"), F.array_join(each, "")).otherwise(plain)


def occurrences(cells: DataFrame, secret: str, cell: int) -> DataFrame:
    """_file, at: the places of a secret in files, those that share characters too."""
    more = cells.select(F.col("_file").alias("_f"), (F.col("_cell") - 1).alias("_c"), F.left("_work", F.lit(len(secret) - 1)).alias("_more"))
    rows = cells.join(more, F.col("_file").eqNullSafe(F.col("_f")) & (F.col("_cell") == F.col("_c")), "left").withColumn("_all", F.concat("_work", F.coalesce("_more", F.lit(""))))
    # cut before each occurrence: every piece but the first begins with one
    parts = F.filter(F.split("_all", "(?=\\Q" + secret.replace("\\E", "\\E\\\\E\\Q") + "\\E)"), lambda p: p != "")
    rows = rows.filter(F.contains("_all", F.lit(secret))).select("_file", "_cell", F.startswith("_all", F.lit(secret)).alias("_first"), F.posexplode(F.transform(parts, F.length)).alias("_i", "_n"))
    before = Window.partitionBy("_file", "_cell").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_cell") * cell)
    return rows.filter((F.col("_i") > 0) | F.col("_first")).select("_file", "at")


def struck_at(cells: DataFrame, places: DataFrame, secret: str, cell: int) -> DataFrame:
    """cells with the secrets that begin at `places` struck out in _work; one may reach into the next cell."""
    n = len(secret)
    met = places.select(F.col("_file").alias("_f"), "at", F.explode(F.sequence(F.floor(F.col("at") / cell), F.floor((F.col("at") + n - 1) / cell))).alias("_c"))
    met = met.groupBy("_f", "_c").agg(F.sort_array(F.collect_list((F.col("at") - F.col("_c") * cell).cast("int"))).alias("_starts"))
    rows = cells.join(met, F.col("_file").eqNullSafe(F.col("_f")) & (F.col("_cell") == F.col("_c")), "left")
    behind = lambda i: F.when(i > 0, F.get("_starts", i - 1) + n).otherwise(0)

    def piece(start: Column, i: Column) -> Column:
        gap = F.substring(F.col("_work"), behind(i) + 1, F.greatest(F.lit(0), start - behind(i)))
        return F.concat(gap, F.substring(F.lit(struck(secret)), F.greatest(F.lit(0), -start) + 1, F.lit(n)))

    rest = F.substring(F.col("_work"), F.element_at("_starts", -1) + n + 1, F.length("_work"))
    new = F.left(F.concat(F.array_join(F.transform("_starts", piece), ""), rest), F.length("_work"))
    return rows.withColumn("_work", F.when(F.col("_starts").isNull(), F.col("_work")).otherwise(new)).select(*cells.columns)


def scrubbed_cells(chunks: DataFrame, file: str, order: str, text: str, secrets: list[str], mark: str = "[REDACTED]", cell: int = CELL, width: float = WIDTH) -> DataFrame:
    """file, cell, text: the scrubbed files in cells of `cell` characters (before scrubbing), from 0 on.

    order is a number, different for the chunks of a file; a null file is a file, and chunks without text, null or empty, add nothing. A
    mark is not searched again. Occurrences of a secret that can't overlap itself depend on a neighbourhood of bounded length, so cells
    with such margins are scrubbed at once. Where one can ('aa' in 'aaaa'), which occurrences go may depend on a whole file: there
    secrets go one at a time, and the greedy choice is made by pointers that double (scans.throttled_by_jumps).
    """
    some = sorted({s for s in secrets if s}, key=lambda s: (-len(s), secrets.index(s)))
    if any(c in s for s in some for c in (FIRST, OTHER, OWN)):
        raise ValueError("secrets must not hold U+FDD0 to U+FDD2")
    cell = max([cell, *map(len, some)])
    hidden = F.translate("_text", FIRST + OTHER, OWN + OWN)
    if not any(map(overlaps_itself, some)):
        cells = laid_out(chunks, file, order, text, cell, sum(len(s) - 1 for s in some), width)
        work = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(struck(s))), some, hidden)
        cut = lambda c: F.substring(c, F.col("_head") + 1, F.lit(cell))
        cells = cells.withColumn("_work", work).select("_file", "_cell", cut(F.col("_text")).alias("_text"), cut(F.col("_work")).alias("_work"))
    else:
        cells = written(laid_out(chunks, file, order, text, cell, 0, width).withColumn("_work", hidden))
        for s in some:
            places = occurrences(cells, s, cell)
            if overlaps_itself(s):
                # a null file takes part under a name of its own
                named = places.select(F.struct(F.col("_file").isNull().alias("none"), F.col("_file").alias("name")).alias("k"), "at")
                places = throttled_by_jumps(named, "k", "at", len(s)).select(F.col("k.name").alias("_file"), "at")
            cells = written(struck_at(cells, places, s, cell))
    return cells.select(F.col("_file").alias(file), F.col("_cell").alias("cell"), shown(F.col("_text"), F.col("_work"), mark).alias("text"))
