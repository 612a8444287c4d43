"""Notes and their markers, printed page numbers, and what the pages beside a page say of its edge lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwright.functions import text as T

MARKER = r"\[\^([^\]\s]+)\](?!:)"
NOTE = r"(?s)^([0-9]{1,3}|[*†‡§¶])[.)]?\s+(\S.*)$"
PRINTED = r"(?<![\w./:\-–,$])[0-9]{1,4}(?![\w./:\-–%$,])"
REACH = 2


def raised_markers(chars: DataFrame, line_keys: list[str]) -> DataFrame:
    """line_keys, at, key: small raised digits or signs glued to a word of chars (at, ch, size, origin_y), as a note's key."""
    line = W.partitionBy(*line_keys)
    order = line.orderBy("at")
    row = chars.withColumns({"_big": F.max("size").over(line), "_pc": F.lag("ch").over(order)})
    row = row.withColumn("_base", F.avg(F.when(F.col("size") >= 0.85 * F.col("_big"), F.col("origin_y"))).over(line))
    sign = (F.col("size") <= 0.8 * F.col("_big")) & (F.col("_base") - F.col("origin_y") >= 0.2 * F.col("_big")) & F.col("ch").rlike(r"^[0-9*†‡§¶]$")
    row = row.withColumn("_s", sign).withColumn("_o", F.when(F.col("_s") & F.coalesce(F.lag("_s").over(order), F.lit(False)), 0).otherwise(1))
    row = row.withColumn("_run", F.sum("_o").over(order)).filter("_s")
    runs = row.groupBy(*line_keys, "_run").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda s: s["ch"]), "").alias("key"), F.min_by("_pc", "at").alias("_b"))
    return runs.filter(F.col("_b").isNotNull() & (F.trim("_b") != "") & (F.length("key") <= 3)).select(*line_keys, "at", "key")


def markers(pages: DataFrame) -> DataFrame:
    """file, page, key, at: each marker of a note in the text, numbered in its page from 0."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))).alias("at", "key")
    return pages.select("file", "page", found)


def definitions(lines: DataFrame) -> DataFrame:
    """file, page, line_no, key, note: lines that open with a number or sign, as a note does."""
    return lines.select("file", "page", "line_no", F.regexp_extract(F.trim("line"), NOTE, 1).alias("key"), T.squashed(F.regexp_extract(F.trim("line"), NOTE, 2)).alias("note")).filter("key <> ''")


def linked(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """file, key, page, note_page, final_key, note: the nth marker of a key in a file meets the nth note of that key, if that is on its page or later.

    marks: file, page, key; notes: file, page, line_no, key, note. A key that was used on an earlier page
    gets its page's number, as keys name the whole document. Markers without a note have a null note_page. Ranks are within a file
    and key.
    """
    mine = marks.select("file", "page", "key").distinct()
    m = mine.withColumn("_n", F.row_number().over(W.partitionBy("file", "key").orderBy("page")))
    d = notes.withColumn("_n", F.row_number().over(W.partitionBy("file", "key").orderBy("page", "line_no"))).select("file", "key", "_n", F.col("page").alias("note_page"), "note")
    joined = m.join(d, ["file", "key", "_n"], "left")
    late = F.col("note_page") >= F.col("page")
    final = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.concat("key", F.lit("-p"), F.col("page")))
    return joined.select("file", "key", "page", F.when(late, F.col("note_page")).alias("note_page"), final.alias("final_key"), F.when(late, F.col("note")).alias("note"))


def announced(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """rows (file, page, ...) sent to the pages up to `reach` beside them, as target and the distance from it; the page itself too."""
    return rows.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off")).withColumn("target", F.col("page") + F.col("off"))


def printed_numbers(edges: DataFrame) -> DataFrame:
    """file, page, value, at, left: numbers that stand alone in edge lines (line, width of page 1), each with the half of the line it is in."""
    found = edges.select("file", "page", "line", F.explode(F.regexp_extract_all("line", F.lit(PRINTED), F.lit(0))).alias("number"))
    place = F.position(F.col("number"), F.col("line")) / F.greatest(F.length("line"), F.lit(1))
    return found.select("file", "page", F.col("number").cast("long").alias("value"), (place <= 0.5).alias("left"))


def running_numbers(numbers: DataFrame, reach: int = REACH) -> DataFrame:
    """file, page, value, left of the numbers (file, page, value, left) that a page up to two away carries on, by one a page, or by two on the same half.

    Numbers on the same diagonal meet by equality of value - page, or of value - 2 page and half, so no
    range join is made: each number announces itself to the pages beside it.
    """
    own = numbers.distinct()
    near = announced(own, reach).filter("off <> 0")
    met = near.select("file", F.col("target").alias("page"), F.col("value").alias("_v"), F.col("off").alias("_o"), F.col("left").alias("_l"))
    one = own.join(met.select("file", "page", (F.col("_v") + F.col("_o")).alias("value")).distinct(), ["file", "page", "value"], "left_semi")
    two = own.join(met.select("file", "page", (F.col("_v") + 2 * F.col("_o")).alias("value"), F.col("_l").alias("left")).distinct(), ["file", "page", "value", "left"], "left_semi")
    return one.union(two).distinct()


def applied(numbers: DataFrame) -> DataFrame:
    """file, page, value, applies: page, or the half where a page prints two numbers that follow each other, one on each half."""
    per = numbers.groupBy("file", "page", "value").agg(F.bool_or("left").alias("left"))
    pair = per.groupBy("file", "page").agg(F.count("*").alias("n"), F.max(F.when(F.col("left"), F.col("value"))).alias("l"), F.max(F.when(~F.col("left"), F.col("value"))).alias("r"))
    spread = (F.col("n") == 2) & (F.col("r") == F.col("l") + 1)
    return per.join(pair, ["file", "page"]).select("file", "page", "value", F.when(F.coalesce(spread, F.lit(False)), F.when(F.col("left"), "left half").otherwise("right half")).otherwise("page").alias("applies"))


def counts_pages(numbers: DataFrame, reach: int = REACH) -> DataFrame:
    """file, page, value, counts: whether a page's number is as far from its place as the numbers before and after it agree on; null if they cannot say."""
    d = numbers.select("file", "page", "value", (F.col("value") - F.col("page")).alias("d"))
    by_page = d.groupBy("file", "page").agg(F.collect_set("d").alias("ds"))
    near = announced(by_page, reach).filter("off <> 0")
    met = near.groupBy("file", F.col("target").alias("page")).agg(
        F.max_by("ds", F.when(F.col("off") > 0, -F.col("off"))).alias("_before"), F.max_by("ds", F.when(F.col("off") < 0, F.col("off"))).alias("_after"))
    met = met.withColumn("_both", F.array_intersect("_before", "_after"))
    out = d.join(met, ["file", "page"], "left")
    return out.select("file", "page", "value", F.when(F.size(F.coalesce("_both", F.array().cast("array<bigint>"))) > 0, F.array_contains("_both", F.col("d"))).alias("counts"))


def runs_beside(edges: DataFrame, near: float = 4.0, reach: int = REACH) -> DataFrame:
    """edges (file, page, line_no, line, x0, y0) with runs: a page up to two away prints the same line at the same place; null if none is beside.

    Lines meet on their text and the page announced to, so a line costs its pages and not their pairs.
    """
    key = F.lower(T.squashed(F.col("line")))
    own = edges.withColumn("_k", key)
    pages = edges.select("file", "page").distinct()
    asked = announced(pages, reach).filter("off <> 0").select("file", F.col("target").alias("page")).distinct()
    told = announced(own.select("file", "page", "_k", "x0", "y0").distinct(), reach).filter("off <> 0").select("file", F.col("target").alias("page"), "_k", F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    met = own.join(told, ["file", "page", "_k"]).filter((F.abs(F.col("x0") - F.col("_x")) <= near) & (F.abs(F.col("y0") - F.col("_y")) <= near)).select("file", "page", "line_no").distinct().withColumn("_m", F.lit(True))
    out = own.drop("_k").join(met, ["file", "page", "line_no"], "left").join(asked.withColumn("_a", F.lit(True)), ["file", "page"], "left")
    return out.withColumn("runs", F.when(F.col("_m"), True).when(F.col("_a"), False)).drop("_m", "_a")


def released(candidates: DataFrame) -> DataFrame:
    """The page numbers (counts, runs) that go back to the text: shown to count no pages and not to run. An unknown stays."""
    return candidates.filter((F.col("counts") == F.lit(False)) & (F.col("runs") == F.lit(False)))


def footnote_body(keys: Column, notes: Column) -> Column:
    """Notes as markdown: [^key]: note, blank lines between."""
    return F.array_join(F.zip_with(keys, notes, lambda k, n: F.concat(F.lit("[^"), k, F.lit("]: "), n)), "\n\n")
