"""Prescribed forms: their grade by shape alone, and two readings of one form against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions import fuzzy
from inkwright.functions import text as T

# The prescribed events, the parts of the heading, and the answers.
EVENTS = ("fire and explosion", "flood", "storm", "earthquake", "lightning", "theft", "actions of the sea", "malicious damage", "impact", "escape of liquid", "accidental breakage", "accidental damage", "high value items", "items away")
HEADER = ("event", "yes", "some examples", "optional", "others")
ANSWER = r"(?i)^\s*(?:yes|no|optional|yes\s*/\s*no|not covered|covered)\b"
LEAD = r"^[^0-9A-Za-z]+"
ALIKE = 0.98


def label(cell: Column) -> Column:
    return F.lower(F.regexp_replace(cell, LEAD, ""))


def carries_answer(cell: Column) -> Column:
    return cell.rlike(ANSWER)


def cells_of(line: Column) -> Column:
    """The cells of a line of a table with bars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def form_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_no, row, cells: the cells (row, col, text) of each row as an array."""
    return cells.groupBy(*keys, "table_no", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]).alias("cells"))


def best_table(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The rows of each sheet's table that names most events, the first of equals, if it names `least`."""
    text = F.lower(F.array_join("cells", " "))
    named = rows.select(*keys, "table_no", F.explode(F.filter(F.array(*map(F.lit, EVENTS)), lambda e: F.contains(text, e))).alias("event")).distinct()
    hits = named.groupBy(*keys, "table_no").agg(F.count("*").alias("hits"))
    best = hits.groupBy(*keys).agg(F.max(F.struct("hits", (-F.col("table_no")).alias("t"))).alias("m")).filter(F.col("m.hits") >= least).select(*keys, (-F.col("m.t")).alias("table_no"))
    return rows.join(best, [*keys, "table_no"], "left_semi")


def grade(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events, events_in_rows, answers_attached, header_whole, header_leaks, band_own_row, orphans of each sheet's prescribed table."""
    best = best_table(rows, keys)
    c = F.col
    body = best.filter("row > 0")
    first = F.get("cells", 0)
    labels = body.filter(F.size("cells") >= 2).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", first.alias("t")))), lambda s: s["t"]), " ").alias("l"))
    held = labels.select(*keys, F.explode(F.filter(F.array(*map(F.lit, EVENTS)), lambda e: F.contains(F.lower("l"), e))).alias("event"))
    opening = body.select(*keys, "row", "cells", F.explode(F.filter(F.array(*map(F.lit, EVENTS)), lambda e: F.startswith(label(F.get(F.col("cells"), 0)), e))).alias("event"))
    opened = opening.groupBy(*keys, "event").agg(F.min_by("cells", "row").alias("cells"))
    events = held.join(opened, [*keys, "event"], "left").groupBy(*keys).agg(F.count("*").alias("events"), F.count("cells").alias("events_in_rows"), F.count_if((F.size("cells") > 1) & carries_answer(F.get("cells", 1))).alias("answers_attached"))
    text = F.lower(F.array_join("cells", " "))
    shape = best.groupBy(*keys).agg(
        F.max(F.when(c("row") == 0, text)).alias("head"), F.array_join(F.collect_list(F.when(c("row") > 0, text)), " ").alias("body"),
        F.bool_or((c("row") > 0) & (F.size("cells") >= 2) & F.get("cells", 0).rlike(r"^.{12,96}$") & (F.size(F.filter("cells", lambda x: x != "")) == 1)).alias("band_own_row"),
        F.count_if((c("row") > 0) & (F.size("cells") >= 2) & (F.get("cells", 0) == "") & (F.size(F.filter("cells", lambda x: x != "")) == 1) & ~F.startswith(F.lower(F.array_join("cells", "")), F.lit("cover for"))).alias("orphans"),
    )
    parts = F.array(*map(F.lit, HEADER))
    out = shape.join(events, keys, "left")
    return out.select(*keys, F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("events_in_rows", F.lit(0)).alias("events_in_rows"), F.coalesce("answers_attached", F.lit(0)).alias("answers_attached"), F.forall(parts, lambda p: F.contains(F.col("head"), p)).alias("header_whole"), F.exists(parts, lambda p: ~F.contains(F.col("head"), p) & F.contains(F.col("body"), p)).alias("header_leaks"), "band_own_row", "orphans")


def report(graded: DataFrame, *keys: str) -> DataFrame:
    """Totals of grades by keys, such as the hold-out split."""
    return graded.groupBy(*keys).agg(F.count("*").alias("sheets"), F.count_if(F.col("header_whole") & ~F.col("header_leaks")).alias("headers_whole"), F.sum("events").alias("events"), F.sum("events_in_rows").alias("events_in_rows"), F.sum("answers_attached").alias("answers_attached"), F.count_if(F.col("orphans") > 0).alias("with_orphans"))


def event_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, event, answer, detail, repeated: the first row that each event opens, over all tables, and whether it opens more."""
    opening = rows.filter(F.size("cells") >= 2).select(*keys, "table_no", "row", "cells", F.explode(F.slice(F.filter(F.array(*map(F.lit, EVENTS)), lambda e: F.startswith(label(F.get(F.col("cells"), 0)), e)), 1, 1)).alias("event"))
    first = opening.groupBy(*keys, "event").agg(F.min_by("cells", F.struct("table_no", "row")).alias("c"), (F.count("*") > 1).alias("repeated"))
    return first.select(*keys, "event", F.get("c", 1).alias("answer"), F.array_join(F.slice("c", 3, F.greatest(F.size("c") - 2, F.lit(0))), " ").alias("detail"), "repeated")


def words_alone(cell: Column) -> Column:
    return F.trim(F.regexp_replace(T.plain_cell(cell), r"^[\s✓✔☑✗✘☒✕✖]+", ""))


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, event, kind: how two readings (event_rows) differ, a row for each difference: an event that one lacks, answer, mark, critical words, wording.

    Critical words are compared as bags, any order; wording by likeness, in an Arrow function that only sees rows equal in them.
    """
    side = lambda df, p: df.select(*keys, "event", F.col("answer").alias(f"{p}a"), F.col("detail").alias(f"{p}d"), F.lit(True).alias(f"{p}h"))
    met = side(a, "x").join(side(b, "y"), [*keys, "event"], "full_outer")
    both = met.filter(F.col("xh") & F.col("yh"))
    bag = lambda c: F.array_sort(T.critical(words_alone(c)))
    kind = lambda df, test, name: df.filter(test).select(*keys, "event", F.lit(name).alias("kind"))
    x, y = F.col("xd"), F.col("yd")
    same = both.filter(bag(x) == bag(y)).withColumn("_r", fuzzy.alike_udf(words_alone(x), words_alone(y)))
    return (
        kind(met, F.col("xh").isNull() | F.col("yh").isNull(), "row only one reader found")
        .union(kind(both, words_alone(F.col("xa")) != words_alone(F.col("ya")), "answer"))
        .union(kind(both, (T.mark_of(F.col("xa")) != T.mark_of(F.col("ya"))) | (T.mark_of(x) != T.mark_of(y)), "mark"))
        .union(kind(both, bag(x) != bag(y), "critical words")).union(kind(same, F.col("_r") < ALIKE, "wording"))
    )


def kind_of(md: Column) -> Column:
    """What an output mostly shows: marks, table, list or prose."""
    items = F.size(F.filter(F.split(md, "\n"), lambda x: x.rlike(r"^\s*[-*] |^\s*[0-9]{1,2}\. ")))
    return F.when(md.rlike("[✓✔✗✘☑☒]"), "marks").when(F.contains(md, F.lit("<table")) | md.rlike(r"(?m)^\| ---"), "table").when(items >= 3, "list").otherwise("prose")
