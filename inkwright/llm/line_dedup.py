"""Line dedup over overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _row_key(doc_id, text):
    """128 bits that name a row by its id and text; rows equal in both are treated alike."""
    return F.struct(F.xxhash64(F.lit(1), doc_id, text).alias("a"), F.xxhash64(F.lit(2), text, doc_id).alias("b"))


def windows(df: DataFrame) -> DataFrame:
    """row, doc_id, pos, h: the 128-bit hash of every run of three consecutive lines that is not all blank."""
    lines = df.select("doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("row"), F.split("text", "\n").alias("lines"))
    at = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WIDTH),
        lambda i: F.struct(
            i.alias("pos"),
            F.when(
                F.trim(F.concat(*[F.get("lines", i + k) for k in range(WIDTH)])) != "",
                F.struct(F.xxhash64(*[F.get("lines", i + k) for k in range(WIDTH)]).alias("a"), F.xxhash64(F.lit(7), *[F.get("lines", i + k) for k in range(WIDTH)]).alias("b")),
            ).alias("h"),
        ),
    )
    found = lines.filter(F.size("lines") >= WIDTH).select("doc_id", "row", F.explode(at).alias("w"))
    return found.select("doc_id", "row", F.col("w.pos").alias("pos"), F.col("w.h").alias("h")).filter(F.col("h").isNotNull())


def covered(df: DataFrame) -> DataFrame:
    """row, gone: for every row that loses lines, their positions, merged from all its repeated windows.

    The first occurrence of a window is the one of the smallest (doc_id, row, position), null ids
    last. A later one covers its three lines, but for those of the first itself where both overlap in one row.
    """
    each = windows(df)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("pos").alias("pos"))
    first = each.groupBy("h").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    repeated = first.filter(F.col("first") != F.col("last")).select("h", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    later = each.join(repeated, "h").filter((F.col("row") != F.col("first_row")) | (F.col("pos") != F.col("first_pos")))
    start = F.when(F.col("row") == F.col("first_row"), F.greatest("pos", F.col("first_pos") + WIDTH)).otherwise(F.col("pos"))
    return (
        later.select("row", F.sequence(start, F.col("pos") + (WIDTH - 1)).alias("gone"))
        .groupBy("row")
        .agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    )


def _without(text, gone):
    """The text's lines but for the positions in the array `gone`: the stretches between them, one walk over both."""
    both = F.array(F.struct(F.split(text, "\n").alias("lines"), F.array_sort(gone).alias("gone")))

    def stretch(x, i):
        start = F.coalesce(F.get(x["gone"], i - 1), F.lit(-1)) + 1
        return F.slice(x["lines"], start + 1, F.coalesce(F.get(x["gone"], i), F.size(x["lines"])) - start)

    kept = F.transform(both, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda i: stretch(x, i))))
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def dedup_lines(df: DataFrame) -> DataFrame:
    """Every row with the lines of later window occurrences removed from `text`, and removed_lines as the last column.

    All other columns stay as they are, whatever their names; where one is called removed_lines already,
    the new one is removed_lines_2, and so on. Null text stays null and texts of fewer than three lines never change. A
    text all of whose lines go becomes empty; a very long text is one row like any other, walked once. Rows equal in
    doc_id and text count as one and all get the result of the first. Null ids sort last. An empty table gives an empty one.
    """
    mine = {c: f"c{i}" for i, c in enumerate(df.columns)}
    inner = df.toDF(*mine.values())
    doc_id, text = F.col(mine["doc_id"]), F.col(mine["text"])
    keyed = inner.withColumn("row", _row_key(doc_id, text))
    gone = covered(inner.select(doc_id.alias("doc_id"), text.alias("text"))).select(F.col("row").alias("gone_row"), "gone")
    joined = keyed.join(gone, F.col("row") == F.col("gone_row"), "left")
    out = joined.withColumn("new_text", F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone"))))
    taken = {c.lower() for c in df.columns}
    name = next(n for n in ("removed_lines", *(f"removed_lines_{k}" for k in range(2, len(taken) + 3))) if n not in taken)
    columns = [F.col("new_text" if c == "text" else m).alias(c) for c, m in mine.items()]
    return out.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(name))


ORACLE = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM {docs}
), w AS (
  SELECT a.doc_id, a.pos, a.line AS l0, b.line AS l1, c.line AS l2
  FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN l c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
  WHERE trim(a.line || b.line || c.line) <> ''
), f AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(pos) OVER o AS first_pos FROM w
  WINDOW o AS (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS pos
  FROM f WHERE doc_id <> first_doc OR pos <> first_pos
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text, count(g.pos) AS removed_lines
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
"""
