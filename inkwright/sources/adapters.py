"""The driver's tables seen as files, pages, lines, blocks and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.operators.ranks import numbered

BAND = 0.12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(documents: DataFrame) -> DataFrame:
    """file, page, doc_id, text: a source is a file and its documents, by id, are its pages."""
    return numbered(documents.select(F.col("source").alias("file"), "doc_id", "text"), "file", "doc_id", "page").select("file", "page", "doc_id", "text")


def lines(paged: DataFrame) -> DataFrame:
    """file, page, doc_id, line_no, n_lines, line: blank lines are numbered and then dropped."""
    parts = paged.select("file", "page", "doc_id", F.split("text", "\n").alias("parts"))
    each = parts.select("file", "page", "doc_id", F.size("parts").cast("long").alias("n_lines"), F.posexplode("parts").alias("line_no", "line"))
    return each.select("file", "page", "doc_id", F.col("line_no").cast("long").alias("line_no"), "n_lines", "line").filter(F.trim("line") != "")


def banded(line_rows: DataFrame, share: float = BAND) -> DataFrame:
    """The lines with their band: head, foot or body."""
    reach = F.greatest(F.lit(1), F.ceil(F.col("n_lines") * share))
    band = F.when(F.col("line_no") < reach, "head").when(F.col("line_no") >= F.col("n_lines") - reach, "foot").otherwise("body")
    return line_rows.withColumn("band", band)


def html_blocks(page_rows: DataFrame) -> DataFrame:
    """page_id, block_no, kind, text: headings, paragraphs and list items of web pages, in order."""
    found = F.regexp_extract_all("html", F.lit(r"<(?:h1|p|li)(?:\s[^>]*)?>[^<]*(?:<(?:b|a|i)[^>]*>[^<]*</(?:b|a|i)>[^<]*)*"), F.lit(0))
    each = page_rows.select("page_id", F.posexplode(found).alias("block_no", "raw"))
    kind = F.when(F.col("raw").startswith("<h1"), "heading").when(F.col("raw").startswith("<li"), "list_item").otherwise("text")
    text = F.trim(F.regexp_replace("raw", r"<[^>]*>", ""))
    return each.select("page_id", F.col("block_no").cast("long").alias("block_no"), kind.alias("kind"), text.alias("text")).filter(F.col("text") != "")


def boxes(lineitem: DataFrame) -> DataFrame:
    """page, box, x0, y0, x1, y1: order lines as boxes of a page, in numbers that are exact in binary."""
    q = F.col("l_quantity")
    return lineitem.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1_000_003 + F.col("l_partkey")).alias("box"),
        q.alias("x0"), (F.col("l_linenumber") * 4.0).alias("y0"),
        (q + F.col("l_suppkey") % 16 + 1.0).alias("x1"), (F.col("l_linenumber") * 4.0 + F.col("l_partkey") % 8 + 1.0).alias("y1"),
    )


#: The same views for DuckDB, as the head of a WITH clause.
SQL = """
WITH pg AS (
  SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents
), ln AS (
  SELECT * FROM (
    SELECT file, page, doc_id, generate_subscripts(parts, 1) - 1 AS line_no, len(parts) AS n_lines, unnest(parts) AS line
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM pg)
  ) WHERE trim(line) <> ''
), bd AS (
  SELECT *, CASE WHEN line_no < greatest(1, ceil(n_lines * 0.12)) THEN 'head' WHEN line_no >= n_lines - greatest(1, ceil(n_lines * 0.12)) THEN 'foot' ELSE 'body' END AS band FROM ln
)"""
BOX_SQL = """
WITH bx AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000003 + l_partkey AS box, l_quantity AS x0, l_linenumber * 4.0::DOUBLE AS y0,
         l_quantity + l_suppkey % 16 + 1 AS x1, l_linenumber * 4.0::DOUBLE + l_partkey % 8 + 1 AS y1 FROM lineitem
)"""
HTML_SQL = r"""
WITH hb AS (
  SELECT page_id, block_no, CASE WHEN raw LIKE '<h1%' THEN 'heading' WHEN raw LIKE '<li%' THEN 'list_item' ELSE 'text' END AS kind,
         trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text
  FROM (SELECT page_id, generate_subscripts(r, 1) - 1 AS block_no, unnest(r) AS raw FROM (
    SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)(?:\s[^>]*)?>[^<]*(?:<(?:b|a|i)[^>]*>[^<]*</(?:b|a|i)>[^<]*)*') AS r FROM pages))
  WHERE trim(regexp_replace(raw, '<[^>]*>', '', 'g')) <> ''
)"""
