"""Saved readings, check files and outputs: text and JSON lines by Spark's own readers, so any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.functions import geometry as G
from inkwright.operators import checks

NAME = r"([^/]+?)(?:_pg([0-9]+))?(?:_repeat([0-9]+))?\.md$"


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """pdf, page, repeat, md: a folder of outputs named <category>/<stem>_pg<page>_repeat<n>.md; page and repeat are 1 where the name has none."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).withColumn("_p", F.input_file_name())
    part = lambda i: F.regexp_extract("_p", NAME, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(1))
    category = F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1)
    return rows.select(category.alias("category"), F.concat(part(1), F.lit(".pdf")).alias("pdf"), number(2).alias("page"), number(3).alias("repeat"), F.col("value").alias("md"))


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """stem, page, text, cut_off: readings with their front matter taken off, and whether it says that the reply was cut off."""
    rows = outputs(spark, folder)
    front = F.regexp_extract("md", r"(?s)\A(---[ \t]*\n.*?\n---[ \t]*\n)", 1)
    return rows.select(F.regexp_replace("pdf", r"\.pdf$", "").alias("stem"), "page", F.trim(F.regexp_replace("md", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n", "")).alias("text"), front.rlike(r"(?im)^cut_off:\s*true\s*$").alias("cut_off"))


def page_readings(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """pages (stem, page) with text and cut_off of their reading, null if there is none."""
    return pages.join(readings, ["stem", "page"], "left")


def region_readings(regions: DataFrame, crops: DataFrame, least: float = 0.5) -> DataFrame:
    """regions (stem, page, region, box) with the text of the crop (stem, crop, text, box) that overlaps most, if to `least`."""
    a = regions.select("stem", "region", *[F.col(n).alias(f"a_{n}") for n in ("x0", "y0", "x1", "y1")])
    b = crops.select("stem", "crop", F.col("text").alias("_t"), *[F.col(n).alias(f"b_{n}") for n in ("x0", "y0", "x1", "y1")])
    met = a.join(b, "stem").withColumn("_i", G.iou("a_", "b_")).filter(F.col("_i") >= least)
    best = met.groupBy("stem", "region").agg(F.max_by("_t", F.struct("_i", "crop")).alias("text"))
    return regions.join(best, ["stem", "region"], "left")


def check_rows(spark: SparkSession, path: str) -> DataFrame:
    """Checks of JSON lines under the one schema of all types; blank lines are none. Repeated ids are an error, raised when rows are read."""
    rows = spark.read.schema(checks.SCHEMA).json(path).filter("id IS NOT NULL")
    twice = checks.duplicate_ids(rows).limit(1).collect()
    if twice:
        raise ValueError(f"the id {twice[0]['id']} is given twice")
    return rows


def save_checks(rows: DataFrame, path: str) -> None:
    """Checks as JSON lines, null fields left out."""
    rows.write.mode("overwrite").json(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """stem, md: results of JSON lines (metadata.Source-File, text), one output a page; blank texts are empty."""
    rows = spark.read.schema("text string, metadata struct<`Source-File`:string>").json(path)
    stem = F.regexp_extract(F.col("metadata.`Source-File`"), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(stem.alias("stem"), F.when(F.trim(text) != "", F.concat(F.rtrim(text), F.lit("\n"))).otherwise("").alias("md")).filter("stem <> ''")


def library_sample(files: DataFrame, n: int, seed: int, sealed: DataFrame | None = None) -> DataFrame:
    """n files (path, pages) in an order that the seed fixes, each with one of its pages; sealed ones (path) never. A sampling operator: n is the feature."""
    rows = files if sealed is None else files.join(sealed, "path", "left_anti")
    order = F.xxhash64(F.lit(seed), "path")
    page = F.pmod(F.xxhash64(F.lit(seed + 1), "path"), F.col("pages")) + 1
    return rows.withColumn("_o", order).orderBy("_o", "path").limit(n).select("path", page.alias("page"))


def write_documents(results: DataFrame, folder: str) -> None:
    """Conversions (file, markdown, completion, issues, ...) as Parquet, the statuses and issues as JSON beside them."""
    results.write.mode("overwrite").parquet(f"{folder}/documents")
    results.drop("markdown").write.mode("overwrite").json(f"{folder}/status")
