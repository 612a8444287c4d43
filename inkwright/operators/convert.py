"""From lines to documents: the stages in a row, with the state that each conversion ends in."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality, render, structure
from .cuts import cut
from .running import beside


class PageSelectionError(ValueError):
    """A selection of pages that names none, or one that is not there."""


@dataclass(frozen=True)
class Options:
    """What a conversion is asked to do; written into its record."""

    front_matter: bool = True
    pages: str | None = None
    location_map: bool = False
    layout: bool = False
    vision: bool = False
    page_markers: bool = False


def parse_pages(spec: str) -> list[tuple[int, int]]:
    """Ranges of a selection such as 1,3-5. Reversed, zero, empty and malformed parts are refused."""
    out = []
    for part in spec.split(","):
        ends = part.strip().split("-")
        if len(ends) > 2 or not all(e.strip().isdigit() for e in ends):
            raise PageSelectionError(f"not a page or a range of pages: {part.strip()!r}")
        low, high = int(ends[0]), int(ends[-1])
        if low < 1 or high < low:
            raise PageSelectionError(f"not a page or a range of pages: {part.strip()!r}")
        out.append((low, high))
    return out


def selected(pages: DataFrame, spec: str | None) -> DataFrame:
    """The rows of pages (file, page) that the selection names; it must name pages that each file has."""
    if spec is None:
        return pages
    ranges = parse_pages(spec)
    top = max(high for _, high in ranges)
    short = pages.groupBy("file").agg(F.max("page").alias("n")).filter(F.col("n") < top).limit(1).collect()
    if short:
        raise PageSelectionError(f"{short[0]['file']} has {short[0]['n']} pages")
    test = F.lit(False)
    for low, high in ranges:
        test = test | F.col("page").between(low, high)
    return pages.filter(test)


def convert(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """file, markdown, completion, confidence, issues, decisions, build (and map) of lines (file, page, line_no, text, size, bold, box, page_height).

    Each stage is a function of DataFrames: quality of each page, blocks, whether the neighbours print them
    too, kinds, levels, order, parts, body. Stages that were asked for and cannot run are issues, never silent.
    """
    keys = ["file", "page"]
    lines = selected(lines, options.pages)  # what follows is built on cuts in the checkpoint folder, so no stage is planned or run twice
    pages = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"), F.max("page_height").alias("page_height"))
    judged = cut(quality.assessed(pages).select(*keys, "kind", "script_kind", "usable", "page_height").withColumnRenamed("kind", "page_kind"))
    body = quality.body_size(lines, *keys)
    blocks = cut(structure.simple_blocks(lines, keys))
    folded = blocks.withColumn("_k", F.lower(F.col("text"))).withColumn("band", F.when(F.col("y0") < 200, "head").otherwise("foot"))
    known = beside(folded.select("file", "page", "band", "_k"), ["file", "band", "_k"], 2)
    size = judged.groupBy("file").agg(F.count("*").alias("n_pages"))
    blocks = folded.join(known, ["file", "band", "_k", "page"], "left").join(size, "file").withColumn("runs", F.when(F.col("n_pages") > 1, F.coalesce("repeated", F.lit(False))))
    blocks = cut(structure.kinds(blocks.join(judged.select(*keys, "page_height"), keys).join(body, keys, "left").withColumn("body_size", F.coalesce("body_size", F.lit(10.0)))))
    decisions = (
        blocks.filter(F.col("kind").isin(*structure.FURNITURE))
        .withColumn("kept_in", F.when(F.col("kind") == "page_number", None).when(F.col("runs"), "running").otherwise("imprint"))
        .groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "block", F.col("kind").alias("role"), "text", "kept_in", F.col("runs").isNotNull().alias("checked")))).alias("decisions"))
    )
    ordered = cut(structure.reading_order(blocks.select(*keys, "block", "kind", "text", "n_lines", "size", "body_size", "x0", "y0", "x1", "y1"), keys))
    heads = structure.heading_levels(ordered, keys).select(*keys, "block", "level")
    items = structure.list_levels(ordered, keys).select(*keys, "block", "level")
    ordered = ordered.join(heads.union(items), [*keys, "block"], "left")
    parts = cut(render.parts(ordered, ["file"]))
    lost = judged.filter("NOT usable").groupBy("file").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    issues = lost.select("file", F.lit("unreadable-pages").alias("code"), F.lit("incomplete").alias("severity"), "pages", F.concat(F.lit("pages without readable text: "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")).alias("message"))
    files = judged.select("file").distinct()
    for stage, wanted in (("layout", options.layout), ("vision", options.vision)):
        if wanted:
            issues = issues.unionByName(files.select("file", F.lit("stage-unavailable").alias("code"), F.lit("degraded").alias("severity"), F.array().cast("array<bigint>").alias("pages"), F.lit(f"the {stage} stage was asked for and no reader for it is registered").alias("message")))
    unchecked = decisions.select("file", F.array_distinct(F.transform(F.filter("decisions", lambda d: ~d["checked"] & d["kept_in"].isNotNull()), lambda d: d["page"])).alias("pages")).filter(F.size("pages") > 0)
    issues = issues.unionByName(unchecked.select("file", F.lit("edge-unchecked").alias("code"), F.lit("note").alias("severity"), F.col("pages").cast("array<bigint>").alias("pages"), F.lit("edge lines with no page beside them are kept as imprint").alias("message")))
    ended = quality.completion(issues, "file").select("file", "completion")
    told = issues.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("code", "severity", "pages", "message"))).alias("issues"))
    trust = quality.confidence(judged.withColumnRenamed("page_kind", "kind"), "file")
    counted = size.withColumnRenamed("n_pages", "pages")
    rest = files.join(ended, "file", "left").join(told, "file", "left").join(trust, "file", "left").join(counted, "file", "left").join(decisions, "file", "left")
    out = render.gathered(parts, rest, ["file"], options.location_map)
    told_of = F.when(F.col("body").isNotNull(), F.col("blocks")).alias("blocks")  # a document without parts has no map
    out = out.select("file", F.coalesce("body", F.lit("")).alias("body"), told_of, F.coalesce("completion", F.lit("complete")).alias("completion"), "confidence", "issues", "decisions", "pages", F.col("file").alias("resource"))
    out = out.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))
    out = render.front_matter(out, ["file"])
    text = F.when(F.lit(options.front_matter), F.concat("front", F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    build = F.struct(*[F.lit(v).cast("string" if k == "pages" else "boolean").alias(k) for k, v in asdict(options).items()])
    mapped = [render.map_of(F.col("body"), F.col("sha256"), F.col("blocks")).alias("map")] if options.location_map else []
    out = out.select("file", text.alias("markdown"), "completion", "confidence", "issues", "decisions", build.alias("build"), *mapped)
    return out


def exit_code(results: DataFrame) -> int:
    """0 if all are complete, 3 if some are degraded or incomplete, 2 if there are none."""
    states = {r[0] for r in results.select("completion").distinct().collect()}  # three values at most
    return 2 if not states else 0 if states == {"complete"} else 3
