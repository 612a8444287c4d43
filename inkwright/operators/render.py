"""Blocks of a document as markdown, with front matter and a map of where each block's text stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwright.functions import text as T

FURNITURE = ("header", "footer", "page_number")


def block_text(kind: Column, text: Column, level: Column) -> Column:
    """One block as markdown, by its kind; formulas and tables are written as they are."""
    flat = T.squashed(text)
    return (
        F.when(F.trim(text) == "", "")
        .when(kind.isin("heading", "title"), F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(2)))).cast("int")), F.lit(" "), flat))
        .when(kind == "list_item", T.list_item(text, F.coalesce(level, F.lit(1))))
        .when(kind == "figure", F.concat(F.lit("!["), T.alt_text(text), F.lit("](figure)")))
        .when(kind.isin("formula", "table"), text)
        .otherwise(F.replace(F.trim(text), F.lit("$"), F.lit("\\$")))
    )


def parts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, page, kind, text: blocks (page, order, kind, text, level) in order as markdown; a paragraph cut by a page break is one part.

    A text block whose predecessor in the document is text of an earlier page that does not end, and which
    begins in lower case, carries that part on. Windows are over one document.
    """
    order = W.partitionBy(*keys).orderBy("page", "order")
    shown = blocks.filter(~F.col("kind").isin(*FURNITURE)).withColumn("_t", block_text(F.col("kind"), F.col("text"), F.col("level"))).filter("_t <> ''")
    before = lambda c: F.lag(c).over(order)
    on = (F.col("kind") == "text") & (before("kind") == "text") & (before("page") < F.col("page")) & T.paragraph_continues(before("_t"), F.col("_t"))
    rows = shown.withColumn("_n", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("_n").over(order))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("page", "order", "_t"))), lambda s: s["_t"])
    return rows.groupBy(*keys, "part").agg(F.min("page").alias("page"), F.min_by("kind", F.struct("page", "order")).alias("kind"), F.aggregate(pieces, F.lit(""), T.join_broken).alias("text"))


CHUNK = 512  # parts of a document that are joined before it is put together
RAW = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}\x{E000}-\x{F8FF}]"


def chunks(part_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, text: the parts of a document in stretches of 512 with blank lines between; raw glyph codes out, the ellipsis as three dots.

    What is done to a text is done here, so that a document is put together of few strings and then left alone.
    """
    ends = part_rows.groupBy(*keys).agg(F.max("part").alias("_last"))
    own = part_rows.select(*keys, "part", "text").join(F.broadcast(ends), keys)
    shown = F.when(F.col("part") == F.col("_last"), F.rtrim("text")).otherwise(F.col("text"))
    own = own.select(*keys, "part", F.replace(F.regexp_replace(shown, RAW, ""), F.lit("…"), F.lit("...")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"])
    return own.groupBy(*keys, F.floor(F.col("part") / CHUNK).alias("chunk")).agg(F.array_join(texts, "\n\n").alias("text"))


def _in_turn(column: str, between: str) -> Column:
    """The strings of a group's chunks in order; nulls are passed over."""
    told = F.when(F.col(column).isNotNull(), F.struct("chunk", F.col(column).alias("v")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda s: s["v"]), between)


def documents(part_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: the parts with blank lines between, cleaned as in chunks. A document of no parts has no row."""
    return chunks(part_rows, keys).groupBy(*keys).agg(_in_turn("text", "\n\n").alias("body"))


def offsets(part_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, page, kind, start, end: where each part stands in its document's body, in characters, by a running sum of lengths."""
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    size = part_rows.withColumn("_l", F.length("text") + 2)
    start = F.coalesce(F.sum("_l").over(before), F.lit(0)).cast("long")
    return size.withColumn("start", start).select(*keys, "part", "page", "kind", "start", (F.col("start") + F.col("_l") - 2).cast("long").alias("end"))


def located(part_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, told: the places of a document's parts as JSON objects with commas between, 512 parts together."""
    own = offsets(part_rows, keys).groupBy(*keys, F.floor(F.col("part") / CHUNK).alias("chunk"))
    told = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("part"), F.col("page"), F.col("kind"), F.array("start", "end").alias("range")))))
    return own.agg(told.alias("told")).withColumn("told", F.substring("told", F.lit(2), F.length("told") - 2))


def gathered(part_rows: DataFrame, rest: DataFrame, keys: list[str], mapped: bool) -> DataFrame:
    """rest, a row a document, with body, null without parts, and blocks, the JSON of its parts' places, empty unless mapped.

    All meets in one aggregation of a document's chunks: a body is in no join and is moved once, in pieces.
    """
    others = [c for c in rest.columns if c not in keys]
    kind = rest.select(F.struct(*[F.col(c) for c in others])).schema[0].dataType
    none = lambda k: F.lit(None).cast(k)
    rows = chunks(part_rows, keys).select(*keys, "chunk", "text", none("string").alias("told"), none(kind).alias("rest"))
    if mapped:
        rows = rows.union(located(part_rows, keys).select(*keys, "chunk", none("string"), "told", none(kind)))
    rows = rows.union(rest.select(*keys, none("bigint"), none("string"), none("string"), F.struct(*[F.col(c) for c in others])))
    met = rows.groupBy(*keys).agg(
        F.count("text").alias("_n"), _in_turn("text", "\n\n").alias("body"), _in_turn("told", ",").alias("blocks"), F.first("rest", ignorenulls=True).alias("rest")
    )
    return met.select(*keys, F.when(F.col("_n") > 0, F.col("body")).alias("body"), "blocks", "rest.*")


def map_of(body: Column, sha: Column, blocks: Column) -> Column:
    """JSON of a body's length and checksum and of each part's page, kind and range."""
    return F.concat(F.lit('{"markdown":{"characters":'), F.length(body).cast("string"), F.lit(',"sha256":"'), sha, F.lit('"},"blocks":['), blocks, F.lit("]}"))


def location_map(part_rows: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, map: see map_of; of the documents that have parts."""
    own = located(part_rows, keys).groupBy(*keys).agg(_in_turn("told", ",").alias("blocks"))
    return bodies.join(own, keys).select(*keys, map_of(F.col("body"), F.sha2(F.col("body").cast("binary"), 256), F.col("blocks")).alias("map"))


def front_matter(bodies: DataFrame, keys: list[str], by: str = "inkwright") -> DataFrame:
    """bodies (body, resource, completion, confidence, pages and, if it is known, sha256) with front: a YAML block whose strings are quoted as JSON quotes them, which YAML reads.

    Required is the type alone; what is null is left out.
    """
    quoted = lambda c: F.nullif(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    c = F.col
    sha = c("sha256") if "sha256" in bodies.columns else F.sha2(c("body").cast("binary"), 256)
    own = F.concat_ws("\n", line("  completion", c("completion")), line("  confidence", c("confidence").cast("string")), line("  pages", c("pages").cast("string")), F.concat(F.lit("  sha256: "), sha))
    block = F.concat_ws(
        "\n", F.lit("---"), F.lit("type: Document"), line("title", quoted(T.title_of(c("body")))), line("description", quoted(T.description_of(c("body")))),
        line("resource", quoted(c("resource"))), F.lit("status: draft"), F.lit("sources:"), line("- resource", quoted(c("resource"))), F.lit(f"{by}:"), own, F.lit("---"),
    )
    return bodies.withColumn("front", block)


def hyphen_join(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pairs (above, below) with joined: a hyphen at a line's end dropped, kept or spaced, by a vocabulary (word) of any size.

    The three words asked about meet the vocabulary by semi-joins on the word, so it is never broadcast unless it is small; lines
    are moved once, to meet what is known of their two words.
    A half with a capital or digit, or a compound of two known words, keeps its hyphen; a function word keeps its space;
    a prefix closes up unless two vowels meet; what the vocabulary does not know closes up.
    """
    c = F.col
    a = F.lower(F.regexp_replace(F.regexp_extract("above", r"(?<!\S)(\S+)-$", 1), r"""^[(\["']+""", ""))  # from a word's start, or each of its letters is tried as one
    b = F.lower(F.regexp_replace(F.regexp_extract("below", r"^(\S+)", 1), r"""^[.,;:!?)\]"']+|[.,;:!?)\]"']+$""", ""))
    rows = pairs.withColumns({"_a": a, "_b": b})
    met = rows.select("_a", "_b").distinct()
    asked = met.select(F.explode(F.array("_a", "_b", F.concat("_a", "_b"))).alias("word")).distinct()
    known = asked.join(vocabulary.select("word"), "word", "left_semi")
    mark = lambda df, expr, name: df.join(known.select(F.col("word").alias(f"_w{name}"), F.lit(True).alias(name)), expr == F.col(f"_w{name}"), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    told = mark(mark(mark(met, c("_a"), "_ka"), c("_b"), "_kb"), F.concat("_a", "_b"), "_kab").select(c("_a").alias("_ta"), c("_b").alias("_tb"), "_ka", "_kb", "_kab")
    rows = rows.join(told, c("_a").eqNullSafe(c("_ta")) & c("_b").eqNullSafe(c("_tb")), "left")
    word = r"^\p{L}+$"
    closed, kept, spaced = F.concat(F.regexp_replace("above", "-$", ""), c("below")), F.concat("above", "below"), F.concat_ws(" ", "above", "below")
    alpha = c("_a").rlike(word)
    joined = (
        F.when(~c("above").rlike(r"[^ ]-$"), spaced)
        .when(~c("below").rlike(r"^\p{Ll}") | F.contains(c("_a"), F.lit("-")) | (c("_b") == ""), kept)
        .when(c("_b").isin(T.FUNCTION_WORDS), F.when(alpha & (F.length("_a") >= 2) & c("_kab"), closed).otherwise(spaced))
        .when(alpha & (F.length("_a") == 1) & ~c("_kab"), kept)
        .when(alpha & c("_b").rlike(word) & ~c("_kab") & c("_ka") & c("_kb") & (F.length("_a") >= 2) & (F.length("_b") >= 2) & (~c("_a").isin(T.PREFIXES) | (c("_a").rlike("[aeiou]$") & (F.substring("_b", 1, 1) == F.substring("_a", -1, 1)))), kept)
        .otherwise(closed)
    )
    return rows.withColumn("joined", joined).select(*pairs.columns, "joined")


def broken_words(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The pairs (above, below) of line ends that are no words apart and one together."""
    a = F.regexp_replace(F.regexp_extract("above", r"(\S+)$", 1), r"""^[(\["']+""", "")
    b = F.regexp_replace(F.regexp_extract("below", r"^(\S+)", 1), r"""[.,;:!?)\]"']+$""", "")
    low = r"^\p{Ll}{2,}$"
    rows = pairs.withColumns({"_a": a, "_b": b}).filter(F.col("_a").rlike(low) & F.col("_b").rlike(low) & (F.length("_a") + F.length("_b") >= 6)).withColumn("_ab", F.concat("_a", "_b"))
    v = lambda name: vocabulary.select(F.col("word").alias(name))
    return rows.join(v("_ab"), "_ab", "left_semi").join(v("_a"), "_a", "left_anti").join(v("_b"), "_b", "left_anti").select(*pairs.columns)
