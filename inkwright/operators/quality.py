"""How far a page's text can be trusted, what became of it, and how a document ended.

All judgements are row-local: a page's tokens are an array of its own row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwright.functions import text as T

READABLE = 20  # letters and digits of a page that can be read
SEVERITY = {"note": 0, "degraded": 1, "incomplete": 2}
COMPLETION = ("complete", "degraded", "incomplete")
CONFIDENCE_TENTHS = {"digital": 9, "vision": 5}


def char_counts(pages: DataFrame) -> DataFrame:
    """pages (text, ...) with n_chars, n_alnum, n_bad and bad_share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = pages.withColumns({"n_chars": T.count_not(text, r"\s\p{Z}"), "n_alnum": T.count_of(text, r"\p{L}\p{N}"), "n_bad": T.bad_chars(text)})
    return counted.withColumn("bad_share", T.share(F.col("n_bad"), F.col("n_chars")))


def _judged(tokens: Column) -> Column:
    """The tokens that are long enough to be judged."""
    return F.filter(tokens, lambda t: F.length(T.bare(t)) >= 4)


def token_shares(pages: DataFrame) -> DataFrame:
    """pages with judged, garbled, garbage_share, wordlike_share, language_share and numeric_share of their tokens."""
    split = pages.withColumn("_t", T.tokens(F.coalesce(F.col("text"), F.lit("")))).withColumn("_j", _judged(F.col("_t"))).withColumn("_v", T.vowel_shares(F.col("_t")))
    n = F.size("_t")
    part = lambda test, of="_t": F.size(F.filter(of, test))
    return split.select(
        *pages.columns, F.size("_j").alias("judged"), F.size(T.garbled_of(F.col("_j"))).alias("garbled"),
        n.alias("n_tokens"), part(T.wordlike, "_v").alias("wordlike"), part(T.language_like, "_v").alias("language_like"), part(lambda t: t.rlike(r"^[$€£(<>≤≥~+\-−]*[0-9][0-9.,]*%?[)*†]*$")).alias("numeric"),
    ).withColumns({
        "garbage_share": T.share(F.col("garbled"), F.col("judged")), "wordlike_share": T.share(F.col("wordlike"), F.col("n_tokens")),
        "language_share": T.share(F.col("language_like"), F.col("n_tokens")), "numeric_share": T.share(F.col("numeric"), F.col("n_tokens")),
    })


def kind(garbage: Column, judged: Column, coverage: Column | None = None, invisible: Column | None = None) -> Column:
    """none, suspect, ocr or digital, by the first rule that holds, over n_alnum and bad_share."""
    coverage = F.lit(0.0) if coverage is None else coverage
    invisible = F.lit(0.0) if invisible is None else invisible
    return (
        F.when(F.col("n_alnum") < READABLE, "none")
        .when(F.col("bad_share") > 0.2, "suspect")
        .when((garbage > 0.2) & (judged >= 30), "suspect")
        .when((invisible > 0.5) | ((coverage > 0.6) & (invisible > 0.1)), "ocr")
        .when((coverage > 0.85) & (F.col("n_alnum") < 200), "suspect")
        .otherwise("digital")
    )


def assessed(pages: DataFrame, coverage: str | None = None, invisible: str | None = None) -> DataFrame:
    """pages with all counts and shares, kind, script_kind (a suspect page judged again script by script) and usable."""
    cov, inv = (F.col(c) if c else None for c in (coverage, invisible))
    out = token_shares(char_counts(pages)).withColumn("kind", kind(F.col("garbage_share"), F.col("judged"), cov, inv))
    again = F.size(F.filter(_judged(T.tokens(F.col("text"))), T.garbled_in_script))
    out = out.withColumn("script_kind", F.when(F.col("kind") == "suspect", kind(T.share(again, F.col("judged")), F.col("judged"), cov, inv)).otherwise(F.col("kind")))
    return out.withColumn("usable", usable(F.col("kind"), F.col("n_alnum")))


def usable(kind_of: Column, n_alnum: Column) -> Column:
    return (kind_of == "vision") | (kind_of.isin("digital", "ocr", "ocr-own") & (n_alnum >= READABLE))


def ocr_gate(readings: DataFrame) -> DataFrame:
    """readings (conf, wordlike_share, numeric_share, language_share, n_lines) with rescued and accepted.

    Rejected rows stay, as witnesses of what stands at the page's edges.
    """
    c = F.col
    rescued = ((c("conf") >= 0.8) & ((c("numeric_share") >= 0.3) | (c("language_share") >= 0.7))) | ((c("numeric_share") >= 0.5) & (c("n_lines") >= 20))
    return readings.withColumn("rescued", rescued).withColumn("accepted", (c("conf") >= 0.75) & ((c("wordlike_share") >= 0.5) | c("rescued")))


def needs_deeper_read(kind_of: Column, wordlike: Column, ocr_empty: Column, least: float = 0.6) -> Column:
    """A page that the ordinary reader will struggle with; without evidence nothing dear is spent."""
    return (kind_of != "digital") & F.coalesce(wordlike < least, ocr_empty, F.lit(False))


def fate(kind_of: Column, script_kind: Column, n_lines: Column, n_images: Column, unseen: Column, curves: Column) -> Column:
    """What became of a page whose own text was turned down: read, blank or lost.

    unseen: letters that a reader saw and the text lacks, null where none looked; curves: drawn ones, null if unknown.
    """
    return (
        F.when(kind_of == "suspect", F.when(script_kind.isin("digital", "ocr") & (n_lines > 0), "read").otherwise("lost"))
        .when((kind_of != "none") | (n_images > 0), "lost")
        .when(unseen.isNull(), F.when(curves == 0, "blank").otherwise("lost"))
        .otherwise(F.when(unseen < READABLE, "blank").otherwise("lost"))
    )


def sideways_turn(down: Column, up: Column, total: Column) -> Column:
    """The clockwise turn that makes a page upright: 0, 90 or 270."""
    both = down + up
    return F.when((both < 40) | (both < 0.6 * F.greatest(F.lit(1), total)), 0).when(down >= up, 270).otherwise(90)


def severity_rank(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, severity), F.lit(0))


def completion(issues: DataFrame, *keys: str) -> DataFrame:
    """keys, issues, completion: the worst severity decides; tasks keep one maximum a key before the shuffle."""
    worst = F.max(severity_rank(F.col("severity")))
    return issues.groupBy(*keys).agg(F.count("*").alias("issues"), F.element_at(F.array(*map(F.lit, COMPLETION)), (worst + 1).cast("int")).alias("completion"))


def all_issues(issues: DataFrame, warnings: DataFrame, *keys: str) -> DataFrame:
    """Typed issues and, as notes, the warnings whose message none of them has."""
    said = issues.select(*keys, "message").distinct()
    rest = warnings.join(said, [*keys, "message"], "left_anti").select(*keys, F.lit("warning").alias("code"), F.lit("note").alias("severity"), "message")
    return issues.select(*keys, "code", "severity", "message").unionByName(rest)


def confidence(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, confidence: the mean over pages of .9 digital, .5 read by a model, .6 else, 0 where unusable."""
    tenths = F.when(~F.col("usable"), 0).when(F.col("kind") == "digital", 9).when(F.col("kind") == "vision", 5).otherwise(6)
    return pages.groupBy(*keys).agg((F.sum(tenths) / (F.count("*") * 10)).alias("confidence"))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """keys, name: the value of the greatest total weight, the smaller one on ties."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_w"), -F.col(value))).alias(name))


def body_size(words: DataFrame, *keys: str) -> DataFrame:
    """keys, body_size: the size, to half points, that most characters of words (size, text) are set in."""
    half = words.withColumn("_s", F.round(F.col("size") * 2) / 2).withColumn("_n", F.length("text")).filter("_s > 0")
    return weighted_mode(half, list(keys), "_s", "_n", "body_size")


def main_size(chars: DataFrame, *keys: str) -> DataFrame:
    """keys, size: the largest size, to tenths, of at least three tenths of the characters, else the commonest."""
    counts = chars.filter("size > 0").groupBy(*keys, F.round("size", 1).alias("_s")).agg(F.count("*").alias("_n"))
    totals = counts.withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    real = F.max(F.when(F.col("_n") >= 0.3 * F.col("_all"), F.col("_s")))
    return totals.groupBy(*keys).agg(F.coalesce(real, F.max_by("_s", F.struct("_n", "_s"))).alias("size"))


def baselines(chars: DataFrame, *keys: str) -> DataFrame:
    """keys, baseline: the mean origin of the characters of 85 % of the largest size, extension faces aside."""
    sized = chars.withColumn("_big", F.max("size").over(W.partitionBy(*keys)))
    main = (F.col("size") >= 0.85 * F.col("_big")) & ~F.upper("font").contains("CMEX")
    return sized.groupBy(*keys).agg(F.coalesce(F.avg(F.when(main, F.col("origin_y"))), F.avg("origin_y")).alias("baseline"))
