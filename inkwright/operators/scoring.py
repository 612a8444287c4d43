"""Roll-ups of check outcomes: rates, macro means, hold-outs, intervals, and one run against another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions import text as T


def rates(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, total, passed, rate of outcomes (passed boolean)."""
    return outcomes.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("rate", F.col("passed") / F.col("total"))


def rollup(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Rates by all keys, by ever fewer of them, and overall; null where a key is rolled up."""
    return outcomes.rollup(*keys).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


def macro(outcomes: DataFrame, category: str, *keys: str) -> DataFrame:
    """keys, categories, score: the unweighted mean of the categories' pass rates."""
    each = rates(outcomes, *keys, category)
    out = each.groupBy(*keys) if keys else each.groupBy()
    return out.agg(F.count("*").alias("categories"), F.avg("rate").alias("score"))


def split(name: Column, rule: str = "sha1") -> Column:
    """held-out or tuned-on, by a hash of a file's name that never moves."""
    held = {"sha1": T.sha_mod5(name) == 0, "hex5": T.first_hex(name, 5) == 0, "hex2": T.first_hex(name, 2) == 1, "hex50": T.first_hex(name, 50) == 0}[rule]
    return F.when(held, "held-out").otherwise("tuned-on")


def holdout_pivot(outcomes: DataFrame, category: str, bucket: Column) -> DataFrame:
    """category and, for held-out and tuned-on, checks and passes side by side."""
    put = outcomes.withColumn("_b", bucket)
    agg = [F.count_if((F.col("_b") == b) & test).alias(f"{b.replace('-', '_')}_{name}") for b in ("held-out", "tuned-on") for name, test in (("total", F.lit(True)), ("passed", F.col("passed")))]
    return put.groupBy(category).agg(*agg)


def gains_losses(old: DataFrame, new: DataFrame, keys: list[str], category: str) -> DataFrame:
    """category, gains, losses: failures (keys, category) that only the old or only the new run has.

    Both anti-joins are one aggregation: a failure is marked by the runs that have it.
    """
    both = old.select(*keys, category, F.lit(True).alias("o"), F.lit(False).alias("n")).union(new.select(*keys, category, F.lit(False), F.lit(True)))
    met = both.groupBy(*keys, category).agg(F.bool_or("o").alias("o"), F.bool_or("n").alias("n")).filter("o <> n")
    return met.groupBy(category).agg(F.count_if("o").alias("gains"), F.count_if("n").alias("losses"))


def side_by_side(a: DataFrame, b: DataFrame, category: str, lost: int = 10) -> DataFrame:
    """category, passed_a, passed_b, total, moved, mark of two runs' outcomes; a category that lost ten or more is marked."""
    x, y = rates(a, category).select(category, "total", F.col("passed").alias("passed_a")), rates(b, category).select(category, F.col("passed").alias("passed_b"))
    out = x.join(y, category, "left").withColumn("passed_b", F.coalesce("passed_b", F.lit(0))).withColumn("moved", F.col("passed_b") - F.col("passed_a"))
    return out.withColumn("mark", F.when(F.col("moved") <= -lost, "lost ground").when(F.col("moved") > 0, "+").otherwise(""))


def page_deltas(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, passed_a, passed_b, total, delta of the pages that both runs scored and that moved."""
    x, y = rates(a, *keys).select(*keys, F.col("passed").alias("passed_a"), "total"), rates(b, *keys).select(*keys, F.col("passed").alias("passed_b"))
    return x.join(y, list(keys)).withColumn("delta", F.col("passed_b") - F.col("passed_a")).filter("delta <> 0")


def failed_everywhere(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys of the checks that no candidate passes."""
    return outcomes.groupBy(*keys).agg(F.bool_or("passed").alias("_any")).filter("NOT _any").select(*keys)


def worst_first(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Rates by keys, the worst first."""
    return rates(outcomes, *keys).orderBy("rate", *keys)


def bootstrap(outcomes: DataFrame, category: str, samples: int = 1000, level: float = 0.95, seed: int = 17) -> DataFrame:
    """score, low, high: the macro mean and its interval, categories resampled within themselves.

    A category's resampled passes are binomial in its pass rate, so only its two counts enter, and the
    samples are drawn on the executors from the counts; no outcome is collected.
    """
    counts = rates(outcomes, category).select("total", "passed").groupBy().agg(F.collect_list(F.struct("total", "passed")).alias("c"))

    def draw(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for c in pdf["c"]:
                if not len(c):
                    rows.append((None, None, None))
                    continue
                n, k = np.array([x["total"] for x in c]), np.array([x["passed"] for x in c])
                order = np.lexsort((k, n))
                n, k = n[order], k[order]
                means = (np.random.default_rng(seed).binomial(n, k / n, (samples, len(n))) / n).mean(axis=1)
                rows.append((float((k / n).mean()), *map(float, np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))))
            yield pd.DataFrame(rows, columns=["score", "low", "high"])

    return counts.mapInPandas(draw, "score double, low double, high double")


def parse_report(report: Column) -> Column:
    """A scorer's printed report as a struct: overall, and an array of name, score, passed and total."""
    line = r"(?m)^\s*(\S+)\s*:\s*([0-9.]+)%\s*\(([0-9]+)/([0-9]+)"
    parts = F.regexp_extract_all(report, F.lit(line), F.lit(0))
    at = lambda x, i: F.regexp_extract(x, line, i)
    overall = F.regexp_extract(report, r"Average Score:\s*([0-9.]+)%", 1)
    return F.struct(F.nullif(overall, F.lit("")).cast("double").alias("overall"), F.transform(parts, lambda x: F.struct(at(x, 1).alias("name"), at(x, 2).cast("double").alias("score"), at(x, 3).cast("long").alias("passed"), at(x, 4).cast("long").alias("total"))).alias("parts"))
