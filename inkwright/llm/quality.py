"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, map_texts, texts

FOLDS = 5
THRESHOLD = 0.3
POOL = 0.2  # share of the pooled covariance in each class's
RIDGE = 0.1  # share of its mean variance, as a sphere, in the result
SOFTEN = 4.0  # the log odds are divided by this, as the statistics of a text are not normal
STATISTICS = ("length", "word_length", "distinct", "top_word", "upper", "digit", "stop", "symbol", "squeeze")
_UPPER, _DIGIT, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()"
_PLAIN = bytes(range(128, 256)) + b"abcdefghijklmnopqrstuvwxyz" + _UPPER + _DIGIT + _STOP + b" \t\r\n\f\v"


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; shares are of bytes, with a few bytes' worth of the usual share added."""
    raw = text.encode()
    n, words = len(raw), raw.split()
    share = lambda k, usual: math.sqrt((k + 20 * usual) / (n + 20))
    count = lambda chars: n - len(raw.translate(None, chars))
    tally = Counter(words)
    w = len(words)
    return [
        math.log1p(n),
        math.log((n - w + 50) / (w + 10)),
        math.log((len(tally) + 8) / (w + 10)),
        math.log((max(tally.values(), default=0) + 1) / (w + 20)),
        share(count(_UPPER), 0.015),
        share(count(_DIGIT), 0.0),
        share(count(_STOP), 0.025),
        share(n - count(_PLAIN), 0.0),
        math.log((len(zlib.compress(raw, 1)) + 30) / (n + 90)),
    ]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double column for each of STATISTICS."""

    def run(ids: list, values: list[str]) -> dict[str, list]:
        rows = np.array([statistics(t) for t in values]).reshape(-1, len(STATISTICS))
        return {"doc_id": ids} | {name: rows[:, k] for k, name in enumerate(STATISTICS)}

    return map_texts(texts(df, id_col, text_col), run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray  # inverse factors, cached: the Mahalanobis distance is the norm of whiten @ (x - mean)
    offset: np.ndarray  # log prior less half the log determinant
    constant: float | None = None  # the score where one class or both have no rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of x."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [self.offset[c] - 0.5 * (((z - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / SOFTEN, -500, 500)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """From the count, sums and sums of products of each class."""
    p = len(STATISTICS)
    n = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
    if not n[0] or not n[1]:
        zero = np.zeros((2, p))
        return Discriminant(zero[0], zero[0] + 1, zero, np.zeros((2, p, p)), zero[:, 0], 0.5 if n[0] == n[1] else float(n[1] > 0))
    total = n[0] + n[1]
    centre = (moments[0][1] + moments[1][1]) / total
    spread = np.diag(moments[0][2] + moments[1][2]) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-12))
    means, inner = np.zeros((2, p)), np.zeros((2, p, p))
    for c in (0, 1):
        mean = moments[c][1] / n[c]
        inner[c] = (moments[c][2] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        means[c] = (mean - centre) / scale
    pooled = (n[0] * inner[0] + n[1] * inner[1]) / total
    whiten, offset = np.zeros((2, p, p)), np.zeros(2)
    for c in (0, 1):
        shrunk = (1 - pool) * inner[c] + pool * pooled
        shrunk = (1 - ridge) * shrunk + ridge * max(np.trace(shrunk) / p, 1e-6) * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        whiten[c] = np.linalg.inv(factor)
        offset[c] = math.log(n[c] / total) - np.log(np.diag(factor)).sum()
    return Discriminant(centre, scale, means, whiten, offset)


def held_out(doc_id):
    """Whether an id is in the fold that is never learned from; null ids never carry labels that count."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Learn from the labelled rows out of the held-out fold, by one aggregation over all of them, around the mean of all rows."""
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").filter(~held_out(F.col("labelled")))
    base = [x or 0.0 for x in stats.agg(*[F.avg(s) for s in STATISTICS]).first()]  # near which sums of squares keep their digits
    apart = [F.col(s) - b for s, b in zip(STATISTICS, base)]
    rows = (
        stats.join(known, F.col("doc_id") == F.col("labelled"))
        .groupBy("label")
        .agg(F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(apart)], *[F.sum(apart[i] * apart[j]).alias(f"q{i}_{j}") for i, j in pairs])
        .collect()  # two rows
    )
    moments = {}
    for r in rows:
        product = np.zeros((len(STATISTICS),) * 2)
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"q{i}_{j}"]
        moments[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(len(STATISTICS))]), product)
    model = discriminant(moments)
    model.centre = model.centre + np.array(base)
    return model


def classify(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of df.

    Only the text enters a score. Labels other than 0 and 1 are ignored, repeated ones count again;
    without rows of both labels every score is that of the label there is, or one half. Null or
    empty texts are scored as texts of no bytes. Null ids and repeated rows pass through; other
    columns are ignored; an empty table gives none.
    """
    own = cut(measured(df, id_col, text_col))
    model = fit(own, labels, label_col)

    def run(batches):
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *STATISTICS).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
