"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under byte trigrams of each
language, the language that markup declares, the address suffix, and a prior for the host that is
smoothed from host to domain to suffix to the whole corpus. All but the first are tables of
soft counts, made by grouped aggregation of the text's own posteriors over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._arrow import chunks

BUCKETS = 1 << 15
INDEPENDENT = 60  # trigrams that count in full; of longer texts the mean counts so often
PRIOR_ROWS = 10.0  # rows' worth of the level above in a host's, domain's or suffix's prior
EVIDENCE_ROWS = 1.0  # rows' worth of an even spread in what is declared
BROADCAST_ROWS = 20_000  # of a table of soft counts, at some hundred bytes each
LEAST = 0.5  # posterior of an accepted row
TOGETHER = 1 << 20  # characters whose trigrams are counted at a time
_LETTER = r"\p{L}"


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, with a space on either side."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(40503) + b[1:-1] * np.uint32(30011) + b[2:] * np.uint32(7919)) * np.uint32(2654435761)) >> np.uint32(17)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log probabilities

    def likelihood(self, text: str) -> np.ndarray:
        """Log likelihood under each language, tempered; of equal parts for a text without a trigram."""
        if not text:
            return np.zeros(len(self.languages))
        at = trigrams(text)
        return self.weights[at].mean(axis=0, dtype=np.float64) * min(len(at), INDEPENDENT)


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Count the trigrams of all labelled rows by language; counts are summed in each task before the shuffle."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_pylist()
            labels = batch.column(1).to_pylist()
            for i, j in chunks(values, [len(t) for t in values], TOGETHER):
                found: dict[str, list[np.ndarray]] = {}
                for text, label in zip(values[i:j], labels[i:j]):
                    found.setdefault(label, []).append(trigrams(text))
                for label, parts in found.items():
                    sums[label] = sums.get(label, 0) + np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for label, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["label", "bucket", "n"])

    labelled = df.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(label_col).cast("string")).alias("label")).filter("text <> '' AND label <> ''")
    counts = labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))

    def column(group: pa.Table) -> pa.Table:
        out = np.zeros(BUCKETS, "<i8")
        out[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table({"label": group.column("label")[:1], "c": pa.array([out.tobytes()], pa.binary())})

    rows = counts.groupBy("label").applyInArrow(column, "label string, c binary").collect()  # one row a language, of 8 * BUCKETS bytes
    languages = sorted(r["label"] for r in rows)
    table = np.full((BUCKETS, len(languages)), 0.5)
    for r in rows:
        table[:, languages.index(r["label"])] += np.frombuffer(r["c"], "<i8")
    return Model(languages, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32) if languages else table)


def _soft(scores: np.ndarray) -> np.ndarray:
    """Shares of each row in proportion to the exponentials."""
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _likelihoods(values: list[str | None], model: Model) -> np.ndarray:
    return np.array([model.likelihood(t or "") for t in values]).reshape(-1, len(model.languages))


def posterior(ll: np.ndarray, counts: dict[str, np.ndarray], whole: np.ndarray, kinds: dict[str, int]) -> np.ndarray:
    """Posteriors of rows with log likelihoods ll, whose soft counts at each level are `counts`: rows of nan say nothing.

    A row's own share is taken out of the counts first. The prior is smoothed from the whole over suffix
    and domain to the host; what is declared and the suffix are likelihoods besides.
    """
    n, p = ll.shape[1], _soft(ll)
    total = whole.sum()
    silent = {key: np.isnan(c).any(axis=1, keepdims=True) for key, c in counts.items()}
    less = {key: np.where(silent[key], 0.0, np.maximum(c - p, 0.0)) for key, c in counts.items()}
    prior = (whole - p + 1.0 / n) / (total - 1 + 1.0) if total > 0 else np.full_like(ll, 1.0 / n)
    prior = np.maximum(prior, 1e-9)
    for key in ("suffix", "domain", "host"):
        prior = (less[key] + PRIOR_ROWS * prior) / (less[key].sum(axis=1, keepdims=True) + PRIOR_ROWS)
    score = ll + np.log(prior)
    for key in ("declared", "suffix"):
        chance = (less[key] + EVIDENCE_ROWS / max(1, kinds[key])) / (np.maximum(whole - p, 0.0) + EVIDENCE_ROWS)
        score += np.where(silent[key], 0.0, np.log(chance))
    return _soft(score)


LEVELS = ("declared", "suffix", "domain", "host")


def fuse(df: DataFrame, model: Model) -> DataFrame:
    """df's columns k (any), text, declared, host, domain, suffix and any others, with lang, confidence, text_lang and keep.

    Null evidence says nothing. A row is kept if its text has a letter and the posterior of its best
    language is at least LEAST; ties go to the language first in the alphabet. A model of no languages
    keeps rows with letters and names none.
    """
    n = len(model.languages)
    letters = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    if not n:
        return df.select("*", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), letters.alias("keep"))
    from ._arrow import cut

    def soften(batches):
        for batch in batches:
            p = _soft(_likelihoods(batch.column(0).to_pylist(), model))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(p[:, i]) for i in range(n)]], names=[*LEVELS, *[f"p{i}" for i in range(n)]])

    sums = lambda: [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    soft = df.select("text", *LEVELS).mapInArrow(soften, ", ".join([*[f"{key} string" for key in LEVELS], *[f"p{i} double" for i in range(n)]]))
    by = cut(soft.groupBy(*LEVELS).agg(*sums()))  # a row for each host and what it declares: what all the tables are made of
    whole = np.array([x or 0.0 for x in by.agg(*sums()).first()])
    out, kinds = df.withColumn("letters", letters), {}
    for key in LEVELS:
        counts = by.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key")).agg(*sums()).select(f"{key}_key", F.array(*[f"p{i}" for i in range(n)]).alias(f"{key}_n"))
        kinds[key] = counts.count()
        # a table this small may go to every executor; a larger one meets the rows by a shuffle, whose hot keys are split at run time
        out = out.join(F.broadcast(counts) if kinds[key] <= BROADCAST_ROWS else counts, F.col(key) == F.col(f"{key}_key"), "left")
    out = out.select(*df.columns, "letters", *[f"{key}_n" for key in LEVELS])
    names = np.array(model.languages, object)
    width, told = len(df.columns), [*df.columns, "lang", "confidence", "text_lang", "keep"]

    def judge(batches):
        for batch in batches:
            ll = _likelihoods(batch.column(1).to_pylist(), model)
            counts = {key: np.array([[np.nan] * n if c is None else c for c in batch.column(width + 1 + i).to_pylist()], float).reshape(-1, n) for i, key in enumerate(LEVELS)}
            found = posterior(ll, counts, whole, kinds) if len(ll) else ll
            best, own = (x.argmax(axis=1) if len(ll) else np.zeros(0, int) for x in (found, ll))
            sure = found.max(axis=1) if len(ll) else np.zeros(0)
            keep = batch.column(width).to_numpy(zero_copy_only=False).astype(bool) & (sure >= LEAST)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names[best], pa.string()), pa.array(sure), pa.array(names[own], pa.string()), pa.array(keep)], names=told)

    extra = StructType.fromDDL("lang string, confidence double, text_lang string, keep boolean")
    return out.mapInArrow(judge, StructType([*df.schema.fields, *extra.fields]))


def from_documents(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Evidence of plain documents: the source stands for the host, the lang column is what is declared."""
    blank = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), blank("lang").alias("declared"), blank("source").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))


def from_pages(df: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Evidence of web pages: visible text, the lang attribute, host, domain, and suffix with a two-letter first folder."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    folder = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:/|$)", 1)
    visible = F.regexp_replace(F.col("html").cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    return df.select(
        F.col(id_col).cast("long").alias("k"),
        F.coalesce(visible, F.lit("")).alias("text"),
        blank(declared).alias("declared"),
        blank(host).alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        blank(F.concat_ws("/", blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)), blank(folder))).alias("suffix"),
    )


def identify(documents: DataFrame, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """kind, doc_id, page_id, lang, confidence, text_lang, declared, keep: a row for each document and page.

    The text model is counted over all documents with a lang. Null or empty texts have no letter and
    are not kept; null hosts, addresses and declarations are no evidence; null ids and repeated
    rows pass through; other columns are ignored; empty tables give none.
    """
    model = model or train(documents)
    both = from_documents(documents).withColumn("kind", F.lit("document")).unionByName(from_pages(pages).withColumn("kind", F.lit("page")))
    out = fuse(both, model)
    one = lambda kind: F.when(F.col("kind") == kind, F.col("k"))
    return out.select("kind", one("document").alias("doc_id"), one("page").alias("page_id"), "lang", "confidence", "text_lang", "declared", "keep")


def keep_identified(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of documents, all columns as they were, whose language is identified; see fuse."""
    model = model or train(documents)
    extra = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    evidence = documents.select(
        F.lit(0).cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.nullif(F.lower(F.trim("lang")), F.lit("")).alias("declared"), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("host"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"),
        *[F.col(f"`{c}`").alias(x) for c, x in extra.items() if c != "text"],
    )
    kept = fuse(evidence, model).filter("keep")
    return kept.select(*[F.col("text" if c == "text" else x).alias(c) for c, x in extra.items()])
