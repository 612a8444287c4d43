"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

Relationally: explode the documents into n-grams, count them in tables partitioned by hash, join the
counts to the exploded n-grams by key, and sum per document. The rows of these relations travel packed.
Runs of documents are tokenised once and written, under a number of their own, to the checkpoint
folder; whatever is read later is read from there. A run sends, for each order and hash range, its
distinct n-gram keys as one sorted, delta-coded array with their counts, so that repeated n-grams,
however frequent, are one entry a run. A hash range adds the arrays up and sends each run the totals of its
keys. The number of ranges follows the number of words, so no range grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, cut, texts

ORDER = 3
ALPHA = 0.4
LEAST = 1  # occurrences of an n-gram of two words and more in other documents that let it answer
RUN_BYTES = 16 << 20
RANGE_KEYS = 1 << 20  # n-grams of one order to add up in one range, at most and on average
KEY_BITS = 56
RAW = 64  # bytes up to which nothing is compressed
_ZSTD = None


def _codec() -> pa.Codec:
    global _ZSTD
    _ZSTD = _ZSTD or pa.Codec("zstd", compression_level=1)
    return _ZSTD


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, the empty ones left out, compressed."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()
    return len(values).to_bytes(8, "little") + bytes([wide]) + (planes if len(planes) <= RAW else _codec().compress(planes, asbytes=True))


def expand(blob: bytes) -> np.ndarray:
    """What squeeze has packed."""
    n, wide = int.from_bytes(blob[:8], "little"), blob[8]
    planes = blob[9:] if n * wide <= RAW else _codec().decompress(blob[9:], n * wide, asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(planes, np.uint8).reshape(wide, n).T
    return out.reshape(-1).view("<u8")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().encode().split()


def tokenised(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, number of each word within the run, hash of each distinct word); frequent words have small numbers."""
    import xxhash

    parts, seen = [], _Ids()
    for text in values:
        own = words(text)
        parts.append(np.fromiter((seen[w] for w in own), np.uint32, len(own)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen)) >> np.uint64(64 - KEY_BITS)
    sizes, own = np.array([len(p) for p in parts], np.uint64), np.concatenate([np.zeros(0, np.uint32), *parts])
    by = np.argsort(-np.bincount(own, minlength=len(seen)), kind="stable")
    rank = np.empty(len(seen), np.uint32)
    rank[by] = np.arange(len(seen), dtype=np.uint32)
    return sizes, rank[own], hashes[by]


def written(sizes: np.ndarray, own: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The three as bytes: word numbers in sixteen bits where they fit, the rest of them apart."""
    low = np.minimum(own, 0xFFFF).astype("<u2")
    body = _codec().compress(low.tobytes(), asbytes=True)
    return squeeze(sizes), len(own).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body + squeeze(own[low == 0xFFFF]), squeeze(hashes)


def read(sizes: bytes, own: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `written` has made of a run."""
    n, size = int.from_bytes(own[:8], "little"), int.from_bytes(own[8:16], "little")
    numbers = np.frombuffer(_codec().decompress(own[16 : 16 + size], 2 * n, asbytes=True), "<u2").astype(np.uint32) if n else np.zeros(0, np.uint32)
    numbers[numbers == 0xFFFF] = expand(own[16 + size :])
    return expand(sizes), numbers, expand(hashes)


def exploded(sizes: np.ndarray, own: np.ndarray, hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(document of each word, its place there, for n = 1 to order the key of the n-gram that ends at it).

    Keys are hashes of 56 bits; those that would reach over a document's start are not to be used.
    """
    sizes = sizes.astype(np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = (np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)

    def keys() -> Iterator[np.ndarray]:
        word = hashes[own] if len(own) else np.zeros(0, np.uint64)
        last = word
        for n in range(1, order + 1):
            if n > 1:
                before = np.zeros(len(word), np.uint64)
                before[1:] = last[:-1]
                last = _mix(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n)) >> np.uint64(64 - KEY_BITS)
            yield last

    return doc, place, keys()


def _runs(batches, run_bytes: int):
    """(ids, texts) of consecutive rows, of run_bytes of text or so; the last of a partition may be smaller."""
    ids, values, size = [], [], 0
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
        for i, j in chunks(sizes, sizes, max(1, run_bytes // 8)):
            part = sum(sizes[i:j])
            if values and size + part > run_bytes:
                yield ids, values
                ids, values, size = [], [], 0
            ids += batch.column(0).slice(i, j - i).to_pylist()
            values += batch.column(1).slice(i, j - i).to_pylist()
            size += part
    if values:
        yield ids, values


def score_parts(counts: list[np.ndarray], doc: np.ndarray, place: np.ndarray, n_docs: int, least: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of logs but for the corpus size, words that fell back to it) of each document.

    counts[n - 1] holds, for each word, how often the n-gram that ends at it occurs in other documents.
    """
    order = len(counts)
    total = np.zeros(len(doc))
    level = np.zeros(len(doc), np.int8)  # the order that answers; zero: none yet
    for n in range(order, 0, -1):
        found = (level == 0) & (place >= n - 1) & ((counts[n - 1] >= least) | (n == 1))
        level[found] = n
        at = np.flatnonzero(found)
        total[at] = np.log(np.maximum(counts[n - 1][at], 1))
        if n > 1:
            total[at] -= np.log(counts[n - 2][at - 1])
    total += math.log(alpha) * (np.minimum(place + 1, order) - level)
    sums = lambda x: np.bincount(doc, x, n_docs)
    return np.bincount(doc, minlength=n_docs), sums(total), sums((level == 1).astype(float)).astype(np.int64)


def score(df: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, run_bytes: int = RUN_BYTES, range_keys: int = RANGE_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: the mean natural log of each word's stupid-backoff score, to six decimals.

    Counts are of the whole corpus less the document's own. Of the n-grams up to `order` that end at a
    word within its document the longest that occurs at least `least` times (one or more) answers, with its count
    over its context's; each order that is skipped costs a factor `alpha`; single words are over the words of all
    other documents, and one that no other document has counts as once. A document without words has a null score.
    Null text is empty; null ids and repeated rows give rows of their own, each against all others; other columns are
    ignored; an empty table gives none. One very long text is a run of its own, in one worker's memory.
    """

    def write(batches):
        for number, (ids, values) in enumerate(_runs(batches, run_bytes)):
            run = (TaskContext.get().partitionId() << 32) + number
            parts = tokenised(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([run]), pa.array([ids], pa.list_(pa.int64())), pa.array([len(parts[1])]), *(pa.array([x], pa.binary()) for x in written(*parts))],
                names=["run", "ids", "n_words", "sizes", "words", "hashes"],
            )

    runs = cut(texts(df, id_col, text_col).mapInArrow(write, "run long, ids array<long>, n_words long, sizes binary, words binary, hashes binary"))
    corpus = runs.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, corpus) / range_keys)))
    shift = np.uint64(KEY_BITS - bits)

    def ask(batches):
        for batch in batches:
            for run, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, place, keys = exploded(*read(*parts), order)
                for n, key in enumerate(keys, 1):
                    own, times = np.unique(key[place >= n - 1], return_counts=True)
                    ranges, starts = np.unique(own >> shift, return_index=True)
                    deltas = np.diff(own, prepend=np.uint64(0))
                    deltas[starts] = own[starts] - (ranges << shift)
                    ends = [*starts[1:], len(own)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ranges.astype(np.int64) * order + (n - 1)), pa.array([run] * len(ranges), pa.int64()),
                            pa.array([squeeze(deltas[a:b]) for a, b in zip(starts, ends)], pa.binary()), pa.array([squeeze(times[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                        ],
                        names=["part", "run", "keys", "times"],
                    )

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(expand(k.as_py()), dtype=np.uint64) for k in group.column("keys")]
        times = np.concatenate([expand(t.as_py()) for t in group.column("times")])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, times).astype(np.uint64)[at]
        blobs = [squeeze(x) for x in np.split(totals, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"run": group.column("run"), "part": group.column("part"), "blob": pa.array(blobs, pa.binary())})

    def settle(answers: pa.Table, own: pa.Table) -> pa.Table:
        parts, blobs = answers.column("part").to_pylist(), answers.column("blob")
        doc, place, keys = exploded(*read(*(own.column(c)[0].as_py() for c in ("sizes", "words", "hashes"))), order)
        ids = own.column("ids")[0].as_py()
        counts = []
        for n, key in enumerate(keys):
            asked = place >= n
            distinct, at = np.unique(key[asked], return_inverse=True)
            ordered = sorted((part, i) for i, part in enumerate(parts) if part % order == n)
            totals = np.concatenate([np.zeros(0, np.uint64), *(expand(blobs[i].as_py()) for _, i in ordered)])
            others = totals.astype(float)[at]
            at += doc[asked] * np.int64(max(1, len(distinct)))  # a number for each document's own n-gram
            del distinct, totals
            _, mine, times = np.unique(at, return_inverse=True, return_counts=True)
            others -= times[mine]
            full = np.zeros(len(place))
            full[asked] = others
            counts.append(full)
            del at, mine, times, others, full
        tokens, logs, single = score_parts(counts, doc, place, len(ids), least, alpha)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": tokens, "logs": logs, "single": single})

    asked = runs.select("run", "sizes", "words", "hashes").mapInArrow(ask, "part long, run long, keys binary, times binary")
    answers = asked.groupBy("part").applyInArrow(answer, "run long, part long, blob binary")
    settled = answers.groupBy("run").cogroup(runs.groupBy("run")).applyInArrow(settle, "doc_id long, n_tokens long, logs double, single long")
    others = F.greatest(F.lit(1), F.lit(corpus) - F.col("n_tokens"))
    mean = (F.col("logs") - F.col("single") * F.log(others)) / F.col("n_tokens")
    return settled.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.round(mean, 6)).alias("score"))


SQL = """
WITH t AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)
), g AS (
  SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT doc_id, i,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
         count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3,
         greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY doc_id)) AS n
  FROM g
), p AS (
  SELECT *, lag(c2) OVER d AS b2, lag(c1) OVER d AS b1 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, CASE WHEN i >= 3 AND c3 >= 1 THEN ln(c3) - ln(b2)
                      WHEN i >= 2 AND c2 >= 1 THEN ln(c2) - ln(b1) + ln(0.4) * least(i - 2, 1)
                      ELSE ln(greatest(c1, 1)) - ln(n) + ln(0.4) * least(i - 1, 2) END AS s
  FROM p
), m AS (SELECT doc_id, count(*) AS n_tokens, round(avg(s), 6) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n_tokens, 0) AS n_tokens, m.score FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
"""
