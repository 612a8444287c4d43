"""SimHash near-dedup by ball hashing that meets in the middle.

Two fingerprints within 2r bits share a value within r bits of each. Every fingerprint stands for
all its variants within r = 2 flips; they are shuffled by a hash of the variant, and whoever
collides is linked. That hash is linear: the 64 bits are dealt to k blocks and the key is the
blocks' parities, so a flip turns one bit of the key. The 2,081 variants of a fingerprint therefore
fall on 1 + k + k(k-1)/2 keys, one row each, and the receiver writes out those variants of its key
alone. Near copies differ in bits of all blocks, so they spread over the keys and no key is hot.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._arrow import cut, map_texts, texts

BITS = 64
RADIUS = 2  # half of the greatest distance
WORDS = 4
GROUP = 2_000  # fingerprints to aim for with each key of their own
VARIANTS = 4_000_000  # written out at a time


def fingerprint(text: str, xxh64) -> int:
    """Majority bits of the XXH64 of the four-word shingles, as a signed long."""
    words = text.encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        values = [xxh64(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        values = [xxh64(joined[a:b], 42) for a, b in zip((ends - sizes).tolist(), ends[WORDS - 1 :].tolist())]
    bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.uint32) * 2 > len(values)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: one row for each row of df."""

    def run(ids: list, values: list[str]) -> dict[str, list]:
        import xxhash

        return {"doc_id": ids, "fp": [fingerprint(t, xxhash.xxh64_intdigest) for t in values]}

    return map_texts(texts(df, id_col, text_col), run, "doc_id long, fp long")


def key_bits(n: int) -> int:
    """Blocks, and so bits of the key, for n distinct fingerprints."""
    return min(24, max(4, math.ceil(math.log2(max(1, n) / GROUP))))


def variant_masks(k: int) -> dict[int, np.ndarray]:
    """By the key bits they turn: the flips of at most RADIUS bits."""
    out: dict[int, list[int]] = {}
    for n in range(RADIUS + 1):
        for bits in combinations(range(BITS), n):
            key = mask = 0
            for b in bits:
                key ^= 1 << (b % k)
                mask |= 1 << b
            out.setdefault(key, []).append(mask)
    return {key: np.array(masks, np.uint64) for key, masks in out.items()}


def key_of(fps: np.ndarray, k: int) -> np.ndarray:
    """The parities of the k blocks of each fingerprint."""
    out = np.zeros(len(fps), np.int64)
    for block in range(k):
        mask = np.uint64(sum(1 << b for b in range(block, BITS, k)))
        out |= (np.bitwise_count(fps & mask) & 1).astype(np.int64) << block
    return out


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def collide(fps: np.ndarray, turned: np.ndarray, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller root) among the fingerprints that share a variant of this key.

    All fingerprints with one variant are within 2 * RADIUS bits of each other, so a link from each
    to the first is enough. A key with many variants is taken in several passes over parts of
    them, which bounds the memory and loses none.
    """
    own, at = np.unique(fps, return_inverse=True)
    order = np.argsort(turned, kind="stable")
    starts = np.flatnonzero(np.diff(turned[order], prepend=-1))
    runs = [(masks[int(turned[order[s]])], at[order[s:e]]) for s, e in zip(starts, [*starts[1:], len(order)])]
    passes = max(1, -(-sum(len(m) * len(i) for m, i in runs) // VARIANTS))
    ends: list[np.ndarray] = []
    for turn in range(passes):
        values, owners = [], []
        for mask, members in runs:
            step = max(1, VARIANTS // 4 // len(mask))
            for j in range(0, len(members), step):
                part = members[j : j + step]
                v = (own[part][:, None] ^ mask[None, :]).ravel()
                o = np.repeat(part.astype(np.int32), len(mask))
                if passes > 1:
                    here = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == turn
                    v, o = v[here], o[here]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values), np.concatenate(owners)
        ranked = np.sort(v)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            continue
        seen = np.zeros(1 << 20, bool)
        seen[(twice * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)] = True
        maybe = seen[(v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)]
        v, o = v[maybe], o[maybe]
        by = np.lexsort((o, v))
        v, o = v[by], o[by]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        head = np.repeat(o[first], np.diff(np.r_[first, len(v)]))
        pair = np.unique(np.stack([head, o])[:, head != o], axis=1)
        close = np.bitwise_count(own[pair[0]] ^ own[pair[1]]) <= 2 * RADIUS
        ends.append(pair[:, close])
    if not ends:
        return own[:0], own[:0]
    a, b = np.concatenate(ends, axis=1)
    root = components(a, b, len(own))
    linked = np.flatnonzero(root != np.arange(len(own)))
    return own[linked], own[root[linked]]


def links(fps: DataFrame, n: int) -> DataFrame:
    """a, b: links that join the distinct fingerprints of `fps` (column fp) just as all pairs within 2 * RADIUS bits do."""
    k = key_bits(n)
    masks = variant_masks(k)
    turns = np.array(sorted(masks), np.int64)

    def route(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = key_of(own.view(np.uint64), k)
            for t in turns:
                yield pa.RecordBatch.from_arrays([pa.array((keys ^ t).astype(np.int32)), pa.array(np.full(len(own), t, np.int32)), pa.array(own)], names=["key", "turned", "fp"])

    def join(group: pa.Table) -> pa.Table:
        own = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = collide(own, group.column("turned").to_numpy().astype(np.int64), masks)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(route, "key int, turned int, fp long").groupBy("key").applyInArrow(join, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the smallest node that it reaches.

    Alternating star contraction: nodes above a node are hung on its smallest neighbour, then
    those below it are, until nothing changes. Each round is cut in the checkpoint folder.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b").distinct()
        now = cut(small)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _placed(own: DataFrame) -> DataFrame:
    """fp, least (its smallest doc_id) and root (its component) of every distinct fingerprint of own (doc_id, fp)."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(distinct, distinct.count()))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of df, all columns as they were: of its smallest doc_id, null last.

    Of rows that share that id the one of the smallest fingerprint stays, and of equal fingerprints the
    first text in order. Texts are fingerprinted again where they are kept, as ids alone may be
    repeated or null.
    """
    placed = _placed(cut(fingerprints(df, id_col, text_col)))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("b")).select(F.col("b.least").alias("keep_id"), F.col("b.fp").alias("keep_fp"))
    mine = {c: f"c{i}" for i, c in enumerate(df.columns)}
    inner = df.toDF(*mine.values())
    text_at = list(mine).index(text_col)

    def add(batches):
        import xxhash

        for batch in batches:
            fps = [fingerprint(t or "", xxhash.xxh64_intdigest) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, "fp"])

    known = inner.mapInArrow(add, StructType([*inner.schema.fields, StructField("fp", LongType())]))
    doc_id = F.col(mine[id_col]).cast("long")
    kept = known.join(best, (F.col("fp") == F.col("keep_fp")) & doc_id.eqNullSafe(F.col("keep_id")))
    first = F.row_number().over(W.partitionBy("keep_fp", "keep_id").orderBy(mine[text_col]))
    return kept.withColumn("nth", first).filter("nth = 1").select(*[F.col(m).alias(c) for c, m in mine.items()])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of df.

    component_id is the smallest doc_id that links of at most four differing bits reach, the
    row's own included; ids that are null count last, and a component of null ids alone has a null id.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives none.
    """
    own = cut(fingerprints(df, id_col, text_col))
    placed = _placed(own)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select(F.col("fp").alias("named"), "component_id")
    return own.join(named, F.col("fp") == F.col("named")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
