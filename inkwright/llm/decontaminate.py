"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel distance.

Items are measured first. Those that one automaton can hold go to every task, and documents are scanned
once and never shuffled. Of any more only a bit table of fixed size, set by the hashes of their pieces,
goes to the tasks: one scan of the documents leaves the places that hit it, those meet the pieces by
hash, and what remains is verified where document and item meet. Either way documents are scanned once.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, map_texts, texts

RATE = 0.05  # edits allowed, as a share of an item's characters
BLOCK_BYTES = 1 << 20  # of items that one automaton holds and every task gets
SLOTS, SLOT_BITS = 1 << 11, 1 << 16  # of the bit table: 16 MB, whatever the items
BASE = 0x9E3779B97F4A7C15  # of the rolling hash
INVERSE = pow(BASE, -1, 1 << 64)


def normal(text: str) -> str:
    """Lower case, with every run of white space one space."""
    return " ".join(text.lower().split())


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k of an item and its k + 1 pieces with their places."""
    k = int(len(item) * rate)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the first best place in text that is within k edits of the pattern, if any."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        at[ch] |= 1 << i
    up, down, score, best = mask, 0, m, None
    for j, ch in enumerate(text):
        eq = at.get(ch, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & mask
        hp = down | (mask & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & mask
        up = ((hn << 1) & mask) | (mask & ~(d0 | hp))
        down = hp & d0
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """One block of items: an automaton over all their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, places = [], defaultdict(list)
        for item_id, text in items:
            k, parts = pieces(text, rate)
            for at, part in parts:
                places[part].append((len(self.items), at))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, item length) of every item within its budget somewhere in the text."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text) if self.any else ():
            for i, at in where:
                _, item, k = self.items[i]
                start = end + 1 - size - at
                if start >= -k and start + len(item) <= len(text) + k:
                    windows[i].append((max(0, start - k), start + len(item) + k))
        out = []
        for i, spans in windows.items():
            item_id, item, k = self.items[i]
            if best := nearest(item, k, text, spans):
                out.append((item_id, *best, len(item)))
        return sorted(out)


def nearest(item: str, k: int, text: str, spans: list[tuple[int, int]]) -> tuple[int, int] | None:
    """(distance, end) of the first best place within k edits in the spans of the text, if any."""
    best = None
    for a, b in merged(sorted(set(spans))):
        found = myers(item, text[a:b], k)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], a + found[1])
    return best


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Unions of the sorted spans that overlap."""
    start, end = None, None
    for a, b in spans:
        if start is None:
            start, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield start, end
            start, end = a, b
    if start is not None:
        yield start, end


def normalised(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """uid, item_id, text of the items that have one, written once; uid is the row's own."""

    def run(ids: list, values: list[str]) -> dict[str, list]:
        rows = [(i, t) for i, t in zip(ids, map(normal, values)) if t]
        return {"item_id": [i for i, _ in rows], "text": [t for _, t in rows]}

    return cut(map_texts(texts(items, id_col, text_col), run, "item_id long, text string").select(F.monotonically_increasing_id().alias("uid"), "item_id", "text"))


_MATCHERS: dict[int, Matcher] = {}


def _matcher(block: list[tuple[int, str]], rate: float) -> Matcher:
    seed = hash((rate, tuple(block)))
    if seed not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[seed] = Matcher(block, rate)
    return _MATCHERS[seed]


def _block(known: DataFrame, block_bytes: int) -> list[tuple[int, str]] | None:
    """The items, if their measured size is within the bound; else None, and none of them comes to the driver."""
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return [(r["item_id"], r["text"]) for r in known.select("item_id", "text").collect()] if size <= block_bytes else None


def window_hashes(text: str, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the window that begins at each place) for every size that fits."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(codes) - 1), BASE, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(codes) - 1), INVERSE, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)]
    for size in sizes:
        if size <= len(codes):
            h = (sums[size:] - sums[:-size]) * back[: len(codes) - size + 1]
            yield size, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def piece_rows(known: DataFrame, rate: float) -> DataFrame:
    """uid, size, h, at: the hash of every piece of every item."""

    def run(ids: list, values: list[str]) -> dict[str, list]:
        rows = [(uid, len(part), int(next(window_hashes(part, [len(part)]))[1].view(np.int64)[0]), at) for uid, text in zip(ids, values) for at, part in pieces(text, rate)[1]]
        return dict(zip(("uid", "size", "h", "at"), map(list, zip(*rows)) if rows else ([], [], [], [])))

    return map_texts(known.select(F.col("uid").alias("doc_id"), "text"), run, "uid long, size int, h long, at int")


def bit_table(parts: DataFrame) -> np.ndarray:
    """A bit for every piece's hash, gathered slot by slot: SLOTS rows of SLOT_BITS bits at most come to the driver."""
    place = F.shiftrightunsigned("h", 64 - (SLOTS * SLOT_BITS - 1).bit_length())

    def fill(group: pa.Table) -> pa.Table:
        bits = np.zeros(SLOT_BITS, np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        return pa.table({"slot": group.column("slot")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    held = parts.select(F.floor(place / SLOT_BITS).cast("int").alias("slot"), (place % SLOT_BITS).cast("int").alias("bit")).distinct()
    table = np.zeros((SLOTS, SLOT_BITS // 8), np.uint8)
    for r in held.groupBy("slot").applyInArrow(fill, "slot int, bits binary").collect():
        table[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _text_key(text) -> list:
    return [F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(7), text).alias("kb")]


def _joined(docs: DataFrame, known: DataFrame, rate: float) -> DataFrame:
    """doc_id, text and leaks by way of the bit table; docs has doc_id and text."""
    parts = cut(piece_rows(known, rate))
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # no more than 1 / rate
    table = docs.sparkSession.sparkContext.broadcast(bit_table(parts))
    shift = np.uint64(64 - (SLOTS * SLOT_BITS - 1).bit_length())

    def scan(batches):
        for batch in batches:
            bits, out = table.value, [[], [], [], [], []]
            for ka, kb, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size, h in window_hashes(normal(text), sizes):
                    at = h >> shift
                    hit = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    for column, values in zip(out, ([ka] * len(hit), [kb] * len(hit), [size] * len(hit), h[hit].view(np.int64).tolist(), hit.tolist())):
                        column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["ka", "kb", "size", "h", "pos"])

    hits = docs.select(*_text_key(F.col("text")), "text").mapInArrow(scan, "ka long, kb long, size int, h long, pos long").distinct()
    starts = hits.join(parts, ["size", "h"]).select("ka", "kb", "uid", (F.col("pos") - F.col("at")).alias("start"))
    candidates = starts.groupBy("ka", "kb", "uid").agg(F.collect_set("start").alias("starts")).join(known.select("uid", "item_id", F.col("text").alias("item")), "uid")
    paired = docs.select("doc_id", "text", *_text_key(F.col("text"))).join(candidates, ["ka", "kb"]).select("doc_id", "text", "item_id", "item", "starts")

    def verify(batches):
        for batch in batches:
            rows = []
            for doc_id, raw, item_id, item, starts in zip(*(c.to_pylist() for c in batch.columns)):
                text, k = normal(raw), int(len(item) * rate)
                spans = [(max(0, a - k), a + len(item) + k) for a in starts if a >= -k and a + len(item) <= len(text) + k]
                if spans and (best := nearest(item, k, text, spans)):
                    rows.append((doc_id, raw, item_id, *best, len(item)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["doc_id", "text", "item_id", "distance", "match_end", "item_chars"])

    return paired.mapInArrow(verify, "doc_id long, text string, item_id long, distance int, match_end long, item_chars int")


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, match_end, item_chars: every document that holds an item within its budget.

    Texts and items are compared in lower case with single spaces; the budget is `rate` of an
    item's characters, rounded down. match_end is a place in the text so changed. Of places that are equally near the
    first counts. Items of up to `block_bytes` in all are matched by one automaton, more by hash joins, with the same result. Null or
    empty items and texts match nothing; null ids and repeated rows, of either table, give rows of their own; a very long text is
    scanned whole by one task; empty tables give none; other columns are ignored.
    """
    known, own = normalised(items), texts(docs)
    block = _block(known, block_bytes)
    if block is None:
        return _joined(own, known, rate).drop("text")

    def run(ids: list, values: list[str]) -> dict[str, list]:
        matcher = _matcher(block, rate)
        rows = [(doc_id, *found) for doc_id, text in zip(ids, values) for found in matcher.find(normal(text))]
        return dict(zip(("doc_id", "item_id", "distance", "match_end", "item_chars"), map(list, zip(*rows)) if rows else ([], [], [], [], [])))

    return map_texts(own, run, "doc_id long, item_id long, distance int, match_end long, item_chars int")


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns as they were, that hold no item within its budget; see find_leaks.

    Null and empty texts stay, as do repeated rows, each or none of them; without items all rows stay; an
    empty table stays empty. Very long texts are scanned whole.
    """
    known = normalised(items)
    block = _block(known, block_bytes)
    if block is None:
        mine = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        inner = docs.toDF(*mine.values())
        text = F.coalesce(F.col(mine["text"]).cast("string"), F.lit(""))
        leaking = _joined(texts(docs), known, rate).select(*_text_key(F.col("text"))).distinct()
        return inner.select("*", *_text_key(text)).join(leaking, ["ka", "kb"], "left_anti").select(*[F.col(m).alias(c) for c, m in mine.items()])

    def run(batches):
        for batch in batches:
            matcher = _matcher(block, rate)
            yield batch.filter(pa.array([not text or not matcher.find(normal(text)) for text in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
