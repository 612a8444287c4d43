"""Best-fit packing by bin completion over the histogram of piece lengths.

A piece is at most `capacity` tokens long, so the histogram has at most `capacity` rows however
large the corpus is. Bin completion works on it alone: it takes the largest length that is left,
enumerates the undominated fillings beside it and applies one to some number of sequences. The
plan is a list of such patterns, and every piece finds its place in it from its rank among the
pieces of its length, which Spark counts in buckets. No piece is ever gathered with all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrow import cut, map_texts, texts

CAPACITY = 1024
END = 2
EFFORT = 10_000  # nodes and fillings that the search may look at: effort, not data
BUCKET = 100_000  # pieces of one length to rank together
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times, ((length, copies), ...)

_CODERS: dict[str, tuple] = {}


def coder(json_path: str, ranks_path: str | None):
    """text -> ids as the tokenizers file gives them, once per Python worker.

    With the same vocabulary as ranks the ids come from tiktoken, several times faster; a text that
    spells out a special token goes to the tokenizers library, whose way with it is the standard here.
    """
    if json_path not in _CODERS:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _CODERS[json_path] = exact, special, fast
    exact, special, fast = _CODERS[json_path]

    def encode(text: str) -> list[int]:
        if fast is None or any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(df: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and an end token, cut if longer than the capacity.

    All pieces but the first have exactly `capacity` tokens.
    """

    def run(ids: list, values: list[str]) -> dict[str, list]:
        encode = coder(json_path, ranks_path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(ids, values):
            tokens = np.array([*encode(text), END], "<u4")
            first = len(tokens) % capacity or capacity
            for k, start in enumerate([0, *range(first, len(tokens), capacity)]):
                part = tokens[start : start + capacity] if start else tokens[:first]
                for name, value in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))):
                    out[name].append(value)
        return out

    return map_texts(texts(df, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bounds:
    """Lower bounds on the sequences that counts by length (an array, 0 to capacity) need."""

    def __init__(self, capacity: int, steps: int = 20):
        n = np.arange(capacity + 1)
        k = np.arange(1, steps + 1)[:, None]
        self.capacity, self.scale = capacity, (k * capacity).ravel()
        self.weights = np.where((k + 1) * n % capacity == 0, k * n, (k + 1) * n // capacity * capacity)

    def __call__(self, counts: np.ndarray) -> int:
        """The greatest of the sum's bound, Martello and Toth's L2 and the rounding bounds of Fekete and Schepers."""
        size, half = counts * np.arange(self.capacity + 1), self.capacity // 2
        count_to, size_to = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, size))
        small = np.arange(half + 1)  # lengths under it are left out, those over capacity less it stand alone
        edge = self.capacity - small + 1
        room = (count_to[edge] - count_to[half + 1]) * self.capacity - (size_to[edge] - size_to[half + 1])
        more = np.maximum(0, -((room - size_to[half + 1] + size_to[small]) // self.capacity))
        l2 = count_to[-1] - count_to[half + 1] + more
        rounded = -(-(self.weights @ counts) // self.scale)
        return int(max(-(-size_to[-1] // self.capacity), l2.max(), rounded.max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Each sequence starts with the largest length left and takes the largest that fits, and so on: the first incumbent."""
    left, out = Counter(counts), []
    while left := +left:
        room, bin_of = capacity, Counter()
        for n in sorted(left, reverse=True):
            if take := min(left[n], room // n):
                bin_of[n] = take
                room -= n * take
        times = min(left[n] // c for n, c in bin_of.items())
        out.append((times, tuple(bin_of.items())))
        for n, c in bin_of.items():
            left[n] -= c * times
    return out


def _lots(left: dict[int, int], room: int) -> Iterator[tuple[int, int]]:
    """(length, copies) in falling lengths, copies in powers of two that add up to what is left and fits."""
    for n in sorted(left, reverse=True):
        c, step = min(left[n], room // n), 1
        while c > 0:
            take = min(step, c)
            yield n, take
            c, step = c - take, step * 2


def dearest(room: int, left: dict[int, int], price) -> tuple[float, list[int]]:
    """(worth, lengths in falling order) of the filling of the room that is worth most at these prices."""
    worth, taken = np.zeros(room + 1), []
    for n, c in _lots(left, room):
        s = n * c
        with_it = worth[: room + 1 - s] + price[n] * c
        better = with_it > worth[s:] + 1e-12
        if better.any():
            worth[s:] = np.where(better, with_it, worth[s:])
            taken.append((n, c, better))
    filling, at = [], room
    for n, c, better in reversed(taken):
        if at >= n * c and better[at - n * c]:
            filling += [n] * c
            at -= n * c
    return float(worth[room]), sorted(filling, reverse=True)


def prices(counts: dict[int, int], capacity: int, classes: int, rounds: int = 200) -> np.ndarray:
    """What a piece of each length, 0 to capacity, is worth as a share of a sequence: dual prices of the fillings' linear program.

    The program is solved over `classes` of neighbouring lengths by generating the dearest filling
    at a time; prices between classes are interpolated. They order fillings and bound nothing.
    """
    lengths = np.array(sorted(counts))
    each = np.array([counts[n] for n in lengths], float)
    need: Counter = Counter()
    for group in np.array_split(np.arange(len(lengths)), min(classes, len(lengths))):
        need[int(round(float(np.average(lengths[group], weights=each[group]))))] += each[group].sum()
    names = sorted(need)
    place = {n: i for i, n in enumerate(names)}
    most = {n: min(capacity // n, int(need[n])) for n in names}
    inverse = np.diag([1 / most[n] for n in names])
    times = inverse @ np.array([need[n] for n in names])
    for _ in range(rounds):
        dual = np.maximum(inverse.sum(axis=0), 0)
        worth, filling = dearest(capacity, most, dict(zip(names, dual)))
        if worth <= 1 + 1e-9:
            break
        column = np.zeros(len(names))
        for n in filling:
            column[place[n]] += 1
        change = inverse @ column
        up = change > 1e-9
        ratio = np.where(up, times / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        times -= step * change
        times[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    dual = np.maximum(inverse.sum(axis=0), 0)
    return np.interp(np.arange(capacity + 1), [0, *names], [0, *dual])


def swallows(whole: list[int], part: list[int]) -> bool:
    """Whether the items of `part`, largest first, each find the tightest room in the items of `whole`: it then dominates.

    Sorted containment is a case of it. A no may be wrong and then costs effort, never a solution.
    """
    rooms = list(whole)
    for n in part:
        fits = [r for r in rooms if r >= n]
        if not fits:
            return False
        tight = min(fits)
        rooms.remove(tight)
        rooms.append(tight - n)
    return True


class Effort:
    """What is left of the fillings and nodes that a search may look at."""

    def __init__(self, left: int):
        self.left = left


def fillings(room: int, left: dict[int, int], most_waste: int, effort: Effort) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths in falling order) of all undominated fillings of the room, least waste first, one at a time.

    For each waste a depth-first search over falling lengths, cut by the sums that the smaller
    lengths can still reach, lists what leaves just that waste; dominated ones are skipped.
    """
    lengths = [n for n in sorted(left) if n <= room and left[n] > 0]
    full, reach = (1 << (room + 1)) - 1, [1]
    for n in lengths:
        bits, c, step = reach[-1], min(left[n], room // n), 1
        while c:
            take = min(step, c)
            bits |= (bits << (n * take)) & full
            c, step = c - take, step * 2
        reach.append(bits)

    def search(target: int, top: int, taken: list[int]) -> Iterator[list[int]]:
        if not target:
            yield taken
            return
        for i in range(top, -1, -1):
            n = lengths[i]
            if not reach[i + 1] >> target & 1:
                return
            for c in range(min(left[n], target // n), 0, -1):
                if reach[i] >> (target - n * c) & 1:
                    yield from search(target - n * c, i - 1, taken + [n] * c)

    kept: list[list[int]] = []
    for waste in range(min(most_waste, room) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for filling in search(room - waste, len(lengths) - 1, []):
            effort.left -= 1
            if not any(swallows(k, filling) for k in kept):
                kept.append(filling)
                yield waste, filling
            if len(filling) <= 1 or effort.left <= 0:  # one item of that length dominates all that is left
                return


def _steps(state: Counter, allowed: int, capacity: int, effort: Effort, price: np.ndarray | None) -> Iterator[tuple[int, Counter, int]]:
    """(times, sequence, waste of each) for the largest length left.

    The dearest filling comes first where there are prices, then all undominated ones. Each comes as many times
    as it can, and again with half of that down to once, in turns with those that follow; a number
    in between is a path through several nodes.
    """
    top = max(state)
    rest = state.copy()
    rest[top] -= 1
    room, waiting = capacity - top, []

    def found() -> Iterator[tuple[int, list[int]]]:
        if price is not None:
            first = dearest(room, +rest, price)[1]
            yield room - sum(first), first
        yield from fillings(room, rest, min(allowed, room), effort)

    for waste, filling in found():
        sequence = Counter([top, *filling])
        times = min(state[n] // c for n, c in sequence.items())
        if waste:
            times = min(times, allowed // waste)
        if not times:
            continue
        yield times, sequence, waste
        waiting = [*((t // 2, s, w) for t, s, w in waiting if t > 1), (times, sequence, waste)]
        yield from (step for step in waiting[:-1])
    while waiting := [(t // 2, s, w) for t, s, w in waiting if t > 1]:
        yield from waiting


def _search(counts: dict[int, int], capacity: int, used: int, bound: int, bounds: Bounds, effort: Effort, classes: int = 0) -> tuple[list[Pattern] | None, int, bool]:
    """(patterns if they beat `used`, sequences, whether the tree is done) of one depth-first search."""
    total = sum(n * c for n, c in counts.items())
    state, vector = Counter(counts), np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        vector[n] = c
    best, path, waste, opened = None, [], 0, 0
    seen: dict[bytes, int] = {}
    price = since = None

    def options(left: Counter) -> Iterator[tuple[int, Counter, int]]:
        nonlocal price, since
        if classes and (price is None or abs(len(path) - since) >= 10):
            price, since = prices(left, capacity, classes), len(path)
            effort.left -= 5
        return _steps(left, (used - 1) * capacity - total - waste, capacity, effort, price)

    stack = [options(+state)]
    while stack and used > bound and effort.left > 0:
        effort.left -= 1
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                times, sequence, lost = path.pop()
                waste -= times * lost
                opened -= times
                for n, c in sequence.items():
                    state[n] += c * times
                    vector[n] += c * times
            continue
        times, sequence, lost = step
        if waste + times * lost > (used - 1) * capacity - total:
            continue
        path.append(step)
        waste += times * lost
        opened += times
        for n, c in sequence.items():
            state[n] -= c * times
            vector[n] -= c * times
        key = hashlib.blake2b(vector.tobytes(), digest_size=16).digest()
        left = +state
        if not left:
            best, used = [(t, tuple(s.items())) for t, s, _ in path], opened
            stack.append(iter(()))
        elif seen.get(key, opened + 1) <= opened or opened + bounds(vector) >= used:
            stack.append(iter(()))
        else:
            seen[key] = opened
            stack.append(options(left))
    return best, used, not stack or used <= bound


def plan(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[Pattern]:
    """Patterns that use up the counts in as few sequences as branch and bound finds.

    The best-fit packing is the first incumbent. A node fills the room beside the largest length
    that is left; the search turns back where the waste so far, or a lower bound on what is left, cannot beat the
    incumbent, or where the same pieces were left before. Searches in turn take the fillings by
    waste alone or by prices over several numbers of classes first. They end at the lower bound, when a tree is done, or
    after `effort` nodes and fillings in all; only the last can leave a packing that is not proved the best.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    bounds, vector = Bounds(capacity), np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        vector[n] = c
    bound, best = bounds(vector), best_fit(counts, capacity)
    used = sum(t for t, _ in best)
    share, left = max(500, 3 * len(counts)), effort
    while used > bound and left > 0:
        for classes in (0, 20, 24, 0, 16, 32, 28):
            own = Effort(min(left, share))
            left -= own.left
            found, used, done = _search(counts, capacity, used, bound, bounds, own, classes)
            left += max(0, own.left)
            best = found or best
            if done:
                return best
        share *= 2
    return best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, copies, offset) in the order of ranks."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for times, items in patterns:
        offset = 0
        for n, c in items:
            out.setdefault(n, []).append((used[n], base, c, offset))
            used[n] += c * times
            offset += n * c
        base += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, effort: int = EFFORT) -> DataFrame:
    """The pieces with sequence_id and offset; `pieces` has the columns of token_pieces.

    Pieces that are equal in all columns are interchangeable. An empty table gives none.
    """
    own = cut(pieces)
    counts = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}  # at most `capacity` rows
    places = slots(plan(counts, capacity, effort))
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").count()
        .withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("length").alias("len"), F.col("bucket").alias("buck"), "before")
    )
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(order) - 1).join(before, (F.col("length") == F.col("len")) & (F.col("bucket") == F.col("buck")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).cast("long").alias("rank"))

    def place(batches):
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at, rows = np.flatnonzero(n == length), places[int(length)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                behind = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + behind // row[:, 2]
                offset[at] = row[:, 3] + behind % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of every row of df, with its place in a sequence.

    Null or empty text: one piece with the end token alone. Null ids and repeated rows get pieces
    of their own; other columns are ignored; an empty table gives none.
    """
    return pack(token_pieces(df, json_path, ranks_path, capacity, id_col, text_col), capacity)
