import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkwright.llm import packing
from inkwright.llm.registry import tokenizer_path

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


def check_plan(counts, patterns, capacity):
    used = Counter()
    for times, items in patterns:
        assert sum(n * c for n, c in items) <= capacity
        for n, c in items:
            used[n] += c * times
    assert +used == +Counter(counts)
    return sum(t for t, _ in patterns)


def optimum(sizes, capacity):
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in {b for b in bins if b + sizes[i] <= capacity}:
            k = bins.index(room)
            put(i + 1, bins[:k] + [room + sizes[i]] + bins[k + 1 :])
        put(i + 1, bins + [sizes[i]])

    put(0, [])
    return best


def test_plans_are_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 20, 30])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))), reverse=True)
        n = check_plan(Counter(sizes), packing.plan(Counter(sizes), capacity), capacity)
        assert bound_of(sizes, capacity) <= n == optimum(sizes, capacity), (capacity, sizes)


def bound_of(sizes, capacity):
    vector = np.bincount(sizes, minlength=capacity + 1)
    return packing.Bounds(capacity)(vector)


def fits(counts, capacity, bins):
    """Whether the pieces fit in so many sequences: every way to fill the one of the largest piece, with states remembered."""
    failed = set()

    def ways(room, names, left):
        if not names:
            yield ()
            return
        n, rest = names[0], names[1:]
        for c in range(min(left[n], room // n), -1, -1):
            for way in ways(room - n * c, rest, left):
                yield ((n, c), *way)

    def try_(left, bins):
        left = +left
        if not left:
            return True
        key = (bins, tuple(sorted(left.items())))
        if key in failed or sum(n * c for n, c in left.items()) > bins * capacity:
            return False
        top = max(left)
        left[top] -= 1
        for way in ways(capacity - top, [n for n in sorted(left, reverse=True) if n <= capacity - top and left[n]], left):
            if try_(left - Counter(dict(way)), bins - 1):
                return True
        failed.add(key)
        return False

    return try_(Counter(counts), bins)


def test_plans_of_up_to_forty_pieces_are_optimal():
    rng = random.Random(4)
    beyond = 0
    for _ in range(80):
        capacity = rng.choice([12, 15, 20])
        counts = Counter(rng.randint(3, capacity * 3 // 5) for _ in range(rng.randint(20, 40)))
        n = check_plan(counts, packing.plan(counts, capacity), capacity)
        if n > bound_of(list(counts.elements()), capacity):
            beyond += 1
            assert not fits(counts, capacity, n - 1), (capacity, counts)
    assert beyond


@pytest.mark.parametrize("seed, most", [(0, 106), (5, 109), (11, 106)])
def test_plans_of_three_hundred_pieces_beat_best_fit(seed, most):
    random.seed(seed)
    counts = Counter(random.randint(200, 520) for _ in range(300))
    assert check_plan(counts, packing.plan(counts), 1024) <= most < sum(t for t, _ in packing.best_fit(counts, 1024))


def test_plan_of_many(rng=random.Random(2)):
    counts = Counter(min(1024, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(20_000))
    assert check_plan(counts, packing.plan(counts), 1024) == bound_of(list(counts.elements()), 1024)
    assert packing.plan({}) == []


def test_bounds_hold():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        assert bound_of(sizes, 20) <= optimum(sorted(sizes, reverse=True), 20)


def test_domination():
    assert packing.swallows([5], [3, 2]) and not packing.swallows([3, 2], [5]) and packing.swallows([], [])
    for parts in itertools.product(range(1, 4), repeat=3):
        assert packing.swallows([sum(parts)], sorted(parts, reverse=True))


def test_every_undominated_filling_comes():
    left = Counter({2: 3, 3: 2, 5: 1, 7: 1})
    got = [f for _, f in packing.fillings(9, left, 9, packing.Effort(1000))]
    every = [sorted(c, reverse=True) for r in range(5) for c in set(itertools.combinations(sorted(left.elements()), r)) if sum(c) <= 9]
    assert all(any(packing.swallows(k, f) for k in got) for f in every) and len(got) < len(every)


def test_dearest():
    assert packing.dearest(10, {6: 1, 5: 2, 4: 1}, np.arange(11) / 10) == (1.0, [6, 4]) or packing.dearest(10, {6: 1, 5: 2, 4: 1}, np.arange(11) / 10)[0] == 1.0
    worth = np.zeros(11)
    worth[[3, 4]] = 0.5, 0.1
    assert packing.dearest(10, {4: 2, 3: 2}, worth) == (1.1, [4, 3, 3])


def check_rows(df, rows):
    tok = Tokenizer.from_file(JSON)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    texts_of = defaultdict(list)
    for x in df.select("doc_id", "text").collect():
        texts_of[x.doc_id].append(x.text)
    assert pieces.keys() == texts_of.keys()
    for doc_id, own in pieces.items():
        texts = texts_of[doc_id]
        want = []
        for text in texts:
            ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


@pytest.mark.parametrize("bucket", [packing.BUCKET, 7])
def test_documents(docs, odd, none, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    for df in (odd, docs):
        rows = packing.pack_documents(df, JSON, RANKS).collect()
        n = check_rows(df, rows)
        assert bound_of([r.length for r in rows], 1024) <= n <= bound_of([r.length for r in rows], 1024) + 1
    assert packing.pack_documents(none, JSON, RANKS).count() == 0


def test_special_strings():
    encode, exact = packing.coder(JSON, RANKS), Tokenizer.from_file(JSON)
    for text in ("a <|endoftext|> b", "plain", "", "  \n\n x", "é漢 " * 50):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
