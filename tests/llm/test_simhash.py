import random

import numpy as np
import xxhash

from inkwright.llm import simhash


def naive(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps):
    """Smallest place that each fingerprint reaches over links of four bits or fewer."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(docs, odd):
    for text in [r.text for r in docs.collect()][:80] + [r.text for r in odd.collect()] + ["ÀB cd", "one two three", "a\x0bb\x1cc d e f"]:
        assert simhash.fingerprint(text or "", xxhash.xxh64_intdigest) & (2**64 - 1) == naive(text or "")


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains of near ones, at up to five bits
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    want = classes(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for n in (len(fps), 3_000_000):  # few blocks and many
        found = simhash.connected(simhash.links(df, n)).collect()
        root = {r.node: r.root for r in found}
        groups = {}
        for f, w in zip(signed, want):
            groups.setdefault(w, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_hot_key_in_passes(monkeypatch):
    """A key with far more variants than go into one pass gives the links all the same."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(300)})
    own = np.array(fps, np.uint64)
    masks = {0: np.concatenate(list(simhash.variant_masks(4).values()))}
    monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    a, b = simhash.collide(own, np.zeros(len(own), np.int64), masks)
    at = {f: i for i, f in enumerate(fps)}
    root = simhash.components(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]), len(fps))
    want = classes(fps)
    assert [want[int(r)] for r in root] == want


def test_near_duplicates(docs, odd, none):
    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        fps = [naive(r.text or "") for r in rows]
        want = sorted(repr((r.doc_id, f"{f:016x}", rows[c].doc_id)) for r, f, c in zip(rows, fps, classes(fps)))
        assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(docs, odd, none):
    for df in (docs, odd):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        want = sorted({c: rows[c].doc_id for c in classes([naive(r.text or "") for r in rows])}.values(), key=repr)
        out = simhash.keep_one(df)
        assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=repr) == want
    assert simhash.keep_one(none).count() == 0
