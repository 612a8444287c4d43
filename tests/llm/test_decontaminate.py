import random

from inkwright.llm import decontaminate as D


def sellers(item, text):
    """(distance, end) of the first best place, by the plain table."""
    row, best = list(range(len(item) + 1)), None
    for j, ch in enumerate(text, 1):
        new = [0]
        for i, c in enumerate(item, 1):
            new.append(min(row[i - 1] + (c != ch), row[i] + 1, new[i - 1] + 1))
        row = new
        if best is None or row[-1] < best[0]:
            best = (row[-1], j)
    return best


def test_myers_equals_the_table():
    rng = random.Random(5)
    for _ in range(400):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        want = sellers(item, text) if text else None
        for k in (0, 2, 5):
            assert D.myers(item, text, k) == (want if want and want[0] <= k else None)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, "z"), lambda: chars.__setitem__(i, "q")])()
    return "".join(chars)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for d in range(40):
        text = " ".join(rng.choice(words) for _ in range(60))
        if d % 2:
            item = rng.choice(items)[1]
            at = rng.randrange(len(text))
            text = text[:at] + edited(rng, item, rng.randrange(0, int(len(item) * 0.05) + 3)) + text[at:]
        docs.append((d, text.upper() if d % 3 else text.replace(" ", " \n ")))
    want = set()
    for d, text in docs:
        for i, item in items:
            dist, end = sellers(D.normal(item), D.normal(text))
            if dist <= int(len(D.normal(item)) * D.RATE):
                want.add((d, i, dist, end))
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.distance, r.match_end) for r in got.collect()} == want and len(want) > 10
    small = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert sorted((r.doc_id, r.item_id, r.distance, r.match_end) for r in small.collect()) == sorted(want)  # by hash joins
    for size in (200, 1 << 20):
        kept = D.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert sorted(map(tuple, kept.collect())) == sorted(x for x in docs if all(x[0] != w[0] for w in want))


def test_both_ways_agree_on_the_tables(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, other = (sorted(map(tuple, D.find_leaks(docs, items, block_bytes=n).collect())) for n in (1 << 20, 0))
    assert one == other and one


def test_window_hashes():
    text = "abcabcé漢abc"
    by = dict(D.window_hashes(text, [1, 3, len(text), len(text) + 1]))
    assert list(by) == [1, 3, len(text)] and len(by[3]) == len(text) - 2
    assert by[3][0] == by[3][3] == by[3][8] == dict(D.window_hashes("xxabc", [3]))[3][2] and len(set(by[3].tolist())) == len({text[i : i + 3] for i in range(len(text) - 2)})


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, " "), (1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    for size in (1 << 20, 0):
        got = D.find_leaks(odd, items, block_bytes=size)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1)] * 2 + [(4, 1)] * 4
        assert D.find_leaks(none, items, block_bytes=size).count() == 0 and D.find_leaks(odd, items.filter("false"), block_bytes=size).count() == 0
        kept = D.drop_leaks(odd, items, block_bytes=size)
        assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert D.drop_leaks(odd, items.filter("false")).count() == odd.count()
