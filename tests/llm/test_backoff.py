import math
from collections import Counter

import compare
from pyspark.sql import functions as F

from inkwright.llm import backoff


def brute(rows):
    docs = [(i, (t or "").lower().encode().split()) for i, t in rows]
    of = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    grams = [sum((of(w, n) for _, w in docs), Counter()) for n in (1, 2, 3)]
    size = sum(grams[0].values())
    out = []
    for doc_id, w in docs:
        mine = [of(w, n) for n in (1, 2, 3)]
        others = lambda gram: grams[len(gram) - 1][gram] - mine[len(gram) - 1][gram]
        total = 0.0
        for i in range(len(w)):
            for skipped, n in enumerate(range(min(3, i + 1), 0, -1)):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or others(gram) >= 1:
                    context = others(gram[:-1]) if n > 1 else max(1, size - len(w))
                    total += math.log(0.4) * skipped + math.log(max(1, others(gram)) / context)
                    break
        out.append((doc_id, len(w), round(total / len(w), 4) if w else None))
    return sorted(out, key=repr)


def test_brute_force(docs, odd, none):
    for df in (odd, docs):
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        got = sorted(((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 4)) for r in backoff.score(df).collect()), key=repr)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 2e-4) for a, b in zip(got, want))
    assert backoff.score(none).count() == 0


def test_many_runs_and_ranges_in_any_order_say_the_same(docs):
    one = {r.doc_id: r.score for r in backoff.score(docs).collect()}
    shuffled = docs.orderBy(F.rand())  # another order whenever it is computed anew
    many = {r.doc_id: r.score for r in backoff.score(shuffled, run_bytes=20_000, range_keys=3_000).collect()}
    assert one.keys() == many.keys() and all(one[k] == many[k] or abs(one[k] - many[k]) < 2e-6 for k in one)


def test_twin(spark, sf_dir):
    df = backoff.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert compare.differences(df, backoff.SQL, compare.connection(sf_dir)) == []


def test_packed_numbers():
    import numpy as np

    for values in ([], [0], [1, 255, 256, 2**40], [2**63], list(range(1000))):
        x = np.array(values, np.uint64)
        assert (backoff.expand(backoff.squeeze(x)) == x).all()


def test_written_runs():
    import numpy as np

    many = [" ".join(f"w{i}" for i in range(70_000)), "", "w1 w1 w69999", "  "]
    parts = backoff.tokenised(many)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(backoff.read(*backoff.written(*parts)), parts))
    assert parts[0].tolist() == [70_000, 0, 3, 0] and parts[1][70_000] == parts[1][1] == 0
    assert [len(x) for x in backoff.read(*backoff.written(*backoff.tokenised([])))] == [0, 0, 0] and np.unique(parts[2]).size == 70_000
