import zlib

import numpy as np

from inkwright.llm import quality


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{big}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_labels_of_the_fold_do_not_matter(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_density_equals_the_formula():
    rng = np.random.default_rng(2)
    p = len(quality.STATISTICS)
    x = {c: rng.normal(c, 1 + c, (200, p)) @ rng.normal(0, 1, (p, p)) for c in (0, 1)}
    model = quality.discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    both = np.concatenate([x[0], x[1]])
    z = (both - both.mean(0)) / both.std(0)
    part = {0: z[:200], 1: z[200:]}
    cov = {c: np.cov(v.T, bias=True) for c, v in part.items()}
    want = []
    for c in (0, 1):
        s = (1 - quality.POOL) * cov[c] + quality.POOL * (cov[0] + cov[1]) / 2
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / p * np.eye(p)
        d = z - part[c].mean(0)
        want.append(np.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(both), 1 / (1 + np.exp(-np.clip((want[1] - want[0]) / quality.SOFTEN, -500, 500))))


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 0), (8, 1), (None, 1), (3, None), (5, 7), (6, 1), (6, 1)], "doc_id long, quality int")
    for given in (labels, labels.filter("false"), labels.filter("quality = 1")):
        rows = quality.classify(odd, given).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(none, labels).count() == 0


def test_whole_query_by_brute_force(spark, docs, sf_dir):
    """Every score against plain numpy over the statistics of the training rows."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = docs.select("doc_id", "text").collect()
    x = np.array([quality.statistics(r.text or "") for r in rows])
    learn = [i for i, r in enumerate(rows) if labels.get(r.doc_id) in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    y = np.array([labels[rows[i].doc_id] for i in learn])
    centre, scale = x[learn].mean(0), x[learn].std(0)
    z, p = (x - centre) / scale, len(quality.STATISTICS)
    part = {c: z[learn][y == c] for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in part.items()}
    pooled = sum(len(part[c]) * cov[c] for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        s = (1 - quality.POOL) * cov[c] + quality.POOL * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / p * np.eye(p)
        d = z - part[c].mean(0)
        density.append(np.log(len(part[c]) / len(y)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.SOFTEN, -500, 500)))
    got = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-7)
