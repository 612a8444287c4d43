import re

import corpus_pipeline as P
import xxhash

from inkwright.llm import decontaminate, language_id, simhash
from inkwright.llm._arrow import cut

from test_decontaminate import sellers
from test_line_dedup import brute as dedup
from test_packing import check_rows
from test_simhash import classes


def test_stages_against_brute_force(spark, sf_dir, docs):
    kept = cut(P.identified(spark, docs, sf_dir))
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    first = {r.doc_id for r in kept.collect()}
    assert first <= rows.keys() and all(re.search(r"[^\W\d_]", rows[i].text or "") for i in first)
    assert len(first) >= 0.95 * sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in rows.values())
    model = language_id.train(docs)
    assert set(model.languages) == {r.lang for r in rows.values() if r.lang}

    lines = cut(P.without_repeated_lines(spark, kept, sf_dir))
    assert lines.columns == docs.columns
    want = dedup([(i, rows[i].text) for i in first])
    second = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in second.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == (len(r.text) if want[i][1] else rows[i].n_chars) for i, r in second.items())

    single = cut(P.without_near_copies(spark, lines, sf_dir))
    ids = sorted(second)
    root = classes([simhash.fingerprint(second[i].text, xxhash.xxh64_intdigest) & (2**64 - 1) for i in ids])
    third = {ids[c] for c in root}
    assert {r.doc_id for r in single.collect()} == third and single.columns == docs.columns

    clean = cut(P.without_benchmark(spark, single, sf_dir))
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if decontaminate.normal(r.text or "")]
    fourth = {i for i in third if not any((near := sellers(x, decontaminate.normal(second[i].text))) and near[0] <= int(len(x) * decontaminate.RATE) for x in items if near_enough(x, decontaminate.normal(second[i].text)))}
    assert {r.doc_id for r in clean.collect()} == fourth and clean.columns == docs.columns

    packed = P.packed(spark, clean, sf_dir)
    assert {r.doc_id for r in packed.collect()} == fourth
    check_rows(clean, packed.collect())


def near_enough(item, text):
    """Whether any piece of the item, as the pigeonhole cuts it, is in the text: cheap, and never false where an item is near."""
    return any(p in text for _, p in decontaminate.pieces(item)[1])


def test_run_is_its_stages(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_odd_and_empty_rows(spark, sf_dir, odd, none):
    """Nulls, repeated rows, very long texts and clashing names go through all stages, as does an empty table."""
    docs = odd
    kept = []
    for _, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        kept.append(docs.count())
    ids = sorted((r.doc_id for r in docs.collect()), key=repr)
    assert kept[0] == odd.count() - 3 == kept[1] and ids == sorted([1, 4, 6, 7, 8, None], key=repr)  # of 4 the lines that 1 has are gone, and one of its two rows
    rows = P.packed(spark, docs, sf_dir).collect()
    check_rows(docs, rows)
    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
    bare = odd.select("doc_id", "text", "lang", "source")
    assert P.without_repeated_lines(spark, bare, sf_dir).columns == bare.columns
