import numpy as np

from inkwright.llm import language_id as L


def test_documents_and_pages(spark, sf_dir, docs):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = L.identify(docs, pages)
    rows = out.collect()
    assert len(rows) == docs.count() + pages.count()
    by = {r.doc_id: r for r in rows if r.kind == "document"}
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    right = [by[i].lang == lang for i, (lang, text) in truth.items() if lang and text and len(text) > 100]
    assert np.mean(right) > 0.97
    assert all(0 <= r.confidence <= 1.0000001 for r in rows)


def test_likelihood_equals_the_sum():
    model = L.Model(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(L.BUCKETS), 2).T).astype(np.float32))
    text = "Some text of a few words"
    at = L.trigrams(text)
    want = sum(model.weights[i].astype(float) for i in at) / len(at) * min(len(at), L.INDEPENDENT)
    assert np.allclose(model.likelihood(text), want) and (model.likelihood("") == 0).all() and len(L.trigrams("x")) == 1


def test_priors_are_smoothed_from_whole_to_host(spark):
    """One row's posterior against the same rule written out in numpy."""
    rng = np.random.default_rng(3)
    hosts = ["h.x.de", "h.x.de", "g.x.de", "k.y.fr", None]
    rows = [(0, "", d, h, h and h.split(".", 1)[1], h and h.rsplit(".", 1)[1]) for h, d in zip(hosts * 6, ["de", None, "fr", "fr", "de"] * 6)]
    df = spark.createDataFrame(rows, "k long, text string, declared string, host string, domain string, suffix string")
    model = L.Model(["de", "fr"], np.zeros((L.BUCKETS, 2), np.float32))
    got = sorted((r.declared or "", r.host or "", round(r.confidence, 9)) for r in L.fuse(df, model).collect())
    p = np.array([0.5, 0.5])
    n = len(rows)
    want = []
    for i, r in enumerate(rows):
        others = [o for j, o in enumerate(rows) if j != i]
        prior = (np.full(2, 0.5) * len(others) + 0.5) / (n - 1 + 1.0)
        for key in (5, 4, 3):
            c = 0.5 * np.ones(2) * sum(o[key] == r[key] for o in others) if r[key] is not None else np.zeros(2)
            prior = (c + L.PRIOR_ROWS * prior) / (c.sum() + L.PRIOR_ROWS)
        score = np.log(prior)
        for key in (2, 5):
            if r[key] is not None:
                c = 0.5 * sum(o[key] == r[key] for o in others)
                kinds = len({o[key] for o in rows if o[key] is not None})
                score += np.log((c + L.EVIDENCE_ROWS / kinds) / (0.5 * (n - 1) + L.EVIDENCE_ROWS))
        e = np.exp(score - score.max())
        want.append((r[2] or "", r[3] or "", round(float((e / e.sum()).max()), 9)))
    assert got == sorted(want)
    assert rng is not None and p.sum() == 1


def test_markup(spark):
    html = "<html lang='FR'><head><script>x()</script></head><body><p>Bonjour &amp; merci</p><!-- no --></body></html>"
    df = spark.createDataFrame([(1, "HTTPS://www.Example.co.fr/de/page", html), (2, None, None), (None, "nonsense", "<b>")], "page_id long, url string, html string")
    r = {x.k: x for x in L.from_pages(df).collect()}
    assert (r[1].declared, r[1].host, r[1].domain, r[1].suffix) == ("fr", "www.example.co.fr", "co.fr", "fr/de") and "Bonjour" in r[1].text and "x()" not in r[1].text
    assert r[2].text == "" and r[2].host is None and r[None].host is None


def test_odd_rows(odd, none, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rows = L.identify(odd, pages).collect()
    assert len(rows) == odd.count()
    assert not any(r.keep for r in rows if r.doc_id in (2, 3, 5))
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 4, None, 6, 7, 8} and kept.count() >= 5
    assert L.identify(none, pages).count() == 0 and L.keep_identified(none).count() == 0
    assert L.keep_identified(none.withColumnRenamed("row", "keep")).columns == [c if c != "row" else "keep" for c in odd.columns]


def test_whole_query_by_brute_force(spark, sf_dir, docs):
    """Every posterior, from the counted trigrams to the smoothed host, in plain Python over all rows."""
    from collections import Counter, defaultdict

    documents = [(r.doc_id, r.text or "", (r.lang or "").strip().lower() or None, (r.source or "").strip().lower() or None) for r in docs.collect()]
    tally = defaultdict(Counter)
    for _, text, lang, _ in documents:
        if text and lang:
            tally[lang].update(L.trigrams(text).tolist())
    names = sorted(tally)
    logs = {n: {k: np.float32(np.log((v + 0.5) / (sum(tally[n].values()) + 0.5 * L.BUCKETS))) for k, v in tally[n].items()} for n in names}
    none = {n: np.float32(np.log(0.5 / (sum(tally[n].values()) + 0.5 * L.BUCKETS))) for n in names}

    pages = L.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    rows = [("document", i, t, d, h, None, None) for i, t, d, h in documents] + [("page", r.k, r.text, r.declared, r.host, r.domain, r.suffix) for r in pages]
    like = []
    for row in rows:
        at = L.trigrams(row[2]).tolist() if row[2] else []
        like.append(np.array([sum(float(logs[n].get(k, none[n])) for k in at) / len(at) * min(len(at), L.INDEPENDENT) if at else 0.0 for n in names]))
    soft = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in like]
    whole = sum(soft)
    sums = [defaultdict(lambda: np.zeros(len(names))) for _ in range(7)]
    for row, p in zip(rows, soft):
        for key in (3, 4, 5, 6):
            if row[key] is not None:
                sums[key][row[key]] = sums[key][row[key]] + p
    got = {(r.kind, r.doc_id if r.kind == "document" else r.page_id): r for r in L.identify(docs, spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for row, ll, p in zip(rows, like, soft):
        less = {key: np.maximum(sums[key][row[key]] - p, 0) if row[key] is not None else np.zeros(len(names)) for key in (3, 4, 5, 6)}
        prior = np.maximum((whole - p + 1 / len(names)) / whole.sum(), 1e-9)
        for key in (6, 5, 4):
            prior = (less[key] + L.PRIOR_ROWS * prior) / (less[key].sum() + L.PRIOR_ROWS)
        score = ll + np.log(prior)
        for key in (3, 6):
            if row[key] is not None:
                score = score + np.log((less[key] + L.EVIDENCE_ROWS / len(sums[key])) / (np.maximum(whole - p, 0) + L.EVIDENCE_ROWS))
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        r = got[row[0], row[1]]
        assert abs(r.confidence - post.max()) < 1e-4 and post[names.index(r.lang)] >= post.max() - 1e-4
        assert r.keep == (any(ch.isalpha() for ch in row[2]) and r.confidence >= L.LEAST)
