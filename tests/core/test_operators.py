"""Cases of each operator on small literal tables."""

import pytest
from pyspark.sql import functions as F

from inkwright.operators import bags, boxes, checks, convert, forms, maths, notes, quality, ranks, readings, render, running, scoring, structure, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# ---- ranks and neighbours ------------------------------------------------------------------------


def test_numbers_over_ranges(spark):
    rows = [("hot", i * i % 10_007) for i in range(900)] + [("cold", 5), ("cold", 9_000), (None, 3)]
    df = frame(spark, rows, "k string, v long")
    one, many = (got(ranks.numbered(df, "k", "v", "n", rows=r), "k", "v", "n") for r in (65_536, 50))
    assert one == many and max(n for _, _, n in one) == 900
    assert ranks.numbered(df.filter("false"), "k", "v", "n").count() == 0


def lines_of(spark, pages):
    rows = [("f", p, p, i, len(ls), ls[i]) for p, ls in pages.items() for i in range(len(ls))]
    from inkwright.sources import adapters

    return adapters.banded(frame(spark, rows, "file string, page long, doc_id long, line_no long, n_lines long, line string"))


def test_running_lines(spark):
    banded = lines_of(spark, {1: ["Title 1", "body one", "Page 1 of 3"], 2: ["Other", "body two", "Page 2 of 3"], 5: ["Title 9", "x", "Imprint"]})
    out = {(r.page, r.line_no): (r.kept_in, r.checked) for r in running.decided(banded).collect()}
    assert out[1, 2] == ("running", True) and out[1, 0] == ("imprint", True) and out[5, 2] == ("imprint", True)
    single = {r.kept_in for r in running.decided(lines_of(spark, {1: ["Only", "one"]})).collect()}
    assert single == {None}  # nobody to ask


@pytest.mark.parametrize("a, b, want", [("abc", "abc", [(0, 0), (1, 1), (2, 2)]), ("abc", "xabc", [(0, 1), (1, 2), (2, 3)]), ("abcd", "bcda", [(1, 0), (2, 1), (3, 2)]), ("", "a", []), ("aab", "ab", [(0, 0), (2, 1)])])
def test_alignment(a, b, want):
    like = {c: {c: 1.0} for c in set(a) | set(b)}
    pairs = running.align(list(a), list(b), like)
    assert sum(s for *_, s in pairs) == len(want) and (len(set(a)) != len(a) or [p[:2] for p in pairs] == want)
    assert pairs == sorted(pairs)


def test_alignment_is_optimal():
    import random

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        like = {x: {y: rng.choice([0.5, 0.7, 0.9]) for y in range(6) if rng.random() < 0.3} | {x: 1.0} for x in range(6)}
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + like[a[i]].get(b[j], -9))
        pairs = running.align(a, b, like)
        assert abs(sum(s for *_, s in pairs) - best[-1][-1]) < 1e-9
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_versions(spark):
    old = {1: "alpha beta gamma delta", 2: "one two three four five", 3: "gone for good now truly"}
    new = {1: "alpha beta gamma delta", 2: "brand new page of words", 3: "one two three four six"}
    pages = lambda p: running.classes(frame(spark, [("f", k, v) for k, v in p.items()], "file string, page long, text string"))
    out = got(running.matched(pages(old), pages(new)), "old_page", "new_page")
    assert out == sorted([(1, 1), (2, 3), (3, None), (None, 2)], key=repr)
    prints = lambda p, foot: frame(spark, [("f", k, v, [foot]) for k, v in p.items()], "file string, page long, body string, running array<string>")
    kinds = {(r.old_page, r.new_page): r.kind for r in running.classed(running.matched(pages(old), pages(new)), prints(old, "issued 3 May 2019"), prints(new, "issued 9 June 2020")).collect()}
    assert kinds == {(1, 1): "restamped", (2, 3): "changed", (3, None): "dropped", (None, 2): "new"}


# ---- quality and readings ------------------------------------------------------------------------


def test_kinds_of_pages(spark):
    good = "plain words of a page that anyone can read without trouble " * 3
    bad = " ".join("x%$q9z)(w" for _ in range(40))
    df = frame(spark, [(1, good, 0.0, 0.0), (2, "few", 0.0, 0.0), (3, bad, 0.0, 0.0), (4, good, 0.0, 0.7), (5, good[:150], 0.9, 0.0), (6, None, 0.0, 0.0), (7, good + "\ufffd" * 80, 0.0, 0.0)], "page int, text string, cov double, inv double")
    assert got(quality.assessed(df, "cov", "inv"), "page", "kind") == [(1, "digital"), (2, "none"), (3, "suspect"), (4, "ocr"), (5, "suspect"), (6, "none"), (7, "suspect")]


def test_ocr_gate(spark):
    rows = [(1, 0.9, 0.8, 0.0, 0.0, 5), (2, 0.7, 0.9, 0.0, 0.0, 5), (3, 0.85, 0.2, 0.4, 0.0, 5), (4, 0.76, 0.2, 0.6, 0.0, 25), (5, 0.76, 0.2, 0.6, 0.0, 3), (6, 0.81, 0.1, 0.0, 0.7, 1)]
    df = frame(spark, rows, "page int, conf double, wordlike_share double, numeric_share double, language_share double, n_lines int")
    assert got(quality.ocr_gate(df).filter("accepted"), "page") == [(1,), (3,), (4,), (6,)]


def test_fates_and_turns(spark):
    c = F.col
    df = frame(spark, [("suspect", "digital", 3, 0, None, None), ("suspect", "suspect", 3, 0, None, None), ("none", "none", 0, 0, None, 0), ("none", "none", 0, 0, 30, 0), ("none", "none", 0, 1, None, 0), ("none", "none", 0, 0, None, None)], "k string, s string, n int, i int, u int, v int")
    assert [r.f for r in df.select(quality.fate(c("k"), c("s"), c("n"), c("i"), c("u"), c("v")).alias("f")).collect()] == ["read", "lost", "blank", "lost", "lost", "lost"]
    turns = frame(spark, [(50, 0, 60), (0, 50, 60), (30, 0, 30), (50, 0, 900)], "d int, u int, t int")
    assert [r.t for r in turns.select(quality.sideways_turn(c("d"), c("u"), c("t")).alias("t")).collect()] == [270, 90, 0, 0]


def test_completion(spark):
    issues = frame(spark, [("a", "x", "note", "m1"), ("a", "y", "incomplete", "m2"), ("b", "z", "note", "m3"), ("c", "w", "degraded", "m4")], "file string, code string, severity string, message string")
    assert got(quality.completion(issues, "file"), "file", "completion") == [("a", "incomplete"), ("b", "complete"), ("c", "degraded")]
    warnings = frame(spark, [("a", "m1"), ("a", "bare")], "file string, message string")
    assert got(quality.all_issues(issues.filter("file = 'a'"), warnings, "file"), "code", "message") == [("warning", "bare"), ("x", "m1"), ("y", "m2")]


def test_sizes(spark):
    chars = frame(spark, [(1, "C", "F", 10.0, 100.0)] * 6 + [(1, "x", "CMEX10", 10.0, 50.0)] + [(1, "s", "F", 6.0, 96.0)] * 3, "line int, ch string, font string, size double, origin_y double")
    assert got(quality.main_size(chars, "line"), "size") == [(10.0,)] and got(quality.baselines(chars, "line"), "baseline") == [(100.0,)]


def test_corroboration(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, words), (2, words, "too few"), (3, " ".join(f"other{i}" for i in range(60)), words), (4, "слово " * 50, words), (5, None, words)]
    out = readings.corroborated(frame(spark, rows, "page int, m string, w string"), ["page"], "m", "w")
    assert got(out, "page", "state") == [(1, "corroborated"), (2, "unchecked"), (3, "low support"), (4, "unverified"), (5, "unchecked")]


def test_running_heads_of_readings(spark):
    rows = [(1, "ANNUAL REPORT\nbody text\n12", ["Annual Report 2020"], ["12"]), (2, "An ordinary line\nbody", ["An ordinary line"], []), (3, "ANNUAL REPORT", ["ANNUAL REPORT"], ["x"]), (4, "HEAD LINE\nbody", [], ["HEAD LINE"])]
    out = {r.page: (r.text, r.dropped) for r in readings.without_running_heads(frame(spark, rows, "page int, text string, top array<string>, bottom array<string>")).collect()}
    assert out[1] == ("body text", ["ANNUAL REPORT", "12"]) and out[2][1] == [] and out[3] == ("", ["ANNUAL REPORT"]) and out[4][1] == []
    alike = frame(spark, [("CHAPTER TVVO", ["chapter two"])], "l string, w array<string>").select(readings.witnessed_alike("l", "w").alias("v"))
    assert alike.first().v is True


def test_splicing():
    a, b = "one line of four words\nthe second line here too\nthe third line is shared", "the third line is shared\nand a fourth one follows"
    assert readings.splice(a, b).splitlines() == [*a.splitlines(), "and a fourth one follows"]
    assert readings.splice("a", "") == "a" and readings.splice("", "b") == "b" and readings.splice("x", "y") == "x\n\ny"


def test_layout_and_responses(spark):
    raw = ['[{"category": "header", "text": "H"}, {"category": "text", "text": "kept \\u00e9"}]', '[{"category": "text", "text": "whole"}, {"category": "text", "te', "plain *markdown*", '[{"category": "figure"}]']
    df = frame(spark, [(r,) for r in raw], "raw string")
    assert [r.t for r in df.select(readings.layout_text(F.col("raw")).alias("t")).collect()] == ["kept é", "whole", "plain *markdown*", ""]
    assert [r.t for r in df.select(readings.cut_off(F.col("raw")).alias("t")).collect()] == [False, True, False, False]
    reply = frame(spark, [("---\nlang: en\nturn: 0\n---\n\nThe text",), ("```yaml\nlang: fr\n```\nAutre",), ("just text",)], "t string").select(readings.response(F.col("t")).alias("r")).collect()
    assert [(x.r.meta, x.r.text) for x in reply] == [({"lang": "en", "turn": "0"}, "The text"), ({"lang": "fr"}, "Autre"), ({}, "just text")]
    pics = frame(spark, [("![a chart](x.png)\nthree real words here",), ("![only](y)",)], "t string").select(readings.picture_answer(F.col("t")).alias("p")).collect()
    assert [(x.p.text, x.p.description) for x in pics] == [("three real words here", "a chart"), (None, "only")]
    said = frame(spark, [("Decorative line", "icon"), ("This icon means: warning sign.", "icon"), ("too few", "picture-text"), ("A figure of things. " * 40, "figure")], "t string, k string").select(readings.clean_answer(F.col("t"), F.col("k")).alias("a")).collect()
    assert said[0].a is None and said[1].a == "warning sign" and said[2].a is None and len(said[3].a) <= 400


def test_routing(spark):
    long = "word " * 120
    rows = [(1, "digital", True, None, False, "d", "o", "own"), (2, "ocr", True, 0.3, False, "deep text", "ord", "own"), (3, "ocr", True, 0.3, False, None, "ord", "own"), (4, "ocr", True, 0.9, False, "d", "ord", long), (5, "ocr", True, 0.9, False, "d", "x" * 500, "own")]
    df = frame(spark, [(*r, 20.0, 100.0) for r in rows], "page int, kind string, has_text boolean, wordlike_share double, ocr_empty boolean, deep string, ordinary string, own string, width double, height double")
    assert got(readings.routed(df), "page", "reader", "issue") == [(1, "own", None), (2, "deep", None), (3, "ordinary", "reader-fallback"), (4, "own", "reader-fallback"), (5, "own", "reading-implausible")]


# ---- bags -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("printed, written, want", [
    ("the afer effect", "the after effect", {"repaired": 1}), ("Step 1 Understanding", "Step1Understanding", {"glued": 3 - 2}), ("1understanding it", "1 understanding it", {"split": 1}),
    ("one two three", "one three", {"missing": 1}), ("one", "one two", {"added": 1}), ("bu ildin gs ab cd efghij", "buildings abcd efghij", {"glued": 2}), ("4artificial turf", "artificial turf", {"missing": 1, "added": 1}), ("same words", "same words", {}),
])
def test_word_check(spark, printed, written, want):
    r = bags.word_check(frame(spark, [(1, printed, written, "")], "page int, printed string, written string, accounted string"), ["page"]).first()
    assert {k: r[k] for k in ("missing", "added", "repaired", "split", "glued", "respaced") if r[k]} == want


def test_accounted_and_nulls(spark):
    rows = [(1, "a running head\nbody", "body", "a running head"), (2, None, None, None)]
    out = bags.word_check(frame(spark, rows, "page int, printed string, written string, accounted string"), ["page"])
    assert got(out, "page", "missing", "added") == [(1, 0, 0), (2, 0, 0)]


def test_critical(spark):
    df = frame(spark, [(1, "not covered up to $500", "covered up to $600"), (2, "the same", "the same")], "p int, a string, b string")
    assert got(bags.critical_difference(df, ["p"], "a", "b"), "word", "n") == [("$500", 1), ("$600", 1), ("not", 1)]


# ---- checks and scores ----------------------------------------------------------------------------

MD = "# A heading\n\n**bold words** and *slanted ones*[^1] then 5² more.\n\n| Item | Price |\n| --- | --- |\n| Apple | 3 |\n| Pear | 4 |\n\n<table><tr><th>Covers</th><th>Other</th></tr><tr><td><ul><li>fire damage</li><li>flood</li></ul></td><td>x</td></tr></table>\n\n\\(a + b\\)"
CASES = [
    ("present", True, {"text": "bold words and"}), ("present", False, {"text": "BOLD WORDS"}), ("present", True, {"text": "BOLD WORDS", "case_sensitive": False}), ("present", True, {"text": "bald words and", "max_diffs": 3}), ("present", False, {"text": "Pear", "first_n": 20}),
    ("present", True, {"text": "a + b", "last_n": 12}), ("absent", True, {"text": "zebra"}), ("absent", False, {"text": "Apple"}), ("order", True, {"before": "Apple", "after": "Pear"}), ("order", False, {"before": "Pear", "after": "Apple"}), ("order", True, {"before": "Aple", "after": "Peer", "max_diffs": 2}),
    ("format", True, {"text": "A heading", "format": "heading"}), ("format", True, {"text": "bold words", "format": "bold"}), ("format", False, {"text": "slanted", "format": "bold"}), ("format", True, {"text": "slanted ones", "format": "italic"}),
    ("table", True, {"cell": "Apple", "right": "3", "down": "Pear", "top_heading": "Item"}), ("table", False, {"cell": "Apple", "right": "4"}), ("table", True, {"cell": "4", "left": "Pear", "up": "3", "left_heading": "Pear"}), ("table", False, {"cell": "Apple", "ignore_markdown_tables": True}),
    ("baseline", True, {}), ("baseline", False, {"max_length": 10}), ("footnote", True, {"marker": "1", "appears_before_marker": "slanted ones"}), ("footnote", True, {"marker": "2", "appears_after_marker": "more"}), ("footnote", False, {"marker": "7"}),
    ("list_item", True, {"item": "fire damage", "top_heading": "Covers"}), ("list_item", False, {"item": "fire damage", "top_heading": "Other"}), ("math", True, {"math": "a+b"}), ("math", False, {"math": "a-b"}),
]


def test_every_check(spark):
    import pyspark.sql.types as K

    schema = K._parse_datatype_string(checks.SCHEMA)
    rows = [tuple(({"pdf": "d.pdf", "page": 1, "id": f"c{i}", "type": t} | given).get(f.name) for f in schema) for i, (t, _, given) in enumerate(CASES)]
    rows += [tuple({"pdf": "none.pdf", "page": 1, "id": "lost", "type": "present", "text": "x"}.get(f.name) for f in schema), tuple({"pdf": "d.pdf", "page": 1, "id": "bad", "type": "order", "before": "x", "after": ""}.get(f.name) for f in schema)]
    out = {r.id: r.passed for r in checks.run(frame(spark, rows, schema), frame(spark, [("d.pdf", 1, 1, MD)], "pdf string, page int, repeat int, md string")).collect()}
    assert [i for i, (_, want, _) in enumerate(CASES) if out[f"c{i}"] != want] == [] and out["lost"] is False and out["bad"] is False
    assert {r.id for r in checks.malformed(frame(spark, rows, schema)).collect()} == {"bad"}


def test_repeats_and_baselines(spark):
    assert checks.ending_repeats("abc" + "xy" * 40)[1] == 40 and checks.ending_repeats("") == [0] * 5
    results = frame(spark, [("a", "f", "present", True), ("a", "f", "present", False), ("b", "f", "present", True), ("b", "f", "present", True), ("b", "f", "present", False)], "id string, pdf string, type string, passed boolean")
    assert got(checks.majority(results), "id", "passed") == [("a", False), ("b", True)]
    some = frame(spark, [("f", 1, "f_b", "baseline")], "pdf string, page int, id string, type string")
    assert got(checks.with_baselines(some, frame(spark, [("f",), ("g",)], "pdf string")), "id") == [("f_b",), ("g_baseline",)]


def test_scores(spark):
    df = frame(spark, [("a", True)] * 3 + [("a", False)] + [("b", True), ("b", False)], "cat string, passed boolean")
    assert got(scoring.macro(df, "cat"), "categories", "score") == [(2, 0.625)]
    r = scoring.bootstrap(df, "cat").first()
    assert r.low <= r.score == 0.625 <= r.high and scoring.bootstrap(df, "cat").first() == r
    said = frame(spark, [("x : Average Score: 86.8% ± 0.9%\n  tables.jsonl : 89.5% (9/10 tests)",)], "t string").select(scoring.parse_report(F.col("t")).alias("r")).first().r
    assert said.overall == 86.8 and [(p.name, p.passed, p.total) for p in said.parts] == [("tables.jsonl", 9, 10)]


# ---- boxes ----------------------------------------------------------------------------------------

BOX = "page int, id long, x0 double, y0 double, x1 double, y1 double"


def test_marks(spark):
    marks = frame(spark, [(1, 1, 5.0, 5.0, 7.0, 7.0), (1, 2, 50.0, 50.0, 58.0, 58.0), (1, 3, 200.0, 200.0, 210.0, 210.0)], BOX).withColumnRenamed("id", "mark")
    cells = frame(spark, [(1, 10, 0.0, 0.0, 20.0, 20.0)], BOX)
    lines = frame(spark, [(1, 20, 62.0, 49.0, 120.0, 59.0), (1, 21, 90.0, 49.0, 120.0, 59.0)], BOX)
    figures = frame(spark, [(1, 30, 190.0, 190.0, 220.0, 220.0)], BOX)
    assert got(boxes.attached(marks, cells, lines, figures, ["page"], 30.0), "mark", "cell", "line", "figure") == [(1, 10, None, None), (2, None, 20, None), (3, None, None, 30)]


def test_visibility(spark):
    base = dict(size=10.0, color="000", invisible=False, paint_order=5, page_x0=0.0, page_y0=0.0, page_x1=100.0, page_y1=100.0)
    rows = [(1, 1, 10.0, 10.0, 15.0, 20.0), (1, 2, 200.0, 10.0, 205.0, 20.0), (1, 3, 50.0, 50.0, 55.0, 60.0), (1, 4, 70.0, 70.0, 75.0, 80.0), (1, 5, 10.0, 40.0, 15.0, 50.0)]
    chars = frame(spark, rows, BOX).withColumnRenamed("id", "char")
    for k, v in base.items():
        chars = chars.withColumn(k, F.lit(v))
    chars = chars.withColumn("size", F.when(F.col("char") == 5, 0.5).otherwise(F.col("size")))
    fills = frame(spark, [(1, 1, 45.0, 45.0, 60.0, 65.0, "fff", 9), (1, 2, 65.0, 65.0, 80.0, 85.0, "000", 2)], BOX + ", fill string, paint_order int")
    assert got(boxes.visibility(chars, fills, ["page"]), "char", "hidden") == [(1, ""), (2, "off-page"), (3, "covered"), (4, "same-colour"), (5, "tiny")]
    runs = boxes.hidden_runs(frame(spark, [(1, i, c, h) for i, (c, h) in enumerate([("a", ""), ("b", "tiny"), ("c", "tiny"), ("d", "covered")])], "line int, at int, ch string, hidden string"), ["line"])
    assert got(runs, "reason", "text") == [("covered", "d"), ("tiny", "bc")]


def test_words_from_characters(spark):
    x, rows = 0.0, []
    for i, ch in enumerate("two words"):
        rows.append((1, i, ch, 10.0, x, 0.0, x + 5.0, 10.0))
        x += 5.0
    for i, ch in enumerate("gap"):
        rows.append((1, 20 + i, ch, 10.0, x + 4.0, 0.0, x + 9.0, 10.0))
        x += 5.0
    out = boxes.words(frame(spark, rows, "line int, at int, ch string, size double, x0 double, y0 double, x1 double, y1 double"), ["line"])
    assert [r.text for r in out.orderBy("word").collect()] == ["two", "words", "gap"]


def test_regions(spark):
    rows = [(1, "table", 0.0, 0.0, 100.0, 100.0, 0.59), (1, "table", 60.0, 0.0, 100.0, 100.0, 0.77), (1, "text", 0.0, 200.0, 50.0, 220.0, 0.4), (1, "figure", 5.0, 5.0, 95.0, 95.0, 0.9)]
    df = frame(spark, rows, "page int, kind string, x0 double, y0 double, x1 double, y1 double, score double")
    assert got(boxes.clean_regions(df, ["page"]), "kind", "x0", "score") == [("figure", 5.0, 0.9), ("table", 0.0, 0.77)]


def test_mark_features(spark):
    mask = [bool(y == x) for y in range(8) for x in range(8)]
    r = frame(spark, [(mask,)], "m array<boolean>").select(boxes.mark_features(F.col("m"), 8, 8).alias("f")).first().f
    assert r.whole == 8 / 64 and r.upper_left == 4 / 16 and r.upper_right == 0 and r.falling > r.rising


# ---- structure ------------------------------------------------------------------------------------


def block(i, kind, x0, y0, x1, y1, text="some words of running text here", n=1):
    return (1, i, kind, text, n, x0, y0, x1, y1)


BLOCKS = "page int, block long, kind string, text string, n_lines int, x0 double, y0 double, x1 double, y1 double"


def test_two_columns(spark):
    rows = [block(9, "header", 50.0, 5.0, 550.0, 15.0), block(0, "text", 50.0, 40.0, 550.0, 60.0), block(1, "text", 50.0, 80.0, 280.0, 200.0), block(2, "text", 50.0, 210.0, 280.0, 300.0), block(3, "text", 320.0, 80.0, 550.0, 200.0), block(4, "text", 320.0, 210.0, 550.0, 300.0)]
    out = structure.reading_order(frame(spark, rows, BLOCKS), ["page"]).orderBy("order")
    assert [r.block for r in out.collect()] == [0, 1, 2, 3, 4, 9]


def test_wide_figure_and_island():
    b = lambda i, k, x0, y0, x1, y1: dict(block=i, kind=k, x0=x0, y0=y0, x1=x1, y1=y1, text="w", n_lines=1)
    out = structure.xy_cut([b(0, "text", 0, 0, 90, 50), b(1, "text", 110, 0, 200, 50), b(2, "figure", 0, 60, 200, 100), b(3, "text", 0, 110, 90, 150), b(4, "text", 110, 110, 200, 150)], 6.0)
    assert [x["block"] for x in out] == [0, 2, 3, 1, 4]
    out = structure.xy_cut([b(0, "text", 0, 0, 95, 80), b(3, "text", 0, 82, 95, 200), b(1, "text", 105, 0, 200, 200), b(2, "text", 80, 90, 120, 110)], 6.0)
    assert [x["block"] for x in out] == [0, 3, 2, 1]


def test_side_labels():
    b = lambda i, x0, y0, x1, text: dict(block=i, kind="text", x0=x0, y0=y0, x1=x1, y1=y0 + 10, text=text, n_lines=1)
    body = "a sentence of running text that goes on"
    order = [b(0, 100, 10, 500, body), b(1, 20, 11, 70, "Covered"), b(2, 100, 60, 500, body), b(3, 20, 61, 70, "Excluded")]
    assert [x["block"] for x in structure.seated(order, 600, 10)] == [1, 0, 3, 2]


def test_block_building():
    line = lambda x0, y0, x1, text, size=10.0, bold=False: dict(x0=x0, y0=y0, x1=x1, y1=y0 + size, text=text, size=size, bold=bold)
    lines = [line(0, 0, 200, "A paragraph that begins"), line(0, 12, 190, "and carries on"), line(0, 60, 200, "Another one"), line(0, 72, 100, "• an item"), line(300, 0, 400, "next column"), line(0, 90, 200, "1.2 Heading Here"), line(0, 102, 200, "text under it")]
    assert sorted(map(sorted, structure.build(lines))) == [[0, 1], [2], [3], [4], [5], [6]]


def test_kinds(spark):
    rows = [("12", 1, 10.0, False, 10.0, 20.0, None), ("www.example.org", 1, 10.0, False, 100.0, 110.0, None), ("A short head", 1, 10.0, False, 20.0, 30.0, None), ("A short head", 1, 10.0, False, 20.0, 30.0, False), ("Figure 3: a thing", 1, 10.0, False, 300.0, 310.0, None), ("• entry", 1, 10.0, False, 300.0, 310.0, None),
            ("Big Title", 1, 14.0, False, 300.0, 314.0, None), ("Bold one", 1, 10.0, True, 300.0, 310.0, None), ("Introduction", 1, 10.0, False, 300.0, 310.0, None), ("Just text.", 1, 10.0, False, 300.0, 310.0, None), ("Page foot", 1, 9.0, False, 760.0, 770.0, None)]
    df = frame(spark, rows, "text string, n_lines int, size double, bold boolean, y0 double, y1 double, runs boolean").withColumns({"page_height": F.lit(792.0), "body_size": F.lit(10.0)})
    assert [r.kind for r in structure.kinds(df).collect()] == ["page_number", "header", "header", "text", "caption", "list_item", "heading", "heading", "heading", "text", "footer"]


def test_margin_numbers_and_headings(spark):
    rows = [(1, i, str(5 * i), 20.0, 100.0 * i, 30.0, 100.0 * i + 10, 792.0) for i in range(1, 6)] + [(1, 9, "7", 300.0, 50.0, 310.0, 60.0, 792.0)]
    df = frame(spark, rows, "page int, block long, text string, x0 double, y0 double, x1 double, y1 double, page_height double")
    assert got(structure.margin_numbers(df, ["page"]), "block") == [(i,) for i in range(1, 6)]
    heads = frame(spark, [(1, 0, "VI.", 14.0, 10.0, 10.0, 30.0, 24.0), (1, 1, "The title", 14.0, 40.0, 10.0, 200.0, 24.0), (1, 2, "of it all", 14.0, 40.0, 26.0, 200.0, 40.0)], "page int, block long, text string, size double, x0 double, y0 double, x1 double, y1 double")
    assert got(structure.label_headings(heads, ["page"]), "label", "title") == [(0, 1)]
    wrapped = structure.wrapped_headings(heads.filter("block > 0").withColumns({"order": F.col("block"), "level": F.lit(2)}), ["page"])
    assert got(wrapped, "text") == [("The title of it all",)]


# ---- tables ---------------------------------------------------------------------------------------


def test_aligned_table(spark):
    rows, n = [], 0
    for r, (a, b, c) in enumerate([("Item", "Price", "Stock"), ("Apple", "3.10", "12"), ("Pear", "4.20", "7"), ("Plum", "1.90", "30"), ("Fig", "6.00", "2")]):
        for text, x in ((a, 100.0), (b, 250.0), (c, 400.0)):
            rows.append((1, n, text, x, 14.0 * r, x + 5 * len(text), 14.0 * r + 10))
            n += 1
    prose = [(2, 100 + r * 2 + s, "a line of running prose that fills its column well", x, 14.0 * r, x + 240, 14.0 * r + 10) for r in range(12) for s, x in enumerate((60.0, 330.0))]
    df = frame(spark, rows + prose, "page int, line long, text string, x0 double, y0 double, x1 double, y1 double")
    out = tables.aligned_tables(df, ["page"])
    assert {r.page for r in out.collect()} == {1} and out.filter("row = 2 AND col = 1").first().text == "4.20" and out.count() == 15


def test_ruled_table():
    h = lambda y, a, b: {"orient": "h", "at": y, "low": a, "high": b}
    v = lambda x, a, b: {"orient": "v", "at": x, "low": a, "high": b}
    rules = [h(0, 0, 200), h(20, 0, 200), h(40, 0, 200), v(0, 0, 40), v(100, 20, 40), v(200, 0, 40)]
    words = [dict(text=t, x0=x, y0=y, x1=x + 20, y1=y + 8) for t, x, y in (("Head", 10, 5), ("left", 10, 25), ("right", 120, 25))]
    table = tables.ruled(rules, words)[0]
    assert [(c["row"], c["col"], c["colspan"], c["text"]) for c in table] == [(0, 0, 2, "Head"), (1, 0, 1, "left"), (1, 1, 1, "right")]


def test_rules_and_spans(spark):
    d = frame(spark, [(1, 0.0, 0.0, 100.0, 1.0, False), (1, 0.0, 0.0, 1.0, 50.0, False), (1, 0.0, 0.0, 40.0, 40.0, False), (1, 5.0, 5.0, 60.0, 60.0, True)], "page int, x0 double, y0 double, x1 double, y1 double, stroked boolean")
    assert got(tables.edges(d).groupBy("orient").count(), "orient", "count") == [("h", 3), ("v", 3)]
    rects = frame(spark, [(1, 0, 0, 0.0, 100.0, 0.0, 10.0), (1, 1, 0, 0.0, 50.0, 10.0, 20.0), (1, 1, 1, 50.0, 100.0, 10.0, 30.0), (1, 2, 0, 0.0, 50.0, 20.0, 30.0)], "page int, row int, col int, x0 double, x1 double, y0 double, y1 double")
    assert got(tables.column_spans(rects, ["page"]), "row", "col", "colspan") == [(0, 0, 2)] and got(tables.row_spans(rects, ["page"]), "row", "col", "rowspan") == [(1, 1, 2)]


def test_folds(spark):
    cells = [(1, r, c, t) for r, row in enumerate([("", "A", "B"), ("x", "0.15", "0.2"), ("", "(4.07)", "(1.2)"), ("y", "1", "2"), ("", "(3)", "")]) for c, t in enumerate(row)]
    out = tables.folded_statistics(frame(spark, cells, "page int, row int, col int, text string"), ["page"])
    assert got(out.filter("col = 1"), "row", "text") == [(0, "A"), (1, "0.15 (4.07)"), (2, "1 (3)")]


def test_split_rows(spark):
    rows = [(1, ["Shapiro W\nP value", "0.46\n0.02"]), (2, ["One label", "a\nb"]), (3, ["Name", "Chief of the\ndepartment"]), (4, ["a\nb\nc", "1\n2"]), (5, ["tier one\ntier two", "1-80 $50\n81-600 $100"]), (6, ["x", "y"])]
    out = tables.split_rows(frame(spark, rows, "id int, cells array<string>"))
    assert got(out.groupBy("id").count(), "id", "count") == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 2), (6, 1)]
    assert got(out.filter("id = 1"), "part", "cells") == [(0, ["Shapiro W", "0.46"]), (1, ["P value", "0.02"])]


def test_html_spans_round_trip(spark):
    cells = frame(spark, [(1, 0, 0, "Head & <x>", 1, 2, True), (1, 1, 0, "a", 2, 1, False), (1, 1, 1, "b", 1, 1, False), (1, 2, 1, "c", 1, 1, False)], "page int, row int, col int, text string, rowspan int, colspan int, header boolean")
    html = tables.html(cells, ["page"]).first().html
    parsed = tables.parse_tables(html)[0]
    assert parsed.cells == {(0, 0): "Head & <x>", (0, 1): "Head & <x>", (1, 0): "a", (1, 1): "b", (2, 0): "a", (2, 1): "c"} and parsed.headers == {(0, 0), (0, 1)}


def test_nested_and_unclosed_tables():
    outer = tables.parse_tables("<table><tr><td>a<table><tr><td>inner</td></tr></table></td><td>b</td></tr><tr><td>c")
    assert [t.cells for t in outer] == [{(0, 0): "inner"}, {(0, 0): "a inner", (0, 1): "b", (1, 0): "c"}]


def test_listing(spark):
    line = lambda text, x, indent, gap=2.0: dict(text=text, x=x, indent=indent, gap=gap, height=10.0)
    out = tables.listing([line("We cover:", 0, 0), line("• fire and", 10, 20), line("smoke", 20, 20), line("– in homes", 25, 35), line("• flood", 10, 20), line("Note at the edge", 0, 0)])
    assert out == {"lead": "We cover:", "items": [{"text": "fire and smoke", "children": ["in homes"], "tail": ""}, {"text": "flood", "children": [], "tail": ""}], "note": "Note at the edge"}
    assert tables.listing([line("• one", 0, 5)]) is None
    kind = "struct<lead:string,items:array<struct<text:string,children:array<string>,tail:string>>,note:string>"
    row = frame(spark, [((out["lead"], [(i["text"], i["children"], i["tail"]) for i in out["items"]], out["note"]),)], f"l {kind}")
    r = row.select(tables.listing_html(F.col("l.lead"), F.col("l.items"), F.col("l.note")).alias("h"), tables.flat_listing(F.col("l.lead"), F.col("l.items"), F.col("l.note")).alias("f")).first()
    assert r.f == "We cover: fire and smoke in homes flood Note at the edge" and r.h.startswith("<p>We cover:</p>\n<ul>\n<li>fire and smoke\n<ul>\n<li>in homes</li>")


def test_key_tables_and_crossings(spark):
    cells = frame(spark, [(1, r, c, t) for r, row in enumerate([("A. one", "short"), ("B. two", "label"), ("C. three", "here")]) for c, t in enumerate(row)] + [(2, r, c, t) for r, row in enumerate([("12", "prose " * 9)] * 3) for c, t in enumerate(row)], "page int, row int, col int, text string")
    assert got(tables.key_table(cells, ["page"]), "page") == [(1,)]
    words = frame(spark, [(1, 7, "ab", 0.0, 0.0, 10.0, 10.0), (1, 7, "cd", 60.0, 0.0, 70.0, 10.0)], "page int, text_cell int, text string, x0 double, y0 double, x1 double, y1 double")
    drawn = frame(spark, [(1, 1, 0.0, 0.0, 50.0, 20.0), (1, 2, 50.0, 0.0, 100.0, 20.0)], "page int, cell int, x0 double, y0 double, x1 double, y1 double")
    assert got(tables.crossings(words, drawn, ["page"]), "crossings") == [(1,)] and got(tables.placed(words, drawn, ["page"]), "cell", "text") == [(1, "ab"), (2, "cd")]


# ---- notes, maths, render, forms, convert ----------------------------------------------------------


def test_notes(spark):
    chars = [(1, i, c, s, y) for i, (c, s, y) in enumerate([("f", 10.0, 100.0), ("a", 10.0, 100.0), ("c", 10.0, 100.0), ("e", 10.0, 100.0), ("1", 6.0, 95.0), ("2", 6.0, 95.0), ("x", 10.0, 100.0)])]
    assert got(notes.raised_markers(frame(spark, chars, "line int, at int, ch string, size double, origin_y double"), ["line"]), "at", "key") == [(4, "12")]
    pages = frame(spark, [("f", 1, "word[^1] and [^2]"), ("f", 3, "again[^1]\n[^1]: defined")], "file string, page long, text string")
    marks = notes.markers(pages)
    assert got(marks, "page", "key") == [(1, "1"), (1, "2"), (3, "1")]
    found = frame(spark, [("f", 2, 0, "1", "first note"), ("f", 3, 9, "1", "second"), ("f", 1, 5, "9", "other")], "file string, page long, line_no int, key string, note string")
    assert got(notes.linked(marks, found), "key", "page", "note_page", "final_key") == [("1", 1, 2, "1"), ("1", 3, 3, "1-p3"), ("2", 1, None, "2")]


def test_printed_numbers(spark):
    edges = frame(spark, [("f", p, f"Page {p + 4} | Policy", 600.0) for p in (1, 2, 3)] + [("f", p, "2", 600.0) for p in (1, 2)] + [("f", 9, "14 / 15", 600.0)], "file string, page long, line string, width double")
    numbers = notes.printed_numbers(edges)
    kept = notes.running_numbers(numbers)
    assert got(kept, "page", "value") == [(1, 5), (2, 6), (3, 7)] and got(notes.applied(kept), "page", "applies") == [(1, "page"), (2, "page"), (3, "page")]
    counts = {(r.page, r.value): r.counts for r in notes.counts_pages(frame(spark, [("f", 1, 5, True), ("f", 2, 6, True), ("f", 3, 7, True), ("f", 2, 90, True)], "file string, page long, value long, left boolean")).collect()}
    assert counts[2, 6] is True and counts[2, 90] is False and counts[1, 5] is None
    verdict = frame(spark, [(1, False, False), (2, False, None), (3, None, False), (4, True, False)], "block int, counts boolean, runs boolean")
    assert got(notes.released(verdict), "block") == [(1,)]


@pytest.mark.parametrize("text, want", [("the fee is $5 and $\\int x$", "the fee is $5 and \\(\\int x\\)"), ("let $x$ be", "let \\(x\\) be"), ("$$a=b$$", "\\[a=b\\]"), ("from $5 to $6", "from $5 to $6"), ("$a +$ $b$", "\\(a + b\\)"), ("$$\\begin{aligned}a&=b\\\\c&=d\\end{aligned}$$", "\\[a=b\\]\n\n\\[c=d\\]")])
def test_delimiters(text, want):
    assert maths.delimited(text) == want


def test_latex(spark):
    assert maths.escaped("costs $5 \\(a & b$\\) &") == "costs \\$5 \\(a \\& b$\\) &"
    assert maths.paired_delimiters("\\big( x \\big)") == "\\left( x \\right)" and maths.paired_delimiters("\\big( {x \\big)}") == "\\big( {x \\big)}"
    assert maths.joined_dangling("\\(x =\\) 2 + 1 = 3.") == "\\(x =2+1=3\\)." and maths.aligned_at_relation("[a=b] = c") == "[a=b] &= c"
    df = frame(spark, [("E_{s}_{,t}  x",), ("a ... b",)], "l string").select(maths.polished(F.col("l")).alias("p"))
    assert [r.p for r in df.collect()] == ["E_{s,t} x", "a \\ldots b"]


def test_rebuilt_formulas():
    g = lambda ch, x, y, size=10.0: dict(ch=ch, x0=x, y0=y - size, x1=x + size / 2, y1=y, size=size, base=y)
    assert maths.rebuilt([g("x", 0, 100), g("2", 6, 94, 6.0), g("i", 10, 103, 6.0)], []) == "x^{2}_{i}"
    assert maths.rebuilt([g("y", 0, 100), g("=", 6, 100), g("a", 14, 90), g("b", 14, 112)], [dict(x0=12, y0=95, x1=22, y1=96)]) == "y=\\frac{a}{b}"
    assert maths.rebuilt([dict(ch="√", x0=0, y0=90, x1=6, y1=100, size=10.0, base=100), g("x", 7, 100)], [dict(x0=6, y0=88, x1=14, y1=89)]) == "\\sqrt{x}"


def test_hyphens_with_a_vocabulary(spark):
    vocabulary = frame(spark, [(w,) for w in "research racist free pre dialysis spirit high third".split()], "word string")
    pairs = [("re-", "search"), ("racist-", "free"), ("pre-", "dialysis"), ("spir-", "it"), ("40-", "to 100"), ("G-", "CSF"), ("unknow-", "able"), ("no", "hyphen"), ("third-", "high")]
    out = dict((a, j) for a, j in got(render.hyphen_join(frame(spark, pairs, "above string, below string"), vocabulary), "above", "joined"))
    assert out == {"re-": "research", "racist-": "racist-free", "pre-": "predialysis", "spir-": "spirit", "40-": "40- to 100", "G-": "G-CSF", "unknow-": "unknowable", "no": "no hyphen", "third-": "third-high"}
    broken = render.broken_words(frame(spark, [("a rese", "arch of"), ("free", "high")], "above string, below string"), vocabulary)
    assert got(broken, "above") == [("a rese",)]


def test_documents(spark):
    rows = [("f", 1, 0, "heading", "A  title", 1), ("f", 1, 1, "text", "A paragraph that is cut", None), ("f", 1, 2, "footer", "Page 1", None), ("f", 2, 0, "text", "by the page. It costs $5…", None), ("f", 2, 1, "list_item", "• entry", 1), ("f", 2, 2, "text", "", None), ("f", 2, 3, "figure", "a [chart]", None)]
    parts = render.parts(frame(spark, rows, "file string, page long, order int, kind string, text string, level int"), ["file"])
    body = render.documents(parts, ["file"]).first().body
    assert body == "# A title\n\nA paragraph that is cut by the page. It costs \\$5...\n\n- entry\n\n![a (chart)](figure)"
    out = {r.part: (r.start, r.end) for r in render.offsets(parts, ["file"]).collect()}
    assert out[1] == (0, 9) and out[2][0] == 11


def test_front_matter_is_yaml(spark):
    import json

    df = frame(spark, [('# A "title": x\n\nOne sentence of more than six words here.', "file:///a b.pdf", "complete", 0.9, 3)], "body string, resource string, completion string, confidence double, pages int")
    front = render.front_matter(df, []).first().front.split("\n")
    assert front[0] == front[-1] == "---" and json.loads(front[2].removeprefix("title: ")) == 'A "title": x' and "  pages: 3" in front


def test_forms(spark):
    rows = [(1, 0, 0, ["Event", "Yes/No Optional", "Some examples (for details of others)"]), (1, 0, 1, ["Flood", "Yes", "x"]), (1, 0, 2, ["Storm", "", "Optional cover"]), (1, 0, 3, ["• Theft", "No", "y"]), (1, 0, 4, ["", "", "left over"]), (2, 0, 0, ["nothing", "here"])]
    schema = "sheet int, table_no int, row int, cells array<string>"
    r = forms.grade(frame(spark, rows, schema), ["sheet"]).collect()
    assert len(r) == 1 and (r[0].events, r[0].events_in_rows, r[0].answers_attached, r[0].header_whole, r[0].orphans) == (3, 3, 2, True, 1)
    other = [(1, 0, 1, ["Flood", "No", "x"]), (1, 0, 2, ["Storm", "", "Optional cover not included"]), (1, 0, 3, ["Theft", "✓ No", "y"])]
    diff = forms.compare(forms.event_rows(frame(spark, rows[1:4], schema), ["sheet"]), forms.event_rows(frame(spark, other, schema), ["sheet"]), ["sheet"])
    assert got(diff, "event", "kind") == [("flood", "answer"), ("storm", "critical words"), ("theft", "mark")]


@pytest.mark.parametrize("spec", ["2-1", "0", "1-2-3", "two", "", "-3", "1,,2"])
def test_bad_selections(spec):
    with pytest.raises(convert.PageSelectionError):
        convert.parse_pages(spec)


def test_conversion(spark):
    rows = []
    for page in (1, 2, 3):
        texts = ["Running Head of the File", "Page title", "This paragraph is long enough to be a real one and it", "carries on over a second line.", f"Page {page} of 3"]
        ys = [20.0, 90.0, 120.0, 132.0, 770.0]
        rows += [("f", page, i, t, 14.0 if i == 1 else 10.0, i == 1, 72.0, y, 500.0, y + 10, 792.0) for i, (t, y) in enumerate(zip(texts, ys))]
    df = frame(spark, rows, "file string, page long, line_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double, page_height double")
    assert convert.parse_pages("1, 3-5") == [(1, 1), (3, 5)]
    out = convert.convert(df, convert.Options(front_matter=False, location_map=True))
    r = out.first()
    assert r.completion == "complete" and convert.exit_code(out) == 0 and "Running Head" not in r.markdown and "Page 1 of 3" not in r.markdown
    assert r.markdown.count("# Page title") == 3 and "a real one and it carries on" in r.markdown and {d.kept_in for d in r.decisions} == {"running", None}
    two = convert.convert(df, convert.Options(pages="2", layout=True)).first()
    assert two.completion == "degraded" and {i.code for i in two.issues} == {"stage-unavailable", "edge-unchecked"} and two.markdown.startswith("---\ntype: Document") and two.build.pages == "2"
    with pytest.raises(convert.PageSelectionError):
        convert.selected(df, "9")


def _b(i, x0, y0, x1, y1, text="a sentence of running text here", kind="text", n=1):
    return dict(block=i, kind=kind, x0=x0, y0=y0, x1=x1, y1=y1, text=text, n_lines=n)


def _reading(blocks, width, size):
    return [b["block"] for b in structure.seated(structure.xy_cut(blocks, max(4.0, 0.6 * size)), width, size)]


def test_labels_beside_definitions():
    terms = [_b(i, 480, y, 560, y + 11, "Term two") for i, y in enumerate((170, 220, 300))]
    told = [_b(10 + i, 610, y, 880, y + 22, "what a term means is told in a sentence", n=2) for i, y in enumerate((170, 220, 300))]
    left = [_b(20 + i, 60, 60 + 40 * i, 460, 71 + 40 * i) for i in range(8)]
    out = _reading(left + terms + told, 940.0, 9.0)
    assert all(out.index(i) + 1 == out.index(10 + i) for i in range(3))


def test_labels_that_stay():
    torn = [_b(0, 120, 380, 550, 391), _b(1, 120, 393, 300, 404, "exist with respect"), _b(3, 420, 393, 550, 404, "and so on with more"), _b(2, 330, 393, 390, 404, "to loading"), _b(4, 120, 406, 550, 417)]
    assert [b["block"] for b in structure.seated(torn, 600.0, 9.0)] == [0, 1, 3, 2, 4]
    cells = [_b(0, 40, 300, 160, 311, "an author and year"), _b(1, 170, 300, 220, 311, "Rodent (40)"), _b(2, 230, 300, 350, 311, "a wide cell"), _b(3, 360, 300, 590, 311, "a later cell of the row, long enough")]
    assert _reading(cells, 600.0, 9.0) == [0, 1, 2, 3]
    number = [_b(1, 80, 200, 300, 214, "the title of the fifth stage", "heading"), _b(2, 80, 220, 380, 231), _b(0, 40, 200, 58, 214, "05")]
    assert [b["block"] for b in structure.seated(number, 420.0, 9.0)] == [1, 2, 0]
    columns = [_b(0, 50, 100, 290, 123, n=2), _b(1, 50, 140, 110, 151, "Introduction", "heading"), _b(2, 50, 160, 290, 183, n=2), _b(3, 310, 100, 550, 123, n=2), _b(4, 310, 140, 550, 175, n=3)]
    assert _reading(columns, 600.0, 9.0) == [0, 1, 2, 3, 4]


def test_bands_and_rows():
    page = [_b(0, 50, 40, 550, 70), _b(1, 50, 100, 290, 300), _b(2, 50, 310, 290, 500), _b(3, 310, 100, 550, 300), _b(4, 310, 310, 550, 500), _b(5, 50, 520, 550, 540), _b(6, 50, 560, 290, 600), _b(7, 310, 560, 550, 600)]
    assert [b["block"] for b in structure.xy_cut(page[::-1], 6.0)] == list(range(8))
    deep = [_b(i, 0, 20 * i, 100, 20 * i + 10) for i in range(500)]
    assert [b["block"] for b in structure.xy_cut(deep[::-1], 6.0)] == list(range(500))
    assert structure.xy_cut([], 6.0) == []


def test_splicing_as_bands_do():
    shared = ["and have not compromised themselves", "in acts against the United States", "I have known Mr Law for many years"]
    assert readings.splice("\n".join(["Besides, they are confirmed", *shared]), "\n".join([*shared, "and valued his word"])).splitlines() == ["Besides, they are confirmed", *shared, "and valued his word"]
    dropped = readings.splice("the distribution of nodes is\nNx times Nv equals forty nine", "distribution of nodes is\nNx times Nv equals forty nine\nby ninety seven").splitlines()
    assert dropped == ["the distribution of nodes is", "Nx times Nv equals forty nine", "by ninety seven"]
    short = readings.splice("a letter of some length about the cargo\n1862", "1862\nand a second page about the insurance")
    assert short.splitlines() == ["a letter of some length about the cargo", "1862", "", "1862", "and a second page about the insurance"]
    far = "\n".join(f"line number {i} of the lower band" for i in range(9)) + "\nthe upper half of the page"
    assert readings.splice("the upper half of the page", far).endswith(far)
    anchored = readings.splice("one two three four five\nsmudge", "an odd line here\none two three four five\nthe rest of it all\na b c d")
    assert anchored.splitlines() == ["one two three four five", "the rest of it all", "a b c d"]


def test_regions_that_grow(spark):
    rows = [(1, "text", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "text", 0.0, 0.0, 10.0, 20.0, 0.5), (1, "text", 1.0, 12.0, 9.0, 19.0, 0.8), (1, "caption", 0.0, 1.0, 10.0, 19.0, 0.3), (2, "table", 74.0, 185.0, 523.0, 322.0, 0.87), (2, "table", 74.0, 459.0, 526.0, 547.0, 0.59), (3, "page_header", 0.0, 0.0, 90.0, 40.0, 0.5), (3, "title", 0.0, 0.0, 90.0, 40.0, 0.9)]
    df = frame(spark, rows, "page int, kind string, x0 double, y0 double, x1 double, y1 double, score double")
    out = got(boxes.clean_regions(df, ["page"], 800.0), "page", "kind", "y1", "score")
    assert out == [(1, "text", 20.0, 0.9), (2, "table", 322.0, 0.87), (2, "table", 547.0, 0.59), (3, "page_header", 40.0, 0.5)]


def test_reconciled_words():
    from collections import Counter

    def run(lost, added, printed=(), written=(), blob=""):
        lost, added = Counter(lost), Counter(added)
        out = bags.reconcile(lost, added, [p.split() for p in printed], [w.split() for w in written], blob)
        return {k: dict(v) for k, v in out.items() if v}, dict(+lost), dict(+added)

    assert run(["afer"], ["after"]) == ({"repaired": {"afer->after": 1}}, {}, {})
    assert run(["artificial"], ["4artificial"]) == ({"glued": {"4artificial": 1}}, {}, {})
    assert run(["1understanding"], ["understanding"], written=["1 understanding"]) == ({"split": {"1understanding": 1}}, {}, {})
    assert run(["12other"], ["other"], written=["2 other"]) == ({}, {"12other": 1}, {"other": 1})
    assert run(["step", "1", "two"], ["step1"], printed=["step 1 two"]) == ({"glued": {"step1": 1}}, {"two": 1}, {})
    assert run(["oneword"], ["one", "word"], written=["one word"]) == ({"split": {"oneword": 1}}, {}, {})
    assert run(["bu", "ildingamong", "gables"], [], printed=["bu ildingamong gables"], blob="buildingamonggables") == ({"respaced": {"bu": 1, "ildingamong": 1, "gables": 1}}, {}, {})
    many = [f"w{i}x" for i in range(20_000)]
    assert run(many, [f"{w}!" for w in many])[1:] == ({}, {})


@pytest.mark.parametrize("text, want", [
    ("take $p=q$    $dp = dq$, then", r"take \(p=q\)    \(dp = dq\), then"),
    ("find $g(2)$ , $h(-1)$ and $Q$ of x", r"find \(g(2)\) , \(h(-1)\) and \(Q\) of x"),
    (r"then $\cos t$ and $ln m$", r"then \(\cos t\) and \(ln m\)"),
    *[(p, p) for p in ("$7 a $12 lamp", "$7 a day, $8 a week", "$1,300 a month", r"pays \$5 or \$6", "one $ sign", "", r"\(ours\)")],
    (r"7. $3m + \{m - 7n\}$ $+ [9m + 1]$ $- k$ . 8.", r"7. \(3m + \{m - 7n\} + [9m + 1] - k\) . 8."),
    (r"$u +$ $v$ and $x$ $y$", r"\(u + v\) and \(x\) \(y\)"),
    (" ".join(["$a +$"] * 600), r"\(" + " ".join(["a +"] * 600) + r"\)"),
    (r"$$\begin{pmatrix} a & b \\ c & d \end{pmatrix}$$", r"\[\begin{pmatrix} a & b \\ c & d \end{pmatrix}\]"),
    (r"$$\begin{align} a &= b \end{align}$$", r"\[\begin{align} a &= b \end{align}\]"),
    (r"$$\begin{align*} f &= g \\ &\quad - h \\ &\quad (3a) \end{align*} & (k)$$", "\\[f = g\\]\n\n\\[\\quad - h \\quad (3a)\\]\n\n\\[(k)\\]"),
    (r"$$\begin{gather} a \\[2pt] \begin{cases} 1 & x \\ 0 & y \end{cases} \end{gather}$$", "\\[a\\]\n\n\\[\\begin{cases} 1 & x \\\\ 0 & y \\end{cases}\\]"),
])
def test_delimiters_at_length(text, want):
    assert maths.delimited(text) == want


@pytest.mark.parametrize("text, want", [
    (r"\bigg[ u \bigg]", r"\left[ u \right]"), (r"\Big\{ u \Big\}", r"\left\{ u \right\}"), (r"\bigl( \Big( u \Big) \bigr)", r"\left( \left( u \right) \right)"),
    (r"\frac{\big( u \big)}{v}", r"\frac{\left( u \right)}{v}"), *[(x, x) for x in (r"\big( u", r"u \big)", r"\Bigg| u \Bigg|", r"\big( u \\ v \big)", r"\big( u & v \big)", r"{\big( u} v \big)", r"\frac{\big( u}{v \big)}")],
])
def test_sized_delimiters(text, want):
    assert maths.paired_delimiters(text) == want


@pytest.mark.parametrize("text, want", [
    ("so \\(u+v=\\)\n4 and then", "so \\(u+v=4\\) and then"), ("as \\(u=v\\) 2 things and \\(a<b\\) 3.", None), ("where \\(n=\\) the rows", None), ("\\(u =\\) \\(v\\) w", "\\(u = v\\) w"), ("\\(u=\\) 3and", None), ("\\(u=\\) 2 × (3, 4) = 5%", "\\(u=2\\times (3,4)=5%\\)"),
])
def test_dangling(text, want):
    assert maths.joined_dangling(text) == (text if want is None else want)
