"""Cases that reviews have found, each of which failed before it was mended."""

import re
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from inkwright.functions import fuzzy, text
from inkwright.operators import bags, boxes, checks, cuts, maths, placing, render, running, tables
from inkwright.plans import registry


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_critical_words_by_plain_bounds(spark):
    df = frame(spark, [(1, "and noño, underßkeit; not", "$5 not")], "p int, a string, b string")
    found = lambda **how: sorted(tuple(r) for r in bags.critical_difference(df, ["p"], "a", "b", **how).select("word", "n").collect())
    assert found() == [("$5", 1)] and found(plain_bounds=True) == [("$5", 1), ("no", 1), ("under", 1)]


def test_hidden_runs_takes_tied_lines_as_stored(spark, tmp_path):
    n = 200
    keys = [k for k in range(n) for _ in range(2)]
    tied = pa.table({"l_orderkey": pa.array(keys, pa.int64()), "l_linenumber": pa.array([1] * 2 * n, pa.int32()), "l_partkey": pa.array([0] * 2 * n, pa.int64()), "l_suppkey": pa.array([1, 2] * n, pa.int64())})
    (tmp_path / "lineitem.parquet").mkdir()
    for i, half in enumerate((tied.take(list(range(0, 2 * n, 2))), tied.take(list(range(1, 2 * n, 2))))):  # the second file, which holds the later rows, is the larger, so that Spark reads it first
        pq.write_table(half if i == 0 else pa.concat_tables([half, half]), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    rows = registry.QUERIES["hidden_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == n and {r["reason"] for r in rows} == {"tiny"}


def test_script_reads_the_text_once_a_script(spark):
    df = frame(spark, [(1, "aé дд"), (2, "ааaa!"), (3, "漢字 ab"), (4, "12 ,"), (5, ""), (6, None), (7, "ééé ддд αα")], "p int, t string")
    out = df.select("p", text.script(F.col("t")).alias("s"))
    assert [r["s"] for r in out.sort("p").collect()] == ["Latin", "Latin", "Latin", None, None, None, "Latin"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("IsGreek") == 1


def test_a_page_is_parsed_once_for_its_checks(monkeypatch):
    md = "| Order | Status |\n|---|---|\n" + "\n".join(f"| {i} | F_{i} |" for i in range(9))
    calls = []
    monkeypatch.setattr(checks, "parse_tables", lambda *a: calls.append(a) or tables.parse_tables(*a))
    ask = lambda i, right, diffs=0: SimpleNamespace(type="table", max_diffs=diffs, cell=str(i), right=right, up=None, down=None, left=None, top_heading="Order", left_heading=None, ignore_markdown_tables=None)
    assert [checks.run_one(ask(i, f"F_{i}"), md) for i in range(9)] == [True] * 9 and len(calls) == 1
    assert not checks.run_one(ask(3, "F_4"), md) and checks.run_one(ask(3, "F_4", 2), md)
    pairs = [("", ""), ("", "a"), ("abc", "abd"), ("ab", "abcd"), ("kitten", "sitting"), ("a", "b")]
    assert all(checks.near(a, b, least) == (fuzzy.ratio(a, b) >= least) for a, b in pairs for least in (0.5, 2 / 3, 0.8, 1))


def test_a_cut_is_computed_once_and_read_by_column(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    out = cuts.cut(spark.range(100).withColumn("t", F.lit("a" * 50)).mapInArrow(run, "id long, t string"))
    assert out.select("id").distinct().count() == 100 and seen.value == 100
    assert "ReadSchema: struct<id:bigint>" in out.select("id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert cuts.cut(spark.range(3).select("id", F.lit(None).alias("nothing"))).count() == 3


def test_likeness_is_that_of_all_pairs(spark, monkeypatch):
    import random

    draw = random.Random(3)
    base = [[draw.choice("abcdefghij") * draw.randint(1, 2) for _ in range(draw.choice((0, 1, 2, 5, 30, 90)))] for _ in range(40)]
    changed = [[w if draw.random() > share else "x" for w in ws] for ws in base for share in (0.0, 0.08, 0.2)]
    old = [(draw.choice("fg"), i, " ".join(ws)) for i, ws in enumerate(base)] + [(None, 99, "a b")]
    new = [(f, i * 3 + k, " ".join(changed[i * 3 + k])) for i, (f, _, _) in enumerate(old[:-1]) for k in range(3)] + [("f", 900, None), (None, 901, "a b")]
    monkeypatch.setattr(running, "GRAMS", 100)
    sides = [running.classes(frame(spark, rows, "file string, page long, text string")) for rows in (old, new)]
    got = {(r.file, r.old_page, r.new_page): round(r.likeness, 9) for r in running.likeness(*sides).collect()}

    def sets(rows):
        first = {}
        for f, page, t in rows:
            ws = (t or "").split()
            first.setdefault((f, frozenset(zip(ws, ws[1:])) if len(ws) != 1 else frozenset([(ws[0],)])), page)
        return [(f, s, page) for (f, s), page in first.items()]

    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(f, p, q): round(share(a, b), 9) for f, a, p in sets(old) for g, b, q in sets(new) if f == g and f is not None and share(a, b) >= 0.5}
    assert got == want and len(want) > 50


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_long_documents_are_put_together_of_chunks(spark):
    import json

    n = 1200
    rows = [("f", i, i // 40, "text", f"part {i}…\u0001  " if i in (3, n) else f"part {i}") for i in range(1, n + 1)] + [("g", 1, 1, None, "alone")]
    parts = frame(spark, rows, "file string, part long, page long, kind string, text string")
    rest = frame(spark, [("f", 1), ("g", 2), ("h", 3)], "file string, pages int")
    want = "\n\n".join(f"part {i}" if i not in (3, n) else "part 3...  " if i == 3 else f"part {n}..." for i in range(1, n + 1))
    out = {r.file: r for r in render.gathered(parts, rest, ["file"], True).collect()}
    assert out["f"].body == want and (out["g"].body, out["g"].pages, out["h"].body, out["h"].pages) == ("alone", 2, None, 3)
    places = json.loads(f"[{out['f'].blocks}]")
    assert [p["part"] for p in places] == list(range(1, n + 1)) and places[1]["range"] == [8, 14] and "kind" not in json.loads(out["g"].blocks)
    assert {r.file: r.body for r in render.documents(parts, ["file"]).collect()} == {"f": want, "g": "alone"}


def test_titles_and_descriptions_behind_a_long_head(spark):
    far = "- item\n\n" * 9000 + "# A heading far on\n\nThe first sentence that has six words. More."
    cut = "x" * (text.HEAD - 9) + "\n# Heading that is cut\n\nAnother sentence of more than six words."
    rows = frame(spark, [(1, far), (2, cut), (3, None)], "p int, t string").select("p", text.title_of(F.col("t")).alias("a"), text.description_of(F.col("t")).alias("b"))
    got = {r.p: (r.a, r.b) for r in rows.collect()}
    assert got[1] == ("A heading far on", "The first sentence that has six words.") and got[2] == ("Heading that is cut", "Another sentence of more than six words.") and got[3] == (None, None)


def test_places_of_a_rewrite_travel_as_bytes(spark):
    out = placing.rewritten(F.col("t"), "b+", "##")
    df = frame(spark, [(1, "abbbc"), (2, ""), (3, None)], "p int, t string").select("p", out.alias("r"))
    assert [r.r and (r.r.text, r.r.at) for r in df.sort("p").collect()][:2] == [("a##c", [0, 1, 2, 3, 3, 4]), ("", [0])]
    assert placing.places(re.compile("b+"), "##", "abbbc")[1].nbytes == 6 * 4


def test_boxes_are_moved_once_for_bins_and_channels(spark):
    page = frame(spark, [(1, r, x, x + w) for r in range(5) for x, w in ((0.0, 3.0), (20.0, 4.0))] + [(1, 9, 5.0, 9.5)], "page int, row int, x0 double, x1 double")
    bins, found = boxes.coverage(page, ["page"]), tables.channels(page, ["page"], 4.0)
    assert _exchanges(bins) == 1 and _exchanges(found) == 1
    assert [tuple(r) for r in found.collect()] == [(1, 4, 20)] and {r.bin: r.n for r in bins.collect()} == {**dict.fromkeys([0, 1, 2, 3, *range(20, 25)], 5), **dict.fromkeys(range(5, 10), 1)}


def test_few_regions_are_kept_as_many_are():
    import random

    import numpy as np

    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 12)
        box = [[x := draw.randint(0, 6) * 1.0, y := draw.randint(0, 6) * 1.0, x + draw.randint(0, 9), y + draw.randint(0, 9)] for _ in range(n)]
        kinds, scores = [draw.choice(("text", "table", "figure")) for _ in range(n)], [draw.randint(5, 9) / 10 for _ in range(n)]
        order = sorted(range(n), key=lambda i: -scores[i])
        at, kept, score = boxes.suppressed(np.array(box, float), kinds, np.array(scores), np.array(order))
        assert [(i, b, s) for i, b, s in boxes.suppressed_few(box, kinds, scores, order)] == [(int(i), b.tolist(), float(s)) for i, b, s in zip(at, kept, score)]


def test_segments_are_counted_without_distinct(spark, sf_dir):
    df = registry.QUERIES["line_segments"](spark, sf_dir)
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString() and _exchanges(df) == 1


def test_only_what_stands_between_dollars_is_lexed(monkeypatch):
    seen = []
    monkeypatch.setattr(maths, "lexed", lambda t, own=maths.lexed: seen.append(len(t)) or own(t))
    prose = "plain words & signs, 12.5 of them. " * 300
    assert maths.delimited(f"{prose}$x + 1${prose}") == rf"{prose}\(x + 1\){prose}" and maths.escaped(f"{prose}$5 \\(a & b\\)") == rf"{prose}\$5 \(a \& b\)"
    assert sum(seen) < 100


def test_a_text_is_made_plain_once_for_its_checks(spark, sf_dir):
    plan = lambda name: registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("check_order").count("<br/?>") == 3 and plan("check_run").count("<br/?>") == 4
    odd = " a  b \n c\n\nd  e  f*g* _h_ <br>‘x’ “y” µ–− ＿"
    assert frame(spark, [(odd,)], "t string").select(text.normalize(F.col("t")).alias("t")).first().t == " a b c d e fg h 'x' \"y\" μ-- _"


def test_pages_of_answered_checks_stay_behind(spark):
    asked = [{"pdf": "f", "page": p, "id": f"{kind}{p}", "type": kind, "max_diffs": 0, "text": "b"} for p in (1, 2) for kind in ("present", "absent", "baseline")]
    rows = frame(spark, asked, checks.SCHEMA)
    run = checks.run(rows, frame(spark, [("f", 1, 1, "a b"), ("f", 2, 1, "a" * 40)], "pdf string, page int, repeat int, md string"))
    assert {r.id: r.passed for r in run.collect()} == {"present1": True, "absent1": False, "baseline1": True, "present2": False, "absent2": True, "baseline2": False}
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert re.search(r"isnull\(passed#\d+\)\)? (?:THEN )?md#", plan)


def test_page_classes_are_not_written(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(running, "cut", lambda df: 1 / 0)
    assert registry.QUERIES["page_classes"](spark, sf_dir).count() > 0


def test_lines_are_moved_once_for_prints(spark):
    lines = [("f", p, p, n, 3, t, b) for p in (1, 2) for n, t, b in ((0, "Head 1", "head"), (1, f"body {p}", "body"), (2, f"foot {'ab'[p - 1]}", "foot"))]
    out = running.prints(frame(spark, lines, "file string, page long, doc_id long, line_no long, n_lines long, line string, band string"))
    assert not re.search(r"Exchange hashpartitioning\([^)]*line_no", out._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.page, r.body, r.running) for r in out.collect()) == [(1, "body 1 foot a", ["head #"]), (2, "body 2 foot b", ["head #"])]


def test_lines_are_moved_once_to_be_joined_by_vocabulary(spark):
    pairs = frame(spark, [("a micro-", "scope x"), ("well-", "known"), ("x-", "Ray")], "above string, below string")
    out = render.hyphen_join(pairs, frame(spark, [(w,) for w in ("microscope", "well", "known")], "word string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*isnull\(_[at]", plan)) == 2
    assert {r.above: r.joined for r in out.collect()} == {"a micro-": "a microscope x", "well-": "well-known", "x-": "x-Ray"}


def test_tokens_are_made_bare_once_for_their_vowels(spark):
    rows = frame(spark, [(["word", "(word)", "xyz", "bcd.", "a", "12", "x1", "aaaa", "—", "éa"],)], "t array<string>")
    shares = rows.select(text.vowel_shares(F.col("t")).alias("s"))
    assert shares.first().s == [0.25, 0.25, 1 / 3, 0.0, 0.5, 0.5, -1.0, 1.0, -1.0, 0.5]
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower") == 2


def test_words_of_letters_alone_are_not_cut_for_numerals(monkeypatch):
    cut = []
    monkeypatch.setattr(bags, "_ends", lambda w, fits, own=bags._ends: cut.append(w) or own(w, fits))
    found = bags.reconcile(bags.Counter(["12abc", "plain", "dash"]), bags.Counter(["12", "abc", "other", "dash_"]), [["12abc", "plain", "dash"]], [["12", "abc", "other"]], "")
    assert sorted(cut) == ["dash_"] and found["split"] == {"12abc": 1} and found["glued"] == {"dash_": 1}


def test_pages_of_bare_tags_are_read_as_the_parser_reads_them(monkeypatch):
    import random

    def parsed(md):
        reader = tables._Reader()
        reader.feed(md)
        for t in reversed(reader.open):
            reader._close(t)
            reader.done.append(t["table"])
        return [t for t in reader.done if t.cells]

    draw = random.Random(27)
    bare = [f"<{s}{t}>" for t in ("table", "tr", "td", "th", "ul", "li", "br", "B", "TD", "h2", "thead") for s in ("", "/")] + ["a", " b\n c ", "x > y", "", "*d*"]
    odd = ["&amp;", "&", "<td rowspan=2>", "<br/>", "<!-- c -->", "a < b", "</td >", "<script>", "<ſub>", "<li", "<"]
    pages = [("<table>" + "".join(draw.choice(bare) for _ in range(draw.randint(1, 40))), True) for _ in range(1500)]
    pages += [("<table><tr><td>" + "".join(draw.choice(bare + odd) for _ in range(draw.randint(1, 30))) + draw.choice(odd), False) for _ in range(1500)]
    want, fed = [parsed(md) for md, _ in pages], []
    monkeypatch.setattr(tables._Reader, "feed", lambda self, md, own=tables._Reader.feed: fed.append(md) or own(self, md))
    assert [tables.parse_tables(md, False) for md, _ in pages] == want
    assert fed == [md for md, plainly in pages if not plainly]


def test_list_checks_make_plain_only_what_they_compare(monkeypatch):
    md = "<table><tr>" + "".join(f"<th>Head {k}</th>" for k in range(9)) + "</tr>" + "<tr>" + "".join(f"<td>cell<ul><li>**entry** {k}</li></ul></td>" for k in range(9)) + "</tr></table>" + "<table><tr><td>far</td></tr></table>" * 50
    ask = lambda item, heading: SimpleNamespace(type="list_item", max_diffs=0, item=item, top_heading=heading)
    made = []
    monkeypatch.setattr(checks, "plain", lambda t, own=checks.plain: made.append(t) or own(t))
    assert [checks.run_one(ask(f"entry {k}", f"Head {h}"), md) for k in range(9) for h in (k, k + 1)] == [True, False] * 9
    assert checks.run_one(ask("entry 3", None), md) and not checks.run_one(ask("cell", None), md)
    assert len(made) == 9 + 18 * 3 + 2 * 2


def test_ascii_that_is_plain_stays_as_it_is(monkeypatch):
    import unicodedata

    normalised = []
    monkeypatch.setattr(unicodedata, "normalize", lambda form, t, own=unicodedata.normalize: normalised.append(t) or own(form, t))
    assert checks.plain("Brand#7, 12 > 3") == "Brand#7, 12 > 3" and not normalised
    odd = {" a  b ": " a b ", "a\tb": "a b", "a\x1cb": "a b", "a\x85b": "a b", "*a* _b_": "a b", "a<br>b": "a b", "‘é’": "'é'", "": "", None: ""}
    assert {t: checks.plain(t) for t in odd} == odd


def test_open_checks_cross_as_columns():
    shared = "<table>" + "x" * 99
    batch = pa.RecordBatch.from_pydict({"id": pa.array(["a", "b", None]), "max_diffs": pa.array([0, None, 2], pa.int32()), "cased": pa.array([None, True, False]), "url": pa.array([None] * 3, pa.string()), "md": pa.array([shared, "other", shared])})
    rows = list(checks._rows(batch))
    assert [tuple(r) for r in rows] == [("a", 0, None, None, shared), ("b", None, True, None, "other"), (None, 2, False, None, shared)]
    assert rows[0].md is rows[2].md and not list(checks._rows(batch.slice(0, 0)))


def test_equal_checks_of_equal_short_pages_are_answered_once(monkeypatch):
    page = lambda n: f"<table><tr><th>What</th></tr><tr><td>{'x' * n}<ul><li>fire</li></ul></td></tr></table>"
    ask = lambda item, heading="What": SimpleNamespace(type="list_item", max_diffs=0, item=item, top_heading=heading)
    calls = []
    checks._has_entry_kept.cache_clear()
    monkeypatch.setattr(checks, "parse_tables", lambda md, *a: calls.append(len(md)) or tables.parse_tables(md, *a))
    asked = [(page(n), item) for n in (*range(20), 1000) for item in ("fire", "flood")] * 3
    assert [checks.run_one(ask(item), md) for md, item in asked] == [item == "fire" for _, item in asked]
    assert not checks.run_one(ask("fire", "Other"), page(0)) and checks.run_one(ask("fire", None), page(0)) and not checks.run_one(ask(None), page(0))
    assert len(calls) == 21 + 1 and checks._has_entry_kept.cache_info().currsize == 20 * 2 + 3  # the long page is held with the few last read
