from inkwright.operators import characters as H
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def said(df, *order):
    return ["".join(r.ch for r in df.orderBy(*order).collect())]


def test_spaced_letters(spark):
    row = lambda line, words: [(line, t, 10.0, x, x + 5.0 * len(t)) for t, x in words]
    spaced = row(1, [(c, 8.0 * i + (10 if i > 5 else 0)) for i, c in enumerate("Annualreport")])
    cells = row(2, [(c, 20.0 * i) for i, c in enumerate("12345678")])
    short = row(3, [("a", 0.0), ("b", 8.0), ("c", 16.0)])
    leaders = row(4, [(".", 8.0 * i) for i in range(9)])
    out = H.spaced_letters(frame(spark, spaced + cells + short + leaders, "line int, text string, size double, x0 double, x1 double"), ["line"])
    got = {}
    for r in out.orderBy("line", "x0").collect():
        got.setdefault(r.line, []).append(r.text)
    assert got[1] == ["Annual", "report"] and got[2] == list("12345678") and got[3] == ["a", "b", "c"] and got[4] == ["."] * 9


def test_drop_caps(spark):
    schema = "page int, line int, text string, size double, x0 double, y0 double, x1 double, y1 double"
    first, second = ("e gouvernement cultive", 10.0, 45.0, 247.0, 150.0, 257.0), ("quillement le chaos.", 10.0, 45.0, 258.0, 150.0, 268.0)
    rows = [(1, 0, "L", 41.0, 24.0, 241.0, 44.5, 282.0), (1, 1, *first), (1, 2, *second), (1, 3, "les transports", 10.0, 266.0, 247.0, 330.0, 257.0)]
    out = {(r.line): (r.text, r.x0) for r in H.drop_caps(frame(spark, rows, schema), ["page"]).collect()}
    assert out == {1: ("Le gouvernement cultive", 24.0), 2: ("quillement le chaos.", 45.0), 3: ("les transports", 266.0)}
    stay = [(1, 0, "L", 10.0, 40.0, 247.0, 45.0, 257.0), (1, 1, *first), (2, 0, "L", 41.0, 24.0, 241.0, 44.0, 282.0), (2, 1, "e far away", 10.0, 120.0, 247.0, 200.0, 257.0)]
    assert {r.text for r in H.drop_caps(frame(spark, stay, schema), ["page"]).collect()} == {"L", "e gouvernement cultive", "e far away"}


def line_of(text, font="CMR10", line=1):
    return [(1, line, i, ch, font, 5.0 * i, 5.0 * i + 5.0) for i, ch in enumerate(text)]


CHARS = "page int, line int, at int, ch string, font string, x0 double, x1 double"


def test_tex_letters(spark):
    def read(*lines):
        rows = [r for n, (t, f) in enumerate(lines) for r in line_of(t, f, n)]
        out = H.tex_letters(frame(spark, rows, CHARS), ["page"], ["page", "line"])
        got = {}
        for r in out.orderBy("line", "at", "part").collect():
            got.setdefault(r.line, []).append((r.ch, r.x0, r.x1))
        return ["".join(c for c, _, _ in got[n]) for n in sorted(got)], got

    text, boxes = read(("the classi\x0ccation of e\x0ecient o\x0b-line work", "F"))
    assert text == ["the classification of efficient off-line work"]
    at = [c for c, _, _ in boxes[0]].index("f")
    assert boxes[0][at][1:] == (50.0, 52.5) and boxes[0][at + 1][1:] == (52.5, 55.0)
    assert read(("a newer \x1cnal e\x1eect of letters here", "F"))[0] == ["a newer final effiect of letters here"]  # the newer encoding
    symbols = "\x0c + \x0c = x y z \x0c - \x0c + \x0c a b"
    assert read((symbols, "S"))[0] == [symbols]  # single letters: no text face
    assert read(("short \x0cn", "F"))[0] == ["short \x0cn"]


def test_composed_accents(spark):
    def read(*chars):
        rows = [(1, i, ch, font, 10.0, x, x + 5.0) for i, (ch, font, x) in enumerate(chars)]
        out = H.composed_accents(frame(spark, rows, "line int, at int, ch string, font string, size double, x0 double, x1 double"), ["line"])
        return "".join(r.ch for r in out.orderBy("at").collect())

    assert read(("o", "F", 0.0), ("´", "F", 0.0), ("n", "F", 5.0)) == "ón"
    assert read(("H", "F", 0.0), ("¨", "F", 5.0), ("o", "F", 5.0)) == "Hö"
    assert read(("x", "M", 0.0), ("ˆ", "R", 0.0)) == "xˆ" and read(("q", "F", 0.0), ("¨", "F", 0.0)) == "q¨" and read(("o", "F", 0.0), ("´", "F", 9.0)) == "o´"
    assert read(("c", "F", 0.0), ("¸", "F", 0.0), ("a", "F", 5.0), ("˜", "F", 5.0), ("o", "F", 10.0)) == "ção"


def test_standing_numbers(spark):
    rows = [("Page 30 | Household Policy",), ("v2.1 and 12% of $5, 7-8",), ("3 of 14",), ("no figure",)]
    out = H.standing_numbers(frame(spark, rows, "line string").withColumns({"x0": F.lit(0.0), "x1": F.lit(100.0)}))
    assert sorted((r.line[:4], r.value, round(r.x, 3)) for r in out.collect()) == [("3 of", 3, 7.143), ("3 of", 14, 85.714), ("Page", 30, round(6 / 26 * 100, 3))]


def test_groups_of_fills(spark):
    rows = [(1, i, 10.0 * i, 0.0, 10.0 * i + 10, 10.0) for i in (0, 1, 2, 5)] + [(1, 9, 20.0, 10.5, 30.0, 20.0), (2, 3, 0.0, 0.0, 10.0, 10.0)]
    out = H.fill_groups(frame(spark, rows, "page int, fill long, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert sorted((r.page, r.fill, r.grp) for r in out.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 5, 5), (1, 9, 0), (2, 3, 3)]


def test_sizes_of_marks(spark):
    rows = [(12.0, 12.0, 612.0, 792.0), (40.0, 40.0, 1920.0, 1080.0), (40.0, 40.0, 612.0, 792.0), (2.0, 12.0, 612.0, 792.0), (30.0, 10.0, 612.0, 792.0), (5.0, 5.0, None, None)]
    df = frame(spark, rows, "w double, h double, pw double, ph double")
    assert [r.m for r in df.select(H.mark_sized(*map(F.col, ("w", "h", "pw", "ph"))).alias("m")).collect()] == [True, True, False, False, False, True]


def test_places_of_a_rewrite(spark):
    from inkwright.operators import placing as P

    df = frame(spark, [("ab12c3",), ("",), (None,), ("777",)], "t string").select("t", P.rewritten(F.col("t"), "[0-9]+", "<N>").alias("r"))
    got = {r.t: (r.r.text, r.r.at) for r in df.collect()}
    assert got["ab12c3"] == ("ab<N>c<N>", [0, 1, 2, 3, 5, 6, 9]) and got[""] == ("", [0]) and got["777"] == ("<N>", [0, 1, 2, 3]) and got[None] == (None, None)


def test_headings_above_a_box(spark):
    from inkwright.operators import placing as P

    words = frame(spark, [(1, 0, "Name", 10.0, 80.0, 40.0, 90.0), (1, 1, "Amount", 60.0, 80.0, 90.0, 90.0), (1, 2, "far", 10.0, 10.0, 40.0, 20.0), (2, 0, "alone", 10.0, 80.0, 40.0, 90.0)], "page int, word int, text string, x0 double, y0 double, x1 double, y1 double")
    columns = frame(spark, [(p, 1, c, 50.0 * c, 50.0 * c + 50, 95.0) for p in (1, 2) for c in (0, 1)], "page int, tab int, col int, low double, high double, top double")
    assert sorted(map(tuple, P.headings_above(words, columns, ["page"]).collect())) == [(1, 1, 0, "Name"), (1, 1, 1, "Amount")]
