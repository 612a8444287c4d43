import pytest
from pyspark.sql import functions as F

from inkwright.functions import fuzzy
from inkwright.functions import text as T


def value(spark, fn, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize("token, want", [("0Ql.5)')81", True), ("~hlngomonas", True), ("PIOI*Jnlboctenum", True), ("wordGlueDhere", True), ("strngth", True), ("hello", False), ("https://a.b/c%d$e", False), ("me@x.org", False), ("it's", False), ("K9x", False), ("rock-and-roll", False), ("a1b2cdef", True), ("Étude", False)])
def test_garbled(spark, token, want):
    assert value(spark, T.garbled, token) is want


def test_garbled_in_its_script(spark):
    assert value(spark, T.garbled_in_script, "महत्वपूर्ण") is False and value(spark, T.garbled_in_script, "0Ql.5)')81漢字") is True


@pytest.mark.parametrize("line, want", [("12", True), ("– iv –", True), ("ANNUAL REPORT", True), ("An ordinary sentence", False), ("", False), ("第3章", True), ("AB", False), ("A B C D E F G H I J", False)])
def test_furniture(spark, line, want):
    assert value(spark, T.furniture, line) is want


@pytest.mark.parametrize("a, b, want", [("re-", "search", "research"), ("G-", "CSF", "G-CSF"), ("one", "two", "one two"), ("", "x", "x"), ("a -", "b", "a - b")])
def test_join_broken(spark, a, b, want):
    assert value(spark, T.join_broken, a, b) == want


def test_titles_and_descriptions(spark):
    body = "# A title here\n\nLead in:\n\nThis is the first real sentence of it. More follows.\n\n| a | b |"
    assert value(spark, T.title_of, body) == "A title here" and value(spark, T.description_of, body) == "This is the first real sentence of it."
    assert value(spark, T.title_of, "none") is None and value(spark, T.description_of, "short one") == "short one" and value(spark, T.description_of, "") is None
    assert len(value(spark, T.description_of, "w " * 300)) == 200


def test_numbers_and_marks(spark):
    assert value(spark, T.mark_of, "✓ Yes") == "tick" and value(spark, T.mark_of, "✗ no") == "cross" and value(spark, T.mark_of, "no") == ""
    assert value(spark, T.statistic, "(-1.07)**".replace("**", "*")) is True and value(spark, T.statistic, "(n = 12)") is False
    assert value(spark, T.numeric_cell, "$1,200.50*") is True and value(spark, T.numeric_cell, "abc") is False
    assert value(spark, T.critical, "Not covered up to $1,000 or 5 %") == ["not", "up to".replace(" ", ""), "$1000", "5%"]
    assert value(spark, T.clean_cell, "Total . . . . .") == "Total" and value(spark, T.clean_cell, "---") == "---"


def test_list_items(spark):
    level = lambda n: lambda c: T.list_item(c, F.lit(n))
    assert value(spark, level(1), "• entry") == "- entry" and value(spark, level(3), "(4) entry") == "    4. entry" and value(spark, level(9), "(a) kept") == "      (a) kept"


def test_hash_splits(spark):
    import hashlib

    for name in ("a", "page_1.pdf", "é"):
        digest = hashlib.sha1(name.encode()).hexdigest()
        assert value(spark, T.sha_mod5, name) == int(digest, 16) % 5 and value(spark, lambda c: T.first_hex(c, 7), name) == int(digest[:8], 16) % 7


def test_printed_and_load(spark):
    assert value(spark, T.printed_chars, "---\na: b\n---\n| a | b |\n| --- | :-: |\n<b>cd</b>") == 4
    assert value(spark, lambda c: T.load(c, F.lit(8.0), F.lit(4.0)), "abcd") == 1.0 and value(spark, lambda c: T.load(c, F.lit(0.0), F.lit(4.0)), "abcd") == 0.0


def test_word_order(spark):
    same = lambda a, b: T.in_order(F.split(a, " "), F.split(b, " "))
    assert value(spark, same, "a policy has", "page a 3 policy now has") is True and value(spark, same, "has a policy", "page a policy has") is False


def test_fuzzy_equals_plain_definitions():
    import random

    rng = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        return row[-1]

    def _step(row, x, b):
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(new[-1], row[j], row[j - 1] + (x == y)))
        return new

    def ends(p, t, k):
        row, out = list(range(len(p) + 1)), []
        for j, y in enumerate(t, 1):
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i - 1] + (x != y), row[i] + 1, new[-1] + 1))
            row = new
            if row[-1] <= k:
                out.append(j)
        return out

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
        if a:
            assert fuzzy.near(a, b, 2) == ends(a, b, 2)
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 1.0 and fuzzy.partial_ratio("abcd", "abxd") == 0.75 and fuzzy.partial_ratio("", "x") == 0.0
