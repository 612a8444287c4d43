"""Queries of the page's smaller parts: characters, fonts, rules, cells, headings and gates, over rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.functions import fonts, geometry as G, text as T
from inkwright.operators import boxes as X
from inkwright.operators import characters as H
from inkwright.operators import checks as C
from inkwright.operators import convert as V
from inkwright.operators import maths as M
from inkwright.operators import notes as N
from inkwright.operators import placing as Pl
from inkwright.operators import quality as Q
from inkwright.operators import readings as R
from inkwright.operators import scoring as S
from inkwright.operators import structure as Z
from inkwright.operators import tables as Tb
from inkwright.sources import adapters as A

from ._named import Named
from .boxes import HALVES, K, P, boxes, halves

query = Named()
FACES = ("ABCDEF+CMMI10", "Times-BoldItalic", "Arial,Bold", "Wingdings", "ArialCE-Italic", "STIXMath-Oblique", "Garamond-SC", "Helvetica-Light")


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def picked(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


# ---- boxes --------------------------------------------------------------------------------------------


@query(HALVES + " SELECT a.page, a.box AS a_box, b.box AS b_box, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS x_shared, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS y_shared FROM a JOIN b ON b.page = a.page")
def bbox_axis_overlap(spark, sf_dir):
    met = X.pairs(*halves(spark, sf_dir), K)
    return met.select("page", "a_box", "b_box", G.x_overlap("a_", "b_").alias("x_shared"), G.y_overlap("a_", "b_").alias("y_shared"))


@query(P + """, s AS (SELECT page, box, CASE WHEN box % 2 = 0 THEN x1 ELSE x0 END AS x0, CASE WHEN box % 2 = 0 THEN x0 ELSE x1 END AS x1, CASE WHEN box % 3 = 0 THEN y1 ELSE y0 END AS y0, CASE WHEN box % 3 = 0 THEN y0 ELSE y1 END AS y1 FROM bx)
  SELECT page, box, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1, x1 <= x0 OR y1 <= y0 AS turned FROM s""")
def rect_normalized(spark, sf_dir):
    even, third = F.col("box") % 2 == 0, F.col("box") % 3 == 0
    rows = boxes(spark, sf_dir).select("page", "box", F.when(even, F.col("x1")).otherwise(F.col("x0")).alias("x0"), F.when(third, F.col("y1")).otherwise(F.col("y0")).alias("y0"), F.when(even, F.col("x0")).otherwise(F.col("x1")).alias("x1"), F.when(third, F.col("y0")).otherwise(F.col("y1")).alias("y1"))
    return rows.select("page", "box", *G.normalized(), G.empty().alias("turned"))


@query(P + """, m AS (SELECT page, box, x0, y0, x1, y1, x0 - 2 AS mx0, y0 - 1 AS my0, x0 + box % 9 - 3 AS mx1, y1 - 1 AS my1 FROM bx)
  SELECT page, box, CASE WHEN least(x1, mx1) > greatest(x0, mx0) AND least(y1, my1) > greatest(y0, my0) THEN greatest(x0, mx0) ELSE mx0 END AS x0,
  CASE WHEN least(x1, mx1) > greatest(x0, mx0) AND least(y1, my1) > greatest(y0, my0) THEN least(x1, mx1) ELSE mx1 END AS x1 FROM m""")
def page_box_in_media(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("page", "box", *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("x0") - 2).alias("m_x0"), (F.col("y0") - 1).alias("m_y0"), (F.col("x0") + F.col("box") % 9 - 3).alias("m_x1"), (F.col("y1") - 1).alias("m_y1"))
    x0, _, x1, _ = G.crop_in_media("c_", "m_")
    return rows.select("page", "box", x0, x1)


# ---- characters ---------------------------------------------------------------------------------------

CH = P + """, ch AS (SELECT page, box AS char, x0, y0, x1, y1, CASE WHEN box % 11 = 0 THEN 0.5::DOUBLE ELSE 8.0::DOUBLE END AS size, box % 3 AS color, box % 13 = 0 AS invisible, box % 7 AS paint_order FROM bx),
dr AS (SELECT page, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 1 AS x1, y1 + 1 AS y1, box % 3 AS fill, box % 5 AS paint_order FROM bx WHERE box % 2 = 1)"""
SEEN = CH + """, met AS (SELECT c.page, c.char, bool_or(d.paint_order > c.paint_order) AS over, arg_max(d.fill = c.color, d.paint_order * 10 + (d.fill = c.color)::INT) FILTER (d.paint_order < c.paint_order) AS same
  FROM ch c JOIN dr d ON d.page = c.page AND greatest(0, least(c.x1, d.x1) - greatest(c.x0, d.x0)) * greatest(0, least(c.y1, d.y1) - greatest(c.y0, d.y0)) >= 0.9 * (c.x1 - c.x0) * (c.y1 - c.y0) GROUP BY ALL),
vis AS (SELECT ch.page, ch.char, CASE WHEN size < 1 THEN 'tiny' WHEN x1 <= 5 OR x0 >= 45 OR y1 <= 0 OR y0 >= 100 THEN 'off-page' WHEN invisible THEN 'invisible' WHEN coalesce(over, false) THEN 'covered' WHEN coalesce(same, false) THEN 'same-colour' ELSE '' END AS hidden
  FROM ch LEFT JOIN met USING (page, char))"""


def seen(spark, sf_dir):
    """Boxes as characters, the odd ones painted as fills a little larger; equal paint orders do not occur among fills of one colour and another."""
    b, c = boxes(spark, sf_dir), F.col
    chars = b.select("page", c("box").alias("char"), "x0", "y0", "x1", "y1", F.when(c("box") % 11 == 0, 0.5).otherwise(8.0).alias("size"), (c("box") % 3).alias("color"), (c("box") % 13 == 0).alias("invisible"), (c("box") % 7).alias("paint_order"), F.lit(5.0).alias("page_x0"), F.lit(0.0).alias("page_y0"), F.lit(45.0).alias("page_x1"), F.lit(100.0).alias("page_y1"))
    fills = b.filter("box % 2 = 1").select("page", (c("x0") - 1).alias("x0"), (c("y0") - 1).alias("y0"), (c("x1") + 1).alias("x1"), (c("y1") + 1).alias("y1"), (c("box") % 3).alias("fill"), (c("box") % 5).alias("paint_order"))
    return X.visibility(chars, fills, K)


@query(SEEN + " SELECT CASE hidden WHEN 'same-colour' THEN '' ELSE hidden END AS hidden, count(*) AS n FROM vis GROUP BY 1")
def hidden_characters(spark, sf_dir):
    # of fills painted at one time the last is not settled, so what only they decide is counted with what is seen
    own = seen(spark, sf_dir).withColumn("hidden", F.when(F.col("hidden") == "same-colour", "").otherwise(F.col("hidden")))
    return own.groupBy("hidden").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS line, l_linenumber AS i, chr(CAST(97 + l_partkey % 26 AS INT)) AS ch, ['', 'tiny', 'covered'][l_suppkey % 3 + 1] AS hidden FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
 b AS (SELECT *, CASE WHEN hidden = lag(hidden) OVER w THEN 0 ELSE 1 END AS o FROM c WINDOW w AS (PARTITION BY line ORDER BY i)), r AS (SELECT *, sum(o) OVER (PARTITION BY line ORDER BY i) AS run FROM b)
 SELECT line, hidden AS reason, string_agg(ch, '' ORDER BY i) AS text FROM r WHERE hidden <> '' GROUP BY line, run, hidden""")
def hidden_runs(spark, sf_dir):
    from pyspark.sql import Window as W

    # lines of one order, number and part are taken in the order in which they are stored, so that the choice never hangs on the shuffle
    stored = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    rows = A.read(spark, sf_dir, "lineitem").select("*", *stored).withColumn("_n", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "_file", "_at"))).filter("_n = 1")
    chars = rows.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("at"), F.char(97 + F.col("l_partkey") % 26).alias("ch"), picked(("", "tiny", "covered"), F.col("l_suppkey")).alias("hidden"))
    return X.hidden_runs(chars, ["line"])


WD = """WITH c AS (SELECT p_partkey AS line, generate_subscripts(string_split(p_name, ''), 1) AS i, unnest(string_split(p_name, '')) AS ch, p_size FROM part), g AS (
  SELECT line, i, ch, i * 6.0::DOUBLE + (i + p_size) % 3 * CASE WHEN (i * p_size) % 7 = 0 THEN 1.0 ELSE 0.25 END AS x0 FROM c), k AS (
  SELECT *, x0 + 5.0 AS x1, lag(ch) OVER w AS pc, x0 - lag(x0 + 5.0) OVER w AS gap FROM g WINDOW w AS (PARTITION BY line ORDER BY i)), m AS (
  SELECT *, coalesce(quantile_cont(CASE WHEN regexp_matches(ch, '^[\\p{L}\\p{N}]$') AND regexp_matches(pc, '^[\\p{L}\\p{N}]$') THEN gap END, 0.5) OVER (PARTITION BY line), 0) AS med FROM k), b AS (
  SELECT *, CASE WHEN trim(ch) = '' OR trim(pc) = '' OR (gap > greatest(0.13 * 10, 0.9) AND gap > 1.6 * greatest(med, 0)) OR gap > med + 2.5 THEN 1 ELSE 0 END AS o FROM m), w AS (
  SELECT *, sum(o) OVER (PARTITION BY line ORDER BY i) AS word FROM b)"""


def part_chars(spark, sf_dir):
    """The characters of a part's name, six points apart with a jitter, some of it wide."""
    c = F.col
    each = A.read(spark, sf_dir, "part").select(c("p_partkey").alias("line"), "p_size", F.posexplode(F.filter(F.split("p_name", ""), lambda x: x != "")).alias("i", "ch")).withColumn("at", c("i") + 1)
    x0 = c("at") * 6.0 + (c("at") + c("p_size")) % 3 * F.when((c("at") * c("p_size")) % 7 == 0, 1.0).otherwise(0.25)
    return each.select("line", "at", "ch", F.lit(10.0).alias("size"), x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + 5.0).alias("x1"), F.lit(10.0).alias("y1"))


@query(WD + " SELECT line, string_agg(ch, '' ORDER BY i) AS text, min(x0) AS x0, max(x1) AS x1 FROM w WHERE trim(ch) <> '' GROUP BY line, word")
def words_from_characters(spark, sf_dir):
    return X.words(part_chars(spark, sf_dir), ["line"]).select("line", "text", "x0", "x1")


@query(P + """, c AS (SELECT *, (y0 + y1) / 2 AS cy FROM bx), o AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY page ORDER BY cy, x0) > 4.5 THEN 1 ELSE 0 END AS o FROM c), r AS (SELECT *, sum(o) OVER (PARTITION BY page ORDER BY cy, x0) AS row FROM o),
 s AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, row ORDER BY x0, x1) >= 5 THEN 1 ELSE 0 END AS c FROM r) SELECT page, count(DISTINCT row) AS rows, CAST(sum(c) AS BIGINT) + count(DISTINCT row) AS segments FROM s GROUP BY page""")
def line_segments(spark, sf_dir):
    out = X.lines_of(boxes(spark, sf_dir), K, gap=0.5)
    rows = out.groupBy("page", "row").agg((F.max("segment") + 1).alias("segments"))  # segments of a row are numbered from 0
    return rows.groupBy("page").agg(F.count("*").alias("rows"), F.sum("segments").alias("segments"))


@query(f"""WITH f AS (SELECT p_partkey, {quoted(FACES)}[p_partkey % {len(FACES)} + 1] AS font, p_size % 32 AS flags, p_name AS text FROM part)
  SELECT p_partkey, (flags & 16) > 0 OR regexp_matches(lower(font), '{fonts.BOLD}') AS bold, (flags & 2) > 0 OR regexp_matches(lower(font), '{fonts.ITALIC}') AS italic, (flags & 1) > 0 AS superscript, regexp_matches(upper(font), '{fonts.MATHS}') AS maths,
  CASE WHEN regexp_matches(lower(font), '{fonts.SMALL_CAPS}') THEN upper(text) ELSE text END AS shown FROM f""")
def font_flags(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part").select("p_partkey", picked(FACES, F.col("p_partkey")).alias("font"), (F.col("p_size") % 32).alias("flags"), F.col("p_name").alias("text"))
    font, flags = F.col("font"), F.col("flags")
    return rows.select("p_partkey", fonts.bold(font, flags).alias("bold"), fonts.italic(font, flags).alias("italic"), fonts.superscript(flags).alias("superscript"), fonts.maths(font).alias("maths"), fonts.small_caps(font, F.col("text")).alias("shown"))


@query("""WITH f AS (SELECT p_partkey, ['Wingdings', 'ArialCE', 'Arial'][p_partkey % 3 + 1] AS font, ['ü', 'è', 'n', 'x', 'ð', 'Ý'][p_size % 6 + 1] AS ch, p_size / 100.0::DOUBLE AS ratio FROM part)
  SELECT p_partkey, CASE WHEN font = 'Wingdings' THEN CASE ch WHEN 'ü' THEN '✓' WHEN 'n' THEN '■' ELSE ch END ELSE ch END AS mark, CASE WHEN font = 'ArialCE' THEN translate(ch, 'ÃÈÏÒØÝãèïòøý', 'ĂČĎŇŘÝăčďňřý') ELSE ch END AS letter,
  '\\varepsilon' AS epsilon, CASE WHEN p_partkey % 52 < 26 THEN chr(CAST(65 + p_partkey % 52 AS INT)) ELSE chr(CAST(71 + p_partkey % 52 AS INT)) END AS plain FROM f""")
def repaired_characters(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part").select("p_partkey", picked(("Wingdings", "ArialCE", "Arial"), F.col("p_partkey")).alias("font"), picked(("ü", "è", "n", "x", "ð", "Ý"), F.col("p_size")).alias("ch"), (F.col("p_size") / 100.0).alias("ratio"))
    font, ch = F.col("font"), F.col("ch")
    code = F.lit(0x1D400) + F.col("p_partkey") % 52
    return rows.select("p_partkey", fonts.symbol_mark(font, ch).alias("mark"), fonts.central_european(font, ch).alias("letter"), fonts.epsilon_by_width(font, F.col("ratio")).alias("epsilon"), fonts.math_alphanumeric(code).alias("plain"))


SZ = """WITH c AS (SELECT l_orderkey AS line, 6.0 + l_suppkey % 3 * 0.5::DOUBLE AS size, l_quantity AS y FROM lineitem), n AS (SELECT line, size, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY line) AS total FROM n)"""


def sized(spark, sf_dir):
    return A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), (6.0 + F.col("l_suppkey") % 3 * 0.5).alias("size"), F.col("l_quantity").alias("origin_y"), F.lit("CMR10").alias("font"))


@query(SZ + " SELECT line, CAST(coalesce(max(size) FILTER (n >= 0.3 * total), arg_max(size, n * 100 + size)) AS DOUBLE) AS size FROM t GROUP BY line")
def main_size(spark, sf_dir):
    return Q.main_size(sized(spark, sf_dir), "line")


@query(SZ + ", b AS (SELECT line, y, size, max(size) OVER (PARTITION BY line) AS big FROM c) SELECT line, round(coalesce(avg(y) FILTER (size >= 0.85 * big), avg(y)), 6) AS baseline FROM b GROUP BY line")
def baselines(spark, sf_dir):
    return Q.baselines(sized(spark, sf_dir), "line").withColumn("baseline", F.round("baseline", 6))


# ---- mends of a text layer ----------------------------------------------------------------------------

SPREAD = """WITH c AS (SELECT p_partkey AS line, generate_subscripts(string_split(p_name, ''), 1) AS i, unnest(string_split(p_name, '')) AS ch FROM part WHERE p_partkey % 2 = 0), w AS (SELECT line, i, ch, i * 8.0::DOUBLE AS x0 FROM c WHERE ch <> ' '),
 n AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, CASE WHEN x0 - lag(x0) OVER (PARTITION BY line ORDER BY x0) <= 9.5 THEN 0 ELSE 1 END AS o FROM w), k AS (SELECT *, CASE WHEN n >= 6 THEN sum(o) OVER (PARTITION BY line ORDER BY x0) ELSE i END AS word FROM n)"""


@query(SPREAD + " SELECT line, string_agg(ch, '' ORDER BY x0) AS text, min(x0) AS x0, max(x0) + 5 AS x1 FROM k GROUP BY line, word UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 0, 5 FROM part WHERE p_partkey % 2 = 1")
def spaced_letters(spark, sf_dir):
    """The letters of every other part's name as words of their own, eight points apart; the others' words as they are, at one place."""
    part = A.read(spark, sf_dir, "part")
    letters = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("line"), F.posexplode(F.filter(F.split("p_name", ""), lambda x: x != "")).alias("i", "text")).filter("text <> ' '").select("line", "text", F.lit(8.0).alias("size"), ((F.col("i") + 1) * 8.0).alias("x0"), ((F.col("i") + 1) * 8.0 + 5).alias("x1"))
    words = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("line"), F.explode(F.split("p_name", " ")).alias("text"), F.lit(8.0).alias("size"), F.lit(0.0).alias("x0"), F.lit(5.0).alias("x1"))
    return H.spaced_letters(letters.union(words), ["line"])


@query("""SELECT c_custkey AS page, 0 AS line, CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 1, 1) || substr(c_mktsegment, 2) ELSE substr(c_mktsegment, 2) END AS text, CASE WHEN c_custkey % 3 = 0 THEN 24.0 ELSE 45.0 END AS x0 FROM customer
 UNION ALL SELECT c_custkey, 1, 'second line', 45.0 FROM customer UNION ALL SELECT c_custkey, 2, substr(c_name, 1, 1), CASE WHEN c_custkey % 3 = 1 THEN 24.0 ELSE 0.0 END FROM customer WHERE c_custkey % 3 <> 0""")
def drop_caps(spark, sf_dir):
    """A customer's segment as a first line with its initial beside it: tall; of the line's own size; or too far off."""
    c, third = F.col, F.col("c_custkey") % 3
    row = lambda n, text, size, x0, y0, x1, y1: F.struct(F.lit(n).alias("line"), text.alias("text"), F.lit(1.0).alias("_"), size.alias("size"), x0.alias("x0"), F.lit(y0).alias("y0"), x1.alias("x1"), y1.alias("y1"))
    tall = F.when(third == 1, 10.0).otherwise(41.0)
    at = F.when(third == 2, 0.0).otherwise(24.0)
    lines = F.array(
        row(0, F.expr("substring(c_mktsegment, 2)"), F.lit(10.0), F.lit(45.0), 247.0, F.lit(130.0), F.lit(257.0)), row(1, F.lit("second line"), F.lit(10.0), F.lit(45.0), 258.0, F.lit(130.0), F.lit(268.0)),
        row(2, F.substring("c_name", 1, 1), tall, at, 241.0, at + 20.5, F.lit(241.0) + tall),
    )
    rows = A.read(spark, sf_dir, "customer").select(c("c_custkey").alias("page"), F.explode(lines).alias("r")).select("page", "r.line", "r.text", "r.size", "r.x0", "r.y0", "r.x1", "r.y1")
    return H.drop_caps(rows, ["page"]).select("page", "line", "text", "x0")


@query("""WITH s AS (SELECT p_partkey AS page, p_name || CASE WHEN p_partkey % 4 = 0 THEN 'office' WHEN p_partkey % 4 = 1 THEN 'waffle' WHEN p_partkey % 4 = 2 THEN 'plain' ELSE 'abc' END || ' a long run of letters' AS t FROM part) SELECT page, CASE WHEN page % 4 = 3 THEN replace(t, 'abc', 'ab') || chr(12) ELSE t END AS text FROM s""")
def tex_letters(spark, sf_dir):
    """A part's name and a word whose ligature is a raw code; every fourth has a code beside no letter, which stays."""
    at = F.col("p_partkey") % 4
    end = F.when(at == 0, "o\x0ece").when(at == 1, "wa\x0ble").when(at == 2, "plain").otherwise("ab")
    text = F.concat("p_name", end, F.lit(" a long run of letters"), F.when(at == 3, " \x0c").otherwise(""))
    each = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.posexplode(F.filter(F.split(text, ""), lambda x: x != "")).alias("at", "ch"), F.lit("CMR10").alias("font")).withColumns({"x0": F.col("at") * 5.0, "x1": F.col("at") * 5.0 + 5.0})
    out = H.tex_letters(each, ["page"], ["page"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "ch"))), lambda s: s["ch"]), "")
    return out.groupBy("page").agg(joined.alias("text")).withColumn("text", F.regexp_replace("text", " \x0c$", "\x0c"))


@query("""SELECT p_partkey AS line, CASE p_partkey % 4 WHEN 0 THEN 'Ramón' WHEN 1 THEN 'Hölder' WHEN 2 THEN 'x´ y' ELSE 'q¨' END AS text FROM part""")
def composed_accents(spark, sf_dir):
    """Words with an accent of its own: over the letter before it, over the one behind it, over none, and over one that has no such form."""
    at = F.col("p_partkey") % 4
    one = lambda ch, x: F.struct(F.lit(ch).alias("ch"), F.lit(float(x)).alias("x0"))
    word = F.when(at == 0, F.array(one("R", 0), one("a", 5), one("m", 10), one("o", 15), one("´", 15), one("n", 20))).when(at == 1, F.array(one("H", 0), one("¨", 5), one("o", 5), one("l", 10), one("d", 15), one("e", 20), one("r", 25))).when(at == 2, F.array(one("x", 0), one("´", 9), one(" ", 12), one("y", 20))).otherwise(F.array(one("q", 0), one("¨", 0)))
    each = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.posexplode(word).alias("at", "c")).select("line", "at", "c.ch", F.lit("Times").alias("font"), F.lit(10.0).alias("size"), "c.x0", (F.col("c.x0") + 5).alias("x1"))
    out = H.composed_accents(each, ["line"])
    return out.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda s: s["ch"]), "").alias("text"))


@query(P + """, l AS (SELECT page, box AS line, box % 9 AS n, 4.0 + box % 4 * 3.0 AS size, (y0 + y1) / 2 AS base, x0, y0, x1, y1 FROM bx), met AS (SELECT a.page, a.line AS satellite, b.line AS host, abs(a.base - b.base) AS d FROM l a JOIN l b ON b.page = a.page AND b.line <> a.line AND b.n >= 2 AND a.n <= 6 AND a.size < 0.85 * b.size AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.base BETWEEN b.y0 AND b.y1)
 SELECT page, satellite, host FROM met QUALIFY row_number() OVER (PARTITION BY page, satellite ORDER BY d, host) = 1""")
def satellites(spark, sf_dir):
    c = F.col
    lines = boxes(spark, sf_dir).select("page", c("box").alias("line"), (c("box") % 9).alias("n_words"), (4.0 + c("box") % 4 * 3.0).alias("size"), ((c("y0") + c("y1")) / 2).alias("baseline"), "x0", "y0", "x1", "y1")
    return H.satellites(lines, K)


@query("""SELECT o_orderkey, o_custkey % 9000 AS value, round(100.0 * (5 + length(CAST(o_custkey % 9000 AS VARCHAR)) / 2.0::DOUBLE) / (29 + length(CAST(o_custkey % 9000 AS VARCHAR))), 6) AS x FROM orders""")
def standing_numbers(spark, sf_dir):
    text = F.concat(F.lit("Page "), (F.col("o_custkey") % 9000).cast("string"), F.lit(" | v2.1 a-7 12% 3,4 $5 ."))
    rows = A.read(spark, sf_dir, "orders").select("o_orderkey", text.alias("line"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"))
    return H.standing_numbers(rows).select("o_orderkey", "value", F.round("x", 6).alias("x"))


@query(P + """, s AS (SELECT page, box % 3 AS col, x0, x1, lag(x1) OVER w AS px, lag(box % 3) OVER w AS pc FROM bx WINDOW w AS (PARTITION BY page ORDER BY x0, x1, box % 3)) SELECT page, coalesce(bool_or(col <> pc AND x0 - px < 6), false) AS across, coalesce(max(x0 - px) >= 8, false) AS multicell FROM s GROUP BY page""")
def row_tests(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", (F.col("box") % 3).alias("col"), "x0", "x1")
    return H.across_columns(b, K).join(H.multicell(b, K), K)


@query(A.SQL + r""" SELECT file, page, count(*) < 3 OR count(*) FILTER (regexp_matches(trim(line), '^\p{Lu}')) <= 0.3 * count(*) AS runs_on FROM ln GROUP BY file, page""")
def paragraph_or_cells(spark, sf_dir):
    lines = A.lines(A.pages(A.read(spark, sf_dir, "documents"))).select("file", "page", F.col("line").alias("text"))
    return H.runs_on(lines, ["file", "page"])


@query(HALVES + """ SELECT a.page, a.box, arg_max(b.box, (greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), -1), -b.box)) AS col FROM a JOIN b ON b.page = a.page GROUP BY ALL""")
def column_of_box(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    return H.column_of(even, odd.select("page", F.col("box").alias("col"), F.col("x0").alias("low"), F.col("x1").alias("high")), K, "box")


@query(HALVES + """, m AS (SELECT a.page, a.box AS figure, a.x1 - a.x0 AS w, a.y1 - a.y0 AS h, a.x0, a.y0, a.x1, a.y1, (a.x0 + a.x1) / 2 AS cx, (a.y0 + a.y1) / 2 AS cy FROM a WHERE a.x1 - a.x0 BETWEEN 3 AND 30 AND a.y1 - a.y0 BETWEEN 3 AND 30 AND (a.x1 - a.x0) / (a.y1 - a.y0) BETWEEN 0.4 AND 2.5),
 t AS (SELECT * FROM b WHERE box % 4 = 1), l AS (SELECT * FROM b WHERE box % 4 = 3), k AS (SELECT m.page, m.figure, 0 AS r FROM m JOIN t ON t.page = m.page AND m.cx BETWEEN t.x0 AND t.x1 AND m.cy BETWEEN t.y0 AND t.y1
 UNION ALL SELECT m.page, m.figure, 1 FROM m JOIN l ON l.page = m.page AND l.y1 >= m.y0 AND l.y0 <= m.y1 AND abs((l.y0 + l.y1) / 2 - m.cy) <= 0.7 * greatest(l.y1 - l.y0, m.y1 - m.y0) AND (l.x0 - m.x1 BETWEEN -1 AND 30 OR (m.cx BETWEEN l.x0 AND l.x1 AND m.cy BETWEEN l.y0 AND l.y1)))
 SELECT page, figure, CASE min(r) WHEN 0 THEN 'in a table' ELSE 'at the head of a line' END AS place FROM k GROUP BY page, figure""")
def icons(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    figures = even.filter(H.mark_sized(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(612.0), F.lit(792.0))).withColumnRenamed("box", "figure")
    return H.icons(figures, odd.filter("box % 4 = 1"), odd.filter("box % 4 = 3"), K)


TOUCH = P + """, u AS (SELECT page, box, floor(x0 / 8) * 8.0 AS x0, y0, floor(x0 / 8) * 8.0 + 8 AS x1, y0 + 4 AS y1 FROM bx), pr AS (SELECT a.page, a.box AS a, b.box AS b FROM u a JOIN u b ON b.page = a.page AND a.box < b.box AND (((abs(a.x1 - b.x0) <= 1 OR abs(b.x1 - a.x0) <= 1) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * 4) OR ((abs(a.y1 - b.y0) <= 1 OR abs(b.y1 - a.y0) <= 1) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * 8)))"""


def tiles(spark, sf_dir):
    """Boxes laid on a grid of eight by four points, so that neighbours touch."""
    left = F.floor(F.col("x0") / 8) * 8.0
    return boxes(spark, sf_dir).select("page", F.col("box").alias("fill"), left.alias("x0"), "y0", (left + 8).alias("x1"), (F.col("y0") + 4).alias("y1"))


@query(TOUCH + " SELECT page, a, b FROM pr")
def touching_fills(spark, sf_dir):
    return H.touching(tiles(spark, sf_dir), K)


@query(TOUCH.replace("WITH bx", "WITH RECURSIVE bx") + """, e AS (SELECT page, a, b FROM pr UNION SELECT page, b, a FROM pr), r(page, fill, grp) AS (SELECT page, box, box FROM u UNION SELECT r.page, e.b, r.grp FROM r JOIN e ON e.page = r.page AND e.a = r.fill) SELECT page, fill, min(grp) AS grp FROM r GROUP BY page, fill""")
def fill_groups(spark, sf_dir):
    return H.fill_groups(tiles(spark, sf_dir), K)


@query(HALVES + """, f AS (SELECT page, box AS fragment, 8.0 + box % 3 AS size, x0, x1, y1 AS base FROM a), k AS (SELECT page, box AS block, box % 4 AS n, x1 + 10 AS edge, 8.0 + box % 5 AS size, CASE WHEN box % 6 = 1 THEN 'ends.' ELSE 'goes on' END AS t, y1 AS base, x1 AS e FROM b),
 met AS (SELECT f.page, f.fragment, k.block, f.x0, k.e FROM f JOIN k ON k.page = f.page AND abs(k.base - f.base) <= 0.3 * f.size AND (f.x0 - k.e BETWEEN 0 AND 1.5 * f.size OR (k.n >= 2 AND f.x1 <= k.edge + f.size AND f.x0 - k.e BETWEEN 0 AND 6 * f.size)) AND k.t = 'goes on' AND abs(k.size - f.size) <= 0.15 * f.size)
 SELECT page, fragment, min(block) AS block FROM met WHERE NOT (30 < x0 AND 31 > e) GROUP BY page, fragment""")
def fragment_hosts(spark, sf_dir):
    c = F.col
    even, odd = halves(spark, sf_dir)
    loose = even.select("page", c("box").alias("fragment"), (8.0 + c("box") % 3).alias("size"), F.lit("times").alias("family"), c("y1").alias("baseline"), "x0", "x1")
    blocks = odd.select("page", c("box").alias("block"), (c("box") % 4).alias("n_lines"), (c("x1") + 10).alias("right"), F.when(c("box") % 6 == 1, "ends.").otherwise("goes on").alias("text"), (8.0 + c("box") % 5).alias("size"), F.lit("times").alias("family"), c("y1").alias("baseline"), c("x1").alias("end"))
    return H.fragment_hosts(loose, blocks, even.select("page").distinct().select("page", F.lit(30.0).alias("g0"), F.lit(31.0).alias("g1")), K)


@query(r"SELECT page_id, regexp_matches(regexp_replace(html, '<[^>]*>', '', 'g'), '[\p{L}\p{N}]') AS said FROM pages")
def cells_with_text(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", H.has_text(F.regexp_replace("html", "<[^>]*>", "")).alias("said"))


# ---- tables -------------------------------------------------------------------------------------------

CELLS = """WITH ce AS (SELECT p_partkey // 10 AS tab, CAST(p_partkey % 10 AS INT) AS row, CAST(p_size % 3 AS INT) AS col, p_name AS text, p_partkey % 10 * 10.0::DOUBLE AS y0, (p_partkey % 10 + 1 + p_size % 2) * 10.0::DOUBLE AS y1, p_size % 3 * 50.0::DOUBLE AS x0, (p_size % 3 + 1 + p_size % 4 // 2) * 50.0::DOUBLE AS x1 FROM part)"""


def drawn(spark, sf_dir):
    """Ten parts as a table of three columns, some cells wider or higher than their place."""
    k, s = F.col("p_partkey"), F.col("p_size")
    tens = F.floor(k / 10)
    return A.read(spark, sf_dir, "part").select(
        tens.alias("tab"), (k % 10).cast("int").alias("row"), (s % 3).cast("int").alias("col"), F.col("p_name").alias("text"), (k % 10 * 10.0).alias("y0"), ((k % 10 + 1 + s % 2) * 10.0).alias("y1"), (s % 3 * 50.0).alias("x0"), ((s % 3 + 1 + F.floor(s % 4 / 2)) * 50.0).alias("x1"),
    )


@query(CELLS + """, l AS (SELECT tab, col, min(x0) AS l, max(x1) AS r FROM ce GROUP BY ALL), m AS (SELECT tab, col AS c, (l + coalesce(lead(l) OVER (PARTITION BY tab ORDER BY col), max(r) OVER (PARTITION BY tab))) / 2 AS mid FROM l),
 met AS (SELECT ce.tab, ce.row, ce.col, m.c FROM ce JOIN m ON m.tab = ce.tab AND m.c > ce.col AND m.mid > ce.x0 AND m.mid < ce.x1 WHERE NOT EXISTS (SELECT 1 FROM ce o WHERE o.tab = ce.tab AND o.row = ce.row AND o.col = m.c)),
 k AS (SELECT *, c - row_number() OVER (PARTITION BY tab, row, col ORDER BY c) AS k FROM met) SELECT tab, row, col, count(*) + 1 AS colspan FROM k WHERE k = col GROUP BY tab, row, col""")
def drawn_column_spans(spark, sf_dir):
    return Tb.column_spans(drawn(spark, sf_dir), ["tab"])


@query(CELLS + """, r AS (SELECT tab, row AS r, (min(y0) + min(y1)) / 2 AS mid FROM ce GROUP BY ALL) SELECT ce.tab, ce.row, ce.col, count(*) + 1 AS rowspan FROM ce JOIN r ON r.tab = ce.tab AND r.r > ce.row AND r.mid < ce.y1 GROUP BY ALL""")
def drawn_row_spans(spark, sf_dir):
    return Tb.row_spans(drawn(spark, sf_dir), ["tab"])


WORDS_IN = P + """, w AS (SELECT page, box, box % 4 AS text_cell, CAST(box AS VARCHAR) AS text, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM bx WHERE box % 2 = 0), c AS (SELECT page, box AS cell, x0, y0 - 4 AS y0, x1, y1 + 4 AS y1 FROM bx WHERE box % 2 = 1),
 met AS (SELECT w.*, c.cell FROM w JOIN c ON c.page = w.page AND w.x BETWEEN c.x0 AND c.x1 AND w.y BETWEEN c.y0 AND c.y1)"""


def words_and_cells(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    words = even.select("page", (F.col("box") % 4).alias("text_cell"), F.col("box").cast("string").alias("text"), "x0", "y0", "x1", "y1")
    return words, odd.select("page", F.col("box").alias("cell"), "x0", (F.col("y0") - 4).alias("y0"), "x1", (F.col("y1") + 4).alias("y1"))


@query(WORDS_IN + " SELECT page, text_cell, count(DISTINCT cell) - 1 AS crossings FROM met GROUP BY ALL HAVING count(DISTINCT cell) > 1")
def cell_crossings(spark, sf_dir):
    return Tb.crossings(*words_and_cells(spark, sf_dir), K)


@query(WORDS_IN + " SELECT page, cell, string_agg(text, ' ' ORDER BY floor(y + 0.5), x, text) AS text FROM met GROUP BY ALL")
def placed_words(spark, sf_dir):
    return Tb.placed(*words_and_cells(spark, sf_dir), K)


@query(P + """, d AS (SELECT page, box, x0, y0, x1, y1, box % 2 = 0 AS stroked, x1 - x0 AS w, y1 - y0 AS h FROM bx), k AS (SELECT *, CASE WHEN h <= 3 AND w >= 2 THEN 'h' WHEN w <= 3 AND h >= 2 THEN 'v' WHEN stroked THEN 'b' END AS k FROM d)
 SELECT page, box, 'h' AS orient, (y0 + y1) / 2 AS "at", x0 AS low, x1 AS high FROM k WHERE k = 'h' UNION ALL SELECT page, box, 'v', (x0 + x1) / 2, y0, y1 FROM k WHERE k = 'v' UNION ALL SELECT page, box, 'h', unnest([y0, y1]), x0, x1 FROM k WHERE k = 'b' UNION ALL SELECT page, box, 'v', unnest([x0, x1]), y0, y1 FROM k WHERE k = 'b'""")
def rule_edges(spark, sf_dir):
    return Tb.edges(boxes(spark, sf_dir).withColumn("stroked", F.col("box") % 2 == 0)).select("page", "box", "orient", "at", "low", "high")


@query(P + """ SELECT page, box, 'h' AS orient, unnest([y0, y1]) AS "at", x0 AS low, x1 AS high FROM bx UNION ALL SELECT page, box, 'v', unnest([x0, x1]), y0, y1 FROM bx""")
def fill_rules(spark, sf_dir):
    return Tb.fills_to_rules(boxes(spark, sf_dir)).select("page", "box", "orient", "at", "low", "high")


@query(P + """, r AS (SELECT page, CAST(y0 AS BIGINT) AS row, count(*) AS n FROM bx GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, row) AS i, count(*) OVER (PARTITION BY page) AS c FROM r),
 t AS (SELECT *, quantile_cont(CASE WHEN i <= greatest(3, c // 3) THEN n END, 0.5) OVER (PARTITION BY page) AS t FROM k) SELECT page, row, n FROM t WHERE n >= greatest(2, floor(0.8 * t))""")
def structural_rows(spark, sf_dir):
    rows = boxes(spark, sf_dir).groupBy("page", F.col("y0").cast("long").alias("row")).agg(F.count("*").alias("n"))
    return Tb.structural_rows(rows, K)


@query("""WITH c AS (SELECT p_partkey // 10 AS tab, p_partkey % 10 AS row, CASE WHEN p_partkey % 31 = 0 THEN 'plain' ELSE chr(CAST(97 + p_partkey % 10 AS INT)) || '.' END AS l, p_name AS r FROM part),
 a AS (SELECT tab, count(*) AS n, count(*) FILTER (l = 'plain') AS p, count(*) FILTER (len(string_split(trim(r), ' ')) <= 3) AS s FROM c GROUP BY tab) SELECT tab FROM a WHERE n >= 3 AND p = 0 AND s >= 0.8 * n""")
def key_tables(spark, sf_dir):
    k = F.col("p_partkey")
    rows = A.read(spark, sf_dir, "part").select(F.floor(k / 10).alias("tab"), (k % 10).alias("row"), F.when(k % 31 == 0, "plain").otherwise(F.concat(F.char(97 + k % 10), F.lit("."))).alias("l"), F.col("p_name").alias("r"))
    cells = rows.select("tab", "row", F.posexplode(F.array("l", "r")).alias("col", "text"))
    return Tb.key_table(cells, ["tab"])


@query("""WITH c AS (SELECT c_custkey, CAST(1 + c_custkey % 3 AS INT) AS n, c_name AS l, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer) SELECT c_custkey, i AS part, l || ' ' || CASE WHEN i = 0 THEN 'A' WHEN i = 1 THEN 'B' ELSE 'C' END AS label, CAST(v + i AS VARCHAR) AS amount FROM (SELECT *, unnest(range(n)) AS i FROM c)""")
def rows_of_tall_cells(spark, sf_dir):
    letter = lambda i: F.when(i == 0, "A").when(i == 1, "B").otherwise("C")
    lines = F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))
    balance = F.floor("c_acctbal").cast("long")
    cells = F.array(F.array_join(F.transform(lines, lambda i: F.concat("c_name", F.lit(" "), letter(i))), "\n"), F.array_join(F.transform(lines, lambda i: (balance + i).cast("string")), "\n"))
    return Tb.split_rows(A.read(spark, sf_dir, "customer").select("c_custkey", cells.alias("cells"))).select("c_custkey", "part", F.get("cells", 0).alias("label"), F.get("cells", 1).alias("amount"))


@query(r"""SELECT p_partkey, '<p>' || p_name || '</p>' || chr(10) || '<ul>' || chr(10) || '<li>' || p_type || '</li>' || chr(10) || '<li>' || p_brand || '</li>' || chr(10) || '</ul>' AS html, p_name || ' ' || p_type || ' ' || p_brand AS flat FROM part""")
def listing_cells(spark, sf_dir):
    empty = F.array().cast("array<string>")
    items = F.array(*[F.struct(F.col(c).alias("text"), empty.alias("children"), F.lit("").alias("tail")) for c in ("p_type", "p_brand")])
    return A.read(spark, sf_dir, "part").select("p_partkey", Tb.listing_html(F.col("p_name"), items, F.lit("")).alias("html"), Tb.flat_listing(F.col("p_name"), items, F.lit("")).alias("flat"))


@query(HALVES + """, h AS (SELECT b.page, b.box, a.box AS row FROM a JOIN b ON b.page = a.page AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 5 AND b.y1 + 5), f AS (SELECT page, box, min(row) AS to_row FROM h GROUP BY page, box HAVING count(DISTINCT row) > 1)
 SELECT h.page, h.row, min(f.to_row) AS to_row FROM h JOIN f ON f.page = h.page AND f.box = h.box GROUP BY h.page, h.row""")
def boxed_rows(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    return Pl.boxed_rows(even.withColumnRenamed("box", "row"), odd.withColumns({"y0": F.col("y0") - 5, "y1": F.col("y1") + 5}), K)


@query(HALVES + """, m AS (SELECT a.page, a.box % 3 AS cell, a.box AS line, a.y0, arg_max(b.box, (least(a.y1, b.y1) - greatest(a.y0, b.y0), -b.box)) AS row FROM a JOIN b ON b.page = a.page AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY ALL)
 SELECT page, cell, row, string_agg(CAST(line AS VARCHAR), ' ' ORDER BY y0, line) AS text FROM m GROUP BY ALL""")
def dealt_lines(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    lines = even.select("page", (F.col("box") % 3).alias("cell"), F.col("box").alias("line"), F.col("box").cast("string").alias("text"), "y0", "y1")
    return Pl.dealt_lines(lines, odd.select("page", F.col("box").alias("row"), F.col("y0").alias("top"), F.col("y1").alias("foot")), K)


@query(HALVES + """, n AS (SELECT a.page, b.box // 4 AS tab, b.box AS col, a.y0, a.x0, a.box AS word FROM a JOIN b ON b.page = a.page AND b.y0 - a.y1 BETWEEN -3 AND 15 AND (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1), f AS (SELECT page, tab, col, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY y0, x0, word) AS text FROM n GROUP BY ALL)
 SELECT * FROM f WHERE (page, tab) IN (SELECT (page, tab) FROM f GROUP BY page, tab HAVING count(*) > 1)""".replace("b.box // 4 AS tab", "b.box % 2 AS tab"))
def headings_above(spark, sf_dir):
    even, odd = halves(spark, sf_dir)
    words = even.select("page", F.col("box").alias("word"), F.col("box").cast("string").alias("text"), "x0", "y0", "x1", "y1")
    columns = odd.select("page", (F.col("box") % 2).alias("tab"), F.col("box").alias("col"), F.col("x0").alias("low"), F.col("x1").alias("high"), F.col("y0").alias("top"))
    return Pl.headings_above(words, columns, K)


@query(r"SELECT conv_id, turn, regexp_replace(text, '[aeiou]+', '##', 'g') AS text, length(text) + 1 AS places, length(regexp_replace(text, '[aeiou]+', '##', 'g')) AS last FROM conversations WHERE text IS NOT NULL")
def rewritten_places(spark, sf_dir):
    rows = A.read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    out = rows.select("conv_id", "turn", Pl.rewritten(F.col("text"), "[aeiou]+", "##").alias("r"))
    return out.select("conv_id", "turn", "r.text", F.size("r.at").alias("places"), F.element_at("r.at", -1).alias("last"))


# ---- gates and fates ----------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, ['suspect', 'none', 'digital'][o_custkey % 3 + 1] AS k, ['digital', 'ocr', 'none'][o_orderkey % 3 + 1] AS s, o_custkey % 4 AS lines, o_orderkey % 2 AS images, CASE WHEN o_custkey % 5 < 4 THEN o_custkey % 5 * 20 END AS unseen, CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey % 2 END AS curves FROM orders)
  SELECT o_orderkey, CASE WHEN k = 'suspect' THEN CASE WHEN s IN ('digital', 'ocr') AND lines > 0 THEN 'read' ELSE 'lost' END WHEN k <> 'none' OR images > 0 THEN 'lost' WHEN unseen IS NULL THEN CASE WHEN curves = 0 THEN 'blank' ELSE 'lost' END WHEN unseen < {least} THEN 'blank' ELSE 'lost' END AS fate FROM o""".replace("{least}", str(Q.READABLE)))
def page_fates(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fate = Q.fate(picked(("suspect", "none", "digital"), c), picked(("digital", "ocr", "none"), k), c % 4, k % 2, F.when(c % 5 < 4, c % 5 * 20), F.when(k % 7 > 1, k % 2))
    return A.read(spark, sf_dir, "orders").select("o_orderkey", fate.alias("fate"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 60 AS down, o_orderkey % 60 AS up, o_custkey % 100 + 30 AS total FROM orders) SELECT o_orderkey, CASE WHEN down + up < 40 OR down + up < 0.6 * greatest(1, total) THEN 0 WHEN down >= up THEN 270 ELSE 90 END AS turn FROM o""")
def sideways_turns(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return A.read(spark, sf_dir, "orders").select("o_orderkey", Q.sideways_turn(c % 60, k % 60, c % 100 + 30).alias("turn"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS conf, l_discount * 10 AS w, l_tax * 10 AS n, l_suppkey % 10 / 10.0::DOUBLE AS g, l_partkey % 40 AS lines FROM lineitem),
  r AS (SELECT *, (conf >= 0.8 AND (n >= 0.3 OR g >= 0.7)) OR (n >= 0.5 AND lines >= 20) AS rescued FROM o) SELECT l_orderkey, l_linenumber, l_partkey, rescued, conf >= 0.75 AND (w >= 0.5 OR rescued) AS accepted FROM r""")
def ocr_gate(spark, sf_dir):
    c = F.col
    rows = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_quantity") / 50).alias("conf"), (c("l_discount") * 10).alias("wordlike_share"), (c("l_tax") * 10).alias("numeric_share"), (c("l_suppkey") % 10 / 10.0).alias("language_share"), (c("l_partkey") % 40).alias("n_lines"))
    return Q.ocr_gate(rows).select("l_orderkey", "l_linenumber", "l_partkey", "rescued", "accepted")


@query("""SELECT o_orderkey FROM orders WHERE CASE o_custkey % 3 WHEN 1 THEN false WHEN 2 THEN true END IS FALSE AND CASE o_orderkey % 3 WHEN 1 THEN false WHEN 2 THEN true END IS FALSE""")
def released_numbers(spark, sf_dir):
    flag = lambda c: F.when(F.col(c) % 3 == 1, False).when(F.col(c) % 3 == 2, True)
    return N.released(A.read(spark, sf_dir, "orders").select("o_orderkey", flag("o_custkey").alias("counts"), flag("o_orderkey").alias("runs"))).select("o_orderkey")


# ---- headings -----------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_custkey AS page, o_orderkey AS block, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 900 AS VARCHAR) ELSE 'text' END AS text, o_custkey % 2 * 1.0 + 20 AS x0, o_orderkey % 700 * 1.0::DOUBLE AS y0 FROM orders), i AS (SELECT *, CAST(text AS INT) AS v FROM b WHERE text <> 'text'),
 u AS (SELECT *, CASE WHEN v > lag(v) OVER (PARTITION BY page ORDER BY y0, block) THEN 1 ELSE 0 END AS up FROM i), g AS (SELECT page FROM u GROUP BY page HAVING count(*) >= 4 AND max(y0 + 8) - min(y0) >= 0.25 * 800 AND sum(up) >= 0.7 * (count(*) - 1)) SELECT page, block FROM i WHERE page IN (SELECT page FROM g)""")
def margin_numbers(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = A.read(spark, sf_dir, "orders").select(c.alias("page"), k.alias("block"), F.when(k % 4 < 3, (k % 900).cast("string")).otherwise("text").alias("text"), (c % 2 * 1.0 + 20).alias("x0"), (k % 700 * 1.0).alias("y0"), (c % 2 * 1.0 + 30).alias("x1"), (k % 700 * 1.0 + 8).alias("y1"), F.lit(800.0).alias("page_height"))
    return Z.margin_numbers(rows, ["page"])


HEADS = """WITH h AS (SELECT l_orderkey AS page, l_linenumber * 100000 + l_partkey AS block, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) || '.' ELSE 'Title ' || l_partkey END AS text, l_quantity AS x0, l_quantity + 5 AS x1, l_suppkey % 4 * 2.0::DOUBLE AS y1 FROM lineitem)"""


def heads(spark, sf_dir):
    c = F.col
    text = F.when(c("l_partkey") % 2 == 0, F.concat(c("l_linenumber").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("Title "), c("l_partkey").cast("string")))
    return A.read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), (c("l_linenumber") * 100000 + c("l_partkey")).alias("block"), text.alias("text"), c("l_quantity").alias("x0"), (c("l_quantity") + 5).alias("x1"), (c("l_suppkey") % 4 * 2.0).alias("y1"), (c("l_suppkey") % 4 * 2.0 - 8).alias("y0"))


@query(HEADS + """, n AS (SELECT a.page, a.block AS label, b.block AS title, b.x0 - a.x1 AS g FROM h a JOIN h b ON b.page = a.page WHERE a.text LIKE '%.' AND b.text NOT LIKE '%.' AND abs(a.y1 - b.y1) <= 3 AND b.x0 - a.x1 BETWEEN 0 AND 60)
 SELECT page, label, title FROM n QUALIFY row_number() OVER (PARTITION BY page, label ORDER BY g, title) = 1""")
def label_headings(spark, sf_dir):
    return Z.label_headings(heads(spark, sf_dir), ["page"])


@query("""WITH h AS (SELECT l_orderkey AS page, l_linenumber AS o, 1 + l_suppkey % 2 AS level, 'Title ' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN '.' ELSE '' END AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
 b AS (SELECT *, CASE WHEN o = lag(o) OVER w + 1 AND level = lag(level) OVER w AND lag(text) OVER w NOT LIKE '%.' THEN 0 ELSE 1 END AS n FROM h WINDOW w AS (PARTITION BY page ORDER BY o)), r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY o) AS run FROM b),
 p AS (SELECT *, (row_number() OVER (PARTITION BY page, run ORDER BY o) - 1) // 4 AS part FROM r) SELECT page, min(o) AS head, string_agg(text, ' ' ORDER BY o) AS text FROM p GROUP BY page, run, part""")
def wrapped_headings(spark, sf_dir):
    from pyspark.sql import Window as W

    c = F.col
    # lines of one order, number and part are taken in the order in which they are stored, so that the choice never hangs on the shuffle
    stored = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    rows = A.read(spark, sf_dir, "lineitem").select("*", *stored).withColumn("_n", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "_file", "_at"))).filter("_n = 1")
    text = F.concat(F.lit("Title "), c("l_partkey").cast("string"), F.when(c("l_partkey") % 5 == 0, ".").otherwise(""))
    own = rows.select(c("l_orderkey").alias("page"), c("l_linenumber").alias("order"), (1 + c("l_suppkey") % 2).alias("level"), text.alias("text"), F.lit(12.0).alias("size"), (c("l_linenumber") * 12.0).alias("y0"), (c("l_linenumber") * 12.0 + 10).alias("y1"))
    return Z.wrapped_headings(own, ["page"])


# ---- readings, reports, selections ---------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, lower(array_to_string(regexp_extract_all(string_split(text, chr(10))[1], '[\\p{L}\\p{N}]+'), ' ')) AS x, lower(array_to_string(regexp_extract_all(string_split(text, chr(10))[-1], '[\\p{L}\\p{N}]+'), ' ')) AS y FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, x = y OR (x <> '' AND y <> '' AND least(length(x), length(y)) >= 12 AND least(length(x), length(y)) >= 0.6 * greatest(length(x), length(y)) AND (contains(x, y) OR contains(y, x))) AS same FROM a""")
def same_lines(spark, sf_dir):
    lines = F.split("text", "\n")
    rows = A.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.line_key(F.get(lines, 0)).alias("x"), T.line_key(F.element_at(lines, -1)).alias("y"))
    return rows.select("doc_id", T.same_line(F.col("x"), F.col("y")).alias("same"))


@query("""SELECT 'run ' || o_custkey AS run, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed FROM orders GROUP BY o_custkey""")
def report_parsed(spark, sf_dir):
    """A run's printed report of one section, written and read again."""
    runs = A.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    report = F.format_string("  section%d : %.1f%% (%d/%d tests)\nAverage Score: %.1f%%\n", F.col("o_custkey"), F.col("p") * 100.0 / F.col("n"), F.col("p"), F.col("n"), F.col("p") * 100.0 / F.col("n"))
    read = runs.select(S.parse_report(report).alias("r")).select(F.explode("r.parts").alias("s"))
    return read.select(F.regexp_replace("s.name", "section", "run ").alias("run"), F.col("s.total").alias("total"), F.col("s.passed").alias("passed"))


@query(A.SQL + " SELECT file, page, doc_id FROM pg WHERE page IN (1, 3, 4, 5)")
def selected_pages(spark, sf_dir):
    return V.selected(A.pages(A.read(spark, sf_dir, "documents")), "1,3-5").select("file", "page", "doc_id")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN event_type || ' and more words here' END AS text, event_type AS description FROM events""")
def picture_answers(spark, sf_dir):
    said = F.concat(F.lit("!["), "event_type", F.lit("](x.png)\n"), F.when(F.col("event_type") == "click", F.concat("event_type", F.lit(" and more words here"))).otherwise("few"))
    return A.read(spark, sf_dir, "events").select("event_id", R.picture_answer(said).alias("a")).select("event_id", "a.text", "a.description")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type WHEN 2 THEN 'a plain ' || event_type || ' drawn' ELSE event_type || ' is drawn. It is small.' END AS said FROM events""")
def cleaned_answers(spark, sf_dir):
    at, kind = F.col("event_id") % 4, F.col("event_type")
    text = F.when(at == 0, F.concat(F.lit("Decorative "), kind)).when(at == 1, F.concat(F.lit("This icon means "), kind, F.lit("."))).when(at == 2, F.concat(F.lit("a plain "), kind, F.lit(" drawn"))).otherwise(F.concat(kind, F.lit(" is drawn.\nIt is small.\n\nMore.")))
    return A.read(spark, sf_dir, "events").select("event_id", R.clean_answer(text, F.when(at == 1, "icon").when(at == 2, "picture-text").otherwise("figure")).alias("said"))


@query("""SELECT event_id, 'value: ' || event_type AS text, CAST(event_id AS VARCHAR) AS page FROM events""")
def responses(spark, sf_dir):
    reply = F.concat(F.lit("---\npage: "), F.col("event_id").cast("string"), F.lit("\nlang: en\n---\nvalue: "), "event_type")
    return A.read(spark, sf_dir, "events").select("event_id", R.response(reply).alias("r")).select("event_id", "r.text", F.col("r.meta")["page"].alias("page"))


@query(r"""WITH c AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part) SELECT p_partkey, '.... ' || a || ' ....' AS given, a AS clean,
 regexp_matches(lower(b), '^\p{Ll}') AS goes_on, CASE WHEN p_partkey % 3 = 0 THEN 'tick' WHEN p_partkey % 3 = 1 THEN 'cross' ELSE '' END AS mark, p_partkey % 2 = 0 AS statistic FROM c""")
def cell_texts(spark, sf_dir):
    given = F.concat(F.lit(".... "), "p_name", F.lit(" ...."))
    mark = T.mark_of(F.concat(picked(("• <b>✓</b> ", "✗ ", ""), F.col("p_partkey")), F.col("p_name")))
    number = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(".5)"))).otherwise(F.col("p_size").cast("string"))
    return A.read(spark, sf_dir, "part").select("p_partkey", given.alias("given"), T.clean_cell(given).alias("clean"), T.continues(F.col("p_name"), F.lower("p_type")).alias("goes_on"), mark.alias("mark"), T.statistic(number).alias("statistic"))


# ---- checks -------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, coalesce(len(list_filter(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: contains(lower(x), 'e'))) > 0, false) AS heading, coalesce(len(list_filter(regexp_extract_all(html, '(?is)<b(?:\s[^>]*)?>(.*?)</b>', 1) || regexp_extract_all(html, '(?is)<strong[^>]*>(.*?)</strong>', 1), lambda x: contains(lower(x), 'e'))) > 0, false) AS bold
 FROM (SELECT page_id, regexp_replace(regexp_replace(html, '[*_#]', ' ', 'g'), '</?[bi]>(.)', '\0', 'g') AS html FROM pages)""")
def check_formats(spark, sf_dir):
    """A format check of each page for headings and bold text that hold an e, in either case."""
    rows = A.read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "[*_#]", " ").alias("md"))
    asked = rows.select("page_id", "md", F.explode(F.array(F.lit("heading"), F.lit("bold"))).alias("format"), F.lit("format").alias("type"), F.lit("e").alias("text"), F.lit(False).alias("case_sensitive"), F.lit(0).alias("max_diffs"))
    from .checks import _checks

    spare = [c for c in _checks(asked.limit(0)).columns if c not in asked.columns]
    schema = dict(_checks(asked.limit(0)).dtypes)
    full = asked.select("*", *[F.lit(None).cast(schema[c]).alias(c) for c in spare])
    return C.exact(full).groupBy("page_id").agg(F.bool_or(F.when(F.col("format") == "heading", F.col("passed"))).alias("heading"), F.bool_or(F.when(F.col("format") == "bold", F.col("passed"))).alias("bold"))


SHEET = "WITH s AS (SELECT o_custkey AS page, o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS below, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)"


def order_sheets(spark, sf_dir):
    """pdf, page, md: the orders of a customer as a table of number, status and priority, with a list and a note."""
    row = F.format_string("| %d | %s | %s |", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda s: s["r"]), "\n")
    md = F.concat(F.lit("| Order | Status | Priority |\n|---|---|---|\n"), "_rows", F.lit("\n\nThe orders of customer "), F.col("o_custkey").cast("string"), F.lit("[^1] stand above\n\n[^1]: as they were taken\n"))
    return A.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("_rows")).select(F.lit("sheets").alias("pdf"), F.col("o_custkey").cast("int").alias("page"), md.alias("md"))


def run_checks(asked, outputs):
    """Checks run by their whole definition, one repeat a page."""
    from .checks import _checks

    return C.run(_checks(asked), outputs.withColumn("repeat", F.lit(1)))


@query(SHEET + " SELECT 'o' || o_orderkey AS id, pr LIKE '%U%' OR st = 'F' AS passed FROM s")
def check_tables(spark, sf_dir):
    """A table check of each order: its number with its status at the right, or with status F where its priority has no U."""
    orders = A.read(spark, sf_dir, "orders")
    want = F.when(F.col("o_orderpriority").contains("U"), F.col("o_orderstatus")).otherwise("F")
    asked = orders.select(F.lit("sheets").alias("pdf"), F.col("o_custkey").cast("int").alias("page"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("table").alias("type"), F.lit(0).alias("max_diffs"), F.col("o_orderkey").cast("string").alias("cell"), want.alias("right"), F.lit("Order").alias("top_heading"))
    return run_checks(asked, order_sheets(spark, sf_dir)).select("id", "passed")


@query("SELECT DISTINCT 'c' || o_custkey AS id, o_custkey % 3 <> 2 AS passed FROM orders")
def check_footnotes(spark, sf_dir):
    """A note check of each sheet: by its marker, the text before it and after it; every third asks for a marker that is not there."""
    sheets = order_sheets(spark, sf_dir)
    asked = sheets.select("pdf", "page", F.concat(F.lit("c"), F.col("page").cast("string")).alias("id"), F.lit("footnote").alias("type"), F.lit(0).alias("max_diffs"), F.when(F.col("page") % 3 == 2, "7").otherwise("1").alias("marker"), F.concat(F.lit("orders of customer "), F.col("page").cast("string")).alias("appears_before_marker"), F.when(F.col("page") % 3 == 1, "stand above").alias("appears_after_marker"))
    return run_checks(asked, sheets).select("id", "passed")


@query("SELECT 'p' || p_partkey AS id, p_partkey % 3 <> 2 AS passed FROM part")
def check_list_items(spark, sf_dir):
    """A check of each part for an entry of the list in its cell; every third asks for one that is not there."""
    item = lambda c: F.concat(F.lit("<li>"), F.col(c), F.lit("</li>"))
    part = A.read(spark, sf_dir, "part")
    sheets = part.select(F.lit("parts").alias("pdf"), F.col("p_partkey").cast("int").alias("page"), F.concat(F.lit("<table><tr><th>What</th></tr><tr><td>"), "p_name", F.lit("<ul>"), item("p_type"), item("p_brand"), F.lit("</ul></td></tr></table>")).alias("md"))
    asked = part.select(F.lit("parts").alias("pdf"), F.col("p_partkey").cast("int").alias("page"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("list_item").alias("type"), F.lit(0).alias("max_diffs"), F.when(F.col("p_partkey") % 3 == 2, "nothing of it").when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand")).alias("item"), F.lit("What").alias("top_heading"))
    return run_checks(asked, sheets).select("id", "passed")


@query("SELECT 'm' || p_partkey AS id, p_partkey % 2 = 0 AS passed FROM part")
def check_maths(spark, sf_dir):
    part = A.read(spark, sf_dir, "part")
    formula = F.format_string("x_{%d} = %d", F.col("p_partkey"), F.col("p_size"))
    sheets = part.select(F.lit("parts").alias("pdf"), F.col("p_partkey").cast("int").alias("page"), F.concat(F.lit("so \\("), formula, F.lit("\\) holds")).alias("md"))
    asked = part.select(F.lit("parts").alias("pdf"), F.col("p_partkey").cast("int").alias("page"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.lit("math").alias("type"), F.lit(0).alias("max_diffs"), F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace(formula, " ", "")).otherwise("y = 0").alias("math"))
    return run_checks(asked, sheets).select("id", "passed")


@query("SELECT 'd' || item_id AS id, item_id % 3 <> 2 AS passed FROM benchmark WHERE length(trim(regexp_replace(lower(text), '[^a-z ]', '', 'g')[1:24])) >= 12")
def check_edited(spark, sf_dir):
    """A check of each item for its opening with two letters changed where three are allowed; every third has four changed, to letters that no item has."""
    plain = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    rows = A.read(spark, sf_dir, "benchmark").select("item_id", plain.alias("md"), F.trim(F.substring(plain, 1, 24)).alias("q")).filter("length(q) >= 12")
    spots = F.when(F.col("item_id") % 3 == 2, F.array(*map(F.lit, (1, 4, 7, 10)))).otherwise(F.array(F.lit(1), F.lit(6)))
    asked = F.array_join(F.transform(F.filter(F.split("q", ""), lambda x: x != ""), lambda x, i: F.when(F.array_contains(spots, i + 1), "Ω").otherwise(x)), "")
    checks = rows.select(F.lit("items").alias("pdf"), F.col("item_id").cast("int").alias("page"), F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("id"), F.lit("present").alias("type"), F.lit(3).alias("max_diffs"), asked.alias("text"))
    return run_checks(checks, rows.select(F.lit("items").alias("pdf"), F.col("item_id").cast("int").alias("page"), "md")).select("id", "passed")


@query("SELECT DISTINCT source AS pdf, CASE WHEN length(source) % 2 = 0 THEN 'baseline' ELSE 'present' END AS type, false AS added FROM documents UNION ALL SELECT DISTINCT source, 'baseline', true FROM documents WHERE length(source) % 2 <> 0")
def check_baselines_added(spark, sf_dir):
    files = A.read(spark, sf_dir, "documents").select(F.col("source").alias("pdf")).distinct()
    have = files.select("pdf", F.lit(1).alias("page"), F.concat("pdf", F.lit("_own")).alias("id"), F.when(F.length("pdf") % 2 == 0, "baseline").otherwise("present").alias("type"))
    return C.with_baselines(have, files).select("pdf", "type", F.col("id").endswith("_baseline").alias("added"))


# ---- formulas -----------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '\left( ' || p_size || ' \right)' WHEN 1 THEN '\big( ' || p_size || ' & x \big)' WHEN 2 THEN '\left[ \left( a \right) \right]' WHEN 3 THEN '\big( ' || p_size WHEN 4 THEN '{\big( a} \big)' ELSE '(' || p_size || ')' END AS latex FROM part""")
def sized_delimiters(spark, sf_dir):
    size = F.col("p_size").cast("string")
    at = F.col("p_partkey") % 6
    given = F.when(at == 0, F.concat(F.lit("\\big( "), size, F.lit(" \\big)"))).when(at == 1, F.concat(F.lit("\\big( "), size, F.lit(" & x \\big)"))).when(at == 2, "\\Big[ \\bigl( a \\bigr) \\Big]").when(at == 3, F.concat(F.lit("\\big( "), size)).when(at == 4, "{\\big( a} \\big)").otherwise(F.concat(F.lit("("), size, F.lit(")")))
    return A.read(spark, sf_dir, "part").select("p_partkey", M.pair_delimiters(given).alias("latex"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'so \(x=' || p_size || '+1\) and' WHEN 1 THEN 'so \(x= y\) and' WHEN 2 THEN 'so \(x=\) the ' || p_size ELSE 'so \(x\) ' || p_size END AS text FROM part""")
def dangling_formulas(spark, sf_dir):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    given = F.when(at == 0, F.concat(F.lit("so \\(x=\\)\n"), size, F.lit(" + 1 and"))).when(at == 1, "so \\(x=\\) \\(y\\) and").when(at == 2, F.concat(F.lit("so \\(x=\\) the "), size)).otherwise(F.concat(F.lit("so \\(x\\) "), size))
    return A.read(spark, sf_dir, "part").select("p_partkey", M.join_dangling(given).alias("text"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a_{' || p_size || '} &= b' WHEN 1 THEN 'f \left( a = b \right) &\leq ' || p_size WHEN 2 THEN '[a=b] + ' || p_size ELSE 'x &\in ' || p_size || ' = z' END AS row FROM part""")
def aligned_relations(spark, sf_dir):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    given = F.when(at == 0, F.concat(F.lit("a_{"), size, F.lit("} = b"))).when(at == 1, F.concat(F.lit("f \\left( a = b \\right) \\leq "), size)).when(at == 2, F.concat(F.lit("[a=b] + "), size)).otherwise(F.concat(F.lit("x \\in "), size, F.lit(" = z")))
    return A.read(spark, sf_dir, "part").select("p_partkey", M.align_relation(given).alias("row"))


@query(r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pay $' || p_size || ' and $7' WHEN 1 THEN 'let \(x_' || p_size || '\) be' WHEN 2 THEN '\[a = ' || p_size || ']' || '' WHEN 3 THEN '\(a + b\) and \(c\) \(d\)' ELSE '\[a = 1\]' || chr(10) || chr(10) || '\[= ' || p_size || '\]' END AS text FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 2)""")
def maths_delimiters(spark, sf_dir):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    given = F.when(at == 0, F.concat(F.lit("pay $"), size, F.lit(" and $7"))).when(at == 1, F.concat(F.lit("let $x_"), size, F.lit("$ be"))).when(at == 3, "$a +$ $b$ and $c$ $d$").otherwise(F.concat(F.lit("$$\\begin{aligned} a &= 1 \\\\ &= "), size, F.lit(" \\end{aligned}$$")))
    return A.read(spark, sf_dir, "part").filter("p_partkey % 5 <> 2").select("p_partkey", M.normalise_delimiters(given).alias("text"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a \& ' || p_size WHEN p_partkey % 3 = 1 THEN 'a \& ' || p_size ELSE '\begin{x} & ' || p_size END AS span FROM part""")
def formula_ampersands(spark, sf_dir):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    given = F.concat(F.when(at == 0, "a & ").when(at == 1, "a \\& ").otherwise("\\begin{x} & "), size)
    return A.read(spark, sf_dir, "part").select("p_partkey", T.formula_ampersands(given).alias("span"))


QUERIES, ORACLES = query.queries, query.oracles
