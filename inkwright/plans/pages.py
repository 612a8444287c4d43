"""Queries over lines, running heads and feet, and two issues of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.operators import notes as N
from inkwright.operators import running as R
from inkwright.sources import adapters as A

from ._named import Named

query = Named()
P = A.SQL
FOLD = rf"regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\b(?:{T.MONTHS})\b', '<m>', 'g')"
EDGES = f"""{P}, ed AS (SELECT *, {FOLD} AS fold FROM bd WHERE band <> 'body')"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
RUN = lambda reach: f"EXISTS (SELECT 1 FROM ed b WHERE b.file = a.file AND b.band = a.band AND b.fold = a.fold AND b.page <> a.page AND abs(b.page - a.page) <= {reach})"
def _issue(name: str, pages: str, text: str) -> str:
    """The pages of one issue with the words that do not run from page to page, as tables of a WITH clause."""
    run = f"EXISTS (SELECT 1 FROM {name}_ed b WHERE b.file = a.file AND b.band = a.band AND b.fold = a.fold AND abs(b.page - a.page) = 1)"
    return f"""{name}_pg AS (SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, {text} AS text FROM documents WHERE {pages}),
{name}_ln AS (SELECT * FROM (SELECT file, page, generate_subscripts(parts, 1) - 1 AS line_no, len(parts) AS n_lines, unnest(parts) AS line FROM (SELECT *, string_split(text, chr(10)) AS parts FROM {name}_pg)) WHERE trim(line) <> ''),
{name}_bd AS (SELECT *, CASE WHEN line_no < greatest(1, ceil(n_lines * 0.12)) THEN 'head' WHEN line_no >= n_lines - greatest(1, ceil(n_lines * 0.12)) THEN 'foot' ELSE 'body' END AS band FROM {name}_ln),
{name}_ed AS MATERIALIZED (SELECT *, {FOLD} AS fold FROM {name}_bd WHERE band <> 'body'),
{name}_rn AS MATERIALIZED (SELECT file, page, line_no, {run} AS rep FROM {name}_ed a),
{name} AS MATERIALIZED (SELECT p.file, p.page, coalesce(b.body, '') AS text FROM {name}_pg p LEFT JOIN (SELECT file, page, string_agg(line, ' ' ORDER BY line_no) FILTER (rep IS NOT TRUE) AS body FROM {name}_bd LEFT JOIN {name}_rn USING (file, page, line_no) GROUP BY file, page) b ON b.file = p.file AND b.page = p.page)"""


REVISED = "CASE WHEN doc_id % 5 = 0 THEN 'revised edition ' || text ELSE text END"
ISSUES = "WITH " + _issue("old", "doc_id % 7 <> 1", "text") + ",\n" + _issue("new", "doc_id % 7 <> 0", REVISED)
BIGRAMS = lambda t: f"""(SELECT file, page, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1] || ' '] ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS g FROM (SELECT file, page, {WORDS} AS w FROM {t}))"""
LIKE = ISSUES + f""", oc AS MATERIALIZED (SELECT file, page, list_sort(g) AS g FROM {BIGRAMS('old')}), nc AS MATERIALIZED (SELECT file, page, list_sort(g) AS g FROM {BIGRAMS('new')}),
od AS (SELECT file, g, min(page) AS page FROM oc GROUP BY file, g), nd AS (SELECT file, g, min(page) AS page FROM nc GROUP BY file, g),
lk AS MATERIALIZED (
  SELECT * FROM (SELECT o.file, o.page AS old_page, n.page AS new_page, o.g AS og, n.g AS ng,
    CASE WHEN len(o.g) + len(n.g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(o.g, n.g))::DOUBLE / (len(o.g) + len(n.g) - len(list_intersect(o.g, n.g))) END AS likeness
  FROM od o JOIN nd n ON n.file = o.file) WHERE likeness >= 0.5
)"""


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.banded(A.lines(A.pages(A.read(spark, sf_dir, "documents"))))


def issue_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two issues of each source. Every seventh document is not in the old one, another seventh not in the new one, and every fifth is revised there."""
    docs = A.read(spark, sf_dir, "documents")
    revised = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("revised edition "), F.col("text"))).otherwise(F.col("text"))
    return A.pages(docs.filter("doc_id % 7 <> 1")), A.pages(docs.filter("doc_id % 7 <> 0").withColumn("text", revised))


def bodies(pages: DataFrame) -> DataFrame:
    """An issue's pages without the lines that run from page to page."""
    own = R.prints(A.banded(A.lines(pages))).select("file", "page", F.col("body").alias("text"))
    return pages.select("file", "page").join(own, ["file", "page"], "left").select("file", "page", F.coalesce("text", F.lit("")).alias("text"))


def issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = issue_pages(spark, sf_dir)
    return bodies(old), bodies(new)


def classed_issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = issues(spark, sf_dir)
    return R.classes(old), R.classes(new)


@query(P + " SELECT file, page, line_no, line FROM ln")
def doc_lines(spark, sf_dir):
    return A.lines(A.pages(A.read(spark, sf_dir, "documents"))).select("file", "page", "line_no", "line")


@query(P + " SELECT file, page, doc_id FROM pg WHERE page <= 3")
def first_pages(spark, sf_dir):
    return A.pages(A.read(spark, sf_dir, "documents")).filter("page <= 3").select("file", "page", "doc_id")


@query("SELECT source AS file, count(*) AS pages FROM documents GROUP BY source")
def page_count(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("pages"))


@query(P + " SELECT file, page, line_no, band FROM bd")
def edge_bands(spark, sf_dir):
    return banded(spark, sf_dir).select("file", "page", "line_no", "band")


@query(EDGES + f" SELECT file, page, line_no, band, fold, {RUN(1)} AS repeated FROM ed a")
def running_lines(spark, sf_dir):
    return R.running(banded(spark, sf_dir)).select("file", "page", "line_no", "band", "fold", "repeated")


@query(EDGES + f" SELECT file, page, line_no, line FROM ed a WHERE NOT {RUN(2)}")
def imprint_lines(spark, sf_dir):
    return R.running(banded(spark, sf_dir), 2).filter(~F.col("repeated")).select("file", "page", "line_no", "line")


@query(
    EDGES
    + f""" SELECT file, page, line_no, checked, CASE WHEN NOT checked THEN NULL WHEN rep THEN 'running' ELSE 'imprint' END AS kept_in,
  CASE WHEN NOT checked THEN 'no page beside it to ask' WHEN rep THEN 'a page beside it prints the same line' ELSE 'no page beside it prints the line' END AS because
  FROM (SELECT a.*, {RUN(2)} AS rep, m.pages > 1 AS checked FROM ed a JOIN (SELECT file, max(page) AS pages FROM bd GROUP BY file) m ON m.file = a.file)"""
)
def edge_decisions(spark, sf_dir):
    return R.decided(banded(spark, sf_dir)).select("file", "page", "line_no", "checked", "kept_in", "because")


@query(
    EDGES
    + f""", rn AS MATERIALIZED (SELECT file, page, line_no, {RUN(1)} AS rep, fold FROM ed a)
  SELECT file, page, coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (rep IS NOT TRUE), '') AS body,
         coalesce(string_agg(fold, ' / ' ORDER BY line_no) FILTER (rep), '') AS running
  FROM bd LEFT JOIN rn USING (file, page, line_no) GROUP BY file, page"""
)
def page_prints(spark, sf_dir):
    return R.prints(banded(spark, sf_dir)).select("file", "page", "body", F.array_join("running", " / ").alias("running"))


@query(P + f" SELECT file, page, len(g) AS n, list_sort(g)[1] AS first FROM {BIGRAMS('pg')}")
def page_bigrams(spark, sf_dir):
    found = A.pages(A.read(spark, sf_dir, "documents")).select("file", "page", T.bigrams(T.words(F.col("text"))).alias("g"))
    return found.select("file", "page", F.size("g").cast("long").alias("n"), F.get("g", 0).alias("first"))


@query(LIKE + " SELECT file, old_page, new_page, likeness FROM lk")
def page_likeness(spark, sf_dir):
    return R.likeness(*classed_issues(spark, sf_dir)).select("file", "old_page", "new_page", "likeness")


@query(ISSUES + f" SELECT file, min(page) AS first, count(*) AS pages FROM (SELECT file, page, list_sort(g) AS g FROM {BIGRAMS('old')}) GROUP BY file, g")
def page_classes(spark, sf_dir):
    old = R.named(bodies(issue_pages(spark, sf_dir)[0]))  # read once, so not written
    return old.groupBy("file", "cls").agg(F.min("page").alias("first"), F.count("*").alias("pages")).select("file", "first", "pages")


@query(
    LIKE
    + """ SELECT lk.file, old_page, new_page, CASE WHEN o.text = n.text THEN 'same' WHEN regexp_replace(lower(o.text), '[0-9]+', '#', 'g') = regexp_replace(lower(n.text), '[0-9]+', '#', 'g') THEN 'restamped' ELSE 'changed' END AS kind
  FROM lk JOIN old o ON o.file = lk.file AND o.page = old_page JOIN new n ON n.file = lk.file AND n.page = new_page"""
)
def page_match_class(spark, sf_dir):
    old, new = classed_issues(spark, sf_dir)
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    kind = F.when(F.col("ot") == F.col("nt"), "same").when(plain("ot") == plain("nt"), "restamped").otherwise("changed")
    a = old.select("file", F.col("page").alias("old_page"), F.col("text").alias("ot"))
    b = new.select("file", F.col("page").alias("new_page"), F.col("text").alias("nt"))
    return R.likeness(old, new).join(a, ["file", "old_page"]).join(b, ["file", "new_page"]).select("file", "old_page", "new_page", kind.alias("kind"))


@query()
def page_match_dp(spark, sf_dir):
    return R.matched(*classed_issues(spark, sf_dir))


@query()
def page_match_kinds(spark, sf_dir):
    prints = [R.prints(A.banded(A.lines(pages))) for pages in issue_pages(spark, sf_dir)]
    return R.classed(R.matched(*classed_issues(spark, sf_dir)), *prints)


@query("SELECT conv_id, turn, conv_id || ' -> ' || (conv_id + 1) || ' now' AS figures, CASE WHEN role = 'user' THEN 'asked -> told' ELSE '' END AS wording FROM conversations WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[^\\s]+')) > 0")
def page_changes(spark, sf_dir):
    """Every turn of a conversation against a copy with another number, a word more and, for the user's, another word."""
    rows = A.read(spark, sf_dir, "conversations").filter("text IS NOT NULL").filter(F.size(T.tokens(F.col("text"))) > 0)
    user, conv = F.col("role") == "user", F.col("conv_id")
    old = F.concat(F.lit("of "), conv.cast("string"), F.lit(" "), "text", F.lit(" "), F.when(user, "asked").otherwise("told"))
    new = F.concat(F.lit("of "), (conv + 1).cast("string"), F.lit(" now "), "text", F.lit(" told"))
    return rows.select("conv_id", "turn", R.changes(old, new).alias("c")).select("conv_id", "turn", F.array_join("c.figures", "|").alias("figures"), F.array_join("c.wording", "|").alias("wording"))


@query(LIKE + " SELECT file, page FROM oc o WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.file = o.file AND lk.og = o.g)")
def dropped_pages(spark, sf_dir):
    old, new = classed_issues(spark, sf_dir)
    met = R.likeness(old, new).select("file", F.col("old_cls").alias("cls")).distinct()
    return old.select("file", "page", "cls").join(met, ["file", "cls"], "left_anti").select("file", "page")


@query(LIKE + " SELECT file, page FROM nc n WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.file = n.file AND lk.ng = n.g)")
def new_pages(spark, sf_dir):
    old, new = classed_issues(spark, sf_dir)
    met = R.likeness(old, new).select("file", F.col("new_cls").alias("cls")).distinct()
    return new.select("file", "page", "cls").join(met, ["file", "cls"], "left_anti").select("file", "page")


@query(P + " SELECT DISTINCT file, page FROM ln WHERE line IN (SELECT line FROM ln GROUP BY line HAVING count(DISTINCT doc_id) > 1) AND length(line) >= 40")
def shared_passages(spark, sf_dir):
    rows = A.lines(A.pages(A.read(spark, sf_dir, "documents"))).filter(F.length("line") >= 40)
    hashed = rows.select("file", "page", "doc_id", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    often = hashed.groupBy("h", "h2").agg((F.min("doc_id") < F.max("doc_id")).alias("often")).filter("often").select("h", "h2")
    return hashed.join(often, ["h", "h2"], "left_semi").select("file", "page").distinct()


NUMBERS = EDGES + r""", nu AS MATERIALIZED (SELECT DISTINCT file, page, CAST(v AS BIGINT) AS value, i <= len(vs) / 2 AS left FROM (
  SELECT file, page, vs, generate_subscripts(vs, 1) AS i, unnest(vs) AS v FROM (SELECT file, page, regexp_extract_all(line, '[0-9]{1,4}') AS vs FROM ed)))"""


def edge_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of edge lines, the earlier half of a line's counted as its left."""
    found = R.edge_lines(banded(spark, sf_dir)).select("file", "page", F.regexp_extract_all("line", F.lit("[0-9]{1,4}"), F.lit(0)).alias("vs"))
    each = found.select("file", "page", "vs", F.posexplode("vs").alias("i", "v"))
    return each.select("file", "page", F.col("v").cast("long").alias("value"), (F.col("i") + 1 <= F.size("vs") / 2).alias("left")).distinct()


@query(
    NUMBERS
    + """ SELECT DISTINCT file, page, value, "left" FROM nu a WHERE EXISTS (SELECT 1 FROM nu b WHERE b.file = a.file AND b.page <> a.page AND abs(b.page - a.page) <= 2
  AND (b.value - a.value = b.page - a.page OR (b.value - a.value = 2 * (b.page - a.page) AND b."left" = a."left")))"""
)
def printed_number_runs(spark, sf_dir):
    return N.running_numbers(edge_numbers(spark, sf_dir))


@query(
    NUMBERS
    + """, pg2 AS (SELECT file, page, list(DISTINCT value - page) AS ds FROM nu GROUP BY file, page), nb AS (
  SELECT n.file, n.page, n.value, (SELECT ds FROM pg2 p WHERE p.file = n.file AND p.page IN (n.page - 1, n.page - 2) ORDER BY page DESC LIMIT 1) AS b,
         (SELECT ds FROM pg2 p WHERE p.file = n.file AND p.page IN (n.page + 1, n.page + 2) ORDER BY page LIMIT 1) AS a FROM nu n)
  SELECT file, page, value, CASE WHEN len(list_intersect(a, b)) > 0 THEN list_contains(list_intersect(a, b), value - page) END AS counts FROM nb"""
)
def number_counts_pages(spark, sf_dir):
    return N.counts_pages(edge_numbers(spark, sf_dir))


@query(
    EDGES
    + """ SELECT file, page, line_no, CASE WHEN EXISTS (SELECT 1 FROM ed b WHERE b.file = a.file AND b.page <> a.page AND abs(b.page - a.page) <= 2 AND abs(b.line_no - a.line_no) <= 1
    AND lower(trim(regexp_replace(b.line, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(a.line, '\\s+', ' ', 'g')))) THEN true
    WHEN EXISTS (SELECT 1 FROM ed b WHERE b.file = a.file AND b.page <> a.page AND abs(b.page - a.page) <= 2) THEN false END AS runs FROM ed a"""
)
def runs_beside(spark, sf_dir):
    edges = R.edge_lines(banded(spark, sf_dir)).select("file", "page", "line_no", "line", F.lit(0.0).alias("x0"), F.col("line_no").cast("double").alias("y0"))
    return N.runs_beside(edges, near=1.0).select("file", "page", "line_no", "runs")


QUERIES, ORACLES = query.queries, query.oracles
