"""Queries of blocks, tables, notes and whole documents: web pages are blocks, orders are tables, parts are forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.operators import convert as C
from inkwright.operators import forms
from inkwright.operators import maths as M
from inkwright.operators import notes as N
from inkwright.operators import render as R
from inkwright.operators import structure as S
from inkwright.operators import tables as Tb
from inkwright.sources import adapters as A

from ._named import Named

query = Named()
H = A.HTML_SQL


def html_rows(spark, sf_dir):
    return A.html_blocks(A.read(spark, sf_dir, "pages"))


@query(H + " SELECT page_id, block_no, kind, text FROM hb")
def html_blocks(spark, sf_dir):
    return html_rows(spark, sf_dir)


@query(H + " SELECT page_id, block_no, '- ' || text AS item FROM hb WHERE kind = 'list_item' AND NOT regexp_matches(text, '^[•◦▪●‣⁃■□·\\-–—*(0-9]')")
def html_list_items(spark, sf_dir):
    rows = html_rows(spark, sf_dir).filter("kind = 'list_item'").filter(~F.col("text").rlike(r"^[•◦▪●‣⁃■□·\-–—*(0-9]"))
    return rows.select("page_id", "block_no", T.list_item(F.concat(F.lit("• "), F.col("text")), F.lit(1)).alias("item"))


@query(H + " SELECT page_id, arg_min(text, block_no) AS title FROM hb WHERE kind = 'heading' GROUP BY page_id")
def html_title(spark, sf_dir):
    return html_rows(spark, sf_dir).filter("kind = 'heading'").groupBy("page_id").agg(F.min_by("text", "block_no").alias("title"))


def line_rows(spark, sf_dir):
    """Lines of documents laid out on pages of 792 points: fourteen points a line, size and weight by their place."""
    rows = A.lines(A.pages(A.read(spark, sf_dir, "documents").filter("text IS NOT NULL")))
    y = (F.col("line_no") + 1) * 14.0 / F.greatest(F.col("n_lines") * 14.0 / 760.0, F.lit(1.0))
    return rows.select("file", "page", "line_no", F.col("line").alias("text"), F.when(F.col("line_no") == 0, 14.0).otherwise(10.0).alias("size"), (F.col("line_no") == 0).alias("bold"), F.lit(72.0).alias("x0"), y.alias("y0"), F.least(F.lit(540.0), 72.0 + F.length("line") * 5.0).alias("x1"), (y + 10.0).alias("y1"), F.lit(792.0).alias("page_height"))


LINES = A.SQL + """, lr AS (SELECT file, page, line_no, line AS text, CASE WHEN line_no = 0 THEN 14.0 ELSE 10.0 END AS size, line_no = 0 AS bold, (line_no + 1) * 14.0::DOUBLE / greatest(n_lines * 14.0::DOUBLE / 760.0::DOUBLE, 1) AS y0,
  (line_no + 1) * 14.0::DOUBLE / greatest(n_lines * 14.0::DOUBLE / 760.0::DOUBLE, 1) + 10 AS y1 FROM ln)"""
CASCADE = LINES + r""", t AS (SELECT *, trim(text) AS t, length(trim(text)) AS n, length(regexp_replace(trim(text), '[^\p{Ll}]', '', 'g')) AS low, length(regexp_replace(trim(text), '[^\p{Nd}]', '', 'g')) AS dig FROM lr)
 SELECT file, page, line_no, CASE WHEN regexp_matches(t, '(?i)^\s*(?:page\s+)?(?:[0-9]{1,4}|[ivxlcdm]{1,7})(?:\s*(?:/|of)\s*[0-9]{1,4})?\s*$') AND (y1 <= 0.09 * 792.0 * 1.3 OR y0 >= (792.0 - 0.09 * 792.0) * 0.97) THEN 'page_number'
 WHEN ct AND y1 <= 0.18 * 792.0 THEN 'header' WHEN ct AND y0 >= 0.86 * 792.0 THEN 'footer' WHEN y1 <= 0.09 * 792.0 AND n <= 160 AND size <= 13 THEN 'header'
 WHEN y0 >= 792.0 - 0.09 * 792.0 AND n <= 200 AND size <= 10.5 THEN 'footer'
 WHEN regexp_matches(t, '(?i)^\s*(?:figure|fig\.?|table|tab\.?|chart|scheme|plate|exhibit)\s*[0-9IVX]+[.:\-\s]') THEN 'caption'
 WHEN regexp_matches(t || ' ', '^\s*(?:[•◦▪●‣⁃■□·]|[-–—*]\s|\(?[0-9]{1,3}[.)]\s|\(?[a-z][.)]\s|\([A-Z]\)\s|[A-Z]\)\s|\(?[ivx]{1,6}[.)]\s)') THEN 'list_item'
 WHEN size >= 11.5 AND n <= 200 AND NOT regexp_matches(t, '[.,;]$') THEN 'heading' WHEN bold AND n <= 120 AND NOT regexp_matches(t, '[,;]$') THEN 'heading'
 WHEN regexp_matches(t, '^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,4})\.?\s+\S') AND n <= 100 AND bold THEN 'heading'
 WHEN regexp_matches(t, '(?i)^\s*(?:abstract|introduction|conclusions?|references|acknowledg\w*|appendix|bibliography|summary|background|methods?|results?|discussion|keywords?)\b[:.]?\s*$') THEN 'heading' ELSE 'text' END AS kind
 FROM (SELECT *, regexp_matches(t, '(?i)https?://|www\.|\b[\w.+-]+@[\w-]+\.[\w.]+|\bdoi\b|\bdoi:|journal homepage|available (?:online )?at|downloaded from|\bcopyright\b|©|\bissn\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b') AS ct FROM t)"""


@query(CASCADE)
def block_kind_cascade(spark, sf_dir):
    rows = line_rows(spark, sf_dir).withColumns({"n_lines": F.lit(1), "body_size": F.lit(10.0)})
    return S.kinds(rows).select("file", "page", "line_no", "kind")


@query(LINES + r""", h AS (SELECT *, length(regexp_replace(regexp_extract(text, '^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,4})\.?\s+\S', 1), '[^.]', '', 'g')) AS dots, regexp_extract(text, '^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,4})\.?\s+\S', 1) AS num FROM lr)
  SELECT file, page, line_no, CASE WHEN num <> '' THEN least(6, dots + 2) ELSE least(6, greatest(1, dense_rank() OVER (PARTITION BY file, page ORDER BY size DESC))) END AS level FROM h""")
def heading_levels(spark, sf_dir):
    rows = line_rows(spark, sf_dir).withColumns({"kind": F.lit("heading"), "body_size": F.lit(10.0)})
    return S.heading_levels(rows, ["file", "page"]).select("file", "page", "line_no", "level")


LEVELS = H + r""", it AS (SELECT page_id, block_no, 10.0 * (length(text) % 3) AS x0, kind, '• ' || text AS text FROM hb),
  rn AS (SELECT *, sum(CASE WHEN kind = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY block_no) AS run FROM it), m AS (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n FROM rn WHERE kind = 'list_item')
  SELECT page_id, block_no, CASE WHEN n >= 3 THEN least(4, dense_rank() OVER (PARTITION BY page_id, run ORDER BY x0)) ELSE 1 END AS level FROM m"""


@query(LEVELS)
def list_levels(spark, sf_dir):
    rows = html_rows(spark, sf_dir).select("page_id", "block_no", F.col("block_no").alias("order"), "kind", F.concat(F.lit("• "), F.col("text")).alias("text"), ((F.length("text") % 3) * 10.0).alias("x0"))
    return S.list_levels(rows, ["page_id"]).select("page_id", "block_no", "level")


@query()
def reading_order(spark, sf_dir):
    rows = A.boxes(A.read(spark, sf_dir, "lineitem")).select("page", F.col("box").alias("block"), F.lit("text").alias("kind"), F.lit("word").alias("text"), F.lit(1).alias("n_lines"), "x0", "y0", "x1", "y1")
    return S.reading_order(rows, ["page"], 64.0, 4.0).select("page", "block", "order")


@query()
def paragraph_blocks(spark, sf_dir):
    return S.built(line_rows(spark, sf_dir), ["file", "page"]).groupBy("file", "page", "block").agg(F.count("*").alias("lines"))


@query(LINES + r""", o AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > 0.5 * greatest(size, lag(size) OVER w) OR size / lag(size) OVER w < 0.8 OR size / lag(size) OVER w > 1.25
  OR regexp_matches(text, '^\s*(?:[•◦▪●‣⁃■□·]|[-–—*]\s|\(?[0-9]{1,3}[.)]\s|\(?[a-z][.)]\s|\([A-Z]\)\s|[A-Z]\)\s|\(?[ivx]{1,6}[.)]\s)') THEN 1 ELSE 0 END AS b FROM lr WINDOW w AS (PARTITION BY file, page ORDER BY y0, line_no)),
  g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY file, page ORDER BY y0, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM o) SELECT file, page, block, count(*) AS n_lines FROM g GROUP BY ALL""")
def simple_blocks(spark, sf_dir):
    return S.simple_blocks(line_rows(spark, sf_dir), ["file", "page"]).select("file", "page", "block", "n_lines")


def order_cells(spark, sf_dir):
    """Each customer's orders as a table: status, priority and whole price, a row an order."""
    from pyspark.sql import Window as W

    orders = A.read(spark, sf_dir, "orders")
    row = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.floor("o_totalprice").cast("string"))).alias("col", "text")
    return orders.select(F.col("o_custkey").alias("page"), row.alias("row"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").select("page", "row", "o_orderkey", cells)


CELLS = """WITH rw AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, o_orderkey, [o_orderstatus, o_orderpriority, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)] AS v FROM orders),
  ce AS (SELECT page, row, o_orderkey, generate_subscripts(v, 1) - 1 AS col, unnest(v) AS text FROM rw)"""


@query(CELLS + r""", f AS (SELECT page, length(text) - length(replace(text, ' ', '')) + 1 AS w, trim(text) AS t FROM ce WHERE trim(text) <> '') SELECT page, count(*) AS filled, count(*) FILTER (w <= 3) / count(*) AS short_share,
  count(*) FILTER (regexp_matches(t, '(?i)^(?:[-+(]?[0-9.,]+%?\)?|-|--|n/?a)$')) / count(*) AS numeric_share, count(*) >= 2 AND max(w) <= 4 AND count(*) FILTER (regexp_matches(t, '^[A-Za-z][\w .()/-]{0,24}:\s*\S') OR t LIKE '%:') * 2 >= count(*) AS control_stamp FROM f GROUP BY page""")
def table_shares(spark, sf_dir):
    return Tb.shares(order_cells(spark, sf_dir), ["page"])


@query(CELLS + """, s AS (SELECT *, 1 + o_orderkey % 2 AS rs, 1 + (o_orderkey // 2) % 2 AS cs FROM ce WHERE col < 2), r AS (SELECT *, row AS r0, unnest(range(row, row + rs)) AS r FROM s), g AS (SELECT *, col AS c0, unnest(range(col, col + cs)) AS c FROM r)
  SELECT page, r AS row, c AS col, text FROM (SELECT *, row_number() OVER (PARTITION BY page, r, c ORDER BY r0, c0) AS n FROM g) WHERE n = 1""")
def grid_explode_spans(spark, sf_dir):
    rows = order_cells(spark, sf_dir).filter("col < 2").withColumns({"rowspan": (F.col("o_orderkey") % 2 + 1).cast("int"), "colspan": (F.floor(F.col("o_orderkey") / 2) % 2 + 1).cast("int")})
    return Tb.grid(rows, ["page"]).select("page", "row", "col", "text")


@query(CELLS + """, l AS (SELECT page, row, '| ' || string_agg(replace(trim(replace(text, '|', '\\|')), '$', '\\$'), ' | ' ORDER BY col) || ' |' AS l FROM ce GROUP BY page, row)
  SELECT page, string_agg(CASE WHEN row = 0 THEN l || chr(10) || '| --- | --- | --- |' ELSE l END, chr(10) ORDER BY row) AS md FROM l GROUP BY page""")
def cells_to_markdown(spark, sf_dir):
    return Tb.markdown(order_cells(spark, sf_dir), ["page"])


@query(CELLS + """, l AS (SELECT page, row, '<tr>' || chr(10) || string_agg(CASE WHEN row = 0 THEN '<th>' || text || '</th>' ELSE '<td>' || text || '</td>' END, chr(10) ORDER BY col) || chr(10) || '</tr>' AS l FROM ce GROUP BY page, row)
  SELECT page, '<table>' || chr(10) || string_agg(l, chr(10) ORDER BY row) || chr(10) || '</table>' AS html FROM l GROUP BY page""")
def cells_to_html(spark, sf_dir):
    rows = order_cells(spark, sf_dir).withColumns({"rowspan": F.lit(1), "colspan": F.lit(1), "header": F.col("row") == 0})
    return Tb.html(rows, ["page"])


@query()
def cells_round_trip(spark, sf_dir):
    return Tb.parsed_cells(Tb.markdown(order_cells(spark, sf_dir), ["page"]), ["page"])


@query(CELLS + """, e AS (SELECT page, row, col, CASE WHEN (page + col) % 3 = 0 THEN '' ELSE text END AS text FROM ce), f AS (SELECT DISTINCT page, col FROM e WHERE trim(text) <> ''), k AS (SELECT page, col, row_number() OVER (PARTITION BY page ORDER BY col) - 1 AS at FROM f)
  SELECT e.page, e.row, k.at AS col, e.text FROM e JOIN k ON k.page = e.page AND k.col = e.col""")
def columns_without_empty(spark, sf_dir):
    rows = order_cells(spark, sf_dir).withColumn("text", F.when((F.col("page") + F.col("col")) % 3 == 0, "").otherwise(F.col("text"))).select("page", "row", "col", "text")
    return Tb.without_empty_columns(rows, ["page"])


@query(CELLS + r""", c AS (SELECT page, row, CASE WHEN row < page % 3 THEN 'head ' || col ELSE text END AS text FROM ce), r AS (SELECT page, row, count(*) AS n, count(*) FILTER (regexp_matches(trim(text), '^[(\[]?[-+−–<>≤≥~≈]?\s*[$€£¥]?\s?[0-9.,]+\s*%?[)\]]?[*†‡a-z]{0,3}$|^[-–—]$|^[nN]/?[aA]$')) AS k FROM c WHERE trim(text) <> '' GROUP BY page, row),
  f AS (SELECT page, least(coalesce(min(row) FILTER (k >= greatest(1, 0.4 * n)), max(row) + 1), 3) AS h, max(row) + 1 AS n FROM r GROUP BY page) SELECT page, CASE WHEN h = 0 OR h >= n THEN 1 ELSE h END AS headings FROM f""")
def table_heading_rows(spark, sf_dir):
    rows = order_cells(spark, sf_dir).withColumn("text", F.when(F.col("row") < F.col("page") % 3, F.concat(F.lit("head "), F.col("col").cast("string"))).otherwise(F.col("text")))
    return Tb.heading_rows(rows, ["page"])




@query()
def statistics_folded(spark, sf_dir):
    text = F.when(F.col("row") % 2 == 0, F.col("text")).when(F.col("col") == 2, F.concat(F.lit("("), (F.col("text").cast("long") % 97).cast("string"), F.lit(")"))).otherwise("")
    return Tb.folded_statistics(order_cells(spark, sf_dir).withColumn("text", text).select("page", "row", "col", "text"), ["page"])


@query(CELLS + """, l AS (SELECT page, row, max(CASE WHEN row = 0 OR o_orderkey % 3 = 0 THEN row END) OVER (PARTITION BY page ORDER BY row) AS top FROM ce WHERE col = 0) SELECT page, top AS row, count(*) AS rowspan FROM l GROUP BY page, top HAVING count(*) > 1""")
def label_spans(spark, sf_dir):
    rows = order_cells(spark, sf_dir).filter("col = 0").select("page", "row", F.when((F.col("row") == 0) | (F.col("o_orderkey") % 3 == 0), "label").otherwise("").alias("label"))
    return Tb.label_spans(rows, ["page"])


@query()
def aligned_tables(spark, sf_dir):
    rows = order_cells(spark, sf_dir)
    lines = rows.select("page", (F.col("row") * 3 + F.col("col")).alias("line"), "text", (F.col("col") * 120.0).alias("x0"), (F.col("row") * 12.0).alias("y0"), (F.col("col") * 120.0 + F.length("text") * 5.0).alias("x1"), (F.col("row") * 12.0 + 10.0).alias("y1"))
    return Tb.aligned_tables(lines, ["page"]).select("page", "table_no", "row", "col", "text")


NOTES = A.SQL + """, mk AS (SELECT DISTINCT file, page, CAST(page % 5 AS VARCHAR) AS key FROM ln), nt AS (SELECT file, page, line_no, CAST(page % 5 AS VARCHAR) AS key FROM ln WHERE line_no = 1),
  m AS (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY page) AS n FROM mk), d AS (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY page, line_no) AS n FROM nt)
  SELECT m.file, m.key, m.page, CASE WHEN d.page >= m.page THEN d.page END AS note_page, CASE WHEN m.n = 1 THEN m.key ELSE m.key || '-p' || m.page END AS final_key FROM m LEFT JOIN d ON d.file = m.file AND d.key = m.key AND d.n = m.n"""


@query(NOTES)
def footnote_links(spark, sf_dir):
    rows = A.lines(A.pages(A.read(spark, sf_dir, "documents"))).withColumn("key", (F.col("page") % 5).cast("string"))
    notes = rows.filter("line_no = 1").select("file", "page", "line_no", "key", F.col("line").alias("note"))
    return N.linked(rows.select("file", "page", "key"), notes).select("file", "key", "page", "note_page", "final_key")


@query(A.SQL + r""" SELECT file, page, line_no, regexp_extract(trim(line), '(?s)^([0-9]{1,3}|[*†‡§¶])[.)]?\s+(\S.*)$', 1) AS key FROM ln WHERE regexp_matches(trim(line), '(?s)^([0-9]{1,3}|[*†‡§¶])[.)]?\s+(\S.*)$')""")
def note_definitions(spark, sf_dir):
    return N.definitions(A.lines(A.pages(A.read(spark, sf_dir, "documents")))).select("file", "page", "line_no", "key")


def html_document(spark, sf_dir):
    rows = html_rows(spark, sf_dir).select(F.col("page_id").alias("file"), F.lit(1).alias("page"), F.col("block_no").alias("order"), "kind", "text", F.lit(1).alias("level"))
    return R.parts(rows, ["file"])


BODY = H + r""", tx AS (SELECT page_id AS file, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS part, kind, CASE kind WHEN 'heading' THEN '# ' || trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))
  WHEN 'list_item' THEN CASE WHEN regexp_matches(text, '^\s*[•◦▪●‣⁃■□·\-–—*]') THEN '- ' || trim(regexp_extract(text, '(?s)^\s*[•◦▪●‣⁃■□·\-–—*]\s*(.*)$', 1)) WHEN regexp_matches(text, '(?s)^\s*\(?([0-9]{1,3})[.)]\s*(.*)$') THEN regexp_extract(text, '(?s)^\s*\(?([0-9]{1,3})[.)]\s*(.*)$', 1) || '. ' || trim(regexp_extract(text, '(?s)^\s*\(?([0-9]{1,3})[.)]\s*(.*)$', 2)) ELSE trim(text) END
  ELSE replace(trim(text), '$', '\$') END AS t FROM hb)"""


@query(BODY + " SELECT file, rtrim(string_agg(t, chr(10) || chr(10) ORDER BY part)) AS body FROM tx GROUP BY file")
def document_markdown(spark, sf_dir):
    return R.documents(html_document(spark, sf_dir), ["file"])


@query(BODY + " SELECT file, part, kind, coalesce(CAST(sum(length(t) + 2) OVER w AS BIGINT), 0) AS start, coalesce(CAST(sum(length(t) + 2) OVER w AS BIGINT), 0) + length(t) AS \"end\" FROM tx WINDOW w AS (PARTITION BY file ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def location_offsets(spark, sf_dir):
    return R.offsets(html_document(spark, sf_dir), ["file"]).select("file", "part", "kind", "start", "end")


@query()
def front_matter(spark, sf_dir):
    rows = R.documents(html_document(spark, sf_dir), ["file"]).withColumns({"resource": F.col("file").cast("string"), "completion": F.lit("complete"), "confidence": F.lit(0.9), "pages": F.lit(1)})
    return R.front_matter(rows, ["file"]).select("file", "front")


@query()
def conversion(spark, sf_dir):
    return C.convert(line_rows(spark, sf_dir), C.Options(location_map=True)).select("file", "markdown", "completion", "confidence", F.size("decisions").alias("decisions"), F.length("map").alias("map_length"))


@query()
def escape_dollars(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", M.escape_dollars(M.normalise_delimiters(F.regexp_replace("text", r"([a-z]) ([a-z])\b", r"$1 \$$2\$"))).alias("text"))


ACCIDENTS = (
    (r"a\cdot\cdot\cdot b", r"a\cdots b"), (r"a, ... , z", r"a, \ldots , z"), ("x\u0338= y", r"x\neq y"), ("a \\equiv\u0338 b", r"a \not\equiv b"), (r"a \notin B", r"a \not\in B"), (r"f^{\sim}= g", r"f\cong g"),
    (r"(\mod 7)", r"\pmod{7}"), (r"\mathbf{w}\mathbf{o}\mathbf{r}\mathbf{d}", r"\mathbf{word}"), (r"A -^{a}-^{b}--\rightarrow B", r"A \xrightarrow{ab} B"), (r"E_{s}_{,t} +  x^{2}^{a}", r"E_{s,t} + x^{2a}"), (r"\big( x \big)", r"\left( x \right)"),
    (r"\leftarrow\rightarrow y", r"\longleftrightarrow y"), (r"x_{a_{b}}", r"x_{a_{b}}"), (r"._{._{.}}", r"\ddots"), ("é\u0301", "é"),
)


@query("WITH k AS (SELECT " + "[" + ", ".join("'" + b + "'" for _, b in ACCIDENTS) + f"] AS k) SELECT p_partkey, k[p_partkey % {len(ACCIDENTS)} + 1] || ' z_{{' || p_size || '}}' AS latex FROM part, k")
def polished_latex(spark, sf_dir):
    """A part's size as a script behind an accident of every kind."""
    part = A.read(spark, sf_dir, "part")
    accident = F.element_at(F.array(*[F.lit(a) for a, _ in ACCIDENTS]), (F.pmod("p_partkey", F.lit(len(ACCIDENTS))) + 1).cast("int"))
    return part.select("p_partkey", M.polished(F.concat(accident, F.lit(" z_{"), F.col("p_size").cast("string"), F.lit("}"))).alias("latex"))


def sheet_rows(spark, sf_dir, other=False):
    """Ten parts as one sheet: an event for each, an answer by its size, its name as the detail."""
    part = A.read(spark, sf_dir, "part")
    event = F.element_at(F.array(*map(F.lit, forms.EVENTS)), (F.pmod("p_partkey", F.lit(14)) + 1).cast("int"))
    kind = F.pmod(F.col("p_size") + (F.when(F.col("p_size") % 5 == 0, 1).otherwise(0) if other else 0), F.lit(3))
    answer = F.when(kind == 0, "Yes").when(kind == 1, "No").otherwise("Optional")
    body = part.select(F.floor(F.col("p_partkey") / 10).alias("sheet"), F.lit(0).alias("table_no"), (F.pmod("p_partkey", F.lit(10)) + 1).cast("int").alias("row"), F.array(F.initcap(event), answer, F.col("p_name")).alias("cells"))
    head = body.select("sheet", "table_no").distinct().select("sheet", "table_no", F.lit(0).alias("row"), F.array(F.lit("Event"), F.lit("Yes/No Optional"), F.lit("Some examples (see others)")).alias("cells"))
    return head.union(body)


@query("""WITH s AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS sheet, p_partkey % 14 AS e, p_size FROM part), n AS (SELECT sheet, count(DISTINCT e) AS events, count(DISTINCT e) AS r FROM s GROUP BY sheet) SELECT sheet, events, r AS events_in_rows, r AS answers_attached FROM n WHERE events >= 3""")
def form_grades(spark, sf_dir):
    return forms.grade(sheet_rows(spark, sf_dir), ["sheet"]).select("sheet", "events", "events_in_rows", "answers_attached")


@query("""WITH s AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS sheet, count(DISTINCT p_partkey % 14) AS e FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey % 14) >= 3), h AS (SELECT e, ('0x' || sha1(CAST(sheet AS VARCHAR))[1:8])::BIGINT % 5 = 0 AS held FROM s)
  SELECT CASE WHEN held THEN 'held-out' ELSE 'tuned-on' END AS bucket, count(*) AS sheets, CAST(sum(e) AS BIGINT) AS events FROM h GROUP BY held""")
def form_report(spark, sf_dir):
    from inkwright.operators import scoring

    graded = forms.grade(sheet_rows(spark, sf_dir), ["sheet"]).withColumn("bucket", scoring.split(F.col("sheet").cast("string"), "hex5"))
    return forms.report(graded, "bucket").select("bucket", "sheets", "events")


@query()
def form_compare(spark, sf_dir):
    return forms.compare(forms.event_rows(sheet_rows(spark, sf_dir), ["sheet"]), forms.event_rows(sheet_rows(spark, sf_dir, True), ["sheet"]), ["sheet"])


QUERIES, ORACLES = query.queries, query.oracles
