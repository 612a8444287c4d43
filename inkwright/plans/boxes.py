"""Queries of geometry: order lines are the boxes of an order, which is a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.functions import geometry as G
from inkwright.operators import boxes as X
from inkwright.operators import tables as Tb
from inkwright.sources import adapters as A

from ._named import Named

query = Named()
P = A.BOX_SQL
K = ["page"]
AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
SHARED = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
HALVES = P + ", a AS (SELECT * FROM bx WHERE box % 2 = 0), b AS (SELECT * FROM bx WHERE box % 2 = 1)"


def boxes(spark, sf_dir):
    return A.boxes(A.read(spark, sf_dir, "lineitem"))


def halves(spark, sf_dir):
    """Boxes of even and of odd number, as two kinds of things on a page."""
    own = boxes(spark, sf_dir)
    return own.filter("box % 2 = 0"), own.filter("box % 2 = 1")


@query(P + " SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM bx GROUP BY page")
def bbox_union(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(*G.union_all())


@query(HALVES + f" SELECT a.page, a.box AS a_box, b.box AS b_box, {SHARED} / {AREA} AS covered FROM a JOIN b ON b.page = a.page WHERE {SHARED} > 0")
def bbox_overlap(spark, sf_dir):
    met = X.pairs(*halves(spark, sf_dir), K).withColumn("covered", G.overlap_fraction("a_", "b_"))
    return met.filter("covered > 0").select("page", "a_box", "b_box", "covered")


@query(HALVES + f" SELECT a.page, a.box AS a_box, b.box AS b_box, {SHARED} / ({AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {SHARED}) AS iou FROM a JOIN b ON b.page = a.page WHERE {SHARED} > 0")
def bbox_iou_pairs(spark, sf_dir):
    return X.pairs(*halves(spark, sf_dir), K).withColumn("iou", G.iou("a_", "b_")).filter("iou > 0").select("page", "a_box", "b_box", "iou")


@query(HALVES + f" SELECT a.page, a.box AS a_box, b.box AS b_box, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM a JOIN b ON b.page = a.page WHERE {SHARED} > 0")
def bbox_intersection(spark, sf_dir):
    return X.pairs(*halves(spark, sf_dir), K).withColumn("i", G.intersection("a_", "b_")).filter("i IS NOT NULL").select("page", "a_box", "b_box", "i.*")


@query(HALVES + " SELECT a.page, a.box AS point, b.box FROM a JOIN b ON b.page = a.page WHERE (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1")
def point_in_box(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    points = a.select("page", F.col("box").alias("point"), G.centre_x().alias("x"), G.centre_y().alias("y"))
    return X.containing(points, b, K).select("page", "point", F.col("b_box").alias("box"))


@query(HALVES + f""" SELECT page, block, region, covered FROM (SELECT a.page, a.box AS block, b.box AS region, {SHARED} / {AREA} AS covered, row_number() OVER (PARTITION BY a.page, a.box ORDER BY {SHARED} / {AREA} DESC, b.box) AS n
  FROM a JOIN b ON b.page = a.page WHERE {SHARED} > 0) WHERE n = 1 AND covered >= 0.3""")
def best_region(spark, sf_dir):
    return X.best_region(*halves(spark, sf_dir), K, "box", "box", 0.3)


@query(HALVES + f" SELECT page, box FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND {SHARED} / {AREA} > 0.5)")
def blocks_outside_tables(spark, sf_dir):
    return X.outside(*halves(spark, sf_dir), K).select("page", "box")


@query(HALVES + """, m AS (SELECT a.page, a.box AS mark, b.box AS line, b.x0 - a.x1 AS gap FROM a JOIN b ON b.page = a.page
  WHERE abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 0.7 * greatest(a.y1 - a.y0, b.y1 - b.y0) AND b.y1 >= a.y0 AND b.y0 <= a.y1 AND b.x0 - a.x1 >= -1 AND b.x0 - a.x1 <= 30)
  SELECT page, mark, line, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, mark ORDER BY gap, line) AS n FROM m) WHERE n = 1""")
def nearest_line(spark, sf_dir):
    return X.nearest_right(*halves(spark, sf_dir), K, "box", "box", 30.0)


@query(P + " SELECT page, bin, count(*) AS n FROM (SELECT page, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS bin FROM bx) GROUP BY page, bin")
def x_histogram(spark, sf_dir):
    return X.coverage(boxes(spark, sf_dir), K)


GUTTERS = P + """, s AS (SELECT page, count(*) AS n, CAST(floor(min(x0)) AS BIGINT) AS l, CAST(floor(max(x1)) AS BIGINT) AS r FROM bx GROUP BY page),
  b AS (SELECT page, n, l, r, unnest(range(l, r + 1)) AS bin FROM s), c AS (SELECT page, bin, count(*) AS k FROM (SELECT page, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS bin FROM bx) GROUP BY page, bin),
  f AS (SELECT b.*, b.bin - row_number() OVER (PARTITION BY b.page ORDER BY b.bin) AS g FROM b LEFT JOIN c ON c.page = b.page AND c.bin = b.bin WHERE coalesce(c.k, 0) <= greatest(1, floor(b.n * 0.03))),
  u AS (SELECT page, n, l, r, min(bin) AS g0, max(bin) + 1 AS g1 FROM f GROUP BY page, g, n, l, r HAVING max(bin) + 1 - min(bin) >= 3 AND (min(bin) + max(bin) + 1) / 2 - l >= 0.15 * (r - l) AND (min(bin) + max(bin) + 1) / 2 - l <= 0.85 * (r - l)),
  k AS (SELECT u.page, g0, g1 FROM u JOIN bx ON bx.page = u.page GROUP BY u.page, g0, g1, n HAVING count(*) FILTER (x1 <= g0 + 0.5) >= 0.2 * n AND count(*) FILTER (x0 >= g1 - 0.5) >= 0.2 * n)
  SELECT page, g0, g1 FROM (SELECT *, count(*) OVER (PARTITION BY page) AS c FROM k) WHERE c <= 3"""


@query(GUTTERS)
def x_histogram_gutters(spark, sf_dir):
    return X.gutters(boxes(spark, sf_dir), K, width=3.0)


@query(P + """, o AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM bx),
  g AS (SELECT page, r, x0 - r AS gap FROM o WHERE x0 - r >= 2) SELECT page, r + gap / 2 AS at, gap FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC, r) AS n FROM g) WHERE n = 1""")
def sweep_gap(spark, sf_dir):
    return X.widest_gap(boxes(spark, sf_dir), K, 2.0)


@query(P + """, o AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2 THEN 1 ELSE 0 END AS b FROM bx),
  i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM o) SELECT page, island, count(*) AS boxes, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page, island""")
def gap_islands(spark, sf_dir):
    rows = X.islands(boxes(spark, sf_dir), K, "x0", "x1", F.lit(2.0))
    return rows.groupBy("page", "island").agg(F.count("*").alias("boxes"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(P + """, o AS (SELECT *, (y0 + y1) / 2 AS cy FROM bx), c AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY page ORDER BY cy, x0) > 1.8 THEN 1 ELSE 0 END AS b FROM o),
  r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY page ORDER BY cy, x0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM c) SELECT page, row, count(*) AS boxes, min(y0) AS y0, max(y1) AS y1 FROM r GROUP BY page, row""")
def row_clusters(spark, sf_dir):
    return X.lines_of(boxes(spark, sf_dir), K, size=4.0).groupBy("page", "row").agg(F.count("*").alias("boxes"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


@query(P + " SELECT page, round(quantile_cont(x0, 0.1), 6) AS p10, round(quantile_cont(x1, 0.9), 6) AS p90 FROM bx GROUP BY page")
def line_p10_p90(spark, sf_dir):
    return X.edge_percentiles(boxes(spark, sf_dir), K).select("page", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query(P + ", w AS (SELECT page, max(x1) AS width, max(y1) AS height FROM bx GROUP BY page), h AS (SELECT *, height / (3 - 2 * 0.25) AS hi FROM w), e AS (SELECT *, unnest(range(0, 3)) AS band FROM h), t AS (SELECT *, greatest(0, CASE WHEN band = 2 THEN height - hi ELSE band * hi * 0.75 END) AS y0 FROM e) SELECT page, band, y0, CASE WHEN band = 2 THEN height ELSE least(height, y0 + hi) END AS y1 FROM t")
def page_bands(spark, sf_dir):
    size = boxes(spark, sf_dir).groupBy("page").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return G.band_boxes(size, 3, 0.25).select("page", "band", "y0", "y1")


@query(P + " SELECT page, box, CAST(CAST(CAST(x0 AS FLOAT) * CAST(2 AS FLOAT) AS FLOAT) + CAST(5 AS FLOAT) AS DOUBLE) AS x, CAST(CAST(CAST(y0 AS FLOAT) * CAST(-1 AS FLOAT) AS FLOAT) + CAST(100 AS FLOAT) AS DOUBLE) AS y FROM bx")
def points_transformed(spark, sf_dir):
    x, y = G.transformed(F.col("x0"), F.col("y0"), (2, 0, 0, -1, 5, 100))
    return boxes(spark, sf_dir).select("page", "box", x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(P + " SELECT page, box, x0 - 1.5 AS x0, y0 - 0.5 AS y0, x1 + 1.5 AS x1, y1 + 0.5 AS y1 FROM bx")
def bbox_expand(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", *G.expand("", 1.5, 0.5))


@query()
def clean_regions(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("text", "table", "figure", "caption"))), (F.col("box") % 4 + 1).cast("int"))
    rows = boxes(spark, sf_dir).select("page", kinds.alias("kind"), "x0", "y0", "x1", "y1", (F.col("x0") / 50).alias("score"))
    return X.clean_regions(rows, K)


CHANNELS = P + """, s AS (SELECT page, CAST(floor(min(x0)) AS BIGINT) AS l, CAST(floor(max(x1)) AS BIGINT) AS r, count(DISTINCT box % 5) AS rows FROM bx GROUP BY page), b AS (SELECT page, l, r, rows, unnest(range(l, r + 1)) AS bin FROM s),
  c AS (SELECT page, bin, count(DISTINCT row) AS k FROM (SELECT page, box % 5 AS row, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS bin FROM bx) GROUP BY page, bin),
  f AS (SELECT b.*, b.bin - row_number() OVER (PARTITION BY b.page ORDER BY b.bin) AS g FROM b LEFT JOIN c ON c.page = b.page AND c.bin = b.bin WHERE coalesce(c.k, 0) <= CASE WHEN rows >= 5 THEN greatest(1, floor(0.2 * rows)) ELSE 0 END)
  SELECT page, min(bin) AS c0, max(bin) + 1 AS c1 FROM f GROUP BY page, g, l, r HAVING min(bin) > l AND max(bin) < r AND max(bin) + 1 - min(bin) >= 2.4"""


@query(CHANNELS)
def column_channels(spark, sf_dir):
    return Tb.channels(boxes(spark, sf_dir).withColumn("row", F.col("box") % 5), K, size=4.0)


QUERIES, ORACLES = query.queries, query.oracles
