"""Queries of spatial joins and tile grids over annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import is_rect
from tessella.operators import annotations as A
from tessella.operators import spatial as S
from tessella.plans.fixtures import Tables
from tessella.plans.registry import met, query
from tessella.storage import stored

_POLY = "NOT contains(lower(label), 'rect')"
_RECTS = ", rects AS (SELECT slide_id, ann_idx AS rect_idx, xmin AS rx0, ymin AS ry0, xmax AS rx1, ymax AS ry1 FROM fx_annotations WHERE contains(lower(label), 'rect')), polys AS (SELECT * FROM fx_annotations WHERE NOT contains(lower(label), 'rect')) "
_BOX = ("xmin", "ymin", "xmax", "ymax")


def _wide(by: int) -> tuple[str, ...]:
    return (f"xmin - {by}", f"ymin - {by}", f"xmax + {by}", f"ymax + {by}")

def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.annotations()
    return A.rectangles(a), A.polygons(a)

_J3, _J3_ON = met("rects", ("rx0 - 100", "ry0 - 100", "rx1 + 100", "ry1 + 100"), "polys3", _BOX)

@query("j3_regions_in_rect", "fx_regions", """, rects AS (SELECT slide_id, ann_idx AS rect_idx, xmin AS rx0, ymin AS ry0, xmax AS rx1, ymax AS ry1 FROM fx_regions WHERE contains(lower(label), 'rect')), polys3 AS (SELECT * FROM fx_regions WHERE NOT contains(lower(label), 'rect'))""" + _J3 + """,
 k AS (SELECT a.slide_id, rect_idx, ann_idx, rx0, ry0, [p FOR p IN points IF p.x - rx0 > -100 AND p.x < rx1 + 100 AND p.y - ry0 > -100 AND p.y < ry1 + 100] AS q FROM """ + _J3_ON + """)
SELECT slide_id, rect_idx, ann_idx, CAST(len(q) AS INT) AS n_points, CAST(list_sum([p.x - rx0 FOR p IN q]) AS BIGINT) AS sx, CAST(list_sum([p.y - ry0 FOR p IN q]) AS BIGINT) AS sy FROM k WHERE len(q) > 0""")
def _(t: Tables) -> DataFrame:
    rects, polys = _sides(t)
    total = lambda k: F.aggregate("points", F.lit(0).cast("long"), lambda a, v: a + v[k])
    return S.regions_in_rect(polys, rects).select("slide_id", "rect_idx", "ann_idx", F.size("points").alias("n_points"), total("x").alias("sx"), total("y").alias("sy"))

_J5, _J5_ON = met("o", ("cx - 150", "cy - 150", "cx + 150", "cy + 150"), "o", ("cx", "cy", "cx", "cy"))

@query("j5_neighbours", "fx_annotations", _RECTS + ", o AS (SELECT slide_id, ann_idx, (xmin+xmax)//2 AS cx, (ymin+ymax)//2 AS cy FROM polys) " + _J5 + "SELECT a.slide_id, a.ann_idx AS a, b.ann_idx AS b FROM " + _J5_ON + " WHERE a.ann_idx <> b.ann_idx AND sqrt((a.cx-b.cx)**2+(a.cy-b.cy)**2) <= 150")
def _(t: Tables) -> DataFrame:
    o = _sides(t)[1].select("slide_id", F.col("ann_idx").alias("obj_id"), F.expr("(xmin + xmax) div 2").alias("cx"), F.expr("(ymin + ymax) div 2").alias("cy"))
    return S.neighbours(o, ["slide_id"], 150).select("slide_id", "a", "b")

_HALVES = ", a AS (SELECT * FROM fx_annotations WHERE label <> 'normal' AND NOT contains(label, 'rect')), b AS (SELECT * FROM fx_annotations WHERE label = 'normal') "

def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.annotations()
    left = A.polygons(a).filter("label != 'normal'").select("slide_id", F.col("ann_idx").alias("a"), *(F.col(c).alias(f"a_{c}") for c in S.ANN))
    return left, a.filter("label = 'normal'").select("slide_id", F.col("ann_idx").alias("b"), *S.ANN)

_ABOX = ("a_xmin", "a_ymin", "a_xmax", "a_ymax")

_J6, _J6_ON = met("a", _BOX, "b", _BOX)

@query("j6_bbox_intersects", "fx_annotations", _HALVES + _J6 + "SELECT a.slide_id, a.ann_idx AS a, b.ann_idx AS b, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS area FROM " + _J6_ON + " WHERE a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")
def _(t: Tables) -> DataFrame:
    a, b = _halves(t)
    return S.bucket_join(a, b, ["slide_id"], _ABOX, S.ANN, 256).select("slide_id", "a", "b", S.intersection_area(_ABOX, S.ANN).alias("area"))

@query("j6_bbox_intersects_half_open", "fx_annotations", _HALVES + _J6 + "SELECT a.slide_id, a.ann_idx AS a, b.ann_idx AS b FROM " + _J6_ON + " WHERE a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax")
def _(t: Tables) -> DataFrame:
    a, b = _halves(t)
    return S.bucket_join(a, b, ["slide_id"], _ABOX, S.ANN, 256, closed=False).select("slide_id", "a", "b")

@query("j7_match_object_record", "fx_annotations", _HALVES + """, p AS (SELECT slide_id, b.ann_idx AS obj_id, a.ann_idx AS rec_id, CASE WHEN least(a.xmax, b.xmax) >= greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) >= greatest(a.ymin, b.ymin)
 THEN (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) ELSE 0 END AS area, (a.xmin+a.xmax-b.xmin-b.xmax)**2 + (a.ymin+a.ymax-b.ymin-b.ymax)**2 AS d FROM b JOIN a USING (slide_id))
SELECT slide_id, obj_id, rec_id, CAST(area AS INT) AS area FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, obj_id ORDER BY area DESC, CASE WHEN area > 0 THEN 0 ELSE d END, rec_id) AS r FROM p) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    a, b = _halves(t)
    objects = b.select("slide_id", F.col("b").alias("obj_id"), *(F.col(c).alias(d) for c, d in zip(S.ANN, ("x1", "y1", "x2", "y2"), strict=True)))
    records = a.select("slide_id", F.col("a").alias("rec_id"), *(F.col(c).alias(d) for c, d in zip(_ABOX, S.ANN, strict=True)))
    return S.match_object_record(objects, records, ["slide_id"])

_GRID = _RECTS + ", tiles AS (SELECT slide_id, rect_idx, zoom, i AS y1, j AS x1, least(i + zoom, ry1 - ry0) AS y2, least(j + zoom, rx1 - rx0) AS x2, rx0, ry0 FROM rects, (VALUES (256), (384), (512)) z(zoom), LATERAL (SELECT unnest(range(0, ry1 - ry0, zoom)) AS i), LATERAL (SELECT unnest(range(0, rx1 - rx0, zoom)) AS j)) "

@query("r1_grid_tiles", "fx_annotations", _GRID + "SELECT slide_id, rect_idx, CAST(zoom AS INT) AS zoom, CAST(y1 AS INT) AS y1, CAST(x1 AS INT) AS x1, CAST(y2 AS INT) AS y2, CAST(x2 AS INT) AS x2 FROM tiles WHERE y2 - y1 >= 100 AND x2 - x1 >= 100")
def _(t: Tables) -> DataFrame:
    return S.grid_tiles(_sides(t)[0]).select("slide_id", "rect_idx", "zoom", "y1", "x1", "y2", "x2")

@query("l4_min_tile_side", "fx_annotations", _GRID + "SELECT zoom::INT AS zoom, COUNT(*) AS n, min(least(y2 - y1, x2 - x1))::INT AS shortest FROM tiles WHERE y2 - y1 >= 100 AND x2 - x1 >= 100 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.grid_tiles(_sides(t)[0]).groupBy("zoom").agg(F.count(F.lit(1)).alias("n"), F.min(F.least(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))).alias("shortest"))

def _tiles(t: Tables) -> DataFrame:
    g = S.grid_tiles(_sides(t)[0], (512,), 0.0)
    name = F.concat_ws("_", F.col("rect_idx").cast("string"), F.col("y1").cast("string"), F.col("x1").cast("string"))
    return g.select("slide_id", name.alias("tile_id"), (F.col("rx0") + F.col("x1")).alias("tx0"), (F.col("ry0") + F.col("y1")).alias("ty0"), (F.col("rx0") + F.col("x2")).alias("tx1"), (F.col("ry0") + F.col("y2")).alias("ty1"))

_T512 = _GRID + ", t AS (SELECT slide_id, concat_ws('_', rect_idx, y1, x1) AS tile_id, rx0 + x1 AS tx0, ry0 + y1 AS ty0, rx0 + x2 AS tx1, ry0 + y2 AS ty1 FROM tiles WHERE zoom = 512 AND y2 - y1 >= 100 AND x2 - x1 >= 100) "

@query("j8_tiles_covering_records", "fx_annotations", _T512 + """, c AS (SELECT slide_id, tile_id, ann_idx, xmin, ymin, xmax, ymax FROM t JOIN polys USING (slide_id) WHERE xmin >= tx0 + 3 AND xmax <= tx1 - 3 AND ymin >= ty0 + 3 AND ymax <= ty1 - 3)
SELECT slide_id, tile_id, ann_idx FROM c WHERE NOT EXISTS (SELECT 1 FROM c i WHERE i.slide_id = c.slide_id AND i.tile_id = c.tile_id AND i.ann_idx % 5 = 0 AND i.ann_idx <> c.ann_idx AND c.ann_idx % 5 <> 0 AND i.xmin < c.xmax AND i.xmax > c.xmin AND i.ymin < c.ymax AND i.ymax > c.ymin) AND c.ann_idx % 5 <> 0""")
def _(t: Tables) -> DataFrame:
    tiles, polys = _tiles(t), _sides(t)[1]
    inside = S.tiles_covering_records(tiles, polys, ["slide_id"])
    masked = inside.filter("ann_idx % 5 = 0").select("slide_id", "tile_id", *(F.col(c).alias(d) for c, d in zip(S.ANN, ("ix0", "iy0", "ix1", "iy1"), strict=True)))
    return S.tiles_covering_records(tiles, polys.filter("ann_idx % 5 != 0"), ["slide_id"], intruders=masked).select("slide_id", "tile_id", "ann_idx")

_CORNERS = "(xmin > tx0 AND xmin < tx1 AND ymin > ty0 AND ymin < ty1 OR xmax > tx0 AND xmax < tx1 AND ymax > ty0 AND ymax < ty1)"

@query("j9_overlay_contours", "fx_annotations", _T512 + f"SELECT slide_id, tile_id, ann_idx FROM t JOIN polys USING (slide_id) WHERE {_CORNERS}")
def _(t: Tables) -> DataFrame:
    return S.overlay_contours(_tiles(t), _sides(t)[1]).select("slide_id", "tile_id", "ann_idx")

@query("l5_bbox_inside", "fx_annotations", _T512 + "SELECT slide_id, tile_id, COUNT(*) AS n FROM t JOIN polys USING (slide_id) WHERE xmin >= tx0 + 2 AND xmax <= tx1 - 2 AND ymin >= ty0 + 2 AND ymax <= ty1 - 2 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return S.tiles_covering_records(_tiles(t), _sides(t)[1], ["slide_id"], margin=2).groupBy("slide_id", "tile_id").agg(F.count(F.lit(1)).alias("n"))

_EDGES = ", e AS (SELECT slide_id, ann_idx, label, xmin, ymin, xmax, ymax, points[k] AS p, points[k % 6 + 1] AS q FROM fx_regions, range(1, 7) r(k)) "
_EVEN = "sum(CASE WHEN (p.y > py) <> (q.y > py) AND px < (q.x - p.x) * (py - p.y) / (q.y - p.y) + p.x THEN 1 ELSE 0 END) % 2 = 1"
_SEG = "min((px-p.x-tt*(q.x-p.x))**2 + (py-p.y-tt*(q.y-p.y))**2)"
_TT = "greatest(0, least(1, ((px-p.x)*(q.x-p.x) + (py-p.y)*(q.y-p.y)) / nullif(((q.x-p.x)**2 + (q.y-p.y)**2), 0)))"

def _centres(ann: DataFrame) -> DataFrame:
    return ann.select("slide_id", F.col("ann_idx").alias("point_id"), (F.col("xmin") + 11).alias("px"), (F.col("ymin") + 7).alias("py"))

_POINTS = ", pts AS (SELECT slide_id, ann_idx AS point_id, xmin + 11 AS px, ymin + 7 AS py FROM fx_regions) "

@query("j12_point_in_polygon", "fx_regions", _EDGES + _POINTS + f", c AS (SELECT slide_id, point_id, ann_idx, px, py, p, q, {_TT} AS tt FROM pts JOIN e USING (slide_id) WHERE NOT contains(label, 'rect') AND px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax) SELECT slide_id, point_id, ann_idx FROM c GROUP BY 1, 2, 3 HAVING {_EVEN} AND {_SEG} > 0")
def _(t: Tables) -> DataFrame:
    a = stored(t.annotations(), "annotations")
    return S.point_in_polygon(_centres(a), A.polygons(a), ["slide_id"]).select("slide_id", "point_id", "ann_idx")

@query("j13_hit_test", "fx_regions", _EDGES + _POINTS + f""", c AS (SELECT slide_id, point_id, ann_idx, label, xmin, ymin, xmax, ymax, px, py, p, q, {_TT} AS tt FROM pts JOIN e USING (slide_id) WHERE px BETWEEN xmin - 5 AND xmax + 5 AND py BETWEEN ymin - 5 AND ymax + 5),
 h AS (SELECT slide_id, point_id, ann_idx, any_value(contains(label, 'rect')) AS is_rect, any_value(px BETWEEN xmin - 4 AND xmax + 4 AND py BETWEEN ymin - 4 AND ymax + 4) AS in_rect, {_EVEN} OR {_SEG} <= 25 AS in_poly FROM c GROUP BY 1, 2, 3)
SELECT slide_id, point_id, max(ann_idx) AS ann_idx FROM h WHERE CASE WHEN is_rect THEN in_rect ELSE in_poly END GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    a = stored(t.annotations(), "annotations")
    return S.hit_test(_centres(a), a, is_rect(F.col("label")))

_J14, _J14_ON = met("o", _wide(30), "o", _BOX)

@query("j14_intruders", "fx_annotations", _RECTS + """, o AS (SELECT slide_id, ann_idx AS obj_id, xmin, ymin, xmax, ymax, (xmin+xmax)//2 AS cx, (ymin+ymax)//2 AS cy FROM polys),
""" + _J14[2:] + """, p AS (SELECT a.slide_id, a.obj_id AS target, b.obj_id, b.cy - (a.ymin - 30 + a.ymax + 30)//2 AS dy, b.cx - (a.xmin - 30 + a.xmax + 30)//2 AS dx FROM """ + _J14_ON + """ WHERE a.obj_id <> b.obj_id AND b.xmax >= a.xmin - 30 AND b.xmin <= a.xmax + 30 AND b.ymax >= a.ymin - 30 AND b.ymin <= a.ymax + 30)
SELECT slide_id, target, obj_id, CASE WHEN abs(dy) > abs(dx) THEN CASE WHEN dy > 0 THEN 'bottom' ELSE 'top' END WHEN dx > 0 THEN 'right' ELSE 'left' END AS side FROM p""")
def _(t: Tables) -> DataFrame:
    p = _sides(t)[1]
    o = p.select("slide_id", F.col("ann_idx").alias("obj_id"), F.col("xmin").alias("x1"), F.col("ymin").alias("y1"), F.col("xmax").alias("x2"), F.col("ymax").alias("y2"), F.expr("(xmin + xmax) div 2").alias("cx"), F.expr("(ymin + ymax) div 2").alias("cy"))
    tiles = p.select("slide_id", F.col("ann_idx").alias("target"), (F.col("xmin") - 30).alias("tx0"), (F.col("ymin") - 30).alias("ty0"), (F.col("xmax") + 30).alias("tx1"), (F.col("ymax") + 30).alias("ty1"))
    return S.intruders(tiles, o, ["slide_id"])

@query("r19_cell_crops", "fx_regions", """, c AS (SELECT slide_id, ann_idx, xmin - 30 AS rx0, ymin - 30 AS ry0, xmax + 30 AS rx1, ymax + 30 AS ry1 FROM fx_regions WHERE NOT contains(lower(label), 'rect') AND xmax - xmin BETWEEN 100 AND 200 AND ymax - ymin BETWEEN 100 AND 200),
 n AS (SELECT c.slide_id, c.ann_idx, COUNT(*) AS n FROM c JOIN fx_regions r ON c.slide_id = r.slide_id WHERE NOT contains(lower(r.label), 'rect') AND len([p FOR p IN points IF p.x - rx0 > -100 AND p.x < rx1 + 100 AND p.y - ry0 > -100 AND p.y < ry1 + 100]) > 0 GROUP BY 1, 2)
SELECT c.slide_id, c.ann_idx, rx0, ry0, rx1, ry1, rx0 + 32 AS x0, ry0 + 32 AS y0, rx1 - 32 AS x1, ry1 - 32 AS y1, coalesce(n, 0) AS n_regions FROM c LEFT JOIN n USING (slide_id, ann_idx)""")
def _(t: Tables) -> DataFrame:
    return S.cell_crops(t.annotations())

@query("r34_probes", "fx_annotations", ", c AS (SELECT DISTINCT slide_id, CAST(xmin // 500 AS INT) AS cx, CAST(ymin // 500 AS INT) AS cy FROM fx_annotations) SELECT slide_id, cx, cy, CAST(trunc(cx * 25 * 128.7::DOUBLE) AS INT) + i::INT AS px, CAST(trunc(cy * 25 * 128.7::DOUBLE) AS INT) + j::INT AS py FROM c, range(0, 3072, 1024) a(i), range(0, 3072, 1024) b(j)")
def _(t: Tables) -> DataFrame:
    cells = t.annotations().select("slide_id", F.expr("xmin div 500").cast("int").alias("cx"), F.expr("ymin div 500").cast("int").alias("cy")).distinct()
    return S.probes(cells, 128.7)
