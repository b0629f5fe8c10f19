"""Spatial joins: equi-joins on grid cells with an exact residual, and what is built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import to_local
from tessella.operators.annotations import cell_size_filter, polygons
from tessella.storage import stored

Box = tuple[str, str, str, str]


def _cells(df: DataFrame, box: Box, cell: int, reach: float = 0) -> DataFrame:
    """``df`` once for each cell its box touches; never broadcast, for Spark takes exploded rows to be as small as those they come from."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / cell), F.floor((F.col(b) + reach) / cell)))
    return df.withColumn("_cx", span(box[0], box[2])).withColumn("_cy", span(box[1], box[3])).hint("merge")


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], a: Box, b: Box, cell: int, closed: bool = True, reach: float = 0) -> DataFrame:
    """J6. Pairs of rows with equal keys whose boxes (xmin, ymin, xmax, ymax) meet, the left one widened by ``reach``.

    Each row stands in every cell its box touches; a pair is kept only in the cell that holds the
    lower corner of the intersection, so none appears twice. Half-open boxes must share an area.
    Columns besides the keys must differ between the sides.
    """
    x0, y0 = F.greatest(F.col(a[0]) - reach, F.col(b[0])), F.greatest(F.col(a[1]) - reach, F.col(b[1]))
    x1, y1 = F.least(F.col(a[2]) + reach, F.col(b[2])), F.least(F.col(a[3]) + reach, F.col(b[3]))
    meets = (x0 <= x1) & (y0 <= y1) if closed else (x0 < x1) & (y0 < y1)
    here = (F.floor(x0 / cell) == F.col("_cx")) & (F.floor(y0 / cell) == F.col("_cy"))
    return _cells(left, a, cell, reach).join(_cells(right, b, cell), [*keys, "_cx", "_cy"]).filter(meets & here).drop("_cx", "_cy")


def intersection_area(a: Box, b: Box) -> Column:
    """Area that two boxes share, 0 if they don't meet."""
    dx = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((dx >= 0) & (dy >= 0), dx * dy).otherwise(0)


ANN: Box = ("xmin", "ymin", "xmax", "ymax")
RECT: Box = ("rx0", "ry0", "rx1", "ry1")


def regions_in_rect(ann: DataFrame, rects: DataFrame, slack: int = 100, cell: int = 1024) -> DataFrame:
    """J3. Polygons in each rectangle: the points strictly within ``slack`` of it, relative to it; regions without such a point go, the box stays."""
    pairs = bucket_join(rects, ann, ["slide_id"], RECT, ANN, cell, reach=slack)
    inside = lambda p: (p["x"] - F.col("rx0") > -slack) & (p["x"] < F.col("rx1") + slack) & (p["y"] - F.col("ry0") > -slack) & (p["y"] < F.col("ry1") + slack)
    kept = pairs.withColumn("points", F.filter("points", inside)).filter("size(points) > 0")
    return kept.withColumn("points", to_local(F.col("points"), F.col("rx0"), F.col("ry0")))


def neighbours(objects: DataFrame, group: list[str], distance: int = 150) -> DataFrame:
    """J5. (group..., a, b): other objects of the group with centroids at most ``distance`` apart. objects: (group..., obj_id, cy, cx)."""
    cell = lambda d: d.withColumn("_x", F.floor(F.col("cx") / distance)).withColumn("_y", F.floor(F.col("cy") / distance))
    left = cell(objects.select(*group, F.col("obj_id").alias("a"), "cx", "cy"))
    around = F.expr("explode(flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(_x + i as nx, _y + j as ny)))))")
    right = cell(objects.select(*group, F.col("obj_id").alias("b"), "cx", "cy")).withColumn("n", around).select(*group, "b", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("n.nx").alias("_x"), F.col("n.ny").alias("_y")).hint("merge")
    d2 = (F.col("cx") - F.col("bx")) * (F.col("cx") - F.col("bx")) + (F.col("cy") - F.col("by")) * (F.col("cy") - F.col("by"))
    return left.join(right, [*group, "_x", "_y"]).filter((F.col("a") != F.col("b")) & (d2 <= distance * distance)).select(*group, "a", "b", d2.alias("d2"))


def match_object_record(objects: DataFrame, records: DataFrame, group: list[str], cell: int = 256) -> DataFrame:
    """J7. The record that shares most area with each object (the first on ties), else the one with the nearest centre.

    objects: (group..., obj_id, x1, y1, x2, y2); records: (group..., rec_id, xmin, ymin, xmax, ymax).
    Objects that meet no record look for the nearest in cells around them, which grow until it is certain.
    """
    o: Box = ("x1", "y1", "x2", "y2")
    area = intersection_area(o, ANN)
    met = bucket_join(objects, records, group, o, ANN, cell).withColumn("area", area).filter("area > 0")
    best = Window.partitionBy(*group, "obj_id")
    first = met.withColumn("_r", F.row_number().over(best.orderBy(F.desc("area"), "rec_id"))).filter("_r = 1").select(*group, "obj_id", "rec_id", "area")
    left = objects.join(first, [*group, "obj_id"], "left_anti")
    near = _nearest(left, records, group, cell).withColumn("area", F.lit(0).cast(dict(first.dtypes)["area"]))
    return first.unionByName(near)


def _nearest(objects: DataFrame, records: DataFrame, group: list[str], cell: int) -> DataFrame:
    """(group..., obj_id, rec_id): the record with the nearest centre, the first on ties, for each object of a group that has records.

    Each round joins the objects that are left with the records of the nine cells around them; a record
    no farther than a cell's side is the nearest. Then the cells' sides grow fourfold. Centres are in half units.
    """
    at = lambda c, side: F.floor(F.col(c) / side)
    places = stored(records.select(*group, "rec_id", (F.col("xmin") + F.col("xmax")).alias("rx"), (F.col("ymin") + F.col("ymax")).alias("ry")).filter("rx is not null and ry is not null"), "records")
    left = objects.join(places.select(*group).distinct(), group, "left_semi").select(*group, "obj_id", (F.col("x1") + F.col("x2")).alias("ox"), (F.col("y1") + F.col("y2")).alias("oy")).filter("ox is not null and oy is not null")
    left, out, side = stored(left, "unmatched"), left.select(*group, "obj_id", F.lit(None).cast(dict(records.dtypes)["rec_id"]).alias("rec_id")).limit(0), 2 * cell
    while left.limit(1).count():
        around = F.explode(F.array(*(F.struct((at("ox", side) + i).alias("cx"), (at("oy", side) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        spots = left.withColumn("c", around).select(*group, "obj_id", "ox", "oy", "c.*").hint("merge")
        met = spots.join(places.withColumns({"cx": at("rx", side), "cy": at("ry", side)}), [*group, "cx", "cy"])
        gap = (F.col("ox") - F.col("rx")).cast("long") * (F.col("ox") - F.col("rx")) + (F.col("oy") - F.col("ry")).cast("long") * (F.col("oy") - F.col("ry"))
        best = met.groupBy(*group, "obj_id").agg(F.min(F.struct(gap.alias("d"), "rec_id")).alias("b"))
        sure = stored(best.filter(F.col("b.d") <= side * side).select(*group, "obj_id", "b.rec_id"), "nearest")
        out, left, side = out.unionByName(sure), stored(left.join(sure, [*group, "obj_id"], "left_anti"), "unmatched"), side * 4
    return out


def bbox_inside(inner: Box, outer: Box, margin: int = 2) -> Column:
    """L5. Is the inner box wholly inside, ``margin`` from every side?"""
    return (F.col(inner[0]) >= F.col(outer[0]) + margin) & (F.col(inner[2]) <= F.col(outer[2]) - margin) & (F.col(inner[1]) >= F.col(outer[1]) + margin) & (F.col(inner[3]) <= F.col(outer[3]) - margin)


def tiles_covering_records(tiles: DataFrame, records: DataFrame, group: list[str], margin: int = 3, intruders: DataFrame | None = None, cell: int = 512) -> DataFrame:
    """J8. (tile columns, record columns) where the record lies inside the tile; not if its box meets a box of ``intruders(group..., tile_id, ix0, iy0, ix1, iy1)`` of that tile.

    tiles: (group..., tile_id, tx0, ty0, tx1, ty1).
    """
    t: Box = ("tx0", "ty0", "tx1", "ty1")
    found = bucket_join(tiles, records, group, t, ANN, cell).filter(bbox_inside(ANN, t, margin))
    if intruders is None:
        return found
    i = intruders.select(*(F.col(c).alias(f"_{c}") for c in [*group, "tile_id", "ix0", "iy0", "ix1", "iy1"]))
    same = [F.col(c) == F.col(f"_{c}") for c in [*group, "tile_id"]]
    meets = (F.col("_ix0") < F.col("xmax")) & (F.col("_ix1") > F.col("xmin")) & (F.col("_iy0") < F.col("ymax")) & (F.col("_iy1") > F.col("ymin"))
    cond = meets
    for s in same:
        cond = s & cond
    return found.join(i, cond, "left_anti")


def overlay_contours(tiles: DataFrame, rois: DataFrame, mode: str = "corner", cell: int = 512) -> DataFrame:
    """J9. (tile_id, roi_id) of a slide: the region's upper left or lower right corner strictly inside the tile, or, for ``full``, any overlap."""
    t: Box = ("tx0", "ty0", "tx1", "ty1")
    pairs = bucket_join(tiles, rois, ["slide_id"], t, ANN, cell, closed=False)
    if mode != "full":
        inside = lambda x, y: (F.col(x) > F.col("tx0")) & (F.col(x) < F.col("tx1")) & (F.col(y) > F.col("ty0")) & (F.col(y) < F.col("ty1"))
        pairs = pairs.filter(inside("xmin", "ymin") | inside("xmax", "ymax"))
    return pairs


#: Vertices that are compared with their points at once.
VERTICES = 1 << 18


def _against(x: np.ndarray, y: np.ndarray, size: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the k-th polygon, of size[k] vertices, and the k-th point: does it hold the point by the even-odd rule, and the squared distance to its nearest edge. The last vertex joins the first."""
    inside, near = np.zeros(len(size), bool), np.full(len(size), np.inf)
    if not len(x):
        return inside, near
    some, first = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
    follow = np.arange(len(x)) + 1
    follow[first + size[some] - 1] = first
    of = np.repeat(np.arange(len(size)), size)
    dx, dy, ox, oy = x[follow] - x, y[follow] - y, px[of] - x, py[of] - y
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((oy < 0) != (oy < dy)) & (px[of] < dx * oy / dy + x)
        length = dx * dx + dy * dy
        t = np.where(length == 0, 0.0, np.clip((ox * dx + oy * dy) / length, 0.0, 1.0))
    inside[some] = np.add.reduceat(crosses.astype(np.int64), first) % 2 == 1
    near[some] = np.fmin.reduceat((ox - t * dx) ** 2 + (oy - t * dy) ** 2, first)
    return inside, near


def _tested(pairs: DataFrame, columns: list[str], test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``columns`` of the pairs (px, py, _x, _y, ...) whose polygon, given by its vertices' _x and _y, passes the test (inside, squared distance).

    Batches of pairs are tested in Arrow, VERTICES at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("_x", "_y"))
            px, py = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("px", "py"))
            size = pc.fill_null(pc.list_value_length(batch.column("_x")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(size)])
            ends = [0, *(np.flatnonzero(np.diff(cut[1:] // VERTICES)) + 1), len(size)]
            for a, b in zip(ends, ends[1:]):
                part = slice(cut[a], cut[b])
                keep = test(*_against(x[part], y[part], size[a:b], px[a:b], py[a:b]))
                yield batch.select(columns).slice(a, b - a).filter(pa.array(keep))

    return pairs.mapInArrow(run, pairs.select(*columns).schema)


def point_in_polygon(points: DataFrame, polys: DataFrame, group: list[str], cell: int = 256) -> DataFrame:
    """J12. Rows of ``points(group..., px, py)`` with each polygon ``(xmin..ymax, points)`` that strictly holds them."""
    pairs = bucket_join(points, polys, group, ("px", "py", "px", "py"), ANN, cell)
    known = pairs.filter("points is not null").withColumns({"_x": F.col("points.x"), "_y": F.col("points.y")})
    return _tested(known, pairs.columns, lambda inside, d2: inside & (d2 > 0))


def hit_test(points: DataFrame, ann: DataFrame, rectangle: Column, edge: int = 5, slack: int = 4, cell: int = 512) -> DataFrame:
    """J13. (slide_id, point_id, ann_idx): the topmost record at each point: in a polygon or within ``edge`` of its outline, or in a rectangle widened by ``slack``.

    Rectangles meet the points apart from polygons, in wider cells and without vertices, as their box decides.
    """
    at: Box = ("px", "py", "px", "py")
    flat, p = F.coalesce(rectangle, F.lit(False)), points.select("slide_id", "point_id", "px", "py")
    rects = bucket_join(p, ann.filter(flat).select("slide_id", "ann_idx", *ANN), ["slide_id"], at, ANN, 2 * cell, reach=slack)
    polys = ann.filter(~flat & F.col("points").isNotNull()).select("slide_id", "ann_idx", *ANN, F.col("points.x").alias("_x"), F.col("points.y").alias("_y"))
    near = bucket_join(p, polys, ["slide_id"], at, ANN, cell, reach=edge).select("slide_id", "point_id", "ann_idx", "px", "py", "_x", "_y")
    hits = _tested(near, ["slide_id", "point_id", "ann_idx"], lambda inside, d2: inside | (d2 <= edge * edge)).unionByName(rects.select("slide_id", "point_id", "ann_idx"))
    return hits.groupBy("slide_id", "point_id").agg(F.max("ann_idx").alias("ann_idx"))


def intruders(tiles: DataFrame, objects: DataFrame, group: list[str], cell: int = 256) -> DataFrame:
    """J14. Other objects whose box meets the tile, with the side they are on. tiles: (group..., target, tx0, ty0, tx1, ty1)."""
    pairs = bucket_join(tiles, objects, group, ("tx0", "ty0", "tx1", "ty1"), ("x1", "y1", "x2", "y2"), cell).filter("obj_id != target")
    dy = F.col("cy") - F.floor((F.col("ty0") + F.col("ty1")) / 2)
    dx = F.col("cx") - F.floor((F.col("tx0") + F.col("tx1")) / 2)
    side = F.when(F.abs(dy) > F.abs(dx), F.when(dy > 0, "bottom").otherwise("top")).otherwise(F.when(dx > 0, "right").otherwise("left"))
    return pairs.select(*group, "target", "obj_id", side.alias("side"))


def grid_tiles(rects: DataFrame, zooms: tuple[int, ...] = (256, 384, 512), overlap: float = 0.0, min_side: int = 100) -> DataFrame:
    """R1, L4. Tiles of each rectangle for each zoom, clipped at its far edges; those with a side under ``min_side`` go."""
    z = F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.lit(max(1, int(z * (1 - overlap)))).alias("stride")) for z in zooms)))
    d = rects.withColumn("z", z).select(*rects.columns, "z.*").withColumn("h", F.col("ry1") - F.col("ry0")).withColumn("w", F.col("rx1") - F.col("rx0")).filter("h > 0 and w > 0")
    d = d.withColumn("y1", F.explode(F.expr("sequence(0, h - 1, stride)"))).withColumn("x1", F.explode(F.expr("sequence(0, w - 1, stride)")))
    d = d.withColumn("y2", F.least(F.col("y1") + F.col("zoom"), F.col("h"))).withColumn("x2", F.least(F.col("x1") + F.col("zoom"), F.col("w")))
    return d.filter((F.col("y2") - F.col("y1") >= min_side) & (F.col("x2") - F.col("x1") >= min_side)).drop("h", "w", "stride")


def probes(cells: DataFrame, downsample: float, cell: int = 25, chunk: int = 1024) -> DataFrame:
    """R34. (slide_id, cx, cy, px, py): chunk positions inside each preview cell, scaled to level 0; the side is floored to a multiple of ``chunk``."""
    side = int(cell * downsample) // chunk * chunk
    at = F.sequence(F.lit(0), F.lit(max(side - chunk, -1)), F.lit(chunk)) if side >= chunk else F.array().cast("array<int>")
    base = cells.withColumn("_x", (F.col("cx") * cell * F.lit(downsample)).cast("int")).withColumn("_y", (F.col("cy") * cell * F.lit(downsample)).cast("int"))
    return base.withColumn("_i", F.explode(at)).withColumn("_j", F.explode(at)).select("slide_id", "cx", "cy", (F.col("_x") + F.col("_i")).alias("px"), (F.col("_y") + F.col("_j")).alias("py"))


def cell_crops(ann: DataFrame, span: int = 30, trim: int = 2) -> DataFrame:
    """R19. For cells of 100 to 200 pixels a side: the context window widened by ``span``, the output box trimmed by ``trim``, and how many regions the window's mask draws."""
    cells = cell_size_filter(polygons(ann)).select("slide_id", F.col("ann_idx").alias("rect_idx"), F.col("label").alias("rect_name"), (F.col("xmin") - span).alias("rx0"), (F.col("ymin") - span).alias("ry0"), (F.col("xmax") + span).alias("rx1"), (F.col("ymax") + span).alias("ry1"))
    drawn = regions_in_rect(polygons(ann), cells).groupBy("slide_id", "rect_idx").agg(F.count(F.lit(1)).alias("n_regions"))
    out = [(F.col("rx0") + span + trim).alias("x0"), (F.col("ry0") + span + trim).alias("y0"), (F.col("rx1") - span - trim).alias("x1"), (F.col("ry1") - span - trim).alias("y1")]
    return cells.join(drawn, ["slide_id", "rect_idx"], "left").select("slide_id", F.col("rect_idx").alias("ann_idx"), *RECT, *out, F.coalesce("n_regions", F.lit(0)).alias("n_regions"))
