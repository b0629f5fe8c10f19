"""Placing training tiles around objects of a mask so that none is cut by a tile's edge.

objects: (img_id, obj_id, cy, cx, y1, x1, y2, x2, ...) with inclusive boxes; images: (img_id, height,
width); runs: (img_id, y, x0, x1) of abnormal pixels; integral: their integral image. Tiles are
half-open squares (y1, x1, size).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import first_independent
from tessella.operators.ranking import hash_key
from tessella.operators.spatial import neighbours
from tessella.operators.sums import rect_sum, ring_sum, search_places
from tessella.operators.tiling import extract_padded
from tessella.storage import spread, stored

#: Defaults of all placements.
PADDING, MIN_PADDING, PADDING_STEP, MAX_EXPAND, EXPAND_STEP, MARGIN, MIN_TILE = 30, 10, 5, 200, 10, 3, 60


def _pads(padding: int, least: int, step: int) -> Column:
    top, low = max(padding, least), max(least, 0)
    return F.array(*(F.lit(p) for p in range(top, low - 1, -max(step, 1))))


def _side(box: tuple[str, str, str, str], pad: Column, min_tile: int) -> Column:
    y1, x1, y2, x2 = (F.col(c) for c in box)
    return F.greatest(F.greatest(y2 - y1, x2 - x1) + 2 * pad, F.lit(min_tile))


def _clamped(at: Column, size: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(at, most - size)).cast("int")


def center_tile(objects: DataFrame, padding: int = PADDING, min_tile: int = MIN_TILE) -> DataFrame:
    """R25. A square centred on the object's centroid, which may leave the image."""
    size = _side(("y1", "x1", "y2", "x2"), F.lit(padding), min_tile)
    half = F.floor(size / 2)
    return objects.select("img_id", "obj_id", (F.col("cy") - half).cast("int").alias("ty"), (F.col("cx") - half).cast("int").alias("tx"), size.cast("int").alias("size")).withColumnsRenamed({"ty": "y1", "tx": "x1"})


def tile_for_objects(objects: DataFrame, images: DataFrame, padding: int = PADDING, min_tile: int = 100) -> DataFrame:
    """R29. A padded square around the object's box, moved into the image; objects for which it is too large are left out."""
    size = _side(("y1", "x1", "y2", "x2"), F.lit(padding), min_tile)
    d = objects.join(images, "img_id").withColumn("size", size.cast("int")).filter("size <= height and size <= width")
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2) - F.floor(F.col("size") / 2)
    return d.select("img_id", "obj_id", _clamped(mid("y1", "y2"), F.col("size"), F.col("height")).alias("ty"), _clamped(mid("x1", "x2"), F.col("size"), F.col("width")).alias("tx"), "size").withColumnsRenamed({"ty": "y1", "tx": "x1"})


def truncation_check(tiles: DataFrame, runs: DataFrame, key: list[str], margin: int = MARGIN) -> DataFrame:
    """R26. The keys of tiles that have an abnormal pixel in the band of ``margin`` inside their edges."""
    t = tiles.select("img_id", *key, "y1", "x1", "size", F.explode(F.expr("sequence(y1, y1 + size - 1)")).alias("y"))
    d = t.join(runs.select("img_id", "y", "x0", F.col("x1").alias("xb")), ["img_id", "y"])
    last = F.col("x1") + F.col("size") - 1
    meets = lambda a, b: (F.col("x0") <= b) & (F.col("xb") >= a)
    level = (F.col("y") < F.col("y1") + margin) | (F.col("y") >= F.col("y1") + F.col("size") - margin)
    sides = meets(F.col("x1"), F.least(F.col("x1") + margin - 1, last)) | meets(F.greatest(last - margin + 1, F.col("x1")), last)
    return d.filter((level & meets(F.col("x1"), last)) | sides).select("img_id", *key).distinct()


def fit_tile(groups: DataFrame, images: DataFrame, table: DataFrame, padding: int = PADDING, min_padding: int = MIN_PADDING, step: int = PADDING_STEP, expand: int = MAX_EXPAND, expand_step: int = EXPAND_STEP, margin: int = MARGIN, min_tile: int = MIN_TILE) -> DataFrame:
    """R22. (img_id, obj_id, y1, x1, size): for each box (img_id, obj_id, y1, x1, y2, x2) the first square around it without an abnormal pixel in its edge band, by padding from large to small, then by growth. Boxes are distinct; a square takes eight look-ups in the table."""
    size = _side(("by1", "bx1", "by2", "bx2"), F.col("pad"), min_tile) + F.col("extra")
    c = groups.select("img_id", "obj_id", *(F.col(k).alias(f"b{k}") for k in ("y1", "x1", "y2", "x2"))).join(images, "img_id")
    c = c.withColumn("pad", F.explode(_pads(padding, min_padding, step))).withColumn("extra", F.explode(F.sequence(F.lit(0), F.lit(expand), F.lit(expand_step))))
    c = c.withColumn("size", size.cast("int")).filter("size <= height and size <= width")
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2) - F.floor(F.col("size") / 2)
    c = c.withColumn("y1", _clamped(mid("by1", "by2"), F.col("size"), F.col("height"))).withColumn("x1", _clamped(mid("bx1", "bx2"), F.col("size"), F.col("width")))
    clean = ring_sum(c.select("img_id", "obj_id", "pad", "extra", "y1", "x1", "size"), table, margin).filter("ring = 0")
    first = F.row_number().over(Window.partitionBy("img_id", "obj_id").orderBy(F.desc("pad"), "extra"))
    return clean.withColumn("_r", first).filter("_r = 1").select("img_id", "obj_id", "y1", "x1", "size")


def ranges(objects: DataFrame, images: DataFrame, padding: int, min_padding: int, step: int, margin: int, min_tile: int) -> DataFrame:
    """(img_id, obj_id, pads): for each padding the size of its square, the first and last place (ya to yz, xa to xz) at which it holds the object, ``margin`` from its edges, and the centred place (yc, xc). Paddings without a place are left out."""
    o = spread(objects.select("img_id", "obj_id", "cy", "cx", *(F.col(k).alias(f"b{k}") for k in ("y1", "x1", "y2", "x2"))).join(images, "img_id"), "img_id", "obj_id")

    def one(pad: Column) -> Column:
        size = _side(("by1", "bx1", "by2", "bx2"), pad, min_tile).cast("int")
        out = [pad.alias("pad"), size.alias("size")]
        for a, most, c in (("y", "height", "cy"), ("x", "width", "cx")):
            first, last = F.greatest(F.lit(0), F.col(f"b{a}2") + max(margin, 1) - size), F.least(F.col(f"b{a}1") - margin, F.col(most) - size)
            out += [first.alias(f"{a}a"), last.alias(f"{a}z"), F.least(F.greatest((F.col(c) - F.floor(size / 2)).cast("int"), first), last).alias(f"{a}c")]
        return F.struct(*out)

    fits = F.filter(F.transform(_pads(padding, min_padding, step), one), lambda p: (p["size"] <= F.col("height")) & (p["size"] <= F.col("width")) & (p["ya"] <= p["yz"]) & (p["xa"] <= p["xz"]))
    return o.select("img_id", "obj_id", fits.alias("pads"))


def _first(p: dict, ys: np.ndarray, xs: np.ndarray, keep: np.ndarray, *rank: np.ndarray) -> tuple | None:
    """Of the places to ``keep`` the least by ``rank``, then distance from the centred place, then row and column: (ranks..., distance, place)."""
    y, x = np.nonzero(keep)
    if not len(y):
        return None
    far = (ys[y] - p["yc"]) ** 2 + (xs[x] - p["xc"]) ** 2
    ranks = [r[y, x] for r in rank]
    k = np.lexsort((xs[x], ys[y], far, *ranks[::-1]))[0]
    return (*(r[k] for r in ranks), far[k], ys[y[k]], xs[x[k]])


def ring_placement(objects: DataFrame, images: DataFrame, table: DataFrame, padding: int = PADDING, min_padding: int = MIN_PADDING, step: int = PADDING_STEP, margin: int = MARGIN, min_tile: int = MIN_TILE) -> DataFrame:
    """R23. The place whose edge band holds no abnormal pixel: largest padding, then nearest to the centre, then by row and column. table: `sums.summed_area` of the abnormal pixels."""

    def best(p: dict, ys: np.ndarray, xs: np.ndarray, sums: np.ndarray) -> tuple | None:
        one = _first(p, ys, xs, sums == 0 if margin > 0 else np.ones(sums.shape, bool))
        return one and (-p["pad"], *one, p["size"])

    d = search_places(ranges(objects, images, padding, min_padding, step, margin, min_tile), table, margin, 1, best, "struct<less:int,dist:long,y1:int,x1:int,size:int>")
    return d.select("img_id", "obj_id", "found.y1", "found.x1", "found.size")


def force_placement(objects: DataFrame, images: DataFrame, table: DataFrame, padding: int = PADDING, min_padding: int = MIN_PADDING, step: int = PADDING_STEP, min_tile: int = MIN_TILE) -> DataFrame:
    """R24. The place that holds fewest pixels of other objects, then nearest to the centre, over all paddings. Tiles hold the whole object, so its own pixels don't matter for the order."""

    def best(p: dict, ys: np.ndarray, xs: np.ndarray, sums: np.ndarray) -> tuple | None:
        one = _first(p, ys, xs, np.ones(sums.shape, bool), sums)
        return one and (one[0], one[1], -p["pad"], one[2], one[3], p["size"])

    d = search_places(ranges(objects, images, padding, min_padding, step, 0, min_tile), table, 0, 1, best, "struct<n:long,dist:long,less:int,y1:int,x1:int,size:int>")
    return d.select("img_id", "obj_id", "found.y1", "found.x1", "found.size")


def avoid_pathology(tiles: DataFrame, images: DataFrame, table: DataFrame, step: int = 10) -> DataFrame:
    """R30. Tiles (img_id, obj_id, y1, x1, size) moved to the nearest place without abnormal pixels on a lattice of ``step`` within one tile's size; those without one are left out. shifted tells."""
    d = spread(tiles.join(images, "img_id").filter("size <= height and size <= width"), "img_id", "obj_id")
    steps = lambda room: F.least(F.expr(f"size div {step}"), F.floor(room / step))
    place = lambda a, most: ((F.col(a) - steps(F.col(a)) * step).cast("int"), (F.col(a) + steps(F.col(most) - F.col("size") - F.col(a)) * step).cast("int"))
    (ya, yz), (xa, xz) = place("y1", "height"), place("x1", "width")
    pads = F.array(F.struct(F.col("size").cast("int").alias("size"), ya.alias("ya"), yz.alias("yz"), xa.alias("xa"), xz.alias("xz"), F.col("y1").cast("int").alias("yc"), F.col("x1").cast("int").alias("xc")))
    d = d.filter((F.col("y1") >= 0) & (F.col("x1") >= 0) & (F.col("y1") + F.col("size") <= F.col("height")) & (F.col("x1") + F.col("size") <= F.col("width")))

    def best(p: dict, ys: np.ndarray, xs: np.ndarray, sums: np.ndarray) -> tuple | None:
        one = _first(p, ys, xs, sums == 0)
        return one and (*one, p["size"])

    d = search_places(d.select("img_id", "obj_id", pads.alias("pads")), table, 0, step, best, "struct<dist:long,y1:int,x1:int,size:int>")
    return d.select("img_id", "obj_id", "found.y1", "found.x1", "found.size", (F.col("found.dist") != 0).alias("shifted"))


def normal_quota(normals: DataFrame, base: DataFrame, mode: str = "match", multiplier: float = 1.0) -> DataFrame:
    """W15. ``normals`` (img_id, obj_id, placed) with kept: placed ones in object order until the image's target is met. base: (img_id, n) tiles of abnormal objects.

    The target is all normals (``all``), the half-even rounded multiple of n (``multiplier``), or n but
    at least 5. Failed placements use no quota.
    """
    n = F.coalesce("n", F.lit(0))
    w = Window.partitionBy("img_id").orderBy("obj_id")
    target = F.count(F.lit(1)).over(Window.partitionBy("img_id")) if mode == "all" else F.greatest(F.bround(n * multiplier), F.lit(0)) if mode == "multiplier" else F.greatest(n, F.lit(5))
    done = F.coalesce(F.sum(F.col("placed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return normals.join(base, "img_id", "left").withColumn("target", target.cast("long")).withColumn("skipped", done >= F.col("target")).withColumn("kept", F.col("placed") & ~F.col("skipped")).drop("n")


def backfill_normals(pixels: DataFrame, deficit: DataFrame, images: DataFrame, table: DataFrame, taken: DataFrame, size: int = 100, seed: int = 42, tries: int | None = 200, tries_each: int = 80) -> DataFrame:
    """R31. (img_id, seq, y1, x1, size): clean tiles centred on normal pixels, drawn by a hash, until each image's deficit (img_id, n) is met.

    At most max(``tries``, ``tries_each`` * n) pixels of an image are tried, or all of them if ``tries`` is None, so that the
    deficit is met wherever the image allows it; places already ``taken`` are passed over.
    """
    side = max(size, 60) if size >= 60 else size
    d = pixels.select("img_id", "y", "x").join(deficit.filter("n > 0"), "img_id").join(images, "img_id").filter((F.col("height") >= side) & (F.col("width") >= side))
    try_no = F.row_number().over(Window.partitionBy("img_id").orderBy(hash_key(seed, F.concat_ws(":", "img_id", "y", "x")), "y", "x"))
    d = d.withColumn("_t", try_no)
    if tries is not None:
        d = d.filter(F.col("_t") <= F.greatest(F.lit(tries), tries_each * F.col("n")))
    place = lambda c, most: _clamped(F.col(c) - side // 2, F.lit(side), F.col(most))
    d = d.select("img_id", "n", "_t", place("y", "height").alias("y1"), place("x", "width").alias("x1"), F.lit(side).alias("size")).withColumns({"y2": F.col("y1") + side, "x2": F.col("x1") + side})
    d = rect_sum(d.groupBy("img_id", "n", "y1", "x1", "y2", "x2", "size").agg(F.min("_t").alias("_t")), table).filter("total = 0").join(taken.select("img_id", "y1", "x1", "size").distinct(), ["img_id", "y1", "x1", "size"], "left_anti")
    seq = F.row_number().over(Window.partitionBy("img_id").orderBy("_t"))
    return d.withColumn("seq", seq).filter("seq <= n").select("img_id", F.col("seq").alias("seq"), "y1", "x1", "size")


def greedy_groups(objects: DataFrame, images: DataFrame, table: DataFrame, distance: int = 150, **fit: int) -> DataFrame:
    """R21. (img_id, obj_id, status, y1, x1, size): in id order, an unused object with neighbours seeds a group.

    The group of every object and the tile that fits it are worked out in parallel. A tile uses all
    objects of its group, a failed fit leaves them free, so an object is a seed if no smaller neighbour with a tile is one: seeds are
    chosen by `graph.first_independent`, in squares of sixteen distances. Of equal tiles of an image the first is saved.
    """
    pairs = neighbours(objects, ["img_id"], distance).select("img_id", "a", "b")
    whole = pairs.union(pairs.select("img_id", "a", F.col("a").alias("b")).distinct())
    boxes = whole.join(objects.select("img_id", F.col("obj_id").alias("b"), "y1", "x1", "y2", "x2"), ["img_id", "b"])
    groups = stored(boxes.groupBy("img_id", F.col("a").alias("obj_id")).agg(F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2")), "groups")
    tiles = stored(groups.select("img_id", "obj_id").join(fit_tile(groups, images, table, **fit), ["img_id", "obj_id"], "left"), "tiles")
    nodes = tiles.join(objects.select("img_id", "obj_id", "cx", "cy"), ["img_id", "obj_id"]).select("img_id", F.col("obj_id").alias("node"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("size").isNotNull().alias("able"))
    seeds = first_independent(nodes, pairs.filter("b < a"), "img_id", 16 * distance).filter("free").select("img_id", F.col("node").alias("obj_id"))
    again = F.row_number().over(Window.partitionBy("img_id", "y1", "x1", "size").orderBy("obj_id")) > 1
    status = F.when(F.col("size").isNull(), "failed_truncation").when(again, "failed_duplicate").otherwise("saved")
    return tiles.join(seeds, ["img_id", "obj_id"]).select("img_id", "obj_id", status.alias("status"), "y1", "x1", "size")


PHASES = {"grp": 0, "ind": 1, "norm": 2}


def union_phases(groups: DataFrame, individual: DataFrame, normal: DataFrame) -> DataFrame:
    """U4. The tiles of the three phases, with kind."""
    kinds = ((groups, "grp"), (individual, "ind"), (normal, "norm"))
    parts = [d.withColumn("kind", F.lit(k)) if "kind" not in d.columns else d for d, k in kinds]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def dedup_tiles(tiles: DataFrame) -> DataFrame:
    """U3. ``tiles`` (img_id, kind, obj_id, y1, x1, size, forced) with duplicate: an earlier phase, or an earlier object of the same, has the same square. Forced tiles never are."""
    phase = F.element_at(F.create_map(*(F.lit(v) for kv in PHASES.items() for v in kv)), F.col("kind"))
    first = F.row_number().over(Window.partitionBy("img_id", "y1", "x1", "size").orderBy(phase, "obj_id"))
    return tiles.withColumn("duplicate", (first > 1) & ~F.coalesce("forced", F.lit(False)))


def mask_intruders(tile_pixels: DataFrame, target: str, component: str = "component", seed: int = 42) -> DataFrame:
    """R27. Pixels (tile_id, ..., component, cls, value) with other objects than the target as background, black or white in the image by a hash of the tile."""
    other = F.col(component).isNotNull() & (F.col(component) != F.col(target))
    white = F.when(F.substring(hash_key(seed, F.col("tile_id")), 1, 1) < "8", 0).otherwise(255)
    return tile_pixels.withColumn("cls", F.when(other, 0).otherwise(F.col("cls"))).withColumn("value", F.when(other, white).otherwise(F.col("value")))


def crop_stats(tiles: DataFrame) -> DataFrame:
    """A21. One row of counters over candidates (phase, status): saved and failed by reason, and the rate of saved ones in percent."""
    count = lambda p, s: F.coalesce(F.sum(((F.col("phase") == p) & (F.col("status") == s)).cast("long")), F.lit(0)).alias(f"{p}_{s}")
    names = [("greedy", ("saved", "failed_truncation", "failed_duplicate")), ("ind", ("isolated", "fallback", "forced", "failed_truncation", "failed_duplicate")), ("norm", ("saved", "shifted", "backfill", "failed_pathology", "failed_duplicate", "skipped_limit"))]
    good = F.sum(F.col("status").isin("saved", "isolated", "fallback", "forced", "shifted", "backfill").cast("long"))
    rate = F.round(F.coalesce(100.0 * good / F.count(F.lit(1)), F.lit(0.0)), 6)
    return tiles.agg(*(count(p, s) for p, ss in names for s in ss), rate.alias("success_rate"))


def extraction_coverage(records: DataFrame, covered: DataFrame) -> DataFrame:
    """A22. ``records`` (img_id, rec_id) with tiles, the sum over ``covered`` (img_id, rec_id, n), and extracted."""
    n = covered.groupBy("img_id", "rec_id").agg(F.sum("n").alias("tiles"))
    return records.join(n, ["img_id", "rec_id"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(0)).cast("long")).withColumn("extracted", F.col("tiles") > 0)


def padded_tile(tiles: DataFrame, pixels: DataFrame, side: int) -> DataFrame:
    """R28 for image and mask together: white image, background mask beyond the frame."""
    return extract_padded(tiles, pixels, side, {"value": 255, "cls": 0})
