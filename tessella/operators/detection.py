"""From probability maps to detections, regions and their statistics. Maps: (img_id, y, x, p0, p1, p2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.pixels import argmax
from tessella.operators import raster as R


def best(df: DataFrame) -> DataFrame:
    """With pred, the class of the greatest probability."""
    return df.withColumn("pred", argmax(F.array("p0", "p1", "p2")))


def _runs_of(df: DataFrame, condition: Column) -> DataFrame:
    return R.run_length_encode(df.withColumn("cls", F.lit(1)), where=condition).drop("cls")


def suspicious_components(df: DataFrame, threshold: float) -> DataFrame:
    """R37. Runs of the non-background components (8-connected, class 1 or 2 greatest) that hold a pixel with p2 >= threshold. The map is read once: its runs say whether they hold one."""
    runs = R.run_length_encode(best(df).withColumn("cls", F.lit(1)), where=F.col("pred") > 0, mark=F.col("p2") >= threshold).drop("cls")
    lab = R.connected_components(runs, 8)
    red = lab.filter("marked").select("img_id", "component").distinct()
    return lab.drop("marked").join(red, ["img_id", "component"], "left_semi")


def confident_regions(df: DataFrame, threshold: float) -> DataFrame:
    """R35. Runs of components (8-connected) of p2 > threshold, with threshold; an image without one is tried again at max(0.3, 0.75 threshold)."""
    low = max(0.3, 0.75 * threshold)
    top = df.groupBy("img_id").agg((F.max("p2") > threshold).alias("_ok"))
    used = df.join(top, "img_id").withColumn("_t", F.when(F.col("_ok"), threshold).otherwise(low)).filter(F.col("p2") > F.col("_t"))
    lab = R.connected_components(_runs_of(used, F.lit(True)), 8)
    return lab.join(top.select("img_id", F.when(F.col("_ok"), threshold).otherwise(low).alias("threshold")), "img_id")


def confidence_filter(regions: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """L11. (img_id, component, probability, area) of regions whose mean p2 is at least the threshold."""
    return R.component_probability(regions, df, "p2").filter(F.col("probability") >= threshold)


def roi_records(regions: DataFrame, probes: DataFrame) -> DataFrame:
    """R36. (slide_id, key, x, y, width, height): regions moved to slide pixels by their probe's place (img_id, slide_id, px, py), numbered in each slide."""
    box = regions.groupBy("img_id", "component").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")).join(probes, "img_id")
    i = F.row_number().over(Window.partitionBy("img_id").orderBy("component")) - 1
    n = F.row_number().over(Window.partitionBy("slide_id").orderBy("img_id", "component")) - 1
    key = F.concat_ws("_", F.lit("cnt"), F.col("img_id").cast("string"), i.cast("string"), n.cast("string"))
    return box.select("slide_id", key.alias("key"), (F.col("x0") + F.col("px")).alias("x"), (F.col("y0") + F.col("py")).alias("y"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))


def regions(initial: DataFrame, least: int = 3) -> DataFrame:
    """R38. (img_id, component, x, y, w, h): boxes of the non-background components (class 1 or 2 greatest, 8-connected) of at least ``least`` pixels, which are predicted again."""
    lab = R.component_area_filter(R.connected_components(_runs_of(best(initial), F.col("pred") > 0), 8), least)
    box = lab.groupBy("img_id", "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("_x"), F.max("y").alias("_y"))
    return box.select("img_id", "component", "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"))


def _over() -> Column:
    return (F.col("q2") > F.col("q0")) & (F.col("q2") > F.col("q1"))


def refine_regions(initial: DataFrame, region_preds: DataFrame) -> DataFrame:
    """R38. The map with class 1 := p1 + p2 and class 2 := 0, overwritten where a region's prediction (img_id, component, y, x, q0, q1, q2) has class 2 greatest, by the last such region; an image without region predictions keeps its map.

    What changes is gathered by cells of a row, of R.CELL columns at most, and the map's pixels meet those once.
    """
    places, q = ["img_id", "y", "_c"], [F.col(f"q{k}").cast("double") for k in range(3)]
    last = region_preds.filter(_over()).groupBy("img_id", "y", "x").agg(*(F.max_by(v, "component").alias(f"_q{k}") for k, v in enumerate(q)))
    last = last.groupBy("img_id", "y", F.floor(F.col("x") / R.CELL).alias("_c")).agg(*(F.collect_list(c).alias(f"{c}s") for c in ("x", "_q0", "_q1", "_q2")))
    maps = initial.select("img_id", "y", "x", "p0", "p1", "p2", F.floor(F.col("x") / R.CELL).alias("_c"))
    again = maps.select(*places).distinct().join(region_preds.select("img_id").distinct(), "img_id").join(last, places, "left")
    d = maps.join(again.withColumn("_has", F.lit(True)).hint("shuffle_hash"), places, "left").withColumn("_at", F.array_position("xs", F.col("x")).cast("int") - 1)
    p = [F.col(f"p{k}") for k in range(3)]
    merged = (p[0], p[1] + p[2], F.lit(0.0))
    return d.select("img_id", "y", "x", *(F.when(F.col("_has").isNull(), p[k]).otherwise(F.coalesce(F.get(f"_q{k}s", "_at"), merged[k])).alias(f"p{k}") for k in range(3)))


def region_boxes(boxes: DataFrame, region_preds: DataFrame) -> DataFrame:
    """R38. (img_id, component, x, y, w, h, prob): the `regions` whose prediction (img_id, component, y, x, q0, q1, q2) has class 2 greatest somewhere, with its greatest q2."""
    found = region_preds.groupBy("img_id", "component").agg(F.max("q2").alias("prob"), F.bool_or(_over()).alias("_hit")).filter("_hit").drop("_hit")
    return boxes.join(found, ["img_id", "component"])


def detection_stats(df: DataFrame, images: DataFrame, threshold: float, least: float = 500) -> DataFrame:
    """A19. (img_id, atypical, normal, total, max_confidence, avg_confidence) by outer contours: of p2 > threshold, of any size, and of p1 > 0.5 with at least ``least`` inside; confidence is the mean p2 inside a contour."""
    lab = R.outer_contours(_runs_of(df, F.col("p2") > threshold), images)
    a = R.component_probability(lab, df, "p2").groupBy("img_id").agg(F.count(F.lit(1)).alias("atypical"), F.max("probability").alias("max_confidence"), F.avg("probability").alias("avg_confidence"))
    calm = R.contour_area(R.outer_contours(_runs_of(df, F.col("p1") > 0.5), images)).filter(F.col("area") >= least)
    n = calm.groupBy("img_id").agg(F.count(F.lit(1)).alias("normal"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = df.select("img_id").distinct().join(a, "img_id", "left").join(n, "img_id", "left")
    return out.select("img_id", zero("atypical").alias("atypical"), zero("normal").alias("normal"), (zero("atypical") + zero("normal")).alias("total"), F.coalesce("max_confidence", F.lit(0.0)).alias("max_confidence"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def sparse_stats(df: DataFrame, images: DataFrame, object_area: float = 300, group_area: float = 6500) -> DataFrame:
    """A20. (img_id, objects, groups, atypical, warnings) by outer contours.

    Objects are those of non-background pixels with more than ``object_area`` inside, groups those with
    more than ``group_area``. Each contour of class 2 with more than ``object_area`` inside counts by the
    object inside whose line its first pixel lies: in a group it is a warning; in a single cell it is
    atypical once the running sum, in scan order, of trunc(100 * its area / the cell's area) is not zero.
    """
    pred = best(df)
    lab = R.outer_contours(_runs_of(pred, F.col("pred") > 0), images)
    cells = R.contour_area(lab).filter(F.col("area") > object_area)
    parts = R.outer_contours(_runs_of(pred, F.col("pred") == 2), images)
    first = parts.groupBy("img_id", "component").agg(F.min(F.struct("y", "x0")).alias("at"))
    first = first.join(R.contour_area(parts).filter(F.col("area") > object_area), ["img_id", "component"]).select("img_id", F.col("component").alias("part"), F.col("area").alias("part_area"), F.col("at.y").alias("y"), F.col("at.x0").alias("x"))
    # Inside the line are the pixels whose four neighbours are in the object as well.
    around = F.explode(F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
    spots = first.select("img_id", "part", "part_area", around.alias("c")).select("img_id", "part", "part_area", "c.*")
    held = R.in_cells(lab, "x0", "x1").select(F.col("img_id").alias("_i"), F.col("y").alias("_y"), "x0", "x1", "component", "_c")
    held = spots.join(held, F.expr(f"img_id = _i and y = _y and floor(x / {R.CELL}) = _c")).filter("x0 <= x and x <= x1")
    held = held.groupBy("img_id", "part", "part_area", "component").agg(F.count(F.lit(1)).alias("n")).filter("n = 5").drop("n").join(cells, ["img_id", "component"])
    ratio = F.floor(100 * F.col("part_area") / F.col("area"))
    held = held.withColumn("_sum", F.sum(ratio).over(Window.partitionBy("img_id", "component").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    count = lambda c: F.sum(c.cast("long"))
    by = held.groupBy("img_id").agg(count((F.col("area") <= group_area) & (F.col("_sum") > 0)).alias("atypical"), count(F.col("area") > group_area).alias("warnings"))
    objects = cells.groupBy("img_id").agg(F.count(F.lit(1)).alias("objects"), count(F.col("area") > group_area).alias("groups"))
    out = df.select("img_id").distinct().join(objects, "img_id", "left").join(by, "img_id", "left")
    return out.select("img_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("objects", "groups", "atypical", "warnings")))
