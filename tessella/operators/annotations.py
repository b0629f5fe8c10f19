"""Annotation records: reports, filters, matching of files, merging and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import MAX_INT, class_of, dedup_key, is_rect, normalize_label, rect_number
from tessella.operators.graph import first_choices


def polygons(ann: DataFrame) -> DataFrame:
    """Records that are no rectangles of interest."""
    return ann.filter(~is_rect(F.col("label")))


def rectangles(ann: DataFrame) -> DataFrame:
    """(slide_id, rect_idx, rect_name, rx0, ry0, rx1, ry1)."""
    return ann.filter(is_rect(F.col("label"))).select("slide_id", F.col("ann_idx").alias("rect_idx"), F.col("label").alias("rect_name"), F.col("xmin").alias("rx0"), F.col("ymin").alias("ry0"), F.col("xmax").alias("rx1"), F.col("ymax").alias("ry1"))


def label_counts(ann: DataFrame) -> DataFrame:
    """A1. (slide_id, label, n), rectangles left out."""
    return polygons(ann).groupBy("slide_id", normalize_label(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_report(ann: DataFrame) -> DataFrame:
    """A2. (slide_id, label, n): per slide and label, per label over all slides, per slide, and in all.

    Slide totals and the grand total count every record, rectangles too.
    """
    rows = ann.select("slide_id", F.when(~is_rect(F.col("label")), normalize_label(F.col("label"))).alias("label"))
    out = rows.groupingSets([["slide_id", "label"], ["label"], ["slide_id"], []], "slide_id", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("slide_id", "label").alias("level"))
    return out.filter(F.col("label").isNotNull() | (F.col("level").bitwiseAND(1) == 1)).select("slide_id", "label", "n", F.col("level").cast("int").alias("level"))


def label_totals(ann: DataFrame) -> DataFrame:
    """A3. (label, n) over all files and their total as 'Total objects', rectangles left out."""
    out = polygons(ann).select(normalize_label(F.col("label")).alias("label")).rollup("label").agg(F.count(F.lit(1)).alias("n"), F.grouping("label").alias("g"))
    return out.select(F.when(F.col("g") == 1, "Total objects").otherwise(F.col("label")).alias("label"), "n")


def rects_per_slide(ann: DataFrame) -> DataFrame:
    """A23. (slide_id, n) rectangles."""
    return ann.filter(is_rect(F.col("label"))).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))


def cell_size_filter(df: DataFrame, least: int = 100, most: int = 200) -> DataFrame:
    """L1. Boxes whose sides are both in the bounds."""
    return df.filter((F.col("xmax") - F.col("xmin")).between(least, most) & (F.col("ymax") - F.col("ymin")).between(least, most))


def rect_width_limit(rects: DataFrame, most: int = 8000) -> DataFrame:
    """L2. Rectangles no wider than ``most``."""
    return rects.filter(F.col("rx1") - F.col("rx0") <= most)


def drop_bad_contours(ann: DataFrame) -> DataFrame:
    """L3. Records with three points or more and a name that doesn't hold ``Annotation``."""
    return ann.filter((F.size("points") >= 3) & ~F.col("label").contains("Annotation"))


def exclude_old_markup(files: DataFrame) -> DataFrame:
    """L12. Files whose path has no ``_old``."""
    return files.filter(~F.col("path").contains("_old"))


def match_file(slides: DataFrame, files: DataFrame, suffix: str = ".json") -> DataFrame:
    """J1, J2. One file for each slide: the exact ``<slide_id><suffix>``, else the first path with that in it; slides without one are dropped.

    Paths are cut at every place where a slide id of a known length could start, so that a substring
    match is an equi-join, not a comparison of all slides with all files.
    """
    lengths = slides.select(F.length("slide_id").alias("len")).distinct().agg(F.array_sort(F.collect_set("len")).alias("lens"))
    names = files.select(F.col("path").alias("file")).filter(F.col("file").contains(suffix)).join(F.broadcast(lengths))
    ends = names.withColumn("stem", F.explode(F.expr(f"transform(filter(sequence(1, length(file)), i -> substring(file, i, {len(suffix)}) = '{suffix}'), i -> substring(file, 1, i - 1))")))
    keys = ends.withColumn("len", F.explode("lens")).filter("length(stem) >= len").select("file", F.expr("right(stem, len)").alias("slide_id"))
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    exact = (base == F.concat(F.col("slide_id"), F.lit(suffix))).cast("int")
    first = F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc(exact), "file"))
    return slides.join(keys.distinct(), "slide_id").withColumn("_r", first).filter("_r = 1").drop("_r")


def next_rect_labels(ann: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """W9. ``new`` (slide_id, order) with labels ``rect N`` that go on after the slide's largest N."""
    n = rect_number(F.col("label"))
    top = ann.filter(n != MAX_INT).groupBy("slide_id").agg(F.max(n).alias("_top"))
    own = F.row_number().over(Window.partitionBy("slide_id").orderBy(order))
    return new.join(top, "slide_id", "left").withColumn("label", F.concat(F.lit("rect "), (F.coalesce("_top", F.lit(0)) + own).cast("string"))).drop("_top")


def annotation_order() -> list[Column]:
    """O1. Rectangles first, by number; then labels in any case; then the index."""
    label = F.trim(F.col("label"))
    number = rect_number(label)
    return [(number == MAX_INT).cast("int"), number, F.lower(label), F.col("ann_idx")]


def label_palette(ann: DataFrame) -> DataFrame:
    """O7. Distinct trimmed labels of polygons; sort by lower(label)."""
    return polygons(ann).select(F.trim("label").alias("label")).distinct()


def merge_annotations(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """U1. ``base`` and the incoming records whose key is neither in base nor earlier in incoming; column added."""
    key = lambda d: d.withColumn("_key", dedup_key(F.col("label"), is_rect(F.col("label")), F.struct("xmin", "ymin", "xmax", "ymax"), F.col("points")))
    first = F.row_number().over(Window.partitionBy("slide_id", "_key").orderBy("ann_idx"))
    new = key(incoming).withColumn("_r", first).filter("_r = 1").drop("_r").join(key(base).select("slide_id", "_key"), ["slide_id", "_key"], "left_anti")
    return base.withColumn("added", F.lit(False)).unionByName(new.drop("_key").withColumn("added", F.lit(True)))


def atlas(ann: DataFrame) -> DataFrame:
    """R20. One crop window for each region: slide_id, label, ann_idx, x, y, width, height, name."""
    p = polygons(ann).withColumn("label", F.btrim("label", F.lit("?)")))
    name = F.concat(F.col("ann_idx").cast("string"), F.lit("_"), F.col("label"), F.lit("_coords_"), F.col("xmin").cast("string"), F.lit("_"), F.col("ymin").cast("string"))
    return p.select("slide_id", "label", "ann_idx", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("width"), (F.col("ymax") - F.col("ymin")).alias("height"), name.alias("name"))


def near_pairs(ann: DataFrame, limit: int = 15, share: float = 0.2) -> DataFrame:
    """J4. (slide_id, a, b), a < b: two of their like corners at most ``limit`` apart, and an intersection of at least ``share`` of the larger area.

    Each record stands once in each cell of eight times ``limit`` that holds a corner of it, and as the later one in those
    within ``limit`` of a corner; a pair is kept only in the cell of the earlier record's first corner that fits.
    """
    side = 8 * limit
    box = polygons(ann).select("slide_id", F.col("ann_idx").alias("a"), "xmin", "ymin", "xmax", "ymax")
    other = box.withColumnsRenamed({"a": "b", "xmin": "bx0", "ymin": "by0", "xmax": "bx1", "ymax": "by1"})
    cell = lambda c, off=0: F.floor((F.col(c) + off) / side)
    # Corners are all places of two columns and two rows, so their cells are too.
    cells = lambda names, offs: F.explode(F.array_distinct(F.array(*(cell(c, o) for c in names for o in offs))))
    left = box.withColumn("cx", cells(("xmin", "xmax"), (0,))).withColumn("cy", cells(("ymin", "ymax"), (0,))).hint("merge")
    right = other.withColumn("cx", cells(("bx0", "bx1"), (-limit, limit))).withColumn("cy", cells(("by0", "by1"), (-limit, limit))).hint("merge")
    d = lambda x, y: (F.col(x[0]) - F.col(x[1])) * (F.col(x[0]) - F.col(x[1])) + (F.col(y[0]) - F.col(y[1])) * (F.col(y[0]) - F.col(y[1])) <= limit * limit
    fits = [d((x, bx), (y, by)) for y, by in (("ymin", "by0"), ("ymax", "by1")) for x, bx in (("xmin", "bx0"), ("xmax", "bx1"))]
    spots = [(cell(x) == F.col("cx")) & (cell(y) == F.col("cy")) for y in ("ymin", "ymax") for x in ("xmin", "xmax")]
    here = F.when(fits[0], spots[0]).when(fits[1], spots[1]).when(fits[2], spots[2]).when(fits[3], spots[3])
    dx = F.least("xmax", "bx1") - F.greatest("xmin", "bx0")
    dy = F.least("ymax", "by1") - F.greatest("ymin", "by0")
    inter = F.when((dx >= 0) & (dy >= 0), dx * dy).otherwise(0)
    area = F.greatest((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    pairs = left.join(right, ["slide_id", "cx", "cy"]).filter((F.col("a") < F.col("b")) & here & (inter >= F.lit(share) * area))
    return pairs.select("slide_id", "a", "b")


def resolve_near_duplicates(ann: DataFrame, limit: int = 15, share: float = 0.2) -> DataFrame:
    """U2. Polygons of ``ann`` that survive: in order, each record kills the first earlier record that is still alive and close to it.

    Pairs and kills are made by joins, of all slides and clumps at once (`graph.first_choices`): the kills of a chain
    or a star take one or two rounds, and clumps in which all are close to all are decided in memory unless very large.
    """
    dead = first_choices(near_pairs(ann, limit, share), ["slide_id"])
    return polygons(ann).join(dead.select("slide_id", F.col("a").alias("ann_idx")), ["slide_id", "ann_idx"], "left_anti")


def markdown_report(report: DataFrame) -> DataFrame:
    """S12. (at, line) of a label report: a slide's header, its labels, then totals; sort by at."""
    head = F.col("label").isNull()
    text = (
        F.when(F.col("slide_id").isNull() & head, F.concat(F.lit("**Total: "), F.col("n").cast("string"), F.lit("**")))
        .when(F.col("slide_id").isNull(), F.concat(F.lit("- all "), F.col("label"), F.lit(": "), F.col("n").cast("string")))
        .when(head, F.concat(F.lit("## "), F.col("slide_id"), F.lit(": "), F.col("n").cast("string")))
        .otherwise(F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("n").cast("string")))
    )
    at = F.concat_ws("/", F.when(F.col("slide_id").isNull(), "~").otherwise(F.col("slide_id")), F.when(head, F.when(F.col("slide_id").isNull(), "~").otherwise("")).otherwise(F.col("label")))
    return report.select(at.alias("at"), text.alias("line"))


def draw_class(ann: DataFrame, labels: dict[str, int]) -> DataFrame:
    """P4 on records: with column mask, 255 or 127."""
    return ann.withColumn("mask", class_of(F.col("label"), labels))
