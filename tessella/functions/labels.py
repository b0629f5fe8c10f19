"""Labels, coordinates, names and keys of annotations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INT = 2147483647
POINTS = "array<struct<x:int,y:int>>"


def normalize_label(label: Column) -> Column:
    """P1. The label without ``?``, ``)`` and spaces at either end."""
    return F.btrim(label, F.lit("?) "))


def is_rect(label: Column) -> Column:
    """P2. Does the label name a rectangle of interest?"""
    return F.lower(label).contains("rect")


def rect_number(label: Column) -> Column:
    """P3. N of a label ``rect N``, in any case; the largest int for other labels."""
    return F.coalesce(F.regexp_extract(label, r"(?i)^\s*rect\s*(\d+)\s*$", 1).try_cast("int"), F.lit(MAX_INT))


def class_of(label: Column, labels: dict[str, int]) -> Column:
    """P4. 255 for a label of ``labels`` (abnormal), 127 for others (normal)."""
    known = F.array(*(F.lit(k) for k in labels)) if labels else F.array().cast("array<string>")
    return F.when(F.array_contains(known, normalize_label(label)), 255).otherwise(127)


def trunc_coord(text: Column) -> Column:
    """P5. A number's text cut toward zero; null if it is none."""
    return text.try_cast("double").cast("int")


def llround(x: Column) -> Column:
    """P6. Nearest integer, halves away from zero."""
    return F.round(x).cast("long")


def bbox_from_points(points: Column) -> Column:
    """P7. struct(xmin, ymin, xmax, ymax)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def close_polygon(points: Column) -> Column:
    """P8. The first point again at the end, for three or more points whose ends differ by more than 1e-6."""
    a, b = points[0], F.element_at(points, -1)
    apart = (F.abs(a["x"] - b["x"]) > 1e-6) | (F.abs(a["y"] - b["y"]) > 1e-6)
    return F.when((F.size(points) >= 3) & apart, F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def effective_bbox(rectangle: Column, rect: Column, points: Column) -> Column:
    """P9. A polygon's box from its points; a rectangle's stored box, or from points if that is empty; null if still empty."""
    own = bbox_from_points(points)
    filled = lambda r: (r["xmax"] > r["xmin"]) & (r["ymax"] > r["ymin"])
    return F.when(rectangle & filled(rect), rect).when(filled(own), own)


def to_local(points: Column, x0: Column, y0: Column) -> Column:
    """P10. Points relative to an origin."""
    return F.transform(points, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))


def scale_level(at: Column, downsample: Column) -> Column:
    """P11. A coordinate of a pyramid level in level-0 pixels, cut toward zero."""
    return (at * downsample).cast("int")


def ordered_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """P11. A box dragged in any direction."""
    return F.struct(F.least(x0, x1).alias("xmin"), F.least(y0, y1).alias("ymin"), F.greatest(x0, x1).alias("xmax"), F.greatest(y0, y1).alias("ymax"))


def float_or_text(value: Column) -> Column:
    """P14. struct(number, text): the number if the value is one, else the text."""
    n = value.try_cast("double")
    return F.struct(n.alias("number"), F.when(n.isNull(), value).alias("text"))


def slide_mpp(x: Column, y: Column) -> Column:
    """P15. Mean microns per pixel of both axes; 0 if one is missing or no number."""
    return F.coalesce((x.try_cast("double") + y.try_cast("double")) / 2, F.lit(0.0))


@F.udf(T.StringType(), useArrow=False)
def _ascii(s: str | None) -> str | None:
    """One text at a time, in Spark's batches of 100 rows: Arrow's batches hold thousands of whole texts, and pandas a copy for each step."""
    return s if s is None or s.isascii() else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


def slugify(text: Column) -> Column:
    """P16. ASCII of the decomposed text, lower case, other runs of characters one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_ascii(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def tile_name(slide: Column, rect: Column, y: Column, x: Column, size: Column, kind: str | None = None, number: Column | None = None) -> Column:
    """P17. ``slide__rect[_kind_number]_coords_y_x_size``."""
    middle = F.lit("") if kind is None else F.concat(F.lit(f"_{kind}_"), number.cast("string"))
    return F.concat(slide, F.lit("__"), rect, middle, F.lit("_coords_"), F.concat_ws("_", y.cast("string"), x.cast("string"), size.cast("string")))


def parse_tile_name(name: Column) -> Column:
    """P17. struct(slide_id, rect_name, kind, number, y, x, size) of a tile's name."""
    pattern = r"^(.*?)__(.*?)(?:_(grp|ind|norm)_(\d+))?_coords_(-?\d+)_(-?\d+)_(\d+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    whole = lambda k, c: part(k).try_cast("int").alias(c)
    return F.struct(part(1).alias("slide_id"), part(2).alias("rect_name"), F.nullif(part(3), F.lit("")).alias("kind"), whole(4, "number"), whole(5, "y"), whole(6, "x"), whole(7, "size"))


def contour_to_tile(points: Column, x0: Column, y0: Column, scale: Column) -> Column:
    """P30. Points in a drawn tile's pixels, cut toward zero."""
    return F.transform(points, lambda p: F.struct(((p["x"] - x0) * scale).cast("int").alias("x"), ((p["y"] - y0) * scale).cast("int").alias("y")))


def dedup_key(label: Column, rectangle: Column, box: Column, points: Column, integers: bool = False) -> Column:
    """P31. What two records must share to be the same: label, kind, rounded box, number of points and rounded points. ``integers``: all are whole, and nothing need be rounded."""
    whole = lambda c: (c if integers else llround(c.cast("double"))).cast("string")
    corners = F.concat_ws(",", *(whole(box[k]) for k in ("xmin", "ymin", "xmax", "ymax")))
    path = F.array_join(F.transform(points, lambda p: F.concat_ws(",", whole(p["x"]), whole(p["y"]))), ";")
    return F.concat_ws("|", F.lower(F.trim(label)), F.when(rectangle, "1").otherwise("0"), corners, F.size(points).cast("string"), path)


def relabel_valid(old: Column, new: Column) -> Column:
    """P36. May a label be changed? A rectangle stays ``rect N``; nothing else becomes one."""
    numbered = lambda c: rect_number(c) != MAX_INT
    return F.when(numbered(old), numbered(new)).otherwise(~numbered(new)) & (F.length(F.trim(new)) > 0)
