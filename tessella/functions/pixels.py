"""Classes, probabilities and symmetries of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKGROUND, NORMAL, ABNORMAL = 0, 127, 255
LOW = 0.3
#: Outcomes of (true, predicted) classes.
OUTCOMES = {
    (2, 2): "pathology_hit", (2, 1): "pathology_to_normal", (2, 0): "pathology_to_background",
    (1, 2): "normal_to_pathology", (0, 2): "background_to_pathology", (1, 1): "normal_hit",
}


def mask_to_class(v: Column) -> Column:
    """P18. 0, 127, 255 -> 0, 1, 2; any other value -> 0."""
    return F.when(v == NORMAL, 1).when(v == ABNORMAL, 2).otherwise(0)


def class_to_mask(c: Column) -> Column:
    """P18. 0, 1, 2 -> 0, 127, 255; any other class -> 0."""
    return F.when(c == 1, NORMAL).when(c == 2, ABNORMAL).otherwise(BACKGROUND)


def to_gray(r: Column, g: Column, b: Column) -> Column:
    """P19. Luminance."""
    return r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)


def scale_pixels(values: Column) -> Column:
    """P20. An array of 0..255 as shares of 1."""
    return F.transform(values, lambda v: v / F.lit(255.0))


def softmax(z: Column) -> Column:
    """P21. Probabilities of an array of logits, shifted by the largest."""
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(p: Column) -> Column:
    """P22. Place of the first maximum, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def split_by_class(df: DataFrame, probs: str = "probs") -> DataFrame:
    """P23. One row for each class: cls, p."""
    return df.select(*(c for c in df.columns if c != probs), F.posexplode(probs).alias("cls", "p"))


def one_hot(c: Column, n: int) -> Column:
    """P24. Array of n zeros with a one at the class."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == c).cast("int"))


def sample_weight(c: Column, weights: tuple[float, ...] = (1.0, 1.0, 2.0)) -> Column:
    """P25. Weight of a pixel's class, the weights summing to 1."""
    total = float(sum(weights))
    return F.element_at(F.array(*(F.lit(w / total) for w in weights)), c + 1)


def error_category(gt: Column, pred: Column) -> Column:
    """P27. Name of the outcome; null for background found as background or normal, and normal as background."""
    out = F.lit(None).cast("string")
    for (a, b), name in OUTCOMES.items():
        out = F.when((gt == a) & (pred == b), name).otherwise(out)
    return out


def overlay_category(p: Column, threshold: float, suspicious: Column) -> Column:
    """P28. yellow, red, normal or green2 of a pixel, in that precedence; null for none."""
    best, p1, p2 = argmax(p), p[1], p[2]
    red = p2 >= threshold
    calm = (p2 < LOW) & ~suspicious
    return F.when(suspicious & ~red, "yellow").when(red, "red").when((best == 1) & (p1 >= 0.5) & calm, "normal").when((best == 2) & calm, "green2")


def overlay_category_native(p: Column, threshold: float) -> Column:
    """P29. The other rule: red above the threshold, yellow between, green2 at LOW or below, both where class 2 is dominant."""
    p2 = p[2]
    dominant = (p2 >= p[0]) & (p2 >= p[1])
    return F.when(p2 > threshold, "red").when((p2 > LOW) & dominant, "yellow").when((p2 <= LOW) & dominant, "green2")


def spline_line(n: int) -> list[float]:
    """P32. The squared-spline window of n places, divided by its mean."""
    rise = [(2 * i + 1) / n if n % 2 == 0 else 2 * (i + 1) / (n + 1) for i in range(n)]
    t = [r if r <= 1 else 2 - r for r in rise]
    raw = [(2 * v) ** 2 / 2 if i < n // 4 or i >= n - n // 4 else 1 - (2 * (v - 1)) ** 2 / 2 for i, v in enumerate(t)]
    return [v * n / sum(raw) for v in raw]


def spline_weight(i: Column, n: int) -> Column:
    """P32. The weight of place i of a window of n."""
    return F.element_at(F.array(*(F.lit(v) for v in spline_line(n))), i + 1)


def spline_weights(spark: SparkSession, n: int) -> DataFrame:
    """P32. (i, w): the window as a table."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), spline_weight(F.col("id").cast("int"), n).alias("w"))


def flip_rot(y: Column, x: Column, n: int | Column, k: Column) -> tuple[Column, Column]:
    """P37. Where the square's pixel (y, x) goes under symmetry k of eight: k mod 4 quarter turns, mirrored first from 4 on."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    u = F.when(k >= 4, last - x).otherwise(x)
    r = F.pmod(k, F.lit(4))
    return (
        F.when(r == 0, y).when(r == 1, last - u).when(r == 2, last - y).otherwise(u),
        F.when(r == 0, u).when(r == 1, y).when(r == 2, last - u).otherwise(last - y),
    )


def flip_rot_inverse(y: Column, x: Column, n: int | Column, k: Column) -> tuple[Column, Column]:
    """P37. The pixel that symmetry k moved to (y, x)."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    r = F.pmod(k, F.lit(4))
    v = F.when(r == 0, y).when(r == 1, x).when(r == 2, last - y).otherwise(last - x)
    u = F.when(r == 0, x).when(r == 1, last - y).when(r == 2, last - x).otherwise(y)
    return v, F.when(k >= 4, last - u).otherwise(u)
