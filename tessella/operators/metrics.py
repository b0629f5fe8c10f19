"""Evaluation of segmentations: confusion, IoU, F1, precision, losses and average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.pixels import argmax
from tessella.operators.ranking import global_rank, running_sums

EPS = 1e-7


def predicted(pixels: DataFrame) -> DataFrame:
    """Pixels with logits z0..z2 and pred, the class of the greatest."""
    return pixels.withColumn("pred", argmax(F.array("z0", "z1", "z2")))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 1.0).otherwise(top / bottom)


def _four(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"iou": _ratio(tp, tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def confusion_matrix(df: DataFrame, classes: int = 3) -> DataFrame:
    """A6. (gt, pred, n) of all class pairs, zeros too."""
    seen = df.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("gt"), (F.col("id") % classes).cast("int").alias("pred"))
    return grid.join(seen, ["gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_wide(df: DataFrame, classes: int = 3) -> DataFrame:
    """A6 with one column pred_k for each class."""
    return df.groupBy("gt").pivot("pred", list(range(classes))).count().select("gt", *(F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"pred_{k}") for k in range(classes)))


def _counts(cls: int = 2) -> dict[str, Column]:
    hit = lambda c: F.sum(c.cast("long"))
    g, p = F.col("gt") == cls, F.col("pred") == cls
    return {"tp": hit(g & p), "fp": hit(~g & p), "fn": hit(g & ~p), "tn": hit(~g & ~p)}


def sample_metrics(df: DataFrame, key: str = "tile_id") -> DataFrame:
    """A7. Per sample: tp, fp, fn, tn of class 2, iou, precision, recall, f1, and the pixels mistaken between classes 1 and 2."""
    n = df.groupBy(key).agg(*(c.alias(k) for k, c in _counts().items()), F.sum(((F.col("gt") == 1) & (F.col("pred") == 2)).cast("long")).alias("normal_to_path_px"), F.sum(((F.col("gt") == 2) & (F.col("pred") == 1)).cast("long")).alias("path_to_normal_px"))
    return n.withColumns(_four(F.col("tp"), F.col("fp"), F.col("fn")))


def global_metrics(df: DataFrame, cls: int = 2) -> DataFrame:
    """A8. The same from the sums over all samples."""
    return df.agg(*(c.alias(k) for k, c in _counts(cls).items())).withColumns(_four(F.col("tp"), F.col("fp"), F.col("fn")))


def class_counts(df: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """(by..., cls, tp, fp, fn) of every class, absent ones too, in one aggregation."""
    by = by or []
    sums = [F.sum(c.cast("long")).alias(f"{n}{k}") for k in range(classes) for n, c in (("tp", (F.col("gt") == k) & (F.col("pred") == k)), ("fp", (F.col("gt") != k) & (F.col("pred") == k)), ("fn", (F.col("gt") == k) & (F.col("pred") != k)))]
    wide = df.groupBy(*by).agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("cls"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn"))) for k in range(classes))))
    return wide.select(*by, rows.alias("c")).select(*by, "c.*")


def class_metric(c: DataFrame, metric: str) -> DataFrame:
    """Rows of class_counts with value: iou, or f1 with EPS; 1 for a class absent on both sides."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    bottom = tp + fp + fn if metric == "iou" else 2 * tp + fp + fn
    value = tp / bottom if metric == "iou" else 2 * tp / (bottom + EPS)
    return c.withColumn("value", F.when(bottom == 0, 1.0).otherwise(value))


def macro_metric(df: DataFrame, metric: str, classes: int = 3, background: bool = False, by: list[str] | None = None) -> DataFrame:
    """A9, A10. Mean over the classes, without background unless asked."""
    rows = class_metric(class_counts(df, classes, by), metric)
    rows = rows if background else rows.filter("cls > 0")
    return rows.groupBy(*(by or [])).agg(F.avg("value").alias("value"))


def batch_mean_metric(df: DataFrame, batch: str, metric: str, classes: int = 3) -> DataFrame:
    """A12. The macro metric of each batch, then the mean over batches."""
    return macro_metric(df, metric, classes, by=[batch]).agg(F.avg("value").alias("value"))


def cumulative_pr(df: DataFrame, order: list[Column]) -> DataFrame:
    """W1. Running tp, fp and precision by descending score, summed in ranges of the order, to which the sums of the earlier ranges are added."""
    out = running_sums(df.withColumn("_n", 1 - F.col("positive")), order, {"tp": "positive", "fp": "_n"}).drop("_n")
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def average_precision(df: DataFrame, tie: str) -> DataFrame:
    """A13. Exact average precision by descending score, ties by ``tie``; 0 without positives.

    Ranks come from range-partitioned running sums, so no task holds all scores.
    """
    pos = global_rank(df, F.desc("score"), F.col(tie), name="_r")
    hits = global_rank(pos.filter("positive = 1"), "_r", name="_h")
    ap = F.sum((F.col("_h") + 1) / (F.col("_r") + 1)) / F.count(F.lit(1))
    return hits.agg(F.coalesce(ap, F.lit(0.0)).alias("ap"))


def score_histogram(df: DataFrame, bins: int = 4096) -> DataFrame:
    """(bin, pos, neg) of scores cut into bins of [0, 1]."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col("score") * (bins - 1)).cast("int")))
    return df.groupBy(b.alias("bin")).agg(F.sum("positive").cast("long").alias("pos"), F.sum(1 - F.col("positive")).cast("long").alias("neg"))


def cumulative_hist(hist: DataFrame) -> DataFrame:
    """W2. Running tp and fp from the highest bin down; at most as many rows as bins."""
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))


def average_precision_binned(df: DataFrame, bins: int = 4096) -> DataFrame:
    """A14. Average precision from binned scores: the form that scales."""
    h = cumulative_hist(score_histogram(df, bins))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("pos")).otherwise(0.0)) / F.sum("pos")
    return h.agg(F.coalesce(ap, F.lit(0.0)).alias("ap"))


def roi_probability(df: DataFrame, p: str, threshold: float, by: list[str]) -> DataFrame:
    """A17. Mean of the probabilities above the threshold, 0 if there are none, and how many there are."""
    above = F.col(p) > threshold
    total, n = F.sum(F.when(above, F.col(p)).otherwise(0.0)), F.sum(above.cast("long"))
    return df.groupBy(*by).agg(F.when(n > 0, total / n).otherwise(0.0).alias("probability"), n.alias("n"))


def probe_max(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """A18. The greatest probability of each probe."""
    return df.groupBy(*by).agg(F.max(p).alias("p_max"))


def focal_tversky(df: DataFrame, probs: list[str], alpha: float = 0.3, beta: float = 0.7, gamma: float = 1.33, weights: list[float] | None = None, smooth: float = 1e-6) -> DataFrame:
    """A25. Mean over classes of (1 - T)^gamma, T from soft sums over all pixels, with ``smooth`` above and below the line."""
    sums = []
    for k, p in enumerate(probs):
        y = (F.col("gt") == k).cast("double")
        sums += [F.sum(F.col(p) * y).alias(f"tp{k}"), F.sum(F.col(p) * (1 - y)).alias(f"fp{k}"), F.sum((1 - F.col(p)) * y).alias(f"fn{k}")]
    s = df.agg(*sums)
    t = [(F.col(f"tp{k}") + smooth) / (F.col(f"tp{k}") + alpha * F.col(f"fp{k}") + beta * F.col(f"fn{k}") + smooth) for k in range(len(probs))]
    w = weights or [1.0] * len(probs)
    return s.select((sum((F.pow(1 - t[k], F.lit(gamma)) * w[k] for k in range(len(probs))), F.lit(0.0)) / sum(w)).alias("loss"))


def cross_entropy(df: DataFrame, probs: list[str], weights: list[float] | None = None, smoothing: float = 0.0) -> DataFrame:
    """A26. Weighted negative log likelihood over the sum of weights; smoothing spreads that share over all classes."""
    w = weights or [1.0] * len(probs)
    own = sum((F.when(F.col("gt") == k, w[k]).otherwise(0.0) for k in range(len(probs))), F.lit(0.0))
    nll = [-F.log(F.greatest(F.col(p), F.lit(1e-12))) for p in probs]
    hit = sum((F.when(F.col("gt") == k, nll[k] * w[k]).otherwise(0.0) for k in range(len(probs))), F.lit(0.0))
    spread = sum((nll[k] * w[k] for k in range(len(probs))), F.lit(0.0)) / len(probs)
    return df.agg(((1 - smoothing) * F.sum(hit) / F.sum(own) + smoothing * F.sum(spread) / F.sum(own)).alias("loss"))


def pathology_preserved(before: Column, after: Column, ratio: float, min_pixels: int) -> Column:
    """L9. Does a crop keep enough of the pathology?"""
    enough = (after / before >= ratio) & (after >= F.greatest(F.ceil(before * ratio), F.least(F.lit(min_pixels), before)))
    return F.when(before <= 0, True).otherwise(enough)


COMPARED = ("iou", "f1", "precision", "recall", "tp", "fp", "fn", "tn")


def compare_audits(new: DataFrame, old: DataFrame, names: tuple[str, ...] = COMPARED) -> DataFrame:
    """J15. (metric, new, old, delta) of two one-row summaries."""
    long = lambda d, c: d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(c)) for n in names))).alias("r")).select("r.*")
    return long(new, "new").join(long(old, "old"), "metric").withColumn("delta", F.col("new") - F.col("old"))
