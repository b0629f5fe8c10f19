"""Queries that evaluate predictions: pixels with logits, scores, samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixels as P
from tessella.operators import metrics as M
from tessella.operators import ranking as R
from tessella.operators.scoring import classify_images
from tessella.plans.fixtures import Tables
from tessella.plans.registry import query

_PRED = "CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INT)"
_X = f", x AS (SELECT *, {_PRED} AS pred, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM fx_pixels), q AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM x) "


def _probs(t: Tables) -> DataFrame:
    d = M.predicted(t.pixels()).withColumn("probs", P.softmax(F.array("z0", "z1", "z2")))
    return d.withColumns({f"p{k}": F.col("probs")[k] for k in range(3)})


@query("p18_mask_to_class", "fx_pixels", ", m AS (SELECT tile_id, px, CASE WHEN px % 5 = 4 THEN 9 ELSE CASE gt WHEN 1 THEN 127 WHEN 2 THEN 255 ELSE 0 END END AS v FROM fx_pixels) SELECT tile_id, px, v::INT AS v, CAST(CASE v WHEN 127 THEN 1 WHEN 255 THEN 2 ELSE 0 END AS INT) AS cls FROM m")
def _(t: Tables) -> DataFrame:
    d = t.pixels().withColumn("v", F.when(F.col("px") % 5 == 4, 9).otherwise(P.class_to_mask(F.col("gt"))))
    return d.select("tile_id", "px", "v", P.mask_to_class(F.col("v")).alias("cls"))


@query("p19_to_gray", "fx_pixels", "SELECT tile_id, px, round((px * 11 + tile_id) % 256 * 0.299::DOUBLE + (px * 7) % 256 * 0.587::DOUBLE + (tile_id * 3) % 256 * 0.114::DOUBLE, 6) AS gray FROM fx_pixels")
def _(t: Tables) -> DataFrame:
    return t.pixels().select("tile_id", "px", F.round(P.to_gray((F.col("px") * 11 + F.col("tile_id")) % 256, (F.col("px") * 7) % 256, (F.col("tile_id") * 3) % 256), 6).alias("gray"))


@query("p20_scale_pixels", "fx_pixels", "SELECT tile_id, px, round((px * 11 + tile_id) % 256 / 255.0::DOUBLE, 6) AS a, round(gt / 255.0::DOUBLE, 6) AS b FROM fx_pixels")
def _(t: Tables) -> DataFrame:
    s = P.scale_pixels(F.array(((F.col("px") * 11 + F.col("tile_id")) % 256).cast("long"), F.col("gt").cast("long")))
    return t.pixels().select("tile_id", "px", F.round(s[0], 6).alias("a"), F.round(s[1], 6).alias("b"))


@query("p21_softmax", "fx_pixels", _X + "SELECT tile_id, px, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM q")
def _(t: Tables) -> DataFrame:
    return _probs(t).select("tile_id", "px", *(F.round(f"p{k}", 6).alias(f"p{k}") for k in range(3)))


@query("p22_argmax", "fx_pixels", _X + "SELECT tile_id, px, pred FROM x")
def _(t: Tables) -> DataFrame:
    return M.predicted(t.pixels()).select("tile_id", "px", "pred")


@query("p23_split_by_class", "fx_pixels", _X + "SELECT tile_id, px, 0 AS cls, round(p0, 6) AS p FROM q UNION ALL SELECT tile_id, px, 1, round(p1, 6) FROM q UNION ALL SELECT tile_id, px, 2, round(p2, 6) FROM q")
def _(t: Tables) -> DataFrame:
    return P.split_by_class(_probs(t).select("tile_id", "px", "probs")).withColumn("p", F.round("p", 6))


@query("p24_one_hot", "fx_pixels", "SELECT tile_id, px, CAST(gt = 0 AS INT) AS h0, CAST(gt = 1 AS INT) AS h1, CAST(gt = 2 AS INT) AS h2 FROM fx_pixels")
def _(t: Tables) -> DataFrame:
    return t.pixels().withColumn("h", P.one_hot(F.col("gt"), 3)).select("tile_id", "px", *(F.col("h")[k].alias(f"h{k}") for k in range(3)))


@query("p25_sample_weight", "fx_pixels", "SELECT tile_id, px, CASE WHEN gt = 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM fx_pixels")
def _(t: Tables) -> DataFrame:
    return t.pixels().select("tile_id", "px", P.sample_weight(F.col("gt")).alias("w"))


@query("p27_error_category", "fx_pixels", _X + "SELECT CASE WHEN gt = 2 AND pred = 2 THEN 'pathology_hit' WHEN gt = 2 AND pred = 1 THEN 'pathology_to_normal' WHEN gt = 2 THEN 'pathology_to_background' WHEN gt = 1 AND pred = 2 THEN 'normal_to_pathology' WHEN gt = 0 AND pred = 2 THEN 'background_to_pathology' WHEN gt = 1 AND pred = 1 THEN 'normal_hit' END AS outcome, COUNT(*) AS n FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return M.predicted(t.pixels()).groupBy(P.error_category(F.col("gt"), F.col("pred")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("p28_overlay_category", "fx_pixels", _X + "SELECT tile_id, px, CASE WHEN gt = 2 AND p2 < 0.5 THEN 'yellow' WHEN p2 >= 0.5 THEN 'red' WHEN pred = 1 AND p1 >= 0.5 AND p2 < 0.3 AND gt <> 2 THEN 'normal' WHEN pred = 2 AND p2 < 0.3 AND gt <> 2 THEN 'green2' END AS zone FROM q")
def _(t: Tables) -> DataFrame:
    return _probs(t).select("tile_id", "px", P.overlay_category(F.col("probs"), 0.5, F.col("gt") == 2).alias("zone"))


@query("p29_overlay_category_native", "fx_pixels", _X + "SELECT tile_id, px, CASE WHEN p2 > 0.5 THEN 'red' WHEN p2 > 0.3 AND p2 >= p0 AND p2 >= p1 THEN 'yellow' WHEN p2 <= 0.3 AND p2 >= p0 AND p2 >= p1 THEN 'green2' END AS zone FROM q")
def _(t: Tables) -> DataFrame:
    return _probs(t).select("tile_id", "px", P.overlay_category_native(F.col("probs"), 0.5).alias("zone"))


@query("a6_confusion_matrix", "fx_pixels", _X + "SELECT g.v::INT AS gt, p.v::INT AS pred, COUNT(x.gt) AS n FROM range(0, 3) g(v) CROSS JOIN range(0, 3) p(v) LEFT JOIN x ON x.gt = g.v AND x.pred = p.v GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return M.confusion_matrix(M.predicted(t.pixels()))


@query("a6_confusion_wide", "fx_pixels", _X + "SELECT gt, COUNT(*) FILTER (pred = 0) AS pred_0, COUNT(*) FILTER (pred = 1) AS pred_1, COUNT(*) FILTER (pred = 2) AS pred_2 FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return M.confusion_wide(M.predicted(t.pixels()))


_COUNTS = "COUNT(*) FILTER (gt = 2 AND pred = 2) AS tp, COUNT(*) FILTER (gt <> 2 AND pred = 2) AS fp, COUNT(*) FILTER (gt = 2 AND pred <> 2) AS fn, COUNT(*) FILTER (gt <> 2 AND pred <> 2) AS tn"
_FOUR = "round(CASE WHEN tp+fp+fn = 0 THEN 1 ELSE tp/(tp+fp+fn) END, 6) AS iou, round(CASE WHEN tp+fp = 0 THEN 1 ELSE tp/(tp+fp) END, 6) AS precision, round(CASE WHEN tp+fn = 0 THEN 1 ELSE tp/(tp+fn) END, 6) AS recall, round(CASE WHEN 2*tp+fp+fn = 0 THEN 1 ELSE 2*tp/(2*tp+fp+fn) END, 6) AS f1"
_SAMPLES = f"SELECT tile_id, tp, fp, fn, tn, normal_to_path_px, path_to_normal_px, {_FOUR} FROM (SELECT tile_id, {_COUNTS}, COUNT(*) FILTER (gt = 1 AND pred = 2) AS normal_to_path_px, COUNT(*) FILTER (gt = 2 AND pred = 1) AS path_to_normal_px FROM x GROUP BY 1)"


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c, kind in d.dtypes if kind == "double"})


@query("a7_sample_metrics", "fx_pixels", _X + _SAMPLES)
def _(t: Tables) -> DataFrame:
    return _rounded(M.sample_metrics(M.predicted(t.pixels())))


@query("a8_global_metrics", "fx_pixels", _X + f"SELECT tp, fp, fn, tn, {_FOUR} FROM (SELECT {_COUNTS} FROM x)")
def _(t: Tables) -> DataFrame:
    return _rounded(M.global_metrics(M.predicted(t.pixels())))


_CC = ", cc AS (SELECT {by} c.v AS cls, COUNT(*) FILTER (gt = c.v AND pred = c.v) AS tp, COUNT(*) FILTER (gt <> c.v AND pred = c.v) AS fp, COUNT(*) FILTER (gt = c.v AND pred <> c.v) AS fn FROM x CROSS JOIN range(0, {n}) c(v) GROUP BY ALL) "
_IOU = "CASE WHEN tp+fp+fn = 0 THEN 1 ELSE tp/(tp+fp+fn) END"
_F1 = "CASE WHEN 2*tp+fp+fn = 0 THEN 1 ELSE 2*tp/(2*tp+fp+fn+1e-7) END"


@query("a9_macro_iou", "fx_pixels", _X + _CC.format(by="", n=4) + f"SELECT round(avg({_IOU}), 6) AS value FROM cc WHERE cls > 0")
def _(t: Tables) -> DataFrame:
    return _rounded(M.macro_metric(M.predicted(t.pixels()), "iou", 4))


@query("a10_macro_f1", "fx_pixels", _X + _CC.format(by="", n=3) + f"SELECT round(avg({_F1}), 6) AS value FROM cc")
def _(t: Tables) -> DataFrame:
    return _rounded(M.macro_metric(M.predicted(t.pixels()), "f1", 3, background=True))


@query("a11_class_metrics", "fx_pixels", _X + _CC.format(by="", n=3) + f"SELECT cls::INT AS cls, round({_IOU}, 6) AS iou, round({_F1}, 6) AS f1 FROM cc")
def _(t: Tables) -> DataFrame:
    c = M.class_counts(M.predicted(t.pixels()), 3)
    return _rounded(M.class_metric(c, "iou").withColumnRenamed("value", "iou").join(M.class_metric(c, "f1").select("cls", F.col("value").alias("f1")), "cls").select("cls", "iou", "f1"))


@query("a12_batch_mean_metric", "fx_pixels", _X + _CC.format(by="tile_id // 16 AS b,", n=3) + f"SELECT round(avg(v), 6) AS value FROM (SELECT b, avg({_IOU}) AS v FROM cc WHERE cls > 0 GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return _rounded(M.batch_mean_metric(M.predicted(t.pixels()).withColumn("b", F.floor(F.col("tile_id") / 16)), "b", "iou"))


_PR = ", w AS (SELECT event_id, positive, sum(positive) OVER (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY score DESC, event_id) AS r FROM fx_scores) "


@query("a13_average_precision", "fx_scores", _PR + "SELECT round(coalesce(sum(tp / r) / count(*), 0), 6) AS ap FROM w WHERE positive = 1")
def _(t: Tables) -> DataFrame:
    return _rounded(M.average_precision(t.scores(), "event_id"))


@query("w1_cumulative_pr", "fx_scores", _PR + "SELECT event_id, CAST(tp AS BIGINT) AS tp, CAST(r - tp AS BIGINT) AS fp, round(tp / r, 6) AS precision FROM w")
def _(t: Tables) -> DataFrame:
    d = M.cumulative_pr(t.scores(), [F.desc("score"), F.col("event_id")])
    return _rounded(d.select("event_id", "tp", "fp", "precision"))


_HIST = ", h AS (SELECT CAST(greatest(0, least(4095, trunc(score * 4095))) AS INT) AS bin, CAST(sum(positive) AS BIGINT) AS pos, CAST(sum(1 - positive) AS BIGINT) AS neg FROM fx_scores GROUP BY 1), c AS (SELECT *, CAST(sum(pos) OVER (ORDER BY bin DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY bin DESC) AS BIGINT) AS fp FROM h) "


@query("w2_cumulative_hist", "fx_scores", _HIST + "SELECT bin, pos, neg, tp, fp FROM c")
def _(t: Tables) -> DataFrame:
    return M.cumulative_hist(M.score_histogram(t.scores()))


@query("a14_average_precision_binned", "fx_scores", _HIST + "SELECT round(sum(CASE WHEN pos > 0 THEN tp / (tp + fp) * pos ELSE 0 END) / sum(pos), 6) AS ap FROM c")
def _(t: Tables) -> DataFrame:
    return _rounded(M.average_precision_binned(t.scores()))


@query("a17_roi_probability", "fx_pixels", _X + "SELECT tile_id, round(coalesce(avg(p2) FILTER (p2 > 0.4), 0), 6) AS probability, COUNT(*) FILTER (p2 > 0.4) AS n FROM q GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _rounded(M.roi_probability(_probs(t), "p2", 0.4, ["tile_id"]))


@query("a18_probe_max_probability", "fx_pixels", _X + "SELECT tile_id, round(max(p2), 6) AS p_max FROM q GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _rounded(M.probe_max(_probs(t), "p2", ["tile_id"]))


_T = "(sum(p{k} * (gt = {k})::INT) + 1e-6) / (sum(p{k} * (gt = {k})::INT) + 0.3 * sum(p{k} * (gt <> {k})::INT) + 0.7 * sum((1 - p{k}) * (gt = {k})::INT) + 1e-6)"


@query("a25_focal_tversky", "fx_pixels", _X + f"SELECT round((pow(1 - {_T.format(k=0)}, 1.33) + pow(1 - {_T.format(k=1)}, 1.33) + 2 * pow(1 - {_T.format(k=2)}, 1.33)) / 4, 6) AS loss FROM q")
def _(t: Tables) -> DataFrame:
    return _rounded(M.focal_tversky(_probs(t), ["p0", "p1", "p2"], weights=[1.0, 1.0, 2.0]))


@query("a26_cross_entropy", "fx_pixels", _X + "SELECT round(0.9 * sum(-ln(CASE gt WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) * (CASE WHEN gt = 2 THEN 2 ELSE 1 END)) / sum(CASE WHEN gt = 2 THEN 2 ELSE 1 END) + 0.1 * sum((-ln(p0) - ln(p1) - 2 * ln(p2)) / 3) / sum(CASE WHEN gt = 2 THEN 2 ELSE 1 END), 6) AS loss FROM q")
def _(t: Tables) -> DataFrame:
    return _rounded(M.cross_entropy(_probs(t), ["p0", "p1", "p2"], [1.0, 1.0, 2.0], 0.1))


_KEPT = "CASE WHEN before <= 0 THEN TRUE ELSE after / before >= 0.5 AND after >= greatest(ceil(0.5 * before), least(3, before)) END"


@query("l9_pathology_preserved", "fx_pixels", f", n AS (SELECT tile_id, COUNT(*) FILTER (gt = 2) AS before, COUNT(*) FILTER (gt = 2 AND z2 > 0) AS after FROM fx_pixels GROUP BY 1) SELECT tile_id, {_KEPT} AS kept FROM n")
def _(t: Tables) -> DataFrame:
    hit = lambda c: F.sum(c.cast("long"))
    n = t.pixels().groupBy("tile_id").agg(hit(F.col("gt") == 2).alias("before"), hit((F.col("gt") == 2) & (F.col("z2") > 0)).alias("after"))
    return n.select("tile_id", M.pathology_preserved(F.col("before"), F.col("after"), 0.5, 3).alias("kept"))


@query("j15_compare_audits", "fx_pixels", _X + f""", s AS (SELECT {_COUNTS} FROM x), o AS (SELECT COUNT(*) FILTER (gt = 2 AND p = 2) AS tp, COUNT(*) FILTER (gt <> 2 AND p = 2) AS fp, COUNT(*) FILTER (gt = 2 AND p <> 2) AS fn, COUNT(*) FILTER (gt <> 2 AND p <> 2) AS tn FROM (SELECT gt, CASE WHEN z0 >= z2 AND z0 >= z1 THEN 0 WHEN z2 >= z1 THEN 1 ELSE 2 END AS p FROM fx_pixels)),
 a AS (UNPIVOT (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, tp/(tp+fp+fn) AS iou, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1 FROM s) ON COLUMNS(*) INTO NAME metric VALUE v),
 b AS (UNPIVOT (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, tp/(tp+fp+fn) AS iou, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1 FROM o) ON COLUMNS(*) INTO NAME metric VALUE v)
SELECT metric, round(a.v, 6) AS new, round(b.v, 6) AS old, round(a.v - b.v, 6) AS delta FROM a JOIN b USING (metric)""")
def _(t: Tables) -> DataFrame:
    new = M.global_metrics(M.predicted(t.pixels()))
    swapped = t.pixels().select("tile_id", "gt", "z0", F.col("z2").alias("z1"), F.col("z1").alias("z2"))
    return _rounded(M.compare_audits(new, M.global_metrics(M.predicted(swapped))))


@query("w8_best_checkpoint", "fx_scores", ", m AS (SELECT tile_id, epoch, round(avg(score), 6) AS m FROM fx_scores GROUP BY 1, 2), b AS (SELECT *, max(m) OVER (PARTITION BY tile_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), k AS (SELECT tile_id, epoch, m FROM b WHERE before IS NULL OR m > before) SELECT tile_id, epoch, m, epoch = max(epoch) OVER (PARTITION BY tile_id) AS is_best FROM k")
def _(t: Tables) -> DataFrame:
    m = t.scores().groupBy("tile_id", "epoch").agg(F.round(F.avg("score"), 6).alias("m"))
    return R.best_checkpoint(m, ["tile_id"], "epoch", "m")


_BAL = ", n AS (SELECT tile_id, COUNT(*) FILTER (gt = 2 AND z2 > 0) AS px FROM fx_pixels GROUP BY 1), w AS (SELECT *, CASE WHEN px >= 4 THEN 0.5::DOUBLE / count(*) FILTER (px >= 4) OVER () ELSE 0.5::DOUBLE / count(*) FILTER (px < 4) OVER () END AS weight FROM n) "


def _weights(t: Tables) -> DataFrame:
    n = t.pixels().groupBy("tile_id").agg(F.sum(((F.col("gt") == 2) & (F.col("z2") > 0)).cast("long")).alias("px"))
    return R.balance_weights(n, "px", 0.5, 4)


@query("w16_balance_weights", "fx_pixels", _BAL + "SELECT tile_id, px, round(weight, 9) AS weight FROM w")
def _(t: Tables) -> DataFrame:
    return _weights(t).withColumn("weight", F.round("weight", 9))


@query("o5_weighted_sample", "fx_pixels", _BAL + ", u AS (SELECT tile_id, weight, (CAST(concat('0x', substr(md5(concat('42|', tile_id)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM w) SELECT tile_id FROM u ORDER BY -ln(u) / weight, tile_id LIMIT 40")
def _(t: Tables) -> DataFrame:
    return R.weighted_sample(_weights(t), "tile_id", "weight", 40).select("tile_id")


@query("o5_weighted_sample_replacement", "fx_pixels", _BAL + """, c AS (SELECT tile_id, sum(weight) OVER (ORDER BY tile_id) AS hi, weight, sum(weight) OVER () AS total FROM w),
 d AS (SELECT i AS draw, (CAST(concat('0x', substr(md5(concat('43|', i)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM range(0, (SELECT COUNT(*) FROM embeddings)) r(i))
SELECT draw, tile_id FROM d JOIN c ON u * total >= hi - weight AND u * total < hi""")
def _(t: Tables) -> DataFrame:
    w = _weights(t)
    return R.weighted_sample(w, "tile_id", "weight", t.read("embeddings").count(), replacement=True).select("draw", "tile_id")


@query("o2_top_errors", "fx_pixels", _X + f"SELECT tile_id, fp FROM ({_SAMPLES}) ORDER BY fp DESC, tile_id LIMIT 80")
def _(t: Tables) -> DataFrame:
    return R.top_rows(M.sample_metrics(M.predicted(t.pixels())), "fp", 80, "tile_id").select("tile_id", "fp")


@query("d2_classify_images", "fx_pixels", _X + "SELECT tile_id, px, pred FROM x")
def _(t: Tables) -> DataFrame:
    rows = t.pixels().withColumn("values", F.array("z0", "z1", "z2"))
    return classify_images(rows.select("tile_id", "px", "values"), softmax_model, 3, 256).select("tile_id", "px", "pred")


def softmax_model(values: np.ndarray) -> np.ndarray:
    """A stand-in for a classifier: softmax of its inputs."""
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
