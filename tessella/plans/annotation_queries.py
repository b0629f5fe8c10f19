"""Queries over annotation records, labels, files and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.operators import annotations as A
from tessella.operators import ranking as R
from tessella.plans.fixtures import Tables
from tessella.plans.registry import met, query
from tessella.storage import stored

KEY = ["slide_id", "ann_idx"]
ABNORMAL = {"LSIL": 2, "HSIL": 2, "Group HSIL": 2, "ASCH": 2}
_TRIM = "trim(label, '?) ')"
_POLY = "NOT contains(lower(label), 'rect')"


def _box():
    return F.struct("xmin", "ymin", "xmax", "ymax")


@query("p1_normalize_label", "fx_annotations", f"SELECT slide_id, ann_idx, {_TRIM} AS label FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.normalize_label(F.col("label")).alias("label"))


@query("p2_is_rect", "fx_annotations", "SELECT slide_id, ann_idx, contains(lower(label), 'rect') AS is_rect FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.is_rect(F.col("label")).alias("is_rect"))


@query("p3_rect_number", "fx_annotations", r"SELECT slide_id, ann_idx, coalesce(TRY_CAST(regexp_extract(label, '(?i)^\s*rect\s*(\d+)\s*$', 1) AS INT), 2147483647) AS n FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.rect_number(F.col("label")).alias("n"))


@query("p4_class_of", "fx_annotations", f"SELECT slide_id, ann_idx, CASE WHEN {_TRIM} IN ('LSIL', 'HSIL', 'Group HSIL', 'ASCH') THEN 255 ELSE 127 END AS mask FROM fx_annotations WHERE {_POLY}")
def _(t: Tables) -> DataFrame:
    return A.draw_class(A.polygons(t.annotations()), ABNORMAL).select(*KEY, "mask")


@query("p5_trunc_coord", "", "SELECT l_orderkey, l_linenumber, CAST(trunc(TRY_CAST(CASE WHEN l_returnflag = 'N' THEN concat('x', l_shipdate::VARCHAR) ELSE CAST(l_discount * 100 - l_quantity AS VARCHAR) END AS DOUBLE)) AS INT) AS at FROM lineitem")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("x"), F.col("l_shipdate").cast("string"))).otherwise((F.col("l_discount") * 100 - F.col("l_quantity")).cast("string"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", L.trunc_coord(text).alias("at"))


@query("p6_llround", "", "SELECT l_orderkey, l_linenumber, CAST(round((l_partkey - 5000) / 2.0::DOUBLE) AS BIGINT) AS at FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.read("lineitem").select("l_orderkey", "l_linenumber", L.llround((F.col("l_partkey") - 5000) / F.lit(2.0)).alias("at"))


@query("p7_bbox_from_points", "fx_regions", "SELECT slide_id, ann_idx, list_min([p.x FOR p IN points]) AS xmin, list_min([p.y FOR p IN points]) AS ymin, list_max([p.x FOR p IN points]) AS xmax, list_max([p.y FOR p IN points]) AS ymax FROM fx_regions")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.bbox_from_points(F.col("points")).alias("b")).select(*KEY, "b.*")


@query("p8_close_polygon", "fx_regions", "SELECT slide_id, ann_idx, CAST(7 AS INT) AS n, points[1].x AS last_x, points[1].y AS last_y FROM fx_regions")
def _(t: Tables) -> DataFrame:
    p = L.close_polygon(F.col("points"))
    return t.annotations().select(*KEY, F.size(p).alias("n"), F.element_at(p, -1)["x"].alias("last_x"), F.element_at(p, -1)["y"].alias("last_y"))


@query("p9_effective_bbox", "fx_regions", "SELECT slide_id, ann_idx, xmin, CAST(CASE WHEN ann_idx % 3 = 0 OR NOT contains(lower(label), 'rect') THEN list_max([p.x FOR p IN points]) ELSE xmax + 7 END AS INT) AS xmax FROM fx_regions")
def _(t: Tables) -> DataFrame:
    stored = F.struct("xmin", "ymin", F.when(F.col("ann_idx") % 3 == 0, F.col("xmin")).otherwise(F.col("xmax") + 7).alias("xmax"), "ymax")
    return t.annotations().select(*KEY, L.effective_bbox(L.is_rect(F.col("label")), stored, F.col("points")).alias("b")).filter("b is not null").select(*KEY, "b.xmin", "b.xmax")


@query("p10_to_local", "fx_regions", "SELECT slide_id, ann_idx, CAST(list_sum([p.x - xmin FOR p IN points]) AS BIGINT) AS sx, CAST(list_sum([p.y - ymin FOR p IN points]) AS BIGINT) AS sy FROM fx_regions")
def _(t: Tables) -> DataFrame:
    p = L.to_local(F.col("points"), F.col("xmin"), F.col("ymin"))
    total = lambda k: F.aggregate(p, F.lit(0).cast("long"), lambda a, v: a + v[k])
    return t.annotations().select(*KEY, total("x").alias("sx"), total("y").alias("sy"))


@query("p11_scale_level", "fx_annotations", "SELECT slide_id, ann_idx, CAST(trunc(xmin * 2.37::DOUBLE) AS INT) AS x, CAST(trunc(ymin * 2.37::DOUBLE) AS INT) AS y, least(xmax, ymin) AS drag_x0, greatest(xmax, ymin) AS drag_x1 FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    b = L.ordered_box(F.col("xmax"), F.col("ymax"), F.col("ymin"), F.col("xmin"))
    return t.annotations().select(*KEY, L.scale_level(F.col("xmin"), F.lit(2.37)).alias("x"), L.scale_level(F.col("ymin"), F.lit(2.37)).alias("y"), b["xmin"].alias("drag_x0"), b["xmax"].alias("drag_x1"))


@query("p14_float_or_text", "fx_slides", "SELECT slide_id, TRY_CAST(objective_power AS DOUBLE) AS number, CASE WHEN TRY_CAST(objective_power AS DOUBLE) IS NULL THEN objective_power END AS text FROM fx_slides")
def _(t: Tables) -> DataFrame:
    return t.slides().select("slide_id", L.float_or_text(F.col("objective_power")).alias("v")).select("slide_id", "v.*")


@query("p15_slide_mpp", "fx_slides", "SELECT slide_id, round(coalesce((TRY_CAST(objective_power AS DOUBLE) + bytes % 7) / 2, 0), 6) AS mpp FROM fx_slides")
def _(t: Tables) -> DataFrame:
    return t.slides().select("slide_id", F.round(L.slide_mpp(F.col("objective_power"), (F.col("bytes") % 7).cast("string")), 6).alias("mpp"))


@query("p16_slugify", "", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", L.slugify(F.col("text")).alias("slug"))


@query("p17_tile_name", "fx_annotations", "SELECT slide_id, ann_idx, concat(slide_id, '__', label, '_ind_', ann_idx, '_coords_', ymin, '_', xmin, '_', xmax - xmin) AS name, label AS rect_name, 'ind' AS kind, ann_idx AS number, ymin AS y, xmin AS x, xmax - xmin AS size FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    name = L.tile_name(F.col("slide_id"), F.col("label"), F.col("ymin"), F.col("xmin"), F.col("xmax") - F.col("xmin"), "ind", F.col("ann_idx"))
    return t.annotations().select(*KEY, name.alias("name")).withColumn("p", L.parse_tile_name(F.col("name"))).select("p.slide_id", "ann_idx", "name", "p.rect_name", "p.kind", "p.number", "p.y", "p.x", "p.size")


@query("p30_contour_to_tile", "fx_regions", "SELECT slide_id, ann_idx, CAST(trunc((points[2].x - 1000) * 0.25::DOUBLE) AS INT) AS x, CAST(trunc((points[2].y - 500) * 0.25::DOUBLE) AS INT) AS y FROM fx_regions")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.contour_to_tile(F.col("points"), F.lit(1000), F.lit(500), F.lit(0.25))[1].alias("p")).select(*KEY, "p.x", "p.y")


@query("p31_dedup_key", "fx_regions", "SELECT slide_id, ann_idx, concat_ws('|', lower(trim(label)), CASE WHEN contains(lower(label), 'rect') THEN '1' ELSE '0' END, concat_ws(',', xmin, ymin, xmax, ymax), '6', array_to_string([concat(p.x, ',', p.y) FOR p IN points], ';')) AS key FROM fx_regions")
def _(t: Tables) -> DataFrame:
    return t.annotations().select(*KEY, L.dedup_key(F.col("label"), L.is_rect(F.col("label")), _box(), F.col("points")).alias("key"))


@query("p36_relabel_valid", "fx_annotations", "SELECT slide_id, ann_idx, CASE WHEN contains(label, 'rect') THEN xmin % 2 = 0 ELSE xmin % 2 = 1 END AS valid FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    new = F.when(F.col("xmin") % 2 == 0, " Rect 9 ").otherwise("LSIL")
    return t.annotations().select(*KEY, L.relabel_valid(F.col("label"), new).alias("valid"))


@query("l1_cell_size_filter", "fx_annotations", "SELECT slide_id, ann_idx FROM fx_annotations WHERE xmax - xmin BETWEEN 100 AND 200 AND ymax - ymin BETWEEN 100 AND 200")
def _(t: Tables) -> DataFrame:
    return A.cell_size_filter(t.annotations()).select(*KEY)


@query("l2_rect_width_limit", "fx_annotations", "SELECT slide_id, ann_idx AS rect_idx, xmax - xmin AS width FROM fx_annotations WHERE contains(lower(label), 'rect') AND xmax - xmin <= 1500")
def _(t: Tables) -> DataFrame:
    return A.rect_width_limit(A.rectangles(t.annotations()), 1500).select("slide_id", "rect_idx", (F.col("rx1") - F.col("rx0")).alias("width"))


@query("l3_drop_bad_contours", "fx_annotations", "SELECT slide_id, ann_idx FROM fx_annotations WHERE xmin % 6 >= 3 AND xmin % 11 <> 0")
def _(t: Tables) -> DataFrame:
    a = t.annotations().withColumn("points", F.slice("points", 1, F.col("xmin") % 6)).withColumn("label", F.when(F.col("xmin") % 11 == 0, "Annotation 7").otherwise(F.col("label")))
    return A.drop_bad_contours(a).select(*KEY)


@query("l12_exclude_old_markup", "fx_slides", "SELECT slide_id, path FROM (SELECT slide_id, CASE WHEN bytes % 3 = 0 THEN replace(path, '.', '_old.') ELSE path END AS path FROM fx_slides) WHERE NOT contains(path, '_old')")
def _(t: Tables) -> DataFrame:
    return A.exclude_old_markup(t.slides().select("slide_id", F.when(F.col("bytes") % 3 == 0, F.expr("replace(path, '.', '_old.')")).otherwise(F.col("path")).alias("path")))


_FILES = """, files AS (SELECT concat('/m/', CASE WHEN n % 3 = 0 THEN 'a_' ELSE '' END, slide_id, '.SUF') AS path FROM fx_slides WHERE n % 2 = 0
 UNION ALL SELECT concat('/m/z/', slide_id, '.SUF') FROM fx_slides WHERE n % 6 = 0)
SELECT slide_id, file FROM (SELECT s.slide_id, f.path AS file, row_number() OVER (PARTITION BY s.slide_id ORDER BY CASE WHEN regexp_extract(f.path, '[^/]*$') = concat(s.slide_id, '.SUF') THEN 0 ELSE 1 END, f.path) AS r
 FROM fx_slides s JOIN files f ON contains(f.path, concat(s.slide_id, '.SUF'))) WHERE r = 1"""


def _files(t: Tables, suffix: str) -> DataFrame:
    s = t.slides()
    a = s.filter("n % 2 = 0").select(F.concat(F.lit("/m/"), F.when(F.col("n") % 3 == 0, "a_").otherwise(""), "slide_id", F.lit(suffix)).alias("path"))
    return a.union(s.filter("n % 6 = 0").select(F.concat(F.lit("/m/z/"), "slide_id", F.lit(suffix)).alias("path")))


@query("j1_match_annotation_file", "fx_slides", _FILES.replace("SUF", "json"))
def _(t: Tables) -> DataFrame:
    return A.match_file(t.slides().select("slide_id"), _files(t, ".json"), ".json").select("slide_id", "file")


@query("j2_match_markup", "fx_slides", _FILES.replace("SUF", "xml"))
def _(t: Tables) -> DataFrame:
    return A.match_file(t.slides().select("slide_id"), _files(t, ".xml"), ".xml").select("slide_id", "file")


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = t.slides().select(F.col("slide_id").alias("name"), "n")
    return s.filter("n % 7 <> 0").select("name"), s.filter("n % 11 <> 0").select("name")


_IMAGES = ", images AS (SELECT slide_id AS name FROM fx_slides WHERE n % 7 <> 0), masks AS (SELECT slide_id AS name FROM fx_slides WHERE n % 11 <> 0) "


@query("j10_pair_images_masks", "fx_slides", _IMAGES + "SELECT name FROM images JOIN masks USING (name)")
def _(t: Tables) -> DataFrame:
    images, masks = _names(t)
    return images.join(masks, "name")


@query("j11_orphan_pairs", "fx_slides", _IMAGES + "SELECT * FROM (SELECT 'mask' AS missing, name FROM images ANTI JOIN masks USING (name) ORDER BY name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'image' AS missing, name FROM masks ANTI JOIN images USING (name) ORDER BY name LIMIT 10)")
def _(t: Tables) -> DataFrame:
    images, masks = _names(t)
    lost = lambda a, b, what: R.limit_samples(a.join(b, "name", "left_anti"), "name", 10).select(F.lit(what).alias("missing"), "name")
    return lost(images, masks, "mask").union(lost(masks, images, "image"))


@query("u6_missing_names", "fx_slides", _IMAGES + "SELECT 'mask' AS missing, name FROM (SELECT name FROM images EXCEPT SELECT name FROM masks) UNION ALL SELECT 'image' AS missing, name FROM (SELECT name FROM masks EXCEPT SELECT name FROM images)")
def _(t: Tables) -> DataFrame:
    images, masks = _names(t)
    return images.subtract(masks).select(F.lit("mask").alias("missing"), "name").union(masks.subtract(images).select(F.lit("image").alias("missing"), "name"))


@query("a1_label_counts", "fx_annotations", f"SELECT slide_id, {_TRIM} AS label, COUNT(*) AS n FROM fx_annotations WHERE {_POLY} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return A.label_counts(t.annotations())


_REPORT = f"""SELECT slide_id, label, n, level FROM (SELECT slide_id, label, COUNT(*) AS n, CAST(GROUPING(slide_id, label) AS INT) AS level
 FROM (SELECT slide_id, CASE WHEN {_POLY} THEN {_TRIM} END AS label FROM fx_annotations) GROUP BY GROUPING SETS ((slide_id, label), (label), (slide_id), ())) WHERE label IS NOT NULL OR level % 2 = 1"""


@query("a2_label_report", "fx_annotations", _REPORT)
def _(t: Tables) -> DataFrame:
    return A.label_report(t.annotations())


@query("s12_markdown_report", "fx_annotations", f"""SELECT concat_ws('/', coalesce(slide_id, '~'), CASE WHEN label IS NULL THEN CASE WHEN slide_id IS NULL THEN '~' ELSE '' END ELSE label END) AS at,
 CASE WHEN slide_id IS NULL AND label IS NULL THEN concat('**Total: ', n, '**') WHEN slide_id IS NULL THEN concat('- all ', label, ': ', n) WHEN label IS NULL THEN concat('## ', slide_id, ': ', n) ELSE concat('- ', label, ': ', n) END AS line FROM ({_REPORT})""")
def _(t: Tables) -> DataFrame:
    return A.markdown_report(A.label_report(t.annotations()))


@query("a3_svs_totals", "fx_annotations", f"SELECT coalesce({_TRIM}, 'Total objects') AS label, COUNT(*) AS n FROM fx_annotations WHERE {_POLY} GROUP BY ROLLUP ({_TRIM})")
def _(t: Tables) -> DataFrame:
    return A.label_totals(t.annotations())


@query("a4_property_extremes", "fx_slides", "SELECT max(TRY_CAST(objective_power AS DOUBLE)) AS power_max, min(TRY_CAST(objective_power AS DOUBLE)) AS power_min, max(bytes) AS bytes_max, min(bytes) AS bytes_min FROM fx_slides")
def _(t: Tables) -> DataFrame:
    p = L.float_or_text(F.col("objective_power"))["number"]
    return t.slides().agg(F.max(p).alias("power_max"), F.min(p).alias("power_min"), F.max("bytes").alias("bytes_max"), F.min("bytes").alias("bytes_min"))


@query("a5_size_summary", "fx_slides", "SELECT COUNT(*) AS n, max(bytes) AS most, min(bytes) AS least, (max(bytes) + min(bytes)) / 2 AS midpoint, round(avg(bytes), 6) AS mean FROM fx_slides")
def _(t: Tables) -> DataFrame:
    return t.slides().agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most"), F.min("bytes").alias("least"), ((F.max("bytes") + F.min("bytes")) / 2).alias("midpoint"), F.round(F.avg("bytes"), 6).alias("mean"))


@query("a23_rects_per_slide", "fx_annotations", "SELECT slide_id, COUNT(*) AS n FROM fx_annotations WHERE contains(lower(label), 'rect') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.rects_per_slide(t.annotations())


@query("s2_slide_sizes", "fx_slides", "SELECT slide_id, CAST(SUM(bytes) AS BIGINT) AS bytes FROM (SELECT slide_id, bytes FROM fx_slides UNION ALL SELECT slide_id, bytes % 1000 FROM fx_slides UNION ALL SELECT slide_id, 17 FROM fx_slides WHERE n % 2 = 0) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from tessella.sources.files import slide_sizes

    s = t.slides()
    own = s.select(F.concat(F.lit("/d/"), "slide_id", F.lit(".mrxs")).alias("path"), F.col("bytes").alias("length"))
    part = s.select(F.concat(F.lit("/d/"), "slide_id", F.lit("/Data0001.dat")).alias("path"), (F.col("bytes") % 1000).alias("length"))
    index = s.filter("n % 2 = 0").select(F.concat(F.lit("/d/"), "slide_id", F.lit("/Slidedat.ini")).alias("path"), F.lit(17).cast("long").alias("length"))
    return slide_sizes(own.union(part).union(index), "mrxs").select("slide_id", "bytes")


@query("s8_slide_properties", "fx_slides", "SELECT slide_id, TRY_CAST(objective_power AS DOUBLE) AS objective_power, CASE WHEN TRY_CAST(objective_power AS DOUBLE) IS NULL THEN objective_power END AS objective_power_text, CAST(bytes % 5 AS DOUBLE) AS level_count FROM fx_slides")
def _(t: Tables) -> DataFrame:
    from tessella.sources.files import slide_properties

    s = t.slides()
    kv = s.select("slide_id", F.lit("objective_power").alias("key"), F.col("objective_power").alias("value")).union(s.select("slide_id", F.lit("level_count"), (F.col("bytes") % 5).cast("string")))
    return slide_properties(kv, ["objective_power", "level_count"]).select("slide_id", "objective_power", "objective_power_text", "level_count")


@query("w3_sequence_ids", "fx_annotations", f"SELECT slide_id, ann_idx, CAST(row_number() OVER (PARTITION BY slide_id, {_TRIM} ORDER BY ann_idx) - 1 AS INT) AS seq FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    a = t.annotations().withColumn("kind", L.normalize_label(F.col("label")))
    return R.sequence_ids(a, ["slide_id", "kind"], ["ann_idx"]).select(*KEY, "seq")


@query("w4_split_evenly", "fx_slides", "SELECT slide_id, CAST(ntile(7) OVER (ORDER BY slide_id) - 1 AS INT) AS chunk FROM fx_slides")
def _(t: Tables) -> DataFrame:
    return R.split_evenly(t.slides().select("slide_id"), 7, "slide_id")


@query("w5_batch_bounds", "fx_annotations", "SELECT slide_id, (r - 1) // 30 AS batch, min(r - 1) AS first, max(r - 1) AS last FROM (SELECT slide_id, row_number() OVER (PARTITION BY slide_id ORDER BY ann_idx) AS r FROM fx_annotations) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return R.batch_bounds(t.annotations(), 30, "slide_id")


_SPLIT = ", r AS (SELECT slide_id AS name, row_number() OVER (ORDER BY md5(concat('42|', slide_id)), slide_id) - 1 AS r, COUNT(*) OVER () AS n FROM fx_slides), v AS (SELECT *, greatest(n - CAST(trunc((1 - 0.2::DOUBLE) * n) AS BIGINT), 1) AS val FROM r) "


@query("w6_split_static", "fx_slides", _SPLIT + "SELECT name, r < val AS is_val FROM v")
def _(t: Tables) -> DataFrame:
    return R.split_static(t.slides().select(F.col("slide_id").alias("name")), "name", 0.2)


@query("w7_split_cyclic", "fx_slides", _SPLIT + "SELECT name, (r - (3 * val) % n + n) % n < val AS is_val FROM v")
def _(t: Tables) -> DataFrame:
    return R.split_cyclic(t.slides().select(F.col("slide_id").alias("name")), "name", 0.2, 3)


@query("u5_train_complement", "fx_slides", _SPLIT + "SELECT name FROM v WHERE (r - (3 * val) % n + n) % n >= val")
def _(t: Tables) -> DataFrame:
    names = t.slides().select(F.col("slide_id").alias("name"))
    return names.join(R.split_cyclic(names, "name", 0.2, 3).filter("is_val"), "name", "left_anti")


@query("w9_next_rect_labels", "fx_annotations", r""", top AS (SELECT slide_id, max(TRY_CAST(regexp_extract(label, '^rect (\d+)$', 1) AS INT)) AS m FROM fx_annotations GROUP BY 1)
SELECT a.slide_id, a.ann_idx, concat('rect ', coalesce(m, 0) + row_number() OVER (PARTITION BY a.slide_id ORDER BY ann_idx)) AS label FROM fx_annotations a JOIN top USING (slide_id) WHERE label = 'normal'""")
def _(t: Tables) -> DataFrame:
    a = t.annotations()
    return A.next_rect_labels(a, a.filter("label = 'normal'").select(*KEY), "ann_idx").select(*KEY, "label")


@query("o1_order_annotations", "fx_annotations", r"SELECT slide_id, ann_idx, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY CASE WHEN contains(label, 'rect') THEN 0 ELSE 1 END, coalesce(TRY_CAST(regexp_extract(label, '^rect (\d+)$', 1) AS INT), 2147483647), lower(trim(label)), ann_idx) AS INT) AS place FROM fx_annotations")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.annotations().select(*KEY, F.row_number().over(Window.partitionBy("slide_id").orderBy(*A.annotation_order())).alias("place"))


@query("o3_limit_samples", "fx_slides", "SELECT slide_id FROM fx_slides ORDER BY slide_id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return R.limit_samples(t.slides().select("slide_id"), "slide_id", 25)


@query("o4_sample_regions", "fx_annotations", f"SELECT slide_id, ann_idx FROM fx_annotations WHERE {_POLY} ORDER BY md5(concat('42|', slide_id, ':', ann_idx)), concat(slide_id, ':', ann_idx) LIMIT 50")
def _(t: Tables) -> DataFrame:
    return R.sample_rows(A.polygons(t.annotations()), F.concat("slide_id", F.lit(":"), F.col("ann_idx").cast("string")), 50).select(*KEY)


@query("o7_label_palette", "fx_annotations", f"SELECT DISTINCT trim(label) AS label FROM fx_annotations WHERE {_POLY}")
def _(t: Tables) -> DataFrame:
    return A.label_palette(t.annotations())


@query("u1_merge_annotations", "fx_regions", """, b AS (SELECT * FROM fx_regions WHERE ann_idx % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY slide_id, lower(trim(label)), xmin, ymin, xmax, ymax ORDER BY ann_idx) AS r FROM fx_regions WHERE ann_idx % 2 = 1 OR ann_idx % 5 = 0)
SELECT slide_id, ann_idx, FALSE AS added FROM b UNION ALL SELECT slide_id, ann_idx, TRUE FROM k WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.slide_id = k.slide_id AND lower(trim(b.label)) = lower(trim(k.label)) AND b.xmin = k.xmin AND b.ymin = k.ymin AND b.xmax = k.xmax AND b.ymax = k.ymax)""")
def _(t: Tables) -> DataFrame:
    a = t.annotations()
    return A.merge_annotations(a.filter("ann_idx % 2 = 0"), a.filter("ann_idx % 2 = 1 or ann_idx % 5 = 0")).select(*KEY, "added")


@query("r20_label_atlas", "fx_annotations", f"SELECT slide_id, trim(label, '?)') AS label, ann_idx, xmin AS x, ymin AS y, xmax - xmin AS width, ymax - ymin AS height, concat(ann_idx, '_', trim(label, '?)'), '_coords_', xmin, '_', ymin) AS name FROM fx_annotations WHERE {_POLY}")
def _(t: Tables) -> DataFrame:
    return A.atlas(t.annotations())


_CELLS, _MET = met("p", ("xmin", "ymin", "xmax", "ymax"), "p", ("xmin", "ymin", "xmax", "ymax"))
_NEAR = f""", p AS (SELECT * FROM fx_annotations WHERE {_POLY}){_CELLS}, q AS (SELECT a.slide_id, a.ann_idx AS a, b.ann_idx AS b FROM {_MET} WHERE a.ann_idx < b.ann_idx
 AND (sqrt((a.xmin-b.xmin)**2+(a.ymin-b.ymin)**2) <= 60 OR sqrt((a.xmax-b.xmax)**2+(a.ymin-b.ymin)**2) <= 60 OR sqrt((a.xmin-b.xmin)**2+(a.ymax-b.ymax)**2) <= 60 OR sqrt((a.xmax-b.xmax)**2+(a.ymax-b.ymax)**2) <= 60)
 AND CASE WHEN least(a.xmax,b.xmax) >= greatest(a.xmin,b.xmin) AND least(a.ymax,b.ymax) >= greatest(a.ymin,b.ymin) THEN (least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin))*(least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)) ELSE 0 END
  >= 0.2 * greatest((a.xmax-a.xmin)*(a.ymax-a.ymin), (b.xmax-b.xmin)*(b.ymax-b.ymin))) """


@query("j4_near_duplicates", "fx_annotations", _NEAR + "SELECT * FROM q")
def _(t: Tables) -> DataFrame:
    return A.near_pairs(t.annotations(), 60)


@query("u2_resolve_near_duplicates", "fx_annotations", "RECURSIVE" + _NEAR + """, k AS (SELECT slide_id, b, list(a ORDER BY a) AS close, row_number() OVER (PARTITION BY slide_id ORDER BY b) AS n FROM q GROUP BY 1, 2),
 r(slide_id, n, dead) AS (SELECT DISTINCT slide_id, 0::BIGINT, []::INT[] FROM k UNION ALL SELECT r.slide_id, k.n, CASE WHEN len(list_filter(close, lambda x: NOT list_contains(dead, x))) > 0 THEN list_append(dead, list_filter(close, lambda x: NOT list_contains(dead, x))[1]) ELSE dead END FROM r JOIN k ON k.slide_id = r.slide_id AND k.n = r.n + 1),
 d AS (SELECT slide_id, unnest(dead) AS ann_idx FROM (SELECT slide_id, arg_max(dead, n) AS dead FROM r GROUP BY 1))
SELECT slide_id, ann_idx FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.slide_id = p.slide_id AND d.ann_idx = p.ann_idx)""")
def _(t: Tables) -> DataFrame:
    # Read three times; numbering the records anew each time would shuffle and sort them all.
    return A.resolve_near_duplicates(stored(t.annotations().drop("points"), "annotations"), 60).select(*KEY)
