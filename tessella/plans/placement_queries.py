"""Queries of tile placement over masks. Sizes suit images of SIDE pixels; see SMALL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import placement as P
from tessella.operators import raster as R
from tessella.operators.spatial import tiles_covering_records
from tessella.operators.sums import summed_area
from tessella.plans.dataset import build_dataset
from tessella.plans.fixtures import SIDE, Tables
from tessella.plans.registry import query
from tessella.storage import stored

MASK = "fx_discs fx_mask"
SMALL = {"padding": 6, "min_padding": 2, "step": 2, "margin": 1, "min_tile": 12}
_BUILD = {**SMALL, "distance": 16, "expand": 10, "normal_tile": 12, "shift": 4}
_OBJ = ", o AS (SELECT img_id, disc::INT AS obj_id, cy, cx, greatest(0, cy - r) AS y1, greatest(0, cx - r) AS x1, least(47, cy + r) AS y2, least(47, cx + r) AS x2 FROM fx_discs) "


def _objects(t: Tables) -> DataFrame:
    """Discs as objects, with the box that lies in the image."""
    d = t.discs()
    low = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("r"))
    high = lambda c: F.least(F.lit(SIDE - 1), F.col(c) + F.col("r"))
    return d.select("img_id", F.col("disc").cast("int").alias("obj_id"), "cy", "cx", low("cy").alias("y1"), low("cx").alias("x1"), high("cy").alias("y2"), high("cx").alias("x2"))


def _images(t: Tables) -> DataFrame:
    return t.discs().select("img_id").distinct().select("img_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))


def _sick(t: Tables) -> DataFrame:
    return R.run_length_encode(t.mask().filter("cls = 2")).select("img_id", "y", "x0", "x1")


def _sums(t: Tables) -> DataFrame:
    return stored(summed_area(_sick(t), _images(t)), "sums")


@query("r25_center_tile", "fx_discs", _OBJ + "SELECT img_id, obj_id, cy - s // 2 AS y1, cx - s // 2 AS x1, s AS size FROM (SELECT *, greatest(greatest(y2 - y1, x2 - x1) + 12, 12)::INT AS s FROM o)")
def _(t: Tables) -> DataFrame:
    return P.center_tile(_objects(t), 6, 12)


_TFO = _OBJ + ", t AS (SELECT img_id, obj_id, greatest(0, least((y1 + y2) // 2 - s // 2, 48 - s))::INT AS y1, greatest(0, least((x1 + x2) // 2 - s // 2, 48 - s))::INT AS x1, s AS size FROM (SELECT *, greatest(greatest(y2 - y1, x2 - x1) + 12, 12)::INT AS s FROM o) WHERE s <= 48) "


@query("r29_tile_for_objects", "fx_discs", _TFO + "SELECT * FROM t")
def _(t: Tables) -> DataFrame:
    return P.tile_for_objects(_objects(t), _images(t), 6, 12)


@query("r26_truncation_check", MASK, _TFO + "SELECT DISTINCT t.img_id, obj_id FROM t JOIN fx_mask m ON m.img_id = t.img_id AND cls = 2 AND m.y >= t.y1 AND m.y < t.y1 + size AND m.x >= t.x1 AND m.x < t.x1 + size WHERE m.y < t.y1 + 2 OR m.y >= t.y1 + size - 2 OR m.x < t.x1 + 2 OR m.x >= t.x1 + size - 2")
def _(t: Tables) -> DataFrame:
    return P.truncation_check(P.tile_for_objects(_objects(t), _images(t), 6, 12), _sick(t), ["obj_id"], 2)


_BAND = "EXISTS (SELECT 1 FROM fx_mask m WHERE m.img_id = c.img_id AND cls = 2 AND m.y >= c.ty AND m.y < c.ty + s AND m.x >= c.tx AND m.x < c.tx + s AND (m.y < c.ty + 1 OR m.y >= c.ty + s - 1 OR m.x < c.tx + 1 OR m.x >= c.tx + s - 1))"


@query("r22_fit_tile", MASK, _OBJ + f""", k AS (SELECT *, greatest(greatest(y2 - y1, x2 - x1) + 2 * pad, 12) + extra AS s FROM o, (VALUES (6), (4), (2)) p(pad), range(0, 11, 10) e(extra)),
 c AS (SELECT img_id, obj_id, pad, extra, s, greatest(0, least((y1 + y2) // 2 - s // 2, 48 - s)) AS ty, greatest(0, least((x1 + x2) // 2 - s // 2, 48 - s)) AS tx FROM k WHERE s <= 48)
SELECT img_id, obj_id, ty::INT AS y1, tx::INT AS x1, s::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY img_id, obj_id ORDER BY pad DESC, extra) AS r FROM c WHERE NOT {_BAND}) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return P.fit_tile(_objects(t), _images(t), _sums(t), expand=10, **SMALL)


_OFF = _OBJ + """, k AS (SELECT *, greatest(greatest(y2 - y1, x2 - x1) + 2 * pad, 12) AS s FROM o, (VALUES (6), (4), (2)) p(pad)),
 b AS (SELECT *, greatest(0, y2 + greatest({m}, 1) - s) AS ya, least(y1 - {m}, 48 - s) AS yz, greatest(0, x2 + greatest({m}, 1) - s) AS xa, least(x1 - {m}, 48 - s) AS xz FROM k WHERE s <= 48),
 c AS (SELECT img_id, obj_id, pad, s, ty, tx, (ty - least(greatest(cy - s // 2, ya), yz))**2 + (tx - least(greatest(cx - s // 2, xa), xz))**2 AS d FROM b, LATERAL (SELECT unnest(range(ya, yz + 1)) AS ty), LATERAL (SELECT unnest(range(xa, xz + 1)) AS tx) WHERE ya <= yz AND xa <= xz),
 ii AS (SELECT img_id, y, x, sum(s) OVER (PARTITION BY img_id, x ORDER BY y) AS v FROM (SELECT img_id, y, x, sum((cls = 2)::INT) OVER (PARTITION BY img_id, y ORDER BY x) AS s FROM fx_mask)) """
_AT = "coalesce((SELECT v FROM ii WHERE ii.img_id = c.img_id AND ii.y = {y} - 1 AND ii.x = {x} - 1), 0)"


def _rect(y1: str, x1: str, y2: str, x2: str) -> str:
    at = lambda y, x: _AT.format(y=f"({y})", x=f"({x})")
    return f"({at(y2, x2)} - {at(y1, x2)} - {at(y2, x1)} + {at(y1, x1)})"


@query("r23_ring_placement", MASK, _OFF.format(m=1) + f"""SELECT img_id, obj_id, ty::INT AS y1, tx::INT AS x1, s::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY img_id, obj_id ORDER BY pad DESC, d, ty, tx) AS r FROM c
 WHERE {_rect('ty', 'tx', 'ty + s', 'tx + s')} = {_rect('ty + 1', 'tx + 1', 'ty + s - 1', 'tx + s - 1')}) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return P.ring_placement(_objects(t), _images(t), _sums(t), **SMALL)


@query("r24_force_placement", MASK, _OFF.format(m=0) + f"SELECT img_id, obj_id, ty::INT AS y1, tx::INT AS x1, s::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY img_id, obj_id ORDER BY n, d, pad DESC, ty, tx) AS r FROM (SELECT *, {_rect('ty', 'tx', 'ty + s', 'tx + s')} AS n FROM c)) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return P.force_placement(_objects(t), _images(t), _sums(t), **{k: v for k, v in SMALL.items() if k != "margin"})


@query("r30_avoid_pathology", MASK, _TFO + """, c AS (SELECT t.img_id, obj_id, size, t.y1 + dy AS y1, t.x1 + dx AS x1, dy, dx FROM t, LATERAL (SELECT unnest(range(-(size // 4) * 4, (size // 4) * 4 + 1, 4)) AS dy), LATERAL (SELECT unnest(range(-(size // 4) * 4, (size // 4) * 4 + 1, 4)) AS dx) WHERE t.y1 + dy >= 0 AND t.x1 + dx >= 0 AND t.y1 + dy + size <= 48 AND t.x1 + dx + size <= 48)
SELECT img_id, obj_id, y1::INT AS y1, x1::INT AS x1, size, dy <> 0 OR dx <> 0 AS shifted FROM (SELECT *, row_number() OVER (PARTITION BY img_id, obj_id ORDER BY dy * dy + dx * dx, dy, dx) AS r FROM c WHERE NOT EXISTS (SELECT 1 FROM fx_mask m WHERE m.img_id = c.img_id AND cls = 2 AND m.y >= c.y1 AND m.y < c.y1 + size AND m.x >= c.x1 AND m.x < c.x1 + size)) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return P.avoid_pathology(P.tile_for_objects(_objects(t), _images(t), 6, 12), _images(t), _sums(t), 4)


@query("w15_normal_quota", "fx_discs", """, n AS (SELECT img_id, disc AS obj_id, r % 3 <> 0 AS placed FROM fx_discs), b AS (SELECT img_id, COUNT(*) AS n FROM fx_discs WHERE cls = 2 GROUP BY 1),
 q AS (SELECT n.img_id, obj_id, placed, greatest(coalesce(b.n, 0), 5) AS target, coalesce(sum(placed::INT) OVER (PARTITION BY n.img_id ORDER BY obj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM n LEFT JOIN b USING (img_id))
SELECT img_id, obj_id, placed, target, done >= target AS skipped, placed AND done < target AS kept FROM q""")
def _(t: Tables) -> DataFrame:
    d = t.discs()
    normals = d.select("img_id", F.col("disc").alias("obj_id"), (F.col("r") % 3 != 0).alias("placed"))
    return P.normal_quota(normals, d.filter("cls = 2").groupBy("img_id").agg(F.count(F.lit(1)).alias("n")))


_PHASED = ", t AS (SELECT img_id, CASE disc % 3 WHEN 0 THEN 'grp' WHEN 1 THEN 'ind' ELSE 'norm' END AS kind, disc AS obj_id, cy // 12 AS y1, cx // 12 AS x1, 12::INT AS size, disc % 7 = 0 AS forced FROM fx_discs) "


def _phases(t: Tables) -> list[DataFrame]:
    d = t.discs().select("img_id", F.col("disc").alias("obj_id"), F.expr("cy div 12").cast("int").alias("y1"), F.expr("cx div 12").cast("int").alias("x1"), F.lit(12).alias("size"), (F.col("disc") % 7 == 0).alias("forced"))
    return [d.filter(f"obj_id % 3 = {k}") for k in range(3)]


@query("u4_union_phases", "fx_discs", _PHASED + "SELECT img_id, kind, obj_id, y1, x1, size, forced FROM t")
def _(t: Tables) -> DataFrame:
    return P.union_phases(*_phases(t))


@query("u3_dedup_tiles", "fx_discs", _PHASED + "SELECT img_id, kind, obj_id, y1, x1, size, forced, row_number() OVER (PARTITION BY img_id, y1, x1, size ORDER BY CASE kind WHEN 'grp' THEN 0 WHEN 'ind' THEN 1 ELSE 2 END, obj_id) > 1 AND NOT forced AS duplicate FROM t")
def _(t: Tables) -> DataFrame:
    return P.dedup_tiles(P.union_phases(*_phases(t)))


@query("r28_extract_padded", MASK, """, t AS (SELECT img_id, disc AS tile_id, cy - 6 AS y1, cx - 6 AS x1 FROM fx_discs), p AS (SELECT t.img_id, tile_id, i::INT AS ty, j::INT AS tx, y1 + i AS y, x1 + j AS x FROM t, range(0, 12) a(i), range(0, 12) b(j))
SELECT p.img_id, tile_id, ty, tx, coalesce(CAST((m.x * 7 + m.y * 13) % 256 AS INT), 255) AS value, coalesce(cls, 0) AS cls FROM p LEFT JOIN fx_mask m ON m.img_id = p.img_id AND m.y = p.y AND m.x = p.x""")
def _(t: Tables) -> DataFrame:
    tiles = t.discs().select("img_id", F.col("disc").alias("tile_id"), (F.col("cy") - 6).alias("y1"), (F.col("cx") - 6).alias("x1"))
    return P.padded_tile(tiles, t.mask().withColumn("value", ((F.col("x") * 7 + F.col("y") * 13) % 256).cast("int")), 12)


@query("r27_mask_intruders", "fx_discs", """, p AS (SELECT img_id, disc AS tile_id, k::INT AS px, CASE k % 4 WHEN 0 THEN disc WHEN 1 THEN disc + 1 WHEN 2 THEN NULL ELSE disc + 2 END AS component, k::INT % 3 AS cls, (k * 5)::INT AS value FROM fx_discs, range(0, 12) r(k))
SELECT img_id, tile_id, px, CASE WHEN component IS NOT NULL AND component <> tile_id THEN 0 ELSE cls END AS cls, CASE WHEN component IS NOT NULL AND component <> tile_id THEN CASE WHEN substr(md5(concat('42|', tile_id)), 1, 1) < '8' THEN 0 ELSE 255 END ELSE value END AS value FROM p""")
def _(t: Tables) -> DataFrame:
    k, d = F.col("px"), F.col("tile_id")
    p = t.discs().select("img_id", F.col("disc").alias("tile_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("px"))
    p = p.withColumn("component", F.when(k % 4 == 0, d).when(k % 4 == 1, d + 1).when(k % 4 == 3, d + 2)).withColumn("cls", k % 3).withColumn("value", k * 5)
    return P.mask_intruders(p, "tile_id").select("img_id", "tile_id", "px", "cls", "value")


@query("r21_greedy_groups", MASK, "RECURSIVE" + _OBJ + f""", nb AS (SELECT a.img_id, a.obj_id AS a, b.obj_id AS b FROM o a JOIN o b USING (img_id) WHERE a.obj_id = b.obj_id OR sqrt((a.cx - b.cx)**2 + (a.cy - b.cy)**2) <= 16),
 g AS (SELECT nb.img_id, nb.a AS obj_id, min(y1) AS y1, min(x1) AS x1, max(y2) AS y2, max(x2) AS x2, list(nb.b ORDER BY nb.b) AS members FROM nb JOIN o ON o.img_id = nb.img_id AND o.obj_id = nb.b GROUP BY 1, 2 HAVING COUNT(*) > 1),
 k AS (SELECT g.*, greatest(greatest(y2 - y1, x2 - x1) + 2 * pad, 12) + extra AS s, pad, extra FROM g, (VALUES (6), (4), (2)) p(pad), range(0, 11, 10) e(extra)),
 c AS (SELECT img_id, obj_id, pad, extra, s, greatest(0, least((y1 + y2) // 2 - s // 2, 48 - s)) AS ty, greatest(0, least((x1 + x2) // 2 - s // 2, 48 - s)) AS tx FROM k WHERE s <= 48),
 f AS (SELECT img_id, obj_id, ty, tx, s FROM (SELECT *, row_number() OVER (PARTITION BY img_id, obj_id ORDER BY pad DESC, extra) AS r FROM c WHERE NOT {_BAND}) WHERE r = 1),
 t AS (SELECT g.img_id, g.obj_id, members, CASE WHEN s IS NULL THEN NULL ELSE concat(ty, ':', tx, ':', s) END AS tile, ty, tx, s, row_number() OVER (PARTITION BY g.img_id ORDER BY g.obj_id) AS n FROM g LEFT JOIN f USING (img_id, obj_id)),
 r(img_id, n, obj_id, status, used, saved) AS (SELECT DISTINCT img_id, 0::BIGINT, NULL::INT, '', []::INT[], []::VARCHAR[] FROM t UNION ALL
  SELECT r.img_id, t.n, t.obj_id, CASE WHEN list_contains(used, t.obj_id) THEN 'used' WHEN tile IS NULL THEN 'failed_truncation' WHEN list_contains(saved, tile) THEN 'failed_duplicate' ELSE 'saved' END,
   CASE WHEN list_contains(used, t.obj_id) OR tile IS NULL THEN used ELSE list_concat(used, members) END, CASE WHEN list_contains(used, t.obj_id) OR tile IS NULL THEN saved ELSE list_append(saved, tile) END
  FROM r JOIN t ON t.img_id = r.img_id AND t.n = r.n + 1)
SELECT r.img_id, r.obj_id, status, ty::INT AS y1, tx::INT AS x1, s::INT AS size FROM r JOIN t ON t.img_id = r.img_id AND t.n = r.n WHERE status NOT IN ('', 'used')""")
def _(t: Tables) -> DataFrame:
    return P.greedy_groups(_objects(t), _images(t), _sums(t), 16, expand=10, **SMALL)


@query("r31_backfill_normals", MASK, _TFO + """, m AS (SELECT img_id, y, x, row_number() OVER (PARTITION BY img_id ORDER BY md5(concat('42|', img_id, ':', y, ':', x)), y, x) AS n FROM fx_mask WHERE cls = 1),
 c AS (SELECT img_id, greatest(0, least(y - 6, 36)) AS y1, greatest(0, least(x - 6, 36)) AS x1, min(n) AS n FROM m WHERE n <= 320 GROUP BY 1, 2, 3),
 ok AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n) AS seq FROM c WHERE NOT EXISTS (SELECT 1 FROM fx_mask f WHERE f.img_id = c.img_id AND f.cls = 2 AND f.y >= c.y1 AND f.y < c.y1 + 12 AND f.x >= c.x1 AND f.x < c.x1 + 12)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.img_id = c.img_id AND t.y1 = c.y1 AND t.x1 = c.x1 AND t.size = 12))
SELECT img_id, CAST(seq AS INT) AS seq, y1::INT AS y1, x1::INT AS x1, 12::INT AS size FROM ok WHERE seq <= 4""")
def _(t: Tables) -> DataFrame:
    normal = t.mask().filter("cls = 1").select("img_id", "y", "x")
    deficit = _images(t).select("img_id", F.lit(4).alias("n"))
    taken = P.tile_for_objects(_objects(t), _images(t), 6, 12)
    return P.backfill_normals(normal, deficit, _images(t), _sums(t), taken, 12)


@query("r32_build_dataset", MASK, None)
def _(t: Tables) -> DataFrame:
    return build_dataset(t.mask(), _images(t), **_BUILD)


@query("a21_crop_stats", MASK, None)
def _(t: Tables) -> DataFrame:
    return P.crop_stats(build_dataset(t.mask(), _images(t), **_BUILD))


@query("a22_extraction_coverage", MASK, _TFO + ", c AS (SELECT o.img_id, o.obj_id AS rec_id, COUNT(*) AS n FROM o JOIN t ON t.img_id = o.img_id AND o.y1 >= t.y1 + 1 AND o.y2 <= t.y1 + t.size - 1 AND o.x1 >= t.x1 + 1 AND o.x2 <= t.x1 + t.size - 1 GROUP BY 1, 2) SELECT o.img_id, o.obj_id AS rec_id, coalesce(n, 0) AS tiles, n IS NOT NULL AS extracted FROM o LEFT JOIN c ON c.img_id = o.img_id AND c.rec_id = o.obj_id")
def _(t: Tables) -> DataFrame:
    o = _objects(t)
    tiles = P.tile_for_objects(o, _images(t), 6, 12).select("img_id", F.col("obj_id").alias("tile_id"), F.col("x1").alias("tx0"), F.col("y1").alias("ty0"), (F.col("x1") + F.col("size")).alias("tx1"), (F.col("y1") + F.col("size")).alias("ty1"))
    records = o.select("img_id", F.col("obj_id").alias("rec_id"), F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    inside = tiles_covering_records(tiles, records, ["img_id"], 1, cell=64).select("img_id", "rec_id", F.lit(1).alias("n"))
    return P.extraction_coverage(records.select("img_id", "rec_id"), inside)
