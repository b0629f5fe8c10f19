"""Small cases worked out by hand, and against plain Python."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.functions import pixels as P
from tessella.operators import annotations as A
from tessella.operators import graph as G
from tessella.operators import metrics as M
from tessella.operators import placement as PL
from tessella.operators import ranking as RK
from tessella.operators import raster as R
from tessella.operators import spatial as SP
from tessella.operators import tiling as T
from tessella.operators.graph import components
from tessella.operators.sums import summed_area
from tessella.sources import files as S


def test_labels(spark):
    d = spark.createDataFrame([(" ?LSIL) ?",), ("Rect 12",), ("my rectangle",), (" rect 3 ",), ("",)], "label string")
    got = d.select(L.normalize_label(F.col("label")), L.is_rect(F.col("label")), L.rect_number(F.col("label"))).collect()
    assert [tuple(r) for r in got] == [("LSIL", False, L.MAX_INT), ("Rect 12", True, 12), ("my rectangle", True, L.MAX_INT), ("rect 3", True, 3), ("", False, L.MAX_INT)]


def test_numbers(spark):
    d = spark.createDataFrame([("-2.9",), ("7",), ("x",), (None,)], "s string")
    assert [r[0] for r in d.select(L.trunc_coord(F.col("s"))).collect()] == [-2, 7, None, None]
    d = spark.createDataFrame([(2.5,), (-2.5,), (0.4,)], "x double")
    assert [r[0] for r in d.select(L.llround(F.col("x"))).collect()] == [3, -3, 0]


def test_slugify(spark):
    d = spark.createDataFrame([("  Ünïcode -- Straße 7!",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(L.slugify(F.col("t"))).collect()] == ["unicode-strae-7", "", None]


def test_symmetries_come_back(spark):
    d = spark.range(8).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(4))))
    y, x = P.flip_rot(F.col("y"), F.col("x"), 5, F.col("k"))
    d = d.withColumn("fy", y).withColumn("fx", x)
    by, bx = P.flip_rot_inverse(F.col("fy"), F.col("fx"), 5, F.col("k"))
    rows = d.select("k", "y", "x", "fy", "fx", by.alias("by"), bx.alias("bx")).collect()
    assert all((r.y, r.x) == (r.by, r.bx) for r in rows)
    assert len({tuple(sorted((r.y, r.x, r.fy, r.fx) for r in rows if r.k == k)) for k in range(8)}) == 8


def test_spline_mean_is_one(spark):
    for n in (16, 17, 32):
        w = [r.w for r in P.spline_weights(spark, n).orderBy("i").collect()]
        assert math.isclose(sum(w) / n, 1, abs_tol=1e-9) and np.allclose(w, w[::-1])


def test_macro_metrics_of_the_small_batch(spark):
    gt, pred = [0] * 6 + [1] * 2, [0] * 5 + [1] + [1] * 2
    d = spark.createDataFrame(list(zip(gt, pred)), "gt int, pred int")
    assert math.isclose(M.macro_metric(d, "iou", 3, background=True).first().value, (5 / 6 + 2 / 3 + 1) / 3)
    assert math.isclose(M.macro_metric(d, "f1", 3, background=True).first().value, (10 / 11 + 0.8 + 1) / 3, abs_tol=1e-6)


def test_average_precision_forms_agree(spark):
    rng = random.Random(1)
    data = [(i, rng.random(), int(rng.random() < 0.3)) for i in range(400)]
    d = spark.createDataFrame(data, "event_id long, score double, positive int")
    tp, ap = 0, 0.0
    for n, (_, _, p) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        tp += p
        ap += p * tp / n
    exact = M.average_precision(d, "event_id").first().ap
    assert math.isclose(exact, ap / tp, abs_tol=1e-9)
    assert abs(exact - M.average_precision_binned(d).first().ap) < 1e-2
    assert M.average_precision(d.filter("positive = 0"), "event_id").first().ap == 0


def test_splits(spark):
    names = spark.createDataFrame([(f"f{i}",) for i in range(5)], "name string")
    got = RK.split_static(names, "name", 0.2).collect()
    assert sum(r.is_val for r in got) == 1 and sorted(r.name for r in got) == [f"f{i}" for i in range(5)]
    vals = [frozenset(r.name for r in RK.split_cyclic(names, "name", 0.2, e).filter("is_val").collect()) for e in range(5)]
    assert len(set(vals)) == 5


def test_global_rank_and_even_chunks(spark):
    d = spark.range(101).select((F.col("id") * 7919 % 101).alias("v"))
    assert all(r.v == r.rank for r in RK.global_rank(d, "v").collect())
    sizes = sorted((r["count"] for r in RK.split_evenly(d, 7, "v").groupBy("chunk").count().collect()), reverse=True)
    assert sizes == [15, 15, 15, 14, 14, 14, 14]


def test_weighted_sample_with_replacement(spark):
    d = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.0)], "k int, w double")
    got = [r.k for r in RK.weighted_sample(d, "k", "w", 500, replacement=True).collect()]
    assert len(got) == 500 and 400 < got.count(1) < 490 and 3 not in got


def test_components(spark):
    pairs = [("a", i, i + 1) for i in range(20)] + [("a", 40, 41), ("b", 1, 2)]
    got = {(r.g, r.node): r.component for r in components(spark.createDataFrame(pairs, "g string, a int, b int"), ["g"]).collect()}
    assert all(got["a", i] == 0 for i in range(21)) and got["a", 41] == 40 and got["b", 2] == 1


def _mask(spark, rows):
    return spark.createDataFrame([(1, y, x, int(v)) for y, line in enumerate(rows) for x, v in enumerate(line)], "img_id int, y int, x int, cls int")


RING = ["0000000", "0222220", "0200020", "0202020", "0200020", "0222220", "0000000"]


def test_connectivity_and_holes(spark):
    diagonal = R.run_length_encode(_mask(spark, ["20", "02"]).filter("cls = 2")).drop("cls")
    count = lambda c: R.connected_components(diagonal, c).select("component").distinct().count()
    assert (count(4), count(8)) == (2, 1)
    images = spark.createDataFrame([(1, 7, 7)], "img_id int, height int, width int")
    runs = R.run_length_encode(_mask(spark, RING).filter("cls = 2")).drop("cls")
    assert R.pathology_pixels(R.fill_holes(runs, images)).first().n == 25
    empty = runs.filter("y < 0")
    assert R.connected_components(empty, 8).count() == 0 and R.fill_holes(empty, images).count() == 0


def test_props(spark):
    p = R.component_props(R.connected_components(R.run_length_encode(_mask(spark, ["22000", "22022"]).filter("cls = 2")).drop("cls"), 4)).orderBy("obj_id").collect()
    assert [(r.obj_id, r.cy, r.cx, r.y1, r.x1, r.y2, r.x2, r.area) for r in p] == [(1, 0, 0, 0, 0, 1, 1, 4), (2, 1, 3, 1, 3, 1, 4, 2)]


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_across_strips(spark, monkeypatch, connectivity):
    """Strips of three rows against a plain flood fill; only runs on their borders become edges."""
    monkeypatch.setattr(R, "STRIP_ROWS", 3)
    rng = random.Random(connectivity)
    data = [(i, y, x) for i in (1, 2) for y in range(40) for x in range(30) if rng.random() < 0.55]
    runs = R.run_length_encode(spark.createDataFrame(data, "img_id long, y int, x int").withColumn("cls", F.lit(1))).drop("cls")
    got = {(r.img_id, r.y, x): r.component for r in R.connected_components(runs, connectivity).collect() for x in range(r.x0, r.x1 + 1)}
    on, part = set(data), {}
    for p in sorted(on):
        todo = [] if p in part else [p]
        while todo:
            i, y, x = q = todo.pop()
            if q in on and q not in part:
                part[q] = p[1] * R.STRIDE + p[2]
                todo += [(i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or not (a and b)]
    assert got == part


def test_area_inside_contours_from_runs(spark):
    """Against the squares of every pixel."""
    rng = random.Random(4)
    data = [(1, y, x) for y in range(60) for x in range(140) if rng.random() < 0.8]
    runs = R.run_length_encode(spark.createDataFrame(data, "img_id long, y int, x int").withColumn("cls", F.lit(1))).drop("cls")
    lab = R.connected_components(runs, 8).cache()
    squares = collections.Counter((r.component, r.y - i, x - j) for r in lab.collect() for x in range(r.x0, r.x1 + 1) for i in (0, 1) for j in (0, 1))
    want = collections.Counter({r.component: 0.0 for r in lab.collect()})
    for (c, _, _), n in squares.items():
        want[c] += {4: 1.0, 3: 0.5}.get(n, 0.0)
    assert {r.component: r.area for r in R.contour_area(lab).collect()} == dict(want)


def test_threshold_by_blocks(spark, monkeypatch):
    """The same whatever the side of the blocks."""
    px = spark.createDataFrame([(i, y, x, (x * 7 + y * 13 + i * x * y) % 256) for i in (1, 2) for y in range(40) for x in range(23)], "img_id int, y int, x int, v int")
    want = sorted(map(tuple, R.adaptive_threshold(px, "v").collect()))
    monkeypatch.setattr(R, "BLUR_BLOCK", 7)
    assert sorted(map(tuple, R.adaptive_threshold(px, "v").collect())) == want and len(want) == 2 * 40 * 23


def test_rasterized_square(spark):
    d = spark.createDataFrame([(1, [(2, 1), (5, 1), (5, 3), (2, 3)])], "k int, points array<struct<x:int,y:int>>")
    got = sorted((r.y, r.x0, r.x1) for r in R.rasterize(d, ["k"]).collect())
    assert got == [(1, 2, 5), (2, 2, 5), (3, 2, 5)]


@pytest.mark.parametrize("size", [(10, 10), (12, 12), (20, 30), (51, 25)])
def test_stitch_and_blend_give_back_the_image(spark, size):
    h, w = size
    images = spark.createDataFrame([(1, h, w)], "img_id int, height int, width int")
    px = spark.createDataFrame([(1, y, x, float((y * 7 + x * 3) % 11)) for y in range(h) for x in range(w)], "img_id int, y int, x int, v double")
    want = {(r.y, r.x): r.v for r in px.collect()}
    tiles = T.inference_grid(px, images, 12).select("img_id", "tile_idx", "ty", "tx", "v")
    assert {(r.y, r.x): r.v for r in T.stitch(tiles, images, 12, ["v"]).collect()} == want
    over = T.overlap_grid(px, images, 8, 2, "v")
    assert over.groupBy("y0", "x0").count().filter("count != 4").count() == 0  # rows a window: subdivisions squared
    got = {(r.y, r.x): r.v for r in T.blend_overlaps(over, images, 8, 2, "v").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_blending_constants_by_subdivisions(spark):
    images = spark.createDataFrame([(1, 24, 24)], "img_id int, height int, width int")
    ones = images.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("v", F.lit(1.0))
    over = T.overlap_grid(ones, images, 16, 2, "v")
    got = [r.v for r in T.blend_overlaps(over, images, 16, 2, "v", "subdivisions").filter("y between 8 and 15 and x between 8 and 15").collect()]
    assert all(abs(v - 1) < 0.05 for v in got)


def test_kills_in_order(spark):
    rng = random.Random(3)
    data = []
    for i in range(120):
        x, y = rng.randrange(0, 400), rng.randrange(0, 400)
        data.append(("s", i, "LSIL", x, y, x + 60 + rng.randrange(4), y + 60 + rng.randrange(4)))
    d = spark.createDataFrame(data, "slide_id string, ann_idx int, label string, xmin int, ymin int, xmax int, ymax int")
    got = sorted(r.ann_idx for r in A.resolve_near_duplicates(d, 15).collect())

    def close(a, b):
        corners = [(3, 4), (5, 4), (3, 6), (5, 6)]
        if not any(math.hypot(a[i] - b[i], a[j] - b[j]) <= 15 for i, j in corners):
            return False
        dx, dy = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        area = max((r[5] - r[3]) * (r[6] - r[4]) for r in (a, b))
        return (dx * dy if dx >= 0 and dy >= 0 else 0) >= 0.2 * area

    alive: list = []
    for r in data:
        hit = next((o for o in alive if close(o, r)), None)
        if hit is not None:
            alive.remove(hit)
        alive.append(r)
    assert got == sorted(r[1] for r in alive)


def test_kills_of_a_long_chain_and_a_star(spark):
    """100,000 records each in one slide: in the chain each kills the one before, in the star the second kills the centre."""
    n = 100_000
    chain = spark.range(1, n).select(F.lit("s").alias("slide_id"), (F.col("id") - 1).cast("int").alias("a"), F.col("id").cast("int").alias("b"))
    star = spark.range(1, n).select(F.lit("t").alias("slide_id"), F.lit(0).alias("a"), F.col("id").cast("int").alias("b"))
    got = G.first_choices(chain.union(star), ["slide_id"]).groupBy("slide_id").agg(F.count("a").alias("n"), F.max(F.col("b") - F.col("a")).alias("far")).collect()
    assert {(r.slide_id, r.n, r.far) for r in got} == {("s", n - 1, 1), ("t", 1, 1)}


def test_choices_in_order_however_clumps_are_decided(spark, monkeypatch):
    rng = random.Random(8)
    pairs = sorted({(g, *sorted(rng.sample(range(m), 2))) for g, m, k in (("s", 30, 300), ("t", 200, 400), ("u", 12, 200)) for _ in range(k)})
    taken, want = set(), []
    for b in sorted({(g, b) for g, _, b in pairs}):
        a = next((a for g, a, c in pairs if (g, c) == b and (g, a) not in taken), None)
        if a is not None:
            taken.add((b[0], a))
            want.append((b[0], a, b[1]))
    d = spark.createDataFrame(pairs, "slide_id string, a int, b int")
    for most in (1 << 20, 250, 0):
        monkeypatch.setattr(G, "CLUMP_PAIRS", most)
        assert sorted(map(tuple, G.first_choices(d, ["slide_id"]).select("slide_id", "a", "b").collect())) == sorted(want)


def test_seeds_of_one_connected_mass(spark):
    """Against a plain pass in order: 4,000 nodes in scan order, each within reach of many, in squares of 60."""
    rng = random.Random(2)
    at = sorted((rng.randrange(270), rng.randrange(270)) for _ in range(4_000))
    nodes = spark.createDataFrame([(1, i, x, y, rng.random() < 0.8) for i, (y, x) in enumerate(at)], "img_id long, node int, x int, y int, able boolean")
    o = nodes.select("img_id", F.col("node").alias("obj_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    edges = SP.neighbours(o, ["img_id"], 10).filter("b < a").select("img_id", "a", "b").cache()
    before = collections.defaultdict(list)
    for r in edges.collect():
        before[r.a].append(r.b)
    chosen, free = set(), set()
    for r in nodes.orderBy("node").collect():
        if not any(b in chosen for b in before[r.node]):
            free.add(r.node)
            if r.able:
                chosen.add(r.node)
    got = G.first_independent(nodes, edges, "img_id", 60).collect()
    assert len(got) == len(at)
    assert {r.node for r in got if r.free} == free and {r.node for r in got if r.chosen} == chosen


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def test_kills_in_one_large_group(spark, small_batches):
    """Fifty copies of one box on each of two slides, in batches of seven pairs: each record kills the one before."""
    data = [(s, i, "LSIL", 10, 10, 60, 60) for s in ("s", "t") for i in range(50)]
    d = spark.createDataFrame(data, "slide_id string, ann_idx int, label string, xmin int, ymin int, xmax int, ymax int")
    assert sorted((r.slide_id, r.ann_idx) for r in A.resolve_near_duplicates(d, 15).collect()) == [("s", 49), ("t", 49)]
    assert A.resolve_near_duplicates(d.limit(0), 15).count() == 0


def test_greedy_seeds_in_order(spark, small_batches):
    """Against the seeds taken one after another from all groups and their tiles."""
    rng = random.Random(5)
    objects = [(g, k, cy, cx, cy - 2, cx - 2, cy + 2, cx + 2) for g in (1, 2) for k in range(40) for cy, cx in [(rng.randrange(5, 195), rng.randrange(5, 195))]]
    o = spark.createDataFrame(objects, "img_id long, obj_id int, cy int, cx int, y1 int, x1 int, y2 int, x2 int")
    images = spark.createDataFrame([(1, 200, 200), (2, 200, 200)], "img_id long, height int, width int")
    runs = spark.createDataFrame([(r[0], y, r[5], r[7]) for r in objects for y in range(r[4], r[6] + 1)], "img_id long, y int, x0 int, x1 int")
    table = summed_area(runs, images).cache()
    fit = {"padding": 4, "min_padding": 2, "step": 2, "expand": 2, "margin": 2, "min_tile": 12}
    got = {(r.img_id, r.obj_id): (r.status, r.y1, r.x1, r.size) for r in PL.greedy_groups(o, images, table, 25, **fit).collect()}
    members = {r[:2]: [s for s in objects if s[0] == r[0] and math.dist(r[2:4], s[2:4]) <= 25] for r in objects}
    members = {k: m for k, m in members.items() if len(m) > 1}
    boxes = [(*k, *(f(s[i] for s in m) for f, i in ((min, 4), (min, 5), (max, 6), (max, 7)))) for k, m in members.items()]
    tiles = {(r.img_id, r.obj_id): (r.y1, r.x1, r.size) for r in PL.fit_tile(spark.createDataFrame(boxes, "img_id long, obj_id int, y1 int, x1 int, y2 int, x2 int"), images, table, **fit).collect()}
    want, used, saved = {}, set(), set()
    for key in sorted(members):
        if key in used:
            continue
        tile = tiles.get(key)
        if tile is None:
            want[key] = ("failed_truncation", None, None, None)
            continue
        want[key] = ("failed_duplicate" if (key[0], tile) in saved else "saved", *tile)
        saved.add((key[0], tile))
        used.update(s[:2] for s in members[key])
    assert got == want and {v[0] for v in want.values()} >= {"saved", "failed_truncation"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.JSON").write_text('[{"label": " LSIL ", "points": [[1, 2], [3], [5, 9]], "rect": [1, 2, 5, 9]}, {"label": " ", "points": []}, {"label": "x", "points": [[4, 1], [2, 7]]}]')
    (tmp_path / "bad.json").write_text("not a list")
    got = S.read_annotation_json(spark, str(tmp_path)).orderBy("ann_idx").collect()
    assert [(r.label, len(r.points), tuple(r.rect)) for r in got] == [("LSIL", 2, (1, 2, 5, 9)), ("x", 2, (2, 1, 4, 7))]
    for n in ("One.MRXS", "two.mrxs", "._two.mrxs", "three.txt"):
        (tmp_path / n).write_bytes(b"12345")
    assert [(r.slide_id, r.bytes) for r in S.scan_slides(spark, str(tmp_path)).orderBy("path").collect()] == [("One", 5), ("two", 5)]


def test_images(spark, tmp_path):
    tiles = spark.createDataFrame([("t1", 2, 3, [0, 127, 255, 1, 2, 3])], "name string, height int, width int, values array<int>")
    content = S.encode_bmp(tiles).first().content
    (tmp_path / "t1.bmp").write_bytes(bytes(content))
    (tmp_path / "broken.bmp").write_bytes(b"BM")
    r = S.read_tile_images(spark, str(tmp_path / "t1.bmp")).first()
    assert (r.name, r.height, r.width, list(r.data[::3])) == ("t1", 2, 3, [0, 127, 255, 1, 2, 3])
    files = spark.createDataFrame([("t1", bytes(content)), ("x", b"BM"), ("y", None)], "name string, content binary")
    assert [(x.name, list(x["values"])) for x in S.decode_bmp(files).collect()] == [("t1", [0, 127, 255, 1, 2, 3])]


def test_top_rows_by_each_metric(spark):
    d = spark.createDataFrame([("a", 1, 0), ("b", 3, 0), ("c", 3, 5), ("d", 0, 1)], "name string, m long, n long")
    got = {(r.metric, r.rank, r.name, r.value) for r in RK.top_rows_by(d, ["m", "n"], 2, "name").collect()}
    assert got == {("m", 1, "b", 3), ("m", 2, "c", 3), ("n", 1, "c", 5), ("n", 2, "d", 1)}
