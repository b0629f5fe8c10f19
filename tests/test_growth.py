"""What a query moves or holds grows no faster than its input."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tessella.functions.labels import slugify
from tessella.operators import annotations as A
from tessella.operators import detection as D
from tessella.operators import placement as P
from tessella.operators import raster as R
from tessella.operators import spatial as S
from tessella.operators import tiling as T
from tessella.operators.scoring import mirror_model, score_tiles
from tessella.operators.sums import BLOCK, _paint, summed_area
from tessella.plans.catalogue import QUERIES
from tessella.storage import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joined_rows(df) -> list[int]:
    """How many rows the two sides of the plan's uppermost join have."""
    at, spark = df._jdf.queryExecution().optimizedPlan(), df.sparkSession
    while not at.nodeName().startswith("Join"):
        at = at.children().head()
    return [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, at.children().apply(k)).count() for k in range(2)]


def test_areas_of_polygons_are_added_up_in_place(spark):
    """one row for each polygon leaves Python, not one for each of its rows, and none is shuffled for its sum."""
    rng = random.Random(3)
    polys = [(k, [(rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(k % 8)]) for k in range(200)] + [(200, None)]
    d = spark.createDataFrame(polys, "k int, points array<struct<x:int,y:int>>")
    runs = R.rasterize(d, ["k"])
    want = runs.groupBy("k").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"))
    assert sorted(map(tuple, R.filled_area(d, ["k"]).collect())) == sorted(map(tuple, want.collect()))
    # Each point of a row is in one run only, and runs that touch are one.
    seen = sorted(map(tuple, runs.select("k", "y", "x0", "x1").collect()))
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(seen, seen[1:]))
    text = plan(QUERIES["r5_rasterize"](spark, SF))
    assert "Exchange" not in text[: text.index("MapInArrow")]


def test_searches_for_places_hold_one_region(spark):
    """regions pass as rows in order, not as a pandas call for each; the places found are those of a plain search."""
    rng = random.Random(5)
    runs = [(k, y, x, x + 1) for k in range(3) for y in range(0, 90, 7) for x in [rng.randint(0, 80)]]
    images = spark.createDataFrame([(k, 90, 90) for k in range(3)], "img_id long, height int, width int")
    objects = spark.createDataFrame([(k, j, y + 4, x + 4, y, x, y + 8, x + 8) for k in range(3) for j in range(4) for y, x in [(rng.randint(0, 80), rng.randint(0, 80))]], "img_id long, obj_id int, cy int, cx int, y1 int, x1 int, y2 int, x2 int")
    table = stored(summed_area(spark.createDataFrame(runs, "img_id long, y int, x0 int, x1 int"), images), "sums")
    small = {"padding": 30, "min_padding": 2, "step": 7, "min_tile": 12}
    found = P.force_placement(objects, images, table, **small)
    assert "FlatMapCoGroups" not in plan(found)
    on = {(k, y, x) for k, y, a, b in runs for x in range(a, b + 1)}
    want = {}
    for o in objects.collect():
        best = []
        for pad in (30, 23, 16, 9, 2):
            s = max(8 + 2 * pad, 12)
            a, b = ([max(0, o[f"{c}2"] + 1 - s), min(o[f"{c}1"], 90 - s)] for c in "yx")
            if s > 90 or a[0] > a[1] or b[0] > b[1]:
                continue
            yc, xc = min(max(o.cy - s // 2, a[0]), a[1]), min(max(o.cx - s // 2, b[0]), b[1])
            here = [(y, x) for k, y, x in on if k == o.img_id]
            for ty in range(a[0], a[1] + 1):
                rows = [x for y, x in here if ty <= y < ty + s]
                for tx in range(b[0], b[1] + 1):
                    best.append((sum(tx <= x < tx + s for x in rows), (ty - yc) ** 2 + (tx - xc) ** 2, -pad, ty, tx, s))
        if best:
            want[o.img_id, o.obj_id] = min(best)[3:]
    assert {(r.img_id, r.obj_id): (r.y1, r.x1, r.size) for r in found.collect()} == want


def test_tiles_are_scored_from_arrow(spark):
    """nested arrays reach the model without a Python object for each of their numbers; rows of one batch must agree in shape."""
    d = spark.createDataFrame([(k, [[float(k), j + 0.5, 1.0] for j in range(4)]) for k in range(7)], "k int, values array<array<double>>").coalesce(1)
    out = score_tiles(d, mirror_model(2), 2, 3)
    assert "MapInArrow" in plan(out) and "MapInPandas" not in plan(out)
    assert {r.k: r.probs for r in out.collect()} == {k: [v for j in range(4) for v in (float(k), j + 0.5)] for k in range(7)}
    with pytest.raises(Exception, match="differ in shape"):
        score_tiles(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "values array<double>").coalesce(1), mirror_model(1), 1).collect()


def test_padded_tiles_take_one_join(spark):
    """image and mask of a tile come from one shuffle of the pixels."""
    pixels = spark.createDataFrame([(1, y, x, y * 9 + x, x % 3) for y in range(6) for x in range(6)], "img_id long, y int, x int, value int, cls int")
    out = P.padded_tile(spark.createDataFrame([(1, 4, -2, 3)], "img_id long, tile_id int, y1 int, x1 int"), pixels, 4)
    assert plan(out).count("Join") == 1
    want = {(ty, tx): ((ty - 2) * 9 + tx + 3, (tx + 3) % 3) if ty >= 2 and tx < 3 else (255, 0) for ty in range(4) for tx in range(4)}
    assert {(r.ty, r.tx): (r.value, r.cls) for r in out.collect()} == want


def test_slugs_take_few_texts_at_a_time(spark):
    """whole texts don't go through Arrow's batches of thousands of rows."""
    d = spark.createDataFrame([("Ünïcode Straße 7",), ("ﬁve – ½",), ("plain",), (None,)], "t string").select(slugify(F.col("t")).alias("s"))
    assert "BatchEvalPython" in plan(d) and "ArrowEvalPython" not in plan(d)
    assert [r.s for r in d.collect()] == ["unicode-strae-7", "five-12", "plain", None]


def test_blocks_are_painted_a_few_at_a_time():
    """what Python holds does not grow with the rows of Arrow's batches."""
    pieces = [[{"y": k % 32, "a": k % 20, "b": k % 20 + 5}] if k % 3 else None for k in range(1300)]
    batch = pa.RecordBatch.from_pydict({"img_id": list(range(1300)), "by": [0] * 1300, "bx": [0] * 1300, "pieces": pa.array(pieces, pa.list_(pa.struct([("y", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])))})
    out = list(_paint(iter([batch])))
    assert max(b.num_rows for b in out) < 1300
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["img_id"] for r in rows] == list(range(1300))
    for r, p in zip(rows, pieces):
        on = lambda y, x: bool(p) and y >= p[0]["y"] and max(0, min(x, p[0]["b"]) - p[0]["a"] + 1)  # noqa: B023, E731
        assert r["inner"] == [int(on(y, x)) for y in range(BLOCK) for x in range(BLOCK)]


def _in_and_near(points, px, py):
    """Even-odd rule and squared distance to the nearest edge, edge by edge."""
    inside, near = False, float("inf")
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            inside = not inside
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)) if size else 0
        near = min(near, (px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2)
    return inside, near


def test_points_meet_polygons_in_batches(spark, monkeypatch):
    """edges are compared in Arrow batches, not by interpreted lambdas row by row, and rectangles bring no vertices."""
    rng = random.Random(8)
    monkeypatch.setattr(S, "VERTICES", 16)
    recs, probes = [], [("s", k, rng.randint(-10, 70), rng.randint(-10, 70)) for k in range(200)]
    for k in range(60):
        pts = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.choice((1, 2, 3, 5, 9)))]
        xs, ys = zip(*pts)
        recs.append(("s", k, "rect 1" if k % 5 == 0 else "LSIL", min(xs), min(ys), max(xs), max(ys), None if k in (5, 6) else [] if k == 7 else pts))
    ann = spark.createDataFrame(recs, "slide_id string, ann_idx int, label string, xmin int, ymin int, xmax int, ymax int, points array<struct<x:int,y:int>>")
    points = spark.createDataFrame(probes, "slide_id string, point_id int, px int, py int")
    top, held = {}, set()
    for _, k, label, x0, y0, x1, y1, pts in recs:
        for _, n, px, py in probes:
            inside, near = _in_and_near(pts or [], px, py)
            if x0 - 4 <= px <= x1 + 4 and y0 - 4 <= py <= y1 + 4 if label == "rect 1" else inside or near <= 25:
                top[n] = k
            if inside and near > 0 and pts:
                held.add((n, k))
    hits = S.hit_test(points, ann, F.col("label") == "rect 1", cell=16)
    assert "MapInArrow" in plan(hits) and "lambda" not in plan(hits)
    assert {r.point_id: r.ann_idx for r in hits.collect()} == top
    found = S.point_in_polygon(points, ann, ["slide_id"], 16)
    assert "points" in found.columns and {(r.point_id, r.ann_idx) for r in found.collect()} == held


def test_near_pairs_stand_in_few_cells(spark):
    """A record has a row for each cell of its corners, not 4 and 16; each pair is found once."""
    rng = random.Random(11)
    recs = [("s", k, "LSIL", x, y, x + rng.choice((0, 8, 40, 300)), y + rng.choice((0, 8, 40, 300))) for k in range(400) for x, y in [(rng.randint(-150, 150), rng.randint(-150, 150))]]
    ann = spark.createDataFrame(recs, "slide_id string, ann_idx int, label string, xmin int, ymin int, xmax int, ymax int").coalesce(1)
    for share in (0.2, 0.0):
        want = []
        for _, a, _, x0, y0, x1, y1 in recs:
            for _, b, _, u0, v0, u1, v1 in recs[a + 1 :]:
                dx, dy = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
                near = any((x - u) ** 2 + (y - v) ** 2 <= 225 for y, v in ((y0, v0), (y1, v1)) for x, u in ((x0, u0), (x1, u1)))
                if near and (dx * dy if dx >= 0 and dy >= 0 else 0) >= share * max((x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0)):
                    want.append((a, b))
        pairs = A.near_pairs(ann, 15, share)
        assert sorted((r.a, r.b) for r in pairs.collect()) == want
    rows = joined_rows(pairs)
    assert rows[0] <= 4 * 400 and rows[1] <= 6 * 400


def test_records_are_numbered_once(spark):
    """F16: the survivors and both sides of their pairs read one stored table."""
    assert "Window" not in plan(QUERIES["u2_resolve_near_duplicates"](spark, SF))


def test_pixels_are_resampled_without_a_join(spark):
    """pixels name the pixels that take them; nothing is joined, and what lies by images is not shuffled."""
    rng = random.Random(2)
    for (h, w), (h2, w2) in (((7, 9), (3, 4)), ((3, 4), (10, 5)), ((5, 1), (1, 3)), ((6, 6), (6, 6))):
        v = {(y, x): float(rng.randint(0, 255)) for y in range(h) for x in range(w)}
        if h == 7:
            del v[3, 3]
        want: dict = {}
        for i in range(h2):
            for j in range(w2):
                sy, sx = (i + 0.5) * (h / h2) - 0.5, (j + 0.5) * (w / w2) - 0.5
                ly, lx = math.floor(sy), math.floor(sx)
                for ty, wy in ((ly, 1 - sy + ly), (ly + 1, sy - ly)):
                    for tx, wx in ((lx, 1 - sx + lx), (lx + 1, sx - lx)):
                        at = min(max(ty, 0), h - 1), min(max(tx, 0), w - 1)
                        if at in v:
                            want[i, j] = want.get((i, j), 0.0) + v[at] * wy * wx
        d = spark.createDataFrame([(1, y, x, g) for (y, x), g in v.items()], "img_id long, y int, x int, gray double")
        out = R.resample_bilinear(d, "gray", (h, w), (h2, w2))
        assert {(r.y, r.x): round(r.gray, 9) for r in out.collect()} == {k: round(g, 9) for k, g in want.items()}
    text = plan(QUERIES["r16_resample_bilinear"](spark, SF))
    assert "Join" not in text and text.count("Exchange") == 1


def test_chunks_meet_pixels_by_rows(spark):
    """a row of a chunk is one row of the join; places without a pixel are white, pixels outside the chunks go."""
    rng = random.Random(4)
    v = {(k, y, x): rng.randint(0, 200) for k in (1, 2) for y in range(7) for x in range(10) if (y, x) != (2, 3) and (k, y) != (2, 5)}
    extra = [(1, -1, 2, 5), (1, 2, -1, 5), (1, 2, 40, 5), (1, 8, 11, 7), (3, 0, 0, 9), (2, 0, 0, None)]
    del v[2, 0, 0]
    d = spark.createDataFrame([(*k, g) for k, g in v.items()] + extra, "img_id long, y int, x int, gray int")
    images = spark.createDataFrame([(1, 7, 10), (2, 7, 10), (4, 1, 1)], "img_id long, height int, width int")
    out = T.chunk_grid(images, d, (3, 4), "gray")
    v[1, 8, 11] = 7
    want = [(k, r * 3 + q, ty, tx, v.get((k, r * 3 + ty, q * 4 + tx), 255)) for k in (1, 2) for r in range(3) for q in range(3) for ty in range(3) for tx in range(4)]
    want += [(4, 0, ty, tx, 255) for ty in range(3) for tx in range(4)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert dict(out.dtypes)["gray"] == "int" and joined_rows(out)[0] == 2 * 9 * 3 + 3


def test_refined_maps_are_not_sorted(spark):
    """pixels of a map meet what changes by cells of a row, once, and no group of pixels is made of them."""
    rng = random.Random(6)
    maps = [(k, y, x, *(rng.randint(1, 9) / 16 for _ in range(3))) for k in (1, 2, 3) for y in range(3) for x in range(0, 140, 3)]
    preds = [(k, c, y, x, *(rng.randint(1, 9) / 16 for _ in range(3))) for k in (1, 2) for c in range(4) for y in range(4) for x in range(150) if rng.random() < 0.5]
    preds = [p if p[0] == 1 else (*p[:6], 0.0) for p in preds]  # the second image has predictions, but none of class 2
    d = spark.createDataFrame(maps, "img_id long, y int, x int, p0 double, p1 double, p2 double")
    out = D.refine_regions(d, spark.createDataFrame(preds, "img_id long, component long, y int, x int, q0 double, q1 double, q2 double"))
    last = {(k, y, x): (a, b, c) for k, _, y, x, a, b, c in sorted(preds) if c > a and c > b}
    want = [(k, y, x, *(last.get((k, y, x), (a, b + c, 0.0)) if k < 3 else (a, b, c))) for k, y, x, a, b, c in maps]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    text = plan(out)
    assert "ShuffledHashJoin" in text and "SortAggregate" not in text


def test_runs_are_made_of_bits(spark):
    """pixels become bits where they lie, no window sorts them, and runs say whether they hold a marked pixel, so that the map is read once."""
    rng = random.Random(9)
    on = {(k, y, x): rng.choice((1, 1, 1, 2)) for k in (1, 2) for y in (-1, 0, 300) for x in range(-70, 330) if rng.random() < 0.97}
    on |= {(3, 0, x): 2 for x in range(1000)} | {(3, 1, x): 2 for x in (62, 63, 64, 190, 192, 255, 320)}
    hot = {p for p in on if rng.random() < 0.02}
    d = spark.createDataFrame([(*p, c, p in hot) for p, c in on.items()], "img_id long, y int, x int, cls int, hot boolean").repartition(5)
    for where in (None, "cls = 2"):
        runs = R.run_length_encode(d, where=None if where is None else F.expr(where), mark=F.col("hot"))
        want = []
        for (k, y, x), c in sorted(on.items()):
            if where and c != 2:
                continue
            if want and want[-1][:3] == [k, c, y] and want[-1][4] == x - 1:
                want[-1][4:] = [x, want[-1][5] or (k, y, x) in hot]
            else:
                want.append([k, c, y, x, x, (k, y, x) in hot])
        assert sorted(map(list, runs.collect())) == sorted(want)
    assert runs.columns == ["img_id", "cls", "y", "x0", "x1", "marked"] and dict(runs.dtypes)["x1"] == "int"
    text = plan(R.run_length_encode(d))
    assert "Window" not in text and "HashAggregate" in text and "SortAggregate" not in text


def test_suspicious_components_of_many_strips(spark):
    """as by a flood fill, over strips and cells; an image without a red pixel has none."""
    rng = random.Random(12)
    maps = [(k, y, x, *rng.choice(((0.8, 0.1, 0.1), (0.4, 0.4, 0.2), (0.2, 0.5, 0.3), (0.1, 0.1, 0.8) if k == 1 and x > 60 else (0.3, 0.4, 0.3)))) for k in (1, 2) for y in range(250, 262) for x in range(50, 140)]
    fg = {(k, y, x): p2 for k, y, x, p0, p1, p2 in maps if max(p1, p2) > p0}
    want, left = set(), set(fg)
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            k, y, x = todo.pop()
            near = {(k, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            part |= near
            todo += near
        if any(fg[p] >= 0.7 for p in part):
            first = min(part)
            want |= {(*p, first[1] * R.STRIDE + first[2]) for p in part}
    out = D.suspicious_components(spark.createDataFrame(maps, "img_id long, y int, x int, p0 double, p1 double, p2 double"), 0.7)
    assert set(out.columns) == {"img_id", "y", "x0", "x1", "component"}
    got = [(r.img_id, r.y, x, r.component) for r in out.collect() for x in range(r.x0, r.x1 + 1)]
    assert len(got) == len(set(got)) and set(got) == want and want
