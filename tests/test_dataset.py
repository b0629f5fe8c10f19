"""The whole tile build and its counters against a plain build of a few masks, and sums and places of large objects."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import placement as P
from tessella.operators.sums import rect_sum, ring_sum, summed_area
from tessella.plans.dataset import build_dataset

SIDE, MIN_PIXELS = 48, 10
PADS, LEAST, GROW, MARGIN, NEAR, NORMAL, SHIFT = (6, 4, 2), 12, (0, 10), 1, 16, 12, 4


def parts(mask, cls):
    """4-connected components in scan order: lists of (y, x)."""
    left, out = {(y, x) for y, x in zip(*np.nonzero(mask == cls))}, []
    for p in sorted(left):
        if p in left:
            found, todo = [], [p]
            left.discard(p)
            while todo:
                y, x = todo.pop()
                found.append((int(y), int(x)))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            out.append(found)
    return out


def props(found):
    ys, xs = [p[0] for p in found], [p[1] for p in found]
    return {"cy": sum(ys) // len(ys), "cx": sum(xs) // len(xs), "box": (min(ys), min(xs), max(ys), max(xs))}


def clamp(at, size):
    return max(0, min(at, SIDE - size))


def side(box, pad, least):
    return max(max(box[2] - box[0], box[3] - box[1]) + 2 * pad, least)


def band(sick, y, x, s, m=MARGIN):
    whole = sick[y : y + s, x : x + s].sum()
    return whole - (sick[y + m : y + s - m, x + m : x + s - m].sum() if s > 2 * m else 0)


def middle(box, s):
    return clamp((box[0] + box[2]) // 2 - s // 2, s), clamp((box[1] + box[3]) // 2 - s // 2, s)


def fit(box, sick):
    for pad in PADS:
        for more in GROW:
            s = side(box, pad, LEAST) + more
            if s <= SIDE:
                y, x = middle(box, s)
                if not band(sick, y, x, s):
                    return y, x, s
    return None


def places(o, margin):
    """(pad, size, y, x, distance from the centred place) of every place that holds the object."""
    b = o["box"]
    for pad in PADS:
        s = side(b, pad, LEAST)
        ya, yz = max(0, b[2] + max(margin, 1) - s), min(b[0] - margin, SIDE - s)
        xa, xz = max(0, b[3] + max(margin, 1) - s), min(b[1] - margin, SIDE - s)
        if s <= SIDE and ya <= yz and xa <= xz:
            yc, xc = min(max(o["cy"] - s // 2, ya), yz), min(max(o["cx"] - s // 2, xa), xz)
            for y in range(ya, yz + 1):
                for x in range(xa, xz + 1):
                    yield pad, s, y, x, (y - yc) ** 2 + (x - xc) ** 2


def plain_build(image, mask):
    mask = mask.copy()
    for found in parts(mask, 2):
        if len(found) <= MIN_PIXELS:
            for p in found:
                mask[p] = 0
    sick = mask == 2
    objects = [props(f) for f in parts(mask, 2)]
    rows, used, saved = [], set(), set()
    for k, o in enumerate(objects):
        group = [j for j, q in enumerate(objects) if (o["cy"] - q["cy"]) ** 2 + (o["cx"] - q["cx"]) ** 2 <= NEAR**2]
        if k in used or len(group) == 1:
            continue
        tile = fit(tuple(f(objects[j]["box"][i] for j in group) for f, i in ((min, 0), (min, 1), (max, 2), (max, 3))), sick)
        if tile is None:
            rows.append(("greedy", k + 1, "failed_truncation", None))
            continue
        rows.append(("greedy", k + 1, "failed_duplicate" if tile in saved else "saved", tile))
        saved.add(tile)
        used |= set(group)
    n_base = sum(r[2] == "saved" for r in rows)
    for k, o in enumerate(objects):
        clean = [(-pad, d, y, x, s) for pad, s, y, x, d in places(o, MARGIN) if not band(sick, y, x, s)]
        if clean:
            rows.append(("ind", k + 1, "isolated", min(clean)[2:]))
        elif tile := fit(o["box"], sick):
            rows.append(("ind", k + 1, "fallback", tile))
        elif held := [(sick[y : y + s, x : x + s].sum(), d, -pad, y, x, s) for pad, s, y, x, d in places(o, 0)]:
            rows.append(("ind", k + 1, "forced", min(held)[3:]))
        else:
            s = side(o["box"], PADS[0], LEAST)
            rows.append(("ind", k + 1, "forced", (o["cy"] - s // 2, o["cx"] - s // 2, s)))
    n_base += len(objects)
    target, kept = max(n_base, 5), 0
    for k, o in enumerate(map(props, parts(mask, 1))):
        s, tile = side(o["box"], PADS[0], NORMAL), None
        if s <= SIDE:
            y, x = middle(o["box"], s)
            lattice = range(-(s // SHIFT) * SHIFT, (s // SHIFT) * SHIFT + 1, SHIFT)
            moves = [(dy * dy + dx * dx, dy, dx) for dy in lattice for dx in lattice if 0 <= y + dy <= SIDE - s and 0 <= x + dx <= SIDE - s and not sick[y + dy : y + dy + s, x + dx : x + dx + s].any()]
            tile = min(moves, default=None)
        if kept >= target:
            rows.append(("norm", k + 1, "skipped_limit", tile and (y + tile[1], x + tile[2], s)))
        elif tile is None:
            rows.append(("norm", k + 1, "failed_pathology", None))
        else:
            kept += 1
            rows.append(("norm", k + 1, "shifted" if tile[0] else "saved", (y + tile[1], x + tile[2], s)))
    good = {"saved", "isolated", "fallback", "forced", "shifted"}
    taken = {r[3] for r in rows if r[2] in good}
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (("greedy", "ind", "norm").index(r[0]), r[1])):
        if r[2] in good and r[3] in seen and r[2] != "forced":
            r = (*r[:2], "failed_duplicate", r[3])
        elif r[2] in good:
            seen.add(r[3])
        out.append(r)
    spots = sorted((hashlib.md5(f"42|{image}:{y}:{x}".encode()).hexdigest(), y, x) for y, x in zip(*(v.tolist() for v in np.nonzero(mask == 1))))
    wanted, seq, tried = target - kept, 0, set()
    for _, y, x in spots[: max(200, 80 * max(wanted, 0))]:
        tile = (clamp(y - NORMAL // 2, NORMAL), clamp(x - NORMAL // 2, NORMAL), NORMAL)
        if seq < wanted and tile not in tried and tile not in taken and not sick[tile[0] : tile[0] + NORMAL, tile[1] : tile[1] + NORMAL].any():
            seq += 1
            out.append(("norm", seq, "backfill", tile))
        tried.add(tile)
    return [(image, *r[:3], *(r[3] or (None, None, None))) for r in out]


@pytest.fixture(scope="module")
def masks():
    rng, out = random.Random(17), {}
    for image, discs in ((1, 3), (2, 7), (3, 12), (4, 1), (5, 18), (6, 9)):
        m = np.zeros((SIDE, SIDE), int)
        y, x = np.mgrid[:SIDE, :SIDE]
        for _ in range(discs):
            cy, cx, r, cls = rng.randrange(SIDE), rng.randrange(SIDE), rng.randrange(1, 7), rng.choice((1, 2, 2))
            m[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = cls
        out[image] = m
    return out


@pytest.fixture(scope="module")
def built(spark, masks):
    px = spark.createDataFrame([(i, y, x, int(m[y, x])) for i, m in masks.items() for y in range(SIDE) for x in range(SIDE)], "img_id long, y int, x int, cls int")
    images = spark.createDataFrame([(i, SIDE, SIDE) for i in masks], "img_id long, height int, width int")
    return build_dataset(px, images, min_pixels=MIN_PIXELS, distance=NEAR, padding=6, min_padding=2, step=2, expand=10, margin=MARGIN, min_tile=LEAST, normal_tile=NORMAL, shift=SHIFT).cache()


def test_build_is_the_plain_one_tile_by_tile(built, masks):
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in built.select("img_id", "phase", "obj_id", "status", "y1", "x1", "size").collect()), key=key)
    want = sorted((r for i, m in masks.items() for r in plain_build(i, m)), key=key)
    assert got == want
    assert {r[3] for r in want} >= {"saved", "failed_truncation", "isolated", "forced", "shifted", "failed_duplicate", "backfill"}


def test_counters_of_the_build(built, masks):
    want = collections.Counter((r[1], r[3]) for i, m in masks.items() for r in plain_build(i, m))
    got = P.crop_stats(built).first().asDict()
    rate = got.pop("success_rate")
    assert got == {k: want[tuple(k.split("_", 1))] for k in got}
    good = sum(n for (_, s), n in want.items() if s in ("saved", "isolated", "fallback", "forced", "shifted", "backfill"))
    assert rate == round(100 * good / sum(want.values()), 6) and sum(want.values()) == sum(got.values())


def test_sums_of_boxes_and_rings(spark):
    rng = random.Random(6)
    h, w = 101, 75
    m = np.array([[rng.random() < 0.3 for _ in range(w)] for _ in range(h)])
    runs = [(1, y, x, x) for y in range(h) for x in range(w) if m[y, x]]
    images = spark.createDataFrame([(1, h, w), (2, 40, 33)], "img_id int, height int, width int")
    table = summed_area(spark.createDataFrame(runs, "img_id int, y int, x0 int, x1 int"), images).cache()
    assert table.filter("size(inner) != 1024 or size(top) != 32 or size(left) != 32").count() == 0 and table.count() == 4 * 3 + 2 * 2
    boxes = {(i, *sorted(rng.sample(range(h + 1), 2)), *sorted(rng.sample(range(w + 1), 2))) for i in [1] * 60}
    d = spark.createDataFrame([(i, a, c, b, e) for i, a, b, c, e in boxes] + [(2, 0, 0, 40, 33)], "img_id int, y1 int, x1 int, y2 int, x2 int")
    for r in rect_sum(d, table).collect():
        assert r.total == (m[r.y1 : r.y2, r.x1 : r.x2].sum() if r.img_id == 1 else 0)
    tiles = spark.createDataFrame(list({(1, rng.randrange(h - 30), rng.randrange(w - 30), rng.randrange(1, 31)) for _ in range(60)}), "img_id int, y1 int, x1 int, size int")
    for margin in (0, 2, 9):
        for r in ring_sum(tiles, table, margin).collect():
            assert r.ring == (0 if not margin else m[r.y1 : r.y1 + r.size, r.x1 : r.x1 + r.size].sum() - m[r.y1 + margin : r.y1 + r.size - margin, r.x1 + margin : r.x1 + r.size - margin].sum() * (r.size > 2 * margin))


def test_places_of_a_large_object(spark):
    """An object of 5000 x 5000 pixels and a thin one 5000 long: rows stay blocks, and the places are the nearest clean ones."""
    side_, a, n = 5200, 80, 5000
    runs = spark.range(n).select(F.lit(1).alias("img_id"), (F.col("id") + a).cast("int").alias("y"), F.lit(a).alias("x0"), F.lit(a + n - 1).alias("x1"))
    speck = spark.createDataFrame([(1, 75, 2600, 2600)], "img_id int, y int, x0 int, x1 int")  # in the way of the centred place's upper edge
    thin = spark.range(n).select(F.lit(2).alias("img_id"), (F.col("id") + a).cast("int").alias("y"), F.lit(100).alias("x0"), F.lit(104).alias("x1"))
    images = spark.createDataFrame([(1, side_, side_), (2, side_, side_)], "img_id int, height int, width int")
    table = summed_area(runs.union(speck).union(thin), images)
    objects = spark.createDataFrame([(1, 1, a + n // 2, a + n // 2, a, a, a + n - 1, a + n - 1), (2, 1, a + n // 2, 102, a, 100, a + n - 1, 104)], "img_id int, obj_id int, cy int, cx int, y1 int, x1 int, y2 int, x2 int")
    got = {r.img_id: (r.y1, r.x1, r.size) for r in P.ring_placement(objects, images, table).collect()}
    size = n - 1 + 60
    centred = a + n // 2 - size // 2
    assert got[2] == (centred, 0, size)
    # The band of three rows may hold neither the speck (row 75) nor the object: it ends above the speck or begins below it.
    assert got[1][2] == size and got[1][1] == centred and got[1][0] in (72 - 0, 73 - 0, centred) and not got[1][0] <= 75 < got[1][0] + 3
    forced = {r.img_id: r.size for r in P.force_placement(objects, images, table).collect()}
    assert set(forced) == {1, 2}
