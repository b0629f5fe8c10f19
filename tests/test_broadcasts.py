"""Rows that were exploded, and tables read again, are never sent whole through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import raster as R
from tessella.operators import spatial as S
from tessella.operators.sums import rect_sum
from tessella.storage import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_painted_runs_are_shuffled(spark):
    """F3."""
    d = spark.range(40).select((F.col("id") % 4).alias("img_id"), F.lit(1).alias("y"), (F.col("id") * 5 % 60).cast("int").alias("x0"), (F.col("id") * 5 % 60 + 90).cast("int").alias("x1"), (1 + F.col("id") % 2).cast("int").alias("cls"))
    painted = R.paint_priority(d)
    assert "Broadcast" not in plan(painted)
    got = sorted((r.img_id, r.x0, r.x1, r.cls) for r in painted.collect())
    want = []
    for img in range(4):
        best = {}
        for r in (r for r in d.collect() if r.img_id == img):
            for x in range(r.x0, r.x1 + 1):
                best[x] = max(best.get(x, 0), r.cls)
        for x in sorted(best):
            if want and want[-1][0] == img and want[-1][2] == x - 1 and want[-1][3] == best[x]:
                want[-1][2] = x
            else:
                want.append([img, x, x, best[x]])
    assert got == sorted(map(tuple, want))


def test_spatial_joins_and_stored_tables_are_shuffled(spark):
    """the cells of J6, J7 and the tables that J7 stores between its rounds."""
    d = spark.range(40).selectExpr("id % 4 as g", "cast(id as int) as k", "cast(id * 37 % 900 as int) as a", "cast(id * 53 % 900 as int) as b")
    box = ["cast(a + 20 as int)", "cast(b + 20 as int)"]
    objects = d.filter("k % 2 = 0").selectExpr("g", "k as obj_id", "a as x1", "b as y1", f"{box[0]} as x2", f"{box[1]} as y2")
    records = d.filter("k % 2 = 1").selectExpr("g % 4 as g", "k as rec_id", "a as xmin", "b as ymin", f"{box[0]} as xmax", f"{box[1]} as ymax")
    records = records.unionByName(records.withColumn("g", (F.col("g") + 1) % 4))
    assert "Broadcast" not in plan(S.bucket_join(objects, records, ["g"], ("x1", "y1", "x2", "y2"), S.ANN, 64))
    assert "Broadcast" not in plan(stored(objects, "objects").join(records, "g"))
    found = S.match_object_record(objects, records, ["g"], 8)
    assert "Broadcast" not in plan(found)
    got = {(r.g, r.obj_id): (r.rec_id, r.area) for r in found.collect()}
    for o in objects.collect():
        near = []
        for r in (r for r in records.collect() if r.g == o.g):
            w, h = min(o.x2, r.xmax) - max(o.x1, r.xmin), min(o.y2, r.ymax) - max(o.y1, r.ymin)
            area = w * h if w >= 0 and h >= 0 else 0
            near.append((-area, 0 if area else (r.xmin - o.x1) ** 2 + (r.ymin - o.y1) ** 2, r.rec_id))
        assert got[o.g, o.obj_id] == (min(near)[2], -min(near)[0])


def test_neighbours_and_sums_are_shuffled(spark):
    """what R21 and R22 join."""
    d = spark.range(40).selectExpr("id % 4 as img_id", "cast(id as int) as obj_id", "cast(id * 7 % 90 as int) as cx", "cast(id * 11 % 90 as int) as cy")
    assert "Broadcast" not in plan(S.neighbours(d, ["img_id"], 20))
    table = spark.createDataFrame([], "img_id long, by int, bx int, corner long, top array<long>, left array<long>, inner array<short>")
    boxes = d.selectExpr("img_id", "obj_id", "cy as y1", "cx as x1", "cy + 5 as y2", "cx + 5 as x2")
    assert "Broadcast" not in plan(rect_sum(boxes, table))
