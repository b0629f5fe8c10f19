"""The whole tile build over masks, from runs to placed tiles with their outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import placement as P
from tessella.operators import raster as R
from tessella.operators.sums import summed_area
from tessella.storage import stored


def build_dataset(mask: DataFrame, images: DataFrame, min_pixels: int = 10, distance: int = 150, padding: int = P.PADDING, min_padding: int = P.MIN_PADDING, step: int = P.PADDING_STEP, expand: int = P.MAX_EXPAND, margin: int = P.MARGIN, min_tile: int = P.MIN_TILE, normal_tile: int = 100, shift: int = 10) -> DataFrame:
    """(img_id, phase, obj_id, status, y1, x1, size): every candidate tile of masks (img_id, y, x, cls) and what became of it.

    Tiny abnormal components go first. Groups of near objects (greedy), then each object (ind: a clean
    ring, else a clean fit, else forced to the fewest foreign pixels, else centred), then normal
    objects away from abnormal ones (norm), up to as many as there are abnormal tiles, at least five,
    the rest filled up from normal pixels. Of equal squares the first stands, but forced ones stay.
    """
    fit = {"padding": padding, "min_padding": min_padding, "step": step, "min_tile": min_tile}
    runs = stored(R.drop_tiny_components(R.run_length_encode(mask.filter("cls > 0")), min_pixels), "runs")
    sick = runs.filter("cls = 2").select("img_id", "y", "x0", "x1")
    objects = stored(R.component_props(R.connected_components(sick, 4)), "objects")
    calm = R.component_props(R.connected_components(runs.filter("cls = 1").select("img_id", "y", "x0", "x1"), 4))
    sums = stored(summed_area(sick, images), "sums")

    greedy = stored(P.greedy_groups(objects, images, sums, distance, expand=expand, margin=margin, **fit), "greedy").withColumn("phase", F.lit("greedy"))
    # Each search is read several times below.
    ring = stored(P.ring_placement(objects, images, sums, margin=margin, **fit), "ring").withColumn("status", F.lit("isolated"))
    left = objects.join(ring, ["img_id", "obj_id"], "left_anti")
    fitted = stored(P.fit_tile(left, images, sums, expand=expand, margin=margin, **fit), "fitted").withColumn("status", F.lit("fallback"))
    left = left.join(fitted, ["img_id", "obj_id"], "left_anti")
    forced = stored(P.force_placement(left, images, sums, **fit), "forced")
    centred = P.center_tile(left.join(forced, ["img_id", "obj_id"], "left_anti"), padding, min_tile)
    ind = stored(ring.unionByName(fitted).unionByName(forced.unionByName(centred).withColumn("status", F.lit("forced"))), "individual").withColumn("phase", F.lit("ind"))

    placed = P.avoid_pathology(P.tile_for_objects(calm, images, padding, normal_tile), images, sums, shift)
    normals = calm.select("img_id", "obj_id").join(placed, ["img_id", "obj_id"], "left")
    base = greedy.filter("status = 'saved'").select("img_id").unionByName(ind.select("img_id")).groupBy("img_id").agg(F.count(F.lit(1)).alias("n"))
    quota = stored(P.normal_quota(normals.withColumn("placed", F.col("size").isNotNull()), base), "normals")
    status = F.when(F.col("skipped"), "skipped_limit").when(~F.col("placed"), "failed_pathology").when(F.col("shifted"), "shifted").otherwise("saved")
    norm = quota.select("img_id", F.lit("norm").alias("phase"), "obj_id", status.alias("status"), "y1", "x1", "size")
    short = images.select("img_id").join(base, "img_id", "left").select("img_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(5)).alias("target"))
    have = quota.filter("kept").groupBy("img_id").agg(F.count(F.lit(1)).alias("kept"))
    deficit = short.join(have, "img_id", "left").select("img_id", (F.col("target") - F.coalesce("kept", F.lit(0))).alias("n"))

    cols = ["img_id", "phase", "obj_id", "status", "y1", "x1", "size"]
    tiles = greedy.select(*cols).unionByName(ind.select(*cols)).unionByName(norm.select(*cols))
    kind = F.when(F.col("phase") == "greedy", "grp").otherwise(F.col("phase"))
    good = tiles.filter("status in ('saved', 'isolated', 'fallback', 'forced', 'shifted')")
    marked = P.dedup_tiles(good.withColumn("kind", kind).withColumn("forced", F.col("status") == "forced"))
    final = marked.withColumn("status", F.when(F.col("duplicate"), "failed_duplicate").otherwise(F.col("status"))).select(*cols)
    more = P.backfill_normals(R.to_pixels(runs.filter("cls = 1")).select("img_id", "y", "x"), deficit, images, sums, good, normal_tile)
    more = more.select("img_id", F.lit("norm").alias("phase"), F.col("seq").alias("obj_id"), F.lit("backfill").alias("status"), "y1", "x1", "size")
    rest = tiles.filter("status not in ('saved', 'isolated', 'fallback', 'forced', 'shifted')")
    return final.unionByName(rest.select(*cols)).unionByName(more.select(*cols))
