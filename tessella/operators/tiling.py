"""Tile grids over images, and putting tiled predictions together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.pixels import flip_rot_inverse, spline_line


def _square(tiles: DataFrame, side: int) -> DataFrame:
    """Every pixel (ty, tx) of the tiles, never broadcast: their size is underrated, as in `raster.to_pixels`."""
    span = F.sequence(F.lit(0), F.lit(side - 1))
    return tiles.withColumn("ty", F.explode(span)).withColumn("tx", F.explode(span)).hint("merge")


def _positions(at: Column, n: Column, low: Column, high: Column) -> Column:
    """The places from low to high of the mirrored line that show index ``at`` of a line of n; the ends are not repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    shown = lambda v: F.when(F.ceil((low - v) / period) <= F.floor((high - v) / period), F.transform(F.sequence(F.ceil((low - v) / period), F.floor((high - v) / period)), lambda k: (v + k * period).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_union(shown(at), shown(-at))


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows of a sorted table at which one of the keys changes."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def inference_grid(pixels: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """R2. ``pixels`` (img_id, y, x, ...) with tile_idx, ty, tx: tiles in row order over the image padded to a multiple, edges repeated.

    Every pixel finds its own places in tiles; but for the images' sizes nothing is joined.
    """
    up = lambda c: F.ceil(F.col(c) / tile).cast("int")
    spread = lambda c, n: F.explode(F.when(F.col(c) < F.col(n) - 1, F.array(c)).otherwise(F.sequence(F.col(c), up(n) * tile - 1)))
    d = pixels.join(images.select("img_id", F.col("height").alias("_h"), F.col("width").alias("_w")), "img_id")
    d = d.withColumn("_py", spread("y", "_h")).withColumn("_px", spread("x", "_w"))
    at = F.expr(f"_py div {tile}") * up("_w") + F.expr(f"_px div {tile}")
    return d.withColumns({"tile_idx": at.cast("int"), "ty": F.col("_py") % tile, "tx": F.col("_px") % tile}).drop("_h", "_w", "_py", "_px")


def stitch(tiles: DataFrame, images: DataFrame, tile: int, values: list[str]) -> DataFrame:
    """R14. (img_id, y, x, values...) of tile pixels (img_id, tile_idx, ty, tx, values...), cropped to the image."""
    d = tiles.join(images.withColumn("cols", F.ceil(F.col("width") / tile).cast("int")), "img_id")
    y, x = F.floor(F.col("tile_idx") / F.col("cols")) * tile + F.col("ty"), F.col("tile_idx") % F.col("cols") * tile + F.col("tx")
    return d.withColumns({"y": y.cast("int"), "x": x.cast("int")}).filter("y < height and x < width").select("img_id", "y", "x", *values)


def _pad(window: int, subdivisions: int) -> int:
    return round(window * (1 - 1 / subdivisions))


def overlap_grid(pixels: DataFrame, images: DataFrame, window: int, subdivisions: int, value: str) -> DataFrame:
    """R3. (img_id, y0, x0, i, j, values): overlapping windows on the reflected image, from (y0, x0) in padded pixels, cut at the step.

    The reflected image is cut once in blocks of a step's side, each one row with its values by rows; a window is
    subdivisions x subdivisions of them (i, j), so windows are named in place and no pixel is shuffled again.
    """
    pad, step = _pad(window, subdivisions), window // subdivisions
    d = pixels.select("img_id", "y", "x", F.col(value).alias("_v")).join(images.select("img_id", "height", "width"), "img_id")
    # Where the rim is narrower than the image, an index shows itself and at most one mirrored place on each side.
    mirrored = lambda c, n: F.array(F.col(c), F.when((F.col(c) > 0) & (F.col(c) <= pad), -F.col(c)), F.when((F.col(c) < F.col(n) - 1) & (F.col(c) >= F.col(n) - 1 - pad), 2 * (F.col(n) - 1) - F.col(c)))
    place = lambda c, n: F.explode(F.when(F.col(n) > pad, mirrored(c, n)).otherwise(_positions(F.col(c), F.col(n), F.lit(-pad), F.col(n) + pad - 1)))
    d = d.withColumn("_y", place("y", "height")).filter("_y is not null").withColumn("_x", place("x", "width")).filter("_x is not null")
    d = d.withColumns({"_y": F.col("_y") + pad, "_x": F.col("_x") + pad})
    at = (F.col("_y") % step * step + F.col("_x") % step).cast("int")
    blocks = d.groupBy("img_id", "height", "width", F.expr(f"_y div {step}").alias("by"), F.expr(f"_x div {step}").alias("bx")).agg(F.collect_list(at).alias("at"), F.collect_list("_v").alias("values"))
    kinds = dict(blocks.dtypes)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat = batch.num_rows, batch.column("values").flatten()
            order = np.argsort(np.asarray(batch.column("at").flatten()).reshape(n, step * step), axis=1) + np.arange(n)[:, None] * step * step
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * step * step + 1, step * step, dtype=np.int32)), flat.take(pa.array(order.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("img_id", "height", "width", "by", "bx")] + [values], names=["img_id", "height", "width", "by", "bx", "values"])

    blocks = blocks.filter(F.size("at") == step * step).mapInArrow(in_order, ", ".join(f"{c} {kinds[c]}" for c in ("img_id", "height", "width", "by", "bx", "values")))
    line = F.sequence(F.lit(0), F.lit(subdivisions - 1))
    out = blocks.withColumn("i", F.explode(line)).withColumn("j", F.explode(line))
    out = out.withColumns({"y0": ((F.col("by") - F.col("i")) * step).cast("int"), "x0": ((F.col("bx") - F.col("j")) * step).cast("int")})
    fits = lambda c, n: (F.col(c) >= 0) & (F.col(c) + window <= F.col(n) + 2 * pad)
    return out.filter(fits("y0", "height") & fits("x0", "width")).select("img_id", "y0", "x0", "i", "j", "values")


def blend_overlaps(preds: DataFrame, images: DataFrame, window: int, subdivisions: int, value: str, norm: str = "weights") -> DataFrame:
    """R13. (img_id, y, x, value): overlapping predictions (img_id, y0, x0, i, j, values) weighted by the spline window, summed, divided by subdivisions squared or by the weights, and cropped.

    What is shuffled is one row for each block of a window, subdivisions squared of them; up to as many meet in a block of the image and are added elementwise.
    """
    pad, step = _pad(window, subdivisions), window // subdivisions
    line = np.array(spline_line(window)).reshape(subdivisions, step)
    weights = np.einsum("ia,jb->ijab", line, line).reshape(subdivisions**2, step * step)
    kind, own = dict(preds.dtypes)["img_id"], np.arange(step * step)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            new = _starts(t, ["img_id", "by", "bx"])
            held = t.slice(int(new[-1]))  # the last block may go on in the next batch
            if len(new) > 1:
                yield summed(t.slice(0, int(new[-1])), new[:-1])
        if held is not None:
            yield summed(held, np.zeros(1, np.int64))

    def summed(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        w = weights[t.column("i").to_numpy() * subdivisions + t.column("j").to_numpy()]
        v = np.asarray(t.column("values").combine_chunks().flatten()).astype(float).reshape(-1, step * step)
        value, weight = np.add.reduceat(v * w, first, axis=0), np.add.reduceat(w, first, axis=0)
        y = (t.column("by").to_numpy()[first] * step - pad)[:, None] + own // step
        x = (t.column("bx").to_numpy()[first] * step - pad)[:, None] + own % step
        image = t.column("img_id").combine_chunks().take(pa.array(np.repeat(first, step * step)))
        return pa.RecordBatch.from_arrays([image, *(pa.array(c.ravel().astype(np.int32)) for c in (y, x)), pa.array(value.ravel()), pa.array(weight.ravel())], names=["img_id", "y", "x", "_v", "_w"])

    by, bx = (F.col("y0") / step + F.col("i")).cast("int"), (F.col("x0") / step + F.col("j")).cast("int")
    parts = preds.select("img_id", by.alias("by"), bx.alias("bx"), "i", "j", "values")
    d = parts.repartition("img_id", "by", "bx").sortWithinPartitions("img_id", "by", "bx").mapInArrow(add, f"img_id {kind}, y int, x int, _v double, _w double")
    d = d.join(images, "img_id").filter("y >= 0 and x >= 0 and y < height and x < width")
    below = F.lit(float(subdivisions**2)) if norm == "subdivisions" else F.col("_w")
    return d.select("img_id", "y", "x", (F.col("_v") / below).alias(value))


def chunk_grid(images: DataFrame, pixels: DataFrame, chunk: tuple[int, int], value: str, white: int = 255) -> DataFrame:
    """R4. (img_id, chunk_idx, ty, tx, value): chunks of (rows, columns) in row order; where the image doesn't divide, white fills up.

    A chunk's rows meet the pixels as arrays, one for each; the places that a row lacks become white in it.
    """
    ch, cw = chunk
    t = images.withColumn("rows", F.ceil(F.col("height") / ch).cast("int")).withColumn("cols", F.ceil(F.col("width") / cw).cast("int")).withColumn("chunk_idx", F.explode(F.expr("sequence(0, rows * cols - 1)")))
    t = t.select("img_id", "chunk_idx", "cols", F.explode(F.sequence(F.lit(0), F.lit(ch - 1))).alias("ty")).hint("merge")
    t = t.select("img_id", "chunk_idx", "ty", (F.floor(F.col("chunk_idx") / F.col("cols")) * ch + F.col("ty")).cast("int").alias("y"), (F.col("chunk_idx") % F.col("cols")).alias("_k"))
    own = pixels.filter("y is not null and x is not null").select("img_id", "y", F.floor(F.col("x") / cw).cast("int").alias("_k"), F.pmod("x", F.lit(cw)).cast("int").alias("_x"), F.coalesce(value, F.lit(white)).alias("_v"))
    rows = own.groupBy("img_id", "y", "_k").agg(F.collect_list("_x").alias("_x"), F.collect_list("_v").alias("_v"))
    d = t.join(rows, ["img_id", "y", "_k"], "left").withColumns({c: F.coalesce(c, F.array().cast(dict(rows.dtypes)[c])) for c in ("_x", "_v")})
    rest = F.array_except(F.sequence(F.lit(0), F.lit(cw - 1)), "_x")
    fill = F.array_repeat(F.lit(white).cast(dict(own.dtypes)["_v"]), F.size("_rest"))
    d = d.withColumn("_rest", rest).withColumn("_p", F.explode(F.arrays_zip(F.concat("_x", "_rest").alias("tx"), F.concat("_v", fill).alias("v"))))
    return d.select("img_id", "chunk_idx", "ty", F.col("_p.tx").alias("tx"), F.col("_p.v").alias(value))


def tta_average(preds: DataFrame, side: int, values: list[str]) -> DataFrame:
    """R12. (tile_id, y, x, values...): predictions of the eight symmetric tiles (tile_id, k, y, x, values...) turned back and averaged."""
    y, x = flip_rot_inverse(F.col("y"), F.col("x"), side, F.col("k"))
    return preds.groupBy("tile_id", y.cast("int").alias("_y"), x.cast("int").alias("_x")).agg(*(F.avg(v).alias(v) for v in values)).withColumnsRenamed({"_y": "y", "_x": "x"})


def extract_padded(tiles: DataFrame, pixels: DataFrame, side: int, fill: dict[str, int]) -> DataFrame:
    """R28. (img_id, tile_id, ty, tx, values...): pixels of square tiles (y1, x1) that may leave the image, where what ``fill`` has for each value stands. All values come by one join."""
    p = _square(tiles, side).withColumn("y", F.col("y1") + F.col("ty")).withColumn("x", F.col("x1") + F.col("tx"))
    return p.join(pixels.select("img_id", "y", "x", *fill), ["img_id", "y", "x"], "left").select("img_id", "tile_id", "ty", "tx", *(F.coalesce(v, F.lit(n)).alias(v) for v, n in fill.items()))
