"""Sums over rectangles of a mask by a two-level summed-area table, and searches over places of squares.

The table has one row for each block of BLOCK x BLOCK pixels of an image: corner, the pixels before its first row
and first column; top, those above it up to each of its columns; left, those on its left down to each of its
rows; inner, those inside it. Four look-ups give any rectangle, and no row is larger than a block.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import spread, stored

BLOCK = 32
#: Places of a square, a side, that one search tries.
PLACES = 128
#: Blocks that are painted at once.
PAINTED = 512
#: Side of the regions whose searches share their blocks.
REGION = 512


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel(), kind))


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def _paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums inside each block, of the pieces of runs in it; bottom and right: its last row and column."""
    for batch in (whole.slice(a, PAINTED) for whole in batches for a in range(0, whole.num_rows, PAINTED)):
        n, pieces = batch.num_rows, batch.column("pieces")
        on = np.zeros((n, BLOCK, BLOCK + 1), np.int32)
        of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))
        y, a, b = (np.asarray(pieces.flatten().field(k)) for k in range(3))
        np.add.at(on, (of, y, a), 1)
        np.add.at(on, (of, y, b + 1), -1)
        inner = (np.cumsum(on, axis=2)[:, :, :BLOCK] > 0).cumsum(axis=1).cumsum(axis=2)
        kept = [batch.column(k) for k in ("img_id", "by", "bx")]
        made = [_lists(inner[:, -1, :], pa.int32()), _lists(inner[:, :, -1], pa.int32()), _lists(inner.reshape(n, -1), pa.int16())]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=["img_id", "by", "bx", "bottom", "right", "inner"])


def _carried(line: str, key: list[str], name: str):
    """``name``: for each block the sum of ``line`` over the earlier blocks of the same key, in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _rows(batch.column(line))
            keys = [batch.column(k).to_pylist() for k in key]
            at = list(zip(*keys, strict=True))
            new = np.array([True] + [at[k] != at[k - 1] for k in range(1, len(at))])
            before = np.cumsum(m, axis=0) - m
            first = np.flatnonzero(new)
            base = np.repeat(before[first], np.diff(np.append(first, len(at))), axis=0)
            out = before - base
            if last == at[0]:
                until = first[1] if len(first) > 1 else len(at)
                out[:until] += carry
            carry, last = out[-1] + m[-1], at[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(out, pa.int64())], names=[*batch.schema.names, name])

    return run


def summed_area(runs: DataFrame, images: DataFrame) -> DataFrame:
    """W11. The summed-area table (img_id, by, bx, corner, top, left, inner) of runs (img_id, y, x0, x1) in images (img_id, height, width).

    Runs are cut at blocks and painted block by block; columns of blocks, then rows of blocks, pass in order
    and carry one line of sums each.
    """
    kind = dict(images.dtypes)["img_id"]
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    cut = runs.select("img_id", "y", "x0", "x1", block("y").alias("by"), F.explode(F.sequence(block("x0"), block("x1"))).alias("bx"))
    piece = F.struct((F.col("y") - F.col("by") * BLOCK).alias("y"), F.greatest(F.col("x0") - F.col("bx") * BLOCK, F.lit(0)).alias("a"), F.least(F.col("x1") - F.col("bx") * BLOCK, F.lit(BLOCK - 1)).alias("b"))
    pieces = cut.select("img_id", "by", "bx", piece.alias("p")).groupBy("img_id", "by", "bx").agg(F.collect_list("p").alias("pieces"))
    grid = images.select("img_id", F.explode(F.expr(f"sequence(0, cast((height - 1) div {BLOCK} as int))")).alias("by"), "width").withColumn("bx", F.explode(F.expr(f"sequence(0, cast((width - 1) div {BLOCK} as int))")))
    told = grid.select("img_id", "by", "bx").join(pieces, ["img_id", "by", "bx"], "left")
    fields = f"img_id {kind}, by int, bx int, bottom array<int>, right array<int>, inner array<short>"
    painted = told.mapInArrow(_paint, fields)
    down = painted.repartition("img_id", "bx").sortWithinPartitions("img_id", "bx", "by").mapInArrow(_carried("bottom", ["img_id", "bx"], "top"), f"{fields}, top array<long>")
    across = down.withColumn("line", F.concat(F.col("right").cast("array<long>"), F.array(F.element_at("top", -1))))
    fields = f"{fields}, top array<long>, line array<long>"
    whole = across.repartition("img_id", "by").sortWithinPartitions("img_id", "by", "bx").mapInArrow(_carried("line", ["img_id", "by"], "left"), f"{fields}, left array<long>")
    # top counts the block's own columns only; the last entry of the lines before it, what is above the earlier blocks.
    return whole.select("img_id", "by", "bx", F.element_at("left", -1).alias("corner"), "top", F.slice("left", 1, BLOCK).alias("left"), "inner")


def _signed(boxes: DataFrame, table: DataFrame, corners: list[tuple[Column, Column, int]], name: str) -> DataFrame:
    """``boxes`` (distinct rows) with the signed sum of the table before each corner: one join by block."""
    own = F.struct(*(F.col(c) for c in boxes.columns))
    each = F.explode(F.array(*(F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), F.lit(s).alias("s")) for y, x, s in corners)))
    c = boxes.select("img_id", own.alias("_box"), each.alias("c")).withColumns({"_y": F.col("c.y") - 1, "_x": F.col("c.x") - 1})
    c = c.withColumns({"by": F.floor(F.col("_y") / BLOCK).cast("int"), "bx": F.floor(F.col("_x") / BLOCK).cast("int")}).withColumns({"_y": F.col("_y") - F.col("by") * BLOCK, "_x": F.col("_x") - F.col("bx") * BLOCK}).hint("merge")
    value = F.col("corner") + F.element_at("top", F.col("_x") + 1) + F.element_at("left", F.col("_y") + 1) + F.element_at("inner", F.col("_y") * BLOCK + F.col("_x") + 1)
    found = c.join(table, ["img_id", "by", "bx"], "left").select("_box", (F.col("c.s") * F.coalesce(value, F.lit(0).cast("long"))).alias("v"))
    return found.groupBy("_box").agg(F.sum("v").alias(name)).select("_box.*", name)


def _corners(y1: Column, x1: Column, y2: Column, x2: Column, sign: int = 1) -> list[tuple[Column, Column, int]]:
    return [(y2, x2, sign), (y1, x2, -sign), (y2, x1, -sign), (y1, x1, sign)]


def rect_sum(boxes: DataFrame, table: DataFrame, box: tuple[str, str, str, str] = ("y1", "x1", "y2", "x2"), name: str = "total") -> DataFrame:
    """W11. Distinct ``boxes`` (img_id, ...) with the sum inside each half-open box of the image: a corner on its first row or column counts 0."""
    return _signed(boxes, table, _corners(*(F.col(c) for c in box)), name)


def ring_sum(tiles: DataFrame, table: DataFrame, margin: int) -> DataFrame:
    """W11. Distinct square ``tiles`` (img_id, y1, x1, size, ...) with ring: the sum in the band of ``margin`` inside each edge; 0 for no margin, all for a tile without an inside."""
    if margin <= 0:
        return tiles.withColumn("ring", F.lit(0).cast("long"))
    y1, x1, size = F.col("y1"), F.col("x1"), F.col("size")
    in_ = F.when(size <= 2 * margin, 0).otherwise(margin)  # without an inside the inner box is empty
    y2, x2 = F.when(size <= 2 * margin, y1).otherwise(y1 + size - margin), F.when(size <= 2 * margin, x1).otherwise(x1 + size - margin)
    return _signed(tiles, table, _corners(y1, x1, y1 + size, x1 + size) + _corners(y1 + in_, x1 + in_, y2, x2, -1), "ring")


Blocks = dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed spans of whole numbers as few that ascend and do not touch."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _cut(spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(block, its first and last line, where that is) for the lines before which the spans ask, and where each span begins; line 0 has nothing before it."""
    out, starts, n = [], [], 0
    for a, z in spans:
        starts.append(n)
        for k in range((max(a, 1) - 1) // BLOCK, (z - 1) // BLOCK + 1 if z > 0 else 0):
            first, last = max(a, 1, k * BLOCK + 1), min(z, (k + 1) * BLOCK)
            out.append((k, first - 1 - k * BLOCK, last - 1 - k * BLOCK, n + first - a))
        n += z - a + 1
    return out, [*starts, n]


def _matrix(blocks: Blocks, rows: list[tuple[int, int]], cols: list[tuple[int, int]]) -> tuple[np.ndarray, list[int], list[int]]:
    """The table before each row and column of the spans, and where each span begins in it."""
    (down, tops), (across, lefts) = _cut(rows), _cut(cols)
    out = np.zeros((tops[-1], lefts[-1]), np.int64)
    for by, y0, y1, r in down:
        for bx, x0, x1, c in across:
            corner, top, left, inner = blocks[by, bx]
            out[r : r + y1 - y0 + 1, c : c + x1 - x0 + 1] = corner + top[None, x0 : x1 + 1] + left[y0 : y1 + 1, None] + inner[y0 : y1 + 1, x0 : x1 + 1]
    return out, tops, lefts


Best = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], "tuple | None"]


def search_places(places: DataFrame, table: DataFrame, margin: int, stride: int, best: Best, order: str) -> DataFrame:
    """(img_id, obj_id, found): the least of what ``best(pad, ys, xs, sums)`` returns over all places of each row's squares; rows without one are left out.

    places: (img_id, obj_id, pads), pads an array of structs with size, first and last row and column (ya, yz, xa,
    xz) of the square's place and whatever ``best`` reads; a place lies each ``stride``. sums: pixels in the
    band of ``margin`` inside the square's edges, or in all of it for no margin. ``order`` is the type of what ``best`` returns, a struct.

    The places of a row are cut in pieces of PLACES a side, and a piece reads the blocks that hold the corners of its squares, which lie
    near the four corners: what a task holds depends neither on the square's size nor on the object's.
    """
    places = stored(places, "places")  # its expressions are read many times below
    kinds = dict(places.dtypes)
    length = max(stride, PLACES // stride * stride)
    least = lambda c: F.array_min(F.transform("pads", lambda p: p[c]))
    most = lambda c: F.array_max(F.transform("pads", lambda p: p[c]))
    starts = lambda a, z: F.explode(F.sequence(least(a), most(z), F.lit(length)))
    cut = places.filter("size(pads) > 0").select("*", starts("ya", "yz").alias("py")).withColumn("px", starts("xa", "xz"))
    # Within a piece the last place is the last before the next piece, so that strides go on.
    clip = lambda p, a, z, at: (F.greatest(p[a], F.col(at)).alias(a), F.least(p[z], F.col(at) + length - 1).alias(z))
    names = [f.name for f in places.schema["pads"].dataType.elementType.fields]
    clipped = F.transform("pads", lambda p: F.struct(*(p[n].alias(n) for n in names if n not in ("ya", "yz", "xa", "xz")), *clip(p, "ya", "yz", "py"), *clip(p, "xa", "xz", "px")))
    pieces = stored(cut.withColumn("pads", F.filter(clipped, lambda p: (p["ya"] <= p["yz"]) & (p["xa"] <= p["xz"]))).filter("size(pads) > 0"), "pieces")
    at = lambda v: F.floor((F.greatest(v, F.lit(1)) - 1) / BLOCK).cast("int")
    ends = lambda f, make: f(F.transform("pads", make))

    def needed(a: str, z: str) -> Column:
        near = F.sequence(at(least(a)), at(most(z) + margin))
        far = F.sequence(at(ends(F.array_min, lambda p: p[a] + p["size"] - margin)), at(ends(F.array_max, lambda p: p[z] + p["size"])))
        return F.explode(F.array_union(near, far))

    # Pieces of one region of an image are searched together and share their blocks.
    key = ["img_id", "gy", "gx"]
    pieces = pieces.withColumns({"gy": F.floor(F.col("py") / REGION), "gx": F.floor(F.col("px") / REGION)})
    asked = pieces.select(*key, "pads").withColumn("by", needed("ya", "yz")).withColumn("bx", needed("xa", "xz")).drop("pads").distinct().hint("merge")
    blocks = asked.join(table, ["img_id", "by", "bx"]).select(*(F.col(c).alias(c) for c in [*key, "by", "bx", "corner", "top", "left", "inner"]))

    def searched(pads: list[dict], held: Blocks) -> dict | None:
        spans = lambda a, z: _joined([(p[a] + d, p[z] + e) for p in pads for d, e in ((0, margin), (p["size"] - margin, p["size"]))])
        rows, cols = spans("ya", "yz"), spans("xa", "xz")
        (m, tops, lefts), top = _matrix(held, rows, cols), None

        def begins(lines: list[tuple[int, int]], starts: list[int], v: int) -> int:
            k = bisect_right(lines, (v, math.inf)) - 1
            return starts[k] + v - lines[k][0]

        for p in pads:
            ys, xs, size = np.arange(p["ya"], p["yz"] + 1, stride), np.arange(p["xa"], p["xz"] + 1, stride), p["size"]
            tall, wide = p["yz"] - p["ya"] + 1, p["xz"] - p["xa"] + 1
            # The lines of a square's places lie in one span, so each corner's sums are a slice.
            y, x = ({d: begins(lines, starts, p[k] + d) for d in (0, margin, size - margin, size)} for lines, starts, k in ((rows, tops, "ya"), (cols, lefts, "xa")))
            look = lambda dy, dx: m[y[dy] : y[dy] + tall : stride, x[dx] : x[dx] + wide : stride]  # noqa: B023, E731
            rect = lambda a, b: look(b, b) - look(a, b) - look(b, a) + look(a, a)  # noqa: B023, E731
            sums = rect(0, size)
            if margin > 0 and size > 2 * margin:
                sums = sums - rect(margin, size - margin)
            one = best(p, ys, xs, sums)
            if one is not None and (top is None or one < top):
                top = one
        return None if top is None else dict(zip(fields, map(int, top), strict=True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a region come together, its blocks before its pieces; only its blocks are held."""
        held, last = {}, None
        for batch in batches:
            piece = batch.column("piece").to_pylist()
            pads, regions = batch.column("pads").to_pylist(), zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            by, bx, corner = (batch.column(k).drop_null().to_pylist() for k in ("by", "bx", "corner"))
            top, left, inner = (np.asarray(batch.column(k).flatten()).reshape(-1, n) for k, n in (("top", BLOCK), ("left", BLOCK), ("inner", BLOCK**2)))
            kept, found, k = [], [], 0
            for row, region in enumerate(regions):
                if region != last:
                    held, last = {}, region
                if not piece[row]:
                    held[by[k], bx[k]] = (corner[k], top[k], left[k], inner[k].reshape(BLOCK, BLOCK))
                    k += 1
                elif (one := searched(pads[row], held)) is not None:
                    kept.append(row)
                    found.append(one)
            own = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("img_id").take(own), batch.column("obj_id").take(own), pa.array(found, struct)], names=["img_id", "obj_id", "found"])

    fields = [f.split(":")[0] for f in order[len("struct<") : -1].split(",")]
    struct = pa.struct([(f.split(":")[0], pa.int64() if f.endswith(":long") else pa.int32()) for f in order[len("struct<") : -1].split(",")])
    rows = blocks.withColumn("piece", F.lit(False)).unionByName(pieces.select(*key, "obj_id", "pads", F.lit(True).alias("piece")), allowMissingColumns=True)
    out = spread(rows, *key).sortWithinPartitions(*key, "piece").mapInArrow(search, f"img_id {kinds['img_id']}, obj_id {kinds['obj_id']}, found {order}")
    return out.groupBy("img_id", "obj_id").agg(F.min("found").alias("found"))
