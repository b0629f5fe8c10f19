"""Masks as runs and pixels: encoding, components, holes, prefix sums, neighbourhoods and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.operators.graph import components
from tessella.operators.ranking import sample_rows, unit_interval
from tessella.storage import stored

#: A run's number in its image: its row times this, plus its first column; columns must be below it, and so must rows.
STRIDE = 1 << 31
#: Columns of a cell, by which runs of a row meet.
CELL = 64


def run_length_encode(pixels: DataFrame, group: list[str] | None = None, value: str = "cls", where: Column | None = None, mark: Column | None = None) -> DataFrame:
    """W10. (group..., value, y, x0, x1): maximal runs of equal values in each row. Pixels may have gaps.

    Of the pixels only those count for which ``where`` holds; with ``mark``, ``marked`` says whether it holds for one of the run's. Pixels
    become bits of cells of CELL columns where they lie; only these are shuffled, and read as runs in Arrow batches.
    """
    group = group or ["img_id"]
    row, kinds = [*group, value, "y"], dict(pixels.dtypes)
    bit, none = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x", F.lit(CELL)).cast("int")), F.lit(0).cast("long")
    on = bit if where is None else F.when(where, bit).otherwise(none)
    held = {"_on": on} if mark is None else {"_on": on, "_marked": F.when(mark, on).otherwise(none)}
    cells = pixels.groupBy(*row, F.floor(F.col("x") / CELL).alias("_c")).agg(*(F.bit_or(v).alias(k) for k, v in held.items())).filter("_on != 0")
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in row), f"x0 {kinds['x']}", f"x1 {kinds['x']}", *(["marked boolean"] if mark is not None else [])])
    kind = to_arrow_type(pixels.schema["x"].dataType)
    return cells.repartition(*row).sortWithinPartitions(*row, "_c").mapInArrow(lambda batches: _bit_runs(batches, row, kind), fields)


def _bits(column: pa.Array) -> np.ndarray:
    """The bits of 64-bit numbers, lowest first, as one row of booleans."""
    return np.unpackbits(column.to_numpy().astype("<i8").view(np.uint8), bitorder="little").view(bool)


def _bit_runs(batches: Iterator[pa.RecordBatch], row: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Runs (row..., x0, x1), of this kind, of cells (row..., _c, _on), in order; with _marked, whether a run holds one of its bits."""
    for t, new in _whole(batches, row):
        on, c = _bits(t.column("_on")), t.column("_c").to_numpy()
        apart = new.copy()
        apart[1:] |= c[1:] != c[:-1] + 1
        before, after = np.zeros(len(on), bool), np.zeros(len(on), bool)
        before[1:], after[:-1] = on[:-1], on[1:]
        before[::CELL] &= ~apart
        after[CELL - 1 : -1 : CELL] &= ~apart[1:]
        first, last = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after)
        own = pa.array(first // CELL)
        ends = [pa.array(c[at // CELL] * CELL + at % CELL).cast(kind) for at in (first, last)]
        out = {k: t.column(k).take(own) for k in row} | dict(zip(("x0", "x1"), ends, strict=True))
        if "_marked" in t.schema.names:
            seen = np.concatenate([[0], np.cumsum(_bits(t.column("_marked")))])
            out["marked"] = pa.array(seen[last + 1] > seen[first])
        yield pa.RecordBatch.from_pydict(out)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows in the order of the keys, cut so that no group goes on in the next, with the rows at which a group begins."""
    held = None
    for batch in batches:
        t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not t.num_rows:
            continue
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            col = t.column(k)
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield t.slice(0, cut), new[:cut]
        held = t.slice(cut)
    if held is not None:
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        yield held, new


def to_pixels(runs: DataFrame) -> DataFrame:
    """Runs as pixels: x in place of x0, x1. For results that are pixels; operators meet runs and pixels by cells (`pixels_in_runs`).

    Spark takes exploded rows to be as small as those they come from and would broadcast them; the hint makes joins shuffle.
    """
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1").hint("merge")


def in_cells(runs: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """``runs`` once for each cell of CELL columns between first and last, with _c; never broadcast, as in `to_pixels`."""
    at = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / CELL)
    return runs.withColumn("_c", F.explode(F.sequence(at(first), at(last)))).hint("merge")


def pixels_in_runs(pixels: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """Pixels (group..., y, x, ...) with the other columns of the run (group..., y, x0, x1, ...) they lie in: one row a pixel and run, met in its cell."""
    cells = in_cells(runs, "x0", "x1").withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    return pixels.withColumn("_c", F.floor(F.col("x") / CELL)).join(cells, [*group, "y", "_c"]).filter("x >= _x0 and x <= _x1").drop("_c", "_x0", "_x1")


def merge_runs(runs: DataFrame, group: list[str]) -> DataFrame:
    """Overlapping or touching runs of the same group and row as one."""
    w = Window.partitionBy(*group, "y").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("x0") > before + 1)).cast("int")
    marked = runs.withColumn("_new", new)
    return marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*group, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


#: Edge rows that are worked out at once.
EDGE_ROWS = 1 << 20


def _scan(x: np.ndarray, y: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """(polygon, y, x0, x1) of the filled polygons whose vertices lie between the cuts, in no order.

    Lines of all polygons are numbered, and crossings dealt to them by their numbers; only lines of more than two crossings are sorted, and only
    those that hold several runs, or a vertex, are merged.
    """
    size = np.diff(cut)
    of = np.repeat(np.arange(len(size)), size)
    if not len(x):
        return of, y, x, x
    follow = np.arange(len(x)) + 1
    follow[cut[1:][size > 0] - 1] = cut[:-1][size > 0]
    qx, qy = x[follow], y[follow]
    low, high = np.minimum(y, qy), np.maximum(y, qy)
    some, at = np.flatnonzero(size), cut[:-1][size > 0]
    top, tall = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    top[some] = np.minimum.reduceat(y, at)
    tall[some] = np.maximum.reduceat(y, at) - top[some] + 1
    base = np.cumsum(tall) - tall - top  # a polygon's row y is line base + y
    rows = high - low
    edge = np.repeat(np.arange(len(x)), rows)
    down = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows) + (low - y)[edge]
    cross = x[edge] + down * (qx - x)[edge] / (qy - y)[edge]
    line = down + (y + base[of])[edge]
    n = np.bincount(line, minlength=int(tall.sum()))
    one, two = np.empty(len(n)), np.empty(len(n))
    two[line], one[line[::-1]] = cross, cross[::-1]
    if len(n) and n.max() > 2:  # every line has an even number of crossings
        more = np.flatnonzero(n[line] > 2)
        more = more[np.lexsort((cross[more], line[more]))]
        where, c = line[more], cross[more]
    else:
        where, c = np.zeros(0, np.int64), np.zeros(0)
    pair = np.flatnonzero(n == 2)
    x0 = np.concatenate([np.ceil(np.minimum(one[pair], two[pair])), np.ceil(c[::2])]).astype(np.int64)
    x1 = np.concatenate([np.floor(np.maximum(one[pair], two[pair])), np.floor(c[1::2])]).astype(np.int64)
    line = np.concatenate([pair, where[::2]])
    full, level = x0 <= x1, y == qy
    own = base[of] + y
    busy = n > 2
    busy[own] = True
    alone = full & ~busy[line]
    full &= busy[line]
    parts = [(line[full], x0[full], x1[full]), (own[level], np.minimum(x, qx)[level], np.maximum(x, qx)[level]), (own, x, x)]
    merged = _merged(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    line, x0, x1 = (np.concatenate(c) for c in zip((line[alone], x0[alone], x1[alone]), merged, strict=True))
    poly = np.repeat(np.arange(len(size)), tall)[line]
    return poly, line - base[poly], x0, x1


def _merged(line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """One run for those of a line that overlap or touch."""
    order = np.lexsort((x1, x0, line))
    line, x0, x1 = line[order], x0[order], x1[order]
    base = x0.min()
    wide = int(x1.max() - base) + 3
    nth = np.cumsum(np.concatenate([[False], line[1:] != line[:-1]]))
    reached = np.maximum.accumulate(x1 - base + nth * wide) - nth * wide + base
    first = np.flatnonzero(np.concatenate([[True], (nth[1:] != nth[:-1]) | (x0[1:] > reached[:-1] + 1)]))
    return line[first], x0[first], np.maximum.reduceat(x1, first)


def _scanned(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """`_scan` of a batch with points _x, _y, in pieces of about EDGE_ROWS; polygons are numbered by their row."""
    x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_x", "_y"))
    cut = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_x")), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    tall, some = np.zeros(len(cut) - 1, np.int64), np.flatnonzero(np.diff(cut))
    if len(some):
        tall[some] = (np.maximum.reduceat(y, cut[some]) - np.minimum.reduceat(y, cut[some])) * 2 + 2
    at = np.cumsum(tall) // EDGE_ROWS
    for piece in np.split(np.arange(len(tall)), np.flatnonzero(np.diff(at)) + 1):
        a, b = (piece[0], piece[-1] + 1) if len(piece) else (0, 0)
        poly, row, x0, x1 = _scan(x[cut[a] : cut[b]], y[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
        yield poly + a, row, x0, x1


def _with_points(polys: DataFrame, key: list[str]) -> DataFrame:
    return polys.select(*key, F.transform("points", lambda p: p["x"]).alias("_x"), F.transform("points", lambda p: p["y"]).alias("_y"))


def rasterize(polys: DataFrame, key: list[str]) -> DataFrame:
    """R5. (key..., y, x0, x1): filled polygons by the even-odd rule at integer points, with their vertices and level edges; one run for those that overlap or touch.

    A polygon's rows follow from its own points, so Arrow batches of polygons are scanned in place and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for poly, row, x0, x1 in _scanned(batch):
                own = pa.array(poly)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in key), *(pa.array(v.astype(np.int32)) for v in (row, x0, x1))], names=[*key, "y", "x0", "x1"])

    kinds = dict(polys.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", y int, x0 int, x1 int"
    return _with_points(polys, key).mapInArrow(run, fields)


def filled_area(polys: DataFrame, key: list[str]) -> DataFrame:
    """R5. (key..., area): the points that `rasterize` fills of each polygon that has any, added up where the runs arise, so that only one row for each polygon leaves Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area = np.zeros(batch.num_rows, np.int64)
            for poly, _, x0, x1 in _scanned(batch):
                np.add.at(area, poly, x1 - x0 + 1)
            own = pa.array(np.flatnonzero(area))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in key), pa.array(area).take(own)], names=[*key, "area"])

    kinds = dict(polys.dtypes)
    return _with_points(polys, key).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", area long")


def paint_priority(runs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """R6. Overlapping runs (group..., y, x0, x1, cls) as disjoint ones of the greatest class."""
    group = group or ["img_id"]
    row = [*group, "y"]
    cuts = runs.select(*row, F.explode(F.array(F.col("x0"), F.col("x1") + 1)).alias("a")).distinct()
    segments = cuts.withColumn("b", F.lead("a").over(Window.partitionBy(*row).orderBy("a"))).filter("b is not null").withColumn("_c", F.floor(F.col("a") / CELL))
    top = segments.join(in_cells(runs, "x0", "x1"), [*row, "_c"]).filter("x0 <= a and x1 >= a").groupBy(*row, "a", "b").agg(F.max("cls").alias("cls"))
    return merge_runs(top.select(*row, "cls", F.col("a").alias("x0"), (F.col("b") - 1).alias("x1")), [*group, "cls"])


def pad_border(runs: DataFrame, pad: int) -> DataFrame:
    """R7. Runs of the image enlarged by ``pad`` on each side."""
    return runs.withColumns({"y": F.col("y") + pad, "x0": F.col("x0") + pad, "x1": F.col("x1") + pad})


def crop_to_multiple(pixels: DataFrame, height: int, width: int, factor: int) -> DataFrame:
    """R17. Pixels without the trailing rows and columns beyond a multiple of ``factor``."""
    return pixels.filter((F.col("y") < height - height % factor) & (F.col("x") < width - width % factor))


#: Rows of a strip, whose runs one task labels in memory.
STRIP_ROWS = 256


def _strip_labels(strip: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, c: int) -> np.ndarray:
    """For runs in the order of strip, y and x0, the place of the first run of each one's component inside its strip."""
    n = len(y)
    base = x0.min() - c - 1
    wide = int(x1.max() - base) + c + 2
    row = strip * (STRIP_ROWS + 2) + y % STRIP_ROWS
    first, last = row * wide + x0 - base, row * wide + x1 - base  # both ascend
    low, high = np.searchsorted(last, first - c - wide), np.searchsorted(first, last + c - wide, side="right")
    often = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), often)
    b = np.repeat(low, often) + np.arange(len(a)) - np.repeat(np.cumsum(often) - often, often)
    label = np.arange(n)
    while len(a):
        # Roots hook on to smaller roots, then every run points at its root.
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def connected_components(runs: DataFrame, connectivity: int = 8, group: list[str] | None = None) -> DataFrame:
    """R9. Runs of one class with component, the number of the component's first run.

    Runs of neighbouring rows that touch (for 8 also at a corner) belong together. A task labels the runs of a
    strip of STRIP_ROWS rows in memory. Only what touches across the border of two strips becomes edges between
    the strips' labels, and those spread by joins; images of one strip have none.
    """
    group, c = group or ["img_id"], 1 if connectivity == 8 else 0
    n = runs.withColumn("node", F.col("y").cast("long") * STRIDE + F.col("x0")).withColumn("_s", F.floor(F.col("y") / STRIP_ROWS))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in n.schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, new in _whole(batches, [*group, "_s"]):
            y, x0, x1 = (t.column(k).to_numpy().astype(np.int64) for k in ("y", "x0", "x1"))
            first = _strip_labels(np.cumsum(new), y, x0, x1, c)
            yield t.append_column("local", t.column("node").take(pa.array(first)))

    strips = n.repartition(*group, "_s").sortWithinPartitions(*group, "_s", "y", "x0")
    n = stored(strips.mapInArrow(label, f"{fields}, local long").drop("_s"), "labelled")
    edge = lambda k: F.pmod("y", F.lit(STRIP_ROWS)) == k
    up = n.filter(edge(STRIP_ROWS - 1)).select(*group, F.col("local").alias("a"), (F.col("x0") - c).alias("a0"), (F.col("x1") + c).alias("a1"), (F.col("y") + 1).alias("y"))
    down = n.filter(edge(0)).select(*group, F.col("local").alias("b"), "x0", "x1", "y")
    pairs = in_cells(up, "a0", "a1").join(in_cells(down, "x0", "x1"), [*group, "y", "_c"]).filter((F.col("a0") <= F.col("x1")) & (F.col("x0") <= F.col("a1")))
    pairs = stored(pairs.select(*group, "a", "b").distinct(), "borders")
    if not pairs.limit(1).count():
        return n.withColumn("component", F.col("local")).drop("node", "local")
    labels = components(pairs, group).withColumnRenamed("node", "local")
    return n.join(labels, [*group, "local"], "left").withColumn("component", F.coalesce("component", "local")).select(*runs.columns, "component")


def component_props(labelled: DataFrame, group: list[str] | None = None) -> DataFrame:
    """R10. (group..., component, obj_id, cy, cx, y1, x1, y2, x2, area): centroid cut to whole numbers, inclusive box; obj_id from 1 in scan order."""
    group = group or ["img_id"]
    size = (F.col("x1") - F.col("x0") + 1).cast("long")
    s = labelled.groupBy(*group, "component").agg(
        F.sum(size).alias("area"), F.sum(size * F.col("y")).alias("sy"), F.sum(size * (F.col("x0") + F.col("x1")) / 2).alias("sx"),
        F.min("y").alias("y1"), F.min("x0").alias("xa"), F.max("y").alias("y2"), F.max("x1").alias("x2"),
    )
    number = F.row_number().over(Window.partitionBy(*group).orderBy("component"))
    return s.select(*group, "component", number.alias("obj_id"), F.floor(F.col("sy") / F.col("area")).cast("int").alias("cy"), F.floor(F.col("sx") / F.col("area")).cast("int").alias("cx"), "y1", F.col("xa").alias("x1"), "y2", "x2", "area")


def component_area_filter(labelled: DataFrame, least: int, group: list[str] | None = None) -> DataFrame:
    """L6. Runs of components of at least ``least`` pixels."""
    group = group or ["img_id"]
    size = F.sum((F.col("x1") - F.col("x0") + 1).cast("long"))
    big = labelled.groupBy(*group, "component").agg(size.alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return labelled.join(big, [*group, "component"], "left_semi")


def drop_tiny_components(runs: DataFrame, most: int, cls: int = 2) -> DataFrame:
    """R8. Runs (img_id, cls, y, x0, x1) without the 4-connected components of ``cls`` of up to ``most`` pixels, which become background."""
    kept = component_area_filter(connected_components(runs.filter(F.col("cls") == cls), 4), most + 1).drop("component")
    return runs.filter(F.col("cls") != cls).unionByName(kept)


def records_with_pixels(records: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """L7. Records (img_id, rec_id, half-open box y1, x1, y2, x2) that hold more than ``least`` pixels of the runs; all for ``least`` <= 0."""
    if least <= 0:
        return records
    r = runs.select("img_id", F.col("y").alias("_y"), F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    rows = records.filter("y2 > y1 and x2 > x1").withColumn("_y", F.explode(F.expr("sequence(y1, y2 - 1)")))
    shared = F.greatest(F.lit(0), F.least(F.col("_b") + 1, F.col("x2")) - F.greatest("_a", "x1"))
    n = rows.join(r, ["img_id", "_y"]).groupBy("img_id", "rec_id").agg(F.sum(shared).alias("_n")).filter(F.col("_n") > least).drop("_n")
    return records.join(n, ["img_id", "rec_id"], "left_semi")


def complement(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Runs of what the runs (img_id, y, x0, x1) leave free in images (img_id, height, width)."""
    rows = images.withColumn("y", F.explode(F.expr("sequence(0, height - 1)")))
    ends = rows.select("img_id", "y", F.lit(-1).alias("x0"), F.lit(-1).alias("x1")).union(rows.select("img_id", "y", F.col("width"), F.col("width")))
    marks = merge_runs(runs.select("img_id", "y", "x0", "x1"), ["img_id"]).unionByName(ends)
    after = F.lead("x0").over(Window.partitionBy("img_id", "y").orderBy("x0", "x1"))
    return marks.withColumn("_n", after).filter("_n is not null and _n > x1 + 1").select("img_id", "y", (F.col("x1") + 1).alias("x0"), (F.col("_n") - 1).alias("x1"))


def fill_holes(runs: DataFrame, images: DataFrame) -> DataFrame:
    """R11. The runs with the background that is cut off from the frame (4-connected); the outer contours of the mask are its components."""
    runs = stored(runs.select("img_id", "y", "x0", "x1"), "runs")
    free = connected_components(complement(runs, images), 4).join(images, "img_id")
    edge = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width") - 1)
    outside = free.filter(edge).select("img_id", "component").distinct()
    holes = free.join(outside, ["img_id", "component"], "left_anti")
    return merge_runs(runs.unionByName(holes.select("img_id", "y", "x0", "x1")), ["img_id"])


def outer_contours(runs: DataFrame, images: DataFrame) -> DataFrame:
    """R9, R11. Runs (img_id, y, x0, x1, component) of the areas inside the mask's outer contours: its components (8-connected) with their holes filled and all that lies in these."""
    return stored(connected_components(fill_holes(runs, images), 8), "contours")


def contour_area(labelled: DataFrame) -> DataFrame:
    """(img_id, component, area) inside the line through the centres of the outermost pixels of filled components: each square of four pixels counts 1, each of three 1/2."""
    side = lambda k, up: labelled.select("img_id", "component", (F.col("y") + up).alias("y"), F.col("x0").alias(f"{k}0"), F.col("x1").alias(f"{k}1"))
    pairs = in_cells(side("a", 1), "a0", "a1").join(in_cells(side("b", 0), "b0", "b1"), ["img_id", "component", "y", "_c"])
    pairs = pairs.filter((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")) & (F.floor(F.greatest("a0", "b0") / CELL) == F.col("_c")))
    # Two runs of neighbouring rows share n columns and so n - 1 squares of four; of each run's own neighbours in pairs the other
    # holds one or both at the overlaps with the run less its last and less its first column.
    shared = lambda a0, a1, b0, b1: F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    a0, a1, b0, b1 = (F.col(k) for k in ("a0", "a1", "b0", "b1"))
    four = shared(a0, a1, b0, b1) - 1
    three = shared(a0, a1 - 1, b0, b1) + shared(a0 + 1, a1, b0, b1) + shared(b0, b1 - 1, a0, a1) + shared(b0 + 1, b1, a0, a1) - 4 * four
    found = pairs.groupBy("img_id", "component").agg(F.sum(four + three * 0.5).alias("area"))
    return labelled.select("img_id", "component").distinct().join(found, ["img_id", "component"], "left").select("img_id", "component", F.coalesce("area", F.lit(0.0)).alias("area"))


def component_probability(labelled: DataFrame, probs: DataFrame, p: str, group: list[str] | None = None) -> DataFrame:
    """A16. (group..., component, probability, area): mean of ``p`` over each component's pixels."""
    group = group or ["img_id"]
    px = pixels_in_runs(probs.select(*group, "y", "x", F.col(p).alias("_p")), labelled.select(*group, "component", "y", "x0", "x1"), group)
    return px.groupBy(*group, "component").agg((F.sum("_p") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("probability"), F.count(F.lit(1)).alias("area"))


def cluster_core_issues(gt_runs: DataFrame, pixels: DataFrame, least: int = 25) -> DataFrame:
    """A15. (img_id, issues): true components (8-connected, at least ``least`` pixels) with some class 2 predicted, but under 0.35, and over 0.4 class 1. pixels: img_id, y, x, pred."""
    lab = component_area_filter(connected_components(gt_runs, 8), least)
    size = pathology_pixels(lab, ["img_id", "component"])
    seen = pixels_in_runs(pixels.filter(F.col("pred").isin(1, 2)).select("img_id", "y", "x", "pred"), lab.select("img_id", "component", "y", "x0", "x1"), ["img_id"])
    counts = seen.groupBy("img_id", "component").agg(F.count_if(F.col("pred") == 2).alias("red"), F.count_if(F.col("pred") == 1).alias("normal"))
    bad = counts.join(size, ["img_id", "component"]).filter((F.col("red") > 0) & (F.col("red") / F.col("n") < 0.35) & (F.col("normal") / F.col("n") > 0.4))
    counts = bad.groupBy("img_id").agg(F.count(F.lit(1)).alias("issues"))
    return pixels.select("img_id").distinct().join(counts, "img_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)).cast("long"))


def pathology_pixels(runs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A24. (group..., n): pixels under the runs."""
    return runs.groupBy(*(group or ["img_id"])).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("n"))


def integral_image(pixels: DataFrame, value: Column) -> DataFrame:
    """W11. (img_id, y, x, s): sum of the value over all pixels up to and at (y, x)."""
    run = Window.unboundedPreceding
    rows = pixels.select("img_id", "y", "x", F.sum(value).over(Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(run, 0)).alias("_r"))
    return rows.select("img_id", "y", "x", F.sum("_r").over(Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(run, 0)).alias("s"))


def morph_gradient(pixels: DataFrame, value: str, k: int = 3, name: str = "edge") -> DataFrame:
    """W13. Dilation minus erosion over k x k, by rows, then by columns. Every pixel of the image must be there."""
    r = k // 2
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(-r, r)
    col = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(-r, r)
    d = pixels.withColumn("_hi", F.max(value).over(row)).withColumn("_lo", F.min(value).over(row))
    return d.withColumn(name, F.max("_hi").over(col) - F.min("_lo").over(col)).drop("_hi", "_lo")


def boundary_dice(pixels: DataFrame, classes: int = 3, k: int = 3) -> DataFrame:
    """A27. (cls, dice) of the boundaries of gt and pred, background left out; 1 without any boundary. pixels: img_id, y, x, gt, pred."""
    out = None
    for c in range(1, classes):
        d = pixels.withColumn("_g", (F.col("gt") == c).cast("int")).withColumn("_p", (F.col("pred") == c).cast("int"))
        d = morph_gradient(morph_gradient(d, "_g", k, "_eg"), "_p", k, "_ep")
        both, total = F.sum(F.col("_eg") * F.col("_ep")), F.sum(F.col("_eg") + F.col("_ep"))
        one = d.agg(F.when(total == 0, 1.0).otherwise(2 * both / total).alias("dice")).select(F.lit(c).alias("cls"), "dice")
        out = one if out is None else out.union(one)
    return out


def gaussian(n: int) -> list[float]:
    """Weights of n taps, sigma as imaging libraries choose it for a window of n."""
    s = 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((k - n // 2) ** 2) / (2 * s * s)) for k in range(n)]
    return [v / sum(w) for v in w]


#: Side of the blocks in which `adaptive_threshold` blurs.
BLUR_BLOCK = 128


def adaptive_threshold(pixels: DataFrame, value: str, size: int = 11, less: float = 2.0, name: str = "on") -> DataFrame:
    """W14. (img_id, y, x, value, name) of ``pixels``: name is 1 where the pixel is at most its Gaussian local mean less ``less``, else 0; the border is replicated.

    A pixel is sent to the blocks whose rim it lies on, once for most; each block with its rim is blurred by
    rows, then by columns, in memory. Pixels of an image fill a rectangle.
    """
    r, w = size // 2, np.array(gaussian(size))
    kinds = dict(pixels.dtypes)
    # A block reaches r pixels beyond its own.
    near = lambda c: F.sequence(F.floor((F.col(c) - r) / BLUR_BLOCK), F.floor((F.col(c) + r) / BLUR_BLOCK))
    sent = pixels.select("img_id", "y", "x", F.col(value).cast("double").alias("_v"), F.explode(near("y")).alias("_by"), near("x").alias("_k")).withColumn("_bx", F.explode("_k")).drop("_k")
    blocks = sent.groupBy("img_id", "_by", "_bx").agg(*(F.collect_list(c).alias(a) for c, a in (("y", "_y"), ("x", "_x"), ("_v", "_v"))))

    def blur(m: np.ndarray) -> np.ndarray:
        wide = np.pad(m, ((0, 0), (r, r)), mode="edge")
        return sum(wide[:, k : k + m.shape[1]] * w[k] for k in range(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                y, x, v = (np.asarray(batch.column(c)[k].values) for c in ("_y", "_x", "_v"))
                by, bx = (batch.column(c)[k].as_py() * BLUR_BLOCK for c in ("_by", "_bx"))
                own = (y >= by) & (y < by + BLUR_BLOCK) & (x >= bx) & (x < bx + BLUR_BLOCK)
                if not own.any():
                    continue
                grid = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1))
                grid[y - y.min(), x - x.min()] = v
                # Beyond a rim that is not the image's border nothing of its own pixels is read.
                mean = blur(blur(grid).T).T[y - y.min(), x - x.min()]
                on = (v <= np.round(mean, 9) - less).astype(np.int32)
                image = batch.column("img_id").take(pa.array(np.full(int(own.sum()), k)))
                yield pa.RecordBatch.from_arrays([image, pa.array(y[own]), pa.array(x[own]), pa.array(v[own]), pa.array(on[own])], names=["img_id", "y", "x", "_v", name])

    out = blocks.mapInArrow(run, f"img_id {kinds['img_id']}, y {kinds['y']}, x {kinds['x']}, _v double, `{name}` int")
    return out.withColumn("_v", F.col("_v").cast(kinds[value])).withColumnRenamed("_v", value)


def tissue_grid(pixels: DataFrame, on: str, cell: int = 25, least: int = 225) -> DataFrame:
    """R33. (img_id, cy, cx, n): cells with more than ``least`` foreground pixels."""
    return pixels.groupBy("img_id", F.expr(f"y div {cell}").cast("int").alias("cy"), F.expr(f"x div {cell}").cast("int").alias("cx")).agg(F.sum(on).alias("n")).filter(F.col("n") > least)


def block_average(pixels: DataFrame, value: str, f: int) -> DataFrame:
    """R18. Mean over blocks of f x f pixels."""
    return pixels.groupBy("img_id", F.expr(f"y div {f}").cast("int").alias("y"), F.expr(f"x div {f}").cast("int").alias("x")).agg(F.avg(value).alias(value))


def tissue_fraction_filter(pixels: DataFrame, value: str, height: int, width: int, threshold: float = 220, least: float = 0.05, limit: int = 128) -> DataFrame:
    """L8. (img_id, share): images whose share of pixels darker than the threshold is at least ``least``; images above ``limit`` a side are averaged down first."""
    f = max(1, max(height, width) // limit)
    d = block_average(pixels, value, f) if f > 1 else pixels
    return d.groupBy("img_id").agg(F.avg((F.col(value) < threshold).cast("double")).alias("share")).filter(F.col("share") >= least)


def invalid_mask_values(pixels: DataFrame, value: str, allowed: tuple[int, ...] = (0, 127, 255), most: int = 200, seed: int = 42) -> DataFrame:
    """L10. (img_id, bad): the values outside ``allowed`` of each image that has some, among at most ``most`` images drawn by a hash."""
    drawn = sample_rows(pixels.select("img_id").distinct(), F.col("img_id"), most, seed)
    return pixels.join(drawn, "img_id", "left_semi").filter(~F.col(value).isin(*allowed)).groupBy("img_id").agg(F.array_sort(F.collect_set(value)).alias("bad"))


def resample_nearest(pixels: DataFrame, values: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """R15. Images of ``size`` at the size ``to``: the source index is the floor of the scaled one."""
    (h, w), (h2, w2) = size, to
    span = lambda n, m: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("to"), F.floor(i * F.lit(n / m)).cast("int").alias("at")))
    images = pixels.select("img_id").distinct()
    grid = images.withColumn("_i", F.explode(span(h, h2))).withColumn("_j", F.explode(span(w, w2))).select("img_id", F.col("_i.at").alias("y"), F.col("_j.at").alias("x"), F.col("_i.to").alias("_y"), F.col("_j.to").alias("_x"))
    return grid.join(pixels, ["img_id", "y", "x"]).select("img_id", F.col("_y").alias("y"), F.col("_x").alias("x"), *values)


def resample_bilinear(pixels: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """R16. The same with half-pixel centres, four taps and clamped edges.

    Each pixel names the pixels that take it, so none is joined; they are added up where an image's pixels are, or by one shuffle.
    """

    def takers(d: DataFrame, c: str, n: int, m: int) -> DataFrame:
        """Rows of ``d`` for each _to{c} of m that has a tap at c of n, with the tap's weight _w{c}."""
        # Source places up to one off, and all beyond an edge, which are clamped to it; one more on both sides, as the exact test follows.
        first = F.when(F.col(c) <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(c) - 0.5) * F.lit(m / n) - 0.5) - 1))
        last = F.when(F.col(c) >= n - 1, m - 1).otherwise(F.least(F.lit(m - 1), F.ceil((F.col(c) + 1.5) * F.lit(m / n) - 0.5) + 1))
        spread = d.filter((F.col(c) >= 0) & (F.col(c) < n)).withColumn(f"_to{c}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        at = (F.col(f"_to{c}") + 0.5) * F.lit(n / m) - 0.5
        clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
        low, high = clamp(F.floor(at)) == F.col(c), clamp(F.floor(at) + 1) == F.col(c)
        part = at - F.floor(at)
        return spread.filter(low | high).withColumn(f"_w{c}", F.when(low, 1 - part).otherwise(0.0) + F.when(high, part).otherwise(0.0))

    (h, w), (h2, w2) = size, to
    taken = takers(takers(pixels.select("img_id", "y", "x", value), "y", h, h2), "x", w, w2)
    return taken.groupBy("img_id", F.col("_toy").alias("y"), F.col("_tox").alias("x")).agg(F.sum(F.col(value) * (F.col("_wy") * F.col("_wx"))).alias(value))


def soft_stain_normalize(pixels: DataFrame, channels: list[str], seed: int = 42) -> DataFrame:
    """R39. Each channel stretched between its 2nd and 98th percentile in the image, clipped to 0..255 and blended with the original; the share 0.15 to 0.35 comes from a hash of the image; flat channels stay."""
    stats = pixels.groupBy("img_id").agg(*(F.percentile(c, F.lit([0.02, 0.98])).alias(f"_{c}") for c in channels))
    alpha = 0.15 + 0.2 * unit_interval(seed, F.col("img_id"))
    out = pixels.join(stats, "img_id")
    for c in channels:
        lo, hi = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        full = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(c) - lo) * 255 / (hi - lo)))
        out = out.withColumn(c, F.when(hi > lo, (1 - alpha) * F.col(c) + alpha * full).otherwise(F.col(c).cast("double")))
    return out.drop(*(f"_{c}" for c in channels))
