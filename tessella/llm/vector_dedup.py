"""Near-duplicate embeddings by NN-descent: neighbour lists refined by joining the neighbours of neighbours.

Vectors travel as unit vectors of 16-bit floats: a cosine of two such is off by at most ROUNDING, so that a pair
is sure to be linked, sure not to be, or confirmed on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.near_dedup import components
from tessella.llm.storage import stored

#: Entries of a neighbour list, and the most that a list holding only links grows to before its component is closed in blocks.
NEIGHBOURS, MOST_NEIGHBOURS = 10, 40
#: Deals of the vectors by signs of random projections, for the first lists; vectors aimed at and held in a block.
DEALS, AIM, BLOCK = 8, 512, 1024
#: Entries of the arrays in which many small groups are multiplied together.
MATRIX = 1 << 22
#: Rounds of a descent at most; it stops once a smaller share of the list entries than this is new.
ROUNDS, SETTLED = 12, 0.02
#: Vectors that are compared with all others to measure recall; below TARGET the descent goes on with new deals, so often at most.
AUDITED, TARGET, DESCENTS = 256, 0.99, 3
#: Pivots that divide a component too large for one block, and members that one task places among them.
PIVOTS, PLACED = 64, 4096
#: What rounding to 16 bits can change of a cosine: 2^-11 for each side's relative error, and a little.
ROUNDING = 1.1e-3
#: What rounding can change of an angle in double precision.
ANGLE = 1e-6


def unit(matrix: np.ndarray) -> np.ndarray:
    m = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _halves(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float16).reshape(len(values), -1).astype(np.float32)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches; groups may span batches and are bounded."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        key = np.stack([t.column(c).to_numpy() for c in keys], axis=1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and (key[a] != last).any():
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.concat_tables(held)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs join parts that the earlier ones left apart."""
    root, keep = list(range(n)), np.zeros(len(x), bool)

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if (a := top(a)) != (b := top(b)):
            root[a], keep[k] = b, True
    return keep


FOUND = "kind byte, a long, b long, sim float"


def _best(nodes: np.ndarray, sims: np.ndarray, allowed: np.ndarray, floors: np.ndarray, k: int, bar: float) -> pa.RecordBatch:
    """From all pairs of a block: kind 0, what may enter a node's list; 1, sure links that span the linked parts; 2, pairs to confirm that could join two of these."""
    n = len(nodes)
    upper = np.triu(np.ones((n, n), bool), 1) & allowed
    x, y = np.nonzero(upper & (sims >= bar + ROUNDING))
    span = _forest(n, x, y)
    sx, sy = x[span], y[span]
    ux, uy = np.nonzero(upper & (np.abs(sims - bar) < ROUNDING))
    if len(ux):
        part = np.arange(n)
        for a, b in zip(sx.tolist(), sy.tolist(), strict=True):
            part[part == part[a]] = part[b]
        apart = part[ux] != part[uy]
        ux, uy = ux[apart], uy[apart]
    open_ = np.where(allowed & (sims > floors[:, None]), sims, -np.inf)
    top = np.argpartition(-open_, min(k, n - 1), axis=1)[:, :k] if n > k else np.tile(np.arange(n), (n, 1))
    row = np.repeat(np.arange(n), top.shape[1])
    col = top.ravel()
    good = np.isfinite(open_[row, col])
    row, col = row[good], col[good]
    a, b = np.concatenate([row, sx, ux]), np.concatenate([col, sy, uy])
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(row), len(sx), len(ux)])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(nodes[a]), pa.array(nodes[b]), pa.array(sims[a, b].astype(np.float32))], names=["kind", "a", "b", "sim"])


def _block_lists(bar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["family", "deal", "bucket", "chunk"]):
            if t.num_rows > 1:
                m = _halves(t.column("half").to_pylist())
                yield _best(t.column("node").to_numpy(), m @ m.T, ~np.eye(len(m), dtype=bool), np.full(len(m), -2.0), NEIGHBOURS, bar)

    return run


def _batched(nodes: np.ndarray, m: np.ndarray, new: np.ndarray, floors: np.ndarray, k: np.ndarray, cut: np.ndarray, bar: float) -> Iterator[pa.RecordBatch]:
    """``_best`` of many small groups in one product: their rows between the cuts, padded to the largest."""
    size = np.diff(cut)
    width = int(size.max())
    at = np.minimum(cut[:-1, None] + np.arange(width), len(nodes) - 1)
    there = np.arange(width) < size[:, None]
    v = np.where(there[:, :, None], m[at], 0)
    sims = v @ v.transpose(0, 2, 1)
    fresh = new[at] & there
    allowed = (fresh[:, :, None] | fresh[:, None, :]) & there[:, :, None] & there[:, None, :]
    allowed[:, np.arange(width), np.arange(width)] = False
    # The rows of groups with links or doubtful pairs go on one by one, the others' best in one sort.
    linked = (allowed & (sims >= bar - ROUNDING)).any(axis=(1, 2))
    for g in np.flatnonzero(linked):
        own, n = slice(cut[g], cut[g + 1]), size[g]
        yield _best(nodes[own], sims[g, :n, :n], allowed[g, :n, :n], floors[own], int(k[own].max()), bar)
    rest = np.flatnonzero(~linked)
    if not len(rest):
        return
    open_ = np.where(allowed[rest] & (sims[rest] > floors[at[rest]][:, :, None]), sims[rest], -np.inf)
    most = int(k.max())
    if width > most:
        col = np.argpartition(-open_, most, axis=2)[:, :, :most]
        open_ = np.take_along_axis(open_, col, axis=2)
    else:
        col = np.broadcast_to(np.arange(width), open_.shape)
    g, r, c = np.nonzero(np.isfinite(open_))
    a, b = nodes[at[rest[g], r]], nodes[at[rest[g], col[g, r, c]]]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int8)), pa.array(a), pa.array(b), pa.array(open_[g, r, c].astype(np.float32))], names=["kind", "a", "b", "sim"])


def _local_join(bar: float):
    """Of the members of each list, forward and backward, the pairs of which one is new. Rows come sorted by list and member."""

    def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at, member = t.column("at").to_numpy(), t.column("member").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (member[1:] != member[:-1])]))
        new = np.logical_or.reduceat(t.column("new").to_numpy(), first)
        t, at, nodes = t.take(pa.array(first)), at[first], member[first]
        floors, k = t.column("floor").to_numpy(), t.column("k").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        size = np.diff(cut)
        some = np.logical_or.reduceat(new, cut[:-1]) & (size > 1)
        dims = pc.binary_length(t.column("half")).to_numpy()
        # Groups of about one size and one length of vector are multiplied together.
        order = np.flatnonzero(some)
        order = order[np.lexsort((size[order], dims[cut[:-1]][order]))]
        x = 0
        while x < len(order):
            g = order[x]
            limit = max(size[g] * 5 // 4, size[g] + 4)
            y = x + 1
            while y < len(order) and size[order[y]] <= limit and dims[cut[order[y]]] == dims[cut[g]] and (y - x + 1) * limit * (limit + 64) <= MATRIX:
                y += 1
            rows = np.concatenate([np.arange(cut[h], cut[h + 1]) for h in order[x:y]])
            m = _halves(t.column("half").take(pa.array(rows)).to_pylist())
            if y - x == 1 and size[g] > BLOCK:
                # A node that very many lists name: its members meet a bounded matrix at a time.
                for i in range(0, len(rows), BLOCK):
                    for j in range(i, len(rows), BLOCK):
                        two = np.arange(i, min(i + BLOCK, len(rows))) if i == j else np.concatenate([np.arange(i, min(i + BLOCK, len(rows))), np.arange(j, min(j + BLOCK, len(rows)))])
                        own = rows[two]
                        allowed = (new[own][:, None] | new[own][None, :]) & ~np.eye(len(own), dtype=bool)
                        yield _best(nodes[own], m[two] @ m[two].T, allowed, floors[own], int(k[own].max()), bar)
            else:
                yield from _batched(nodes[rows], m, new[rows], floors[rows], k[rows], np.concatenate([[0], np.cumsum(size[order[x:y]])]), bar)
            x = y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            at = t.column("at").to_numpy()
            last = int(np.searchsorted(at, at[-1]))  # the last list may go on in the next batch
            if last == 0 and held and held[-1].column("at")[-1].as_py() == at[0]:
                held.append(t)
                continue
            if held or last:
                yield from joined(pa.concat_tables([*held, t.slice(0, last)]))
            held = [t.slice(last)]
        if held:
            yield from joined(pa.concat_tables(held))

    return run


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vectors in 16 bits, and 31 signs of projections for each deal of any descent."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        half, signs = [b""] * len(dims), np.zeros((len(dims), DEALS * DESCENTS), np.int64)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            m = unit(_matrix(batch.column("embedding").take(pa.array(at))))
            if d not in planes:
                planes[d] = np.random.default_rng(d).normal(size=(d, 31 * DEALS * DESCENTS))
            bits = ((m @ planes[d]) > 0).reshape(len(at), DEALS * DESCENTS, 31)
            signs[at] = (bits * (1 << np.arange(31))).sum(axis=2)
            for k, h in zip(at.tolist(), m.astype(np.float16), strict=True):
                half[k] = h.tobytes()
        own = batch.drop_columns(["embedding"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signs.size + 1, signs.shape[1], dtype=np.int32)), pa.array(signs.ravel()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(half, pa.binary()), lists], names=[*own.schema.names, "half", "signs"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose cosine, in double precision on the original vectors, reaches the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.transform("embedding", lambda c: c.cast("double")).alias(f"v_{x}"))

    @F.pandas_udf("double")
    def cosine(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([float(_cosines(np.array([x]), np.array([y]))[0, 0]) for x, y in zip(p, q, strict=True)], dtype=float)

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(cosine("v_a", "v_b") >= threshold).select("a", "b")


def _cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return unit(p) @ unit(q).T


def _first_lists(nodes: DataFrame, descent: int, bar: float) -> DataFrame:
    """What blocks of vectors with equal signs find, for each deal; a block too large (copies share all signs) is dealt on by a hash."""
    sizes = nodes.groupBy("family").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / AIM))).cast("int").alias("bits"))
    signs = F.slice("signs", descent * DEALS + 1, DEALS)
    dealt = nodes.join(sizes, "family").select("node", "family", "half", "bits", F.posexplode(signs).alias("deal", "sign"))
    dealt = dealt.withColumn("bucket", F.expr("sign & (shiftleft(1L, bits) - 1)"))
    full = dealt.groupBy("family", "deal", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    dealt = dealt.join(full, ["family", "deal", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("node", "deal"), "chunks")).select("node", "family", "deal", "bucket", "chunk", "half")
    keys = ["family", "deal", "bucket", "chunk"]
    return stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_lists(bar), FOUND), "first-lists")


def _merged(entries: DataFrame, nodes: DataFrame, bar: float) -> DataFrame:
    """The state (node, half, k, floor, list) from ``entries(a, b, sim, new, k)``: the k nearest, k doubled where all of them are links."""
    best = entries.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("k").alias("k"))
    lists = best.groupBy("a").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "b", "new"))).alias("list"))
    kth = lambda k: -F.try_element_at("list", k)["far"]
    grown = F.when(F.coalesce(kth(F.col("k")) >= bar, F.lit(False)), F.least(F.col("k") * 2, F.lit(MOST_NEIGHBOURS))).otherwise(F.col("k"))
    lists = lists.withColumn("k", grown.cast("int")).withColumn("list", F.slice("list", F.lit(1), F.col("k")))
    floor = F.coalesce(kth(F.col("k")), F.lit(-2.0)).cast("float")
    return stored(lists.withColumn("floor", floor).join(nodes.select(F.col("node").alias("a"), "half"), "a").withColumnRenamed("a", "node"), "lists")


def _descended(nodes: DataFrame, state: DataFrame | None, descent: int, bar: float) -> tuple[DataFrame, list[DataFrame]]:
    """(state, what was found in each round) of one descent: new deals, then joins until the lists settle."""
    found = [_first_lists(nodes, descent, bar)]
    fresh = lambda f: f.filter("kind = 0").select("a", "b", "sim", F.lit(True).alias("new"), F.lit(NEIGHBOURS).alias("k"))
    held = lambda s: s.select(F.col("node").alias("a"), F.explode("list").alias("e"), "k").select("a", "e.b", (-F.col("e.far")).alias("sim"), F.lit(False).alias("new"), "k")
    entries = fresh(found[0])
    for _ in range(ROUNDS):
        state = _merged(entries if state is None else entries.union(held(state)), nodes, bar)
        total, new = state.select(F.sum(F.size("list")), F.sum(F.size(F.filter("list", lambda e: e["new"])))).first()
        if not total or new < SETTLED * total:
            break
        edges = state.select(F.col("node").alias("a"), F.explode("list").alias("e")).select("a", "e.b", "e.new")
        both = edges.select(F.col("a").alias("at"), F.col("b").alias("member"), "new").union(edges.select(F.col("b").alias("at"), F.col("a").alias("member"), "new"))
        sent = both.join(state.select(F.col("node").alias("member"), "half", "floor", "k"), "member")
        found.append(stored(sent.repartition("at").sortWithinPartitions("at", "member").select("at", "member", "new", "half", "floor", "k").mapInArrow(_local_join(bar), FOUND), "joined"))
        entries = fresh(found[-1])
    return state, found


def _audited(nodes: DataFrame, labels: DataFrame, threshold: float) -> tuple[DataFrame, int, int]:
    """(links that were missed, links seen, links missed) of AUDITED vectors against all. What the driver holds is bounded by AUDITED."""
    asked = nodes.orderBy(F.xxhash64("vec_id", "family"), "node").limit(AUDITED).join(labels, "node", "left").select("node", "family", "embedding", F.coalesce("component", "node").alias("component")).collect()
    by_family: dict[int, list] = {}
    for r in asked:
        by_family.setdefault(r.family, []).append(r)
    told = {f: (np.array([r.node for r in rs]), np.array([r.component for r in rs]), np.array([r.embedding for r in rs], float)) for f, rs in by_family.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, node, own = (batch.column(c).to_numpy() for c in ("family", "node", "component"))
            for f, (asked_nodes, asked_own, m) in told.items():
                at = np.flatnonzero(family == f)
                if not len(at):
                    continue
                x, y = np.nonzero(_cosines(_matrix(batch.column("embedding").take(pa.array(at))), m) >= threshold)
                x, y = at[x][node[at[x]] != asked_nodes[y]], y[node[at[x]] != asked_nodes[y]]
                apart = own[x] != asked_own[y]
                seen, missed = np.int64(len(x)), np.int64(apart.sum())
                # One pair of each two components that a link joins is enough.
                x, y = x[apart], y[apart]
                once = np.unique(np.stack([own[x], asked_own[y]], axis=1), axis=0, return_index=True)[1] if len(x) else np.zeros(0, int)
                a, b = np.append(node[x[once]], -1), np.append(asked_nodes[y[once]], -1)
                zero = np.zeros(len(once), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.append(zero, seen)), pa.array(np.append(zero, missed))], names=["a", "b", "seen", "missed"])

    rows = nodes.join(labels, "node", "left").select("node", "family", "embedding", F.coalesce("component", "node").alias("component"))
    seen = stored(rows.mapInArrow(run, "a long, b long, seen long, missed long"), "audit")
    n, missed = seen.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0))).first()
    return seen.filter("a >= 0").select("a", "b"), n, missed


def _count_block(rows: pd.DataFrame, others: pd.DataFrame | None, threshold: float) -> np.ndarray:
    """Weight of the vectors of ``others`` that each of ``rows`` is linked with; None: of its own block, without itself."""
    m = np.array(rows["embedding"].tolist(), float)
    linked = _cosines(m, m if others is None else np.array(others["embedding"].tolist(), float)) >= threshold
    if others is None:
        np.fill_diagonal(linked, False)
    return linked @ (rows if others is None else others)["weight"].to_numpy()


def _small(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["component"]):
            m, weight = _matrix(t.column("embedding")), t.column("weight").to_numpy()
            linked = _cosines(m, m) >= threshold
            np.fill_diagonal(linked, False)
            yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(linked @ weight)], names=["node", "links"])

    return run


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): the weight of the members of its component that each of ``members(node, component, size, weight, embedding)`` is linked with.

    A component of up to BLOCK members is one block. A larger one is divided among up to PIVOTS of its members;
    cells so near each other that all their pairs are linked (one tight clump is a single such cell) are counted by
    their weights, cells too far apart not at all, and only the others are compared, in blocks.
    """
    small = members.filter(F.col("size") <= BLOCK).select("component", "node", "weight", "embedding").repartition("component").sortWithinPartitions("component")
    out = small.mapInArrow(_small(threshold), "node long, links long")
    large = members.filter(F.col("size") > BLOCK)
    if not large.limit(1).count():
        return out
    theta = math.acos(threshold)
    kind = dict(members.dtypes)["embedding"]
    luck = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    chunks = F.ceil(F.col("size") / PLACED).cast("int")
    large = stored(large.withColumn("chunk", F.pmod(F.hash("node"), chunks).cast("int")), "large")
    # About half of PIVOTS by luck; luck cannot double it but once in many thousand components, and any number is right.
    pivots = large.filter((luck < PIVOTS / 2 / F.col("size")) | (F.col("node") == F.col("component")))
    pivots = stored(pivots.select("component", F.col("node").alias("cell"), "embedding", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")), "pivots")

    def place(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        angle = np.arccos(np.clip(_cosines(np.array(rows["embedding"].tolist(), float), np.array(cells["embedding"].tolist(), float)), -1, 1))
        best = angle.argmin(axis=1)
        return rows.assign(cell=cells["cell"].to_numpy()[best], radius=angle[np.arange(len(rows)), best])[["component", "node", "weight", "embedding", "cell", "radius"]]

    key = ["component", "chunk"]
    placed = stored(large.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(place, f"component long, node long, weight long, embedding {kind}, cell long, radius double"), "placed")
    cells = placed.groupBy("component", "cell").agg(F.max("radius").alias("radius"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    cells = stored(cells.join(pivots.filter("chunk = 0").select("component", "cell", "embedding"), ["component", "cell"]), "cells")

    def judge(c: pd.DataFrame) -> pd.DataFrame:
        m, r = np.array(c["embedding"].tolist(), float), c["radius"].to_numpy()
        gap, reach = np.arccos(np.clip(_cosines(m, m), -1, 1)), r[:, None] + r[None, :]
        np.fill_diagonal(gap, 0.0)
        sure, never = gap + reach <= theta - ANGLE, gap - reach > theta + ANGLE
        x, y = np.nonzero(~never)
        name, n, w = c["cell"].to_numpy(), c["n"].to_numpy(), c["weight"].to_numpy()
        return pd.DataFrame({"component": c["component"].iloc[0], "cell": name[x], "other": name[y], "n": n[x], "n_other": n[y], "sure": sure[x, y], "all": w[y]})

    pairs = stored(cells.groupBy("component").applyInPandas(judge, "component long, cell long, other long, n long, n_other long, sure boolean, all long"), "cell-pairs")
    sure = pairs.filter("sure").groupBy("component", "cell").agg(F.sum("all").alias("all"), F.max(F.col("cell") == F.col("other")).alias("own"))
    counted = placed.join(sure, ["component", "cell"]).select("node", (F.col("all") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links"))
    # Cells that are neither: blocks of each meet, one pair of blocks a group.
    unsure = pairs.filter("not sure and cell <= other").withColumn("i", F.explode(F.expr(f"sequence(0, cast(ceil(n / {BLOCK}) as int) - 1)"))).withColumn("j", F.explode(F.expr(f"sequence(0, cast(ceil(n_other / {BLOCK}) as int) - 1)"))).filter("cell < other or i <= j").select("component", "cell", "i", "other", "j", "n", "n_other")
    unsure = stored(unsure, "block-pairs")
    blocked = lambda c, b, n: placed.select("component", F.col("cell").alias(c), "node", "weight", "embedding").join(unsure, ["component", c]).filter(F.pmod(F.hash("node"), F.ceil(F.col(n) / BLOCK)) == F.col(b))
    key = ["component", "cell", "i", "other", "j"]

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"node": [], "links": []})
        if (p["cell"].iloc[0], p["i"].iloc[0]) == (p["other"].iloc[0], p["j"].iloc[0]):
            return pd.DataFrame({"node": p["node"], "links": _count_block(p, None, threshold)})
        there, back = _count_block(p, q, threshold), _count_block(q, p, threshold)
        return pd.DataFrame({"node": np.concatenate([p["node"], q["node"]]), "links": np.concatenate([there, back])})

    left, right = blocked("cell", "i", "n"), blocked("other", "j", "n_other")
    right = right.toDF(*right.columns)  # columns of its own, for both sides read the same tables
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "node long, links long")
    return out.union(counted.union(met).groupBy("node").agg(F.sum("links").alias("links")))


def _plain(vectors: DataFrame) -> Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return some & fine & F.exists("embedding", lambda x: x != 0)


def vector_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept, audit_recall.

    Vectors of one label and length are linked if their cosine in double precision reaches ``threshold``.
    Equal vectors of a label are one node with a weight. Deals by signs of random projections give every node a first list of
    its nearest; each round joins the neighbours of every list, both ways, keeps the nearest, and doubles lists
    that hold links only; it ends when lists settle. All links seen on the way, in lists or not, join components. A
    list that stays full of links is widened to its whole component: there all links are counted, exactly. Then AUDITED vectors
    are compared with all; what was missed is added, and below TARGET the descent goes on with new deals. ``audit_recall`` is the share found at the last audit, before what it added.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label or a vec_id,
    are linked with nothing and kept. Repeated rows are one vector and are each returned; a vec_id with several vectors links as
    any of them does. Ties at the threshold are links. An empty table gives an empty one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    usable = rows.filter(_plain(rows)).distinct()
    merged = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    family = F.xxhash64(F.col("label").cast("string"), F.size("embedding"))
    nodes = stored(merged.select(F.monotonically_increasing_id().alias("node"), family.alias("family"), F.size("embedding").alias("dim"), "label", "vec_id", "weight", "embedding"), "vectors")
    slim = stored(nodes.select("node", "family", "dim", "embedding").mapInArrow(_signs, "node long, family long, dim int, half binary, signs array<long>"), "halves")
    none = spark.createDataFrame([], "node long, component long")
    links, labels, state, recall = spark.createDataFrame([], "a long, b long"), none, None, 1.0
    for descent in range(DESCENTS):
        state, found = _descended(slim, state, descent, threshold)
        seen = reduce(DataFrame.union, found)
        sure = stored(links.union(seen.filter("kind = 1").select("a", "b")).distinct(), "links")
        links = stored(sure.union(_confirmed(seen.filter("kind = 2").select("a", "b").distinct(), nodes, threshold)), "links")
        labels = components(links) if links.limit(1).count() else none
        missing, audited, missed = _audited(nodes, labels, threshold)
        recall = 1 - missed / audited if audited else 1.0
        if missed:
            links = stored(links.union(missing), "links")
            labels = components(links)
        if recall >= TARGET:
            break
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = stored(labels.join(sizes, "component").join(nodes.select("node", "weight", "embedding"), "node"), "members")
    counts = _counted(members, threshold)
    least = labels.join(nodes.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_node = nodes.join(counts, "node", "left").join(labels, "node", "left").join(least, "component", "left")
    by_node = by_node.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    linked = rows.filter(_plain(rows)).join(by_node, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(_plain(rows), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(rest)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audit_recall"))
