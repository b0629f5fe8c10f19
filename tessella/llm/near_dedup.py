"""Near-duplicate detection: MinHash bands find candidates, odd sketches sift them, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytewords as bw
from tessella.llm.storage import stored

ROWS, BANDS, SKETCH_LONGS = 6, 48, 8
SAMPLES = ROWS * BANDS
#: A candidate goes on to the full sets unless its sketch puts it this far under the threshold (about five deviations).
SLACK = 0.15
WIDTH = 64.0 * SKETCH_LONGS
#: Bands whose buckets are first linked to their smallest node; nodes of a bucket that one task compares.
STAR_BANDS, BLOCK = 8, 1024
#: Columns of a product of sets and items at a time; seconds of one entry of such a product, and of one item of a pair's search.
COLUMNS, PRODUCT, SEARCH = 4096, 3e-11, 2e-8
U = np.uint64
_rng = np.random.default_rng(2024)
_A = (_rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_POWER = bw.powers(bw.STEP, ROWS)[None, :]


def minhash(items: np.ndarray) -> np.ndarray:
    """Smallest image of the set under each of the maps, in pieces that fit the cache."""
    x = (items >> U(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(low, (x[None, a : a + 1024] * _A + _B).min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: each sample flips one bit. low: one row of samples for each set."""
    bit = bw.mix(low.astype(np.uint64) ^ _SALT) % U(64 * SKETCH_LONGS)
    out = np.zeros((len(low), SKETCH_LONGS), np.uint64)
    flip = U(1) << (bit % U(64))
    for k in range(SKETCH_LONGS):
        out[:, k] = np.bitwise_xor.reduce(np.where(bit // U(64) == U(k), flip, U(0)), axis=1)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = bw.mix(low.astype(np.uint64) ^ _SALT).reshape(len(low), BANDS, ROWS)
    return bw.mix((parts * _POWER[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * bw.MIX)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, data, offsets in bw.chunks(column):
        s, at = bw.shingles(*bw.words(data, offsets, bw.SPACED), size)
        yield a, [np.unique(s[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _node(items: np.ndarray) -> str:
    """128 bits that equal sets share, whatever the order of their texts."""
    again = bw.mix(items ^ bw.MIX)
    return f"{int(items.sum(dtype=np.uint64)):016x}{int(again.sum(dtype=np.uint64)):016x}"


def _longs(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), flat)


def _profiler(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for a, sets in _sets(batch.column("text"), size):
                low = np.stack([minhash(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), keys.slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.string()), _longs(odd_sketch(low)), _longs(band_keys(low))],
                    names=["doc_id", "text_key", "n_shingles", "node", "sketch", "bands"],
                )

    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), size):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.string()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))],
                    names=["node", "items"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a, b)`` reaches.

    Every round takes the least label among the neighbours and then the label's own label, which
    halves long chains; each round's labels are written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = stored(step.join(jump, "mid").select("node", F.least("mid", "far").alias("component"), (F.least("mid", "far") != F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if not new.filter("moved").limit(1).count():
            return labels


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, component) of the buckets that hold several components, with their own block and the pair of blocks (i, j) in which they meet.

    A bucket of up to BLOCK nodes is one block. In a larger one the nodes of its largest component need
    not meet each other: they are cut in blocks of their own, the rest in others, and only the rest's
    blocks meet all. So a large component is sent once for every BLOCK nodes outside of it.
    """
    counts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "component"))
    mixed = counts.groupBy("bucket").agg(most.alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = mixed.select("bucket", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("k_main"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("k_rest"), (F.col("size") <= BLOCK).alias("small"))
    rows = rows.join(mixed, "bucket")
    whole, place = F.col("k_main") + F.col("k_rest"), F.xxhash64("node")
    own = F.when(F.col("small"), 0).when(F.col("component") == F.col("main"), F.pmod(place, F.col("k_main"))).otherwise(F.col("k_main") + F.pmod(place, F.col("k_rest")))
    others = F.when(F.col("small"), F.array(F.lit(0))).when(F.col("component") == F.col("main"), F.sequence(F.col("k_main"), whole - 1)).otherwise(F.sequence(F.lit(0), whole - 1))
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(others))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("bucket", "band", "node", "component", "own", "i", "j")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which may span batches; a block is bounded."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            part = t.slice(a, b - a)
            if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in ("bucket", "i", "j")):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    return np.asarray(c.flatten()).view(np.uint64).reshape(len(t), -1)


def _likely(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y) of different components whose sizes and sketches allow a link and that meet in no earlier band, with the estimates."""
    comp = np.unique(t.column("component").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    n, band = t.column("n").to_numpy(), int(t.column("band")[0].as_py())
    own, across = t.column("own").to_numpy(), t.column("i")[0] != t.column("j")[0]
    sketch, bands = _matrix(t, "sketch"), _matrix(t, "bands")
    out = []
    for x in range(len(t) - 1):
        y = np.arange(x + 1, len(t))
        y = y[(comp[y] != comp[x]) & (not across or own[y] != own[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        if not len(y):
            continue
        odd = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        e = 1 + WIDTH / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * odd / WIDTH, 1e-9))
        ok = e >= percent / 100 - SLACK
        y, e = y[ok], e[ok]
        if band and len(y):
            ok = ~(bands[y, :band] == bands[x, :band]).any(axis=1)
            y, e = y[ok], e[ok]
        if len(y):
            out.append((np.full(len(y), x), y, e))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _sifter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x, y, _ = _likely(t, percent)
            if len(x):
                keep = np.unique(np.concatenate([x, y]))
                yield from t.take(pa.array(keep)).select(["bucket", "i", "j", "own", "node", "component", "band", "n", "sketch", "bands"]).combine_chunks().to_batches()

    return run


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many items the sets x[k] and y[k] share, for each k.

    Either pair by pair, or, where many pairs ask for it, all at once: an item that several sets of the block hold adds
    to all their intersections together, as a product of the matrix of sets and such items with itself.
    """
    used = np.unique(np.concatenate([x, y]))
    sizes = np.array([len(sets[k]) for k in used])
    of = np.repeat(np.arange(len(used)), sizes)
    items = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)[1]
    common = np.bincount(items) > 1
    keep = common[items]
    column, of = (np.cumsum(common) - 1)[items[keep]], of[keep]
    place = np.searchsorted(used, np.stack([x, y]))
    if len(used) ** 2 * int(common.sum()) * PRODUCT < sizes[place].sum() * SEARCH:
        both = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for first in range(0, int(common.sum()), COLUMNS):
            i, j = np.searchsorted(column, [first, first + COLUMNS])
            m = np.zeros((len(used), COLUMNS), np.float32)
            m[of[i:j], column[i:j] - first] = 1
            both += m @ m.T
        return np.rint(both[place[0], place[1]]).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for k, (p, q) in enumerate(zip(x, y, strict=True)):
        u, v = sets[p], sets[q]
        out[k] = (u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum()
    return out


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x, y, e = _likely(t, percent)
            if not len(x):
                continue
            items = [np.asarray(v.values).view(np.uint64) for v in t.column("items").combine_chunks()]
            size = np.array([len(v) for v in items])
            both = _shared(items, x, y)
            ok = both * 100 >= (size[x] + size[y] - both) * percent
            x, y, e = x[ok], y[ok], e[ok]
            names, comps = t.column("node").to_pylist(), t.column("component").to_pylist()
            root: dict[str, str] = {}

            def top(c: str, root: dict[str, str] = root) -> str:
                while (r := root.get(c, c)) != c:
                    c = r
                return c

            a, b = [], []
            for k in np.argsort(-e, kind="stable"):
                p, q = int(x[k]), int(y[k])
                if (cp := top(comps[p])) != (cq := top(comps[q])):
                    root[cq] = cp
                    a.append(names[p])
                    b.append(names[q])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity_percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept; and node, group, text_key.

    Two texts are linked if ``100 * |A and B| >= similarity_percent * |A or B|`` for their sets of
    distinct ``shingle_words``-word shingles; component_id is the smallest doc_id that can be reached.

    Equal sets are one node, so copies never meet in pairs. Buckets of the first bands link their nodes
    to their smallest node. Every bucket, of any band, that then still holds several components is
    compared in blocks of bounded size, its largest component with the rest only: odd sketches single out the nodes with a likely partner in
    another component, in the first band that the two share, and the full sets confirm. A block
    returns only links that join components, so no group's pairs are written out, and none is lost.

    Nulls and empty texts: an empty set, linked with nothing, each its own component, kept. A row
    without a doc_id belongs to its component and is kept only if no row of that component has an id.
    Repeated rows and ties: each row is returned. Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    profile = stored(base.mapInArrow(_profiler(shingle_words), f"doc_id {kind}, text_key long, n_shingles long, node string, sketch array<long>, bands array<long>"), "profile")
    nodes = profile.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("pick"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("node", F.col("pick.doc_id").alias("doc_id"), F.col("pick.text_key").alias("text_key"), "n", "sketch", "bands"), "nodes")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("far_end")).filter("centre != far_end").drop("far_end")
    members = stored(rows.join(full, "bucket"), "members")
    sketches = nodes.select("node", "n", "sketch", "doc_id", "text_key")

    def with_sets(wanted: DataFrame, name: str) -> DataFrame:
        """(node, items) of the wanted nodes, from one text of each."""
        keys = wanted.distinct().join(nodes.select("node", "doc_id", "text_key"), "node").select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
        texts = base.join(keys, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")), "left_semi").select("text")
        return stored(texts.mapInArrow(_setter(shingle_words), "node string, items array<long>").dropDuplicates(["node"]), f"sets-{name}")

    def linked(edges: DataFrame) -> DataFrame:
        return components(edges) if edges.limit(1).count() else spark.createDataFrame([], "node string, component string")

    # 1. Each node with the smallest node of its buckets in the first bands.
    star = members.filter((F.col("node") != F.col("centre")) & (F.col("band") < STAR_BANDS)).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    odd = sum((F.bit_count(F.col("s_a")[k].bitwiseXOR(F.col("s_b")[k])) for k in range(SKETCH_LONGS)), F.lit(0))
    estimate = 1 + WIDTH / (4 * SAMPLES) * F.log(F.greatest(1 - 2 * odd / WIDTH, F.lit(1e-9)))
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity_percent
    likely = stored(star.join(side("a"), "a").join(side("b"), "b").filter(sized & (estimate >= similarity_percent / 100 - SLACK)).select("a", "b", "n_a", "n_b"), "likely")
    sets = with_sets(likely.select(F.col("a").alias("node")).union(likely.select("b")), "star")
    both = F.size(F.array_intersect("i_a", "i_b"))
    sides = likely.join(sets.select(F.col("node").alias("a"), F.col("items").alias("i_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("i_b")), "b")
    first = stored(sides.filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * similarity_percent).select("a", "b"), "links")
    found = linked(first)

    # 2. In every bucket that still holds several components, the nodes with a likely partner in another, by sketches.
    placed = members.select("bucket", "band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = _in_blocks(placed).join(nodes.select("node", "n", "sketch", "bands"), "node")
    kept = stored(_by_block(apart).mapInArrow(_sifter(similarity_percent), "bucket long, i int, j int, own int, node string, component string, band int, n long, sketch array<long>, bands array<long>"), "sifted")

    # 3. Those, with their full sets: the links that join components.
    ready = kept.join(with_sets(kept.select("node"), "rest"), "node")
    second = stored(_by_block(ready).mapInArrow(_confirmer(similarity_percent), "a string, b string").distinct(), "links")
    if second.limit(1).count():
        found = linked(first.union(second))
    least_id = nodes.join(found, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = nodes.select("node", F.col("doc_id").alias("own")).join(found, "node", "left").join(least_id, "component", "left")
    by_node = by_node.select("node", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    out = profile.select("doc_id", "n_shingles", "node", "text_key").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "node", "group", "text_key")
