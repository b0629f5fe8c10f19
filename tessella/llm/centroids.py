"""Clustering around centroids, in integers, over dictionaries of subvectors.

Vectors are packed into slabs, each one row. A slab is encoded without loss once: a block of dimensions is kept
whole if few of its subvectors are distinct (copies make them so) and otherwise halved, down to single
dimensions, whose integers repeat in any data. A round computes the distance of each distinct subvector to each
centroid once and sums these by code, so that a vector's distances are a few look-ups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessella.llm.storage import stored

#: Vectors of a slab, and the most of them, as a share, that may be distinct in a block that is kept whole.
SLAB, DISTINCT = 16384, 0.125
#: Integers are kept within this, so that every squared distance of up to 512 dimensions fits 64 bits.
MOST = 1 << 26
LONG_MAX = (1 << 63) - 1


def encoded(vectors: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first dimension, width, distinct subvectors, code of each vector) for each block of dimensions."""
    out, todo = [], [(0, vectors.shape[1])]
    while todo:
        at, width = todo.pop()
        part = np.ascontiguousarray(vectors[:, at : at + width])
        whole = part.ravel() if width == 1 else part.view(np.dtype((np.void, part.itemsize * width))).ravel()
        _, first, codes = np.unique(whole, return_index=True, return_inverse=True)
        if width > 1 and len(first) > max(1, DISTINCT * len(vectors)):
            todo += [(at + width // 2, width - width // 2), (at, width // 2)]
        else:
            out.append((at, width, part[first], codes.ravel().astype(np.uint16 if len(first) <= 65536 else np.uint32)))
    return out


def nearest_centroid(blocks: list[tuple[int, int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equally near ones the smaller number."""
    total = np.zeros((len(blocks[0][3]), len(centroids)), np.int64)
    for at, width, entries, codes in blocks:
        gap = entries[:, None, :] - centroids[None, :, at : at + width]
        total += (gap * gap).sum(axis=2)[codes]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def sums_by_centroid(blocks: list[tuple[int, int, np.ndarray, np.ndarray]], best: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, sum of each dimension) of each cluster: how often a code stands in a cluster times its subvector."""
    sums = np.zeros((k, dim), np.int64)
    for at, width, entries, codes in blocks:
        often = np.bincount(best * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
        sums[:, at : at + width] = often @ entries
    return np.bincount(best, minlength=k), sums


def integer_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x): rows with exactly ``dim`` components, none null or non-finite, as floor(1024 * component), within +-MOST."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = float(MOST)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * 1024, F.lit(most)), F.lit(-most))).cast("long"))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == dim) & fine).select("vec_id", x.alias("x"))


def _packer(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        kinds = pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("codes", pa.binary()), ("wide", pa.int32())])

        def slab() -> pa.RecordBatch:
            told = [{"first": a, "width": w, "entries": e.tobytes(), "codes": c.tobytes(), "wide": c.itemsize} for a, w, e, c in encoded(np.concatenate(parts))]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.concat_arrays(ids)), pa.array([told], pa.list_(kinds))], names=["ids", "blocks"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(batch.num_rows - at, SLAB - held)
                part = batch.slice(at, n)
                ids.append(part.column("vec_id"))
                parts.append(np.asarray(part.column("x").flatten()).reshape(n, dim).astype(np.int64))
                held, at = held + n, at + n
                if held == SLAB:
                    yield slab()
                    ids, parts, held = [], [], 0
        if held:
            yield slab()

    return run


def _opened(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    blocks = [
        (b["first"], b["width"], np.frombuffer(b["entries"], np.int64).reshape(-1, b["width"]), np.frombuffer(b["codes"], np.uint16 if b["wide"] == 2 else np.uint32).astype(np.int64))
        for b in batch.column("blocks")[k].as_py()
    ]
    return batch.column("ids")[k].values, blocks


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> DataFrame:
    """One row per kept vector of ``vectors(vec_id, embedding)``: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array) and centroid_sha256.

    Components become floor(1024 * x). The first centroids are the k vectors with the smallest sha256 of
    ``seed:vec_id``; each round assigns every vector to its nearest centroid (ties: smaller number) and
    replaces every centroid that has vectors by their exact floor(sum / count). All sums are of integers, so the
    result does not depend on how the rows lie. Slabs are written once; a round reads them and returns k sums of
    each slab, and only the k centroids pass through the driver.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Components
    beyond +-65536 count as that. Zero vectors take part. Repeated rows are vectors of their own; a null vec_id
    stands last among the first centroids' candidates, and equal hashes stand by their components. With fewer than k
    vectors there are as many centroids as vectors; an empty table gives an empty one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dim)
    kind = dict(vectors.dtypes)["vec_id"]
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(named.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    out_schema = f"vec_id {kind}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out_schema}, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    centroids = np.array([r.x for r in first], np.int64)
    slabs = stored(kept.mapInArrow(_packer(dim), f"ids array<{kind}>, blocks array<struct<first:int,width:int,entries:binary,codes:binary,wide:int>>"), "slabs")

    def summed(at: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    _, blocks = _opened(batch, r)
                    best, _ = nearest_centroid(blocks, at)
                    count, sums = sums_by_centroid(blocks, best, len(at), dim)
                    some = np.flatnonzero(count)
                    flat = pa.array(np.repeat(some, dim)), pa.array(np.tile(np.arange(dim), len(some))), pa.array(np.repeat(count[some], dim)), pa.array(sums[some].ravel())
                    yield pa.RecordBatch.from_arrays(list(flat), names=["cluster", "axis", "n", "total"])

        return run

    for _ in range(rounds):
        totals = slabs.mapInArrow(summed(centroids), "cluster long, axis long, n long, total long").groupBy("cluster", "axis")
        rows: list[Row] = totals.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        moved = centroids.copy()
        for r in rows:
            moved[r.cluster, r.axis] = int(r.total) // r.n
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, blocks = _opened(batch, r)
                best, distance = nearest_centroid(blocks, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = stored(slabs.mapInArrow(assigned, out_schema), "assigned")
    # k rows: the inertia of each cluster and of all, and what each centroid is.
    by_cluster = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [
        (c, min(s, LONG_MAX), min(sum(by_cluster.values()), LONG_MAX), centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sorted(by_cluster.items())
    ]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
