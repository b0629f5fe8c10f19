"""Approximate nearest neighbours by counting collisions on single projections."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import stored

#: Lines that vectors are projected on; a vector is verified once it collides with the query on this share of them.
PROJECTIONS, COLLIDES = 128, 0.6
#: Windows stop where a vector as far as the k-th best would collide often enough, with this many deviations to spare.
SPARE = 1.0
#: First half width of windows, in median deviations of a projection, and the most that one round may widen it.
FIRST_WIDTH, STEEPEST = 0.25, 4.0
#: Vectors and queries that one task holds together.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 8192


def reach_of(share: float) -> float:
    """Half width, in distances of a vector from the query, at which it collides on this share of the lines."""
    return NormalDist().inv_cdf((1 + min(share, 0.9999)) / 2)


def sure_share(projections: int = PROJECTIONS, share: float = COLLIDES, spare: float = SPARE) -> float:
    """The least chance of colliding on one line at which ``share`` of the lines is reached with ``spare`` deviations."""
    p = np.linspace(share, 0.9999, 4000)
    enough = projections * p - spare * np.sqrt(projections * p * (1 - p)) >= np.ceil(share * projections)
    return float(p[np.argmax(enough)]) if enough.any() else 0.9999


class CollisionIndex:
    """One sorted array of projections for each line, over the vectors of a block.

    The lines are the axes of random rotations, so that the squares of a difference's projections on
    the lines of one rotation add up to its length exactly. The arrays lie end to end in one, each
    moved by a gap wider than any window, so that the windows of all lines are found by one search.
    """

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS):
        n, d = vectors.shape
        rng = np.random.default_rng(44)
        turns = [np.linalg.qr(rng.normal(size=(d, d)))[0] * np.sqrt(d) for _ in range(-(-projections // d))]
        self.vectors, self.lines = vectors, np.concatenate(turns, axis=1)[:, :projections]
        values = (vectors @ self.lines).T
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, axis=1)
        self.moved = np.arange(projections) * (2 * np.abs(values).max() + 1)
        self.values, self.order = (values + self.moved[:, None]).ravel(), order.ravel()
        self.first = np.arange(projections) * n
        self.spread = float(np.median(np.abs(values - np.median(values, axis=1, keepdims=True)))) or 1.0
        self.read = 0  # entries of the sorted arrays that windows have covered

    def search(self, query: np.ndarray, kth) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the verified vectors. ``kth(rows, distances)`` tells the distance of the k-th best so far.

        Each round reads what the wider windows add to both sides, counts collisions and verifies the
        vectors that have now collided often enough. The next width is that at which the vector that
        is k-th by collisions would be verified, going by its share of collisions so far; the last is
        that at which a vector as far as the k-th best distance is sure to be verified.
        """
        n, m = len(self.vectors), len(self.first)
        need, sure, likely = int(np.ceil(COLLIDES * m)), reach_of(sure_share(m)), reach_of(COLLIDES)
        at, width, best = query @ self.lines + self.moved, FIRST_WIDTH * self.spread, np.inf
        low = high = np.clip(np.searchsorted(self.values, at), self.first, self.first + n)
        hits, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, distances = np.zeros(0, np.int64), np.zeros(0)
        while True:
            a, b = np.split(np.searchsorted(self.values, np.concatenate([at - width, at + width])), 2)
            a, b = np.clip(a, self.first, low), np.clip(b, high, self.first + n)
            sides = zip(np.concatenate([a, high]).tolist(), np.concatenate([low, b]).tolist(), strict=True)
            if added := [self.order[x:y] for x, y in sides if y > x]:
                hits += np.bincount(np.concatenate(added), minlength=n)
            low, high = a, b
            new = np.flatnonzero((hits >= need) & ~seen)
            if len(new):
                seen[new] = True
                rows = np.concatenate([rows, new])
                distances = np.concatenate([distances, np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))])
                best = kth(rows, distances)
            covered = int((high - low).sum())
            if width >= sure * best or covered == n * m:
                self.read += covered
                return rows, distances
            wide = STEEPEST * width
            if best == np.inf or width < likely * best:
                share = np.partition(hits, max(n - 12, 0))[max(n - 12, 0)] / m
                wide = min(max(width / reach_of(share) * likely, 1.1 * width), wide) if share > 0 else wide
            width = min(wide, sure * best)


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest verified ids of the block for each query, an id of several vectors by its nearest. Of equal vectors only the k + 1 smallest ids can count, so the rest stay out."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    _, first, of = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel(), return_index=True, return_inverse=True)
    rank = pd.Series(of).groupby(of).cumcount().to_numpy()
    members = np.flatnonzero(rank <= k)
    members = members[np.argsort(of[members], kind="stable")]
    cut = np.searchsorted(of[members], np.arange(len(first) + 1))
    index = CollisionIndex(vectors[first])
    repeated = len(np.unique(ids)) < len(ids)
    simple = not repeated and len(members) == len(first)
    out = []

    def ranked(rows: np.ndarray, distances: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) behind the rows, nearest first, each id once."""
        held = np.concatenate([members[cut[r] : cut[r + 1]] for r in rows]) if len(rows) else np.zeros(0, int)
        name, score = ids[held], np.repeat(distances, cut[rows + 1] - cut[rows])
        name, score = name[name != own], score[name != own]
        best = np.lexsort((name, score))
        if repeated:
            best = best[np.sort(np.unique(name[best], return_index=True)[1])]
        return name[best], score[best]

    for q, own in zip(queries, query_ids, strict=True):

        def kth(rows: np.ndarray, distances: np.ndarray, own=own) -> float:
            if len(rows) <= k and simple:
                return np.inf
            if simple:  # the query itself may be among them
                return float(np.partition(distances, k)[k])
            scores = ranked(rows, distances, own)[1]
            return float(scores[k - 1]) if len(scores) >= k else np.inf

        rows, distances = index.search(q, kth)
        if len(rows) > k + 1 and not repeated:
            near = distances <= np.partition(distances, k)[k]
            rows, distances = rows[near], distances[near]
        name, score = ranked(rows, distances, own)
        out.append(pd.DataFrame({"query_id": own, "vec_id": name[:k], "score": score[:k]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows with an id and a vector of finite components that are not all zero, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").distinct().select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine).filter(F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries(vec_id, embedding)``, its own id left out.

    The distinct pairs of id and vector are dealt by a hash of both into blocks of about BLOCK_VECTORS, the queries into blocks of
    about BLOCK_QUERIES; each pair of blocks is one group of bounded size, which indexes its vectors,
    searches them and returns k rows a query. Score is the Euclidean distance in double precision;
    ties go to the smaller vec_id. Rows without an id, and vectors that are null, empty, zero or hold
    a null or non-finite component take no part; vectors meet only those of their own length. Repeated
    rows are one candidate. If a vec_id has several vectors, as a candidate or as a query, the least
    distance found of any of them is its score. With fewer than k candidates all are returned. Other columns
    are ignored.
    """
    base, asked = stored(usable(vectors), "vectors"), stored(usable(queries), "queries")
    # Collisions are counted where the sorted arrays are: as rows, they would be PROJECTIONS / 2 times vectors times queries.
    (n_vectors, v_ids), (n_queries, q_ids) = (x.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first() for x in (base, asked))
    blocks, groups = max(1, -(-n_vectors // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    left = base.withColumn("block", dealt(blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("part", dealt(groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left, right = (x.withColumn("dim", F.size("v")) for x in (left, right))

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy(), np.stack(ask["v"].to_numpy()), ask["vec_id"].to_numpy(), k)

    key = ["dim", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    if n_vectors > v_ids or n_queries > q_ids:
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
