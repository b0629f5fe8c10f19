"""Toxicity: a linear classifier on character n-grams whose features carry naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS, BITS, FEATURES = (3, 4, 5), 22, 4096
GAP = "\0" * (max(ORDERS) - 1)
P32 = np.uint32(0x01000193)
MIX32 = np.uint32(0x9E3779B1)


@dataclass
class ToxicityModel:
    """bias, the buckets that have a weight, and weight times log-count ratio of each."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def _pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Lower-cased texts of consecutive rows, about ``most`` characters together; a null is an empty text."""
    a, held, n = 0, [], 0
    for i, t in enumerate(column.to_pylist()):
        t = (t or "").lower()
        if held and n + len(t) > most:
            yield a, held
            a, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield a, held


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at each character, and where each text begins. Gaps keep n-grams within one text."""
    c = np.frombuffer((GAP + GAP.join(texts) + GAP).encode("utf-32-le"), np.uint32)
    begin = np.cumsum([len(GAP)] + [len(t) + len(GAP) for t in texts])[:-1]
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * P32 + c[n - 1 :]
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            yield ((x * MIX32 + np.uint32(n)) * MIX32) >> np.uint32(32 - BITS), begin - (n - 1)


def _present(texts: list[str], index: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket or feature) pairs, each once. index: bucket -> feature, -1 for none."""
    pairs = []
    for bucket, begin in _grams(texts):
        if index is None:
            row = np.searchsorted(begin, np.arange(len(bucket)), side="right") - 1
            got, row = bucket.astype(np.int64), row
        else:
            f = index[bucket]
            hit = np.flatnonzero(f >= 0)
            got, row = f[hit].astype(np.int64), np.searchsorted(begin, hit, side="right") - 1
        ok = row >= 0
        pairs.append((row[ok] << BITS) | got[ok])
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each bucket, by class, for each partition."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(int)
        for a, texts in _pieces(batch.column("text")):
            row, bucket = _present(texts, None)
            of = y[a + row]
            for k in (0, 1):
                n[k] += np.bincount(bucket[of == k], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(n.sum(axis=0))
    for a in range(0, len(at), 100_000):
        own = at[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[0, own].astype(np.int64)), pa.array(n[1, own].astype(np.int64))], names=["bucket", "n0", "n1"])


def _table(buckets: np.ndarray) -> np.ndarray:
    index = np.full(1 << BITS, -1, np.int16)
    index[buckets] = np.arange(len(buckets), dtype=np.int16)
    return index


def _featurer(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _table(buckets)
        for batch in batches:
            y = batch.column("label")
            for a, texts in _pieces(batch.column("text")):
                row, f = _present(texts, index)
                cut = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([y.slice(a, len(texts)), pa.ListArray.from_arrays(pa.array(cut), pa.array(f.astype(np.int16)))], names=["label", "features"])

    return run


def logistic(y: np.ndarray, cut: np.ndarray, f: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """Weights on ratio-scaled features by accelerated gradient steps, each scaled by its feature's curvature."""
    row = np.repeat(np.arange(len(y)), np.diff(cut))
    x = ratio[f]
    n, d = len(y), len(ratio)
    base = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, bias, seen = np.zeros(d), float(np.log(base / (1 - base))), np.zeros(d)
    b_seen, most = bias, max(1.0, float(np.bincount(row, weights=np.abs(x), minlength=n).max(initial=0)))
    scale = np.bincount(f, weights=np.abs(x), minlength=d) / (4 * n) * most + penalty
    for k in range(steps):
        m = k / (k + 3)
        v, b = w + m * (w - seen), bias + m * (bias - b_seen)
        z = b + np.bincount(row, weights=v[f] * x, minlength=n)
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        seen, b_seen = w, bias
        w = v - (np.bincount(f, weights=e[row] * x, minlength=d) / n + penalty * v) / scale
        bias = b - e.mean() / (0.25 * (1 + most))
    return bias, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, penalty: float = 1e-5) -> ToxicityModel:
    """Fit on rows of ``docs(doc_id, text)`` that ``labels(doc_id, label)`` marks 0 or 1.

    About ``max_train_rows`` labelled rows are taken, by a hash of doc_id on both tables before they
    are joined; log-count ratios come from all of these, in one aggregation by bucket, and the
    FEATURES buckets with the greatest log-likelihood ratio get weights. Rows with a null label or
    doc_id teach nothing. Without rows of both classes the score is the share of label 1, or 0.5.
    """
    marked = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    n = marked.count()
    share = min(1.0, max_train_rows / max(n, 1))
    picked = F.pmod(F.xxhash64(F.lit(8), F.col("doc_id")), F.lit(1 << 30)) < int(share * (1 << 30))
    # The sample of labels has about max_train_rows rows of two numbers, whatever the tables' sizes.
    train = docs.filter(picked).select("doc_id", "text").join(F.broadcast(marked.filter(picked)), "doc_id").select("text", "label")
    sizes = dict(train.groupBy("label").count().collect())
    if len(sizes) < 2:
        share = 0.5 if not sizes else min(max(float(next(iter(sizes))), 0.02), 0.98)
        return ToxicityModel(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    n0, n1 = sizes[0], sizes[1]
    counts = train.mapInArrow(_counter, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1"), F.col("n0")
    expect = (a + b) / float(n0 + n1)
    gain = F.when(a > 0, a * F.log(a / (expect * n1))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (expect * n0))).otherwise(0.0)
    best = counts.filter(a + b >= 3).orderBy(F.desc(gain), "bucket").limit(FEATURES).select("bucket", "n0", "n1").toPandas()
    s1, s0 = (best.n1.to_numpy() + 1.0) / (n1 + 2), (best.n0.to_numpy() + 1.0) / (n0 + 2)
    ratio, buckets = np.log(s1 / s0), best.bucket.to_numpy().astype(np.int64)
    table = train.mapInArrow(_featurer(buckets), "label int, features array<short>").toArrow()
    lists = table.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cut = lists.offsets.to_numpy()
    f = lists.values.to_numpy()[cut[0] : cut[-1]].astype(np.int64)
    bias, w = logistic(table.column("label").to_numpy().astype(float), cut - cut[0], f, ratio, penalty)
    return ToxicityModel(float(bias), buckets, w * ratio)


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1 from the whole text. A null or empty text gets the bias alone.

    The model (at most FEATURES weights) is all that goes to the executors. Other columns pass through;
    a column named as ``out`` is replaced.
    """
    docs = docs.drop(out)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _table(model.buckets)
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for a, texts in _pieces(batch.column("text")):
                row, f = _present(texts, index)
                z[a : a + len(texts)] += np.bincount(row, weights=model.weights[f], minlength=len(texts)) if len(f) else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*names, out])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` double")
