"""Quality: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytewords as bw
from tessella.llm.storage import stored

FREQUENCIES, BINS = 64, 512
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:",
    "exclaim": b"!?", "bar": b"|", "symbol": b"#$%&*+=<>@^_~\\/", "bracket": b"()[]{}", "quote": b"\"'`-",
}
STATISTICS = [*CLASSES, "other_ascii", "beyond_ascii", "log_chars", "log_words", "mean_word", "distinct_words", "repeated_next", "commonest_word", "entropy", "mean_line", "distinct_lines", "capital_words"]
_OF = np.full(256, len(CLASSES), np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _OF[list(_v)] = _k
_OF[128:] = len(CLASSES) + 1
LINES = np.arange(256, dtype=np.uint8)
LINES[[0x0A, 0x0D]] = 0


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    counts = np.zeros((rows, 256))
    for r in range(rows):
        counts[r] = np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256)
    n = np.maximum(counts.sum(axis=1), 1)
    share = counts / n[:, None]
    out = np.zeros((rows, len(STATISTICS)))
    kinds = len(CLASSES) + 2
    for k in range(kinds):
        out[:, k] = np.log1p(100 * share[:, k == _OF].sum(axis=1))
    h, at = bw.words(data, offsets, bw.SPACED)
    lines, line_at = bw.words(data, offsets, LINES)
    words = np.diff(at)
    heads = np.flatnonzero((bw.SPACED[data] != 0) & np.concatenate([[True], bw.SPACED[data[:-1]] == 0])) if len(data) else np.zeros(0, int)
    capital = (data[heads] >= 0x41) & (data[heads] <= 0x5A)
    capitals = np.diff(np.concatenate([[0], np.cumsum(capital)])[np.searchsorted(heads, offsets)])
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    distinct, repeated, commonest, own_lines = (np.ones(rows) for _ in range(4))
    for r in range(rows):
        w = h[at[r] : at[r + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            distinct[r], commonest[r] = len(c) / len(w), c.max() / len(w)
            repeated[r] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
        x = lines[line_at[r] : line_at[r + 1]]
        own_lines[r] = len(np.unique(x)) / max(len(x), 1)
    out[:, kinds:] = np.stack([np.log1p(n), np.log1p(words), np.log1p(n / np.maximum(words, 1)), distinct, np.log1p(100 * repeated), np.log1p(100 * commonest), entropy, np.log1p(n / np.maximum(np.diff(line_at), 1)), own_lines, np.log1p(100 * capitals / np.maximum(words, 1))], axis=1)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): len(STATISTICS) numbers from each whole text; a null counts as an empty text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bw.chunks(batch.column("text")):
                s = _statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the Fourier features and the constant
    edges: np.ndarray  # raw scores at which the calibrated score is given
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(33)
        w = rng.normal(size=(len(STATISTICS), FREQUENCIES)) / np.sqrt(len(STATISTICS))
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w
        return np.concatenate([np.cos(z), np.sin(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.calibrated), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all partitions of ``part(stats, labels)``, an array of ``width`` numbers: partial sums in the tasks, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("stats")), batch.column("label").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    t = rows.select("stats", "label").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(width)
    out[t["at"].to_numpy()] = t["v"].to_numpy()
    return out


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling neighbours that violate the order."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / max(a[1] + b[1], 1e-12), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fit_quality(labelled: DataFrame, penalty: float = 1e-4) -> QualityModel:
    """Fit on all rows of ``labelled(stats, label)`` whose label is 0 or 1.

    Three passes of partition sums, none larger than the square of the number of features: moments of
    the statistics, normal equations of the Fourier features, and counts by BINS of the raw score for
    the isotonic fit. Without rows every score is 0.5.
    """
    rows, d, m = labelled.filter("label in (0, 1)"), len(STATISTICS), 2 * FREQUENCIES + 1
    s = _summed(rows, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]), 2 * d + 1)
    n = s[-1]
    if not n:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(m), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = s[:d] / n
    scale = np.sqrt(np.maximum(s[d : 2 * d] / n - mean**2, 0))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(m), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    e = _summed(rows, normal, m * m + m)
    model.weights = np.linalg.solve(e[: m * m].reshape(m, m) / n + penalty * np.eye(m), e[m * m :] / n)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])

    c = _summed(rows, binned, 2 * BINS)
    seen = np.flatnonzero(c[:BINS])
    model.edges = (seen + 0.5) / BINS * 2 - 0.5
    model.calibrated = isotonic(c[BINS + seen] / c[seen], c[seen])
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of ``stats(doc_id, stats)``."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("stats"))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row of ``docs(doc_id, text, ...)``.

    ``labels(doc_id, label)`` teaches where the column ``learn`` (of doc_id) holds. Null and empty
    texts are scored from their statistics like others; labels that are null, or whose doc_id is null
    or unknown, teach nothing; repeated rows are scored each. Other columns are ignored.
    """
    stats = stored(statistics(docs), "statistics")
    marked = labels.filter(learn).select("doc_id", F.col("label").cast("int").alias("label"))
    return score_quality(stats, fit_quality(stored(stats.join(marked, "doc_id").select("stats", "label"), "labelled")))
