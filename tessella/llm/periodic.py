"""Periodic runs of words: blocks are convolved with what follows them, and what matches is extended to whole runs.

A run is a stretch of consecutive words with smallest period q, at least ``4 * q`` words and six in all,
that no neighbouring word extends. Runs are sought by dyadic scales: one whose period is from L to 2 L - 1
holds a block of L words that starts at a multiple of L, and that block returns, one period later, inside
the run. The squared differences of a block and the words after it, summed at every distance from L to
2 L - 1, are one convolution; number-theoretic transforms give them exactly, and a sum of zero is a return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import covered

#: Fewest words of a run, and fewest periods that it holds.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Scales below this are summed directly: a transform of so few words costs more.
FIRST_BLOCK = 8
#: Primes with 2^21 dividing p - 1, and a generator of each; as many are used as the sums need to be exact.
PRIMES = ((998244353, 3), (1004535809, 3), (469762049, 3))
#: Bytes of text whose documents are searched together, and words that one transform holds.
CHUNK_BYTES, CHUNK_WORDS = 4 << 20, 1 << 20


class Transform:
    """Transforms of ``size`` integers modulo one prime, over the last axis, by halves."""

    def __init__(self, size: int, prime: int, generator: int):
        self.size, self.prime = size, prime
        root = pow(generator, (prime - 1) // size, prime)
        powers = np.ones(max(size, 1), np.int64)
        step = 1
        while step < size:  # powers of the root by doubling
            powers[step : 2 * step] = powers[:step] * pow(root, step, prime) % prime
            step *= 2
        self.powers, self.back = powers, np.concatenate([powers[:1], powers[:0:-1]])
        self.scale = pow(size, -1, prime)

    def _run(self, x: np.ndarray, powers: np.ndarray) -> np.ndarray:
        # Every pass reads halves and writes pairs, so that the result stands in order without a reversal.
        rows, half = x.shape[0], self.size // 2
        x = x.reshape(rows, 1, self.size)
        blocks = 1
        while blocks < self.size:
            turn = powers[np.arange(blocks) * (half // blocks)][None, :, None]
            a, b = x[:, :, : half // blocks], x[:, :, half // blocks :] * turn % self.prime
            x = np.concatenate([a + b, a - b], axis=1) % self.prime
            blocks *= 2
        return x.reshape(rows, self.size)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._run(x % self.prime, self.powers)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._run(x, self.back) * self.scale % self.prime


def differences_are_zero(blocks: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """[row, d]: whether the squared differences of ``blocks`` (rows of L) and ``follow`` (rows of 2 L - 1 from the
    block's end on), d words further, sum to zero, for d from 0 to L - 1.

    The sum is ``sum b^2 + sum w^2 - 2 sum b w``; the last is the convolution of the block read backwards. Sums
    are below L times the square of the largest code, so they are zero if they are zero modulo primes whose product is larger.
    """
    rows, width = blocks.shape
    bound = width * (int(max(blocks.max(initial=0), follow.max(initial=0))) + 1) ** 2
    size = 1 << (3 * width - 2).bit_length()
    zero, product = np.ones((rows, width), bool), 1
    for prime, generator in PRIMES:
        t = Transform(size, prime, generator)
        a, b = np.zeros((rows, size), np.int64), np.zeros((rows, size), np.int64)
        a[:, :width], b[:, : 2 * width - 1] = blocks[:, ::-1], follow
        both = t.inverse(t.forward(a) * t.forward(b) % prime)[:, width - 1 : 2 * width - 1]
        square = follow * follow % prime
        upto = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(square, axis=1)], axis=1)
        total = (blocks * blocks % prime).sum(axis=1)[:, None] + upto[:, width : 2 * width] - upto[:, :width] - 2 * both
        zero &= total % prime == 0
        product *= prime
        if product > bound:
            break
    return zero


def _matched(codes: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """First and last-but-one word of the stretch around ``at`` in which words a period apart are equal, in low..high."""
    a, step = at, 64
    while a > low:
        x = max(low, a - step)
        bad = np.flatnonzero(codes[x:a] != codes[x + period : a + period])
        if len(bad):
            a = x + int(bad[-1]) + 1
            break
        a, step = x, 2 * step
    b, step = at, 64
    while b + period < high:
        y = min(high - period, b + step)
        bad = np.flatnonzero(codes[b:y] != codes[b + period : y + period])
        if len(bad):
            b += int(bad[0])
            break
        b, step = y, 2 * step
    return a, b + period


def _direct(codes: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Runs with periods below FIRST_BLOCK: each difference of the whole stretch at once."""
    for p in range(1, FIRST_BLOCK):
        need = max(LEAST_WORDS, LEAST_PERIODS * p) - p
        same = np.flatnonzero(codes[p:] == codes[:-p])
        if len(same) < need:
            continue
        cut = np.flatnonzero(np.diff(same) != 1) + 1
        first, last = same[np.concatenate([[0], cut])], same[np.concatenate([cut - 1, [len(same) - 1]])]
        for a, b in zip(first[last - first + 1 >= need].tolist(), last[last - first + 1 >= need].tolist(), strict=True):
            found.setdefault((a, b + 1 + p), p)  # a smaller period of the same stretch stands already


def find_runs(codes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, word after the last, period) of every run, in order. ``rows``: where each document's words begin in ``codes``, and the end.

    Codes of different documents must differ. A block can only return at less than 2 L words if each of
    its words does, so others need no convolution. Nor does a block that lies, with the window after it, in
    a known run of a period up to L: a second period there would make both multiples of a smaller one.
    """
    found: dict[tuple[int, int], int] = {}
    if len(codes) < LEAST_WORDS:
        return []
    _direct(codes, found)
    order = np.argsort(codes, kind="stable")
    again = np.full(len(codes), len(codes) + 1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    sizes, width = np.diff(rows), FIRST_BLOCK
    while (long := np.flatnonzero(sizes >= LEAST_PERIODS * width)).size:
        counts = sizes[long] // width
        doc = np.repeat(long, counts)
        start = rows[doc] + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * width
        # A block that ends a document's whole blocks would run into the rest: ends are cut in between.
        ends = np.empty(2 * len(start), np.int64)
        ends[::2], ends[1::2] = start, start + width
        if ends[-1] == len(codes):
            ends = ends[:-1]
        widest = np.maximum.reduceat(again, ends)[::2]
        fine = (widest < 2 * width) & (start + 2 * width <= rows[doc + 1])
        start, doc = start[fine], doc[fine]
        if found and len(start):
            known = np.array([(a, b) for (a, b), q in found.items() if q <= width], np.int64).reshape(-1, 2)
            known = known[np.argsort(known[:, 0], kind="stable")]
            reach = np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]
            k = np.searchsorted(known[:, 0], start, side="right") - 1
            # Of the runs that begin at or before the block the furthest end counts, be it of another run.
            inside = (k >= 0) & (reach[np.maximum(k, 0)] >= np.minimum(start + 3 * width, rows[doc + 1])) if len(known) else np.zeros(len(start), bool)
            start, doc = start[~inside], doc[~inside]
        per = max(1, CHUNK_WORDS // (4 * width))
        for x in range(0, len(start), per):
            s, d = start[x : x + per], doc[x : x + per]
            base = rows[d]
            at = s[:, None] + width + np.arange(2 * width - 1)[None, :]
            out = at >= rows[d + 1][:, None]
            # Codes count from 1 in each document; a place after its end differs from every word.
            low = np.minimum.reduceat(codes, rows[:-1][sizes > 0])[np.searchsorted(rows[:-1][sizes > 0], base)]
            blocks = codes[s[:, None] + np.arange(width)[None, :]] - low[:, None] + 1
            follow = np.where(out, 0, codes[np.minimum(at, len(codes) - 1)] - low[:, None] + 1)
            for r, e in zip(*np.nonzero(differences_are_zero(blocks, follow)), strict=True):
                p = width + int(e)
                a, b = _matched(codes, int(s[r]), p, int(rows[d[r]]), int(rows[d[r] + 1]))
                if b - a >= LEAST_PERIODS * p:
                    found.setdefault((a, b), p)
        width *= 2
    return sorted((a, b, q) for (a, b), q in found.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), bool)
    for a, n, q in runs:
        keep[a + q : a + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _searched(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, text without repeats) of each text."""
    split, codes, rows, at = [], [], [0], 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()  # white space of ASCII only, as the word rule says
        known: dict[bytes, int] = {}
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + at)
        at += len(known)
        split.append(words)
        rows.append(rows[-1] + len(words))
    rows = np.array(rows, np.int64)
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(np.concatenate(codes), rows) if codes else []
    for a, b, q in runs:
        k = int(np.searchsorted(rows, a, side="right")) - 1
        own[k].append((a - int(rows[k]), b - a, q))
    for words, found in zip(split, own, strict=True):
        yield len(words), found, _collapsed(words, found) if found else b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, by start and period) and collapsed.

    Words are separated by ASCII white space and numbered from 0. ``collapsed`` has the words, joined by one
    space, that no run contains after that run's first period. Each row is searched where it lies: nothing is
    shuffled, and a task holds the documents of about CHUNK_BYTES of text, or one longer document.

    Null and empty texts have no words and no runs, and collapse to an empty text. Repeated rows are searched each,
    with equal results; equal stretches of several periods are one run, of the smallest. Texts of any length
    are searched whole. An empty table gives an empty one. Columns n_words, runs and collapsed are replaced,
    others pass through under any name.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    rows, back = covered(docs.select(*(F.col(f"`{c}`") for c in kept)), text)
    schema = rows.schema.simpleString()[len("struct<") : -1]
    runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, texts = 0, batch.column(batch.schema.get_field_index(text))
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts]) if len(texts) else []
            while k < len(texts):
                end = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + CHUNK_BYTES, side="right")))
                part = batch.slice(k, end - k)
                done = list(_searched(texts.slice(k, end - k).to_pylist()))
                made = [pa.array([n for n, _, _ in done], pa.int64()), pa.array([[dict(start=a, length=n, period=q) for a, n, q in r] for _, r, _ in done], runs), pa.array([c.decode("utf-8", "surrogatepass") for _, _, c in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "n_words", "runs", "collapsed"])
                k = end

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(run, f"{fields}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*back, "n_words", "runs", "collapsed")
