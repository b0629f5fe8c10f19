"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import stored

BITS, AFFIX, PIECE = 17, 3, 1 << 21
#: Documents of each language that teach with their whole texts, and words of each language in the lexicon (the most frequent ones).
TRAIN_DOCS, LEXICON_WORDS = 150, 20_000
#: Words of a chain that one step of the scan advances, and characters of one gradient step.
SEGMENT, STEP_CHARS = 64, 60_000
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    return (h * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all words, where each word begins with the total, word hash, first word of each text). Words are runs of letters, lower-cased."""
    c = np.frombuffer("\0".join(t.lower() for t in texts).encode("utf-32-le"), np.uint32)
    begin = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    on = _letters()[c]
    first = on & ~np.concatenate([[False], on[:-1]]) if len(c) else on
    where = np.flatnonzero(first)
    c = c[on]
    starts = np.flatnonzero(first[on])
    at = np.append(starts, len(c))
    if not len(starts):
        return c, at, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    k = np.arange(len(c)) - np.repeat(starts, np.diff(at))
    power = np.cumprod(np.concatenate([[U(1)], np.full(int(k.max()), STEP)]), dtype=np.uint64)
    h = np.add.reduceat((c.astype(np.uint64) + U(1)) * power[k], starts)
    return c, at, h, np.searchsorted(where, begin)


def features(c: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, value) of each feature: the word itself, its affixes, and its 2- and 3-grams as a mean."""
    n, size = len(h), np.diff(at)
    word, bucket, value = [np.arange(n)], [_mixed(h * STEP + U(1))], [np.ones(n)]
    c = c.astype(np.uint64) + U(1)
    for k in range(1, AFFIX + 1):
        ok = np.flatnonzero(size >= k)
        head, tail = np.zeros(len(ok), np.uint64), np.zeros(len(ok), np.uint64)
        for j in range(k):
            head = head * STEP + c[at[ok] + j]
            tail = tail * STEP + c[at[ok + 1] - k + j]
        word += [ok, ok]
        bucket += [_mixed(head * STEP + U(100 + k)), _mixed(tail * STEP + U(200 + k))]
        value += [np.ones(len(ok))] * 2
    of = np.repeat(np.arange(n), size)
    for k in (2, 3):
        if len(c) < k:
            continue
        g = np.zeros(len(c) - k + 1, np.uint64)
        for j in range(k):
            g = g * STEP + c[j : j + len(g)]
        ok = np.flatnonzero(of[: len(g)] == of[k - 1 :])
        word.append(of[ok])
        bucket.append(_mixed(g[ok] * STEP + U(300 + k)))
        value.append(1.0 / np.maximum(size[of[ok]] - k + 1, 1))
    return np.concatenate(word), np.concatenate(bucket).astype(np.int64), np.concatenate(value)


def forward_backward(e: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each word, expected transitions). e: scores of each word and label; first: first word of each sequence.

    Chains are cut in segments of SEGMENT words. The matrix of each segment is worked out for all
    segments together, carried along each chain segment by segment, and then all segments advance
    together again; so a chain of n words takes n / SEGMENT steps and not n.
    """
    n, labels = e.shape
    t = np.exp(transition - transition.max())
    if not n:
        return np.zeros((0, labels)), np.zeros_like(t)
    p = np.exp(e - e.max(axis=1, keepdims=True))
    size = np.diff(first)
    chain = np.flatnonzero(size > 0)
    count = -(-size[chain] // SEGMENT)
    top = np.cumsum(count) - count  # first segment of each chain
    k = np.arange(count.sum()) - np.repeat(top, count)
    start = np.repeat(first[:-1][chain], count) + k * SEGMENT
    length = np.minimum(np.repeat(size[chain], count) - k * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")  # segments by length, so that those still alive come first
    alive = np.searchsorted(-length[order], -np.arange(SEGMENT + 1), side="left")
    opens = np.zeros(len(start), bool)
    opens[top] = True

    whole = np.empty((len(start), labels, labels))
    whole[:] = np.eye(labels)
    for j in range(int(length.max())):
        own = order[: alive[j]]
        x = whole[own] @ t
        if j == 0:
            x[opens[own]] = 1.0
        x *= p[start[own] + j][:, None, :]
        whole[own] = x / x.max(axis=(1, 2), keepdims=True)

    into, after = np.full((len(start), labels), 1.0 / labels), np.ones((len(start), labels))
    by_count = np.argsort(-count, kind="stable")
    going = np.searchsorted(-count[by_count], -np.arange(int(count.max())), side="left")
    for j in range(1, int(count.max())):
        own = top[by_count[: going[j]]] + j
        x = np.einsum("ci,cij->cj", into[own - 1], whole[own - 1])
        into[own] = x / x.sum(axis=1, keepdims=True)
    for j in range(int(count.max()) - 1, 0, -1):
        own = top[by_count[: going[j]]] + j
        x = np.einsum("cij,cj->ci", whole[own], after[own])
        after[own - 1] = x / x.sum(axis=1, keepdims=True)

    a, b = np.empty_like(p), np.empty_like(p)
    held = into.copy()
    for j in range(int(length.max())):
        own = order[: alive[j]]
        x = held[own] @ t
        if j == 0:
            x[opens[own]] = 1.0
        x *= p[start[own] + j]
        x /= x.sum(axis=1, keepdims=True)
        held[own] = a[start[own] + j] = x
    held = after.copy()
    for j in range(int(length.max()) - 1, -1, -1):
        own = order[: alive[j]]
        b[start[own] + j] = held[own]
        x = (p[start[own] + j] * held[own]) @ t.T
        held[own] = x / x.sum(axis=1, keepdims=True)

    inner = np.ones(n, bool)
    inner[first[:-1][chain]] = False
    y = (p * b)[inner]
    before = a[np.flatnonzero(inner) - 1]
    norm = (before * (y @ t.T)).sum(axis=1, keepdims=True)
    m = a * b
    return m / m.sum(axis=1, keepdims=True), (before / norm).T @ y * t


def _once(c: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(hashes of the distinct words, their features, number of each word's distinct word)."""
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    size = np.diff(at)[one]
    begin = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(at[one] - begin[:-1], size) + np.arange(begin[-1])
    return h[one], features(c[own], begin, h[one]), of


@dataclass
class Lexicon:
    """Words by their hashes, in order, and the share of each language in a word's occurrences."""

    words: np.ndarray
    shares: np.ndarray

    def features(self, h: np.ndarray) -> np.ndarray:
        """The shares of each word, less those of an even spread; zeros for a word that the lexicon lacks."""
        if not len(self.words):
            return np.zeros((len(h), self.shares.shape[1]))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where((self.words[at] == h)[:, None], self.shares[at] - 1.0 / self.shares.shape[1], 0.0)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transition: np.ndarray
    lexicon: Lexicon
    trust: np.ndarray  # lexicon shares x languages

    def scores(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word and label, lexicon shares of each word) from the words' features and hashes."""
        word, bucket, value = found
        shares = self.lexicon.features(h)
        return np.stack([np.bincount(word, weights=self.weights[bucket, k] * value, minlength=len(h)) for k in range(len(self.languages))], axis=1) + shares @ self.trust, shares

    def emissions(self, c: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Scores of each word; equal words are worked out once."""
        own, found, of = _once(c, at, h)
        return self.scores(found, own)[0][of]

    def label_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of each word, first word of each text)."""
        c, at, h, first = split(texts)
        if not len(h):
            return np.zeros((0, len(self.languages))), first
        return forward_backward(self.emissions(c, at, h), first, self.transition)[0], first


def _batches(sizes: list[int]) -> list[list[int]]:
    """Numbers of the texts of each gradient step: a text goes on to the next step once STEP_CHARS are full."""
    out: list[list[int]] = []
    full = STEP_CHARS
    for k, n in enumerate(sizes):
        if full >= STEP_CHARS:
            out.append([])
            full = 0
        out[-1].append(k)
        full += n
    return out


def fit_crf(texts: list[tuple[str, str]], lexicon: dict[int, dict[str, int]] | None = None, rounds: int = 4, rate: float = 0.3, penalty: float = 1e-6) -> LanguageModel:
    """Fit on whole (text, language) documents by adaptive gradient steps on the chain's likelihood.

    Each text is one chain. In the first rounds every word is taken to be in its document's language.
    In the last two rounds the words of a run that the model itself puts in another language are
    taken to be in that one, so that transitions are learned from the switches within real texts.
    ``lexicon`` has the counts of each word's hash by language; without it no word has shares.
    """
    languages = sorted({y for _, y in texts})
    count = max(len(languages), 1)
    table = Lexicon(np.zeros(0, np.uint64), np.zeros((0, count)))
    if lexicon:
        words = np.array(sorted(lexicon), np.uint64)
        seen = np.array([[lexicon[int(w)].get(x, 0) for x in languages] for w in words], float) + 0.5
        table = Lexicon(words, seen / seen.sum(axis=1, keepdims=True))
    model = LanguageModel(languages or ["und"], np.zeros((1 << BITS, count)), np.zeros((count, count)), table, np.zeros((count, count)))
    if count < 2:
        return model
    grown, grown_t, grown_l = np.full_like(model.weights, 1e-4), np.full_like(model.transition, 1e-4), np.full_like(model.trust, 1e-4)
    steps = _batches([len(t) for t, _ in texts])
    for k in range(rounds):
        for step in steps:
            own = [texts[i] for i in step]
            c, at, h, first = split([t for t, _ in own])
            if not len(h):
                continue
            y = np.repeat([languages.index(x) for _, x in own], np.diff(first))
            words, found, of = _once(c, at, h)
            e, shares = model.scores(found, words)
            e = e[of]
            m, pairs = forward_backward(e, first, model.transition)
            if k >= rounds - 2:
                y = np.where(m.max(axis=1) >= 0.95, m.argmax(axis=1), y)
            m[np.arange(len(y)), y] -= 1
            scale = max(len(h) / 40, 1.0)
            error = np.stack([np.bincount(of, weights=m[:, j], minlength=len(words)) for j in range(count)], axis=1) / scale
            word, bucket, value = found
            used, place = np.unique(bucket, return_inverse=True)
            g = np.stack([np.bincount(place, weights=error[word, j] * value, minlength=len(used)) for j in range(count)], axis=1)
            g += penalty * model.weights[used]
            grown[used] += g * g
            model.weights[used] -= rate * g / np.sqrt(grown[used])
            g = shares.T @ error + penalty * model.trust
            grown_l += g * g
            model.trust -= rate * g / np.sqrt(grown_l)
            inner = np.setdiff1d(np.arange(1, len(y)), first)
            np.add.at(pairs, (y[inner - 1], y[inner]), -1)
            pairs = pairs / scale + 1e-3 * model.transition
            grown_t += pairs * pairs
            model.transition -= rate / (k + 2) * pairs / np.sqrt(grown_t)
    return model


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch, pre-aggregated."""
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            for a in range(0, len(own), 256):
                h, n = np.unique(split([texts[i] for i in own[a : a + 256]])[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def fit_language(docs: DataFrame, learn, train_docs: int = TRAIN_DOCS, lexicon_words: int = LEXICON_WORDS) -> LanguageModel:
    """Fit on rows of ``docs(doc_id, text, lang)`` where ``learn`` holds and text and lang are not null.

    The lexicon counts the words of all these rows by language; at most ``lexicon_words`` of each
    language reach the driver, all those above a frequency (in steps of an eighth of a doubling), with
    their counts in every language. The chain is fitted on the whole texts of about ``train_docs`` documents of each
    language, taken by a hash of doc_id. The languages are the values of lang. Repeated rows count
    again; rows without a doc_id have one hash. Without such a row the model knows no language, with
    one language it predicts that one. Other columns are ignored.
    """
    known = docs.filter(learn).filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return fit_crf([])
    counts = known.select("lang", "text").mapInArrow(_word_counter, "lang string, word long, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    counts = stored(counts, "lexicon")
    lexicon = {}
    for lang in sorted(n):
        own = counts.select("word", "by_lang", F.floor(F.log2(F.col("by_lang")[lang]) * 8).alias("level")).filter("level is not null")
        held, least = 0, None  # the lowest level down to which at most lexicon_words words are held
        for level, words in sorted(own.groupBy("level").count().collect(), reverse=True):
            held += words
            if held > lexicon_words:
                break
            least = level
        if least is not None:
            lexicon |= {r["word"] & 0xFFFFFFFFFFFFFFFF: r["by_lang"] for r in own.filter(F.col("level") >= least).select("word", "by_lang").collect()}
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, train_docs / v)))), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit(10), F.col("doc_id")), F.lit(1 << 30))
    sample = known.filter(place < share * float(1 << 30)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).toPandas().sort_values(["h", "text"])
    return fit_crf(list(zip(sample["text"], sample["lang"], strict=True)), lexicon)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last) of consecutive texts of about PIECE characters."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= PIECE):
            n += len(texts[b])
            b += 1
        yield a, b
        a = b


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs(doc_id, text, ...)``.

    The language is the label with the greatest sum of word marginals over the whole text (of equal
    ones the first by name), the score its share. A null text or one without a letter gets ``und``
    and 0, and so does every row if the model knows no language. Repeated rows are predicted each;
    other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in _pieces(texts):
                m, first = model.label_words(texts[a:b])
                total = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum(m, axis=0)])
                share = total[first[1:]] - total[first[:-1]]
                count = np.diff(first)
                best = np.where(count > 0, share.argmax(axis=1), len(names) - 1)
                score = np.where(count > 0, np.clip(share.max(axis=1) / np.maximum(count, 1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, first_word, last_word, lang, score): the runs of words of one language in each whole text of ``docs(doc_id, text, ...)``.

    A word's language is its most likely label, words count from 0, and score is the run's mean
    marginal. A null text or one without a letter has no run. Repeated rows each have their runs.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in _pieces(texts):
                m, first = model.label_words(texts[a:b])
                if not len(m):
                    continue
                label, text = m.argmax(axis=1), np.repeat(np.arange(b - a), np.diff(first))
                begin = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])]))
                size = np.diff(np.append(begin, len(m)))
                at = begin - first[text[begin]]
                mean = np.add.reduceat(m.max(axis=1), begin) / size
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text[begin] + a)), pa.array(at.astype(np.int64)), pa.array((at + size - 1).astype(np.int64)), pa.array(names[label[begin]].tolist(), pa.string()), pa.array(mean)],
                    names=["doc_id", "first_word", "last_word", "lang", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first_word long, last_word long, lang string, score double")
