"""Neighbour lists, centroids and periodic runs against brute force; forms in pages; products of sets."""

from __future__ import annotations

import hashlib
import random
import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SF, connect, rows

from tessella.llm import centroids, near_dedup, periodic, vector_dedup
from tessella.llm import queries as Q
from tessella.llm.centroids import centroid_clusters
from tessella.llm.html_text import content
from tessella.llm.language import fit_language
from tessella.llm.periodic import PRIMES, Transform, differences_are_zero, find_runs, periodic_runs
from tessella.llm.vector_dedup import vector_duplicates

VECTORS = "vec_id long, embedding array<float>, label int, node string, weight int, v string"


@pytest.mark.parametrize("name", ["op11_vector_dedup", "op12_centroids", "op13_periodic_runs"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), connect().execute(Q.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def sphere(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def near(rng, v, cosine):
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(axis=1)[:, None] * v
    w /= np.linalg.norm(w, axis=1)[:, None]
    return cosine * v + np.sqrt(1 - cosine * cosine) * w


def frame(spark, vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, "y") for i, v, label in zip(ids, vectors, labels, strict=True)], VECTORS)


def linked(vectors, labels, threshold=0.93):
    """(links, component) of each vector, by all pairs."""
    m = np.array(vectors, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    on = (m @ m.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(on, False)
    part = np.arange(len(m))
    while True:
        low = np.minimum(part, np.where(on, part[None, :], len(m)).min(axis=1))
        if (low == part).all():
            return list(zip(on.sum(axis=1).tolist(), part.tolist(), strict=True))
        part = low[low]


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Pairs just above the threshold, a tight clump, a loose cloud larger than a block, and equal vectors, in two labels."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 128)
    monkeypatch.setattr(vector_dedup, "AIM", 64)
    monkeypatch.setattr(vector_dedup, "PLACED", 100)
    rng = np.random.default_rng(5)
    base = sphere(rng, 700)
    parts = [base, near(rng, base[:150], rng.uniform(0.931, 0.96, (150, 1))), near(rng, base[150:200], rng.uniform(0.90, 0.928, (50, 1)))]
    parts += [sphere(rng, 1) + 0.012 * rng.normal(size=(200, 64)), sphere(rng, 1) + 0.045 * rng.normal(size=(300, 64)), np.repeat(sphere(rng, 1), 40, axis=0)]
    vectors = np.concatenate(parts).astype(np.float32)
    order = rng.permutation(len(vectors))
    vectors, labels = vectors[order], [int(x) for x in rng.integers(0, 2, len(vectors))]
    out = vector_duplicates(frame(spark, vectors, labels)).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in out] == linked(vectors, labels)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out) and out[0].audit_recall == 1.0


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [([1, 0], 1), ([1, 0.01], 1), ([1, 0.01], 2), ([1, 0], None), (None, 1), ([], 1), ([0, 0], 1), ([1, nan], 1), ([1, inf], 1), ([1, None], 1), ([1, 0, 0], 1), ([-1, 0], 1), ([2, 0.01], 1)]
    d = frame(spark, [r[0] for r in rows_], [r[1] for r in rows_])
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_duplicates(d).collect()}
    assert out == {i: (2, 0, i == 0) if i in (0, 1, 12) else (0, i, True) for i in range(len(rows_))}
    # Repeated rows are one vector and are each returned; a row without an id is linked with nothing.
    again = d.limit(2).union(d.limit(2)).union(d.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vector_duplicates(again).collect()) == [("0", 1, "0")] * 2 + [("1", 1, "0")] * 2 + [("None", 0, "None")]
    assert vector_duplicates(d.limit(0)).count() == 0


def plain_clusters(vectors, ids, k, rounds, seed):
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for v in vectors]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in zip(ids, x, strict=True))
    c = [v for _, v in first[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in x]
    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(c)):
            own = [v for v, o in zip(x, of, strict=True) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(j, d, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for d, j in assign()]


@pytest.mark.parametrize("slab", [7, 16384])
def test_clusters_are_those_of_plain_rounds(spark, monkeypatch, slab):
    """With copies, so that wide blocks of dimensions are kept whole, ties, and slabs of few vectors."""
    monkeypatch.setattr(centroids, "SLAB", slab)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(40, 6)), np.repeat(rng.normal(size=(2, 6)), 30, axis=0), rng.integers(-1, 2, (20, 6))]).astype(np.float32)
    want = plain_clusters(vectors, range(len(vectors)), 5, 4, 3)
    out = centroid_clusters(frame(spark, vectors, [1] * len(vectors)), 5, 4, 6, 3).orderBy("vec_id").collect()
    assert [(r.cluster, r.distance, r.centroid_sha256) for r in out] == want
    total = sum(d for _, d, _ in want)
    assert all(r.inertia == total and r.cluster_inertia == sum(d for j, d, _ in want if j == r.cluster) for r in out)


def test_blocks_of_dimensions_are_encoded_without_loss():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-9, 9, (500, 5)), np.repeat(rng.integers(-999, 999, (4, 8)), 100, axis=0), np.zeros((1, 3), np.int64)):
        back, blocks = np.full(x.shape, 7777), centroids.encoded(x.astype(np.int64))
        for at, width, entries, codes in blocks:
            back[:, at : at + width] = entries[codes]
        assert (back == x).all()
    assert len(centroids.encoded(np.repeat(rng.integers(-999, 999, (4, 8)), 100, axis=0))) == 1


def test_clusters_of_odd_tables(spark):
    nan = float("nan")
    odd = [[1, 2], [1, 2, 3], None, [], [1, nan], [1, None], [3e38, -3e38], [0, 0], [1, 2]]
    out = {r.vec_id: r for r in centroid_clusters(frame(spark, odd, [1] * len(odd)), 8, 10, 2).collect()}
    assert set(out) == {0, 6, 7, 8} and out[0].cluster == min(out[0].cluster, out[8].cluster) and out[6].distance == 0
    assert centroid_clusters(frame(spark, odd, [1] * len(odd)).limit(0), 8, 10, 2).count() == 0
    assert set(centroid_clusters(frame(spark, odd[:1], [1], [0]).withColumn("vec_id", F.lit(None).cast("long")), 8, 2, 2).first().asDict()) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"}


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + (j == i)
    return sorted((a, n, q) for (a, n), q in found.items())


def repetitive(rng):
    parts = []
    for _ in range(rng.randrange(7)):
        few, base = rng.choice([2, 3, 40]), rng.randrange(1, 70)
        unit = [str(rng.randrange(few)) for _ in range(base)]
        parts += (unit * 9)[: int(base * rng.uniform(2, 7))] if rng.random() < 0.6 else [str(rng.randrange(few)) for _ in range(rng.randrange(1, 90))]
    return parts


def test_runs_are_those_of_every_period(spark, monkeypatch):
    rng = random.Random(9)
    words = [repetitive(rng) for _ in range(150)] + [["a"] * 5, ["a"] * 6, "a b c".split() * 4, "a b c".split() * 3 + ["a", "b"], ["x"] * 3000, [str(k % 700) for k in range(2900)]]
    texts = ["  ".join(w) if k % 2 else "\t" + "\n".join(w) for k, w in enumerate(words)]
    d = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, codes string")
    for chunk in (1000, 4 << 20):
        monkeypatch.setattr(periodic, "CHUNK_BYTES", chunk)
        for r in periodic_runs(d).orderBy("doc_id").collect():
            w = words[r.doc_id]
            assert (r.n_words, [tuple(x) for x in r.runs]) == (len(w), plain_runs(w)), r.doc_id
            gone = {i for a, n, q in plain_runs(w) for i in range(a + q, a + n)}
            assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone) and r.codes == "c"


def test_runs_of_null_empty_and_repeated_texts(spark):
    texts = [None, "", " \t\n", "a", "a b " * 6, "a b " * 6, "A a " * 6]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(d).orderBy("doc_id").collect()]
    run = (6, [(0, 6, 1)], "a b")
    assert out == [(0, [], ""), (0, [], ""), (0, [], ""), (1, [], "a"), run, run, (12, [(0, 12, 2)], "A a")]
    assert periodic_runs(d.limit(0)).count() == 0


def test_transforms_are_exact():
    rng = np.random.default_rng(2)
    for prime, generator in PRIMES:
        for size in (2, 8, 128):
            t, x, y = Transform(size, prime, generator), *rng.integers(0, prime, (2, 3, size))
            assert (t.inverse(t.forward(x)) == x).all()
            z = t.inverse(t.forward(x) * t.forward(y) % prime)
            assert all(int(z[r, k]) == sum(int(x[r, i]) * int(y[r, (k - i) % size]) for i in range(size)) % prime for r in range(3) for k in range(0, size, 7))
    blocks, follow = rng.integers(1, 3, (200, 8)), rng.integers(1, 3, (200, 15))
    want = np.array([[(b == f[k : k + 8]).all() for k in range(8)] for b, f in zip(blocks, follow, strict=True)])
    assert (differences_are_zero(blocks, follow) == want).all() and want.any()
    large = blocks * (1 << 28)  # needs all primes
    assert (differences_are_zero(large, follow * (1 << 28)) == want).all()
    assert find_runs(np.zeros(0, np.int64), np.zeros(1, np.int64)) == []


S = "This is a sentence of the article, with commas, and more. "
TEXT, MENU = f"<p>{S * 9}</p>", "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
CONTACT = "<form><label>Name</label><input name=n><label>Your address</label><input><textarea></textarea><button>Send</button><p>We store your data and treat it as described in our statement on privacy, which you can read at any time.</p></form>"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f'<form id="aspnetForm"><input type=hidden name=v>{MENU}<div id="content"><h1>Head</h1>{TEXT}</div><input name=q><button>Search</button></form>', "HT"),
        (f"<form>{MENU}<article><h1>Head</h1>{TEXT}{TEXT}</article><input></form>", "HTT"),
        (f"<article><h1>Head</h1>{TEXT}<fieldset><legend>Box</legend>{TEXT}</fieldset>{TEXT}</article>", "HTBTT"),
        (f"<main><header><h1>Head</h1></header>{TEXT}{TEXT}</main>", "HTT"),
        (f"<article><h1>Head</h1>{TEXT}{TEXT}</article>{CONTACT}", "HTT"),
        (f"<article><h1>Head</h1>{TEXT}{CONTACT}{TEXT}</article>", "HTT"),
        (f"<div id=content><h1>Head</h1>{TEXT}{CONTACT}{TEXT}</div>", "HTT"),
        (f"<form action=s><input><button>Go</button> Search</form><div><h1>Head</h1>{TEXT}{TEXT}</div>", "HTT"),
    ],
)
def test_forms_are_left_to_the_ratios(page, blocks):
    known = {"H": "Head", "T": (S * 9).strip(), "B": "Box"}
    assert content(f"<html><body>{page}</body></html>") == "\n".join(known[b] for b in blocks)


def test_formulas_stay_in_the_text():
    page = f'<article><h1>Head</h1>{TEXT}<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation encoding="x">a+b</annotation></math> is well known, as we said above.</p>{TEXT}</article>'
    assert content(page).split("\n")[2] == "The sum a+b is well known, as we said above."


@pytest.mark.parametrize("price", [0.0, 1.0])
def test_shared_items_by_pairs_and_by_products(monkeypatch, price):
    monkeypatch.setattr(near_dedup, "PRODUCT", price)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in rng.integers(1, 200, 40)]
    x, y = np.triu_indices(40, 1)
    assert near_dedup._shared(sets, x, y).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)]


def test_transitions_label_spliced_texts(spark):
    """Held-out texts of two languages in turns of a dozen words, every third word an invented name: the chain gives names their neighbours' language, words alone can't."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = fit_language(docs, ~held, train_docs=60)
    rng = random.Random(10)
    texts: dict[str, list[str]] = {}
    for r in docs.filter(held & F.col("text").isNotNull() & F.col("lang").isNotNull()).orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).extend("".join(c if c.isalpha() else " " for c in r.text).split())
    spliced, truth = [], []
    for _ in range(60):
        langs, words = rng.sample(sorted(texts), 2), []
        for turn in range(6):
            at = rng.randrange(max(len(texts[langs[turn % 2]]) - 12, 1))
            own = texts[langs[turn % 2]][at : at + 12]
            words += ["".join(rng.choice("qxzjkvw") for _ in range(6)) if k % 3 == 1 else w for k, w in enumerate(own)]
            truth += [langs[turn % 2]] * len(own)
        spliced.append(" ".join(words))

    def accuracy(m):
        marginals, _ = m.label_words(spliced)
        assert len(marginals) == len(truth)
        return np.mean([m.languages[k] == t for k, t in zip(marginals.argmax(axis=1), truth, strict=True)])

    chain, alone = accuracy(model), accuracy(replace(model, transition=np.zeros_like(model.transition)))
    assert chain > 0.85 and chain > alone + 0.1
