"""Benchmark decontamination with a positional inverted index that Spark builds and intersects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytewords as bw
from tessella.llm.storage import stored

#: Positions of the bitmaps that executors hold to skip terms that no test window has; fixed, whatever the benchmark's size.
BITMAP = 1 << 20
U = np.uint64


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for a, b, data, offsets in bw.chunks(batch.column("text")):
                h, at = bw.words(data, offsets, bw.ALNUM)
                h, row, out = h.view(np.int64), [], []
                for i in range(b - a):
                    own = h[at[i] : at[i + 1]]
                    for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                        row.append(a + i)
                        out.append(own[k : k + size])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return run


def windows_of(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(win, terms) of distinct windows, and (win, item_id)."""
    kind = dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select("item_id", "text").mapInArrow(_windows(size), f"item_id {kind}, terms array<long>")
    rows = stored(rows.withColumn("win", F.xxhash64("terms")), "windows")
    return rows.select("win", "terms").dropDuplicates(["win"]), rows.select("win", "item_id").distinct()


def bitmap(terms: DataFrame) -> np.ndarray:
    """Which of BITMAP places hold one of the terms; at most BITMAP numbers reach the driver."""
    at = terms.select(F.pmod(F.col("term"), F.lit(BITMAP)).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()
    out = np.zeros(BITMAP, bool)
    out[at] = True
    return out


def _counter(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in bw.chunks(batch.column("text"), 8 << 20):
                h, _ = bw.words(data, offsets, bw.ALNUM)
                t, n = np.unique(h[wanted[(h % U(BITMAP)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return run


def _indexer(anchors: np.ndarray, vocabulary: np.ndarray, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for a, b, data, offsets in bw.chunks(batch.column("text")):
                h, at = bw.words(data, offsets, bw.ALNUM)
                place = (h % U(BITMAP)).astype(np.int64)
                hit = np.flatnonzero(anchors[place])
                row = np.searchsorted(at, hit, side="right") - 1
                near = np.zeros(len(h) + 1, np.int32)  # +1 where a neighbourhood begins, -1 after its end
                np.add.at(near, np.maximum(hit - reach, at[row]), 1)
                np.add.at(near, np.minimum(hit + reach + 1, at[row + 1]), -1)
                keep = np.flatnonzero((np.cumsum(near[:-1]) > 0) & vocabulary[place])
                cut = np.searchsorted(keep, at).astype(np.int32)
                own = np.repeat(at[:-1], np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), keys.slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[keep].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array((keep - own).astype(np.int32)))],
                    names=["doc_id", "text_key", "n_words", "terms", "positions"],
                )

    return run


def positional_index(docs: DataFrame, windows: DataFrame, reach: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-row word counts, postings, windows ordered by rarity).

    Terms are counted over the whole corpus; a window that has a term which never occurs is dropped,
    and the rarest term of each other window is its anchor. Postings ``(doc_id, text_key, term, pos)``
    are stored for every test term within ``reach`` words of an anchor's occurrence: all that an
    intersection which starts at the rarest term can ask for. The windows' by_rarity has the reach in
    its metadata.
    """
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    terms = windows.select("win", F.posexplode("terms").alias("offset", "term"))
    vocabulary = bitmap(terms)
    counts = base.select("text").mapInArrow(_counter(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by_rarity")).filter("by_rarity[0].n > 0")
    ranked = stored(ranked, "rarity")
    anchors = bitmap(ranked.select(F.col("by_rarity")[0]["term"].alias("term")))
    index = stored(base.mapInArrow(_indexer(anchors, vocabulary, reach), f"doc_id {kind}, text_key long, n_words long, terms array<long>, positions array<int>"), "index")
    postings = index.filter("size(terms) > 0").select("doc_id", "text_key", F.explode(F.arrays_zip("terms", "positions")).alias("p"))
    postings = postings.select("doc_id", "text_key", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos")).distinct()
    return index.select("doc_id", "text_key", "n_words"), postings, ranked.withMetadata("by_rarity", {"reach": reach})


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, text_key, win, start, width): exact occurrences, by intersecting offset-adjusted lists, rarest first."""
    anchor = ranked.select("win", F.col("by_rarity")[0]["term"].alias("term"), F.col("by_rarity")[0]["offset"].alias("offset"), "by_rarity")
    found = postings.join(anchor, "term").select("doc_id", "text_key", "win", (F.col("pos") - F.col("offset")).alias("start"), "by_rarity").filter("start >= 0")

    def meet(rows: DataFrame, need: DataFrame) -> DataFrame:
        there = postings.select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("term").alias("p_term"), F.col("pos").alias("p_pos"))
        same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")) & (F.col("term") == F.col("p_term")) & (F.col("pos") == F.col("p_pos"))
        return need.join(there, same, "left_semi")

    second = F.col("by_rarity")[1]
    two = found.filter("size(by_rarity) > 1").withColumns({"term": second["term"], "pos": F.col("start") + second["offset"]})
    two = meet(two, two).drop("term", "pos").union(found.filter("size(by_rarity) = 1"))
    rest = two.select("doc_id", "text_key", "win", "start", F.size("by_rarity").alias("width"), F.explode_outer(F.slice("by_rarity", 3, 1 << 20)).alias("t"))
    rest = rest.select("doc_id", "text_key", "win", "start", "width", F.col("t.term").alias("term"), (F.col("start") + F.col("t.offset")).alias("pos"))
    short = rest.filter("width <= 2").select("doc_id", "text_key", "win", "start", "width")
    long = rest.filter("width > 2")
    met = meet(long, long).groupBy("doc_id", "text_key", "win", "start", "width").agg(F.count(F.lit(1)).alias("n")).filter("n = width - 2").drop("n")
    return met.union(short.distinct())


def proximity_matches(postings: DataFrame, ranked: DataFrame, reach: int | None = None, share: float = 1.0) -> DataFrame:
    """(doc_id, text_key, win, pos, n_terms, first, last): anchors with at least ``share`` of the window's distinct terms within ``reach`` words, in any order.

    first and last are the outermost positions of the terms' nearest occurrences. The reach is that of
    the index if none is given; a larger one is refused, as the index lacks postings for it. Cells of
    positions bound the pairs of one anchor, however often a document has a term.
    """
    held = ranked.schema["by_rarity"].metadata["reach"]
    reach = held if reach is None else reach
    if not 0 <= reach <= held:
        raise ValueError(f"reach {reach} is not within the {held} words of the index")
    width = 2 * reach + 1
    cell = lambda x: F.floor(x / width)
    anchor = ranked.select("win", F.col("by_rarity")[0]["term"].alias("term"), F.array_distinct(F.col("by_rarity")["term"]).alias("needed"))
    found = postings.join(anchor, "term").select("doc_id", "text_key", "win", "pos", F.size("needed").alias("of"), F.explode("needed").alias("term"))
    found = found.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("pos") - reach), cell(F.col("pos") + reach)))))
    there = postings.withColumnsRenamed({"doc_id": "p_id", "text_key": "p_key", "term": "p_term", "pos": "p_pos"}).withColumn("p_cell", cell(F.col("p_pos")))
    near = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")) & (F.col("term") == F.col("p_term")) & (F.col("cell") == F.col("p_cell")) & (F.abs(F.col("pos") - F.col("p_pos")) <= reach)
    nearest = found.join(there, near).groupBy("doc_id", "text_key", "win", "pos", "of", "term").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("p_pos")), "p_pos"))["p_pos"].alias("at"))
    counted = nearest.groupBy("doc_id", "text_key", "win", "pos", "of").agg(F.count(F.lit(1)).alias("n_terms"), F.min("at").alias("first"), F.max("at").alias("last"))
    return counted.filter(F.col("n_terms") >= F.ceil(F.col("of") * F.lit(share))).drop("of")


def contamination(docs: DataFrame, benchmark: DataFrame, window_words: int = 10) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and text_key.

    A word is hit if it lies in an occurrence of ``window_words`` consecutive words of a benchmark
    item (all its words, if it has fewer). Nulls and empty texts have no words and no hits; items
    without words match nothing; an item without an id is found but not counted or listed.
    Repeated rows each get a row. Without any match items_sha256 is that of the empty string. Other
    columns are ignored.
    """
    return contamination_with_spans(docs, benchmark, window_words)[0]


def contamination_with_spans(docs: DataFrame, benchmark: DataFrame, window_words: int = 10, reach: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of `contamination`, and from the same index the matches ``(doc_id, text_key, item_id, kind, first, last)`` of all documents.

    Kind is exact, where first and last are the places of the words from 0, or proximity: every distinct
    term of a window lies within ``reach`` words (``window_words`` - 1 if none) of an occurrence of its
    rarest one, in any order. An exact match of at most reach + 1 words is also a proximity match. Equal
    rows have one set of spans; those of an item without an id have a null. The rows come from exact
    matches alone, and the spans cost nothing unless they are read.
    """
    reach = window_words - 1 if reach is None else reach
    windows, items = windows_of(benchmark, window_words)
    rows, postings, ranked = positional_index(docs, windows, max(window_words - 1, reach))
    matches = stored(phrase_matches(postings, ranked), "matches")
    words = matches.select("doc_id", "text_key", F.explode(F.expr("sequence(start, start + width - 1)")).alias("pos")).distinct().groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = matches.select("doc_id", "text_key", "win").distinct().join(items.filter("item_id is not null"), "win").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = words.join(listed, _same_row(words, listed), "left").select(words["doc_id"].alias("h_id"), words["text_key"].alias("h_key"), "n_hit", "items")
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["h_id"]) & (rows["text_key"] == hits["h_key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    exact = matches.select("doc_id", "text_key", "win", F.lit("exact").alias("kind"), F.col("start").cast("int").alias("first"), (F.col("start") + F.col("width") - 1).cast("int").alias("last"))
    close = proximity_matches(postings, ranked, reach).select("doc_id", "text_key", "win", F.lit("proximity").alias("kind"), "first", "last")
    spans = exact.union(close).join(items, "win").select("doc_id", "text_key", "item_id", "kind", "first", "last").distinct()
    out = out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_key",
    )
    return out, spans
