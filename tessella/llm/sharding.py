"""Sharding by vector bin packing over bytes, words and rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.mixing import WORD
from tessella.llm.storage import covered, stored

#: A group that is above 1/BUNDLES of a shard in bytes, words or rows is placed as it is; lighter groups share as many bundles for each shard.
BUNDLES, SLOT_ROWS = 256, 20_000
#: Only a group above a whole shard is cut, into slices of at most this share of one.
SLICE = 0.75
#: Weights of bytes, words and rows in the dot product.
FOCUS = np.array([4.0, 1.0, 1.0])
#: Their weights in the exchanges after it, where bytes, the law, go first; the most exchanges for each shard.
EVENED, SWAPS = np.array([32.0, 1.0, 1.0]), 16


def pack(units: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Place units, largest first, where the dot product of their shares with the residual capacity is highest.

    The three dimensions are bytes, words and rows as shares of a shard's capacity. A shard that would
    overflow in any of them is passed over; a unit that fits nowhere goes where its scarcest dimension
    is left with most. Then `even` swaps units between the fullest and the emptiest shards.
    """
    v = units[["bytes", "words", "n"]].to_numpy(float)
    v = v / np.maximum(v.sum(axis=0) / shards, 1e-9)
    order = np.lexsort((units["unit"].to_numpy(), -(v * FOCUS).sum(axis=1)))
    left, placed = np.ones((shards, 3)), np.zeros(len(v), np.int32)
    for k in order:
        fits = (left >= v[k]).all(axis=1)
        s = int(np.argmax(np.where(fits, left @ (v[k] * FOCUS), -np.inf) if fits.any() else (left - v[k]).min(axis=1)))
        placed[k] = s
        left[s] -= v[k]
    even(v[order], placed_in := placed[order], left)
    placed[order] = placed_in
    return pd.DataFrame({"unit": units["unit"], "shard": placed})


def even(v: np.ndarray, placed: np.ndarray, left: np.ndarray) -> None:
    """Swap or move units, in place, while that lowers the weighted sum of squared residual shares, at most SWAPS times a shard.

    Each step takes the shard that is fullest in one dimension and the one that is emptiest there, the
    dimension of widest spread first, and makes the best exchange of one unit for one or none.
    """
    for _ in range(SWAPS * len(left)):
        for d in np.argsort(left.min(axis=0) - left.max(axis=0), kind="stable"):
            full, empty = int(np.argmin(left[:, d])), int(np.argmax(left[:, d]))
            out, back = np.flatnonzero(placed == full), np.append(np.flatnonzero(placed == empty), -1)
            moved = v[out][:, None, :] - np.where(back[:, None] < 0, 0.0, v[back])[None, :, :]
            gain = (EVENED * ((left[full] + moved) ** 2 + (left[empty] - moved) ** 2)).sum(axis=2) if len(out) else np.zeros((0, 1))
            if full != empty and gain.size and gain.min() < (EVENED * (left[full] ** 2 + left[empty] ** 2)).sum() - 1e-12:
                i, j = np.unravel_index(np.argmin(gain), gain.shape)
                left[full] += moved[i, j]
                left[empty] -= moved[i, j]
                placed[out[i]] = empty
                if back[j] >= 0:
                    placed[back[j]] = full
                break
        else:
            return


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with shard_size, text_crc32, shard and slot.

    shard_size is the text's UTF-8 bytes plus 8; equal texts are a group, and all rows of a group go
    to one shard unless the group is more than a shard's part of all bytes or rows; only then it
    is cut in slices by a hash of doc_id. Groups above 1/BUNDLES of a shard are units of their own,
    at most ``3 * BUNDLES * shards``; the lighter ones are gathered whole, by hash, in
    ``BUNDLES * shards`` bundles. So the units that ``pack`` places are a bounded table, at every size
    of the input. No shard is far from another in bytes, words or rows, as near as whole groups allow. Slots count from 0 without gaps in each shard, numbered by ranges of a hash so that
    no task holds a shard.

    A null text counts as no bytes and is one group; a null doc_id is a value like others. Repeated
    rows are rows of their own; those equal in text and doc_id can't be told apart, so they stay in one
    slice and one range of slots. Ties in size are placed by the groups' hashes. An empty table gives
    an empty one. Columns with one of the four new names are replaced, others pass through.
    """
    rows, back = covered(docs.drop("shard_size", "text_crc32", "shard", "slot"), "doc_id", "text")
    rows = rows.withColumns({
        "shard_size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        "group": F.xxhash64("text"),
    })
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    groups = rows.select(F.col("group").alias("g"), F.col("text_crc32").alias("c"), F.col("shard_size").alias("s"), words.alias("w"))
    groups = stored(groups.groupBy("g", "c", "s").agg(F.sum("s").alias("bytes"), F.sum("w").alias("words"), F.count(F.lit(1)).alias("n")), "groups")
    total = [max(x or 0, 1) for x in groups.agg(F.sum("bytes"), F.sum("words"), F.sum("n")).first()]
    share = {c: F.col(c) / float(t) * float(shards) for c, t in zip(("bytes", "words", "n"), total, strict=True)}
    groups = groups.withColumns({"part": F.greatest(*share.values()), "held": F.greatest(share["bytes"], share["n"])})
    bundle = lambda g: F.pmod(g, F.lit(BUNDLES * shards)).cast("string")
    name = F.concat_ws(":", F.lit("g"), "g", "c", "s")
    apart = F.col("part") > 1.0 / BUNDLES
    own = groups.filter(apart).select("g", "c", "s", name.alias("u"), F.when(F.col("held") > 1, F.ceil(F.col("held") / SLICE)).otherwise(1).cast("int").alias("k"))

    found = rows.join(F.broadcast(own), F.expr("group = g and text_crc32 = c and shard_size = s"), "left")
    piece = F.concat_ws(":", "u", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("k")).cast("string"))
    found = found.withColumn("unit", F.when(F.col("u").isNull(), bundle(F.col("group"))).when(F.col("k") == 1, F.col("u")).otherwise(piece)).drop("g", "c", "s", "u")

    light = groups.filter(~apart).groupBy(bundle(F.col("g")).alias("unit")).agg(*(F.sum(c).alias(c) for c in ("bytes", "words", "n")))
    whole = groups.filter(apart & (F.col("held") <= 1)).select(name.alias("unit"), "bytes", "words", "n")
    each = groups.filter("held > 1").select(F.col("g"), F.col("c"), F.col("s"), (F.col("words") / F.col("n")).cast("long").alias("w"))
    cut = found.filter("k > 1").select("unit", F.col("group").alias("rg"), F.col("text_crc32").alias("rc"), F.col("shard_size").alias("rs"))
    cut = cut.groupBy("unit", "rg", "rc", "rs").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(each), F.expr("rg = g and rc = c and rs = s"))
    cut = cut.select("unit", (F.col("n") * F.col("rs")).alias("bytes"), (F.col("n") * F.col("w")).alias("words"), "n")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            yield pack(pd.concat(held, ignore_index=True), shards)

    # One task places a table of bounded size; what it places is summed up before, in many.
    placed = stored(light.unionByName(whole).unionByName(cut).repartition(1).mapInPandas(place, "unit string, shard int"), "placed")
    found = found.join(F.broadcast(placed), "unit").drop("unit", "k")
    ranges = max(1, -(-total[2] // (shards * SLOT_ROWS)))
    found = found.withColumn("span", F.pmod(F.xxhash64(F.lit(6), "doc_id", "group"), F.lit(ranges)))
    counts = found.groupBy(F.col("shard").alias("c_shard"), F.col("span").alias("c_span")).agg(F.count(F.lit(1)).alias("c_n"))
    counts = counts.select("c_shard", "c_span", (F.sum("c_n").over(Window.partitionBy("c_shard").orderBy("c_span")) - F.col("c_n")).alias("c_before"))
    place_in = F.row_number().over(Window.partitionBy("shard", "span").orderBy("doc_id", "text_crc32", "shard_size")) - 1
    found = found.withColumn("own", place_in).join(F.broadcast(counts) if ranges * shards <= 100_000 else counts, F.expr("shard = c_shard and span = c_span"))
    return found.select(*back, "shard_size", "text_crc32", "shard", (F.col("own") + F.col("c_before")).cast("long").alias("slot"))
