"""Global ranks, splits, samples and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import stored


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with its place from 0 in a total order, without one task for all rows.

    Rows are range-partitioned by the order and numbered in their partition; the sizes of the earlier
    partitions, one number each, are added.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = stored(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return parts.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_own") - 1 + F.col("_before")).drop("_part", "_own", "_before")


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """``df`` with a running sum for each entry (name: column) in a total order, from ranges like those of `global_rank`."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = stored(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranked")
    total = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))  # one row for each range
    total = total.select("_part", *((F.sum(f"_s_{n}").over(Window.orderBy("_part")) - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(total), "_part")
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_part", *(f"_{k}_{n}" for k in "ob" for n in sums))


def hash_key(seed: int, key: Column) -> Column:
    """A repeatable random order: the digest of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def sequence_ids(df: DataFrame, groups: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """W3. Running number from 0 in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)


def split_evenly(df: DataFrame, n: int, *order: str) -> DataFrame:
    """W4. chunk 0..n-1 in the given order; the first ``rows mod n`` chunks get one row more."""
    ranked = global_rank(df, *order, name="_r")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))
    small, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    cut = extra * (small + 1)
    chunk = F.when(F.col("_r") < cut, F.floor(F.col("_r") / (small + 1))).otherwise(extra + F.floor((F.col("_r") - cut) / F.greatest(small, F.lit(1))))
    return ranked.join(total).withColumn("chunk", chunk.cast("int")).drop("_r", "_n")


def batch_bounds(df: DataFrame, size: int, group: str = "chunk", comfort: int = 0) -> DataFrame:
    """W5. (group, batch, first, last), places from 0 inside each group of sizes ``n``; one batch for all if the largest group has at most ``comfort`` rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    most = F.broadcast(sizes.agg(F.max("n").alias("_most")))
    step = F.when(F.col("_most") <= comfort, F.col("_most")).otherwise(F.lit(size)).cast("long")
    rows = sizes.join(most).withColumn("step", step).withColumn("batch", F.explode(F.expr("sequence(0L, cast(floor((n - 1) / step) as bigint))")))
    return rows.select(group, "batch", (F.col("batch") * F.col("step")).alias("first"), (F.least((F.col("batch") + 1) * F.col("step"), F.col("n")) - 1).alias("last"))


def _ranked_names(names: DataFrame, key: str, seed: int) -> DataFrame:
    ranked = global_rank(names.withColumn("_h", hash_key(seed, F.col(key))), "_h", key, name="_r")
    return ranked.join(F.broadcast(names.agg(F.count(F.lit(1)).alias("_n")))).drop("_h")


def split_static(names: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """W6. ``names`` with is_val: the first N - trunc((1 - fraction) * N) in a seeded order, at least one if there are two."""
    n = F.col("_n")
    val = n - ((1 - fraction) * n).cast("long")
    val = F.when(n > 1, F.greatest(val, F.lit(1))).otherwise(val)
    return _ranked_names(names, key, seed).withColumn("is_val", F.col("_r") < val).drop("_r", "_n")


def split_cyclic(names: DataFrame, key: str, fraction: float, epoch: int, seed: int = 42) -> DataFrame:
    """W7. ``names`` with is_val: a window of the seeded order that moves on by its length each epoch and wraps around."""
    n = F.col("_n")
    val = n - ((1 - fraction) * n).cast("long")
    val = F.when(n > 1, F.greatest(val, F.lit(1))).otherwise(val)
    return _ranked_names(names, key, seed).withColumn("is_val", F.pmod(F.col("_r") - F.pmod(epoch * val, n), n) < val).drop("_r", "_n")


def best_checkpoint(df: DataFrame, run: list[str], epoch: str, metric: str) -> DataFrame:
    """W8. Rows whose metric strictly beats every earlier epoch's of the run; is_best marks the last of them."""
    w = Window.partitionBy(*run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(metric) > F.col("_before"))).drop("_before")
    return better.withColumn("is_best", F.col(epoch) == F.max(epoch).over(Window.partitionBy(*run)))


def top_rows(df: DataFrame, metric: str, k: int, tie: str) -> DataFrame:
    """O2. The k rows with the greatest metric, ties by name."""
    return df.orderBy(F.desc(metric), tie).limit(k)


def top_rows_by(df: DataFrame, metrics: list[str], k: int, tie: str) -> DataFrame:
    """O2. (metric, rank, tie, value): the k rows with the greatest value of each of the metrics, ties by name; ranks from 1.

    One pass: before the shuffle each task keeps its own k best of a metric, as long as k is at most
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000).
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics)))
    rows = df.select(tie, each.alias("m")).select("m.metric", tie, "m.value")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("metric", "rank", tie, "value")


def limit_samples(df: DataFrame, key: str, n: int) -> DataFrame:
    """O3. The first n by name; all for 0."""
    return df.orderBy(key).limit(n) if n else df


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """O4. n rows drawn by a seeded hash; all for 0."""
    return df.orderBy(hash_key(seed, key), key).limit(n) if n else df


def unit_interval(seed: int, key: Column) -> Column:
    """A repeatable number in (0, 1) from 13 hexadecimal digits of the digest."""
    return (F.conv(F.substring(hash_key(seed, key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, replacement: bool = False, seed: int = 42) -> DataFrame:
    """O5. n rows drawn by weight.

    Without replacement: the n least values of -ln(u) / weight. With it: n points on the line of
    cumulative weights, each joined to the row whose stretch it falls in; stretches are cut in cells
    of the line so that the join is an equi-join.
    """
    if not replacement:
        return df.filter(F.col(weight) > 0).orderBy(-F.log(unit_interval(seed, F.col(key))) / F.col(weight), key).limit(n)
    rows = running_sums(df.filter(F.col(weight) > 0), [key], {"_to": weight}).withColumn("_from", F.col("_to") - F.col(weight))
    rows = rows.join(F.broadcast(rows.agg(F.max("_to").alias("_all"))))  # one row
    points = df.sparkSession.range(n).select(F.col("id").alias("draw"), unit_interval(seed + 1, F.col("id")).alias("_u"))
    spread = F.lit(float(max(n, 1)))
    stretch = rows.withColumn("_g", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_all") * spread), F.floor(F.col("_to") / F.col("_all") * spread))))
    hit = points.withColumn("_g", F.floor(F.col("_u") * spread)).join(stretch, "_g").filter((F.col("_u") * F.col("_all") >= F.col("_from")) & (F.col("_u") * F.col("_all") < F.col("_to")))
    return hit.select("draw", *df.columns)


def balance_weights(df: DataFrame, pixels: str, target: float = 0.5, min_pixels: int = 10) -> DataFrame:
    """W16. ``df`` with weight: positives (at least max(1, min_pixels) pixels) share ``target`` (0.05 to 0.95), the rest the rest; 1 for all if a side is empty."""
    target = min(max(target, 0.05), 0.95)
    pos = (F.col(pixels) >= max(1, min_pixels)).cast("int")
    counts = F.broadcast(df.agg(F.coalesce(F.sum(pos), F.lit(0)).alias("_pos"), F.count(F.lit(1)).alias("_all")))
    neg = F.col("_all") - F.col("_pos")
    weight = F.when((F.col("_pos") == 0) | (neg == 0), 1.0).when(pos == 1, target / F.col("_pos")).otherwise((1 - target) / neg)
    return df.join(counts).withColumn("weight", weight).drop("_pos", "_all")
