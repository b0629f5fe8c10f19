"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import covered, stored
from tessella.operators.ranking import global_rank

#: Weights of the sources in code-point order, repeating.
WEIGHTS, PASSES = (5, 2, 1), 3
#: Rows of a bucket, over which one window runs, and buckets of a block, over which the next one does.
BUCKET_ROWS, BLOCK_BUCKETS = 2_000, 2_000
#: The least virtual time after the budget.
AFTER = 1.0 + 2.0**-52
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, src, source_size, n_rows, target) of ``rows(source, mix_size)``.

    Water filling: the level is what a weight of 1 gets. Each round is one sum over the sources: those
    whose most (``passes`` times their size) is below their share stop there, and the rest share what
    is left by weight, which raises the level, until no further source stops.
    """
    s = rows.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    s = global_rank(s, F.col("source").asc_nulls_last(), name="place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    s = s.select("source", (F.col("place") + 1).alias("src"), "source_size", "n_rows", weight.alias("weight"), (F.col("source_size") * passes).alias("most"))
    level, full = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("most") / F.col("weight") < F.lit(level)
        left, shared, n = s.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(stops, F.col("most"))), F.lit(0)), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if not shared or n == full:
            break
        level, full = left / shared, n
    target = F.least(F.col("most").cast("double"), F.lit(level or 0.0) * F.col("weight"))
    return s.select("source", "src", "source_size", "n_rows", target.alias("target"))


def _running(rows: DataFrame, group: str, bucket: str, size: str, order: list[str]) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``size`` in the group up to each row, from sums inside buckets, of buckets inside blocks, and of blocks."""
    sums = rows.groupBy(group, bucket).agg(F.sum(size).alias("b_sum")).withColumn("block", F.floor(F.col(bucket) / BLOCK_BUCKETS))
    earlier = lambda key, at, x: F.sum(x).over(Window.partitionBy(*key).orderBy(at)) - F.col(x)
    blocks = sums.groupBy(group, "block").agg(F.sum("b_sum").alias("k_sum"))
    blocks = blocks.select(F.col(group).alias("k_group"), F.col("block").alias("k_block"), earlier([group], "block", "k_sum").alias("k_before"))
    sums = sums.withColumn("b_before", earlier([group, "block"], bucket, "b_sum")).join(blocks, F.expr(f"{group} = k_group and block = k_block"))
    sums = sums.select(F.col(group).alias("b_group"), F.col(bucket).alias("b_bucket"), (F.col("b_before") + F.col("k_before")).alias("before"))
    own = F.sum(size).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(sums, F.expr(f"{group} = b_group and {bucket} = b_bucket"))
    return rows.withColumn("upto", F.col("own") + F.col("before")).drop("own", "before", "b_group", "b_bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, size: str | None = None) -> DataFrame:
    """``docs`` with mix_size, source_size, target, taken and finish.

    Each source's rows stand in the order of a hash of doc_id and size and are served again and again,
    up to ``passes`` times. A row's words leave the queue at the virtual time ``cumulative words of the
    source / target``; the budget, all words together, is spent at time 1, where every source has
    had its target, so the row in service there is taken in part. ``finish`` is the virtual time at
    which a row's first copy is complete.

    ``size`` names a column of sizes; else words of ``text`` are counted. Running sums are per range
    of the hash, about BUCKET_ROWS rows, with the sums of earlier ranges added, so that a source with
    a third of all rows is spread, and so are equal or missing ids unless their sizes are equal too.
    Null or empty texts have size 0 and take 0; a null source is one source, last. Repeated rows are
    rows of their own, ties stand in any order of equal outcome. An empty table gives an empty one.
    Columns named mix_size, source_size, target, taken or finish are replaced, others pass through.
    """
    counted = F.coalesce(F.col(f"`{size}`") if size else F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows, back = covered(docs.withColumn("mix_size", counted).drop("source_size", "target", "taken", "finish"), "doc_id", "source", "mix_size")
    back = [c for c, name in zip(back, rows.columns, strict=True) if name != "mix_size"]
    t = source_targets(rows, weights, passes).withColumnRenamed("source", "t_source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    rows = rows.withColumn("at", F.md5(F.concat(F.lit("5|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("mix_size").cast("string"))))
    place = F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("bucket", F.floor(place * F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    rows = _running(rows, "src", "bucket", "mix_size", ["at", "doc_id", "mix_size"])
    taken = sum((_taken(k) for k in range(passes)), F.lit(0).cast("long"))
    finish = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    return rows.select(*back, "mix_size", "source_size", "target", taken.alias("taken"), finish.alias("finish"))


def _taken(k: int) -> Column:
    """Words that the mix takes of a row's copy k."""
    return F.greatest(F.lit(0), F.least(F.col("mix_size"), F.floor("target") - (F.col("upto") - F.col("mix_size")) - F.col("source_size") * k))


def truncated(mixed: DataFrame, passes: int = PASSES) -> DataFrame:
    """``mixed`` with taken as what the stream holds of each row at its budget, and upto_words.

    The stream has a part for every copy whose service begins before virtual time 1, and another for
    what a copy in service at that time has left, range-sorted by virtual finish time over all sources.
    Its running sum, in ranges of that order, is cut at the budget, the whole words of all targets. A
    source's parts stand in the order of its queue, so the words that the cut stream holds of a source
    tell what it holds of each row. upto_words are the words of the whole stream when the row's first
    copy is complete or the budget is spent, null if nothing is taken of the row. Repeated rows are
    rows of their own; ties in time stand in the order of source, doc_id and size; an empty table gives
    an empty one. Null sources are one source. A column named upto_words is replaced.
    """
    rows, back = covered(mixed.drop("upto_words"), "doc_id", "source", "mix_size", "source_size", "target", "taken", "finish")
    # finish is a quotient of whole words below 2^50, so it gives them back exactly.
    at = lambda k: F.round(F.col("finish") * F.col("target")).cast("long") - F.col("mix_size") + k * F.col("source_size")
    begins = F.coalesce(at(F.col("k")), F.lit(0))  # words of the source's queue before the copy
    held = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.floor("target") - begins))
    copies = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).filter((F.col("k") == 0) | (begins < F.floor("target")))
    part = lambda words, late: F.struct(words.cast("long").alias("words"), F.lit(late).alias("late"))
    left = F.col("mix_size") - F.col("held")
    parts = F.array_compact(F.array(F.when((F.col("k") == 0) | (F.col("held") > 0), part(F.col("held"), False)), F.when((F.col("held") > 0) & (left > 0), part(left, True))))
    done = F.col("finish") + F.col("k") * F.col("source_size") / F.col("target")
    time = F.when(F.col("late"), F.greatest(done, F.lit(AFTER))).when(F.col("words") > 0, F.least(F.lit(1.0), done))
    lead = (F.col("k") == 0) & ~F.col("late")
    copies = copies.withColumn("held", held).withColumn("p", F.explode(parts)).withColumns({"words": F.col("p.words"), "late": F.col("p.late")}).withColumn("time", time).withColumn("lead", lead)
    keys = ("doc_id", "source", "mix_size", "source_size", "target", "finish")
    slim = [F.col(c) if c in keys else F.when(F.col("lead"), F.col(c)).alias(c) for c in rows.columns]
    copies = copies.select(*slim, "k", "words", "time", "lead")
    order = [F.col("time").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("mix_size"), F.col("k")]
    ranked = stored(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "stream")
    sums = ranked.groupBy("part").agg(F.sum("words").alias("p_sum"))  # one row for each partition
    sums = sums.select("part", (F.sum("p_sum").over(Window.orderBy("part")) - F.col("p_sum")).alias("p_before"))
    own = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    budget = F.lit(ranked.select("source", "target").distinct().agg(F.sum(F.floor("target"))).first()[0] or 0)
    stream = ranked.withColumn("own", own).join(F.broadcast(sums), "part").withColumn("upto", F.col("own") + F.col("p_before"))
    inside = F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("upto") + F.col("words")))
    of = stream.groupBy(F.col("source").alias("s_source")).agg(F.sum(inside).alias("s_words"))
    first = stream.filter("lead").join(of, F.col("source").eqNullSafe(F.col("s_source")))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("s_words") - F.coalesce(at(k), F.lit(0)))) for k in range(passes)), F.lit(0)).cast("long")
    first = first.withColumn("taken", taken).withColumn("upto_words", F.when(F.col("taken") > 0, F.least(F.col("upto"), budget)))
    return first.select(*back, "upto_words")


def served(mixed: DataFrame) -> DataFrame:
    """The stream of whole documents: each row as often as the mix takes it (a part of half or more
    counts as one, a row without words comes once), range-sorted by virtual finish time. Repeated rows
    are rows of their own; ties stand in the order of doc_id; an empty table gives an empty one."""
    rows, back = covered(mixed, "doc_id", "mix_size", "source_size", "target", "taken", "finish")
    copies = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("mix_size") + 0.5)).cast("int")
    rows = rows.withColumn("n", copies).filter("n > 0").withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    time = F.coalesce(F.col("finish") + F.col("k") * F.col("source_size") / F.col("target"), F.lit(0.0))
    return rows.withColumn("time", time).orderBy("time", "doc_id").select(*back)
