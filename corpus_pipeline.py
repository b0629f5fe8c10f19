"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, shards.

Each stage takes the Parquet that the one before wrote, works on every row of it and, but for the
last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.decontaminate import contamination
from tessella.llm.mixing import mix, served
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.sharding import shard
from tessella.llm.storage import covered, shared_dir, stored
from tessella.llm.toxicity import fit_toxicity, score_toxicity

SHINGLE_WORDS, SIMILARITY_PERCENT, WINDOW_WORDS, SHARDS = 5, 80, 10, 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; it learns from labelled rows outside the held-out fifth.

    Null and empty texts have the score of no features. Repeated rows are scored each. If the labels
    don't show both classes, nothing tells documents apart, and all stay. An empty table gives an
    empty one; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = fit_toxicity(docs, labels.filter(learn))
    if not len(model.weights):
        return docs
    rows, back = covered(docs, "doc_id", "text")
    return score_toxicity(rows, model).filter("score < 0.5").select(*back)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    rows, back = covered(docs, "doc_id", "text")
    return rows.withColumn("key", F.xxhash64("text")), back


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents without words stay.

    Null and empty texts are in no group, so all stay, repeated rows too. Of rows that repeat the one
    that stays, one stays. A document without an id stays only if none of its group has one. An empty
    table gives an empty one; other columns pass through.
    """
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    alone = found.filter("node is null").select("doc_id", "text_key")
    one = found.filter("kept and node is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    keep = stored(one.withColumn("once", F.lit(True)).union(alone.withColumn("once", F.lit(False)).distinct()), "keep").withColumnRenamed("doc_id", "k_id")
    rows, back = _keyed(docs)
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("text_key")))
    copy = F.row_number().over(Window.partitionBy("k_id", "text_key").orderBy(F.lit(1)))
    return rows.withColumn("copy", copy).filter("copy = 1 or not once").select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage occurs go.

    Null and empty texts have no words and stay; each repeated row is judged like the first. An empty
    table gives an empty one, an empty benchmark keeps all; other columns pass through.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW_WORDS)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("h_id"), "text_key").distinct()
    rows, back = _keyed(docs)
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("text_key")), "left_anti").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order in which it serves them.

    Null and empty texts have no words and come once; a null source is one source. Repeated rows are
    documents of their own; ties in time stand in the order of doc_id. An empty table gives an empty one.
    """
    return served(mix(docs)).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there, and its size and checksum.

    Null texts are a group of size 8, empty ones another; repeated rows have slots of their own. An empty
    table gives an empty one. A column shard, slot, shard_size or text_crc32 is replaced, others pass through.
    """
    return shard(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: The first stage's classifier cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
