"""Tables and folders that every machine of the cluster can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this process has had written, for `drop_stored`.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a session of one machine gets a folder of its own; a cluster has none that all could read."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every machine of the cluster can read")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables and folders that this process has written to the shared folder; their number. Results that still read them can't be run again."""
    paths, _written[:] = list(_written), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    A lost executor costs nothing then: the files belong to no executor, and what was read
    before them need not run again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same, never broadcast: Spark judges a table by its files, and runs, labels and sums are many times larger in memory."""
    return written(df, name).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by the keys to as many partitions as shuffles have. For rows that are small but costly: Spark would put them together by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
