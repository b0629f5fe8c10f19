"""Written tables in the cluster's shared folder, and tables whose columns can't clash with ours."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import shared_dir
from tessella.storage import written as stored

__all__ = ["covered", "shared_dir", "stored"]


def covered(frame: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``frame`` with all columns but the ``used`` ones named in0, in1, and so on, and the columns that give it its own names back."""
    names = {c: c if c in used else f"in{k}" for k, c in enumerate(frame.columns)}
    return frame.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]
