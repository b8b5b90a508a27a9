"""Python functions on columns, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, where the session has more: a worker holds a batch's bodies and all that is parsed of them at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def _small_batches() -> None:
    spark = SparkSession.getActiveSession()
    for name, most in BATCH.items() if spark else ():
        value = spark.conf.get(name)
        size = 0 if value.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)
        if not 0 < size <= most:  # Spark has no limit at 0 and below
            spark.conf.set(name, str(most))


def arrow(f: Callable, kind: str, once: bool = False) -> Callable:
    """F.udf, put off until it is called: a type's text can be read only once there is a session. Lowers the session's BATCH.

    once: a filter on what it gives isn't moved below it. Spark would call it there again, in a Python worker more for each task.
    """

    def call(*columns):
        _small_batches()
        made = F.udf(f, kind, useArrow=True)
        return (made.asNondeterministic() if once else made)(*columns)

    return call


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over the session's shuffle partitions: for Python that takes far longer than its rows are large, as a small file is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
