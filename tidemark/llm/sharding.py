"""Sharding: global byte offsets from per-partition totals, cut at equal targets into contiguous shards.

Law `bytes`: the order of the scan is kept, a row goes where the middle of its bytes falls, so a
shard's size differs from total / shards by at most about the two rows at its ends.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, save


RUNNING = "__part int, __before long, __index long"


def running(batches, size: str):
    """The batches of one partition with its number, and the sum of size and the number of rows before each row in it."""
    part, total, seen = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n, sums = b.num_rows, pc.cumulative_sum(b.column(size))
        if not n:
            continue
        before = pc.add(pc.subtract(sums, b.column(size)), total)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([part] * n, pa.int32()), before, pa.array(range(seen, seen + n), pa.int64())], [*b.schema.names, "__part", "__before", "__index"]
        )
        total, seen = total + sums[-1].as_py(), seen + n


def global_offsets(df: DataFrame, size: str, label: str) -> tuple[DataFrame, int, int]:
    """df (with running()'s columns), saved, with the sum of size and the number of rows before each row in the whole table; and both totals.

    The totals of partitions, one row for each task of the scan, are all that the driver sees.
    """
    saved = save(df, label)
    parts = sorted(tuple(r) for r in saved.groupBy("__part").agg(F.sum(size), F.count("*")).collect())
    bases, bytes_, rows = [], 0, 0
    for part, b, n in parts:
        bases.append((part, bytes_, rows))
        bytes_, rows = bytes_ + b, rows + n
    base = df.sparkSession.createDataFrame(bases, "__part int, __bytes long, __rows long")
    out = saved.join(F.broadcast(base), "__part", "left")
    return (
        out.withColumn("__before", F.col("__before") + F.col("__bytes")).withColumn("__index", F.col("__index") + F.col("__rows")).drop("__part", "__bytes", "__rows"),
        bytes_,
        rows,
    )


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes and size 1, as an empty one. Repeated rows are placed one by one; a
    null key is kept. An empty table gives an empty one; with fewer rows than shards, some shards
    stay empty. A row of more bytes than a shard's target makes its shard that much larger.
    """
    kind = dict(docs.dtypes)[key]
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    sums = in_arrow(narrow, lambda batches: running(batches, "size"), f"key {kind}, size long, crc long, {RUNNING}")
    placed, total, _ = global_offsets(sums, "size", "shards")
    middle = F.col("__before") * 2 + F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(1, 2 * total))), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("__index").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("__index") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
