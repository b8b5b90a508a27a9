"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, tasks_for

SALTS = 16


class Groups:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


#: Links that a task contracts at once.
GATHER = 250_000


def _forests(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes, each to the smallest of those that GATHER links connect: stars, and fewer of them."""

    def contracted(held):
        a, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, c]), return_inverse=True)
        groups = Groups(len(nodes))
        for x, y in set(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
            groups.join(x, y)
        first = nodes[[groups.find(i) for i in range(len(nodes))]] if len(nodes) else nodes
        own = first != nodes
        return pa.RecordBatch.from_arrays([pa.array(first[own]), pa.array(nodes[own])], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= GATHER:
                yield contracted(held)
                held, size = [], 0
        if held:
            yield contracted(held)

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all ends of the links (a, b): label is the smallest node reachable.

    Each round a node takes the smallest label around it, then its label's label, so the rounds grow
    with the logarithm of a component's diameter. Rounds are saved; minima combine before shuffles.
    """
    stars = save(_forests(links.select("a", "b").filter("a != b")), "stars")
    tasks = tasks_for(stars.count())
    both = save(stars.union(stars.select("b", "a")).distinct().coalesce(tasks), "links")
    labels = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").coalesce(tasks), "labels")
    while True:
        near = looked_up(both, "b", labels, "label").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node").coalesce(tasks), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = looked_up(lower, "label", labels.withColumnRenamed("label", "up"), "up", left=True)
        nxt = save(up.select("node", "old", F.least(F.coalesce("up", "label"), "label").alias("label")).coalesce(tasks), "labels")
        labels = nxt.select("node", "label")
        if nxt.filter("old != label").isEmpty():
            return labels


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, left: bool = False) -> DataFrame:
    """rows with the value that the table (node, value) has for a key of theirs.

    A key may be that of all rows, as the label of a large component is: its value goes to SALTS parts.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    asked = salted.select(F.col(key).alias("node"), "__salt").distinct().join(table, "node").select(F.col("node").alias(key), "__salt", value)
    return salted.join(asked, [key, "__salt"], "left" if left else "inner").drop("__salt")
