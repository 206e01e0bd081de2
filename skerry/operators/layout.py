"""How rows lie on storage: runs that one read fetches, and an order of clusters that keeps neighbours together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coalesced_runs(wanted: DataFrame, by: str, gap: int) -> DataFrame:
    """``<by>, runs, rows, span``: reads that fetch each query's wanted rows if gaps of up to ``gap`` rows are read over."""
    w = Window.partitionBy(by).orderBy("record_id")
    new = (F.col("record_id") - F.lag("record_id").over(w) > gap + 1) | F.lag("record_id").over(w).isNull()
    marked = wanted.withColumn("run", F.sum(new.cast("int")).over(w))
    runs = marked.groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"), (F.max("record_id") - F.min("record_id") + 1).alias("width"))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rows"), F.sum("width").alias("span"))


def chain_order(centres: np.ndarray) -> list[int]:
    """Cluster numbers, each followed by the nearest one not yet placed; clusters are few, so this runs on the driver."""
    left = set(range(1, len(centres)))
    order = [0] if len(centres) else []
    while left:
        near = centres @ centres[order[-1]]
        order.append(min(left, key=lambda i: (-near[i], i)))
        left.remove(order[-1])
    return order


def permuted(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``rows`` with the new position that ``order`` (record_id, new_id) gives."""
    return rows.join(order, "record_id").drop("record_id").withColumnRenamed("new_id", "record_id")
