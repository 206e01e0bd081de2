"""Running sums and predecessors over any order, by ranges: no task holds a group or the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.session import cut

PART = "_part"


def in_ranges(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``columns``, with the number of each row's range in ``_part``; a large group spans several.

    Ranges are as many as the sizes ask for, unless ``parts`` are given.
    """
    # Checkpointed: a second run of the range exchange may sample other borders.
    return cut(df.repartitionByRange(*([parts] if parts else []), *[F.col(c) for c in columns]).withColumn(PART, F.spark_partition_id()))


def sums_before(ranged: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``ranged`` (of :func:`in_ranges` by ``by`` and ``order``) with the sum of ``value`` over the rows of the group that come before.

    Each range is summed apart; of a group that began in an earlier range, at most one a range, the sum so far is added.
    """
    known = ranged.withColumn("_value", value)
    within = F.sum("_value").over(Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = known.groupBy(PART, *by).agg(F.sum("_value").alias("_sum"))
    # A group has a row a range here, and rows without a sum before them leave: a row a range stays at most.
    carried = sums.withColumn("_carried", F.sum("_sum").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("_carried is not null").select(F.col(PART).alias("_at"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_carried")
    on = F.col(PART) == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = known.withColumn("_within", within).join(F.broadcast(carried), on, "left")
    return joined.withColumn(name, F.coalesce("_within", F.lit(0)) + F.coalesce("_carried", F.lit(0))).select(*ranged.columns, name)


def last_before(ranged: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranged`` with ``value`` of the row before in the group, null for the first; values are not null."""
    within = F.lag(value).over(Window.partitionBy(PART, *by).orderBy(*order))
    ends = ranged.groupBy(PART).agg(F.max_by(F.struct(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(value).alias("_last")), F.struct(*by, *order)).alias("e"))
    before = ends.select(F.col(PART).alias("_at"), F.lag("e").over(Window.orderBy(PART)).alias("e")).select("_at", "e.*")  # a row a range
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = ranged.withColumn("_within", within).join(F.broadcast(before), F.col(PART) == F.col("_at"), "left")
    # The first row of a range has no row before it there; only the range's first group goes on from the range before.
    return joined.withColumn(name, F.coalesce("_within", F.when(same, F.col("_last")))).select(*ranged.columns, name)
