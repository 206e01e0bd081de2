"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.session import bounded_collect, cut

#: Tokens that one packing task places.
TOKENS_PER_TASK = 500_000

#: Containers at the end of a task, short of small items to fill them, that are packed anew together with those of other tasks,
#: and how many tasks' such containers meet in one task.
REOPENED, TASKS_TOGETHER = 8, 16

MOST_PARTITIONS = 20_000

#: A capacity table is a handful of rows at every scale; more than this is an error.
MAX_CAPACITIES = 1_000

COLUMNS = ["container_kind", "container_id", "id", "part_no", "start_token", "n_tokens"]


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item.

    ``sizes`` is items x dimensions, ``limits`` the capacity of each dimension; no item may exceed it. One container is
    open at a time. It takes the item with the greatest dot product of the item's and the container's remaining share of each
    capacity among those that fit in all dimensions, until none fits. Items of equal sizes form a class, so that a step
    costs the number of distinct sizes, not of items. Zero sizes always fit.
    """
    at = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return at
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    start = np.concatenate([[0], np.cumsum(left)[:-1]])
    worth = kinds / np.maximum(limits, 1)
    alive = np.arange(len(kinds))
    box, placed = 0, 0
    while placed < len(sizes):
        room = limits.astype(np.float64).copy()
        fitting = alive
        while True:
            fitting = fitting[(kinds[fitting] <= room).all(axis=1)]
            if not len(fitting):
                break
            best = fitting[np.argmax(worth[fitting] @ (room / np.maximum(limits, 1)))]
            left[best] -= 1
            at[order[start[best] + left[best]]] = box
            placed += 1
            room -= kinds[best]
            if not left[best]:
                fitting = fitting[fitting != best]
                alive = alive[alive != best]
        box += 1
    return at


def _limits(capacity: int, max_segments: int | None, loss_share: float | None) -> np.ndarray:
    return np.array([capacity, max_segments or np.iinfo(np.int64).max, capacity if loss_share is None else max(1, int(capacity * loss_share))], np.float64)


def split_oversized(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start token, length) of every part; only an item above the capacity has more than one."""
    parts = np.maximum(1, -(-tokens // capacity))
    item = np.repeat(np.arange(len(tokens)), parts)
    number = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = number * capacity
    return item, start, np.minimum(capacity, tokens[item] - start)


def fill_containers(
    items: DataFrame,
    capacities: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    loss_col: str | None = None,
    max_segments: int | None = None,
    loss_share: float | None = None,
    tokens_per_task: int = TOKENS_PER_TASK,
) -> DataFrame:
    """Columns ``container_kind, container_id, <id_col>, part_no, start_token, n_tokens``: a row for each part of each item and kind.

    The limits of a container are its ``capacity_tokens``, ``max_segments`` (none if not given) and the loss-bearing
    tokens (``loss_share`` of the capacity, all of it if not given; ``loss_col`` has an item's, all its tokens if not given; a part
    has its share; what alone bears more than the limit takes a container's whole budget of loss). Only an
    item above the capacity is split, into full parts and a rest. Items are dealt to tasks of about ``tokens_per_task``
    tokens by a hash of their position, whatever their key, so no source or id makes a hot task. The last containers of the
    tasks are packed anew together, again and again by :data:`TASKS_TOGETHER`, so what tasks leave unfilled does not grow with their number.

    A null size counts as 0; an item of no tokens takes a segment of some container; null and repeated ids are items of their own;
    a capacity that is null or below 1 is left out, of several for a kind the least holds, and none at all is an error. No items give no rows; other columns are not read.
    """
    capacity_of: dict[str | None, int] = {}
    for kind, capacity in bounded_collect(capacities.select("container_kind", "capacity_tokens"), MAX_CAPACITIES, "the table of capacities"):
        if capacity is not None and capacity > 0:
            capacity_of[kind] = min(capacity, capacity_of.get(kind, capacity))
    kinds = list(capacity_of.items())
    if not kinds:
        raise ValueError("no capacity of 1 or more")
    loss = F.col(loss_col) if loss_col else F.col(size_col)
    narrow = cut(
        items.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("tokens"), F.coalesce(loss, F.lit(0)).cast("long").alias("loss")
        )
    )
    total = narrow.agg(F.sum("tokens")).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    # The position in the checkpointed rows is stable, and spreads repeated or null ids.
    dealt = narrow.withColumn("task", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)))
    id_type = narrow.schema["id"].dataType.simpleString()
    schema = f"container_kind string, container_id string, id {id_type}, part_no int, start_token long, n_tokens long, loss long, task long, open boolean"

    def placed(kind: str, capacity: int, name: str, task: int, ids: pa.ChunkedArray, part: np.ndarray, start: np.ndarray, n: np.ndarray, bearing: np.ndarray) -> pa.Table:
        limits = _limits(capacity, max_segments, loss_share)
        box = pack(np.column_stack([n, np.ones(len(n), np.int64), np.minimum(bearing, int(limits[2]))]), limits)
        names = pa.array([f"{kind}-{name}-{b}" for b in box.tolist()], pa.string())
        last = box > box.max(initial=0) - REOPENED
        cols = [pa.array([kind] * len(n), pa.string()), names, ids, pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(bearing, pa.int64())]
        return pa.table([*cols, pa.array(np.full(len(n), task), pa.int64()), pa.array(last, pa.bool_())], names=[*COLUMNS, "loss", "task", "open"])

    def first(group: pa.Table) -> pa.Table:
        task, ids = group.column("task")[0].as_py(), group.column("id")
        tokens, lossy = group.column("tokens").to_numpy(), group.column("loss").to_numpy()
        out = []
        for kind, capacity in kinds:
            item, start, n = split_oversized(tokens, capacity)
            whole = np.maximum(tokens[item], 1)
            bearing = (lossy[item] * (start + n)) // whole - (lossy[item] * start) // whole
            out.append(placed(kind, capacity, str(task), task, ids.take(pa.array(item)), start // capacity, start, n, bearing))
        return pa.concat_tables(out)

    def again(level: int):
        def run(group: pa.Table) -> pa.Table:
            kind, task = group.column("container_kind")[0].as_py(), group.column("task")[0].as_py()
            part, start, n, bearing = (group.column(c).to_numpy() for c in ("part_no", "start_token", "n_tokens", "loss"))
            return placed(kind, capacity_of[kind], f"{task}r{level}", task, group.column("id"), part, start, n, bearing)

        return run

    # By number, as a shuffle of few bytes would be read by one task.
    filled, done, level = dealt.repartition(min(tasks, MOST_PARTITIONS), "task").groupBy("task").applyInArrow(first, schema), [], 0
    while tasks > 1:
        filled = cut(filled)
        done.append(filled.where("not open"))
        rest = filled.where("open").withColumn("task", F.floor(F.col("task") / TASKS_TOGETHER))
        tasks, level = -(-tasks // TASKS_TOGETHER), level + 1
        filled = rest.repartition(min(tasks * len(kinds), MOST_PARTITIONS), "container_kind", "task").groupBy("container_kind", "task").applyInArrow(again(level), schema)
    for part in done:
        filled = filled.unionByName(part)
    return filled.select(*COLUMNS).withColumnRenamed("id", id_col)


def fill_report(filled: DataFrame, capacities: DataFrame) -> DataFrame:
    """By kind: containers, the least number that any packing needs (tokens over capacity), tokens, and the unused share."""
    bounded_collect(capacities, MAX_CAPACITIES, "the table of capacities")  # so it may be broadcast
    used = filled.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(capacities.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )
