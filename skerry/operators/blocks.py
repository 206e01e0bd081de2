"""A batch of queries against all rows: the queries as one block beside every partition of rows, or blocks against blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import cut

#: Numbers in the broadcast block of queries at most; more queries than that are sent in several blocks.
BROADCAST_NUMBERS = 4_000_000

#: Results that a partition keeps for a block of queries at most, and results that wait until they are sorted in.
KEPT, WAITING = 2_500_000, 500_000

#: Blocks of queries that are sent at most; beyond, queries go block against block.
MOST_SENT = 64

#: Rows of a block where both sides are cut.
BLOCK = 2_048

#: Cells of a matrix of queries by rows that a scan holds at once.
CELLS = 2_000_000

#: Of queries and rows, with the value of each query beyond which no result counts any more, or none.
Scan = Callable[[pa.Table, pa.Table, np.ndarray | None], Iterator[pa.RecordBatch]]


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def first_of_each_line(far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k least values of each line, by value, then column; infinite ones are left out."""
    take = min(k, far.shape[1])
    if not take:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Ties at the border go by column: all that are as near as the k-th, then the first by (value, column).
    border = np.partition(far, take - 1, axis=1)[:, take - 1 : take]
    line, col = np.nonzero((far <= border) & np.isfinite(far))
    order = np.lexsort((col, far[line, col], line))
    line, col = line[order], col[order]
    keep = np.arange(len(line)) - np.searchsorted(line, np.arange(len(far)))[line] < k
    return line[keep], col[keep]


def _by_pack(queries: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, pa.Table, pa.Table]]:
    """The queries (sorted by pack) of each pack, where they stand, and its rows; all as one where the tables have no packs."""
    if "pack" not in rows.column_names:
        yield slice(0, queries.num_rows), queries, rows
        return
    asked, held = (t.column("pack").to_numpy() for t in (queries, rows))
    for pack in np.unique(held):
        first, end = (int(np.searchsorted(asked, pack, side)) for side in ("left", "right"))
        if end > first:
            yield slice(first, end), queries.slice(first, end - first), rows.filter(pa.array(held == pack))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


class Best:
    """Of each query (by its line) the ``most`` results of least value, equal ones by record.

    Its size is that of what it keeps, whatever is offered. ``border`` has the value of each line beyond which no result enters.
    """

    def __init__(self, lines: int, most: int):
        self.most, self.border = most, np.full(lines, np.inf)
        self.value, self.record = np.full((lines, most), np.inf), np.full((lines, most), np.iinfo(np.int64).max)
        self.waiting, self.size = [], 0

    def offer(self, line: np.ndarray, record: np.ndarray, value: np.ndarray) -> None:
        self.waiting.append((line.astype(np.int32), record, value))
        self.size += len(line)
        if self.size >= WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        line, record, value = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        order = np.argsort(line, kind="stable")
        line, record, value = line[order], record[order], value[order]
        lines, start = np.unique(line, return_index=True)
        start = np.append(start, len(line))
        for at in range(0, len(lines), step := max(1, WAITING // self.most)):
            some, new = lines[at : at + step], slice(start[at], start[min(at + step, len(lines))])
            who = np.concatenate([np.repeat(np.arange(len(some)), self.most), np.searchsorted(some, line[new])])
            v, r = np.concatenate([self.value[some].ravel(), value[new]]), np.concatenate([self.record[some].ravel(), record[new]])
            order = np.lexsort((r, v, who))
            take = order[np.searchsorted(who[order], np.arange(len(some)))[:, None] + np.arange(self.most)]
            self.value[some], self.record[some] = v[take], r[take]
            self.border[some] = v[take[:, -1]]

    def results(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(line, record, value) of all that is kept, some lines at a time."""
        self.settle()
        for at in range(0, len(self.border), step := max(1, WAITING // 4 // self.most)):
            line, col = np.nonzero(np.isfinite(self.value[at : at + step]))
            yield at + line, self.record[at + line, col], self.value[at + line, col]


def against_all(queries: DataFrame, rows: DataFrame, scan: Scan, schema: str, numbers: int, keep: tuple[str, int, bool] | None = None) -> DataFrame:
    """``scan`` of every query with every row, in parts whose results the caller merges.

    With ``keep`` (value column, most, whether the greatest are best) a partition sends only its best of each query, over all of its batches.

    A query holds about ``numbers`` numbers. Queries within :data:`BROADCAST_NUMBERS`, whose results are within :data:`KEPT`, are sent to every partition, which reads
    its rows once and in batches; more are sent in several blocks, each of which reads the rows once. Beyond :data:`MOST_SENT` of these they are cut in blocks that meet
    each block of rows in a task. Where both have a column ``pack``, only equal packs meet. A column ``query_id`` and one ``record_id`` are needed. Results are the same in any way.
    """
    most = BROADCAST_NUMBERS // max(1, numbers)
    if keep and most:
        most = max(1, min(most, KEPT // keep[1]))
    head = queries.limit(most + 1).toArrow()
    sign = -1.0 if keep and keep[2] else 1.0
    keys = [(c, "ascending") for c in ("pack", "query_id") if c in queries.columns]

    def sent(block: pa.Table) -> DataFrame:
        shipped = rows.sparkSession.sparkContext.broadcast(block.sort_by(keys).combine_chunks())

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shipped.value
            if not asked.num_rows:
                return
            ids, best = asked.column("query_id").to_numpy(), keep and Best(asked.num_rows, keep[1])
            for batch in batches:
                for lines, some, part in _by_pack(asked, pa.Table.from_batches([batch])) if batch.num_rows else ():
                    for found in scan(some, part, best and best.border[lines]):
                        if not best:
                            yield found
                            continue
                        query, record, value = (found.column(c).to_numpy() for c in ("query_id", "record_id", keep[0]))
                        best.offer(lines.start + np.searchsorted(ids[lines], query), record, sign * value)
            for line, record, value in best.results() if best else ():
                yield pa.RecordBatch.from_arrays([pa.array(ids[line]), pa.array(record), pa.array(sign * value)], names=["query_id", "record_id", keep[0]])

        return wide.mapInArrow(beside, schema)

    # What is sent grows with the partitions, so there are no more of them than cores.
    cores, wide = rows.sparkSession.sparkContext.defaultParallelism, rows
    if keep and rows.rdd.getNumPartitions() > cores:
        wide = rows.coalesce(cores)
    if head.num_rows <= most:
        return sent(head)
    if most:
        queries = cut(queries)
        n_sent = -(-queries.count() * 5 // (most * 4))
        if n_sent <= MOST_SENT:
            group, out = F.pmod(F.xxhash64("query_id"), F.lit(n_sent)), None
            for i in range(n_sent):
                one = sent(queries.where(group == i).toArrow())
                out = one if out is None else out.unionByName(one)
            return out
    # Columns by new names inside, as both sides may come from one table.
    queries, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, rows))
    n_query, n_row = -(-queries.count() // BLOCK), max(1, -(-rows.count() // BLOCK))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query))).withColumn("rb", F.explode(_numbers(n_row)))
    right = rows.withColumn("qb", F.explode(_numbers(n_query))).withColumn("rb", F.pmod(F.xxhash64("record_id"), F.lit(n_row)))
    empty = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = [f for _, some, part in _by_pack(a.sort_by(keys), b) for f in scan(some, part, None)] if a.num_rows and b.num_rows else []
        return pa.Table.from_batches(found) if found else empty.empty_table()

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, schema)
