"""Nearest neighbours: exact in blocks, filtered, two-stage over sketches, and the index as a table with deletions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.errors import require
from skerry.functions import vector as V
from skerry.operators import blocks, ordered
from skerry.session import cut

#: Distances count to this many decimals; equal ones are ordered by record.
DECIMALS = 9

_SCHEMA = "query_id long, record_id long, distance double"


def _hits(query_ids: np.ndarray, row_ids: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(row_ids, pa.int64()), pa.array(far, pa.float64())], names=["query_id", "record_id", "distance"])


def _far(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows. Each pair is summed by itself, so no block shape shows in the result."""
    if metric == "cosine":
        return np.round(1 - np.clip(np.einsum("ij,ij->i", a, b), -1, 1), DECIMALS)
    return np.round(np.sqrt(np.einsum("ij,ij->i", a - b, a - b)), DECIMALS)


def _nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, metric: str, skip_self: bool) -> Iterator[pa.RecordBatch]:
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    square = (rows**2).sum(1)
    for at in range(0, len(queries), step := max(1, blocks.CELLS // max(1, len(rows)))):
        some, own = queries[at : at + step], query_ids[at : at + step]
        # A product of matrices finds who may be among the first; its last digits depend on the shape, so it does not settle who is.
        product = some @ rows.T
        rough = -product if metric == "cosine" else (some**2).sum(1)[:, None] + square[None] - 2 * product
        if skip_self:
            rough[own[:, None] == row_ids[None, :]] = np.inf
        take = min(k, rough.shape[1])
        border = np.partition(rough, take - 1, axis=1)[:, take - 1 : take]
        slack = 4 * 10.0**-DECIMALS if metric == "cosine" else 1e-11 * (1 + square.max(initial=0) + np.abs(border)) + 4 * 10.0**-DECIMALS * np.sqrt(np.maximum(border, 0))
        line, col = np.nonzero((rough <= border + np.where(np.isfinite(border), slack, 0)) & np.isfinite(rough))
        far = np.concatenate([_far(some[line[i : i + 50_000]], rows[col[i : i + 50_000]], metric) for i in range(0, len(line), 50_000)] or [np.zeros(0)])
        sort = np.lexsort((col, far, line))
        line, col, far = line[sort], col[sort], far[sort]
        keep = np.arange(len(line)) - np.searchsorted(line, np.arange(len(some)))[line] < k
        yield _hits(own[line[keep]], row_ids[col[keep]], far[keep])


def ranked(pairs: DataFrame, k: int | None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "record_id"))
    numbered = pairs.withColumn("vec_rank", place - 1)
    return numbered if k is None else numbered.where(F.col("vec_rank") < k)


def _pack(df: DataFrame) -> list[str]:
    return ["pack"] if "pack" in df.columns else []


def exact_knn(queries: DataFrame, rows: DataFrame, k: int, dim: int, metric: str = "cosine", skip_self: bool = False, allowed: DataFrame | None = None, masked: DataFrame | None = None) -> DataFrame:
    """``query_id, record_id, distance, vec_rank`` (from 0): the k nearest rows of each query, ties by lower id.

    ``queries`` has query_id and vector, ``rows`` record_id and vector, of length 1 for cosine. ``allowed`` and ``masked``
    (record_id) restrict the rows before the cut, so a row that is out takes no place. Each partition of rows sends k rows
    a query to the one shuffle.
    """
    require(k > 0, "k must be positive")
    require(metric in ("cosine", "l2"), "metric is cosine or l2")
    if allowed is not None:
        rows = rows.join(allowed, "record_id", "left_semi")
    if masked is not None:
        rows = rows.join(masked, "record_id", "left_anti")
    rows = rows.select(F.col("record_id").cast("long"), V.doubles(F.col("vector")).alias("vector"), *_pack(rows)).where(F.size("vector") == dim)
    queries = queries.select(F.col("query_id").cast("long"), V.doubles(F.col("vector")).alias("vector"), *_pack(queries)).where(F.size("vector") == dim)

    def scan(q: pa.Table, r: pa.Table, border: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        yield from _nearest(blocks.matrix(q.column("vector"), dim), q.column("query_id").to_numpy(), blocks.matrix(r.column("vector"), dim), r.column("record_id").to_numpy(), k, metric, skip_self)

    return ranked(blocks.against_all(queries, rows, scan, _SCHEMA, dim, ("distance", k, False)), k)


def with_candidates(near: DataFrame, extra: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``near`` with the extra pairs (query_id, record_id) at their exact cosine distances, ranked anew.

    Vectors meet only for the few extra pairs of each query, each side by one join.
    """
    pairs = extra.select("query_id", "record_id").join(near.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")
    ask = queries.select("query_id", V.doubles(F.col("vector")).alias("qv"))
    both = pairs.join(ask, "query_id").join(rows.select("record_id", V.doubles(F.col("vector")).alias("rv")), "record_id")
    more = both.select("query_id", "record_id", F.round(V.cosine_distance(F.col("qv"), F.col("rv")), DECIMALS).alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "record_id"))
    return near.select("query_id", "record_id", "distance").unionByName(more).withColumn("vec_rank", place - 1)


def rerank_depth(live: int, k: int, rerank: int | None = None, recommended: int | None = None) -> int:
    """How many sketch candidates are ranked exactly."""
    return min(live, max(k, rerank or min(recommended or 0, 4096) or max(100, 10 * k)))


def coded(rows: DataFrame, pool: int, bits: int = 4) -> DataFrame:
    """``record_id, q, scale, offset, sum_q, sum_q2, sketch``: the columns that a coded index stores."""

    def with_sketch(c: Column) -> Column:
        fields = [c[f].alias(f) for f in ("q", "scale", "offset", "sum_q", "sum_q2")]
        return F.struct(*fields, V.sketched(c["q"], pool, bits).alias("sketch"))

    code = V.let(V.quantized(V.normalized(V.doubles(F.col("vector")))), with_sketch)
    # One generator keeps the struct from being computed again for each of its fields.
    return rows.select("record_id", *_pack(rows), F.inline(F.array(code)))


def sketch_matrix_distances(query: np.ndarray, sketch: np.ndarray, scale: np.ndarray, offset: np.ndarray, pool: int, bits: int, metric: str = "cosine") -> np.ndarray:
    values = offset[:, None] + scale[:, None] * (sketch * (17.0 if bits == 4 else 1.0))
    means = query.reshape(len(query), -1, pool).mean(axis=2)
    if metric == "cosine":
        return np.round(1 - np.clip(pool * (means @ values.T), -1, 1), DECIMALS)
    return np.round(np.maximum(0, (means**2).sum(1)[:, None] + (values**2).sum(1)[None] - 2 * means @ values.T), DECIMALS)


def sketch_candidates(queries: DataFrame, index: DataFrame, dim: int, pool: int, depth: int, bits: int = 4, metric: str = "cosine") -> DataFrame:
    """``query_id, record_id, distance, vec_rank``: the ``depth`` rows of each query that are nearest by their sketches."""

    def scan(q: pa.Table, r: pa.Table, border: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        ids, asked = q.column("query_id").to_numpy(), blocks.matrix(q.column("vector"), dim)
        rows = r.column("record_id").to_numpy()
        order = np.argsort(rows, kind="stable")
        rows, sketch = rows[order], blocks.matrix(r.column("sketch"), dim // pool)[order]
        scale, offset = (r.column(c).to_numpy()[order] for c in ("scale", "offset"))
        for at in range(0, len(ids), step := max(1, blocks.CELLS // max(1, len(rows)))):
            far = sketch_matrix_distances(asked[at : at + step], sketch, scale, offset, pool, bits, metric)
            near = far <= (np.inf if border is None else border[at : at + step, None])
            line, col = np.nonzero(near) if np.count_nonzero(near) <= 8 * depth * len(far) else blocks.first_of_each_line(far, depth)
            yield _hits(ids[at + line], rows[col], far[line, col])

    table = index.select(F.col("record_id").cast("long"), "sketch", "scale", "offset", *_pack(index))
    return ranked(blocks.against_all(queries, table, scan, _SCHEMA, dim, ("distance", depth, False)), depth)


def asked(queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """``query_id, vector`` (and ``pack``) of queries, of length 1 for cosine."""
    vector = V.doubles(F.col("vector"))
    return queries.select(F.col("query_id").cast("long"), (V.normalized(vector) if metric == "cosine" else vector).alias("vector"), *_pack(queries))


def two_stage_knn(
    queries: DataFrame, index: DataFrame, k: int | None, dim: int, pool: int, depth: int, bits: int = 4, extra: DataFrame | None = None, masked: DataFrame | None = None, metric: str = "cosine"
) -> DataFrame:
    """``query_id, record_id, distance, vec_rank``: candidates by sketch distance, then exact ranking of the coded rows; all of them if k is None.

    ``index`` is from :func:`coded`; ``extra`` (query_id, record_id) joins the candidates; ``masked`` (record_id) leaves before the
    cut. Only sketches meet all queries; codes are read for candidates.
    """
    if masked is not None:
        index = index.join(masked.select("record_id"), "record_id", "left_anti")
    ask = asked(queries, metric)
    candidates = sketch_candidates(ask, index, dim, pool, depth, bits, metric).select("query_id", "record_id")
    if extra is not None:
        candidates = candidates.union(extra.select("query_id", "record_id")).distinct()
    return rerank(candidates, ask, index, k, metric)


def rerank(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int | None, metric: str = "cosine") -> DataFrame:
    """The candidates (query_id, record_id) at the exact distances of their coded rows; ``queries`` are of :func:`asked`.

    Codes go to candidates by one join. The vectors of a batch of queries are sent to every partition, so that no shuffle carries a code or a vector
    for each candidate; larger batches (:data:`blocks.BROADCAST_NUMBERS`) and those of repeated ids are joined, too.
    """
    exact = candidates.select("query_id", "record_id").join(index.select("record_id", "q", "scale", "offset"), "record_id")
    queries = queries.select("query_id", "vector")
    first = queries.first()
    most = blocks.BROADCAST_NUMBERS // max(1, len(first["vector"]) if first else 1)
    head = queries.limit(most + 1).toArrow()
    ids = head.column("query_id").to_numpy()
    shipped = None
    if 0 < head.num_rows <= most and len(np.unique(ids)) == len(ids):
        order = np.argsort(ids)
        shipped = queries.sparkSession.sparkContext.broadcast((ids[order], blocks.matrix(head.column("vector"), len(first["vector"]))[order]))
        exact = exact.where(F.col("query_id").isNotNull())
    else:
        exact = exact.join(queries, "query_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            query = part.column("query_id").to_numpy()
            if shipped is not None:
                names, vectors = shipped.value
                at = np.minimum(np.searchsorted(names, query), len(names) - 1)
                known = names[at] == query
                part, query, y = part.filter(pa.array(known)), query[known], vectors[at[known]]
            dim = len(part.column("q")[0]) if part.num_rows else 1
            if shipped is None:
                y = blocks.matrix(part.column("vector"), dim)
            if part.num_rows:
                scale, offset = (part.column(c).to_numpy()[:, None] for c in ("scale", "offset"))
                yield _hits(query, part.column("record_id").to_numpy(), _far(y, offset + scale * blocks.matrix(part.column("q"), dim), metric))

    return ranked(exact.mapInArrow(measure, _SCHEMA), k)


def staged_knn(queries: DataFrame, index: DataFrame, micro: DataFrame, k: int, dim: int, pool: int, micro_pool: int, depth: int, boost: int = 4) -> DataFrame:
    """As :func:`two_stage_knn` with a coarser tier first: the ``boost`` x ``depth`` rows nearest by ``micro`` (:func:`coded` with
    ``micro_pool``) are cut to ``depth`` by the sketches, and these ranked exactly."""
    ask = asked(queries)
    first = sketch_candidates(ask, micro, dim, micro_pool, boost * depth).select("query_id", "record_id")
    both = first.join(index.select("record_id", "sketch", "scale", "offset", "q"), "record_id").join(ask, "query_id")
    near = F.round(V.sketch_cosine(V.pooled(F.col("vector"), pool), F.col("sketch"), F.col("scale"), F.col("offset"), pool), DECIMALS)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "record_id"))
    second = both.withColumn("near", near).withColumn("place", place).where(F.col("place") <= depth)
    distance = F.round(V.asymmetric_cosine(F.col("vector"), F.col("q"), F.col("scale"), F.col("offset")), DECIMALS)
    return ranked(second.select("query_id", "record_id", distance.alias("distance")), k)


def collapse_rows(hits: DataFrame, row_to_record: Column, k: int) -> DataFrame:
    """Rows of a record as the record, with its nearest row: ``query_id, record_id, distance, row_id, vec_rank``."""
    named = hits.select("query_id", F.col("record_id").alias("row_id"), row_to_record.alias("record_id"), "distance")
    first = F.row_number().over(Window.partitionBy("query_id", "record_id").orderBy("distance", "row_id"))
    one = named.withColumn("first", first).where("first = 1").drop("first")
    return ranked(one, k)


def compacted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """``old_id, new_id``: live rows numbered densely from 0 in the order of their ids.

    Numbers come from counts by range partition, not from one sorted task.
    """
    return dense_ids(rows.join(deleted, "record_id", "left_anti").select(F.col("record_id").alias("old_id")), "old_id", "new_id")


def dense_ids(df: DataFrame, order_col: str, name: str) -> DataFrame:
    """``df`` with a dense number from 0 in the order of a unique column; ranges are numbered apart and shifted by the counts before."""
    numbered = ordered.sums_before(ordered.in_ranges(df, [order_col]), [], [order_col], F.lit(1), name)
    return numbered.withColumn(name, F.col(name).cast("long")).drop(ordered.PART)


def assigned(rows: DataFrame, centres: DataFrame, dim: int) -> DataFrame:
    """``record_id, centre, distance``: the nearest centre (centre, vector) of each row by cosine, the lower of equal ones; rows stay where they are."""

    def scan(q: pa.Table, r: pa.Table, border: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        names, some = q.column("query_id").to_numpy(), blocks.matrix(q.column("vector"), dim)
        order = np.argsort(names, kind="stable")
        far = np.round(1 - np.clip(blocks.matrix(r.column("vector"), dim) @ some[order].T, -1, 1), DECIMALS)
        best = far.argmin(axis=1)
        yield _hits(r.column("record_id").to_numpy(), names[order][best], far[np.arange(len(far)), best])

    ask = centres.select(F.col("centre").cast("long").alias("query_id"), V.doubles(F.col("vector")).alias("vector"))
    held = rows.select(F.col("record_id").cast("long"), V.doubles(F.col("vector")).alias("vector")).where(F.size("vector") == dim)
    near = blocks.against_all(ask, held, scan, _SCHEMA, dim)
    one = near.groupBy("query_id").agg(F.min(F.struct("distance", "record_id")).alias("n"))
    return one.select(F.col("query_id").alias("record_id"), F.col("n.record_id").alias("centre"), F.col("n.distance").alias("distance"))


def kmeans(rows: DataFrame, centres: DataFrame, dim: int, steps: int = 10) -> tuple[DataFrame, DataFrame]:
    """(centres, assignment) after ``steps`` rounds of cosine k-means from the given centres; an empty one stays where it was.

    Components are summed by (centre, place) before the shuffle, so a centre of a third of all rows costs its components a partition.
    """
    held = rows.select(F.col("record_id").cast("long"), V.doubles(F.col("vector")).alias("vector"))
    for _ in range(steps):
        near = assigned(held, centres, dim).join(held, "record_id")
        sums = near.select("centre", F.posexplode("vector").alias("i", "x")).groupBy("centre", "i").agg(F.sum("x").alias("x"))
        moved = sums.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("moved"))
        centres = cut(centres.select(F.col("centre").cast("long"), "vector").join(moved, "centre", "left").select("centre", V.normalized(F.coalesce("moved", V.doubles(F.col("vector")))).alias("vector")))
    return centres, assigned(held, centres, dim)


#: Depths that are tried, the recall that is enough, questions that it is measured with, and the greatest depth that may be recommended.
LADDER = (10, 15, 20, 30, 40, 60, 80, 120, 160, 240, 320, 480, 640)
ENOUGH, MOST_ASKED, MOST_DEPTH = 0.98, 256, 4096


def depth_curve(queries: DataFrame, index: DataFrame, k: int, dim: int, pool: int) -> DataFrame:
    """``depth, recall, chosen``: recall of the two-stage search at each depth against ranking all coded rows exactly.

    At most :data:`MOST_ASKED` of the queries are asked, evenly by their order. One scan serves all depths: candidates keep their
    rank by sketch. Chosen is the least depth of enough recall, the last where none has it.
    """
    live, ask = index.count(), asked(queries)
    n = ask.count()
    if n > MOST_ASKED:
        picked = sorted({int(i * n / MOST_ASKED) for i in range(MOST_ASKED)})
        ask = dense_ids(ask, "query_id", "nth").where(F.col("nth").isin(picked)).drop("nth")
    ask = cut(ask)
    top, ceiling = min(k, live), min(live, MOST_DEPTH)
    depths = [c for c in LADDER if top <= c < ceiling] + [ceiling]
    real = index.select("record_id", V.dequantized(F.col("q").cast("array<double>"), F.col("scale"), F.col("offset")).alias("vector"))
    truth = exact_knn(ask, real, top, dim).select("query_id", "record_id", F.lit(1).alias("hit"))
    near = sketch_candidates(ask, index, dim, pool, depths[-1]).select("query_id", "record_id", "vec_rank")
    exact = rerank(near.select("query_id", "record_id"), ask, index, None).select("query_id", "record_id", "distance")
    both = cut(near.join(exact, ["query_id", "record_id"]).join(truth, ["query_id", "record_id"], "left"))
    each = both.withColumn("depth", F.explode(F.array(*[F.lit(c) for c in depths]))).where(F.col("vec_rank") < F.col("depth"))
    place = F.row_number().over(Window.partitionBy("depth", "query_id").orderBy("distance", "record_id"))
    found = each.withColumn("place", place).where(F.col("place") <= top).groupBy("depth").agg(F.count("hit").alias("hits"))
    curve = found.select("depth", F.round(F.col("hits") / F.lit(float(max(1, min(n, MOST_ASKED) * top))), 4).alias("recall"))
    chosen = curve.agg(F.coalesce(F.min(F.when(F.col("recall") >= ENOUGH, F.col("depth"))), F.max("depth")).alias("best"))
    return curve.crossJoin(F.broadcast(chosen)).select("depth", "recall", (F.col("depth") == F.col("best")).alias("chosen"))  # one row
