"""Versioned collections: a base and layers above it, with tombstones, supersession, compaction and rebasing.

A chain is three tables: ``tiers`` (depth, identity, records), ``tombstones`` (depth, record_id) and ``edges``
(depth, old_id, new_id). Ids are positions over the whole chain; a tier owns the run of ids after the tiers below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.errors import SkerryError, require
from skerry.functions import vector as V
from skerry.operators import knn
from skerry.operators.lexical import LexicalIndex, build_index
from skerry.session import bounded_collect, cut, stored

#: Layers above a base, steps that a supersession is followed, and the drift from which a chain is stale.
MAX_DEPTH, MAX_HOPS, DRIFT_LIMIT = 16, 64, 0.20


def intervals(tiers: DataFrame) -> DataFrame:
    """``tiers`` with ``row_base`` and ``row_end``; at most :data:`MAX_DEPTH` + 1 rows."""
    below = F.coalesce(F.sum("records").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounded_collect(tiers.select("depth"), MAX_DEPTH + 1, "the chain")  # so it may be ordered in one task and broadcast
    placed = tiers.withColumn("row_base", below)
    return placed.withColumn("row_end", F.col("row_base") + F.col("records"))


def check_tiers(tiers: DataFrame) -> None:
    rows = bounded_collect(tiers.orderBy("depth"), MAX_DEPTH + 1, "the chain")
    depths = [r["depth"] for r in rows]
    if depths != list(range(len(depths))) or any(r["records"] < 0 for r in rows):
        raise SkerryError("LAYER_INVALID", f"depths must run from 0 without gaps, with records of 0 or more; found {depths}")


def owners(ids: DataFrame, tiers: DataFrame) -> DataFrame:
    """``record_id, depth, local_id`` of ids that a tier owns: a range join with the few tiers, broadcast."""
    t = intervals(tiers).where("records > 0").select("depth", "row_base", "row_end")
    on = (F.col("record_id") >= F.col("row_base")) & (F.col("record_id") < F.col("row_end"))
    return ids.join(F.broadcast(t), on).select("record_id", "depth", (F.col("record_id") - F.col("row_base")).alias("local_id"))


def locator_problem(locator: Column) -> Column:
    """Why a layer's reference to its parent is refused, or null: it names a file beside or below the layer and is taken as it is written."""
    segments = F.split(locator, "/")
    return (
        F.when(F.coalesce(locator == "", F.lit(True)), "empty")
        .when(F.length(locator) > 1024, "too long")
        .when(locator.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "scheme")
        .when(locator.startswith("/"), "absolute")
        .when(locator.rlike(r"(?i)[\\\x00-\x1f\x7f?#]|%(?:2e|2f|5c|00)") | F.contains(locator, F.lit("//")), "signs")
        .when(F.exists(segments, lambda s: s.isin("..", ".")), "dot segment")
        .when(locator.endswith("/"), "folder")
    )


def resolved_locator(layer: Column, locator: Column) -> Column:
    """Where a layer's parent lies: beside the layer; null for a reference that is refused."""
    return F.when(locator_problem(locator).isNull(), F.concat(F.regexp_extract(layer, "^(.*/)?[^/]*$", 1), locator))


def live(ids: DataFrame, tombstones: DataFrame) -> DataFrame:
    return ids.join(tombstones.select("record_id").distinct(), "record_id", "left_anti")


def live_counts(tiers: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``depth, records, live``."""
    dead = owners(tombstones.select("record_id").distinct(), tiers).groupBy("depth").agg(F.count(F.lit(1)).alias("dead"))
    return tiers.join(dead, "depth", "left").select("depth", "records", (F.col("records") - F.coalesce("dead", F.lit(0))).alias("live"))


def new_tombstones(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Ids that the newer cumulative set adds; an id that it lacks is an error, as sets only grow."""
    if not older.select("record_id").exceptAll(newer.select("record_id")).isEmpty():
        raise SkerryError("LAYER_INVALID", "a cumulative tombstone set must hold the one below")
    return newer.select("record_id").distinct().join(older.select("record_id"), "record_id", "left_anti")


def successors(edges: DataFrame) -> DataFrame:
    """``old_id, immediate, all_new, current``: the first replacement, all of them by depth, and where following the latest ends.

    The latest edges double their reach each round, so a chain of n replacements takes log n rounds; a circle ends where
    :data:`MAX_HOPS` steps end.
    """
    one = edges.groupBy("old_id").agg(
        F.min_by("new_id", F.struct("depth", "new_id")).alias("immediate"),
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "new_id"))), lambda e: e["new_id"]).alias("all_new"),
        F.max_by("new_id", F.struct("depth", "new_id")).alias("latest"),
    )
    jump = cut(one.select("old_id", F.col("latest").alias("to")))
    for _ in range(MAX_HOPS.bit_length() - 1):
        further = jump.select(F.col("old_id").alias("at"), F.col("to").alias("further"))
        step = jump.join(further, F.col("to") == F.col("at"), "left").select("old_id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        step = cut(step)
        jump = step.select("old_id", "to")
        if step.where("moved").isEmpty():
            break
    return one.join(jump, "old_id").select("old_id", "immediate", "all_new", F.col("to").alias("current"))


def chain_stats(doclen: DataFrame) -> DataFrame:
    """One row ``n, total_tokens, avgdl`` over all tiers; buried records still count. ``doclen`` has dl."""
    one = doclen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    return one.withColumn("avgdl", F.greatest(F.lit(1.0), F.col("total_tokens") / F.greatest(F.col("n"), F.lit(1))))


def cite(citations: DataFrame, heads: DataFrame) -> DataFrame:
    """``citations`` (identity, record_id) with ``status``: ``ok``, ``invalid-id`` (negative or null), ``postdates`` (beyond what the
    cited head held) or ``not-on-history``. ``heads`` has identity, row_total."""
    bounded_collect(heads.select("identity"), MAX_DEPTH + 1, "the history")  # so it may be broadcast
    known = citations.join(F.broadcast(heads.select("identity", "row_total")), "identity", "left")
    status = (
        F.when(F.col("row_total").isNull(), "not-on-history")
        .when(F.col("record_id").isNull() | (F.col("record_id") < 0), "invalid-id")
        .when(F.col("record_id") >= F.col("row_total"), "postdates")
        .otherwise("ok")
    )
    return known.withColumn("status", status).drop("row_total")


def drift(tiers: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row ``appended, buried, base_records, drift, status``: ``none``, ``inherited``, or ``drift-exceeded`` above the limit."""
    sums = tiers.agg(
        F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("records"))), F.lit(0)).alias("appended"),
        F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("records"))), F.lit(0)).alias("base_records"),
    )
    buried = tombstones.agg(F.countDistinct("record_id").alias("buried"))
    both = sums.crossJoin(buried)  # one row each
    share = (F.col("appended") + F.col("buried")) / F.greatest(F.col("base_records"), F.lit(1))
    moved = F.col("appended") + F.col("buried") > 0
    return both.withColumn("drift", share).withColumn("status", F.when(~moved, "none").when(share > DRIFT_LIMIT, "drift-exceeded").otherwise("inherited"))


def plan_layer(tiers: DataFrame, tombstones: DataFrame, n_new: int, remove: DataFrame, supersede: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiers, tombstones, edges to add) of a chain with a layer of ``n_new`` records.

    ``supersede`` (old_id, new_no) names which of the layer's records replaces which old one; an old id is buried too. A
    layer that changes nothing, or stands too high, is refused; so are ids that are not live.
    """
    rows = bounded_collect(tiers.orderBy("depth"), MAX_DEPTH + 1, "the chain")
    require(len(rows) <= MAX_DEPTH, "the chain is at its greatest depth: compact it", "COMPACTION_REQUIRED")
    base = sum(r["records"] for r in rows)
    gone = cut(remove.select("record_id").union(supersede.select("old_id")).distinct())
    require(n_new > 0 or not gone.isEmpty(), "the layer changes nothing")
    require(gone.where((F.col("record_id") < 0) | (F.col("record_id") >= base)).isEmpty(), "an id to bury is not in the chain", "NOT_FOUND")
    require(gone.join(tombstones, "record_id", "left_semi").isEmpty(), "an id to bury is buried already")
    depth = len(rows)
    spark = tiers.sparkSession
    more = tiers.select("depth", "identity", "records").union(spark.createDataFrame([(depth, f"layer-{depth}", n_new)], "depth int, identity string, records long"))
    edges = supersede.select(F.lit(depth).alias("depth"), "old_id", (F.col("new_no") + base).alias("new_id"))
    return more, tombstones.select("depth", "record_id").union(gone.select(F.lit(depth), "record_id")), edges


def tiered_knn(questions: DataFrame, codes: DataFrame, tiers: int, dim: int, pool: int, depth: int, extra: DataFrame, masked: DataFrame) -> DataFrame:
    """``query_id, record_id, distance, vec_rank`` over a chain: every tier gives its ``depth`` nearest live rows by sketch, the
    lexical candidates (``extra``) join them, and all are ranked by exact distance and id over the whole chain.

    ``codes`` are of :func:`skerry.operators.knn.coded` with the tier as ``pack``; ``masked`` (record_id) leaves before any cut.
    """
    asked = questions.select(F.col("query_id").cast("long"), V.normalized(V.doubles(F.col("vector"))).alias("vector"))
    alive = live(codes, masked)
    # A question to a tier is a query of its own.
    each = asked.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(tiers - 1)))).withColumn("query_id", F.col("query_id") * tiers + F.col("pack"))
    near = knn.sketch_candidates(each, alive, dim, pool, depth).select(F.floor(F.col("query_id") / tiers).alias("query_id"), "record_id")
    return knn.rerank(near.union(extra.select("query_id", "record_id")).distinct(), asked, alive, None)


def supersede_targets(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """``old_id, new_no`` of ``named`` (old_id, source_path): the one new chunk (new_no, source_path) that the path names.

    A path that names no chunk, or several, is an error, as an edge has one successor.
    """
    met = named.join(chunks.select("new_no", "source_path"), "source_path", "left").groupBy("old_id", "source_path").agg(F.count("new_no").alias("n"), F.min("new_no").alias("new_no"))
    met = cut(met)
    wrong = met.where("n <> 1").orderBy("old_id").first()
    if wrong is not None:
        raise SkerryError("INVALID_ARGUMENT", f"{wrong['old_id']}={wrong['source_path']} names {wrong['n']} of the new records, not one")
    return met.select("old_id", "new_no")


def replay(
    layer_tombstones: DataFrame, parent_tombstones: DataFrame, layer_edges: DataFrame, old_base: int, layer_records: int,
    head_tombstones: DataFrame, head_edges: DataFrame, head_records: int, fork_records: int, on_foreign: str = "refuse", on_conflict: str = "refuse",
) -> tuple[DataFrame, DataFrame]:
    """(tombstones, edges) of a layer replayed on another head: ``record_id`` of all that is buried then, and ``old_id, new_id``.

    Of the layer's tombstones only those that its parent lacked are its own. Own ids move up behind the head's records; ids from
    the fork on (``fork_records``) name other records there: they are refused, or left out by ``on_foreign="drop"``. Where the head already
    records another successor, the edge is refused, left out (``on_conflict="skip"``) or kept beside it (``"keep-both"``). A replay that
    would add nothing is refused too.
    """
    require(on_foreign in ("refuse", "drop") and on_conflict in ("refuse", "skip", "keep-both"), "unknown policy")
    own = cut(layer_tombstones.select("record_id").distinct().join(parent_tombstones.select("record_id"), "record_id", "left_anti").where(F.col("record_id") < old_base))
    edges = layer_edges.select("old_id", (F.col("new_id") - old_base + head_records).alias("new_id"))
    foreign = own.where(F.col("record_id") >= fork_records).union(edges.where(F.col("old_id") >= fork_records).select("old_id"))
    require(on_foreign == "drop" or foreign.isEmpty(), "the layer buries or replaces records that only its own history has")
    edges = edges.where(F.col("old_id") < fork_records)
    require(edges.where((F.col("new_id") < head_records) | (F.col("new_id") >= head_records + layer_records)).isEmpty(), "an edge leads outside the layer", "LAYER_INVALID")
    last = head_edges.groupBy("old_id").agg(F.max_by("new_id", F.struct("depth", "new_id")).alias("theirs"))
    met = cut(edges.join(last, "old_id", "left").withColumn("clash", F.coalesce(F.col("theirs") != F.col("new_id"), F.lit(False))))
    require(on_conflict != "refuse" or met.where("clash").isEmpty(), "the head already records another successor")
    kept = met.where(F.lit(on_conflict == "keep-both") | ~F.col("clash")).select("old_id", "new_id")
    buried = own.where(F.col("record_id") < fork_records).union(kept.select("old_id")).distinct()
    added = cut(buried.join(head_tombstones.select("record_id"), "record_id", "left_anti"))
    require(layer_records > 0 or not added.isEmpty(), "the replayed layer changes nothing")
    return head_tombstones.select("record_id").distinct().union(added), kept


def compacted(records: DataFrame, tombstones: DataFrame, termed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, LexicalIndex]:
    """(id map old_id, new_id; records rewritten; their lexical index) of a chain folded into one base.

    Live records are numbered densely in the order of their ids; their rows are taken over as they are. The index is rebuilt over the
    live records alone, from their known terms (``termed`` of an index) where those are given.
    """
    moved = cut(knn.compacted(records.select("record_id"), tombstones.select("record_id")))
    renumber = lambda df: df.join(moved, F.col("record_id") == F.col("old_id")).drop("record_id", "old_id").withColumnRenamed("new_id", "record_id")
    rewritten = renumber(records)
    return moved, rewritten, LexicalIndex(stored(renumber(termed))) if termed is not None else build_index(rewritten, "record_id", "text")


def translate(citations: DataFrame, id_map: DataFrame, current: DataFrame) -> DataFrame:
    """``old_id, status, new_id`` after a compaction: ``live``, ``superseded`` (by a live record) or ``deleted``.

    ``id_map`` (old_id, new_id) of :func:`skerry.operators.knn.compacted`; ``current`` of :func:`successors`.
    """
    mapped = citations.join(id_map, "old_id", "left").join(current.select("old_id", "current"), "old_id", "left")
    through = id_map.select(F.col("old_id").alias("current"), F.col("new_id").alias("through"))
    both = mapped.join(through, "current", "left")
    status = F.when(F.col("new_id").isNotNull(), "live").when(F.col("through").isNotNull(), "superseded").otherwise("deleted")
    return both.select("old_id", status.alias("status"), F.coalesce("new_id", "through").alias("new_id"))


def rebase(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row ``fork_depth, fork_records``: how much of two chains (depth, identity, records) is common from the base on."""
    joined = ours.alias("o").join(theirs.alias("t"), "depth", "left").select("depth", F.col("o.records").alias("records"), F.coalesce(F.col("o.identity") == F.col("t.identity"), F.lit(False)).alias("same"))
    differs = F.coalesce(F.min(F.when(~F.col("same"), F.col("depth"))), F.max("depth") + 1)
    first = joined.agg(differs.alias("fork_depth"))
    return joined.crossJoin(first).where("depth < fork_depth").groupBy("fork_depth").agg(F.sum("records").alias("fork_records"))  # one row


def shift_ids(ids: DataFrame, fork_records: int, their_records: int) -> DataFrame:
    """Our ids on their chain: those from below the fork stay, newer ones move up behind theirs."""
    moved = F.col("record_id") - fork_records + their_records
    return ids.select("record_id", F.when(F.col("record_id") < fork_records, F.col("record_id")).otherwise(moved).alias("new_id"))
