"""Queries of versioned collections, over a chain cut from the documents.

The base holds three fifths of the ids, two layers above it a fifth each. Ids divisible by 17 are buried; 17 j of the base is
superseded by the j-th id of the first layer, and by the j-th of the second where j is divisible by 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import index_terms
from skerry.operators import chain, fusion, knn, lexical
from skerry.operators.lexical import build_index
from skerry.plans import hybrid
from skerry.plans.search import K, _L
from skerry.plans.texts import sql_index_terms
from skerry.session import cut, stored, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("doc_id is not null")
    return rows.select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("text"))


def _size(records: DataFrame) -> int:
    return (records.agg(F.max("record_id")).first()[0] or 0) + 1


def _tiers(spark: SparkSession, n: int) -> DataFrame:
    fifth = n // 5
    rows = [(0, "base", n - 2 * fifth), (1, "layer-1", fifth), (2, "layer-2", fifth)]
    return spark.createDataFrame(rows, "depth int, identity string, records long")


def _tombstones(records: DataFrame) -> DataFrame:
    return records.where("record_id % 17 = 0").select(F.lit(2).alias("depth"), "record_id")


def _edges(records: DataFrame, n: int) -> DataFrame:
    fifth = n // 5
    base = n - 2 * fifth
    old = records.where(f"record_id % 17 = 0 and record_id < {base}").select("record_id", F.floor(F.col("record_id") / 17).alias("j")).where(f"j < {fifth}")
    first = old.select(F.lit(1).alias("depth"), F.col("record_id").alias("old_id"), (F.col("j") + base).alias("new_id"))
    second = old.where("j % 3 = 0").select(F.lit(2).alias("depth"), F.col("record_id").alias("old_id"), (F.col("j") + base + fifth).alias("new_id"))
    return first.unionByName(second)


def y1_tiers(spark: SparkSession, d: str) -> DataFrame:
    return chain.intervals(_tiers(spark, _size(_records(spark, d)))).select("identity", "records", "row_base", "row_end")


def y2_owners(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return chain.owners(records.select("record_id"), _tiers(spark, _size(records)))


def y3_live(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return chain.live_counts(_tiers(spark, _size(records)), _tombstones(records))


def y4_new_tombstones(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    older, newer = records.where("record_id % 34 = 0"), records.where("record_id % 17 = 0")
    return chain.new_tombstones(older.select("record_id"), newer.select("record_id"))


def y5_successors(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    found = chain.successors(_edges(records, _size(records)))
    return found.select("old_id", "immediate", F.array_join("all_new", ",").alias("all_new"), "current")


def y6_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = _records(spark, d).select(F.size(index_terms(F.col("text"))).cast("long").alias("dl"))
    return chain.chain_stats(lengths).select("n", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


def y7_chain_query(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every live tier and BM25 under the statistics of all records, merged and fused once; chains pin no phrase."""
    records = _records(spark, d)
    tiers = _tiers(spark, _size(records))
    pack = hybrid.pack_of(hybrid.records_of(spark, d))
    worded = pack.records
    gone, questions = _tombstones(worded).select("record_id"), hybrid.questions_of(worded)
    lex = stored(lexical.cutoff(lexical.bm25(pack.index, questions, "query_id", "text", exclude=gone)))
    owned = chain.owners(worded.select("record_id"), tiers).select("record_id", F.col("depth").cast("long").alias("pack"))
    vec = chain.tiered_knn(questions, pack.codes.join(owned, "record_id"), 3, hybrid.DIM, hybrid.POOL, 100, lex, gone)
    hits = fusion.fuse(stored(vec), lex).where(F.col("fused_rank") < K)
    return hits.select("query_id", "record_id", F.col("fused_rank").cast("long").alias("fused_rank"), F.round("distance", 6).alias("distance"))


def y8_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record, buried or not, with what superseded it."""
    records = _records(spark, d)
    current = chain.successors(_edges(records, _size(records))).select(F.col("old_id").alias("record_id"), "current")
    dead = _tombstones(records).select("record_id", F.lit(True).alias("buried"))
    return records.select("record_id").join(dead, "record_id", "left").join(current, "record_id", "left").select("record_id", F.coalesce("buried", F.lit(False)).alias("buried"), "current")


def y9_citations(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    n = _size(records)
    heads = chain.intervals(_tiers(spark, n)).select("identity", F.col("row_end").alias("row_total"))
    which = F.element_at(F.array(F.lit("base"), F.lit("layer-1"), F.lit("layer-2"), F.lit("foreign")), (F.col("record_id") % 4 + 1).cast("int"))
    cited = records.select(F.when(F.col("record_id") % 50 == 0, -1 - F.col("record_id")).otherwise(F.col("record_id")).alias("record_id"), which.alias("identity"))
    return chain.cite(cited, heads).select("identity", "record_id", "status")


def y10_drift(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    found = chain.drift(_tiers(spark, _size(records)), _tombstones(records))
    return found.select("appended", "buried", "base_records", F.round("drift", 6).alias("drift"), "status")


def y13_compacted(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return knn.compacted(records.select("record_id"), _tombstones(records).select("record_id"))


def y13_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """The chain folded into one base: how many records and terms its lexical index has, and a digest of the renumbered rows."""
    records = cut(_records(spark, d))
    _, rewritten, index = chain.compacted(records, _tombstones(records), build_index(records, "record_id", "text").termed)
    sums = rewritten.agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("record_id") * F.length("text")).alias("checksum"))
    return sums.crossJoin(index.terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")))  # one row each


def y12_targets(spark: SparkSession, d: str) -> DataFrame:
    """Which new chunk replaces an old record: the only one of its source path."""
    rows = table(spark, d, "record_chunks").where("source_path is not null").select("chunk_id", "source_path").distinct()
    once = rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("new_no")).where("n = 1")
    named = once.select((F.col("new_no") + 1_000_000).alias("old_id"), "source_path")
    return chain.supersede_targets(named, rows.select(F.col("chunk_id").alias("new_no"), "source_path"))


def y15_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The second layer replayed on a head whose own second layer buried other records and replaced some of the same."""
    records = _records(spark, d)
    n = _size(records)
    fifth = n // 5
    ids = records.select("record_id")
    parent = ids.where("record_id % 34 = 0")
    theirs = ids.where("record_id % 34 = 0 or record_id % 19 = 0").select("record_id")
    edges = _edges(records, n)
    head_edges = edges.where("depth = 1").unionByName(edges.where("depth = 2 and old_id % 2 = 0").withColumn("new_id", F.col("new_id") + 7))
    buried, kept = chain.replay(ids.where("record_id % 17 = 0"), parent, edges.where("depth = 2"), n - fifth, fifth, theirs, head_edges, n + 50, n - fifth, "drop", "skip")
    return buried.select(F.lit("buried").alias("what"), "record_id", F.lit(None).cast("long").alias("new_id")).union(kept.select(F.lit("edge"), F.col("old_id"), "new_id"))


def y14_translated(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    id_map = knn.compacted(records.select("record_id"), _tombstones(records).select("record_id"))
    return chain.translate(records.select(F.col("record_id").alias("old_id")), id_map, chain.successors(_edges(records, _size(records))))


def y15_rebased(spark: SparkSession, d: str) -> DataFrame:
    n = _size(_records(spark, d))
    ours = _tiers(spark, n)
    theirs = ours.withColumn("identity", F.when(F.col("depth") == 2, F.lit("other")).otherwise(F.col("identity")))
    fork = chain.rebase(ours, theirs)
    return fork.select(F.col("fork_depth").cast("long").alias("fork_depth"), "fork_records")


QUERIES = {
    f.__name__: f
    for f in (y1_tiers, y2_owners, y3_live, y4_new_tombstones, y5_successors, y6_stats, y7_chain_query, y8_records, y9_citations, y10_drift, y12_targets, y13_compacted, y13_rewritten, y14_translated, y15_rebased, y15_replayed)
}

_T = """
WITH size AS (SELECT max(doc_id) + 1 AS n, (max(doc_id) + 1) // 5 AS f FROM documents
), tiers AS (
  SELECT 0 AS depth, 'base' AS identity, n - 2 * f AS records, 0 AS row_base, n - 2 * f AS row_end FROM size
  UNION ALL SELECT 1, 'layer-1', f, n - 2 * f, n - f FROM size UNION ALL SELECT 2, 'layer-2', f, n - f, n FROM size
), ids AS (SELECT DISTINCT doc_id AS record_id FROM documents WHERE doc_id IS NOT NULL
), old AS (SELECT record_id, record_id // 17 AS j FROM ids CROSS JOIN size WHERE record_id % 17 = 0 AND record_id < n - 2 * f AND record_id // 17 < f
), edges AS (
  SELECT 1 AS depth, record_id AS old_id, j + n - 2 * f AS new_id FROM old CROSS JOIN size
  UNION ALL SELECT 2, record_id, j + n - f FROM old CROSS JOIN size WHERE j % 3 = 0
), latest AS (SELECT old_id, arg_min(new_id, depth) AS immediate, string_agg(CAST(new_id AS VARCHAR), ',' ORDER BY depth) AS all_new, arg_max(new_id, depth) AS l FROM edges GROUP BY old_id
), hops AS (SELECT old_id, immediate, all_new, l AS cur, 1 AS h FROM latest
), walk AS (
  SELECT a.old_id, a.immediate, a.all_new, coalesce(d.l, c.l, b.l, a.l) AS cur FROM latest a LEFT JOIN latest b ON b.old_id = a.l LEFT JOIN latest c ON c.old_id = b.l LEFT JOIN latest d ON d.old_id = c.l
), live AS (SELECT record_id AS old_id, row_number() OVER (ORDER BY record_id) - 1 AS new_id FROM ids WHERE record_id % 17 <> 0)"""

SQL = {
    "y1_tiers": _T + " SELECT identity, records, row_base, row_end FROM tiers",
    "y2_owners": _T + " SELECT record_id, depth, record_id - row_base AS local_id FROM ids JOIN tiers ON record_id >= row_base AND record_id < row_end",
    "y3_live": _T
    + " SELECT depth, any_value(records) AS records, any_value(records) - count(record_id) AS live FROM tiers LEFT JOIN ids ON record_id % 17 = 0 AND record_id >= row_base AND record_id < row_end GROUP BY depth",
    "y4_new_tombstones": _T + " SELECT record_id FROM ids WHERE record_id % 17 = 0 AND record_id % 34 <> 0",
    "y5_successors": _T + " SELECT old_id, immediate, all_new, cur AS current FROM walk",
    "y6_stats": _L.replace("SELECT doc_id AS record_id, text, lang, source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL", "SELECT doc_id AS record_id, coalesce(text, '') AS text, lang, source FROM documents WHERE doc_id IS NOT NULL")
    + " SELECT n, total_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "y7_chain_query": hybrid.candidates_sql(
        live="record_id % 17 <> 0",
        each="CASE WHEN doc_id < (SELECT max(doc_id) + 1 - 2 * ((max(doc_id) + 1) // 5) FROM documents) THEN 0 WHEN doc_id < (SELECT max(doc_id) + 1 - (max(doc_id) + 1) // 5 FROM documents) THEN 1 ELSE 2 END",
    )
    + hybrid.fused_sql()
    + " SELECT query_id, record_id, fused_rank, round(distance, 6) AS distance FROM fused WHERE fused_rank < 5",
    "y8_records": _T + " SELECT record_id, record_id % 17 = 0 AS buried, cur AS current FROM ids LEFT JOIN walk ON old_id = record_id",
    "y9_citations": _T
    + """, cited AS (SELECT CASE WHEN record_id % 50 = 0 THEN -1 - record_id ELSE record_id END AS record_id, ['base', 'layer-1', 'layer-2', 'foreign'][record_id % 4 + 1] AS identity FROM ids)
SELECT identity, record_id, CASE WHEN row_end IS NULL THEN 'not-on-history' WHEN record_id < 0 THEN 'invalid-id' WHEN record_id >= row_end THEN 'postdates' ELSE 'ok' END AS status
FROM cited LEFT JOIN tiers USING (identity)""",
    "y10_drift": _T
    + """, s AS (SELECT CAST(sum(records) FILTER (depth > 0) AS BIGINT) AS appended, (SELECT count(*) FROM ids WHERE record_id % 17 = 0) AS buried, CAST(sum(records) FILTER (depth = 0) AS BIGINT) AS base_records FROM tiers)
SELECT appended, buried, base_records, round((appended + buried) / base_records, 6) AS drift,
  CASE WHEN appended + buried = 0 THEN 'none' WHEN (appended + buried) / base_records > 0.2 THEN 'drift-exceeded' ELSE 'inherited' END AS status FROM s""",
    "y13_compacted": _T + " SELECT old_id, new_id FROM live",
    "y12_targets": """
SELECT min(chunk_id) + 1000000 AS old_id, min(chunk_id) AS new_no FROM (SELECT DISTINCT chunk_id, source_path FROM record_chunks WHERE source_path IS NOT NULL) GROUP BY source_path HAVING count(*) = 1""",
    "y13_rewritten": _T
    + f""", rewritten AS (SELECT new_id, coalesce(text, '') AS t FROM live JOIN documents ON doc_id = old_id
), words AS (SELECT DISTINCT new_id, unnest({sql_index_terms('t')}) AS term FROM rewritten)
SELECT (SELECT count(*) FROM rewritten) AS records, (SELECT CAST(sum(new_id * length(t)) AS BIGINT) FROM rewritten) AS checksum, count(DISTINCT term) AS terms, count(*) AS postings FROM words""",
    "y15_replayed": _T
    + """, ours AS (SELECT old_id, new_id - (n - f) + (n + 50) AS new_id FROM edges CROSS JOIN size WHERE depth = 2 AND old_id < n - f
), theirs AS (
  SELECT old_id, arg_max(new_id, depth) AS t FROM (SELECT depth, old_id, new_id FROM edges WHERE depth = 1 UNION ALL SELECT depth, old_id, new_id + 7 FROM edges WHERE depth = 2 AND old_id % 2 = 0) GROUP BY old_id
), kept AS (SELECT ours.old_id, ours.new_id FROM ours LEFT JOIN theirs USING (old_id) WHERE t IS NULL OR t = ours.new_id
), gone AS (
  SELECT record_id FROM ids WHERE record_id % 34 = 0 OR record_id % 19 = 0
  UNION SELECT record_id FROM ids CROSS JOIN size WHERE record_id % 17 = 0 AND record_id % 34 <> 0 AND record_id < n - f UNION SELECT old_id FROM kept
)
SELECT 'buried' AS what, record_id, CAST(NULL AS BIGINT) AS new_id FROM gone UNION ALL SELECT 'edge', old_id, new_id FROM kept""",
    "y14_translated": _T
    + """ SELECT record_id AS old_id, CASE WHEN live.new_id IS NOT NULL THEN 'live' WHEN t.new_id IS NOT NULL THEN 'superseded' ELSE 'deleted' END AS status, coalesce(live.new_id, t.new_id) AS new_id
FROM ids LEFT JOIN live ON live.old_id = record_id LEFT JOIN walk ON walk.old_id = record_id LEFT JOIN live t ON t.old_id = walk.cur""",
    "y15_rebased": _T + " SELECT CAST(2 AS BIGINT) AS fork_depth, CAST(sum(records) AS BIGINT) AS fork_records FROM tiers WHERE depth < 2",
}
