"""Queries of vector and lexical search, and of the words that match quality rests on.

The document of an embedding is the one of the same number; queries are the documents (or embeddings) whose number is
divisible by 20, each asked with its first line, against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions import text as T
from skerry.functions import vector as V
from skerry.operators import grounding, knn, lexical
from skerry.plans.texts import SQL_FIRSTS, sql_coverage_words, sql_grounding_words, sql_index_terms, sql_query_terms, sql_quoted, sql_stem
from skerry.session import cut, spread, table

DIM, POOL, K = 64, 2, 5


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), V.normalized(V.doubles(F.col("embedding"))).alias("vector"), "label")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "vector")


def _near(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "record_id", F.round("distance", 6).alias("distance"), F.col("vec_rank").cast("long").alias("vec_rank"))


def v1_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "minilm_f32_kernel_test_vectors")
    return rows.select("vec_id", V.is_valid(V.doubles(F.col("embedding")), 384).alias("valid"))


def v2_norms(spark: SparkSession, d: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.normalized(v)[0], 6).alias("first"))


def v3_distances(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    other = rows.select((F.col("record_id") - 1).alias("record_id"), F.col("vector").alias("next"))
    both = rows.join(other, "record_id")
    return both.select("record_id", F.round(V.cosine_distance(F.col("vector"), F.col("next")), 6).alias("cosine"), F.round(V.l2_distance(F.col("vector"), F.col("next")), 6).alias("l2"))


def v5_quantized(spark: SparkSession, d: str) -> DataFrame:
    code = V.quantized(V.doubles(F.col("embedding")))
    rows = table(spark, d, "embeddings").select("vec_id", F.inline(F.array(code)))
    return rows.select("vec_id", F.array_join("q", ",").alias("q"), F.round("scale", 9).alias("scale"), F.round("offset", 9).alias("offset"), "sum_q", "sum_q2")


def v6_restored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "uint8_snapshot_graph").where("qdata is not null and q_scale is not null and q_offset is not null")
    real = V.dequantized(F.col("qdata").cast("array<double>"), F.col("q_scale").cast("double"), F.col("q_offset").cast("double"))
    return rows.select("row_id", F.round(V.total(real), 6).alias("total"), F.round(V.norm(real), 6).alias("norm"))


def v10_sketches(spark: SparkSession, d: str) -> DataFrame:
    index = knn.coded(_rows(spark, d), POOL)
    return index.select("record_id", F.array_join("sketch", ",").alias("sketch"))


def v13_hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "record_chunks").where("title is not null").select("title").distinct()
    v = V.hash_embedding(F.split(F.lower("title"), " +"), 16)
    weighed = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("v", v).select("title", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(weighed(F.col("v")), 6).alias("weighed"))


def n1_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return _near(knn.exact_knn(_asked(rows), rows, 10, DIM, skip_self=True))


def n1_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return _near(knn.exact_knn(_asked(rows), rows, 10, DIM, metric="l2", skip_self=True))


def n3_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return _near(knn.exact_knn(_asked(rows), rows, 10, DIM, skip_self=True, allowed=rows.where("record_id % 10 = 3").select("record_id")))


def n8_masked(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return _near(knn.exact_knn(_asked(rows), rows, 10, DIM, skip_self=True, masked=rows.where("record_id % 17 = 0").select("record_id")))


def n4_two_stage(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    depth = knn.rerank_depth(rows.count(), K)
    return _near(knn.two_stage_knn(_asked(rows), knn.coded(rows, POOL), K, DIM, POOL, depth))


def n9_collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    hits = knn.exact_knn(_asked(rows), rows, 40, DIM, skip_self=True)
    got = knn.collapse_rows(hits, F.floor(F.col("record_id") / 4).cast("long"), K)
    return got.select("query_id", "record_id", "row_id", F.round("distance", 6).alias("distance"), F.col("vec_rank").cast("long").alias("vec_rank"))


def n10_ghosts(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    gone = (F.col("record_id") % 17 == 0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(gone).alias("deleted"), F.round(F.sum(gone) / F.count(F.lit(1)), 6).alias("ghost_ratio"))


def n11_compacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return knn.compacted(rows, rows.where("record_id % 17 = 0").select("record_id"))


def n6_staged(spark: SparkSession, d: str) -> DataFrame:
    """A coarser tier first, four times as deep; then sketches, then codes."""
    rows = _rows(spark, d)
    return _near(knn.staged_knn(_asked(rows), knn.coded(rows, POOL), knn.coded(rows, 4 * POOL), K, DIM, POOL, 4 * POOL, knn.rerank_depth(rows.count(), K)))


def n13_rerank_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the two-stage search at each depth of the ladder, and the depth that is chosen."""
    rows = _rows(spark, d)
    return knn.depth_curve(_asked(rows), cut(knn.coded(rows, POOL)), 10, DIM, POOL)


def n14_self_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    found = knn.exact_knn(_asked(rows), rows, 5, DIM)
    own = found.where(F.col("query_id") == F.col("record_id"))
    return own.groupBy(F.col("vec_rank").cast("long").alias("vec_rank")).agg(F.count(F.lit(1)).alias("n"))


def n15_lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """One step of cosine k-means from the first vector of each label: how many rows each centre takes, and from which label."""
    rows = _rows(spark, d)
    centres = rows.groupBy("label").agg(F.min_by("vector", "record_id").alias("vector")).select(F.col("label").alias("centre"), "vector")
    return knn.assigned(rows, centres, DIM).join(rows.select("record_id", "label"), "record_id").groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"))


def n15_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Three steps of it: the rows and the mean distance of each centre."""
    rows = cut(_rows(spark, d))
    centres = rows.groupBy("label").agg(F.min_by("vector", "record_id").alias("vector")).select(F.col("label").cast("long").alias("centre"), "vector")
    _, near = knn.kmeans(rows, centres, DIM, 3)
    return near.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 5).alias("distance"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("doc_id is not null and text is not null")
    return spread(rows.select(F.col("doc_id").alias("record_id"), "text", "lang", "source"))


def _questions(records: DataFrame) -> DataFrame:
    return records.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("text"))


def l3_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(_records(spark, d), "record_id", "text").terms


def l3_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = lexical.build_index(_records(spark, d), "record_id", "text").stats
    return stats.select("n", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


def l4_df(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return lexical.document_frequencies(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text")


def _lex(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "record_id", F.round("score", 4).alias("score"), F.col("lex_rank").cast("long").alias("lex_rank"))


def l5_bm25(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return _lex(lexical.bm25(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text"))


def l6_excluded(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    gone = records.where("record_id % 17 = 0").select("record_id")
    return _lex(lexical.bm25(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text", exclude=gone))


def l7_cutoff(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return _lex(lexical.cutoff(lexical.bm25(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text")))


def h11_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the part of the same number from a catalogue; misses stay, marked."""
    rows = _rows(spark, d)
    hits = _near(knn.exact_knn(_asked(rows), rows, 3, DIM, skip_self=True))
    parts = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("record_id"), "p_name")
    return hits.join(parts, "record_id", "left").select("query_id", "record_id", "vec_rank", "p_name", F.col("p_name").isNull().alias("missing"))


def g4_known(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    known = grounding.known_fraction(_questions(records), grounding.vocabulary(records, "text"))
    return known.select("query_id", F.round("known", 6).alias("known"))


def g6_common(spark: SparkSession, d: str) -> DataFrame:
    return grounding.common_words(_records(spark, d), "record_id", "text")


def g8_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    found = grounding.retrieval_signals(knn.exact_knn(_asked(rows), rows, 10, DIM, skip_self=True))
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("d0", "margin", "mean10")])


def g15_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "abstention_examples").where("label is not null and text is not null")
    scored = rows.select("label", F.length("text").alias("score"))
    return grounding.auc(scored, "label", "score").select(F.round("auc", 6).alias("auc"))


def g16_entities(spark: SparkSession, d: str) -> DataFrame:
    return grounding.entities(_records(spark, d), "record_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        v1_valid, v2_norms, v3_distances, v5_quantized, v6_restored, v10_sketches, v13_hash_embeddings, n1_knn, n1_knn_l2, n3_filtered, n4_two_stage,
        n8_masked, n9_collapsed, n6_staged, n10_ghosts, n11_compacted, n13_rerank_sweep, n14_self_recall, n15_lloyd_step, n15_kmeans, l3_term_stats, l3_corpus_stats, l4_df,
        l5_bm25, l6_excluded, l7_cutoff, h11_catalog, g4_known, g6_common, g8_signals, g15_auc, g16_entities,
    )
}

_V = """
WITH lengths AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings
), rows AS (SELECT vec_id AS record_id, label, list_transform(e, lambda x: x / n) AS v FROM lengths
), asked AS (SELECT record_id AS query_id, v AS qv FROM rows WHERE record_id % 20 = 0
)"""
_COS = "round(1 - greatest(-1, least(1, list_inner_product(qv, v))), 9)"


def _knn_sql(k: int, distance: str = _COS, where: str = "query_id <> record_id") -> str:
    return f"""{_V}, far AS (SELECT query_id, record_id, {distance} AS distance FROM asked CROSS JOIN rows WHERE {where}
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) - 1 AS vec_rank FROM far QUALIFY vec_rank < {k})"""


_SHOW = " SELECT query_id, record_id, round(distance, 6) AS distance, vec_rank FROM near"

_CODED = f"""{_V}, spans AS (SELECT record_id, v, list_min(v) AS low, CASE WHEN list_max(v) - list_min(v) < 1e-30 THEN 1.0 ELSE list_max(v) - list_min(v) END AS span FROM rows
), coded AS (SELECT record_id, low AS o, span / 255 AS s, list_transform(v, lambda x: CAST(greatest(0, least(255, floor((x - low) * 255 / span + 0.5))) AS INTEGER)) AS q FROM spans
), sketched AS (
  SELECT *, list_transform(range(0, {DIM // POOL}), lambda i: CAST(least(15, floor(floor((q[i * {POOL} + 1] + q[i * {POOL} + 2]) / 2 + 0.5) / 17 + 0.5)) AS INTEGER)) AS sk FROM coded
), means AS (SELECT query_id, qv, list_transform(range(0, {DIM // POOL}), lambda i: (qv[i * {POOL} + 1] + qv[i * {POOL} + 2]) / 2) AS qm, list_sum(qv) AS qs FROM asked
)"""


def _stage_sql(depth: str) -> str:
    return f"""{_CODED}, far AS (
  SELECT query_id, record_id, qv, qs, q, s, o, round(1 - greatest(-1, least(1, {POOL} * list_inner_product(qm, list_transform(sk, lambda x: o + s * (x * 17.0))))), 9) AS sd FROM means CROSS JOIN sketched
), first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sd, record_id) AS c FROM far
), exact AS (SELECT query_id, record_id, c, round(1 - greatest(-1, least(1, o * qs + s * list_inner_product(qv, CAST(q AS DOUBLE[])))), 9) AS distance FROM first WHERE c <= {depth})"""


_L = f"""
WITH records AS (SELECT doc_id AS record_id, text, lang, source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), termed AS (SELECT record_id, {sql_index_terms('text')} AS t FROM records
), postings AS (SELECT record_id, any_value(len(t)) AS dl, term, count(*) AS tf FROM (SELECT record_id, t, unnest(t) AS term FROM termed) GROUP BY record_id, term
), terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term
), stats AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total_tokens, greatest(1.0, sum(len(t)) / count(*)) AS avgdl FROM termed
), asked AS (SELECT record_id AS query_id, string_split(text, chr(10))[1] AS qt FROM records WHERE record_id % 20 = 0
), qterms AS (SELECT query_id, unnest({sql_query_terms('qt')}) AS term FROM asked)"""


def bm25_sql(where: str = "true", top: int = 24, before: str = _L) -> str:
    return f"""{before}, scored AS (
  SELECT query_id, record_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qterms JOIN terms USING (term) JOIN postings USING (term) CROSS JOIN stats WHERE {where} GROUP BY query_id, record_id
), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) - 1 AS lex_rank FROM scored QUALIFY lex_rank < {top})"""


_CUT = """, kept AS (SELECT * FROM lex QUALIFY score >= max(score) OVER (PARTITION BY query_id) / 1.5)"""
def ground_sql(hits: str, kind: str = "plain") -> str:
    """CTEs from ``hits`` (query_id, record_id, rank), ``asked`` (query_id, qt) and ``records`` to ``graded``; of kind ``weighted``, with
    ``common`` (w), to ``weighed`` (query_id, mean)."""
    plain = "CASE WHEN t LIKE '%''s' THEN left(t, length(t) - 2) WHEN t LIKE '%s''' OR t LIKE '%''' THEN left(t, length(t) - 1) ELSE t END"
    words = f"list_distinct(list_transform(regexp_extract_all(lower({{}}), '[a-z0-9'']+'), lambda t: {plain}))"
    forms = "(list_contains({0}, w) OR list_contains({0}, w || 's') OR list_contains({0}, w || 'es') OR (w LIKE '%s' AND list_contains({0}, left(w, length(w) - 1))))"
    if kind == "plain":
        lists = f"wordlists AS (SELECT query_id, {sql_grounding_words('qt')} AS k FROM asked\n), firsts AS (SELECT query_id, {SQL_FIRSTS} AS ws FROM wordlists"
        out = """graded AS (
  SELECT query_id, record_id, round(avg(c), 3) AS coverage, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (c > 0), '') AS covered,
    coalesce(string_agg(w, ' ' ORDER BY i) FILTER (c = 0), '') AS uncovered, avg(c) AS mean, rank FROM credited GROUP BY query_id, record_id, rank
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mean DESC, rank) = 1
)"""
    else:
        lists = f"firsts AS (SELECT query_id, {sql_coverage_words('qt')} AS ws FROM asked"
        out = """weighed AS (
  SELECT query_id, record_id, sum(c * u) / sum(u) AS mean FROM (SELECT *, CASE WHEN w IN (SELECT w FROM common) THEN 1 / 3 ELSE 1.0 END AS u FROM credited) GROUP BY query_id, record_id
)"""
    return f""", {lists}
), seen AS (
  SELECT query_id, record_id, rank, ws, {words.format("string_split(text, chr(10))[1]")} AS head,
    {words.format("regexp_replace(text, '^[^\n]*\n?', '')")} AS body
  FROM {hits} JOIN firsts USING (query_id) JOIN records USING (record_id) WHERE rank <= 5 AND len(ws) > 0
), stemmed AS (SELECT *, list_transform(body, lambda b: {sql_stem('b')}) AS stems FROM seen
), each AS (SELECT query_id, record_id, rank, head, body, stems, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM stemmed
), credited AS (
  SELECT query_id, record_id, rank, w, i, CASE WHEN {forms.format('body')} OR list_contains(stems, {sql_stem('w')}) THEN 1.0 WHEN {forms.format('head')} THEN 0.5 ELSE 0.0 END AS c FROM each
), {out}"""


def _kmeans_sql(steps: int) -> str:
    out = f"{_V}, c0 AS (SELECT label AS centre, arg_min(v, record_id) AS qv FROM rows GROUP BY label\n)"
    for k in range(steps + 1):
        out += f""", n{k} AS (
  SELECT record_id, v, centre, {_COS} AS distance FROM rows CROSS JOIN c{k} QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY {_COS}, centre) = 1
), s{k} AS (SELECT centre, i, sum(v[i]) AS x FROM n{k} CROSS JOIN range(1, {DIM + 1}) r(i) GROUP BY centre, i
), m{k} AS (SELECT centre, list(x ORDER BY i) AS m FROM s{k} GROUP BY centre
), c{k + 1} AS (SELECT centre, coalesce(list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))), qv) AS qv FROM c{k} LEFT JOIN m{k} USING (centre))"""
    return out + f" SELECT CAST(centre AS BIGINT) AS centre, count(*) AS n, round(avg(distance), 5) AS distance FROM n{steps} GROUP BY centre"


SQL = {
    "v1_valid": """
SELECT vec_id, coalesce(len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) > 1e-30, false) AS valid FROM minilm_f32_kernel_test_vectors""",
    "v2_norms": f"{_V} SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 6) AS first FROM lengths",
    "v3_distances": f"""{_V} SELECT a.record_id, round(1 - greatest(-1, least(1, list_inner_product(a.v, b.v))), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS l2
FROM rows a JOIN rows b ON b.record_id = a.record_id + 1""",
    "v5_quantized": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), s AS (SELECT *, list_min(v) AS low, CASE WHEN list_max(v) - list_min(v) < 1e-30 THEN 1.0 ELSE list_max(v) - list_min(v) END AS span FROM e
), c AS (SELECT *, list_transform(v, lambda x: CAST(greatest(0, least(255, floor((x - low) * 255 / span + 0.5))) AS BIGINT)) AS q FROM s)
SELECT vec_id, array_to_string(q, ',') AS q, round(span / 255, 9) AS scale, round(low, 9) AS "offset", CAST(list_sum(q) AS BIGINT) AS sum_q,
  CAST(list_sum(list_transform(q, lambda x: x * x)) AS BIGINT) AS sum_q2 FROM c""",
    "v6_restored": """
WITH r AS (SELECT row_id, list_transform(qdata, lambda x: CAST(q_offset AS DOUBLE) + CAST(q_scale AS DOUBLE) * x) AS v FROM uint8_snapshot_graph WHERE qdata IS NOT NULL AND q_scale IS NOT NULL AND q_offset IS NOT NULL)
SELECT row_id, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM r""",
    "v10_sketches": f"{_CODED} SELECT record_id, array_to_string(sk, ',') AS sketch FROM sketched",
    "v13_hash_embeddings": """
WITH t AS (SELECT DISTINCT title FROM record_chunks WHERE title IS NOT NULL
), w AS (SELECT title, unnest(regexp_split_to_array(lower(title), ' +')) AS w FROM t
), h AS (SELECT title, w, sha256(w) AS h FROM w
), x AS (SELECT title, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) % 16 AS i, CAST(('0x' || h[9:10]) AS BIGINT) / 255 * 2 - 1 AS x FROM h
), s AS (SELECT title, i, sum(x) AS x FROM x GROUP BY title, i
), v AS (SELECT t.title, list(coalesce(x, 0.0) ORDER BY r.i) AS v FROM t CROSS JOIN range(16) r(i) LEFT JOIN s ON s.title = t.title AND s.i = r.i GROUP BY t.title)
SELECT title, CAST(round(v[1] / n, 6) AS DOUBLE) AS first, round(list_sum(list_transform(range(1, 17), lambda i: i * v[i])) / n, 6) AS weighed
FROM (SELECT title, v, CASE WHEN list_inner_product(v, v) > 0 THEN sqrt(list_inner_product(v, v)) ELSE 1 END AS n FROM v)""",
    "n1_knn": _knn_sql(10) + _SHOW,
    "n1_knn_l2": _knn_sql(10, "round(list_distance(qv, v), 9)") + _SHOW,
    "n3_filtered": _knn_sql(10, where="query_id <> record_id AND record_id % 10 = 3") + _SHOW,
    "n8_masked": _knn_sql(10, where="query_id <> record_id AND record_id % 17 <> 0") + _SHOW,
    "n4_two_stage": _stage_sql("(SELECT least(count(*), 100) FROM embeddings)")
    + " SELECT query_id, record_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) - 1 AS vec_rank FROM exact QUALIFY vec_rank < 5",
    "n9_collapsed": _knn_sql(40)
    + """, named AS (SELECT query_id, record_id AS row_id, record_id // 4 AS record_id, distance FROM near
), one AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, record_id ORDER BY distance, row_id) = 1)
SELECT query_id, record_id, row_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) - 1 AS vec_rank FROM one QUALIFY vec_rank < 5""",
    "n10_ghosts": """
SELECT count(*) AS rows, count(*) FILTER (vec_id % 17 = 0) AS deleted, round(count(*) FILTER (vec_id % 17 = 0) / count(*), 6) AS ghost_ratio FROM embeddings""",
    "n11_compacted": "SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 17 <> 0",
    "n6_staged": _CODED
    + f""", coarse AS (
  SELECT *, list_transform(range(0, {DIM // POOL // 4}), lambda i: CAST(least(15, floor(floor(list_avg(q[i * {4 * POOL} + 1:(i + 1) * {4 * POOL}]) + 0.5) / 17 + 0.5)) AS INTEGER)) AS mk FROM sketched
), pooled AS (SELECT *, list_transform(range(0, {DIM // POOL // 4}), lambda i: list_avg(qv[i * {4 * POOL} + 1:(i + 1) * {4 * POOL}])) AS qc FROM means
), one AS (
  SELECT query_id, qv, qm, qs, record_id, q, s, o, sk, round(1 - greatest(-1, least(1, {4 * POOL} * list_inner_product(qc, list_transform(mk, lambda x: o + s * (x * 17.0))))), 9) AS md FROM pooled CROSS JOIN coarse
), two AS (
  SELECT *, round(1 - greatest(-1, least(1, {POOL} * list_inner_product(qm, list_transform(sk, lambda x: o + s * (x * 17.0))))), 9) AS sd FROM one
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY md, record_id) <= 4 * (SELECT least(count(*), 100) FROM embeddings)
), three AS (
  SELECT query_id, record_id, round(1 - greatest(-1, least(1, o * qs + s * list_inner_product(qv, CAST(q AS DOUBLE[])))), 9) AS distance FROM two
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sd, record_id) <= (SELECT least(count(*), 100) FROM embeddings)
)
SELECT query_id, record_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) - 1 AS vec_rank FROM three QUALIFY vec_rank < 5""",
    "n13_rerank_sweep": _CODED
    + f""", far AS (
  SELECT query_id, record_id, round(1 - greatest(-1, least(1, {POOL} * list_inner_product(qm, list_transform(sk, lambda x: o + s * (x * 17.0))))), 9) AS sd,
    round(1 - greatest(-1, least(1, o * qs + s * list_inner_product(qv, CAST(q AS DOUBLE[])))), 9) AS distance
  FROM (SELECT * FROM means QUALIFY row_number() OVER (ORDER BY query_id) - 1 IN (SELECT CAST(floor(i * greatest(1.0, (SELECT count(*) FROM asked) / 256)) AS BIGINT) FROM range(256) t(i))) CROSS JOIN sketched
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sd, record_id) AS c, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS best FROM far
), size AS (SELECT count(*) AS live FROM embeddings
), depths AS (
  SELECT unnest(list_append(list_filter([10, 15, 20, 30, 40, 60, 80, 120, 160, 240, 320, 480, 640], lambda x: x >= least(10, live) AND x < least(live, 4096)), least(live, 4096))) AS depth FROM size
), found AS (SELECT depth, best FROM placed JOIN depths ON c <= depth QUALIFY row_number() OVER (PARTITION BY depth, query_id ORDER BY distance, record_id) <= 10
), curve AS (SELECT depth, round(count(*) FILTER (best <= 10) / (SELECT count(*) FROM placed WHERE best <= 10), 4) AS recall FROM found GROUP BY depth)
SELECT depth, recall, depth = (SELECT coalesce(min(depth) FILTER (recall >= 0.98), max(depth)) FROM curve) AS chosen FROM curve""",
    "n14_self_recall": _knn_sql(5, where="true") + " SELECT vec_rank, count(*) AS n FROM near WHERE query_id = record_id GROUP BY vec_rank",
    "n15_lloyd_step": f"""{_V}, centres AS (SELECT label AS centre, arg_min(v, record_id) AS qv FROM rows GROUP BY label
), far AS (SELECT record_id, label, centre, {_COS} AS distance FROM rows CROSS JOIN centres
), near AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY distance, centre) = 1)
SELECT CAST(centre AS BIGINT) AS centre, label, count(*) AS n FROM near GROUP BY centre, label""",
    "n15_kmeans": _kmeans_sql(3),
    "l3_term_stats": f"{_L} SELECT term, df FROM terms",
    "l3_corpus_stats": f"{_L} SELECT n, total_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "l4_df": f"{_L} SELECT query_id, term, df FROM qterms JOIN terms USING (term)",
    "l5_bm25": bm25_sql() + " SELECT query_id, record_id, round(score, 4) AS score, lex_rank FROM lex",
    "l6_excluded": bm25_sql("record_id % 17 <> 0") + " SELECT query_id, record_id, round(score, 4) AS score, lex_rank FROM lex",
    "l7_cutoff": bm25_sql() + _CUT + " SELECT query_id, record_id, round(score, 4) AS score, lex_rank FROM kept",
    "h11_catalog": _knn_sql(3)
    + " SELECT query_id, record_id, vec_rank, p_name, p_name IS NULL AS missing FROM near LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 5) ON p_partkey = record_id",
    "g4_known": f"""{_L}, vocab AS (
  SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM records) GROUP BY word
  HAVING count(*) >= (SELECT CASE WHEN count(*) >= 200 THEN 3 ELSE 1 END FROM records)
), w AS (SELECT query_id, unnest(regexp_extract_all(lower(qt), '[a-z0-9'']+')) AS word FROM asked
), m AS (SELECT query_id, count(*) AS n, count(vocab.word) AS k FROM w LEFT JOIN vocab USING (word) GROUP BY query_id)
SELECT query_id, round(k / n, 6) AS known FROM asked LEFT JOIN m USING (query_id)""",
    "g6_common": f"""{_L}, w AS (SELECT record_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS word FROM records)
SELECT word, count(*) AS df FROM w WHERE length(word) >= 3 AND word NOT IN ({sql_quoted(T.GROUNDING_STOPWORDS)}) GROUP BY word HAVING count(*) > (SELECT greatest(4, round(count(*) * 0.05)) FROM records)""",
    "g8_signals": _knn_sql(10)
    + """ SELECT query_id, round(min(distance), 6) AS d0, round(max(distance) FILTER (vec_rank <= 4) - min(distance), 6) AS margin, round(avg(distance), 6) AS mean10 FROM near GROUP BY query_id""",
    "g15_auc": """
WITH s AS (SELECT label, length(text) AS score FROM abstention_examples WHERE label IS NOT NULL AND text IS NOT NULL
), h AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM s GROUP BY score
), r AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won FROM h)
SELECT round(sum(won) / (sum(p) * sum(q)), 6) AS auc FROM r""",
    "g16_entities": """
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9'']*'))) AS word FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), low AS (SELECT DISTINCT word FROM w WHERE word = lower(word))
SELECT word, count(*) AS df FROM w WHERE regexp_matches(word, '^[A-Z][A-Za-z0-9'']{2,}$') AND NOT regexp_matches(word, '^[IVXLCDM]+$') AND lower(word) NOT IN (SELECT word FROM low)
GROUP BY word HAVING count(*) <= (SELECT greatest(2, ceil(count(*) * 0.4)) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)""",
}
