"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import abusive_content, container_packing, conversations, corpus_encoding, distinctive_terms, markup, near_duplicates, page_body, similar_vectors, site_style, split_overlap
from skerry.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = distinctive_terms.distinctive_terms(table(spark, d, "record_chunks"), "chunk_id", "text", "ingested_at")
    return found.select(F.col("record").alias("chunk_id"), "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms.log_entropy(table(spark, d, "record_chunks"), "chunk_id", "text", "ingested_at")
    return scored.select(F.col("record").alias("chunk_id"), "term", "tf", "df", F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tables = table(spark, d, "minilm_f32_kernel_test_vectors"), table(spark, d, "uint8_snapshot_graph")
    return similar_vectors.similar_pairs(similar_vectors.similar_in_both(*tables))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, d, "chat_messages"), table(spark, d, "chat_threads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return page_body.main_body(table(spark, d, "page_texts"))


def p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    return page_body.body_texts(table(spark, d, "page_texts"))


def _document_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicate_classes(table(spark, d, "documents"), width=3, threshold=0.6, min_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(*_document_classes(spark, d))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(*_document_classes(spark, d)).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_markup(table(spark, d, "record_chunks"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "record_chunks"))


def p6_style_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the named method makes of the records; see the README for why it does not answer p6_found."""
    return site_style.pruned_blocks(table(spark, d, "record_chunks"))


def _split_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.split_overlaps(table(spark, d, "abstention_examples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _split_overlaps(spark, d)
    return pairs.select(F.least("id_a", "id_b").alias("example_id_a"), F.greatest("id_a", "id_b").alias("example_id_b")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(_split_overlaps(spark, d), table(spark, d, "abstention_examples"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_encoding.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = corpus_encoding.token_counts(table(spark, d, "documents"))
    return container_packing.fill_containers(sizes, table(spark, d, "container_sizes"))


def p9_instructions(spark: SparkSession, d: str) -> DataFrame:
    """As instruction data: first lines bear no loss; at most 16 segments and nine tenths of loss-bearing tokens a container."""
    sizes = corpus_encoding.token_counts(table(spark, d, "documents"), prompts=True)
    return container_packing.fill_containers(sizes, table(spark, d, "container_sizes"), loss_col="n_loss", max_segments=16, loss_share=0.9)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_packing.fill_report(p9_containers(spark, d), table(spark, d, "container_sizes"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abusive_content.score_documents(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abusive_content.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abusive_content.rates(_scored(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_scores, p2_found, p3_found, p4_found, p4_bodies, p5_found, p5_groups, p6_found, p6_clean, p6_style_blocks, p7_found, p7_report, p8_ids, p9_containers, p9_instructions, p9_fill, p10_found, p10_scores, p10_rates)
}

_RECORD_TERMS = """
WITH latest AS (
  SELECT chunk_id, arg_max(text, ingested_at) AS text FROM record_chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id
), terms AS (
  SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS term FROM latest
), counted AS (
  SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY chunk_id, term
), spread AS (
  SELECT term, sum(tf) AS gf, count(*) AS df, sum(tf * ln(tf)) AS tlogt FROM counted GROUP BY term
), total AS (SELECT count(DISTINCT chunk_id) AS n FROM record_chunks WHERE chunk_id IS NOT NULL)
"""

SQL: dict[str, str] = {
    "p1_found": _RECORD_TERMS + "SELECT chunk_id, term FROM counted JOIN spread USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p1_scores": _RECORD_TERMS
    + """
SELECT chunk_id, term, tf, df, round(ln(1 + tf) * (1 - (ln(gf) - tlogt / gf) / ln(n)), 6) AS score
FROM counted JOIN spread USING (term) CROSS JOIN total""",
    "p3_found": """
WITH RECURSIVE latest AS (
  SELECT conv_id, message_id, parent, role, recipient, content FROM chat_messages
  WHERE conv_id IS NOT NULL AND message_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, message_id ORDER BY exported_at DESC) = 1
), parsed AS (
  SELECT *, lower(trim(role)) AS who,
         CASE WHEN content LIKE '{%' AND json_valid(content) AND json_extract_string(content, '$.content_type') IS NOT NULL THEN content END AS j
  FROM latest
), shown AS (
  SELECT conv_id, message_id, parent, who, recipient,
         CASE WHEN j IS NULL THEN coalesce(regexp_matches(content, '[^\\s\\x{00A0}]'), false)
              ELSE json_extract_string(j, '$.content_type') IN ('text', 'multimodal_text')
               AND len(list_filter(coalesce(CAST(json_extract(j, '$.parts') AS JSON[]), []),
                                   lambda p: json_type(p) = 'VARCHAR' AND regexp_matches(json_extract_string(p, '$'), '[^\\s\\x{00A0}]'))) > 0 END AS visible
  FROM parsed
), kinds AS (
  SELECT conv_id, message_id, parent,
         CASE WHEN visible AND who IN ('user', 'human') THEN 1
              WHEN visible AND who IN ('assistant', 'model', 'bot') AND (recipient IS NULL OR recipient = 'all') THEN 2 ELSE 0 END AS kind
  FROM shown
), sizes AS (SELECT conv_id, count(*) AS n FROM kinds GROUP BY conv_id
), walk AS (
  SELECT t.conv_id, t.current_node AS node, 0 AS up FROM chat_threads t WHERE t.current_node IS NOT NULL AND t.conv_id IS NOT NULL
  UNION ALL
  SELECT w.conv_id, k.parent, w.up + 1 FROM walk w JOIN kinds k ON k.conv_id = w.conv_id AND k.message_id = w.node JOIN sizes s ON s.conv_id = w.conv_id
  WHERE w.up <= s.n AND w.node IS NOT NULL
), ended AS (
  SELECT conv_id, bool_or(node IS NULL) AS whole FROM walk GROUP BY conv_id
), turns AS (
  SELECT w.conv_id, w.node AS message_id, w.up, k.kind FROM walk w JOIN kinds k ON k.conv_id = w.conv_id AND k.message_id = w.node
  JOIN ended e ON e.conv_id = w.conv_id AND e.whole WHERE k.kind > 0
), ends AS (
  SELECT conv_id, max(up) FILTER (kind = 1) AS first_user, arg_min(kind, up) AS last_kind FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY up DESC) AS INTEGER) AS turn_no, message_id
FROM turns JOIN ends USING (conv_id) WHERE last_kind = 2 AND up <= first_user""",
    "p5_found": """
WITH worded AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), shingled AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM worded WHERE len(w) >= 20
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled
), shared AS (
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
)
SELECT doc_id_a, doc_id_b FROM shared WHERE common / (na + nb - common) >= 0.6""",
    # DuckDB's levenshtein counts bytes, so letters outside ASCII stand as capitals, which the normalised texts lack.
    "p7_found": """
WITH known AS (
  SELECT example_id, CASE WHEN s IN ('val', 'dev') THEN 'validation' ELSE s END AS split, t FROM (
    SELECT example_id, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS s, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM abstention_examples
  ) WHERE example_id IS NOT NULL AND s IN ('train', 'validation', 'val', 'dev', 'test') AND t <> ''
), letters AS (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS c FROM (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM known) WHERE unicode(c) > 127
), plain AS (
  SELECT example_id, split, length(t) AS n, translate(t, c, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(length(c) AS INTEGER))) AS t FROM known CROSS JOIN letters
)
SELECT DISTINCT least(a.example_id, b.example_id) AS example_id_a, greatest(a.example_id, b.example_id) AS example_id_b
FROM plain a JOIN plain b ON a.split = 'train' AND b.split <> 'train' AND abs(a.n - b.n) <= greatest(a.n, b.n) // 10
WHERE a.t = b.t OR levenshtein(a.t, b.t) <= greatest(a.n, b.n) // 10""",
}
