"""Queries of evaluation, integrity, journals, blooms and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.text import query_terms
from skerry.operators import blooms, evaluate, grounding, integrity, journal, knn, layout, lexical
from skerry.plans.search import _CODED, _COS, _asked, _knn_sql, _questions, _records, _rows, bm25_sql
from skerry.plans.texts import SQL_FIRSTS, sql_grounding_words, sql_query_terms, sql_quoted, sql_trim
from skerry.session import cut, table

DIM = 64
GEOMETRIES = ((2, 4), (4, 4), (2, 8), (4, 8))


def e1_metrics(spark: SparkSession, d: str) -> DataFrame:
    """nDCG and recall of nearest neighbours; relevant are the vectors of the query's label."""
    rows = _rows(spark, d)
    run = knn.exact_knn(_asked(rows), rows, 100, DIM, skip_self=True).withColumn("rank", F.col("vec_rank") + 1)
    asked = rows.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "label")
    found = evaluate.label_metrics(run, asked, rows.select("record_id", "label"))
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "recall_far")])


def e1_mean(spark: SparkSession, d: str) -> DataFrame:
    return e1_metrics(spark, d).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("ndcg", "recall", "recall_far")])


def e2_success(spark: SparkSession, d: str) -> DataFrame:
    """How soon each question finds its own document by words, by source."""
    records = _records(spark, d)
    hits = lexical.bm25(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text", top=5)
    first = hits.where("query_id = record_id").select("query_id", (F.col("lex_rank") + 1).alias("first_rank"))
    asked = records.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "source").join(first, "query_id", "left")
    found = evaluate.success(asked, ["source"])
    return found.select("source", *[F.round(c, 6).alias(c) for c in ("success1", "success3", "mrr5")])


def e3_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    truth = knn.exact_knn(_asked(rows), rows, 10, DIM)
    found = knn.two_stage_knn(_asked(rows), knn.coded(rows, 4), 10, DIM, 4, 30)
    return evaluate.recall_at(found, truth).select(F.round("recall", 6).alias("recall"))


def e4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's first hit besides itself holds its first line."""
    records = _records(spark, d)
    questions = _questions(records)
    hits = lexical.bm25(lexical.build_index(records, "record_id", "text"), questions, "query_id", "text", top=3).where("query_id <> record_id")
    first = hits.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("lex_rank"))).where("p = 1")
    both = first.join(questions.withColumnRenamed("text", "quote"), "query_id").join(records.select("record_id", "text"), "record_id")
    return both.select("query_id", "record_id", evaluate.evidence_matches(F.col("quote"), F.col("text")).alias("held"))


def e5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of each family the examples with an answer, and with how many words they ask."""
    rows = table(spark, d, "abstention_examples").where("label is not null and family is not null and text is not null")
    answered = F.avg((F.col("label") == 1).cast("double"))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(answered, 6).alias("answerable"), F.round(F.avg(F.size(query_terms(F.col("text")))), 6).alias("terms"))


def e6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentiles_by_index(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def e5_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answered are examples of which the records know nine tenths of the words; right and false answers by family."""
    rows = table(spark, d, "abstention_examples").where("label is not null and family is not null and text is not null")
    asked = rows.select(F.col("example_id").alias("query_id"), "text", "family", (F.col("label") == 1).alias("answerable"))
    vocabulary = grounding.vocabulary(table(spark, d, "record_chunks").where("text is not null"), "text")
    known = grounding.known_fraction(asked, vocabulary).select("query_id", (F.coalesce("known", F.lit(0.0)) >= 0.9).alias("answered"))
    judged = asked.join(known, "query_id").withColumn("right", F.when(F.col("answered"), F.col("answerable")))
    return evaluate.answer_rates(judged, ["family"]).select("family", *[F.round(c, 6).alias(c) for c in ("right_rate", "withheld_rate", "false_answer_rate")])


def i1_digests(spark: SparkSession, d: str) -> DataFrame:
    return integrity.record_digests(_records(spark, d), "record_id", F.concat_ws("|", F.col("record_id").cast("string"), "text"))


def i3_tampered(spark: SparkSession, d: str) -> DataFrame:
    """What a check finds after every 50th record was changed, every 70th lost and ten numbered below 0 slipped in."""
    records = _records(spark, d).select("record_id", "text")
    expected = integrity.record_digests(records, "record_id", F.col("text"))
    now = records.where("record_id % 70 <> 0").withColumn("text", F.when(F.col("record_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = spark.range(-10, 0).select(F.col("id").alias("record_id"), F.lit("new").alias("text"))
    return integrity.tampered(now.unionByName(more), expected, "record_id", F.col("text"))


def k2_pages(spark: SparkSession, d: str) -> DataFrame:
    return integrity.page_digests(integrity.record_digests(_records(spark, d), "record_id", F.col("text")))


def i4_packs(spark: SparkSession, d: str) -> DataFrame:
    return integrity.pack_info(_records(spark, d), "record_id", "text", ["source"])


def i5_records(spark: SparkSession, d: str) -> DataFrame:
    """Point look-ups of the questions' records."""
    asked = _questions(_records(spark, d)).select(F.col("query_id").alias("record_id"))
    return _records(spark, d).join(asked, "record_id", "left_semi").select("record_id", "source", F.length("text").cast("long").alias("n_chars"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", F.col("event_type").alias("kind"), F.array(F.concat(F.lit("user-"), (F.col("user_id") % 5).cast("string"))).alias("tags"), "value")


def j1_valid_notes(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with notes made of chunks: kinds of the list and one that is not, headings, texts, and paths as tags."""
    rows = table(spark, d, "record_chunks")
    kind = F.element_at(F.array(*[F.lit(k) for k in (*journal.KINDS, "remark")]), (F.col("chunk_id") % 8 + 1).cast("int"))
    wrong = journal.note_problem(kind, F.col("heading"), F.col("text"), F.col("heading_path"))
    return rows.groupBy(kind.alias("kind"), wrong.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def j3_latest(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    kind = notes.agg(F.min("kind")).first()[0]
    return journal.latest(notes, "event_id", kind=kind, tag="User-3", limit=10).select("event_id", "kind", "value")


def g5_bloom(spark: SparkSession, d: str) -> DataFrame:
    """The union of the filters of even and odd records, and how many words of all records it knows."""
    records = _records(spark, d)
    words = records.select("record_id", F.explode(query_terms(F.col("text"))).alias("word"))
    bits = 1 << 16
    parts = [(blooms.build_bloom(words.where(f"record_id % 2 = {i}"), bits), bits) for i in (0, 1)]
    union = blooms.union_blooms(parts)
    known = blooms.probe(words.select("word").distinct(), union, bits)
    return known.groupBy("maybe").agg(F.count(F.lit(1)).alias("n")).crossJoin(union.agg(F.count(F.lit(1)).alias("set_bits")))  # one row


def g19_goldens(spark: SparkSession, d: str) -> DataFrame:
    """Replay of golden questions: whether the expected record is among the first ten; tombstoned expectations are skipped."""
    records = _records(spark, d)
    hits = lexical.bm25(lexical.build_index(records, "record_id", "text"), _questions(records), "query_id", "text", top=10)
    goldens = records.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "text")
    passed = hits.where("query_id = record_id").select("query_id", F.lit(True).alias("passed"))
    verdict = F.when(F.col("query_id") % 17 == 0, "skipped").when(F.col("passed"), "pass").otherwise("fail")
    return goldens.join(passed, "query_id", "left").select("query_id", verdict.alias("verdict"))


def x3_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    wanted = knn.exact_knn(_asked(rows), rows, 20, DIM).select("query_id", "record_id")
    return layout.coalesced_runs(wanted, "query_id", 8)


def x4_geometries(spark: SparkSession, d: str) -> DataFrame:
    """The share of the exact first ten in the first fifty by sketch, for each geometry."""
    rows = _rows(spark, d)
    asked = _asked(rows)
    truth = cut(knn.exact_knn(asked, rows, 10, DIM).select("query_id", "record_id"))
    out = None
    for pool, bits in GEOMETRIES:
        found = knn.sketch_candidates(asked, knn.coded(rows, pool, bits), DIM, pool, 50, bits)
        one = evaluate.recall_at(found, truth).select(F.lit(DIM // pool).alias("dims"), F.lit(bits).alias("bits"), F.round("recall", 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        e1_metrics, e1_mean, e2_success, e3_recall, e4_evidence, e5_rates, e5_answers, e6_percentiles, i1_digests, i3_tampered, k2_pages, i4_packs, i5_records,
        j1_valid_notes, j3_latest, g5_bloom, g19_goldens, x3_runs, x4_geometries,
    )
}

_E1 = _knn_sql(100) + """, asked2 AS (SELECT record_id AS query_id, label FROM rows WHERE record_id % 20 = 0
), qrels AS (SELECT query_id, r.record_id FROM asked2 a JOIN rows r ON r.label = a.label AND r.record_id <> query_id
), ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN p <= 10 THEN 1 / log2(p + 1) END) AS idcg
  FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY record_id) AS p FROM qrels) GROUP BY query_id
), got AS (
  SELECT query_id, sum(CASE WHEN vec_rank < 10 THEN 1 / log2(vec_rank + 2) END) AS dcg, count(*) FILTER (vec_rank < 10) AS near, count(*) AS found
  FROM near JOIN qrels USING (query_id, record_id) GROUP BY query_id
), m AS (
  SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(near, 0) / relevant, 6) AS recall, round(coalesce(found, 0) / relevant, 6) AS recall_far
  FROM ideal LEFT JOIN got USING (query_id)
)"""  # fmt: skip

def _geometry_sql(pool: int, bits: int) -> str:
    mean = f"floor(list_avg(q[i * {pool} + 1:(i + 1) * {pool}]) + 0.5)"
    code, value = (f"least(15, floor({mean} / 17 + 0.5))", "x * 17.0") if bits == 4 else (mean, "x * 1.0")
    return f"""SELECT {DIM // pool} AS dims, {bits} AS bits, query_id, record_id FROM (
  SELECT query_id, qv, record_id, o, s, list_transform(range(0, {DIM // pool}), lambda i: {code}) AS sk, list_transform(range(0, {DIM // pool}), lambda i: list_avg(qv[i * {pool} + 1:(i + 1) * {pool}])) AS qc FROM means CROSS JOIN coded
) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - greatest(-1, least(1, {pool} * list_inner_product(qc, list_transform(sk, lambda x: o + s * ({value}))))), 9), record_id) <= 50"""


_TRUTH = f"truth AS (SELECT query_id, record_id FROM asked CROSS JOIN rows QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COS}, record_id) <= 10)"

SQL = {
    "e3_recall": f"""{_CODED}, {_TRUTH}, pooled AS (
  SELECT query_id, qv, qs, record_id, q, o, s, list_transform(range(0, 16), lambda i: least(15, floor(floor(list_avg(q[i * 4 + 1:i * 4 + 4]) + 0.5) / 17 + 0.5))) AS sk,
    list_transform(range(0, 16), lambda i: list_avg(qv[i * 4 + 1:i * 4 + 4])) AS qc FROM means CROSS JOIN coded
), first AS (
  SELECT query_id, record_id, round(1 - greatest(-1, least(1, o * qs + s * list_inner_product(qv, CAST(q AS DOUBLE[])))), 9) AS distance FROM pooled
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - greatest(-1, least(1, 4 * list_inner_product(qc, list_transform(sk, lambda x: o + s * (x * 17.0))))), 9), record_id) <= 30
), found AS (SELECT query_id, record_id FROM first QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) <= 10)
SELECT round(count(*) / (SELECT count(*) FROM truth), 6) AS recall FROM found JOIN truth USING (query_id, record_id)""",
    "e4_evidence": bm25_sql(top=3)
    + f""", others AS (SELECT query_id, record_id FROM lex WHERE query_id <> record_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lex_rank) = 1
), said AS (
  SELECT query_id, record_id, trim(regexp_replace(lower(qt), '[^a-z0-9]+', ' ', 'g')) AS quote, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS body, {sql_grounding_words('qt')} AS k
  FROM others JOIN asked USING (query_id) JOIN records USING (record_id)
), worded AS (SELECT *, {SQL_FIRSTS} AS ws FROM said)
SELECT query_id, record_id, contains(body, quote) OR (len(ws) > 6 AND len(list_filter(ws, lambda w: list_contains(string_split(body, ' '), w))) >= 0.6 * len(ws)) AS held FROM worded""",
    "e5_answers": """
WITH r AS (SELECT text FROM record_chunks WHERE text IS NOT NULL
), vocab AS (
  SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM r) GROUP BY word HAVING count(*) >= (SELECT CASE WHEN count(*) >= 200 THEN 3 ELSE 1 END FROM r)
), e AS (SELECT example_id, family, label = 1 AS able, text FROM abstention_examples WHERE label IS NOT NULL AND family IS NOT NULL AND text IS NOT NULL
), w AS (SELECT example_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM e
), k AS (SELECT example_id, count(vocab.word) / count(*) >= 0.9 AS shown FROM w LEFT JOIN vocab USING (word) GROUP BY example_id
), j AS (SELECT family, able, coalesce(shown, false) AS shown FROM e LEFT JOIN k USING (example_id))
SELECT family, round(count(*) FILTER (able AND shown) / nullif(count(*) FILTER (able), 0), 6) AS right_rate, round(count(*) FILTER (able AND NOT shown) / nullif(count(*) FILTER (able), 0), 6) AS withheld_rate,
  round(count(*) FILTER (NOT able AND shown) / nullif(count(*) FILTER (NOT able), 0), 6) AS false_answer_rate FROM j GROUP BY family""",
    "g5_bloom": f"""
WITH w AS (SELECT DISTINCT unnest({sql_query_terms('text')}) AS word FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), h AS (
  SELECT word, list_reduce(list_transform(string_split(word, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {0x811C9DC5}::BIGINT) % 65536 AS a,
    list_reduce(list_transform(string_split(word, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {0x811C9DC5 ^ 0x9E3779B9}::BIGINT) % 65536 AS b FROM w
)
SELECT true AS maybe, count(*) AS n, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM h UNION ALL SELECT b FROM h)) AS set_bits FROM h""",
    "x4_geometries": f"""{_CODED}, {_TRUTH}, found AS ({' UNION ALL '.join(f'SELECT * FROM ({_geometry_sql(p, b)})' for p, b in GEOMETRIES)})
SELECT dims, bits, round(count(*) / (SELECT count(*) FROM truth), 6) AS recall FROM found JOIN truth USING (query_id, record_id) GROUP BY dims, bits""",
    "e1_metrics": _E1 + " SELECT query_id, ndcg, recall, recall_far FROM m",
    "e1_mean": _E1 + " SELECT round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(recall_far), 5) AS recall_far FROM m",
    "e2_success": bm25_sql(top=5)
    + """, r AS (SELECT record_id AS query_id, source FROM records WHERE record_id % 20 = 0
), f AS (SELECT r.query_id, source, lex_rank + 1 AS fr FROM r LEFT JOIN lex ON lex.query_id = r.query_id AND lex.record_id = r.query_id)
SELECT source, round(avg(CASE WHEN fr <= 1 THEN 1.0 ELSE 0.0 END), 6) AS success1, round(avg(CASE WHEN fr <= 3 THEN 1.0 ELSE 0.0 END), 6) AS success3,
  round(avg(CASE WHEN fr <= 5 THEN 1 / fr ELSE 0.0 END), 6) AS mrr5 FROM f GROUP BY source""",
    "e5_rates": r"""
SELECT family, count(*) AS n, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS answerable,
  round(avg(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) BETWEEN 2 AND 32)))), 6) AS terms
FROM abstention_examples WHERE label IS NOT NULL AND family IS NOT NULL AND text IS NOT NULL GROUP BY family""",
    "e6_percentiles": """
WITH o AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, v[1 + CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT)] AS p50, v[1 + CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT)] AS p95 FROM o""",
    "i1_digests": "SELECT doc_id AS record_id, sha256(doc_id || '|' || text) AS digest FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "i3_tampered": """
WITH r AS (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id AS record_id, CASE WHEN doc_id % 70 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM r WHERE doc_id % 70 = 0 OR doc_id % 50 = 0
UNION ALL SELECT -i, 'added' FROM range(1, 11) t(i)""",
    "k2_pages": """
SELECT doc_id // 256 AS page_no, count(*) AS n_records, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY page_no""",
    "i4_packs": """
SELECT source, count(*) AS n_records, count(DISTINCT sha256(text)) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY source""",
    "i5_records": "SELECT doc_id AS record_id, source, length(text) AS n_chars FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL",
    "j1_valid_notes": f"""
WITH k AS (SELECT [{sql_quoted(journal.KINDS)}, 'remark'][chunk_id % 8 + 1] AS kind, heading AS h, text AS t, heading_path AS p FROM record_chunks)
SELECT kind, CASE WHEN kind = 'remark' OR kind IS NULL THEN 'kind' WHEN h IS NULL OR {sql_trim('h')} = '' OR length(h) > 200 OR contains({sql_trim('h')}, chr(10)) THEN 'title'
  WHEN t IS NULL OR {sql_trim('t')} = '' OR strlen(t) > 16384 THEN 'text'
  WHEN p IS NOT NULL AND (len(p) > 20 OR len(list_filter(p, lambda x: x IS NULL OR {sql_trim('x')} = '' OR length(x) > 40)) > 0) THEN 'tags' END AS problem, count(*) AS n FROM k GROUP BY ALL""",
    "j3_latest": """
SELECT event_id, event_type AS kind, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id % 5 = 3 ORDER BY event_id DESC LIMIT 10""",
    "g19_goldens": bm25_sql(top=10)
    + """ SELECT a.query_id, CASE WHEN a.query_id % 17 = 0 THEN 'skipped' WHEN l.record_id IS NOT NULL THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT query_id FROM asked) a LEFT JOIN lex l ON l.query_id = a.query_id AND l.record_id = a.query_id""",
    "x3_runs": _knn_sql(20, where="true")
    + """, g AS (SELECT query_id, record_id, CASE WHEN coalesce(record_id - lag(record_id) OVER w > 9, true) THEN 1 ELSE 0 END AS s FROM near WINDOW w AS (PARTITION BY query_id ORDER BY record_id)
), r AS (SELECT query_id, record_id, sum(s) OVER (PARTITION BY query_id ORDER BY record_id) AS run FROM g
), t AS (SELECT query_id, run, count(*) AS n, max(record_id) - min(record_id) + 1 AS width FROM r GROUP BY query_id, run)
SELECT query_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(width) AS BIGINT) AS span FROM t GROUP BY query_id""",
}
