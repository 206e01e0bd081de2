"""Queries of hybrid retrieval over all documents: sketch candidates and BM25, fused, pinned, hydrated, grounded and judged.

Every document of at least one word has a vector by the hashing encoder. Questions are the documents whose number is divisible
by 20, each asked with its first line, against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import encode, fusion, grounding
from skerry.pack import Pack
from skerry.plans.search import DIM, K, POOL, bm25_sql, ground_sql
from skerry.plans.texts import sql_index_terms, sql_query_terms, sql_quoted, sql_tokens, sql_trim
from skerry.session import bounded_collect, cut, spread, stored, table

#: Packs of one table at most; more are an error.
MOST_PACKS = 1_000


def records_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("doc_id").isNotNull() & T.worded(F.col("text")))
    return spread(rows.select(F.col("doc_id").alias("record_id"), "text", "lang", "source"))


def questions_of(records: DataFrame) -> DataFrame:
    """``query_id, text, vector``; encoded once."""
    asked = records.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("text")).where(T.worded(F.col("text")))
    return cut(encode.hash_vectors(asked.withColumn("words", F.col("text")), "words", DIM))


def pack_of(records: DataFrame) -> Pack:
    keys = ["pack"] if "pack" in records.columns else []
    records = stored(records)
    return Pack.compile(records, encode.hash_vectors(records.select("record_id", *keys, "text"), "text", DIM), DIM, POOL, checked=False)


def _asked(spark: SparkSession, d: str) -> tuple[Pack, DataFrame, DataFrame, DataFrame]:
    """(pack, questions, vector candidates, lexical candidates)."""
    records = records_of(spark, d)
    pack = pack_of(records)
    questions = questions_of(pack.records)
    return pack, questions, *pack.candidates(questions, K)


def _ranks(hits: DataFrame) -> DataFrame:
    long = [F.col(c).cast("long").alias(c) for c in ("vec_rank", "lex_rank", "fused_rank")]
    return hits.where("fused_rank < 10").select("query_id", "record_id", F.round("distance", 6).alias("distance"), *long)


def h1_fused(spark: SparkSession, d: str) -> DataFrame:
    _, _, vec, lex = _asked(spark, d)
    return _ranks(fusion.fuse(vec, lex))


def h3_pinned(spark: SparkSession, d: str) -> DataFrame:
    pack, questions, vec, lex = _asked(spark, d)
    return _ranks(fusion.pin_phrases(fusion.fuse(vec, lex), lex, questions, pack.records))


def h4_modes(spark: SparkSession, d: str) -> DataFrame:
    _, _, vec, lex = _asked(spark, d)
    out = [fusion.by_mode(vec, lex, m, K).select(F.lit(m).alias("mode"), "query_id", "record_id", F.col("rank").cast("long").alias("rank")) for m in fusion.MODES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def h6_hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: fused, guarded and pinned hits of every query, their records, and how its best passages ground it."""
    pack, questions, vec, lex = _asked(spark, d)
    hits = cut(pack.hits(questions, vec, lex, K))
    grounded = pack.ground(questions, hits).select("query_id", "coverage", F.array_join("uncovered", " ").alias("uncovered"))
    out = pack.hydrate(hits).join(grounded, "query_id", "left")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "record_id", F.round("distance", 6).alias("distance"), "source", F.substring("text", 1, 220).alias("preview"), "coverage", "uncovered")


def h8_multi_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every pack (language) answers every question by its own hybrid query, under its own statistics; nothing merges over packs."""
    records = records_of(spark, d).where("lang is not null")
    names = sorted(r[0] for r in bounded_collect(records.select("lang").distinct(), MOST_PACKS, "the list of packs"))
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1 if names else F.lit(0).cast("long")
    pack = pack_of(records.withColumn("pack", number))
    # A question to a pack is a query of its own.
    asked = questions_of(records_of(spark, d)).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, len(names) - 1)).cast("long"))))
    asked = asked.withColumn("query_id", F.col("query_id") * max(1, len(names)) + F.col("pack"))
    hits = pack.hits(asked.drop("pack"), *pack.candidates(asked, K), K)
    named = F.element_at(F.array(*[F.lit(n) for n in names or [""]]), (F.col("query_id") % max(1, len(names)) + 1).cast("int"))
    return hits.select(F.floor(F.col("query_id") / max(1, len(names))).alias("query_id"), named.alias("pack"), "record_id", F.col("rank").cast("long").alias("rank"))


def h10_fusion_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule of fusion (constant, weight, guard) ranks a question's own document first and among five."""
    _, _, vec, lex = _asked(spark, d)
    found = fusion.simulate(vec, lex, [(60.0, 0.5, 0.05), (60.0, 1.0, 1e9), (20.0, 0.5, 0.05), (60.0, 0.25, 0.05), (60.0, 0.0, 0.05)])
    own = found.where("query_id = record_id")
    asked = vec.select("query_id").distinct().agg(F.count(F.lit(1)).alias("asked"))
    rates = own.groupBy("rule").agg(F.count(F.when(F.col("fused_rank") == 0, 1)).alias("first"), F.count(F.when(F.col("fused_rank") < 5, 1)).alias("near"))
    return rates.crossJoin(asked).select("rule", F.round(F.col("first") / F.col("asked"), 6).alias("success1"), F.round(F.col("near") / F.col("asked"), 6).alias("success5"))  # one row


def _fused_hits(pack: Pack, questions: DataFrame, vec: DataFrame, lex: DataFrame) -> DataFrame:
    return pack.hits(questions, vec, lex, grounding.DEPTH)


def g3_grounding(spark: SparkSession, d: str) -> DataFrame:
    pack, questions, vec, lex = _asked(spark, d)
    found = pack.ground(questions, _fused_hits(pack, questions, vec, lex))
    return found.select("query_id", "record_id", "coverage", F.array_join("covered", " ").alias("covered"), F.array_join("uncovered", " ").alias("uncovered"))


def g9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The greatest coverage of each question among its first five passages, common words at a third."""
    pack, questions, vec, lex = _asked(spark, d)
    common = grounding.common_words(pack.records, "record_id", "text")
    found = grounding.coverage1(questions, _fused_hits(pack, questions, vec, lex), pack.records, common)
    return found.select("query_id", F.round("coverage1", 5).alias("coverage1"))


#: A model for the queries below: signals and coverage, and a gate of distances alone.
MODEL = {"features": ["d0", "margin", "mean10", "known"], "mean": [0.2, 0.15, 0.35, 0.9], "scale": [0.15, 0.1, 0.15, 0.2], "weights": [-1.1, 0.4, -0.6, 0.3], "bias": 0.4, "hard": 0.35, "weak": 0.6}
COVERAGE = (0.6, 0.25, 0.9)
GATE = grounding.Gate(["d0", "mean10"], [0.2, 0.35], [0.15, 0.15], [-1.0, -0.5], 1.5, 0.55)


def _judged(pack: Pack, questions: DataFrame, vec: DataFrame, lex: DataFrame, gate: grounding.Gate | None) -> DataFrame:
    signals = grounding.retrieval_signals(vec).join(grounding.known_fraction(questions, grounding.vocabulary(pack.records, "text")), "query_id")
    cover = grounding.coverage1(questions, _fused_hits(pack, questions, vec, lex), pack.records, grounding.common_words(pack.records, "record_id", "text"))
    return grounding.verdicts(signals.join(cover, "query_id"), **MODEL, coverage=COVERAGE, gate=gate)


def g10_verdicts(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(*_asked(spark, d), GATE)
    return judged.select("query_id", F.round("p", 4).alias("p"), "verdict")


def g11_withheld(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the questions that are answered, by a verdict without gate."""
    pack, questions, vec, lex = _asked(spark, d)
    judged = cut(_judged(pack, questions, vec, lex, None))
    return grounding.withheld(pack.hits(questions, vec, lex, K), judged).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (h1_fused, h3_pinned, h4_modes, h6_hybrid_query, h8_multi_pack, h10_fusion_rules, g3_grounding, g9_coverage, g10_verdicts, g11_withheld)}


def hash_sql(source: str, name: str) -> str:
    """CTEs from ``source`` (id, t) to ``name`` (id, v): vectors of the hashing encoder, rounded."""
    return f"""{name}_words AS (SELECT id, unnest({sql_tokens('lower(t)')}) AS w FROM {source}
), {name}_known AS (
  SELECT w, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) % {DIM} AS i, CAST(('0x' || h[9:10]) AS BIGINT) / 255 * 2 - 1 AS x
  FROM (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM {name}_words))
), {name}_sums AS (SELECT id, i, sum(x) AS x FROM {name}_words JOIN {name}_known USING (w) GROUP BY id, i
), {name}_lists AS (
  SELECT s.id, list(coalesce(x, 0.0) ORDER BY r.i) AS v FROM {source} s CROSS JOIN range({DIM}) r(i) LEFT JOIN {name}_sums u ON u.id = s.id AND u.i = r.i GROUP BY s.id
), {name} AS (SELECT id, list_transform(v, lambda c: round(c / CASE WHEN n > 0 THEN n ELSE 1 END, 9)) AS v FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM {name}_lists)
)"""


_UNIT = "list_transform(v, lambda c: c / CASE WHEN n > 0 THEN n ELSE 1 END)"


def candidates_sql(records: str = "true", live: str = "true", pack: str = "0", each: str = "0", depth: int = 100) -> str:
    """CTEs to ``vec`` (pack, query_id, record_id, distance, vec_rank) and ``kept`` (lexical candidates, lex_rank).

    ``pack`` is a record's pack, under whose statistics it is scored; ``each`` what sketch candidates are cut by besides.
    """
    return f"""
WITH records AS (
  SELECT doc_id AS record_id, text, lang, source, {pack} AS pack, {each} AS tier FROM documents WHERE doc_id IS NOT NULL AND {sql_trim('text')} <> '' AND {records}
), asked AS (
  SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS qt FROM documents WHERE doc_id % 20 = 0 AND {sql_trim('text')} <> '' AND {sql_trim("string_split(text, chr(10))[1]")} <> ''
), rtexts AS (SELECT record_id AS id, text AS t FROM records), qtexts AS (SELECT query_id AS id, qt AS t FROM asked
), {hash_sql('rtexts', 'rv')}, {hash_sql('qtexts', 'qv')}
, units AS (SELECT id AS record_id, {_UNIT} AS v FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM rv)
), spans AS (SELECT record_id, v, list_min(v) AS low, CASE WHEN list_max(v) - list_min(v) < 1e-30 THEN 1.0 ELSE list_max(v) - list_min(v) END AS span FROM units
), coded AS (SELECT record_id, low AS o, span / 255 AS s, list_transform(v, lambda x: CAST(greatest(0, least(255, floor((x - low) * 255 / span + 0.5))) AS INTEGER)) AS q FROM spans
), sketched AS (
  SELECT coded.*, pack, tier, list_transform(range(0, {DIM // POOL}), lambda i: CAST(least(15, floor(floor((q[i * {POOL} + 1] + q[i * {POOL} + 2]) / 2 + 0.5) / 17 + 0.5)) AS INTEGER)) AS sk
  FROM coded JOIN records USING (record_id) WHERE {live}
), means AS (
  SELECT query_id, qv, list_transform(range(0, {DIM // POOL}), lambda i: (qv[i * {POOL} + 1] + qv[i * {POOL} + 2]) / 2) AS qm, list_sum(qv) AS qs
  FROM (SELECT id AS query_id, {_UNIT} AS qv FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM qv))
), rough AS (
  SELECT query_id, record_id, pack, tier, round(1 - greatest(-1, least(1, {POOL} * list_inner_product(qm, list_transform(sk, lambda x: o + s * (x * 17.0))))), 9) AS sd FROM means CROSS JOIN sketched
), first AS (SELECT query_id, pack, record_id FROM rough QUALIFY row_number() OVER (PARTITION BY query_id, pack, tier ORDER BY sd, record_id) <= {depth}
), termed AS (SELECT record_id, pack, {sql_index_terms('text')} AS t FROM records
), postings AS (SELECT record_id, pack, any_value(len(t)) AS dl, term, count(*) AS tf FROM (SELECT record_id, pack, t, unnest(t) AS term FROM termed) GROUP BY record_id, pack, term
), terms AS (SELECT pack, term, count(*) AS df FROM postings GROUP BY pack, term
), stats AS (SELECT pack, count(*) AS n, greatest(1.0, sum(len(t)) / count(*)) AS avgdl FROM termed GROUP BY pack
), qterms AS (SELECT query_id, unnest({sql_query_terms('qt')}) AS term FROM asked
), scored AS (
  SELECT query_id, pack, record_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qterms JOIN terms USING (term) JOIN postings USING (term, pack) JOIN stats USING (pack) WHERE {live} GROUP BY query_id, pack, record_id
), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id, pack ORDER BY score DESC, record_id) - 1 AS lex_rank FROM scored QUALIFY lex_rank < 24
), kept AS (SELECT * FROM lex QUALIFY score >= max(score) OVER (PARTITION BY query_id, pack) / 1.5
), both_kinds AS (SELECT query_id, pack, record_id FROM first UNION SELECT query_id, pack, record_id FROM kept
), exact AS (
  SELECT query_id, pack, record_id, round(1 - greatest(-1, least(1, o * qs + s * list_inner_product(qv, CAST(q AS DOUBLE[])))), 9) AS distance
  FROM both_kinds JOIN coded USING (record_id) JOIN means USING (query_id)
), vec AS (SELECT *, row_number() OVER (PARTITION BY query_id, pack ORDER BY distance, record_id) - 1 AS vec_rank FROM exact)"""


def fused_sql(rrf: str = "60", weight: str = "0.5", guard: str = "0.05", source: str = "vec LEFT JOIN kept USING (query_id, pack, record_id)", rule: str = "") -> str:
    """CTE ``fused``; ``rule`` is a further column (with a comma) of the grid of rules."""
    by = f"query_id, pack{', ' + rule if rule else ''}"
    return f""", joined AS (
  SELECT query_id, pack, record_id, distance, vec_rank, lex_rank{', ' + rule if rule else ''}, round(1 / ({rrf} + vec_rank) + coalesce({weight} / ({rrf} + lex_rank), 0), 12) AS fs, {guard} AS margin,
    bool_or(lex_rank IS NOT NULL) OVER w AS has_lex, max(CASE WHEN vec_rank = 0 THEN distance END) OVER w AS d1, max(CASE WHEN vec_rank = 1 THEN distance END) OVER w AS d2
  FROM {source} WINDOW w AS (PARTITION BY {by})
), guarded AS (
  SELECT *, has_lex AND vec_rank = 0 AND coalesce(CASE WHEN d1 = 0 THEN d2 > 0 ELSE (d2 - d1) / d1 >= margin END, false) AS forced FROM joined
), fused AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN forced THEN 0 ELSE 1 END, CASE WHEN has_lex THEN fs ELSE -vec_rank END DESC, distance, vec_rank) - 1 AS fused_rank FROM guarded
)"""


_FORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"
_PINNED = f""", phrases AS (SELECT query_id, {_FORM.format('qt')} AS phrase FROM asked WHERE len(string_split({_FORM.format('qt')}, ' ')) >= 3
), pins AS (
  SELECT query_id, kept.pack, arg_min(record_id, lex_rank) AS pin FROM kept JOIN phrases USING (query_id) JOIN records USING (record_id)
  WHERE lex_rank < 3 AND contains({_FORM.format('text')}, phrase) GROUP BY query_id, kept.pack
), pinned AS (
  SELECT fused.* EXCLUDE (fused_rank), row_number() OVER (PARTITION BY query_id, pack ORDER BY CASE WHEN record_id = pin THEN 0 ELSE 1 END, fused_rank) - 1 AS fused_rank
  FROM fused LEFT JOIN pins USING (query_id, pack)
)"""
_FUSE = candidates_sql() + fused_sql()
_PIN = _FUSE + _PINNED
_HITS = ", hits AS (SELECT query_id, record_id, distance, fused_rank + 1 AS rank FROM pinned WHERE fused_rank < 5)"
_OUT = " SELECT query_id, record_id, round(distance, 6) AS distance, vec_rank, lex_rank, fused_rank FROM {} WHERE fused_rank < 10"
_STOPS = sql_quoted(T.GROUNDING_STOPWORDS)
_JUDGED = f"""{_PIN}{_HITS}, common AS (
  SELECT w FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS w FROM records) WHERE length(w) >= 3 AND w NOT IN ({_STOPS})
  GROUP BY w HAVING count(*) > (SELECT greatest(4, round(count(*) * 0.05)) FROM records)
){ground_sql('hits', 'weighted')}, covered1 AS (SELECT query_id, coalesce(max(mean), 0.0) AS coverage1 FROM asked LEFT JOIN weighed USING (query_id) GROUP BY query_id
), vocab AS (
  SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM records) GROUP BY word
  HAVING count(*) >= (SELECT CASE WHEN count(*) >= 200 THEN 3 ELSE 1 END FROM records)
), said AS (SELECT query_id, unnest(regexp_extract_all(lower(qt), '[a-z0-9'']+')) AS word FROM asked
), knew AS (SELECT query_id, count(vocab.word) / count(*) AS known FROM said LEFT JOIN vocab USING (word) GROUP BY query_id
), sig AS (
  SELECT query_id, max(distance) FILTER (vec_rank = 0) AS d0, arg_max(distance, vec_rank) FILTER (vec_rank <= 4) - max(distance) FILTER (vec_rank = 0) AS margin, avg(distance) AS mean10
  FROM vec WHERE vec_rank < 10 GROUP BY query_id
), scores AS (
  SELECT query_id, 1 / (1 + exp(-(0.4 + (d0 - 0.2) / 0.15 * -1.1 + (margin - 0.15) / 0.1 * 0.4 + (mean10 - 0.35) / 0.15 * -0.6 + (known - 0.9) / 0.2 * 0.3 + (coverage1 - 0.6) / 0.25 * 0.9))) AS p,
    1 / (1 + exp(-(1.5 + (d0 - 0.2) / 0.15 * -1.0 + (mean10 - 0.35) / 0.15 * -0.5))) AS y
  FROM sig LEFT JOIN knew USING (query_id) JOIN covered1 USING (query_id)
)"""

SQL = {
    "h1_fused": _FUSE + _OUT.format("fused"),
    "h3_pinned": _PIN + _OUT.format("pinned"),
    "h4_modes": _FUSE
    + """, modes AS (
  SELECT 'hybrid' AS mode, query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM fused
  UNION ALL SELECT 'vector', query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_rank) FROM fused
  UNION ALL SELECT 'augmented', query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_rank) FROM fused
  UNION ALL SELECT 'lexical', query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY lex_rank) FROM fused WHERE lex_rank IS NOT NULL
) SELECT mode, query_id, record_id, rank FROM modes WHERE rank <= 5""",
    "h6_hybrid_query": _PIN
    + _HITS
    + ground_sql("hits")
    + """ SELECT hits.query_id, hits.rank, hits.record_id, round(distance, 6) AS distance, source, left(text, 220) AS preview, coverage, uncovered
FROM hits JOIN records USING (record_id) LEFT JOIN graded ON graded.query_id = hits.query_id""",
    "h8_multi_pack": candidates_sql("lang IS NOT NULL", pack="lang") + fused_sql() + _PINNED + " SELECT query_id, pack, record_id, fused_rank + 1 AS rank FROM pinned WHERE fused_rank < 5",
    "h10_fusion_rules": candidates_sql()
    + """, rules AS (
  SELECT * FROM (VALUES ('k=60 w=0.5 guard=0.05', 60.0, 0.5, 0.05), ('k=60 w=1.0 guard=none', 60.0, 1.0, 1e9), ('k=20 w=0.5 guard=0.05', 20.0, 0.5, 0.05), ('k=60 w=0.25 guard=0.05', 60.0, 0.25, 0.05), ('k=60 w=0.0 guard=0.05', 60.0, 0.0, 0.05)) t(rule, k, w, g)
), grid AS (SELECT * FROM vec LEFT JOIN kept USING (query_id, pack, record_id) CROSS JOIN rules)"""
    + fused_sql("k", "w", "g", "grid", "rule")
    + """ SELECT rule, round(count(*) FILTER (fused_rank = 0) / (SELECT count(DISTINCT query_id) FROM vec), 6) AS success1, round(count(*) FILTER (fused_rank < 5) / (SELECT count(DISTINCT query_id) FROM vec), 6) AS success5
FROM fused WHERE query_id = record_id GROUP BY rule""",
    "g3_grounding": _PIN + _HITS + ground_sql("hits") + " SELECT query_id, record_id, coverage, covered, uncovered FROM graded",
    "g9_coverage": _JUDGED + " SELECT query_id, round(coverage1, 5) AS coverage1 FROM covered1",
    "g10_verdicts": _JUDGED
    + " SELECT query_id, round(p, 4) AS p, CASE WHEN p IS NULL THEN 'unscored' WHEN y < 0.55 THEN 'none' WHEN p < 0.6 THEN 'weak' ELSE 'strong' END AS verdict FROM scores",
    "g11_withheld": _JUDGED + " SELECT query_id, record_id, rank FROM hits WHERE query_id NOT IN (SELECT query_id FROM scores WHERE p < 0.35)",
}
