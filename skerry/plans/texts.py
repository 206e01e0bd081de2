"""Queries of text functions, chunks and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import chunking, crawl
from skerry.session import spread, table

_DOCS = "doc_id IS NOT NULL AND text IS NOT NULL"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("doc_id is not null and text is not null"))


def t8_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def t9_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def l1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.index_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def l2_hashes(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(T.index_terms(F.col("text"))).alias("term")).distinct()
    return words.select("term", T.fnv1a32(F.col("term")).alias("h1"), T.fnv1a32(F.col("term"), 0x9E3779B9).alias("h2"))


def g1_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.grounding_words(F.substring_index("text", "\n", 1)), " ").alias("words"))


def g2_stems(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(T.index_terms(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


def t12_redacted(spark: SparkSession, d: str) -> DataFrame:
    text, count = T.redact(F.col("content"))
    rows = table(spark, d, "chat_messages").where("content is not null")
    return rows.select("message_id", "exported_at", F.sha2(text, 256).alias("digest"), count.cast("long").alias("n_redacted"))


def t13_titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.short_title(T.clean_turn(F.col("text"))).alias("title"))


def t3_slugs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, d, "record_chunks").where("doc_id is not null and heading is not null").select("doc_id", "chunk_id", "heading").distinct()
    rows = rows.withColumn("base", T.slug_base(F.col("heading")))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("chunk_id")) - 1
    return rows.select("doc_id", "chunk_id", F.when(n == 0, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("anchor"))


def t7_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "record_chunks").where("text is not null").select("chunk_id", F.sha2(T.decode_entities(F.col("text")), 256).alias("digest"))
    return rows.distinct()


def t18_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "record_chunks").where("source_path is not null").select("source_path", T.route(F.col("source_path")).alias("route")).distinct()


def t19_public(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.public_chunk(table(spark, d, "record_chunks").where("text is not null"))
    return rows.select("chunk_id", F.coalesce("url", F.lit("")).alias("url"), "preview").distinct()


def h12_shown(spark: SparkSession, d: str) -> DataFrame:
    """Records as readers see hits."""
    rows = table(spark, d, "record_chunks").where("chunk_id is not null").select("chunk_id", "title", "heading_path", "url", "source_path", "anchor", "text").distinct()
    near = F.when(F.col("chunk_id") % 4 > 0, (F.col("chunk_id") % 1000) / 1000.0)
    shown = chunking.shown_hit(F.col("chunk_id") % 9 + 1, F.col("chunk_id"), F.col("title"), F.col("heading_path"), F.coalesce("url", "source_path"), F.col("anchor"), near, F.col("text"))
    return rows.select("chunk_id", shown.alias("shown"))


def s2_globs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "record_chunks").where("source_path is not null").select("source_path").distinct()
    return rows.select("source_path", T.glob_match(F.col("source_path")).alias("taken"), T.glob_match(F.col("source_path"), "**/{guide,wiki}*/*.md").alias("guide"))


def t14_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.flat_chunks(_docs(spark, d), "doc_id", "text", target=64)
    return found.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha2("text", 256).alias("digest"))


def t17_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return chunking.first_of_text(_docs(spark, d).select("doc_id", "text"), ["doc_id"]).select("doc_id")


def t20_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "record_chunks").where("text is not null").select("chunk_id", "text").distinct()
    return chunking.sentence_windows(rows, "chunk_id", "text", 2)


def t21_dropped(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.dropped_documents(_docs(spark, d), "doc_id", "text", "source")
    return found.select("doc_id", "name", F.col("n_tokens").cast("long").alias("n_tokens"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Plain turns of each conversation, one a message; in order those without time come first."""
    rows = table(spark, d, "chat_messages").where("conv_id is not null and content is not null")
    who = F.lower(F.trim("role"))
    role = F.when(who.isin("user", "human"), "user").when(who.isin("assistant", "model", "bot"), "assistant")
    one = rows.select("conv_id", "message_id", "create_time", role.alias("role"), "content", "project", "exported_at").where("role is not null and trim(content) <> ''")
    return one.groupBy("conv_id", "message_id").agg(F.max_by(F.struct("create_time", "role", "content", "project"), F.struct("exported_at", "content")).alias("m")).select("conv_id", "message_id", "m.*")


def t10_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return chunking.exchanges(_turns(spark, d), "conv_id", ["create_time", "message_id"], "role").select("conv_id", "message_id", "exchange_no")


def t11_exchange_texts(spark: SparkSession, d: str) -> DataFrame:
    order = ["create_time", "message_id"]
    folded = chunking.exchanges(_turns(spark, d), "conv_id", order, "role")
    day = F.date_from_unix_date(F.floor(F.col("create_time") / 86_400).cast("int")).cast("string")
    texts = chunking.exchange_texts(folded, "conv_id", order, "role", "content", F.col("conv_id"), F.col("project"), day)
    return texts.select("conv_id", "exchange_no", F.sha2("text", 256).alias("digest"))


START = "https://ferrybook.example/"
ROBOTS = "User-agent: skerry/2.0\nUser-agent: other\nDisallow: /how-\nAllow: /how-*-the-\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\n\nUser-agent: Skerry\nDisallow: /*notes$\nDisallow: /*?ref=\nCrawl-delay: 5\n"


def s4_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_texts").where("url is not null")
    return rows.select("page_id", crawl.in_scope(F.col("url"), START).alias("in_scope"))


def s5_robots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_texts").where("url is not null")
    robots = crawl.robots_rules(ROBOTS, "skerry")
    return rows.select("page_id", crawl.allowed(F.col("url"), robots).alias("allowed"), F.lit(robots.crawl_delay).alias("delay"))


def s6_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_texts").where("url is not null")
    return rows.select("page_id", crawl.path_filter(F.col("url"), ["*-the-*"], ["*queue*"]).alias("taken"))


QUERIES = {
    f.__name__: f
    for f in (
        t3_slugs, t7_entities, t8_normalize, t9_tokens, t10_exchanges, t11_exchange_texts, t12_redacted, t13_titles, t14_chunks, t17_dedupe,
        t18_routes, t19_public, h12_shown, t20_windows, t21_dropped, l1_terms, l2_hashes, g1_words, g2_stems, s2_globs, s4_scope, s5_robots, s6_filters,
    )
}


def sql_quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')"


def sql_normalize(x: str) -> str:
    inner = f"regexp_replace(replace(coalesce({x}, ''), chr(13), ''), '[ \t]+', ' ', 'g')"
    return sql_trim(f"regexp_replace({inner}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_normalize(x)}, '[{T.WS}]+'), lambda w: w <> '')"


def sql_index_terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: length(w) BETWEEN 2 AND 32 AND w NOT IN ({sql_quoted(T.INDEX_STOPWORDS)}))"


def sql_query_terms(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: length(w) BETWEEN 2 AND 32))"


def sql_stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {T.STEM_LEAST + len(s)} THEN left({w}, length({w}) - {len(s)})" for s in T.STEM_SUFFIXES)
    return f"CASE {cases} WHEN {w} LIKE '%e' AND length({w}) > {T.STEM_LEAST} THEN left({w}, length({w}) - 1) ELSE {w} END"


def sql_grounding_words(x: str) -> str:
    cut = "CASE WHEN w LIKE '%''s' THEN left(w, length(w) - 2) WHEN w LIKE '%s''' OR w LIKE '%''' THEN left(w, length(w) - 1) ELSE w END"
    each = f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: {cut})"
    return f"list_filter({each}, lambda w: w <> '' AND (length(w) >= 3 OR regexp_matches(w, '[0-9]')) AND w NOT IN ({sql_quoted(T.GROUNDING_STOPWORDS)}))"


def sql_coverage_words(x: str) -> str:
    cut = "CASE WHEN w LIKE '%''s' THEN left(w, length(w) - 2) WHEN w LIKE '%s''' OR w LIKE '%''' THEN left(w, length(w) - 1) ELSE w END"
    each = f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: {cut})"
    return f"list_filter({each}, lambda w: (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({sql_quoted(T.GROUNDING_STOPWORDS)}))"


#: Of a list of words k, the first of equal ones.
SQL_FIRSTS = "list_filter(k, lambda w, i: list_position(k, w) = i)"


def _sql_redact() -> str:
    steps, at = ["r0 AS (SELECT message_id, exported_at, content AS t, 0 AS n FROM chat_messages WHERE content IS NOT NULL)"], 0
    for pattern in (*T.SECRETS, T.EMAIL):
        by = "[email]" if pattern is T.EMAIL else "\\1[redacted]" if "\\b((?:" in pattern or "(Bearer" in pattern else "[redacted]"
        q = pattern.replace("'", "''")
        steps.append(
            f"r{at + 1} AS (SELECT message_id, exported_at, regexp_replace(t, '{q}', '{by}', 'g') AS t, n + len(regexp_extract_all(t, '{q}')) AS n FROM r{at})"
        )
        at += 1
    return f"WITH {', '.join(steps)} SELECT message_id, exported_at, sha256(t) AS digest, CAST(n AS BIGINT) AS n_redacted FROM r{at}"


def _sql_clean(x: str) -> str:
    for tag in T.HARNESS_TAGS:
        x = f"regexp_replace({x}, '<{tag}>(?s:.*?)</{tag}>', '', 'g')"
    return sql_trim(f"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_entities(x: str) -> str:
    for name, char in T.ENTITIES.items():
        x = f"replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({x}, '&amp;', '&')"


_TURNS_SQL = """
WITH one AS (
  SELECT conv_id, message_id, create_time AS t, role, content, project FROM (
    SELECT conv_id, message_id, create_time, content, project, exported_at,
           CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'model', 'bot') THEN 'assistant' END AS role
    FROM chat_messages WHERE conv_id IS NOT NULL AND content IS NOT NULL
  ) WHERE role IS NOT NULL AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, message_id ORDER BY exported_at DESC, content DESC) = 1
), marked AS (
  SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER w <> 'user', true) THEN 1 ELSE 0 END AS start FROM one
  WINDOW w AS (PARTITION BY conv_id ORDER BY t NULLS FIRST, message_id)
), numbered AS (
  SELECT *, CAST(sum(start) OVER (PARTITION BY conv_id ORDER BY t NULLS FIRST, message_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS exchange_no FROM marked
), folded AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, exchange_no) AS replied FROM numbered WHERE exchange_no >= 0
), kept AS (SELECT * FROM folded WHERE replied = 1)
"""

_PATH = "CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END"
_STEP = 64 - 64 * 15 // 100

SQL = {
    "t3_slugs": """
WITH based AS (
  SELECT DISTINCT doc_id, chunk_id, heading,
    replace(regexp_replace(lower("""
    + sql_trim(r"regexp_replace(regexp_replace(heading, '`([^`]*)`', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')")
    + r"""), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') AS base
  FROM record_chunks WHERE doc_id IS NOT NULL AND heading IS NOT NULL
), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY chunk_id) - 1 AS n FROM based)
SELECT doc_id, chunk_id, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS anchor FROM placed""",
    "t7_entities": f"SELECT DISTINCT chunk_id, sha256({_sql_entities('text')}) AS digest FROM record_chunks WHERE text IS NOT NULL",
    "t8_normalize": f"SELECT doc_id, {sql_normalize('text')} AS text FROM documents WHERE {_DOCS}",
    "t9_tokens": f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens FROM documents WHERE {_DOCS}",
    "t10_exchanges": _TURNS_SQL + "SELECT conv_id, message_id, exchange_no FROM kept",
    "t11_exchange_texts": _TURNS_SQL
    + """, said AS (
  SELECT conv_id, exchange_no, min(project) AS project, min(strftime(epoch_ms(CAST(t * 1000 AS BIGINT)), '%Y-%m-%d')) AS d,
         string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY role DESC, t NULLS FIRST, message_id) AS parts
  FROM kept GROUP BY conv_id, exchange_no
)
SELECT conv_id, exchange_no, sha256(parts || chr(10) || chr(10) || 'From the conversation "' || conv_id || '"' || coalesce(' in ' || nullif(project, ''), '') || coalesce(' on ' || d, '') || ', exchange '
       || (exchange_no + 1) || ' of ' || count(*) OVER (PARTITION BY conv_id) || '.') AS digest FROM said""",
    "t12_redacted": _sql_redact(),
    "t13_titles": f"""
WITH lines AS (
  SELECT doc_id, {sql_trim(f"coalesce(list_filter(string_split({_sql_clean('text')}, chr(10)), lambda x: {sql_trim('x')} <> '')[1], '')")} AS line
  FROM documents WHERE {_DOCS}
)
SELECT doc_id, CASE WHEN length(line) > 80 THEN regexp_replace(left(line, 79), '[{T.WS}]+$', '') || '…' ELSE line END AS title FROM lines""",
    "t14_chunks": f"""
WITH worded AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents WHERE {_DOCS}
), counted AS (
  SELECT doc_id, w, len(w) AS n, CAST(1 + ceil(greatest(0, len(w) - 64) / {_STEP}) AS BIGINT) AS c FROM worded WHERE len(w) >= 25
), tailed AS (SELECT *, c > 1 AND n - (c - 1) * {_STEP} < 25 AS tail FROM counted
), each AS (SELECT *, unnest(range(0, CASE WHEN tail THEN c - 1 ELSE c END)) AS chunk_no FROM tailed)
SELECT doc_id, chunk_no, sha256(array_to_string(w[chunk_no * {_STEP} + 1 : chunk_no * {_STEP} + 64], ' ')
  || CASE WHEN tail AND chunk_no = c - 2 THEN ' ' || array_to_string(w[(c - 1) * {_STEP} + 1 : (c - 1) * {_STEP} + 64], ' ') ELSE '' END) AS digest FROM each""",
    "t17_dedupe": f"SELECT min(doc_id) AS doc_id FROM documents WHERE {_DOCS} GROUP BY text",
    "t18_routes": r"""
SELECT DISTINCT source_path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(source_path, '\', '/'), '^\./', ''),
  '(?i)\.(md|mdx|html|txt)$', ''), '(^|/)[0-9]+-', '\1', 'g'), '(?i)(^|/)(index|readme)$', '\1'), '/+$', '') AS route
FROM record_chunks WHERE source_path IS NOT NULL""",
    "t19_public": "SELECT DISTINCT chunk_id, coalesce(url, source_path, '') AS url, left(text, 220) AS preview FROM record_chunks WHERE text IS NOT NULL",
    # A sentence ends where a mark does before white space, so a sign is put there to split by; RE2 cannot look behind.
    "t20_windows": f"""
WITH RECURSIVE parts AS (
  SELECT DISTINCT chunk_id AS record_id, CASE WHEN contains(text, chr(10)) THEN {sql_trim('string_split(text, chr(10))[1]')} ELSE '' END AS head,
    CASE WHEN contains(text, chr(10)) THEN regexp_replace(text, '^[^\n]*\n', '') ELSE text END AS body FROM record_chunks WHERE text IS NOT NULL
), pieces AS (
  SELECT row_number() OVER () AS r, record_id, head, list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
    lambda x: {sql_trim('x')}), lambda x: x <> '') AS p FROM parts
), walk AS (
  SELECT r, 0 AS i, CAST([] AS VARCHAR[]) AS done FROM pieces
  UNION ALL
  SELECT w.r, i + 1, CASE WHEN len(done) > 0 AND len(regexp_split_to_array(done[-1], '\\s+')) < 5 THEN list_append(done[1:-2], done[-1] || ' ' || p[i + 1]) ELSE list_append(done, p[i + 1]) END
  FROM walk w JOIN pieces USING (r) WHERE i < len(p)
), folded AS (SELECT record_id, head, done AS s FROM walk JOIN pieces USING (r) WHERE i = len(p) AND len(done) > 2
), each AS (SELECT *, unnest(range(0, len(s) - 1)) AS window_no FROM folded)
SELECT record_id, window_no, head || chr(10) || s[window_no + 1] || ' ' || s[window_no + 2] AS text FROM each""",
    "t21_dropped": f"""
SELECT doc_id, source AS name, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens FROM documents WHERE {_DOCS} AND len({sql_tokens('text')}) < 25""",
    "l1_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_index_terms('text')}) AS term FROM documents WHERE {_DOCS}) GROUP BY doc_id, term",
    "l2_hashes": f"""
WITH words AS (SELECT DISTINCT unnest({sql_index_terms('text')}) AS term FROM documents WHERE {_DOCS})
SELECT term, list_reduce(list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {0x811C9DC5}::BIGINT) AS h1,
       list_reduce(list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {0x811C9DC5 ^ 0x9E3779B9}::BIGINT) AS h2
FROM words""",
    "g1_words": f"""
WITH worded AS (SELECT doc_id, {sql_grounding_words('string_split(text, chr(10))[1]')} AS k FROM documents WHERE {_DOCS})
SELECT doc_id, array_to_string({SQL_FIRSTS}, ' ') AS words FROM worded""",
    "g2_stems": f"WITH words AS (SELECT DISTINCT unnest({sql_index_terms('text')}) AS word FROM documents WHERE {_DOCS}) SELECT word, {sql_stem('word')} AS stem FROM words",
    "h12_shown": f"""
WITH r AS (SELECT DISTINCT chunk_id, title, heading_path AS p, coalesce(url, source_path) AS src, anchor, text FROM record_chunks WHERE chunk_id IS NOT NULL
), n AS (
  SELECT *, list_filter(list_concat([title], list_filter(coalesce(p, []), lambda h: h IS DISTINCT FROM title)), lambda h: h <> '') AS named, list_filter(list_concat([title], coalesce(p, [])), lambda h: h <> '') AS heads,
    CASE WHEN anchor <> '' AND NOT contains(src, '#') THEN src || '#' || anchor ELSE src END AS placed, {sql_trim(f"regexp_replace(coalesce(text, ''), '[{T.WS}]+', ' ', 'g')")} AS plain FROM r
), o AS (SELECT *, CASE WHEN len(heads) > 0 AND starts_with(plain, heads[-1] || ' ') THEN substr(plain, length(heads[-1]) + 2) ELSE plain END AS own FROM n)
SELECT chunk_id, array_to_string(list_filter([
  (chunk_id % 9 + 1) || '. ' || CASE WHEN len(named) > 0 THEN array_to_string(named, ' › ') ELSE 'record ' || chunk_id END,
  array_to_string(list_filter([placed, CASE WHEN chunk_id % 4 > 0 THEN 'distance ' || printf('%.3f', (chunk_id % 1000) / 1000.0) END], lambda x: x <> ''), ' · '),
  CASE WHEN length(own) > 280 THEN left(own, 279) || '…' ELSE own END], lambda x: x <> ''), chr(10) || '   ') AS shown FROM o""",
    "s2_globs": r"""
SELECT DISTINCT source_path, regexp_full_match(source_path, '(?i)(?:.*/)?[^/]*\.(?:md|mdx|html|txt)') AS taken,
  regexp_full_match(source_path, '(?i)(?:.*/)?(?:guide|wiki)[^/]*/[^/]*\.md') AS guide
FROM record_chunks WHERE source_path IS NOT NULL""",
    "s4_scope": f"SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) = 'https://ferrybook.example' AND starts_with({_PATH}, '/') AS in_scope FROM page_texts WHERE url IS NOT NULL",
    "s5_robots": f"""
WITH t AS (SELECT page_id, {_PATH} || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS t FROM page_texts WHERE url IS NOT NULL)
SELECT page_id, CASE WHEN regexp_matches(t, '^/how-.*-the-') THEN true WHEN regexp_matches(t, '^/.*notes$') OR regexp_matches(t, '^/.*\\?ref=') OR regexp_matches(t, '^/how-') THEN false ELSE true END AS allowed, CAST(5.0 AS DOUBLE) AS delay FROM t""",
    "s6_filters": f"SELECT page_id, {_PATH} LIKE '%-the-%' AND {_PATH} NOT LIKE '%queue%' AND {_PATH} NOT LIKE '%/print.html' AS taken FROM page_texts WHERE url IS NOT NULL",
}
