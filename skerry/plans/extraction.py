"""Queries of document extraction: Markdown and HTML made of the tables' texts, so that SQL knows what must come out; sections, chunks, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import chunking, extract
from skerry.plans.texts import sql_index_terms, sql_normalize, sql_trim
from skerry.session import spread, table
from skerry.sources import files


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Records with a title and a heading of plain words, a row each."""
    rows = table(spark, d, "record_chunks").where("chunk_id is not null").select("chunk_id", F.trim("title").alias("title"), F.trim("heading").alias("heading")).distinct()
    plain = lambda c: F.col(c).rlike(r"^[A-Za-z0-9]+( [A-Za-z0-9]+)*$")
    return spread(rows.where(plain("title") & plain("heading") & (F.lower("title") != F.lower("heading"))))


def _documents(rows: DataFrame, text: Column, ending: str) -> DataFrame:
    return extract.documents(rows.select("chunk_id", F.lit(f"x{ending}").alias("path"), text.alias("text")), "chunk_id", "path", "text")


def t2_sections(spark: SparkSession, d: str) -> DataFrame:
    """Heading paths and anchors of documents with front matter, a title heading, a fence, underlined and own-named headings."""
    md = F.concat(
        F.lit('---\ntitle: "'), "title", F.lit('"\n---\nbefore\n\n# '), "title", F.lit(" ##\n\nintro\n\n"), "heading", F.lit("\n---\n```\n# no heading\n```\n### "), "title",
        F.lit(" {#own}\n\ndeep\n## "), "heading", F.lit("\n# "), "heading",
    )
    found = _documents(_headed(spark, d), md, ".md").select(F.col("doc_id").alias("chunk_id"), "title", F.posexplode("sections").alias("section_no", "s"))
    return found.select("chunk_id", "title", F.col("section_no").cast("long").alias("section_no"), F.array_join("s.heading_path", " > ").alias("path"), "s.anchor", "s.text")


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "record_chunks").where("chunk_id is not null and text is not null").select("chunk_id", T.index_terms(F.col("text")).alias("w"))
    clean = F.filter("w", lambda x: x.rlike("^[a-z0-9]+$"))
    return spread(rows.select("chunk_id", clean.alias("w")).where(F.size("w") >= 9).distinct())


def t5_plain(spark: SparkSession, d: str) -> DataFrame:
    """Text of Markdown with every kind of mark around known words."""
    w = lambda i: F.get("w", F.lit(i))
    md = F.concat(
        F.lit("## "), w(0), F.lit(" ##\n\n- [x] **"), w(1), F.lit("** `"), w(2), F.lit("_*` ["), w(3), F.lit("](http://x.example) ~~"), w(4), F.lit("~~ a_b_c\n\n> > ***"), w(5),
        F.lit("*** \\*"), w(6), F.lit("\\*\n\n* * *\n\n| "), w(7), F.lit(" | ![i](p) |\n|:--|--:|\n```sh\n  "), w(8), F.lit("  **x**\n```\n"),
    )
    return _documents(_words(spark, d), md, ".md").select(F.col("doc_id").alias("chunk_id"), "text")


def t6_html(spark: SparkSession, d: str) -> DataFrame:
    """Title and text of pages whose lines are paragraphs between a menu, a script and a footer."""
    rows = spread(table(spark, d, "page_texts").where("page_id is not null and text is not null"))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    lines = F.array_join(F.transform(F.split(escaped(F.col("text")), "\n"), lambda x: F.concat(F.lit("<p class='a>b'>"), x, F.lit("</p>"))), "")
    page = F.concat(
        F.lit("<!doctype html><head><title>A &mdash; b</title><style>p{}</style></head><body><nav>menu<nav>x</nav></nav><article>"), lines,
        F.lit("<script>if (a < b) {}</script></article><article>more</article><footer>end</footer>"),
    )
    found = extract.documents(rows.select("page_id", F.lit("x.html").alias("path"), page.alias("text")), "page_id", "path", "text")
    return found.select(F.col("doc_id").alias("page_id"), "title", F.sha2("text", 256).alias("digest"))


def t15_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents of known sections: a short one with its child, a short one after another, a middling and a long one."""
    rows = spread(table(spark, d, "documents").where("doc_id is not null and text is not null").select("doc_id", T.index_terms(F.col("text")).alias("w")))
    rows = rows.select("doc_id", F.filter("w", lambda x: x.rlike("^[a-z0-9]+$") & ~x.isin("import", "export")).alias("w")).where(F.size("w") >= 130)
    some = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    md = F.concat(
        F.lit("# Top\n\n"), some(1, 5), F.lit("\n\n## Child\n\n"), some(6, 40), F.lit("\n\n## Short\n\n"), some(46, 4), F.lit("\n\n## Long\n\n"), some(50, 30), F.lit("\n\n"), some(80, 30), F.lit("\n\n"), some(110, 20),
    )
    docs = extract.documents(rows.select("doc_id", F.lit("x.md").alias("path"), md.alias("text")), "doc_id", "path", "text")
    found = extract.chunks_of_documents(docs, target=50)
    return found.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join("heading_path", " > ").alias("path"), "anchor", F.sha2("text", 256).alias("digest"))


def t22_commits(spark: SparkSession, d: str) -> DataFrame:
    """Texts of commits, an order each, with 0 to 49 files."""
    rows = table(spark, d, "orders").where("o_orderkey is not null")
    names = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")), lambda i: i < F.col("o_orderkey") % 50), lambda i: F.concat(F.lit("f"), i.cast("string")))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    text = files.commit_text(F.col("o_orderstatus"), body, F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.sha2(F.col("o_orderkey").cast("string"), 256), names)
    return rows.select("o_orderkey", text.alias("text"))


def x1_packed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole sentences by characters."""
    found = chunking.sentence_packed(spread(table(spark, d, "page_texts").where("page_id is not null")), "page_id", "title", "text", 300, 60)
    return found.select(F.col("doc_id").alias("page_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "text")


QUERIES = {f.__name__: f for f in (t2_sections, t5_plain, t6_html, t15_section_chunks, t22_commits, x1_packed)}

_PLAIN = "'[A-Za-z0-9]+( [A-Za-z0-9]+)*'"
_SLUG = "lower(replace({}, ' ', '-'))"


def _packed_sql() -> str:
    """Sentences are folded one by one: a step of the recursion takes each page's next."""
    return f"""
WITH RECURSIVE said AS (
  SELECT page_id, coalesce(title, '') AS title,
    list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS s
  FROM page_texts WHERE page_id IS NOT NULL
), walk AS (
  SELECT page_id, 0 AS i, 0 AS chunk_no, 0 AS size FROM said WHERE len(s) > 0
  UNION ALL
  SELECT w.page_id, i + 1, chunk_no + CASE WHEN size + length(s[i + 1]) > 300 AND size >= 60 THEN 1 ELSE 0 END,
    CASE WHEN size + length(s[i + 1]) > 300 AND size >= 60 THEN 0 ELSE size END + length(s[i + 1]) + 1
  FROM walk w JOIN said USING (page_id) WHERE i < len(s)
)
SELECT page_id, chunk_no, any_value(title) || ': ' || string_agg(s[i], ' ' ORDER BY i) AS text FROM walk JOIN said USING (page_id) WHERE i > 0 GROUP BY page_id, chunk_no"""


SQL = {
    "t2_sections": f"""
WITH h AS (
  SELECT DISTINCT chunk_id, trim(title) AS t, trim(heading) AS h FROM record_chunks
  WHERE chunk_id IS NOT NULL AND regexp_full_match(trim(title), {_PLAIN}) AND regexp_full_match(trim(heading), {_PLAIN}) AND lower(trim(title)) <> lower(trim(heading))
)
SELECT chunk_id, t AS title, 0 AS section_no, '' AS path, '' AS anchor, 'before' AS text FROM h
UNION ALL SELECT chunk_id, t, 1, '', {_SLUG.format('t')}, t || chr(10) || chr(10) || 'intro' FROM h
UNION ALL SELECT chunk_id, t, 2, h, {_SLUG.format('h')}, h || chr(10) || chr(10) || '# no heading' FROM h
UNION ALL SELECT chunk_id, t, 3, h || ' > ' || t, 'own', t || chr(10) || chr(10) || 'deep' FROM h
UNION ALL SELECT chunk_id, t, 4, h, {_SLUG.format('h')} || '-1', h FROM h
UNION ALL SELECT chunk_id, t, 5, h, {_SLUG.format('h')} || '-2', h FROM h""",
    "t5_plain": f"""
WITH w AS (
  SELECT DISTINCT chunk_id, list_filter({sql_index_terms('text')}, lambda x: regexp_full_match(x, '[a-z0-9]+')) AS w FROM record_chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL
)
SELECT chunk_id, w[1] || e'\\n\\n' || w[2] || ' ' || w[3] || '_* ' || w[4] || ' ' || w[5] || e' a_b_c\\n\\n' || w[6] || ' *' || w[7] || e'*\\n\\n' || w[8] || e' i\\n\\n  ' || w[9] || '  **x**' AS text
FROM w WHERE len(w) >= 9""",
    "t6_html": f"""
SELECT page_id, 'A — b' AS title, sha256({sql_normalize("array_to_string(list_transform(string_split(text, chr(10)), lambda x: ' ' || x || chr(10) || chr(10)), '')")}) AS digest
FROM page_texts WHERE page_id IS NOT NULL AND text IS NOT NULL""",
    "t15_section_chunks": f"""
WITH w AS (
  SELECT doc_id, list_filter({sql_index_terms('text')}, lambda x: regexp_full_match(x, '[a-z0-9]+') AND x NOT IN ('import', 'export')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), k AS (SELECT doc_id, w FROM w WHERE len(w) >= 130
), c AS (
  SELECT doc_id, 0 AS chunk_no, '' AS path, 'top' AS anchor, e'Top\\n\\n' || array_to_string(w[1:5], ' ') || e'\\nChild\\n\\n' || array_to_string(w[6:45], ' ') || e'\\nShort\\n\\n' || array_to_string(w[46:49], ' ') AS t FROM k
  UNION ALL SELECT doc_id, 1, 'Long', 'long', e'Long\\n\\n' || array_to_string(w[50:79], ' ') FROM k
  UNION ALL SELECT doc_id, 2, 'Long', 'long', array_to_string(w[80:109], ' ') || e'\\n\\n' || array_to_string(w[110:129], ' ') FROM k
)
SELECT doc_id, chunk_no, path, anchor, sha256(t) AS digest FROM c""",
    "t22_commits": """
SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE e'\\n\\n' || o_orderpriority END || e'\\n\\nCommit ' || left(sha256(CAST(o_orderkey AS VARCHAR)), 12) || ' by ' || o_custkey || ' on '
  || strftime(o_orderdate, '%Y-%m-%d') || '.' || CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE e'\\n\\nFiles changed: ' || array_to_string(list_transform(range(0, least(40, o_orderkey % 50)), lambda i: 'f' || i), ', ')
  || CASE WHEN o_orderkey % 50 > 40 THEN ' and ' || (o_orderkey % 50 - 40) || ' more' ELSE '' END || '.' END AS text FROM orders WHERE o_orderkey IS NOT NULL""",
    "x1_packed": _packed_sql(),
}
