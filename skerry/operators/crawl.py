"""What a crawl takes: scope, robots rules, path filters, links; over urls that are rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import cut


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def scope_prefix(start: str) -> tuple[str, str]:
    """(origin, path prefix) of a crawl: a last part without extension is a folder, one with is a page of its folder."""
    m = re.match(r"^(https?://[^/?#]+)([^?#]*)", start)
    if not m:
        raise ValueError(f"{start!r} is no http(s) url")
    where = m.group(2) or "/"
    last = where.rsplit("/", 1)[-1]
    prefix = where[: len(where) - len(last)] if "." in last else where if where.endswith("/") else where + "/"
    return m.group(1).lower(), prefix


def in_scope(url: Column, start: str) -> Column:
    host, prefix = scope_prefix(start)
    return (origin(url) == host) & (path(url).startswith(prefix) | (path(url) == prefix.rstrip("/")))


class Robots(NamedTuple):
    """Rules (allow, pattern) that bind an agent, and the seconds that it waits between pages, if any are asked."""

    rules: list[tuple[bool, str]]
    crawl_delay: float | None = None


def robots_rules(text: str, agent: str) -> Robots:
    """What a robots file asks of the agent: of all groups that name it, else of all groups of ``*``; of several delays the longest."""
    groups: list[tuple[set[str], list[tuple[bool, str]], list[float]]] = []
    naming = False
    for raw in text.splitlines():
        key, colon, value = (x.strip() for x in raw.split("#", 1)[0].partition(":"))
        if not colon or not re.fullmatch(r"[A-Za-z-]+", key):
            continue
        key, starts = key.lower(), not naming
        naming = key == "user-agent"
        if naming:
            if starts:
                groups.append((set(), [], []))
            groups[-1][0].add(value.lower().split("/")[0].strip())
        elif groups and key in ("allow", "disallow") and value:
            groups[-1][1].append((key == "allow", value))
        elif groups and key == "crawl-delay" and re.fullmatch(r"\d*\.?\d+|\d+\.", value):
            groups[-1][2].append(float(value))
    bound = [g for g in groups if agent.lower() in g[0]] or [g for g in groups if "*" in g[0]]
    return Robots([rule for g in bound for rule in g[1]], max((d for g in bound for d in g[2][-1:]), default=None))


def robots_pattern(rule: str) -> str:
    body = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
    return f"^{body}" + ("$" if rule.endswith("$") else "")


def allowed(url: Column, robots: Robots) -> Column:
    """The longest matching rule decides, allow among equally long; none matching allows. Rules see path and query."""
    where = F.concat(path(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))
    verdict = F.lit(None).cast("boolean")
    for allow, rule in sorted(robots.rules, key=lambda r: (len(r[1]), r[0])):  # the last that matches wins
        verdict = F.when(where.rlike(robots_pattern(rule)), F.lit(allow)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(True))


def path_filter(url: Column, include: list[str], exclude: list[str]) -> Column:
    """``*`` is the only wildcard; pages for printing are always left out."""
    whole = lambda p: "^" + "".join(".*" if c == "*" else re.escape(c) for c in p) + "$"
    where = path(url)
    keep = F.lit(not include)
    for p in include:
        keep = keep | where.rlike(whole(p))
    for p in [*exclude, "*/print.html"]:
        keep = keep & ~where.rlike(whole(p))
    return keep


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``url, link``: distinct http(s) links of a page to its own origin, resolved against its url, without fragments."""
    tags = F.regexp_extract_all(html_col, F.lit(r"""(?i)\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+)"""), F.lit(0))
    value = lambda tag: F.regexp_replace(tag, r"""(?i)^href\s*=\s*["']?|["']$""", "")
    each = pages.select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.transform(tags, value))).alias("href"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [_resolved(base, href) for base, href in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.string())], names=["url", "link"])

    return each.mapInArrow(resolve, "url string, link string").where("link is not null").distinct()


#: Pages that a crawl takes, and bytes of a page, at most.
MOST_PAGES, MOST_BYTES = 500, 2 * 1024 * 1024


def _onward(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``url, nth, link``: where each page leads, in its order; a refresh tag leads before all links."""
    tags = F.regexp_extract_all(html_col, F.lit(r"""(?i)\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+)"""), F.lit(0))
    value = lambda tag: F.regexp_replace(tag, r"""(?i)^href\s*=\s*["']?|["']$""", "")
    refresh = meta_refresh_target(F.col(html_col))
    told = F.concat(F.when(refresh.isNotNull(), F.array(refresh)).otherwise(F.array().cast("array<string>")), F.transform(tags, value))
    each = pages.select(F.col(url_col).alias("url"), F.posexplode(told).alias("nth", "href"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [_resolved(base, href) for base, href in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(full, pa.string())], names=["url", "nth", "link"])

    return each.mapInArrow(resolve, "url string, nth int, link string").where("link is not null")


def crawled(pages: DataFrame, start: str, url_col: str, html_col: str, robots: Robots | None = None, include: list[str] | None = None, exclude: list[str] | None = None, most: int = MOST_PAGES) -> DataFrame:
    """``position, depth, url``: the pages of a fetched collection that a crawl from ``start`` takes, breadth first, in the order in which they are found.

    A page is taken if it is in the scope of the start, the robots rules and path filters allow it, and it is at most :data:`MOST_BYTES` long. Each level of
    the crawl is one join of the level before with the pages' links, so there are as many rounds as levels; ``most`` pages end it.
    """
    known = pages.where(F.octet_length(html_col) <= MOST_BYTES).dropDuplicates([url_col])
    url = F.col(url_col)
    wanted = in_scope(url, start) & (F.lit(True) if robots is None else allowed(url, robots)) & path_filter(url, include or [], exclude or [])
    taken = known.where(wanted)
    onward = cut(_onward(taken, url_col, html_col).join(taken.select(url.alias("link")), "link", "left_semi"))
    spark = pages.sparkSession
    level = cut(taken.where(url == start).select(F.lit(0).cast("long").alias("position"), F.lit(0).alias("depth"), url.alias("url")))
    done, n = level, level.count()
    size = n
    while size and n < most:
        found = level.select("position", "depth", "url").join(onward, "url").groupBy("link").agg(F.min(F.struct("position", "nth")).alias("first"), (F.min("depth") + 1).alias("depth"))
        new = found.join(done.select(F.col("url").alias("link")), "link", "left_anti").orderBy("first", "link").limit(most - n)  # the feature: a crawl's end
        rows = new.select("depth", "link").collect()  # most rows at most
        level = spark.createDataFrame([(n + i, r["depth"], r["link"]) for i, r in enumerate(rows)], "position long, depth int, url string")
        done, size = done.unionByName(level), len(rows)
        n += size
    return done


def _resolved(base: str | None, href: str) -> str | None:
    """A link's url, if it leads by http(s) to the origin of its page."""
    try:
        here, there = urlsplit(base or ""), urlsplit(urljoin(base or "", href.strip()))
    except ValueError:
        return None
    if there.scheme not in ("http", "https") or (here.scheme, here.netloc.lower()) != (there.scheme, there.netloc.lower()):
        return None
    return urlunsplit((there.scheme, there.netloc.lower(), there.path or "/", there.query, ""))


def meta_refresh_target(html: Column) -> Column:
    """The url that a page's refresh tag names, or null."""
    tag = F.regexp_extract(html, r"""(?i)(<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>)""", 1)
    found = F.regexp_extract(tag, r"""(?i)content\s*=\s*["']?\s*[0-9.]*\s*;\s*url\s*=\s*["']?([^"'>\s]+)""", 1)
    return F.when(found != "", found)
