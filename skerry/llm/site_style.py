"""Site style trees of the records' texts: blocks of records of one host merged by their place, and how much each place matters.

A text is a root over blocks (heading, list, code, formula, table, quote, markup, paragraph). Texts of one host with the same sequence of blocks share a
style; a block's place in it is a node. A node matters the less the more evenly its words spread over the host's texts (their entropy),
and the root the more its styles differ. :mod:`skerry.llm.markup` says why this does not clean the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.markup import kinds_of

#: How much a level's own importance is damped, and below what a block is pruned.
DAMPING, LEAST = 0.9, 0.2

_FENCED = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_FORMS = (
    ("heading", re.compile(r"[ \t]{0,3}#{1,6}[ \t]|[ \t]*=+[^=\n]+=+[ \t]*$|\\(?:sub)*section|<h[1-6]\b", re.I)), ("list", re.compile(r"[ \t]*(?:[-+*#]+|\d+[.)])[ \t]+\S|\\item\b|<li\b", re.I)),
    ("formula", re.compile(r"\$|\\\[|\\\(|\\begin\{(?:equation|align|math)")), ("table", re.compile(r"[ \t]*(?:\||\{\|)|<t[rdh]\b", re.I)), ("quote", re.compile(r"[ \t]*>")),
)


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of a text: fenced code as a whole, else runs of lines without a blank one between."""
    out, at = [], 0
    for m in [*_FENCED.finditer(text), None]:
        for part in re.split(r"\n[ \t]*\n", text[at : m.start() if m else len(text)]):
            if part.strip():
                kind = next((k for k, form in _FORMS if form.match(part)), None)
                out.append((kind or ("markup" if kinds_of(part) else "paragraph"), part))
        if m:
            out.append(("code", m.group()))
            at = m.end()
    return out


def block_table(records: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """``id, host, style, place, kind, words``: a row for each block of each record that has a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, styles, places, kinds, words = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = blocks_of(text)
                style = xxhash.xxh3_64_intdigest("|".join(k for k, _ in found)) - 2**63
                for place, (kind, part) in enumerate(found):
                    at.append(i)
                    styles.append(style)
                    places.append(place)
                    kinds.append(kind)
                    words.append(re.findall(r"\w+", part.lower()))
            take = pa.array(at, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(styles, pa.int64()), pa.array(places, pa.int32()), pa.array(kinds, pa.string()), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "host", "style", "place", "kind", "words"])

    host = F.lower(F.regexp_extract(url_col, r"^https?://([^/?#]+)", 1))
    narrow = records.select(F.col(id_col).alias("id"), host.alias("host"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and host <> ''").dropDuplicates(["id"])
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, host string, style long, place int, kind string, words array<string>")


def block_importance(blocks: DataFrame) -> DataFrame:
    """``host, style, place, importance`` of every node: 1 for a style of one record, else 1 less the mean entropy of the node's words over its
    records, and beside it the entropy of the host's styles, damped. Counted by (node, word), combined before the shuffle."""
    node = ["host", "style", "place"]
    each = blocks.select("id", *node, F.explode("words").alias("word")).groupBy("id", *node, "word").agg(F.count(F.lit(1)).alias("c"))
    records = blocks.select("id", "host", "style").distinct().groupBy("host", "style").agg(F.count(F.lit(1)).alias("m"))
    words = each.groupBy(*node, "word").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = (F.log("c") - F.col("clogc") / F.col("c")) / F.log("m")
    leaves = words.join(records.where("m > 1"), ["host", "style"]).groupBy(*node).agg((1 - F.avg(entropy)).alias("own"))
    whole = records.groupBy("host").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.log("m")).alias("mlogm"))
    root = F.when(F.col("all") > 1, (F.log("all") - F.col("mlogm") / F.col("all")) / F.log("all")).otherwise(F.lit(1.0))
    nodes = blocks.select(*node).distinct().join(leaves, node, "left").join(whole.select("host", root.alias("root")), "host")
    return nodes.select(*node, ((1 - DAMPING) * F.col("root") + DAMPING * F.coalesce("own", F.lit(1.0))).alias("importance"))


def pruned_blocks(records: DataFrame, id_col: str = "chunk_id", text_col: str = "text", url_col: str = "url", least: float = LEAST) -> DataFrame:
    """``<id_col>, block_no, kind, importance, kept``: the blocks of each record that has a host, and whether the tree keeps them.

    Records without id, text or host give nothing; of repeated ids one counts. An empty table gives no rows; other columns are not read.
    """
    blocks = block_table(records, id_col, text_col, url_col)
    placed = blocks.select("id", "host", "style", "place", "kind").join(block_importance(blocks), ["host", "style", "place"])
    return placed.select(F.col("id").alias(id_col), F.col("place").alias("block_no"), "kind", F.round("importance", 6).alias("importance"), (F.col("importance") >= least).alias("kept"))
