"""The lexical index and BM25: one table of the records' terms, from which a batch of queries is scored beside each partition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.text import index_terms, query_terms
from skerry.operators import blocks
from skerry.session import stored

#: BM25's two constants, the candidates of a query, and the share of the top score that a candidate keeps.
K1, B = 1.2, 0.75
CANDIDATES, CUTOFF = 24, 1.5

#: Scores are compared to this many decimals, so that equal texts tie whatever the order of addition.
DECIMALS = 9

#: Numbers that a query holds in its block: terms and weights, of some sixteen words.
NUMBERS = 32


@dataclass
class LexicalIndex:
    """``termed``: record_id and its terms with repeats (``all``), and ``pack`` where records have one.

    The one table that the text is read for; postings, document frequencies, statistics and scores are taken from it.
    """

    termed: DataFrame

    @property
    def keys(self) -> list[str]:
        return ["pack"] if "pack" in self.termed.columns else []

    @property
    def postings(self) -> DataFrame:
        """``term, record_id, tf, dl``. A record's length rides on its postings, so no join brings it."""
        each = self.termed.select("record_id", *self.keys, F.size("all").cast("long").alias("dl"), F.explode("all").alias("term"))
        return each.groupBy("term", "record_id", *self.keys).agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))

    @property
    def terms(self) -> DataFrame:
        """``term, df``, combined before the shuffle."""
        each = self.termed.select(*self.keys, F.explode(F.array_distinct("all")).alias("term"))
        return each.groupBy("term", *self.keys).agg(F.count(F.lit(1)).alias("df"))

    @property
    def stats(self) -> DataFrame:
        """``n, total_tokens, avgdl``: one row, or one a pack. A record without terms still counts in n."""
        lengths = self.termed.select(*self.keys, F.size("all").cast("long").alias("dl"))
        counted = (lengths.groupBy(*self.keys) if self.keys else lengths).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
        return counted.withColumn("avgdl", F.greatest(F.lit(1.0), F.col("total_tokens") / F.greatest(F.col("n"), F.lit(1))))


def terms_of(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table of an index, not yet written."""
    terms = F.coalesce(index_terms(F.col(text_col)), F.array().cast("array<string>"))
    keys = ["pack"] if "pack" in records.columns else []
    return records.select(F.col(id_col).cast("long").alias("record_id"), *keys, terms.alias("all"))


def build_index(records: DataFrame, id_col: str, text_col: str) -> LexicalIndex:
    """The index of ``records``; written once, in columns, whatever is asked of it. :class:`skerry.pack.Pack` saves it."""
    return LexicalIndex(stored(terms_of(records, id_col, text_col)))


def document_frequencies(index: LexicalIndex, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, term, df`` of each query's distinct terms that the index knows."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.explode(query_terms(F.col(text_col))).alias("term"))
    return asked.join(index.terms, "term").select("query_id", "term", "df")


def _weighed(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, start of each term's queries, queries by term, their weights)."""
    lists = asked.column("terms").combine_chunks()
    terms = lists.flatten().to_numpy(zero_copy_only=False)
    weights = asked.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(asked.num_rows), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((who, terms))
    known, start = np.unique(terms[order], return_index=True)
    return known, np.append(start, len(terms)), who[order], weights[order]


def bm25(
    index: LexicalIndex, queries: DataFrame, id_col: str, text_col: str, top: int | None = CANDIDATES, exclude: DataFrame | None = None, stats: DataFrame | None = None, terms: DataFrame | None = None
) -> DataFrame:
    """``query_id, record_id, score, lex_rank`` (from 0): the ``top`` records of each query; all without rank if ``top`` is None.

    Every partition of the index scores its records for all queries and sends ``top`` a query to the one shuffle, so no shuffle
    carries a row for each posting of a common term. Excluded records (``record_id``) leave before the cut, so they take no place.
    ``stats`` and ``terms`` of a larger collection may replace the index's own. In an index with packs a query (with its ``pack``)
    meets its pack's records under its pack's statistics.
    """
    keys = index.keys
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), *keys, F.explode(query_terms(F.col(text_col))).alias("term"))
    if terms is None:
        terms = index.terms
    sizes = F.broadcast(index.stats if stats is None else stats)  # one row, or one a pack
    known = asked.join(terms, ["term", *keys])
    known = known.join(sizes, keys) if keys else known.crossJoin(sizes)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pair = F.struct(F.xxhash64("term").alias("terms"), (idf * (K1 + 1)).alias("weights"))
    block = known.groupBy("query_id", *keys).agg(F.sort_array(F.collect_list(pair)).alias("each"), F.first("avgdl").alias("avgdl")).select("query_id", *keys, F.col("each.terms").alias("terms"), F.col("each.weights").alias("weights"), "avgdl")
    held = index.termed.select("record_id", *keys, F.transform("all", lambda w: F.xxhash64(w)).alias("held"))
    if exclude is not None:
        held = held.join(exclude.select("record_id"), "record_id", "left_anti")

    def scan(q: pa.Table, r: pa.Table, border: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        known, start, who, weight = _weighed(q)
        avgdl, ids, n = q.column("avgdl")[0].as_py(), q.column("query_id").to_numpy(), q.num_rows
        lists = r.column("held").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        met = known[at] == flat
        rows = r.column("record_id").to_numpy()
        posting, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[met] * len(known) + at[met], return_counts=True)
        doc, term = posting // len(known), posting % len(known)
        part = tf / (tf + K1 * (1 - B + B * sizes[doc] / avgdl))
        many = start[term + 1] - start[term]
        # Pairs of a posting and a query before each record: a step has so many cells, and so many pairs, at most.
        begin = np.searchsorted(doc, np.arange(len(rows) + 1))
        before = np.concatenate([[0], np.cumsum(many)])[begin]
        first = 0
        while first < len(rows):
            end = min(len(rows), first + max(1, blocks.CELLS // n), max(first + 1, int(np.searchsorted(before, before[first] + blocks.CELLS, "right")) - 1))
            some, width = slice(begin[first], begin[end]), end - first
            each = np.repeat(start[term[some]] - np.cumsum(many[some]) + many[some], many[some]) + np.arange(before[end] - before[first])
            score = np.bincount(who[each] * width + np.repeat(doc[some] - first, many[some]), np.repeat(part[some], many[some]) * weight[each], minlength=n * width).reshape(n, width)
            # A score counts rounded, so what is a little below the border may still reach it.
            least = np.maximum(0 if border is None else -border - 10.0**-DECIMALS, np.nextafter(0, 1))
            line, col = np.nonzero(score >= np.broadcast_to(least, n)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[line]), pa.array(rows[first + col]), pa.array(np.round(score[line, col], DECIMALS))], names=["query_id", "record_id", "score"])
            first = end

    scored = blocks.against_all(block, held, scan, "query_id long, record_id long, score double", NUMBERS, None if top is None else ("score", top, True))
    if top is None:
        return scored
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id"))
    return scored.withColumn("lex_rank", place - 1).where(F.col("lex_rank") < top)


def cutoff(ranked: DataFrame, ratio: float = CUTOFF) -> DataFrame:
    """Candidates whose score is at least the first one's over ``ratio``; applied after the cap."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("best", best).where(F.col("score") >= F.col("best") / ratio).drop("best")
