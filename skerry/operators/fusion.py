"""Fusing the vector and the lexical ranking of each query: weighted reciprocal ranks, the margin guard, phrase pinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.errors import require
from skerry.functions.text import trimmed
from skerry.session import cut, small

#: The constant of reciprocal ranks, the weight of the lexical one, and the lead from which the first vector hit stays first.
RRF_K, LEXICAL_WEIGHT, GUARD_MARGIN = 60, 0.5, 0.05
MODES = ("hybrid", "vector", "lexical", "augmented")

#: Scores are compared to this many decimals.
DECIMALS = 12


def fuse(vectors: DataFrame, lexical: DataFrame, rrf_k: float = RRF_K, lexical_weight: float = LEXICAL_WEIGHT, guard_margin: float = GUARD_MARGIN) -> DataFrame:
    """``query_id, record_id, distance, vec_rank, lex_rank, score, forced, fused_rank`` (ranks from 0).

    score = 1 / (k + vec_rank) + weight / (k + lex_rank), the second term only for lexical candidates; order by score, then
    distance, then vector rank. Where the first vector hit leads the second by the margin of the distance, it stays
    first. A query without lexical candidates keeps its vector order.
    """
    lex = lexical.select("query_id", "record_id", "lex_rank")
    # Once to each query, below all that a rule adds, so that several rules share the shuffle.
    joined = vectors.select("query_id", "record_id", "distance", "vec_rank").join(lex, ["query_id", "record_id"], "left").repartition("query_id")
    whole = Window.partitionBy("query_id")
    has_lex = F.max(F.col("lex_rank").isNotNull()).over(whole)
    first = F.max(F.when(F.col("vec_rank") == 0, F.col("distance"))).over(whole)
    second = F.max(F.when(F.col("vec_rank") == 1, F.col("distance"))).over(whole)
    lead = F.when(first == 0, F.when(second > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise((second - first) / first)
    score = F.round(1 / (rrf_k + F.col("vec_rank")) + F.coalesce(lexical_weight / (rrf_k + F.col("lex_rank")), F.lit(0.0)), DECIMALS)
    scored = joined.withColumn("score", score).withColumn("forced", has_lex & F.coalesce(lead >= guard_margin, F.lit(False)) & (F.col("vec_rank") == 0))
    order = F.when(has_lex, F.col("score")).otherwise(-F.col("vec_rank").cast("double"))
    ranked = scored.withColumn("order", order)
    place = F.row_number().over(whole.orderBy(F.desc("forced"), F.desc("order"), "distance", "vec_rank"))
    return ranked.withColumn("fused_rank", place - 1).drop("order")


def simulate(vectors: DataFrame, lexical: DataFrame, rules: list[tuple[float, float, float]]) -> DataFrame:
    """``rule, query_id, record_id, fused_rank`` of each rule (constant, lexical weight, guard margin) on the same candidates."""
    out = None
    for k, weight, margin in rules:
        name = f"k={k:g} w={weight} guard={'none' if margin >= 1e9 else margin}"
        one = fuse(vectors, lexical, k, weight, margin).select(F.lit(name).alias("rule"), "query_id", "record_id", "fused_rank")
        out = one if out is None else out.unionByName(one)
    return out


def phrase_form(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9' ]+", " "), " +", " "))


def pin_phrases(fused: DataFrame, lexical: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """``fused`` with the hit first that holds the whole query of three words or more verbatim: the best such of the first three lexical hits.

    ``queries`` has query_id, text; ``records`` record_id, text. Texts are read for three records a query only.
    """
    asked = queries.select("query_id", phrase_form(F.col("text")).alias("phrase")).where(F.size(F.split("phrase", " ")) >= 3)
    tops = cut(lexical.where("lex_rank < 3").select("query_id", "record_id", "lex_rank").join(asked, "query_id"))
    # Forms are made of the few texts that are met, so they come after the join.
    held = records.select("record_id", "text").join(small(tops), "record_id").where(F.contains(phrase_form(F.col("text")), F.col("phrase")))
    pin = held.join(fused.select("query_id", "record_id"), ["query_id", "record_id"]).groupBy("query_id").agg(F.min_by("record_id", "lex_rank").alias("pin"))
    pinned = fused.join(pin, "query_id", "left").withColumn("pinned", F.coalesce(F.col("pin") == F.col("record_id"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pinned"), "fused_rank"))
    return pinned.withColumn("fused_rank", place - 1).drop("pin")


def by_mode(vectors: DataFrame, lexical: DataFrame, mode: str, k: int, **options: float) -> DataFrame:
    """The first k of each query by ``hybrid``, ``vector``, ``lexical`` or ``augmented`` retrieval, with 1-based ranks.

    ``vectors`` holds exact distances of every candidate, the lexical ones among them.
    """
    require(mode in MODES, f"retrieval is one of {', '.join(MODES)}")
    require(k > 0, "k must be positive")
    fused = fuse(vectors, lexical, **options)
    order = {"hybrid": "fused_rank", "vector": "vec_rank", "augmented": "vec_rank", "lexical": "lex_rank"}[mode]
    kept = fused if mode != "lexical" else fused.where("lex_rank is not null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    ranks = [(F.col(c) + 1).alias(c) for c in ("lex_rank", "vec_rank")]
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "record_id", "distance", "rank", *ranks)
