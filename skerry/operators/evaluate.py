"""Retrieval quality: nDCG, recall, success and reciprocal rank, evidence, and percentiles by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.text import grounding_words, trimmed
from skerry.operators import ordered


def rank_metrics(run: DataFrame, qrels: DataFrame, depth: int = 10, far: int = 100) -> DataFrame:
    """``query_id, ndcg, recall, recall_far`` of every judged query.

    ``run`` (query_id, record_id, rank from 1), ``qrels`` (query_id, record_id, grade > 0). A hit that is the query itself
    must be dropped before. Gain is the grade, discount log2(rank + 1); a judged query without hits scores 0.
    """
    judged = qrels.where("grade > 0")
    hits = run.where(F.col("rank") <= far).join(judged, ["query_id", "record_id"])
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= depth, gain)).alias("dcg"), F.count(F.when(F.col("rank") <= depth, 1)).alias("near"), F.count(F.lit(1)).alias("found")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "record_id"))
    ideal = judged.withColumn("place", place)
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= depth, F.col("grade") / F.log2(F.col("place") + 1))).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    joined = best.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "query_id",
        (zero("dcg") / F.col("idcg")).alias("ndcg"),
        (zero("near") / F.col("relevant")).alias("recall"),
        (zero("found") / F.col("relevant")).alias("recall_far"),
    )


def success(first_rank: DataFrame, by: list[str]) -> DataFrame:
    """``success1, success3, mrr5`` by group; ``first_rank`` has each query's first right rank from 1, null for none."""
    r = F.col("first_rank")
    return first_rank.groupBy(*by).agg(
        F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))).alias("success1"),
        F.avg(F.coalesce((r <= 3).cast("double"), F.lit(0.0))).alias("success3"),
        F.avg(F.when(r <= 5, 1 / r).otherwise(F.lit(0.0))).alias("mrr5"),
    )


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``recall``: the share of true (query_id, record_id) that were found."""
    both = truth.join(found.select("query_id", "record_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "record_id"], "left")
    return both.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def evidence_matches(quote: Column, passage: Column, share: float = 0.6) -> Column:
    """Whether a passage holds a quote: verbatim once both are normalised, or that share of its graded words if they are more than six."""
    plain = lambda c: trimmed(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    words, have = grounding_words(quote), F.split(plain(passage), " ")
    held = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
    return F.contains(plain(passage), plain(quote)) | ((F.size(words) > 6) & (held >= share * F.size(words)))


def percentiles_by_index(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Of each group's ordered values the one at floor(n * share), not interpolated, by exact counts of distinct values.

    Equal values are one row before they are put in order, and the order is cut in ranges, so a group of most rows is many tasks' work.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias("total"))
    placed = ordered.sums_before(ordered.in_ranges(counted, [*by, value]), by, [value], F.col("n"), "before")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = placed.join(totals, on)
    at = {name: F.least(F.col("total") - 1, F.floor(F.col("total") * share)) for name, share in shares.items()}
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("before") + F.col("n") > place, F.col(value))).alias(name) for name, place in at.items()])


def label_metrics(run: DataFrame, asked: DataFrame, labels: DataFrame, depth: int = 10, far: int = 100) -> DataFrame:
    """``query_id, ndcg, recall, recall_far`` where a query's relevant records are all others of its label.

    ``run`` (query_id, record_id, rank from 1, the query itself left out), ``asked`` (query_id, label), ``labels`` (record_id, label). Only hits are
    joined with labels; of a label's records the number is enough, as each has the gain 1.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    judged = asked.join(sizes, "label").select("query_id", "label", (F.col("size") - 1).alias("relevant")).where("relevant > 0")
    hits = run.where(F.col("rank") <= far).join(labels.withColumnRenamed("label", "theirs"), "record_id").join(judged.select("query_id", "label"), "query_id").where("label = theirs")
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count(F.when(F.col("rank") <= depth, 1)).alias("near"), F.count(F.lit(1)).alias("found")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(depth)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = judged.join(got, "query_id", "left")
    return joined.select("query_id", (zero("dcg") / ideal).alias("ndcg"), (zero("near") / F.col("relevant")).alias("recall"), (zero("found") / F.col("relevant")).alias("recall_far"))


def answer_rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the shares of answerable questions that were answered rightly or withheld, and of unanswerable ones that were answered all the same.

    ``judged`` has answerable, answered (both booleans) and right (boolean, null where nothing was shown).
    """
    share = lambda test, of: F.count(F.when(test, 1)) / F.when(F.count(F.when(of, 1)) > 0, F.count(F.when(of, 1)))
    able, shown = F.col("answerable"), F.col("answered")
    return judged.groupBy(*by).agg(
        share(able & shown & F.coalesce(F.col("right"), F.lit(False)), able).alias("right_rate"), share(able & ~shown, able).alias("withheld_rate"), share(~able & shown, ~able).alias("false_answer_rate")
    )
