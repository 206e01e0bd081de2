"""What a query's best passages say of its words, and how good a match the hits are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import GROUNDING_STOPWORDS, STEM_SUFFIXES, grounding_words, stem, without_possessive
from skerry.functions.vector import let
from skerry.operators import ordered
from skerry.session import cut, small

#: Passages that are graded, and what a word in the heading only is worth.
DEPTH, HEADING_CREDIT = 5, 0.5

#: Fixed value: what a common word weighs beside the others.
COMMON_WEIGHT = 1 / 3


def word_forms(word: Column) -> Column:
    """A word with its plural and singular forms."""
    single = F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    return F.array_distinct(F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), single))


def stem_forms(word: Column) -> Column:
    """Every word of the same stem: the stem with each ending, as far as stemming it leads back."""
    return let(stem(word), lambda s: F.filter(F.array(*[F.concat(s, F.lit(e)) for e in ("", "e", *STEM_SUFFIXES)]), lambda w: stem(w) == s))


def passage_words(text: Column) -> Column:
    """Distinct words of a passage, possessives taken off."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), "'s?(?![a-z0-9'])", ""), F.lit("[a-z0-9']+"), F.lit(0)))


def coverage_words(text: Column) -> Column:
    """The words that weighted coverage grades, with repeats: of three letters or more, or numerals."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), without_possessive)
    return F.filter(found, lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]+$")) & ~w.isin(GROUNDING_STOPWORDS))


def _credited(asked: DataFrame, hits: DataFrame, records: DataFrame, depth: int) -> DataFrame:
    """``query_id, record_id, rank, words, credit``: what each of a query's words is worth in each of its passages.

    1 if the body's words hold the word, its plural or singular, or a word of its stem; half if the heading does, unstemmed.
    Forms are made of the query's words, once a query, and looked up among the passage's. The first line is the heading, the rest the body.
    """
    formed = asked.withColumn("forms", F.transform("words", lambda w: F.struct(word_forms(w).alias("own"), stem_forms(w).alias("stems"))))
    top = cut(hits.where(F.col("rank") <= depth).select("query_id", "record_id", "rank"))
    # Words are cut from the few texts that are met, so that comes after the join.
    seen = records.select("record_id", "text").join(small(top), "record_id").join(formed, "query_id")
    seen = seen.withColumn("head", F.substring_index("text", "\n", 1)).withColumn("rest", F.regexp_replace("text", r"\A[^\n]*\n?", ""))
    seen = seen.withColumn("body", passage_words(F.col("rest"))).withColumn("heading", passage_words(F.col("head")))
    worth = lambda f: F.when(F.arrays_overlap(f["own"], F.col("body")) | F.arrays_overlap(f["stems"], F.col("body")), F.lit(1.0)).when(F.arrays_overlap(f["own"], F.col("heading")), F.lit(HEADING_CREDIT)).otherwise(F.lit(0.0))
    return seen.withColumn("credit", F.transform("forms", worth)).drop("text", "forms", "head", "rest", "body", "heading")


def _mean(credit: Column, weights: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return total(F.zip_with(credit, weights, lambda c, w: c * w)) / total(weights)


def ground(queries: DataFrame, hits: DataFrame, records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``query_id, record_id, coverage, covered, uncovered`` of each query's best passage; the earliest of equal ones.

    ``queries`` (query_id, text), ``hits`` (query_id, record_id, rank from 1), ``records`` (record_id, text). A query without
    gradable words, or without hits, gives no row.
    """
    asked = queries.select("query_id", grounding_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    seen = _credited(asked, hits, records, depth)
    seen = seen.withColumn("mean", _mean(F.col("credit"), F.transform("credit", lambda c: F.lit(1.0))))
    best = seen.groupBy("query_id").agg(F.min_by(F.struct("record_id", "words", "credit", "mean"), F.struct(-F.col("mean"), F.col("rank"))).alias("b")).select("query_id", "b.*")
    word = lambda test: F.filter("words", lambda w, i: test(F.get("credit", i)))
    return best.select("query_id", "record_id", F.round("mean", 3).alias("coverage"), word(lambda c: c > 0).alias("covered"), word(lambda c: c == 0).alias("uncovered"))


def coverage1(queries: DataFrame, hits: DataFrame, records: DataFrame, common: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``query_id, coverage1`` of every query: the greatest weighted coverage among its passages, words of ``common`` (word) at a third.

    0 for a query without words to grade or without passages.
    """
    asked = queries.select("query_id", coverage_words(F.col("text")).alias("words"))
    each = asked.select("query_id", F.posexplode("words").alias("i", "word"))
    marked = each.join(common.select("word", F.lit(COMMON_WEIGHT).alias("weight")).distinct(), "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("i", "word", F.coalesce("weight", F.lit(1.0)).alias("weight"))))
    weighed = marked.groupBy("query_id").agg(listed.alias("each")).select("query_id", F.col("each.word").alias("words"), F.col("each.weight").alias("weights"))
    best = _credited(weighed, hits, records, depth).groupBy("query_id").agg(F.max(_mean(F.col("credit"), F.col("weights"))).alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("coverage1"))


def retrieval_signals(ranked: DataFrame) -> DataFrame:
    """``query_id, d0, margin, mean10`` over each query's first ten distances (rank from 0)."""
    top = ranked.where("vec_rank < 10")
    d0 = F.max(F.when(F.col("vec_rank") == 0, F.col("distance")))
    fifth = F.max_by("distance", F.when(F.col("vec_rank") <= 4, F.col("vec_rank")))
    return top.groupBy("query_id").agg(d0.alias("d0"), (fifth - d0).alias("margin"), F.avg("distance").alias("mean10"))


def vocabulary(records: DataFrame, text_col: str, min_count: int | None = None) -> DataFrame:
    """Words that occur often enough to be known: three times in a collection of 200 records or more, once in a smaller."""
    least = min_count if min_count is not None else (3 if records.count() >= 200 else 1)
    words = records.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9']+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def common_words(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words in more records than max(4, 5 % of all), of three letters or more and no stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9']+"), F.lit(0)))
    each = records.select(F.explode(words).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(GROUNDING_STOPWORDS))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("df") > F.greatest(F.lit(4), F.round(F.col("total") * 0.05))).select("word", "df")  # one row


def known_fraction(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``query_id, known``: the share of a query's words that the vocabulary holds; null for none."""
    words = queries.select("query_id", F.posexplode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0))).alias("i", "word"))
    marked = words.join(vocab.select("word", F.lit(1).alias("hit")), "word", "left")
    return marked.groupBy("query_id").agg((F.count("hit") / F.when(F.count("word") > 0, F.count("word"))).alias("known"))


@dataclass
class Gate:
    """A logistic model of distances alone that withholds below ``hard``, whatever the verdict's own model says."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    hard: float


def _logit(features: list[str], mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    z = F.lit(float(bias))
    for f, m, s, w in zip(features, mean, scale, weights, strict=True):
        z = z + (F.col(f) - m) / s * w
    return z


def verdicts(
    signals: DataFrame, features: list[str], mean: list[float], scale: list[float], weights: list[float], bias: float, hard: float, weak: float,
    coverage: tuple[float, float, float] | None = None, gate: Gate | None = None,
) -> DataFrame:
    """``signals`` with ``p`` and ``verdict``: ``none`` below ``hard``, ``weak`` below ``weak``, else ``strong``.

    ``coverage`` (mean, scale, weight) adds the signal ``coverage1``. A ``gate`` alone decides on ``none`` where it is given. Thresholds out of
    order, and signals that are missing or not finite, give ``unscored`` and no p.
    """
    scored = 0 <= hard <= weak <= 1
    z = _logit(features, mean, scale, weights, bias)
    if coverage:
        z = z + (F.col("coverage1") - coverage[0]) / (coverage[1] or 1.0) * coverage[2]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.lit(scored) & finite(z)
    low = 1 / (1 + F.exp(-z)) < hard
    if gate:
        y = _logit(gate.features, gate.mean, gate.scale, gate.weights, gate.bias)
        ok, low = ok & finite(y), 1 / (1 + F.exp(-y)) < gate.hard
    p = F.when(ok, 1 / (1 + F.exp(-z)))
    verdict = F.when(~F.coalesce(ok, F.lit(False)), "unscored").when(low, "none").when(p < weak, "weak").otherwise("strong")
    return signals.withColumn("p", p).withColumn("verdict", verdict)


def withheld(hits: DataFrame, judged: DataFrame, show_abstained: bool = False) -> DataFrame:
    """``hits`` without those of queries whose verdict is ``none``, unless they are to be shown; a query without verdict keeps its hits."""
    if show_abstained:
        return hits
    return hits.join(judged.where("verdict = 'none'").select("query_id"), "query_id", "left_anti")


def auc(scored: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """One row ``auc``: the chance that a positive outranks a negative, ties half. By mean ranks of equal scores, not by pairs.

    Scores are cut in ranges, counted apart and shifted by the counts before, so no task orders all of them.
    """
    by_score = scored.groupBy(F.col(score_col).alias("at")).agg(F.sum(F.col(label_col).cast("long")).alias("p"), F.sum((1 - F.col(label_col)).cast("long")).alias("q"))
    placed = ordered.sums_before(ordered.in_ranges(by_score, ["at"]), [], ["at"], F.col("q"), "below")
    parts = placed.select((F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"), "p", "q")
    return parts.agg((F.sum("won") / F.when(F.sum("p") * F.sum("q") > 0, F.sum("p") * F.sum("q"))).alias("auc"))


def entities(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Capitalised words that never stand in lower case, in at most max(2, 40 %) of the records."""
    words = records.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit("[A-Za-z][A-Za-z0-9']*"), F.lit(0)))).alias("word"))
    big = F.col("word").rlike("^[A-Z][A-Za-z0-9']{2,}$")
    roman = F.col("word").rlike("^[IVXLCDM]+$")
    lower = words.where(F.col("word") == F.lower("word")).select(F.col("word").alias("low")).distinct()
    total = records.agg(F.count(F.lit(1)).alias("total"))
    kept = words.where(big & ~roman).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    kept = kept.join(lower, F.lower("word") == F.col("low"), "left_anti").crossJoin(F.broadcast(total))  # one row
    return kept.where(F.col("df") <= F.greatest(F.lit(2), F.ceil(F.col("total") * 0.4))).select("word", "df")
