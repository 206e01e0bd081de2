"""How distinctive a term is for a record: log-entropy weighting by two SQL aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.session import cut

#: Fixed value: a term is a longest run of these characters, three or more of them, in the lower-cased text.
TERM = "[a-z0-9]{3,}"


def latest_deliveries(records: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """One (``record``, ``text``) per id: the latest delivery, the greater text among ties. Rows without id are left out."""
    order = [F.col(order_col)] if order_col else []
    text = F.col(text_col).cast("string")
    newest = F.max_by(text, F.struct(*order, F.coalesce(text, F.lit(""))))
    return records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("record")).agg(newest.alias("text"))


def log_entropy(records: DataFrame, id_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """Columns ``record, term, tf, df, score`` for every term of every record.

    score = ln(1 + tf) * (1 - H(term) / ln N), where H is the entropy of the term's occurrences over the records and N
    the number of all records. The first aggregation counts terms by record, on the partitioning that the choice of
    the latest delivery left; the second sums tf and tf * ln tf by term, combined before the shuffle, so a term that is in
    every record costs one row a partition there. A skewed term in the join back is split at run time.

    Nulls, empty and blank texts have no terms but count in N. A null id leaves its row out. Repeated deliveries of
    an id count once. With one record or none in all, the global weight is 1. An empty table gives no rows. Other columns, of any
    name, are not read.
    """
    return _weighted(records, id_col, text_col, order_col).drop("n")


def _weighted(records: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """The rows of :func:`log_entropy` with ``n``, the number of all records."""
    one = latest_deliveries(records, id_col, text_col, order_col)
    terms = one.select("record", F.explode(F.expr(f"regexp_extract_all(lower(text), '{TERM}', 0)")).alias("term"))
    # Cut here: the second aggregation and the join back would else read and tokenise the collection once each.
    counted = cut(terms.groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf")))
    spread = counted.groupBy("term").agg(
        F.sum("tf").alias("gf"), F.count(F.lit(1)).alias("df"), F.sum(F.col("tf") * F.log(F.col("tf"))).alias("tlogt")
    )
    total = records.where(F.col(id_col).isNotNull()).agg(F.countDistinct(id_col).alias("n"))
    entropy = F.log(F.col("gf")) - F.col("tlogt") / F.col("gf")
    weight = F.when(F.col("n") > 1, F.lit(1.0) - entropy / F.log(F.col("n"))).otherwise(F.lit(1.0))
    return (
        counted.join(spread, "term")
        .crossJoin(F.broadcast(total))  # one row
        .select("record", "term", "tf", "df", (F.log1p(F.col("tf")) * weight).alias("score"), "n")
    )


def distinctive_terms(
    records: DataFrame, id_col: str, text_col: str, order_col: str | None = None, min_tf: int = 3, min_df: int = 2, max_df: int = 8
) -> DataFrame:
    """Rows of :func:`log_entropy` that are frequent in their record and rare but shared in the collection.

    The score decides first: a term of ``min_tf`` or more in its record and in ``max_df`` records at most has an entropy of
    ln ``max_df`` at most, so no such term scores below ln(1 + min_tf) * (1 - ln max_df / ln N). The counts then settle the rest.
    """
    scored = _weighted(records, id_col, text_col, order_col)
    least = math.log1p(min_tf) * F.when(F.col("n") > 1, 1.0 - math.log(max(1, max_df)) / F.log(F.col("n"))).otherwise(F.lit(1.0))
    kept = scored.where(F.col("score") >= least - 1e-9).drop("n")
    return kept.where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
