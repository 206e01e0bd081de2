"""Digests of records and pages, a collection's identity, and what a check of them finds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: records of a digest page.
PAGE = 256


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks, so that equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(manifest: dict) -> str:
    return hashlib.sha256(canonical_json(manifest).encode()).hexdigest()


def record_json(*columns: str) -> Column:
    """A record as canonical JSON: its fields by name."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def record_digests(records: DataFrame, id_col: str, body: Column) -> DataFrame:
    return records.select(F.col(id_col).alias("record_id"), F.sha2(body, 256).alias("digest"))


def page_digests(digests: DataFrame, page: int = PAGE) -> DataFrame:
    """``page_no, n_records, digest`` over the records' digests in the order of their ids; a page is a bounded group."""
    paged = digests.groupBy(F.floor(F.col("record_id") / page).alias("page_no")).agg(F.count(F.lit(1)).alias("n_records"), F.array_sort(F.collect_list(F.struct("record_id", "digest"))).alias("d"))
    return paged.select("page_no", "n_records", F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ""), 256).alias("digest"))


def tampered(records: DataFrame, expected: DataFrame, id_col: str, body: Column) -> DataFrame:
    """``record_id, problem``: records whose digest differs (``changed``), is ``missing`` or was ``added``."""
    now = record_digests(records, id_col, body).withColumnRenamed("digest", "now")
    both = expected.select("record_id", "digest").join(now, "record_id", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("digest").isNull(), "added").when(F.col("now") != F.col("digest"), "changed")
    return both.select("record_id", problem.alias("problem")).where("problem is not null")


def pack_info(records: DataFrame, id_col: str, text_col: str, by: list[str]) -> DataFrame:
    """Records, distinct texts, characters and the id range of each pack (or other group)."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(F.sha2(text_col, 256)).alias("n_texts"),
        F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0)).alias("n_chars"),
        F.min(id_col).alias("first_id"),
        F.max(id_col).alias("last_id"),
    )
