"""A pack: records, their lexical index and coded vectors as Parquet tables beside a manifest; and a mutable vector index."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import SkerryError, require
from skerry.functions import vector as V
from skerry.operators import chain, fusion, grounding, integrity, knn, lexical
from skerry.session import cut, side_by_side, small, stored

#: The tables of a pack, and the version of its layout.
TABLES, LAYOUT = ("records", "termed", "postings", "vectors", "codes"), 2


@dataclass
class Pack:
    """``records`` (record_id, text and more), ``index``, ``vectors`` (record_id, vector of length 1) and their ``codes``.

    Where records and vectors have a column ``pack`` (a number), they are several packs in one table: a question, with its
    pack, meets that pack only, under its own statistics. A pack read from files may hold each record's ``digest``.
    """

    records: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame
    codes: DataFrame
    dim: int
    pool: int = 2
    path: str | None = None
    depth: int | None = None

    @classmethod
    def compile(cls, records: DataFrame, vectors: DataFrame, dim: int, pool: int = 2, checked: bool = True) -> Pack:
        """``records`` (record_id, text, ...), ``vectors`` (record_id, vector); vectors that are not valid are refused if ``checked``."""
        if checked and not vectors.where(~V.is_valid(V.doubles(F.col("vector")), dim)).limit(1).isEmpty():
            raise SkerryError("INVALID_VECTOR", f"a vector is not {dim} finite numbers with a length")
        keys = ["pack"] if "pack" in vectors.columns else []
        unit = vectors.select("record_id", *keys, V.normalized(V.doubles(F.col("vector"))).alias("vector"))
        termed, codes = side_by_side(lambda: stored(lexical.terms_of(records, "record_id", "text")), lambda: stored(knn.coded(unit, pool)))
        return cls(records, lexical.LexicalIndex(termed), unit, codes, dim, pool)

    def save(self, path: str) -> str:
        """Write the tables and the manifest; gives the pack's identity, the digest of its manifest."""
        digested = self.records.withColumn("digest", F.sha2("text", 256))
        tables = dict(zip(TABLES, (digested, self.index.termed, self.index.postings, self.vectors, self.codes), strict=True))
        for name, df in tables.items():
            if name == "postings":  # sorted by term, so that a look-up of a few terms prunes row groups
                df = df.repartitionByRange("term").sortWithinPartitions("term", "record_id")
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.records.sparkSession
        n = spark.read.parquet(f"{path}/records").count()
        manifest = {"layout": LAYOUT, "dim": self.dim, "pool": self.pool, "depth": self.depth, "records": n, "tables": {name: self._seal(spark.read.parquet(f"{path}/{name}")) for name in TABLES}, "content": self._content(spark.read.parquet(f"{path}/records"))}
        spark.createDataFrame([(integrity.canonical_json(manifest),)], ["value"]).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return integrity.identity(manifest)

    @staticmethod
    def _seal(table: DataFrame) -> dict:
        """Rows and a digest of a table that no order changes: the sum of its rows' hashes."""
        one = table.select(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).first()
        return {"rows": one["n"], "digest": str(one["h"] or 0)}

    @staticmethod
    def _content(records: DataFrame) -> str:
        """A digest of all records that no order changes: page digests of record digests, summed by page."""
        digests = integrity.record_digests(records, "record_id", F.col("text"))
        first = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
        total = integrity.page_digests(digests).agg(F.sum(first), F.count(F.lit(1))).first()
        return f"{total[0]}:{total[1]}"

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = False) -> Pack:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest.get("layout") != LAYOUT:
            raise SkerryError("SNAPSHOT_INVALID", f"unknown layout {manifest.get('layout')!r}")
        t = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        if verify and (t["records"].count() != manifest["records"] or cls._content(t["records"]) != manifest["content"]):
            raise SkerryError("SNAPSHOT_INVALID", "the records are not those of the manifest")
        for name in TABLES if verify else ():
            if cls._seal(t[name]) != manifest["tables"][name]:
                raise SkerryError("SNAPSHOT_INVALID", f"the table {name} is not that of the manifest")
        return cls(t["records"], lexical.LexicalIndex(t["termed"]), t["vectors"], t["codes"], manifest["dim"], manifest["pool"], path, manifest["depth"])

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms: of a saved pack only the row groups that may hold them are read."""
        postings = self.index.postings if self.path is None else self.records.sparkSession.read.parquet(f"{self.path}/postings")
        return postings.where(F.col("term").isin(terms))

    def candidates(self, questions: DataFrame, k: int = 5, rerank: int | None = None, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(exactly ranked vector candidates, lexical ones) of questions (query_id, text, vector), each cut here, as much is made of both.

        Candidates by sketch are joined by the lexical ones before the exact ranking. Excluded records take no place in either.
        """
        depth = knn.rerank_depth(self.codes.count(), k, rerank, self.depth)
        asked, codes = knn.asked(questions), self.codes if excluded is None else self.codes.join(excluded.select("record_id"), "record_id", "left_anti")
        near = knn.sketch_candidates(asked, codes, self.dim, self.pool, depth).select("query_id", "record_id")
        found = lexical.cutoff(lexical.bm25(self.index, questions, "query_id", "text", exclude=excluded))
        lex, near = side_by_side(lambda: stored(found), lambda: stored(near))
        return stored(knn.rerank(near.union(lex.select("query_id", "record_id")).distinct(), asked, codes, None)), lex

    def hits(self, questions: DataFrame, vec: DataFrame, lex: DataFrame, k: int, retrieval: str = "hybrid") -> DataFrame:
        """``query_id, record_id, distance, rank, lex_rank, vec_rank``: the first k of each query, fused, guarded and pinned in hybrid mode."""
        if retrieval != "hybrid":
            return fusion.by_mode(vec, lex, retrieval, k)
        pinned = fusion.pin_phrases(fusion.fuse(vec, lex), lex, questions, self.records)
        return pinned.where(F.col("fused_rank") < k).select("query_id", "record_id", "distance", (F.col("fused_rank") + 1).alias("rank"), "lex_rank", "vec_rank")

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """``hits`` with their records' fields; a record that is not what its digest says is an error where digests are kept."""
        found = self.records.join(small(cut(hits)), "record_id")
        if "digest" not in self.records.columns:
            return found
        whole = F.when(F.sha2("text", 256) == F.col("digest"), F.col("text")).otherwise(F.raise_error(F.lit("DIGEST_MISMATCH: a record was changed")))
        return found.withColumn("text", whole).drop("digest")

    def query(self, questions: DataFrame, k: int = 5, retrieval: str = "hybrid", rerank: int | None = None) -> DataFrame:
        """Hits of many questions (query_id, text, vector) in one plan: ``query_id, rank`` and the record's fields, hydrated last."""
        require(k > 0, "k must be positive")
        return self.hydrate(self.hits(questions, *self.candidates(questions, k, rerank), k, retrieval))

    def ground(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        return grounding.ground(questions, hits, self.records)

    def record(self, record_id: int) -> DataFrame:
        return self.records.where(F.col("record_id") == record_id)

    def info(self) -> DataFrame:
        return integrity.pack_info(self.records, "record_id", "text", [])


class VectorIndex:
    """Vectors with stable ids: added, deleted, searched and compacted. ``rows`` has record_id, vector."""

    def __init__(self, spark: SparkSession, dim: int, metric: str = "cosine"):
        require(dim > 0, "dim must be positive")
        require(metric in ("cosine", "l2"), "metric is cosine or l2")
        self.spark, self.dim, self.metric = spark, dim, metric
        self.rows = spark.createDataFrame([], "record_id long, vector array<double>")
        self.deleted = spark.createDataFrame([], "record_id long")

    def add(self, rows: DataFrame) -> VectorIndex:
        v = V.doubles(F.col("vector"))
        wrong = rows.where(~V.is_valid(v, self.dim)) if self.metric == "cosine" else rows.where(F.size("vector") != self.dim)
        if not wrong.limit(1).isEmpty():
            raise SkerryError("INVALID_VECTOR", f"a vector is not {self.dim} finite numbers")
        if not rows.join(self.rows, "record_id", "left_semi").limit(1).isEmpty():
            raise SkerryError("INVALID_ARGUMENT", "an id is never used again")
        self.rows = self.rows.unionByName(rows.select(F.col("record_id").cast("long"), (V.normalized(v) if self.metric == "cosine" else v).alias("vector")))
        return self

    def delete(self, ids: DataFrame) -> VectorIndex:
        self.deleted = self.deleted.union(ids.select(F.col("record_id").cast("long"))).distinct()
        return self

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        asked = queries.select("query_id", V.doubles(F.col("vector")).alias("vector"))
        if self.metric == "cosine":
            asked = asked.select("query_id", V.normalized(F.col("vector")).alias("vector"))
        return knn.exact_knn(asked, self.rows, k, self.dim, self.metric, allowed=allowed, masked=self.deleted)

    def has(self, ids: DataFrame) -> DataFrame:
        return ids.join(chain.live(self.rows.select("record_id"), self.deleted), "record_id", "left_semi")

    def ghost_ratio(self) -> float:
        total = self.rows.count()
        return self.rows.join(self.deleted, "record_id", "left_semi").count() / total if total else 0.0

    def compact(self) -> DataFrame:
        """Drop deleted rows and number the rest anew; gives ``old_id, new_id``."""
        moved = knn.compacted(self.rows.select("record_id"), self.deleted)
        self.rows = self.rows.join(moved, F.col("record_id") == F.col("old_id")).select(F.col("new_id").alias("record_id"), "vector")
        self.deleted = self.spark.createDataFrame([], "record_id long")
        return moved

    def save(self, path: str) -> None:
        if not self.deleted.limit(1).isEmpty():
            raise SkerryError("COMPACTION_REQUIRED", "compact an index with deleted rows before it is saved")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.spark.createDataFrame([(self.dim, self.metric)], "dim int, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        config = spark.read.parquet(f"{path}/config").first()
        out = cls(spark, config["dim"], config["metric"])
        out.rows = spark.read.parquet(f"{path}/rows")
        if out.rows.dtypes != [("record_id", "bigint"), ("vector", "array<double>")]:
            raise SkerryError("SNAPSHOT_INVALID", "the rows have other columns than an index's")
        return out
