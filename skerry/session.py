"""Session helpers: table loading, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(app: str = "skerry", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_by_value() -> None:
    """Send this package's functions to Python workers by value, for clusters where it is not installed on the executors."""
    from pyspark import cloudpickle

    import skerry

    cloudpickle.register_pickle_by_value(skerry)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table of fewer partitions than cores, as one small file is, over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster shares (``spark.checkpoint.dir``); set one only in local mode without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="skerry-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table by writing it, in columns and compressed, into the checkpoint folder; it takes a fraction of a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(*works: Callable[[], DataFrame]) -> list[DataFrame]:
    """The results of several jobs that do not wait for one another."""
    with ThreadPoolExecutor(len(works)) as pool:
        return [f.result() for f in [pool.submit(w) for w in works]]


#: No side of a join is broadcast by hint when its counted rows are above this.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, a few columns wide and cut before, with a broadcast hint if its counted rows are within the limit; else the planner decides."""
    return F.broadcast(df) if df.limit((limit or BROADCAST_ROWS) + 1).count() <= (limit or BROADCAST_ROWS) else df


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by definition; more than ``limit`` is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
