"""Appending to a collection as a stream: each batch is a layer, written once however often it is tried; too many layers fold into one.

Layers lie in ``<path>/generation=<g>/layer=<n>``. Folding writes all layers of a generation as the first of the next, so a reader of the
greatest finished generation sees every row once at any time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from skerry.operators.journal import shaped_notes

#: Fixed value: layers above a base, beyond which they are folded before the next is written.
MOST_LAYERS = 8

#: The name of the layer that a fold writes.
BASE = -1


def _listing(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Number -> folder of the finished parts ``<name>=<number>`` of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    found = {}
    for status in fs.listStatus(where):
        folder = status.getPath()
        m = re.fullmatch(rf"{name}=(-?\d+)", folder.getName())
        if m:
            found[int(m.group(1))] = folder.toString()
    return found


def _finished(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _generation(spark: SparkSession, path: str) -> int:
    """The greatest generation whose base is whole; 0 before any fold."""
    known = _listing(spark, path, "generation")
    whole = [g for g in known if g == 0 or _finished(spark, f"{known[g]}/layer={BASE}")]
    return max(whole, default=0)


def _layers(spark: SparkSession, path: str) -> dict[int, str]:
    found = _listing(spark, f"{path}/generation={_generation(spark, path)}", "layer")
    return {n: folder for n, folder in found.items() if _finished(spark, folder)}


def read_layers(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows, with the number (``layer``) of the batch that brought each; None where nothing was written yet."""
    folders = _layers(spark, path)
    return spark.read.parquet(*[folders[n] for n in sorted(folders)]) if folders else None


def fold_layers(spark: SparkSession, path: str) -> bool:
    """Fold the layers of the present generation into the base of the next; False if there is at most one. The old ones stay until they are removed."""
    if len(_layers(spark, path)) < 2:
        return False
    read_layers(spark, path).write.mode("overwrite").parquet(f"{path}/generation={_generation(spark, path) + 1}/layer={BASE}")
    return True


def append_layers(stream: DataFrame, path: str, checkpoint: str, most: int = MOST_LAYERS) -> StreamingQuery:
    """Write each batch as a layer, folding first where the layers are too many. A batch that is tried again replaces its own layer,
    or is left out where a fold took it up."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        layers = _layers(spark, path)
        if BASE in layers and number not in layers and not spark.read.parquet(layers[BASE]).where(F.col("layer") >= number).isEmpty():
            return
        if number not in layers and len(layers) - (BASE in layers) >= most:
            fold_layers(spark, path)
        batch.withColumn("layer", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/generation={_generation(spark, path)}/layer={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_notes(stream: DataFrame, path: str, checkpoint: str, most: int = MOST_LAYERS) -> StreamingQuery:
    """As :func:`append_layers` for notes (kind, title, text, tags, ...): notes of a wrong form stay out, the others become records."""
    return append_layers(shaped_notes(stream), path, checkpoint, most)
