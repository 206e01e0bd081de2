"""Sources of documents and vectors: folders, commit logs, JSON lines, float files, and listings of packs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import SkerryError, require
from skerry.functions.text import DEFAULT_GLOB, glob_match

#: Bytes of a file at most, files that a commit's text lists, and the two separators of an exported log.
MOST_BYTES, MOST_FILES = 16 * 1024 * 1024, 40
RECORD_SIGN, FIELD_SIGN = "\x1e", "\x1f"


def _listed(spark: SparkSession, root: str, include: str, exclude: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    where = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(F.instr(where, base) > 0, F.substring(where, F.instr(where, F.lit(base)) + len(base), F.length(where))).otherwise(where)
    kept = files.withColumn("source_path", relative).where(glob_match(F.col("source_path"), include))
    return kept if exclude is None else kept.where(~glob_match(F.col("source_path"), exclude))


def folder(spark: SparkSession, root: str, include: str = DEFAULT_GLOB, exclude: str | None = None) -> DataFrame:
    """``source_path, text`` of the files under ``root`` that match; :func:`too_large` has those that are left out. Paths are relative."""
    kept = _listed(spark, root, include, exclude).where(F.col("length") <= MOST_BYTES)
    return kept.select("source_path", F.decode("content", "UTF-8").alias("text"))


def too_large(spark: SparkSession, root: str, include: str = DEFAULT_GLOB, exclude: str | None = None) -> DataFrame:
    """``source_path, length`` of the matching files that :func:`folder` leaves out for their size; their content is not read."""
    return _listed(spark, root, include, exclude).where(F.col("length") > MOST_BYTES).select("source_path", "length")


def commit_text(subject: Column, body: Column, author: Column, day: Column, sha: Column, files: Column) -> Column:
    """Subject, body, who and when, and the files that were changed, in paragraphs."""
    shown = F.array_join(F.slice(files, 1, MOST_FILES), ", ")
    more = F.when(F.size(files) > MOST_FILES, F.concat(F.lit(" and "), (F.size(files) - MOST_FILES).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    by = F.concat(F.lit("Commit "), F.substring(sha, 1, 12), F.lit(" by "), author, F.lit(" on "), day, F.lit("."))
    listed = F.when(F.size(files) > 0, F.concat(F.lit("Files changed: "), shown, more, F.lit(".")))
    return F.concat_ws("\n\n", F.when(subject != "", subject), F.when(F.trim(body) != "", F.trim(body)), by, listed)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``sha, date, author, subject, text, n_files`` of an exported log: records between 0x1e, fields (sha, date, author, subject,
    body, files by line) between 0x1f. One record is read at a time, so a log is never one string."""
    lines = spark.read.option("lineSep", RECORD_SIGN).text(path).where(F.col("value").contains(FIELD_SIGN))
    f = F.split("value", FIELD_SIGN)
    files = F.filter(F.split(F.coalesce(F.get(f, F.lit(5)), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    parts = lines.select(F.trim(f[0]).alias("sha"), f[1].alias("date"), f[2].alias("author"), f[3].alias("subject"), F.coalesce(F.get(f, F.lit(4)), F.lit("")).alias("body"), files.alias("files"))
    text = commit_text(F.col("subject"), F.col("body"), F.col("author"), F.substring("date", 1, 10), F.col("sha"), F.col("files"))
    return parts.select("sha", "date", "author", "subject", text.alias("text"), F.size("files").alias("n_files"))


def session_turns(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, project, at, role, text`` of coding-session transcripts, one JSON event a line. Torn lines, meta, side, summary and error
    events, and interruptions, are left out. Content is a text, or a list whose text parts are joined; the project is the working folder's name."""
    flags = ("isMeta", "isSidechain", "isCompactSummary", "isApiErrorMessage")
    schema = "type string, sessionId string, timestamp string, cwd string, " + ", ".join(f"{f} boolean" for f in flags) + ", message string, _torn string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_torn").json(path).where("_torn is null and message is not null")
    for flag in flags:
        rows = rows.where(~F.coalesce(flag, F.lit(False)))
    said = F.try_parse_json("message")
    parts = F.try_variant_get(said, "$.content", "array<variant>")
    texts = F.transform(F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.try_variant_get(p, "$.text", "string"))
    content = F.coalesce(F.array_join(texts, "\n\n"), F.try_variant_get(said, "$.content", "string"))
    project = F.regexp_extract("cwd", r"([^/\\\\]+)[/\\\\]*$", 1)
    turns = rows.where(F.col("type").isin("user", "assistant")).select(
        F.col("sessionId").alias("conv_id"), F.when(project != "", project).alias("project"), F.col("timestamp").alias("at"), F.col("type").alias("role"), content.alias("text")
    )
    return turns.where((F.trim("text") != "") & ~F.col("text").startswith("[Request interrupted by user"))


def chat_export_turns(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, title, turn, at, role, text`` of an export whose chats hold their messages in order."""
    message = "struct<sender:string,created_at:string,text:string,content:array<struct<type:string,text:string>>>"
    rows = spark.read.schema(f"uuid string, name string, created_at string, chat_messages array<{message}>").option("multiLine", True).json(path)
    each = rows.select("uuid", "name", F.posexplode("chat_messages").alias("turn", "m")).where(F.col("m.sender").isin("human", "assistant"))
    parts = F.transform(F.filter("m.content", lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    text = F.when(F.size("m.content") > 0, F.array_join(parts, "\n\n")).otherwise(F.col("m.text"))
    role = F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender"))
    return each.select(F.col("uuid").alias("conv_id"), F.col("name").alias("title"), "turn", F.col("m.created_at").alias("at"), role.alias("role"), text.alias("text")).where(F.trim("text") != "")


def branch_turns(mapping: dict, node: str | None) -> list[tuple[str, float | None, str]]:
    """(role, time, text) of the turns on the branch from the root to ``node`` of a message tree; a circle ends where it closes."""
    branch, seen = [], set()
    while isinstance(node, str) and node not in seen and isinstance(mapping.get(node), dict):
        seen.add(node)
        branch.append(mapping[node].get("message"))
        node = mapping[node].get("parent")
    turns = []
    for message in filter(lambda m: isinstance(m, dict), reversed(branch)):
        role, content = (message.get("author") or {}).get("role"), message.get("content") or {}
        to_tool = role == "assistant" and message.get("recipient") not in (None, "", "all")
        hidden = (message.get("metadata") or {}).get("is_visually_hidden_from_conversation")
        if role in ("user", "assistant") and not to_tool and not hidden and content.get("content_type") in ("text", "multimodal_text"):
            text = "\n\n".join(p for p in content.get("parts") or [] if isinstance(p, str)).strip()
            if text:
                at = message.get("create_time")
                turns.append((role, float(at) if isinstance(at, (int, float)) else None, text))
    return turns


def tree_export_turns(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, title, turn, at, role, text`` of an export whose chats hold a tree of messages: the branch that each chat ended on.

    A chat is a row, and its tree is walked where the row is. Tool traffic and hidden messages are left out.
    """
    rows = spark.read.schema("id string, conversation_id string, title string, current_node string, mapping string").option("multiLine", True).json(path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (i, turn, at, role, text)
                for i, (tree, node) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                for turn, (role, at, text) in enumerate(branch_turns(json.loads(tree), node))
            ]
            own = pa.array([x[0] for x in out], pa.int64())
            rest = [pa.array([x[n] for x in out], kind) for n, kind in ((1, pa.int32()), (2, pa.float64()), (3, pa.string()), (4, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *rest], names=["conv_id", "title", "turn", "at", "role", "text"])

    named = rows.where("mapping is not null").select(F.coalesce("conversation_id", "id", F.lit("")).alias("conv_id"), "title", "mapping", "current_node")
    turns = named.mapInArrow(walk, "conv_id string, title string, turn int, at double, role string, text string")
    return turns.select("conv_id", "title", "turn", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("at"), "role", "text")


def json_lines(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """Rows of JSON lines that parse and have the required field; broken lines are left out, no schema is guessed."""
    rows = spark.read.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.where(F.col("_torn").isNull() & F.col(required).isNotNull()).drop("_torn")


def float_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``row_id, vector`` of files of little-endian float32 rows; a size that is no whole number of rows is an error.

    Records have one length, so a file is split like any other and read by many tasks; rows are numbered over all files in the order of their paths.
    """
    require(dim > 0, "dim must be positive", "DIMENSION_MISMATCH")
    torn = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") % (4 * dim) != 0)
    if (first := torn.first()) is not None:
        raise SkerryError("DIMENSION_MISMATCH", f"{first['path']} is not a whole number of rows of {dim}")

    def unpack(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, list[float]]]:
        for raw, number in rows:
            yield number, np.frombuffer(raw, "<f4").tolist()

    numbered = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().mapPartitions(unpack)
    return spark.createDataFrame(numbered, "row_id long, vector array<float>")


def shelf(spark: SparkSession, path: str) -> DataFrame:
    """``name, location, identity`` of a listing of packs."""
    rows = spark.read.schema("packs array<struct<name:string,location:string,identity:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("packs"))


def checked_vectors(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """(rows, dimension) of raw vectors; mixed dimensions are an error. The dimensions are counted, not gathered."""
    seen = rows.agg(F.min(F.size(vector_col)).alias("low"), F.max(F.size(vector_col)).alias("high")).first()
    if seen["low"] is None or seen["low"] != seen["high"] or seen["low"] <= 0:
        raise SkerryError("DIMENSION_MISMATCH", f"vectors have {seen['low']} to {seen['high']} components")
    return rows, seen["low"]
