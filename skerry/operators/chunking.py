"""Chunks of documents, exchanges of conversations, and what becomes of both."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import ordered

#: Words of a chunk, the share that two neighbours share, and the least words of a document or a last chunk.
TARGET, OVERLAP_PERCENT, LEAST = 256, 15, 25


def flat_chunks(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap_percent: int = OVERLAP_PERCENT) -> DataFrame:
    """``doc_id, chunk_no, text``: windows of ``target`` words; 0 means the default. Documents below the least words give none.

    A last window below the least words is appended to the one before, shared words and all.
    """
    target, overlap_percent = target or TARGET, overlap_percent or OVERLAP_PERCENT
    step = max(1, target - target * overlap_percent // 100)
    words = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") >= LEAST)
    n = F.size("w")
    count = 1 + F.ceil(F.greatest(F.lit(0), n - target) / step).cast("int")
    tail = (count > 1) & (n - (count - 1) * step < LEAST)
    shown = F.when(tail, count - 1).otherwise(count)
    own = lambda i: F.array_join(F.slice("w", i * step + 1, F.lit(target)), " ")
    last = own(count - 1)
    # Made before they are rows, as each row would else carry all words of its document.
    texts = F.transform(F.sequence(F.lit(0), shown - 1), lambda i: F.when(tail & (i == count - 2), F.concat_ws(" ", own(i), last)).otherwise(own(i)))
    return words.select("doc_id", F.posexplode(texts).alias("chunk_no", "text"))


def dropped_documents(docs: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """``doc_id, name, n_tokens`` of the documents that are too short for a chunk."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(name_col).alias("name"), F.size(T.tokens(F.col(text_col))).alias("n_tokens"))
    return counted.where(F.col("n_tokens") < LEAST)


def first_of_text(chunks: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """The first chunk of each exact text, by ``order``. Texts meet by digest, and a text's first is found in each partition before the shuffle."""
    first = F.min_by(F.struct(*chunks.columns), F.struct(*order))
    return chunks.groupBy(F.sha2(text_col, 256).alias("_digest")).agg(first.alias("_first")).select("_first.*")


def exchanges(turns: DataFrame, conv_col: str, order_cols: list[str], role_col: str) -> DataFrame:
    """``turns`` (user and assistant ones) with ``exchange_no`` from 0: the exchange that each belongs to.

    An exchange starts at a user turn unless the turn before is the user's too. Turns before the first user turn, and
    exchanges without a reply, are left out; so only a conversation's last one can lack it. Turns are numbered in ranges, so a
    conversation of most rows is many tasks' work.
    """
    by = [conv_col]
    ranged = ordered.in_ranges(turns, [conv_col, *order_cols])
    known = ordered.last_before(ranged, by, order_cols, role_col, "_last")
    starts = ((F.col(role_col) == "user") & F.coalesce(F.col("_last") != "user", F.lit(True))).cast("long")
    numbered = ordered.sums_before(known.withColumn("_start", starts), by, order_cols, F.col("_start"), "_before")
    numbered = numbered.withColumn("exchange_no", F.col("_before") + F.col("_start") - 1).where("exchange_no >= 0").drop("_last", "_start", "_before", ordered.PART)
    replied = numbered.where(F.col(role_col) == "assistant").select(conv_col, "exchange_no").distinct()
    return numbered.join(replied, [conv_col, "exchange_no"], "left_semi")


def exchange_texts(
    folded: DataFrame, conv_col: str, order_cols: list[str], role_col: str, text_col: str, title: Column, project: Column | None = None, day: Column | None = None
) -> DataFrame:
    """One row an exchange: its user parts, its replies and where it comes from, with project and first day where they are known."""
    said = F.when(F.col(role_col) == "user", F.concat(F.lit("User: "), F.col(text_col))).otherwise(F.concat(F.lit("Assistant: "), F.col(text_col)))
    part = F.struct((F.col(role_col) != "user").alias("reply"), *order_cols, said.alias("said"))
    none = F.lit(None).cast("string")
    one = folded.groupBy(conv_col, "exchange_no").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.min(title).alias("title"), F.min(none if project is None else project).alias("project"), F.min(none if day is None else day).alias("day")
    )
    totals = folded.select(conv_col, "exchange_no").distinct().groupBy(conv_col).agg(F.count(F.lit(1)).alias("total"))
    named = lambda before, c: F.coalesce(F.concat(F.lit(before), F.when(F.col(c) != "", F.col(c))), F.lit(""))
    of = F.concat(
        F.lit('From the conversation "'), "title", F.lit('"'), named(" in ", "project"), named(" on ", "day"), F.lit(", exchange "), (F.col("exchange_no") + 1).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(".")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n")
    return one.join(totals, conv_col).select(conv_col, "exchange_no", F.concat_ws("\n\n", joined, of).alias("text"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _packed(title: str, text: str, target: int, least: int) -> list[str]:
    lines: list[list[str]] = [[]]
    size = 0
    for sentence in filter(None, (x.strip() for x in _SENTENCE.split(" ".join(text.split("\n"))))):
        if size + len(sentence) > target and size >= least:
            lines.append([])
            size = 0
        lines[-1].append(sentence)
        size += len(sentence) + 1
    return [f"{title}: " + " ".join(line) for line in lines if line]


def sentence_packed(docs: DataFrame, id_col: str, title_col: str, text_col: str, target: int = 800, least: int = 120) -> DataFrame:
    """``doc_id, chunk_no, text``: whole sentences packed to ``target`` characters, each chunk under the title; a chunk ends before what would
    make it longer once it has ``least`` characters, and what is left at the end is kept. A blank text gives none; a null title is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_packed(title or "", text or "", target, least) for title, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            at = [i for i, chunks in enumerate(found) for _ in chunks]
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for chunks in found for n in range(len(chunks))], pa.int32()), pa.array([c for chunks in found for c in chunks], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk_no", "text"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(title_col).cast("string").alias("title"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, chunk_no int, text string")


def public_chunk(chunks: DataFrame) -> DataFrame:
    """A record as readers see it: what is missing falls back (url, then path; text, then preview)."""
    return chunks.withColumn("url", F.coalesce("url", "source_path")).withColumn("preview", T.preview(F.col("text")))


def shown_hit(rank: Column, record_id: Column, title: Column, heading_path: Column, source: Column, anchor: Column, distance: Column, text: Column, most: int = 280) -> Column:
    """A hit as a reader sees it: its place and headings, where it comes from and how near it is, and the start of its text."""
    filled = lambda c: F.when(c != "", c)
    heads = F.filter(F.coalesce(heading_path, F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != "") & (F.coalesce(title, F.lit("")) != h))
    named = F.filter(F.concat(F.array(filled(title)), heads), lambda h: h.isNotNull())
    first = F.concat_ws(" ", F.concat(rank.cast("string"), F.lit(".")), F.when(F.size(named) > 0, F.array_join(named, " › ")).otherwise(F.concat(F.lit("record "), record_id.cast("string"))))
    placed = F.when(filled(anchor).isNotNull() & ~F.contains(source, F.lit("#")), F.concat(source, F.lit("#"), anchor)).otherwise(source)
    where = F.concat_ws(" · ", filled(placed), F.when(distance.isNotNull(), F.format_string("distance %.3f", distance)))
    plain = T.trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{T.WS}]+", " "))
    last = F.concat(F.element_at(F.filter(F.concat(F.array(title), F.coalesce(heading_path, F.array().cast("array<string>"))), lambda h: h.isNotNull() & (h != "")), -1), F.lit(" "))
    own = F.when(F.coalesce(plain.startswith(last), F.lit(False)), F.substring(plain, F.length(last) + 1, F.length(plain))).otherwise(plain)
    cut = F.when(F.length(own) > most, F.concat(F.substring(own, 1, most - 1), F.lit("…"))).otherwise(own)
    return F.concat_ws("\n   ", first, filled(where), filled(cut))


def sentence_windows(records: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``record_id, window_no, text``: runs of ``size`` sentences under the record's first line; none for a record of no more sentences.

    A fragment of fewer than five words joins the sentence after it.
    """
    text = F.col(text_col)
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise(text)
    head = F.when(F.instr(text, "\n") > 0, T.trimmed(F.substring_index(text, "\n", 1))).otherwise(F.lit(""))
    pieces = F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), T.trimmed), lambda p: p != "")
    short = lambda s: F.size(F.split(s, r"\s+")) < 5

    def fold(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, piece)))
        return F.when(F.size(done) == 0, F.array(piece)).when(short(last), joined).otherwise(F.concat(done, F.array(piece)))

    folded = F.aggregate(pieces, F.array().cast("array<string>"), fold)
    each = records.select(F.col(id_col).alias("record_id"), head.alias("head"), folded.alias("s")).where(F.size("s") > size)
    each = each.select("record_id", "head", "s", F.explode(F.sequence(F.lit(0), F.size("s") - size)).alias("window_no"))
    return each.select("record_id", "window_no", F.concat_ws("\n", "head", F.array_join(F.slice("s", F.col("window_no") + 1, F.lit(size)), " ")).alias("text"))
