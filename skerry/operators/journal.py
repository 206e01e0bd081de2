"""Notes of a journal: their form, the records that they become, and the latest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import require
from skerry.functions.text import trimmed

#: Kinds of notes, limits of a note's parts, and how many the latest are at most.
KINDS = ("handoff", "decision", "dead-end", "measurement", "summary", "todo", "preference")
LIMITS = {"title": 200, "text_bytes": 16 * 1024, "tags": 20, "tag": 40, "sources": 20, "repo_items": 50, "repo_item": 300}
MOST = 50


def _text(value: Column, most: int) -> Column:
    """Not blank, and no longer than that."""
    return F.coalesce((trimmed(value) != "") & (F.length(value) <= most), F.lit(False))


def note_problem(kind: Column, title: Column, text: Column, tags: Column | None = None, sources: Column | None = None, repo: Column | None = None) -> Column:
    """What is wrong with a note: ``kind``, ``title``, ``text``, ``tags``, ``sources`` or ``repo``, the first of them; null for a right one.

    A title is one line. ``sources`` are structs of identity (64 hexadecimal digits) and id (0 or more); ``repo`` a map from a list's name to its items.
    """
    wrong = F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind").when(~_text(title, LIMITS["title"]) | F.contains(trimmed(title), F.lit("\n")), "title")
    wrong = wrong.when(F.coalesce((trimmed(text) == "") | (F.octet_length(text) > LIMITS["text_bytes"]), F.lit(True)), "text")
    if tags is not None:
        wrong = wrong.when(tags.isNotNull() & ((F.size(tags) > LIMITS["tags"]) | F.exists(tags, lambda t: ~_text(t, LIMITS["tag"]))), "tags")
    if sources is not None:
        bad = lambda s: ~F.coalesce(s["identity"].rlike("^[0-9a-fA-F]{64}$") & (s["id"] >= 0), F.lit(False))
        wrong = wrong.when(sources.isNotNull() & ((F.size(sources) > LIMITS["sources"]) | F.exists(sources, bad)), "sources")
    if repo is not None:
        long = lambda items: (F.size(items) > LIMITS["repo_items"]) | F.exists(items, lambda x: ~_text(x, LIMITS["repo_item"]))
        wrong = wrong.when(repo.isNotNull() & F.exists(F.map_values(repo), long), "repo")
    return wrong


def valid_note(kind: Column, title: Column, text: Column, tags: Column | None = None) -> Column:
    return note_problem(kind, title, text, tags).isNull()


def shaped_notes(notes: DataFrame) -> DataFrame:
    """``kind, title, text, tags, heading_path, source_path`` and what else ``notes`` (kind, title, text, tags, created, ...) has: right notes as records.

    The title is the record's first line, so that search and grounding see it; tags are in lower case, each once.
    """
    good = notes.where(valid_note(F.col("kind"), F.col("title"), F.col("text"), F.col("tags")))
    tags = F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(trimmed(t))))
    where = F.concat_ws("/", F.lit("journal"), "kind", F.col("created").cast("string")) if "created" in notes.columns else F.concat_ws("/", F.lit("journal"), "kind")
    titled = good.withColumn("title", trimmed(F.col("title"))).withColumn("text", F.concat_ws("\n", "title", trimmed(F.col("text"))))
    return titled.withColumn("tags", tags).withColumn("heading_path", F.array("kind")).withColumn("source_path", where)


def latest(notes: DataFrame, id_col: str, kind: str | None = None, tag: str | None = None, limit: int = 10, buried: DataFrame | None = None) -> DataFrame:
    """The newest live notes of a kind or tag, newest first; a top-k of at most :data:`MOST`, never a full sort."""
    require(0 < limit <= MOST, f"limit is 1 to {MOST}")
    if buried is not None:
        notes = notes.join(buried, id_col, "left_anti")
    if kind is not None:
        notes = notes.where(F.col("kind") == kind)
    if tag is not None:
        notes = notes.where(F.array_contains("tags", tag.lower()))
    return notes.orderBy(F.desc(id_col)).limit(limit)
