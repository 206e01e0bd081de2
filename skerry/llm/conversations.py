"""Rebuilding conversations from message rows: partition by conversation, secondary sort, then a finite-state automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skerry.session import cut

#: Spellings of the two speakers, and the content types with visible text.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "model", "bot")
VISIBLE_TYPES = ("text", "multimodal_text")

#: Kinds of a message: no turn, the user's turn, the assistant's turn.
OTHER, USER, ASSISTANT = 0, 1, 2

#: The automaton: (state, kind of turn) -> state. It begins in BEFORE and accepts in ANSWERED.
BEFORE, ASKED, ANSWERED = 0, 1, 2
STEPS = {
    (BEFORE, USER): ASKED,
    (BEFORE, ASSISTANT): BEFORE,
    (ASKED, USER): ASKED,
    (ASKED, ASSISTANT): ANSWERED,
    (ANSWERED, USER): ASKED,
    (ANSWERED, ASSISTANT): ANSWERED,
}

#: Conversations with more rows than this are walked by pointer doubling over the cluster instead of in one task.
WALK_LIMIT = 100_000

#: Turns of one such conversation are numbered in runs of this many places.
RUN = 50_000


def visible(content: Column) -> Column:
    """Whether a content has visible text: plain text that is not blank, or a JSON object of a visible type with a string part that is not blank."""
    parsed = F.when(content.rlike(r"^\s*\{"), F.try_parse_json(content))
    kind = F.try_variant_get(parsed, "$.content_type", "string")
    parts = F.try_variant_get(parsed, "$.parts", "array<variant>")
    spoken = F.exists(parts, lambda p: (F.schema_of_variant(p) == "STRING") & F.try_variant_get(p, "$", "string").rlike(r"(?U)\S"))
    plain = content.rlike(r"(?U)\S")
    return F.coalesce(F.when(kind.isNotNull(), kind.isin(*VISIBLE_TYPES) & F.coalesce(spoken, F.lit(False))).otherwise(plain), F.lit(False))


def kind_of_turn(role: Column, recipient: Column, content: Column) -> Column:
    who = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    kind = F.when(who.isin(*USER_ROLES), F.lit(USER)).when(who.isin(*ASSISTANT_ROLES) & F.coalesce(recipient == "all", F.lit(True)), F.lit(ASSISTANT))
    return F.when(kind.isNotNull() & visible(content), kind).otherwise(F.lit(OTHER))


def _walk(nodes: dict[str, tuple[str | None, int]], current: str | None) -> list[tuple[int, str]]:
    """(turn number, message) of a kept conversation, else nothing."""
    branch = []
    at = current
    while at is not None:
        node = nodes.get(at)
        if node is None or len(branch) >= len(nodes):
            return []  # a message is missing, or the branch runs in a circle
        branch.append((at, node[1]))
        at = node[0]
    state, turns = BEFORE, []
    for message, kind in reversed(branch):
        if kind != OTHER:
            state = STEPS[state, kind]
            if state != BEFORE:
                turns.append((len(turns) + 1, message))
    return turns if state == ANSWERED else []


def _walk_sorted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, the thread before its messages, older exports before newer: a newer one replaces an older."""
    conv, current, threaded, nodes = None, None, False, {}
    out: tuple[list, list, list] = ([], [], [])

    def close() -> None:
        if threaded:
            for number, message in _walk(nodes, current):
                out[0].append(conv)
                out[1].append(number)
                out[2].append(message)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=names)
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for c, message, parent, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv:
                close()
                conv, current, threaded, nodes = c, None, False, {}
            if kind < 0:
                current, threaded = message, True
            else:
                nodes[message] = (parent, kind)
        if len(out[0]) >= 10_000:
            yield flush()
    close()
    yield flush()


def _doubled(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """The same result for conversations of any length, by pointer doubling: no task holds a conversation.

    After k rounds a message knows the one 2^k places up and how many places it is from the branch's end at the root; the
    ancestors of the current node double likewise. A pointer that never reaches the root runs in a circle.
    """
    key = ["conv_id", "message_id"]
    newest = F.max_by(F.struct("parent", "kind"), F.struct("exported_at", "kind", F.coalesce("parent", F.lit(""))))
    nodes = cut(messages.groupBy(*key).agg(newest.alias("n")).select(*key, F.col("n.parent").alias("up"), F.col("n.kind").alias("kind")))
    present = nodes.select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"))
    joined = nodes.join(present, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("m")), "left")
    # lost: the chain above ends at a message that is not there.
    jump = cut(joined.select(*key, "kind", F.col("m").alias("up"), (F.col("up").isNotNull() & F.col("m").isNull()).alias("lost"), F.when(F.col("m").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    branch = cut(threads.where("current is not null").select("conv_id", F.col("current").alias("message_id")).join(jump.select(*key), key))
    longest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length()) + 1):
        above = jump.select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), F.col("up").alias("up2"), F.col("lost").alias("lost2"), F.col("depth").alias("depth2"))
        on = (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("m"))
        more = branch.join(jump.where("up is not null").select(*key, "up"), key).select("conv_id", F.col("up").alias("message_id"))
        branch = cut(branch.union(more).distinct())
        lost, depth = F.col("lost") | F.coalesce("lost2", F.lit(False)), F.col("depth") + F.coalesce("depth2", F.lit(0))
        jump = cut(jump.join(above, on, "left").select(*key, "kind", F.col("up2").alias("up"), lost.alias("lost"), depth.alias("depth")))
    there = branch.join(jump, key)
    broken = there.groupBy("conv_id").agg(F.max(F.col("lost") | F.col("up").isNotNull()).alias("broken"))
    whole = there.join(broken.where(~F.col("broken")).select("conv_id"), "conv_id").where(F.col("kind") != OTHER)
    ends = whole.groupBy("conv_id").agg(F.min(F.when(F.col("kind") == USER, F.col("depth"))).alias("first"), F.max_by("kind", "depth").alias("last"))
    turns = whole.join(ends.where((F.col("last") == ASSISTANT) & F.col("first").isNotNull()), "conv_id").where("depth >= first")
    turns = turns.withColumn("run", F.floor(F.col("depth") / RUN))
    runs = turns.groupBy("conv_id", "run").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "run", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("depth"))
    return turns.join(runs, ["conv_id", "run"]).select("conv_id", (F.col("before") + number).cast("int").alias("turn_no"), "message_id")


def rebuild_conversations(messages: DataFrame, threads: DataFrame, walk_limit: int = WALK_LIMIT) -> DataFrame:
    """Columns ``conv_id, turn_no, message_id``: the ordered turns of every conversation that is whole and answered.

    Kinds of turns are found beside the scan, so content is neither shuffled nor sent to Python; one shuffle by
    conversation carries ids only. Conversations above ``walk_limit`` rows, found by a count that is combined before its
    shuffle, are walked by pointer doubling, which holds none of them in a task.

    Rows without conv_id or message_id cannot lie on a branch and are left out; a null role, blank content or an unknown
    content type makes a message that is passed but is no turn; a null exported_at is older than any other; among rows of one
    message with equal exported_at the greatest kind, then parent, counts. A repeated thread counts once, with its greatest
    current_node. Empty tables give no rows. Other columns are not read.
    """
    kind = kind_of_turn(F.col("role"), F.col("recipient"), F.col("content")).cast("int")
    rows = messages.where("conv_id is not null and message_id is not null").select("conv_id", "message_id", "parent", kind.alias("kind"), "exported_at")
    heads = threads.where("conv_id is not null").select("conv_id", F.col("current_node").alias("current"))
    per_conv = messages.where("conv_id is not null").groupBy("conv_id").count().where(F.col("count") > walk_limit).select("conv_id")
    big = cut(per_conv)
    n_big = big.count()
    if n_big:
        long_rows, rows = rows.join(big, "conv_id", "left_semi"), rows.join(big, "conv_id", "left_anti")
        one = heads.groupBy("conv_id").agg(F.max("current").alias("current"))
        long_heads, heads = one.join(big, "conv_id", "left_semi"), heads.join(big, "conv_id", "left_anti")
    null = F.lit(None)
    marks = heads.select("conv_id", F.col("current").alias("message_id"), null.cast("string").alias("parent"), F.lit(-1).alias("kind"), null.cast(messages.schema["exported_at"].dataType).alias("exported_at"))
    both = marks.unionByName(rows).repartition("conv_id")
    is_message = (F.col("kind") >= 0).cast("int")
    ordered = both.sortWithinPartitions("conv_id", is_message, F.col("exported_at").asc_nulls_first(), "kind", F.coalesce("parent", F.lit("")), "message_id")
    names = ["conv_id", "turn_no", "message_id"]
    schema = T.StructType([T.StructField("conv_id", T.StringType()), T.StructField("turn_no", T.IntegerType()), T.StructField("message_id", T.StringType())])
    turns = ordered.select("conv_id", "message_id", "parent", "kind").mapInArrow(lambda it: _walk_sorted(it, names), schema)
    return turns.unionByName(_doubled(long_rows, long_heads)) if n_big else turns
