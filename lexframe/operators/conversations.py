"""Chat history operators (§2.5 #43, §2.7 #51-#52, §2.9 #59)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.session import cut_lineage

from lexframe.schemas import MESSAGE_BLOCKS

# Default conversation title, auto-title length, recency buckets in display order.
DEFAULT_TITLE = "New Conversation"
AUTO_TITLE_CHARS = 50
RECENCY_BUCKETS = ["Today", "Yesterday", "Last 7 days", "Last month", "Older"]


def message_content(messages: DataFrame, text_col: str = "text", blocks_col: str | None = "blocks") -> DataFrame:
    """Adds ``content``: the message text when non-empty, else the ``answer`` of the first
    ``tool_call`` block carrying one, else NULL. ``blocks`` may be an array of structs
    or its JSON text."""
    text = F.nullif(F.col(text_col), F.lit(""))
    if blocks_col is None or blocks_col not in messages.columns:
        return messages.withColumn("content", text)
    blocks = F.col(blocks_col)
    if dict(messages.dtypes)[blocks_col] == "string":
        blocks = F.from_json(blocks, MESSAGE_BLOCKS)
    calls = F.filter(blocks, lambda b: (b["type"] == "tool_call") & b["args"]["answer"].isNotNull())
    return messages.withColumn("content", F.coalesce(text, F.get(calls, 0)["args"]["answer"]))


def positional_rank(df: DataFrame, group: str, order_cols: list, slices: int | None = None,
                    name: str = "n") -> DataFrame:
    """1-based position of each row inside its ``group`` by ``order_cols`` (ties must
    be broken by the order columns), without gathering a group in one task.

    Rows are range-partitioned on (group, order) and sorted, so a group larger than a
    slice is cut into consecutive slices. A row's place in its slice comes from its
    in-partition id, without another shuffle; each (slice, group) piece knows its first
    id, and its offset is the row count of the group's earlier slices (a small table, one
    row per piece).
    """
    spark = df.sparkSession
    n_slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range boundaries come from sampling, so a row's slice and place are fixed once by a
    # reliable checkpoint (both uses below must see the same ones).
    ranged = cut_lineage(df.repartitionByRange(n_slices, group, *order_cols).sortWithinPartitions(group, *order_cols)
                         .withColumn("_place", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_slice", F.shiftright("_place", 33))
    pieces = ranged.groupBy("_slice", group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_place").alias("_first"))
    before = F.sum("_cnt").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(F.col("_slice").alias("_s"), F.col(group).alias("_g"), "_first", F.coalesce(before, F.lit(0)).alias("_off"))
    same = (F.col("_slice") == F.col("_s")) & F.col(group).eqNullSafe(F.col("_g"))
    return (ranged.join(offsets, same)
            .withColumn(name, (F.col("_off") + F.col("_place") - F.col("_first") + 1).cast("long"))
            .drop("_slice", "_place", "_s", "_g", "_first", "_off"))


def align_interactions(messages: DataFrame, interactions: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Positional pairing of assistant messages with interactions, per thread.

    ``messages (thread_id, turn, role, content)``; ``interactions (interaction_id,
    thread_id, timestamp)``; ``feedback (interaction_id, is_positive)``.
    Positions come from ``positional_rank`` (no thread is gathered in one task), and
    the pairing is an equi-join on (thread, position).
    The n-th assistant message *with content* gets the n-th interaction by time (id
    breaks ties) and its vote; surplus messages get NULLs; user messages pass through;
    empty assistant messages, tool messages and any other role are dropped.
    Result: ``(thread_id, turn, role, content, interaction_id, feedback)``.
    """
    users = messages.where(F.col("role") == "user").select(
        "thread_id", "turn", "role", "content",
        F.lit(None).cast("long").alias("interaction_id"), F.lit(None).cast("boolean").alias("feedback"))
    answers = positional_rank(
        messages.where((F.col("role") == "assistant") & F.col("content").isNotNull() & (F.col("content") != "")),
        "thread_id", ["turn"])
    inter = interactions.select("interaction_id", "thread_id", "timestamp")
    if feedback is not None:
        inter = inter.join(feedback.select("interaction_id", F.col("is_positive").alias("feedback")),
                           "interaction_id", "left")
    else:
        inter = inter.withColumn("feedback", F.lit(None).cast("boolean"))
    inter = positional_rank(inter, "thread_id", ["timestamp", "interaction_id"])
    paired = answers.join(inter.drop("timestamp"), ["thread_id", "n"], "left").select(
        "thread_id", "turn", "role", "content", "interaction_id", "feedback")
    return users.unionByName(paired)


def recency_buckets(conversations: DataFrame, as_of, ts_col: str = "updated_at") -> DataFrame:
    """Conversation list grouped by age against the calendar day of ``as_of``:
    Today, Yesterday, Last 7 days, Last month (30 days), Older. Adds ``period`` and
    ``period_rank``, and ``pos``: the 1-based place in its bucket, latest first (ties by
    id), numbered on range slices so that no bucket is gathered in one task."""
    day = F.to_date(F.lit(as_of)) if not hasattr(as_of, "alias") else F.to_date(as_of)
    ts = F.col(ts_col)
    midnight = F.to_timestamp_ntz(day)
    rank = (F.when(ts >= midnight, 0)
            .when(ts >= F.to_timestamp_ntz(F.date_sub(day, 1)), 1)
            .when(ts >= F.to_timestamp_ntz(F.date_sub(day, 7)), 2)
            .when(ts >= F.to_timestamp_ntz(F.date_sub(day, 30)), 3)
            .otherwise(4))
    names = F.array(*[F.lit(x) for x in RECENCY_BUCKETS])
    out = (conversations.withColumn("period_rank", rank)
           .withColumn("period", F.element_at(names, F.col("period_rank") + 1)))
    return positional_rank(out, "period_rank", [F.col(ts_col).desc(), F.col("id")], name="pos")


def touch_conversations(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change log to the conversation table.

    ``conversations (id, user_id, title, created_at, updated_at)``;
    ``changes (id, ts, kind, title, user_id)`` with kind ``create`` | ``message`` |
    ``rename`` | ``delete``. A message moves ``updated_at``; a rename with a non-blank
    (trimmed) title replaces the title and moves ``updated_at``; a create inserts with
    the default title unless one is given; a delete removes the row. Only a create
    inserts: other changes of an unknown id have no effect. The latest title by time
    (then text) wins; rows without a change stay as they are. Changes are reduced per id
    by partial aggregates, so hot ids never gather raw rows; one full outer join.
    """
    ch = changes.withColumn("title", F.nullif(F.trim(F.col("title")), F.lit("")))
    moves = (F.col("kind").isin("message", "create") | ((F.col("kind") == "rename") & F.col("title").isNotNull()))
    made = F.col("kind") == "create"
    titled = F.col("kind").isin("rename", "create") & F.col("title").isNotNull()
    latest = ch.groupBy("id").agg(
        F.max(F.when(moves, F.col("ts"))).alias("_ts"),
        F.max(F.when(titled, F.struct("ts", "title"))).alias("_title"),
        F.min(F.when(made, F.struct("ts", "user_id"))).alias("_made"),
        F.max(F.col("kind") == "delete").alias("_deleted"))
    known = F.col("_known").isNotNull()
    out = conversations.withColumn("_known", F.lit(True)).join(latest, "id", "full_outer")
    out = out.where((known | F.col("_made").isNotNull()) & ~F.coalesce(F.col("_deleted"), F.lit(False)))
    title = F.coalesce(F.col("_title.title"), F.when(known, F.col("title")).otherwise(F.lit(DEFAULT_TITLE)))
    return out.select(
        "id", F.when(known, F.col("user_id")).otherwise(F.col("_made.user_id")).alias("user_id"), title.alias("title"),
        F.coalesce(F.col("created_at"), F.when(~known, F.col("_made.ts"))).alias("created_at"),
        F.greatest(F.col("updated_at"), F.col("_ts")).alias("updated_at"))


def auto_title(first_question) -> "F.Column":
    """Title of a new conversation: the first 50 characters of its first question."""
    c = F.col(first_question) if isinstance(first_question, str) else first_question
    return F.substring(c, 1, AUTO_TITLE_CHARS)
