"""De-duplication and upserts (§2.5 #40-#42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.session import cut_lineage

# Keys up to this number are broadcast to a join, so that the rows they are looked up in are not shuffled.
BROADCAST_KEYS = 2_000_000
# Whole numbers are broadcast as bitmaps up to this number of blocks (of 32,768 numbers, 4 KB each).
BITMAP_BLOCKS = 16_384


def small_keys(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` (``n`` rows of few narrow columns), marked for a broadcast when they are few."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def with_member(df: DataFrame, value: Column, members: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name``: is ``value`` one of ``members`` (one column)? Whole numbers travel as bitmaps, a bit for each
    number of the blocks that hold one, so the rows of ``df`` stay where they are for some hundred million dense numbers.
    Numbers far apart, and other values, are broadcast as they are when they are few, and else joined by a shuffle."""
    members = members.toDF("_member").where("_member IS NOT NULL")
    if isinstance(members.schema[0].dataType, T.IntegralType):
        n = F.col("_member").cast("long")
        blocks = members.select(F.bitmap_bucket_number(n).alias("_block"), F.bitmap_bit_position(n).alias("_bit")).repartition("_block")
        blocks = cut_lineage(blocks.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
        if blocks.count() <= BITMAP_BLOCKS:
            n = value.cast("long")
            bit = F.bitmap_bit_position(n)
            byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            found = df.join(F.broadcast(blocks), F.bitmap_bucket_number(n) == F.col("_block"), "left")
            return found.withColumn(name, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("_block", "_bits")
    keys = cut_lineage(members.distinct())
    found = df.join(small_keys(keys, keys.count()), value == F.col("_member"), "left")
    return found.withColumn(name, F.col("_member").isNotNull()).drop("_member")


def _orders(order_cols) -> list[Column]:
    return [F.col(c).desc() if isinstance(c, str) else c for c in order_cols]


def dedup_keep_last(df: DataFrame, key, order_cols) -> DataFrame:
    """One row per ``key``: the last by ``order_cols`` (e.g. ``scrape_date, ord``).

    ``row_number() = 1`` over the key is planned as a partial WindowGroupLimit
    before the shuffle, so each map task ships one row per key: a hot key never
    moves as raw rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_orders(order_cols))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def last_rows(df: DataFrame, key: str, order_cols, row: Column, keys: DataFrame | None = None) -> DataFrame:
    """``dedup_keep_last`` of a ``df`` whose rows ``row`` (part of the order) tells apart, each time ``df`` is read: only keys and
    order are shuffled, and the other rows are taken out where they are. ``keys``: key and order of ``df``, materialised."""
    narrow = (df if keys is None else keys).select(key, *order_cols, row.alias("_row"))
    last = dedup_keep_last(narrow, key, [*order_cols, "_row"]).select("_row")
    return with_member(df, row, last, "_last").where("_last").drop("_last")


def late_rows(source: DataFrame, target: DataFrame, key: str, newer: list[str], *columns) -> DataFrame:
    """``columns`` of the ``source`` rows that are no newer, by the columns ``newer``, than a ``target`` row of their key."""
    mine = target.select(F.col(key).alias("_k"), F.struct(*newer).alias("_stored"))
    narrow = source.select(*dict.fromkeys([key, *newer, *columns]))
    return narrow.join(mine, (F.col(key) == F.col("_k")) & (F.struct(*newer) <= F.col("_stored")), "left_semi").select(*columns)


def not_late(source: DataFrame, target: DataFrame, key: str, newer: list[str]) -> DataFrame:
    """The rows of a materialised ``source`` (one row per key) that are newer, by the columns ``newer``, than every ``target``
    row of their key. Only these columns are shuffled to be compared."""
    late = cut_lineage(late_rows(source, target, key, newer, key))
    n = late.count()
    if n and n == source.count():
        return source.where(F.lit(False))
    return with_member(source, F.col(key), late, "_late").where("NOT _late").drop("_late") if n else source


def merge_embeddings(target: DataFrame, source: DataFrame, key: str = "id_norma",
                     columns: list[str] | None = None, newer: list[str] | None = None, held: bool = False) -> tuple[DataFrame, int]:
    """MERGE on ``key``: matched target rows take every non-key column of the source,
    unmatched source rows are inserted, target rows with no source row are kept.

    Because a matched row is replaced whole, the result is ``target ⋉̸ source ∪ source``;
    the source keys go to the target (``with_member``), so that the target is not shuffled.
    With ``newer`` (columns that both sides hold), a matched row is replaced only by a
    source row that is newer by those columns, whatever order the sources arrive in.
    The source must hold one row per key (``dedup_keep_last`` first); ``held`` says that it is materialised already. Returns
    ``(merged, rows_modified)``.
    """
    cols = columns or target.columns
    # The source is read several times (row count, keys, union): computed once.
    src = source.select(*cols) if held else cut_lineage(source.select(*cols))
    if newer:
        src = not_late(src, target, key, newer).select(*cols)
    kept = with_member(target.select(*cols), F.col(key), src.select(key), "_replaced").where("NOT _replaced").drop("_replaced")
    return kept.unionByName(src), src.count()


def upsert_feedback(current: DataFrame, votes: DataFrame) -> DataFrame:
    """One vote per interaction: the latest vote (by ``ts``, then ``vote_id``) replaces
    the stored one; ``action`` is ``updated`` for an existing interaction, ``created``
    for a new one, ``unchanged`` for stored votes no newer vote touched (a late vote
    older than the stored one does not overwrite it).

    ``current (interaction_id, is_positive[, ts])``, ``votes (vote_id, interaction_id,
    is_positive, ts)``. One full outer join on the interaction, after the votes are
    reduced to one per interaction.
    """
    last = dedup_keep_last(votes, "interaction_id", ["ts", "vote_id"]).select(
        "interaction_id", F.col("is_positive").alias("_new"), F.col("ts").alias("_ts"))
    cur = current.select("interaction_id", "is_positive",
                         (F.col("ts") if "ts" in current.columns else F.lit(None).cast("timestamp_ntz")).alias("ts"))
    newer = F.col("_ts").isNotNull() & (F.col("ts").isNull() | (F.col("_ts") >= F.col("ts")))
    return cur.withColumn("_cur", F.lit(True)).join(last, "interaction_id", "full_outer").select(
        "interaction_id",
        F.when(newer, F.col("_new")).otherwise(F.col("is_positive")).alias("is_positive"),
        F.when(newer, F.col("_ts")).otherwise(F.col("ts")).alias("ts"),
        F.when(F.col("_cur").isNull(), F.lit("created"))
        .when(newer, F.lit("updated")).otherwise(F.lit("unchanged")).alias("action"))
