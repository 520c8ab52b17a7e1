"""Structured Streaming forms of the daily batch work (§2.10 #60-#62).

The daily ingest accumulates rows in a staging table, merges them and then empties
staging; with a streaming file source the checkpoint plays that role: each
micro-batch holds exactly the files not yet merged, so there is no separate
truncate (and no window between merge and truncate in which rows can be lost).

Merges go into tables partitioned by key range and rewrite the ranges that a batch touches. Rows carry
their order (day, when the file was written, batch, file, place in it): an older day that arrives late never
replaces a newer row, and a corrected file of a day replaces what the first one said. A row is replaced by a
newer one only, so a replayed batch, or one that failed half-way, changes nothing that it already
changed; no log of applied batches is needed.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.operators.predicates import tail_sample, valid_embeddings
from lexframe.operators.retrieval import embed, embedding_input
from lexframe.operators.upsert import dedup_keep_last, last_rows, merge_embeddings, with_member
from lexframe.session import scratch_table
from lexframe.sources.norms import CSV_OPTIONS, SCAN_SCHEMA, late_keyed, load_order, merge_keyed, quarantine, read_keyed, with_reason

ORDER = ["scrape_date", "_ord"]
#: What a streamed row knows of its file.
SOURCE = "_source"
VOTE_SCHEMA = "vote_id long, interaction_id long, is_positive boolean, ts timestamp_ntz"
_NO_SOURCE = "struct<file_modification_time: timestamp, file_name: string, file_block_start: bigint>"


def merge_norm_batch(batch: DataFrame, batch_id: int, table_dir: str, rejects_dir: str, dim: int = 768, embedder=None) -> None:
    """One micro-batch of daily rows: type (rejects aside) → last row per id in load
    order → embed (failures aside) → MERGE of the newer rows into the embeddings table. Rows without an id are rejects."""
    with ExitStack() as held:
        source = F.col(SOURCE) if SOURCE in batch.columns else F.lit(None).cast(_NO_SOURCE)
        raw = batch.withColumn("_ord", load_order(source, batch_id)).drop(SOURCE)
        if SOURCE not in batch.columns:  # a stream's batch is the same files in the same order whenever it is read; of other frames that is not known
            raw = held.enter_context(scratch_table(raw, "batch"))
        checked, bad = with_reason(raw), (F.col("reason") != "") | F.col("id_norma").isNull()
        keys = held.enter_context(scratch_table(checked.select(F.col("id_norma").try_cast("long").alias("id_norma"), *ORDER, bad.alias("_bad")), "keys"))
        rejects = checked.where(bad).withColumn("reason", F.when(F.col("reason") == "", F.lit("id_norma")).otherwise(F.col("reason")))
        rejects = rejects.limit(0) if keys.where("_bad").isEmpty() else rejects  # the files are not read again for nothing
        rejects.write.mode("overwrite").parquet(f"{rejects_dir}/rows/batch={batch_id}")

        keys, row, unsplit = keys.where("NOT _bad"), F.col("_ord.row"), F.col("_ord").dropFields("row")
        latest = last_rows(quarantine(raw)[0].where("id_norma IS NOT NULL"), "id_norma", ORDER, row, keys)
        # A batch read again is no newer, however it is split. Late rows are embedded like the others, but only their failures are kept.
        late = late_keyed(keys.withColumns({"_row": row, "_ord": unsplit}), table_dir, "id_norma", ORDER, "_row")
        latest, keep = with_member(latest, row, late, "_late").withColumn("_ord", unsplit), [*ORDER, "_late"]
        done = embed(embedding_input(latest, keep=keep), dim=dim, embedder=embedder, keep=keep)
        failed = ~F.coalesce(F.size("ml_generate_embedding_result") > 0, F.lit(False))
        done = held.enter_context(scratch_table(done.where(failed | ~F.col("_late")), "embedded"))
        done.where(failed).drop("_late").write.mode("overwrite").parquet(f"{rejects_dir}/embeddings/batch={batch_id}")
        merge_keyed(valid_embeddings(done.where("NOT _late")).drop("_late"), table_dir, "id_norma",
                    lambda old, new: merge_embeddings(old, new, "id_norma", new.columns, held=True)[0], held=True)


def stream_merge_norms(spark: SparkSession, in_dir: str, table_dir: str, checkpoint: str,
                       dim: int = 768, embedder=None, available_now: bool = True):
    """Daily files (``in_dir/scrape_date=<day>/*.csv``) → typed, de-duplicated,
    embedded rows MERGEd into the embeddings table at ``table_dir``."""
    src = spark.readStream.options(**CSV_OPTIONS).schema(SCAN_SCHEMA).csv(in_dir)
    source = F.struct(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_name", "file_block_start")))
    src = src.select("*", source.alias(SOURCE))
    rejects = f"{table_dir.rstrip('/')}_rejects"
    writer = (src.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: merge_norm_batch(df, bid, table_dir, rejects, dim, embedder)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def feedback_batch(batch: DataFrame, table_dir: str) -> None:
    """One micro-batch of votes upserted: the last vote per interaction; a late vote older than the stored one
    does not overwrite it. Votes for unknown interactions are stored alike and wait there (``accepted_votes``):
    one output, so a failure can lose none, and nothing is tried again batch by batch."""
    newest = lambda votes: dedup_keep_last(votes, "interaction_id", ["ts", "vote_id"])
    merge_keyed(newest(batch), table_dir, "interaction_id", lambda old, new: newest(old.unionByName(new)))


def accepted_votes(spark: SparkSession, table_dir: str, interactions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored votes of known interactions, and those that wait for theirs. A vote counts from the moment its
    interaction is in ``interactions`` (None: all are known), without another run of the stream."""
    votes = read_keyed(spark, table_dir, VOTE_SCHEMA)
    if interactions is None:
        return votes, votes.limit(0)
    known = interactions.select("interaction_id").distinct()
    return votes.join(known, "interaction_id", "left_semi"), votes.join(known, "interaction_id", "left_anti")


def stream_feedback(votes: DataFrame, table_dir: str, checkpoint: str, available_now: bool = True):
    """Continuous feedback upsert: ``votes`` is a streaming frame of
    ``(vote_id, interaction_id, is_positive, ts)``; ``table_dir`` may hold a keyed table of stored votes."""
    writer = (votes.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, _: feedback_batch(df, table_dir)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_tail_sample(requests: DataFrame, threshold_ms: float = 1000.0, rate: float = 0.1,
                       watermark: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """Streaming request log → the kept events: re-delivered request ids dropped within
    the watermark (bounded state), then errors, slow requests and a reproducible
    sample of the rest."""
    # Watermarks need TIMESTAMP; a TIMESTAMP_NTZ log time is read in the session zone.
    evt = "_event_time"
    timed = requests.withColumn(evt, F.col(ts_col).cast("timestamp"))
    # Whether a request is kept depends on its own row only, so the sample comes first and
    # the de-duplication holds state for the kept tenth.
    kept = tail_sample(timed, threshold_ms, rate)
    return kept.withWatermark(evt, watermark).dropDuplicatesWithinWatermark(["request_id"]).drop(evt)
