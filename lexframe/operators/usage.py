"""Usage analytics and the joins behind them (§2.4, §2.6, §2.7).

Role columns:
  documents    (document_id, filename[, uploaded_at])   filename unique
  links        (interaction_id, document_id)           m:n junction, composite key
  interactions (interaction_id, thread_id, response_time, timestamp)   id unique
  feedback     (feedback_id, interaction_id, is_positive)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexframe.operators.predicates import trailing_window

# Refusal texts of the upload intake.
DUPLICATE_ERROR = "Document with this filename already exists."
PROCESSING_ERROR_PREFIX = "Failed to process PDF: "


def _links(links: DataFrame) -> DataFrame:
    # The junction's key is (interaction_id, document_id); repeated pairs count once.
    return links.select("interaction_id", "document_id").dropDuplicates(["interaction_id", "document_id"])


def link_join(documents: DataFrame, links: DataFrame, interactions: DataFrame) -> DataFrame:
    """Document ⋈ link ⋈ interaction (inner equi-joins over the junction)."""
    return (_links(links)
            .join(interactions, "interaction_id")
            .join(documents, "document_id"))


def document_usage(documents: DataFrame, links: DataFrame, interactions: DataFrame,
                   as_of=None, days: int | None = None, count_name: str = "query_count") -> DataFrame:
    """Interactions per document filename, most used first (ties by filename).

    Plan: the window filter is applied to interactions at the scan; links are
    semi-joined to the (unique-keyed) interactions, counted per document with a
    map-side partial aggregate — so a hot document never travels as raw rows — and
    only then joined to the document table for the filename.
    """
    inter = interactions.select("interaction_id", "timestamp")
    if as_of is not None:
        inter = trailing_window(inter, "timestamp", as_of, 7 if days is None else days)
    counts = (_links(links)
              .join(inter, "interaction_id", "left_semi")
              .groupBy("document_id").agg(F.count(F.lit(1)).alias(count_name)))
    return (counts.join(documents.select("document_id", "filename"), "document_id")
            .select("filename", count_name)
            .orderBy(F.desc(count_name), F.asc("filename")))


def response_summary(interactions: DataFrame) -> DataFrame:
    """Average response time rounded half-even to 3 (0 when NULL or zero) and the
    interaction count; one global aggregate."""
    avg = F.avg("response_time")
    return interactions.agg(
        F.when(F.coalesce(avg, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.bround(avg, 3))
        .alias("average_response_time_seconds"),
        F.count("interaction_id").alias("total_interactions"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Totals of votes: all, positive, negative and positive share (%, 2 decimals)."""
    total = F.count("feedback_id")
    pos = F.count(F.when(F.col("is_positive"), F.col("feedback_id")))
    return (feedback.agg(total.alias("total_feedback_count"), pos.alias("positive_feedback_count"))
            .select("total_feedback_count", "positive_feedback_count",
                    (F.col("total_feedback_count") - F.col("positive_feedback_count"))
                    .alias("negative_feedback_count"),
                    F.when(F.col("total_feedback_count") > 0,
                           F.bround(F.col("positive_feedback_count") / F.col("total_feedback_count") * 100.0, 2))
                    .otherwise(F.lit(0.0)).alias("positive_feedback_percentage")))


def unused_documents(documents: DataFrame, links: DataFrame,
                     interactions: DataFrame | None = None) -> DataFrame:
    """Documents no interaction refers to (NOT EXISTS → left anti join)."""
    used = _links(links)
    if interactions is not None:
        used = used.join(interactions.select("interaction_id"), "interaction_id", "left_semi")
    return documents.join(used.select("document_id"), "document_id", "left_anti")


def cited_documents(answers: DataFrame, documents: DataFrame,
                    names_col: str = "used_documents") -> DataFrame:
    """Per interaction, the stored documents whose filename the answer cites;
    unknown names vanish and repeated names collapse.

    The join comes first, so unknown names are gone before the shuffle of the
    de-duplication, which then keys on the two ids (a document id determines
    its filename)."""
    cited = answers.select("interaction_id", F.explode(F.array_distinct(names_col)).alias("filename"))
    return (cited.join(documents.select("document_id", "filename"), "filename")
            .dropDuplicates(["interaction_id", "document_id"])
            .select("interaction_id", "document_id", "filename"))


def intake_documents(batch: DataFrame, existing: DataFrame, process_ok_col: str | None = None) -> DataFrame:
    """Upload intake over a batch ``(ord, filename, content_type[, process_ok])``.

    First reason wins: a non-PDF is refused for its type; a PDF whose name is already
    stored, or was accepted earlier in the same batch, is a duplicate; a PDF whose
    processing failed is rolled back into the failed list. Returns
    ``(ord, filename, status, error)``, status ``accepted`` or ``failed``.
    """
    from lexframe.operators.predicates import MEDIA_ERROR, PDF_MEDIA_TYPE

    b = batch.withColumn("filename", F.coalesce(F.col("filename"), F.lit("unnamed")))
    is_pdf = F.coalesce(F.col("content_type") == PDF_MEDIA_TYPE, F.lit(False))  # no type is refused
    # Per name: the first PDF of the batch (the one that can be accepted) and whether the
    # name is stored. Partial aggregates, so a name repeated many times never gathers its
    # rows, and one join back to the batch.
    names = (b.where(is_pdf).groupBy("filename").agg(F.min("ord").alias("_first_pdf"))
             .join(existing.select("filename").distinct().withColumn("_known", F.lit(True)), "filename", "left"))
    b = b.join(names, "filename", "left")
    error = (F.when(~is_pdf, F.lit(MEDIA_ERROR))
             .when(F.coalesce(F.col("_known"), F.lit(False)) | (F.col("ord") != F.col("_first_pdf")),
                   F.lit(DUPLICATE_ERROR)))
    if process_ok_col is not None:
        error = error.when(~F.coalesce(F.col(process_ok_col), F.lit(False)),
                           F.concat(F.lit(PROCESSING_ERROR_PREFIX), F.coalesce(F.col("process_error"), F.lit(""))))
    return (b.withColumn("error", error)
            .select("ord", "filename",
                    F.when(F.col("error").isNull(), F.lit("accepted")).otherwise(F.lit("failed")).alias("status"),
                    "error"))


def feedback_reference_check(feedback: DataFrame, interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes for known interactions (accepted) and for unknown ones (rejected); the
    planner broadcasts the smaller side when its size allows it."""
    ids = interactions.select("interaction_id").distinct()
    return (feedback.join(ids, "interaction_id", "left_semi"),
            feedback.join(ids, "interaction_id", "left_anti"))


def load_metrics(df: DataFrame, date_col: str = "scrape_date", key: str = "id_norma") -> DataFrame:
    """Rows and distinct keys per load date."""
    return df.groupBy(date_col).agg(F.count(F.lit(1)).alias("rows"),
                                    F.countDistinct(key).alias("unique_ids"))


def observed(df: DataFrame, date_col: str = "scrape_date", key: str = "id_norma") -> tuple[DataFrame, Observation]:
    """The frame with metrics that Spark collects while it is written: rows, rows without a key, first and last
    date. ``observation.get`` waits for the write and reads nothing again."""
    metrics = Observation()
    out = df.observe(metrics, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("without_key"),
                     F.min(date_col).alias("first"), F.max(date_col).alias("last"))
    return out, metrics


def scrape_metrics(found: DataFrame, scraped: DataFrame, listing_col: str = "page_id",
                   found_key: str = "norm_id", scraped_key: str = "id_norma") -> DataFrame:
    """Per listing: ids found on it, rows scraped for those ids and how many are
    missing (a listing whose pages did not all arrive shows up here)."""
    ids = found.select(listing_col, F.col(found_key).cast("long").alias("_k")).distinct()
    got = scraped.select(F.col(scraped_key).cast("long").alias("_k")).distinct().withColumn("_s", F.lit(1))
    return (ids.join(got, "_k", "left").groupBy(listing_col)
            .agg(F.count(F.lit(1)).alias("ids_found"), F.count("_s").alias("rows_scraped"))
            .withColumn("missing", F.col("ids_found") - F.col("rows_scraped")))


def top_with_remainder(df: DataFrame, order_cols, n: int = 5, group_cols=()) -> DataFrame:
    """First ``n`` rows (per group, by ``order_cols``) with their rank and the number
    of rows left out ("+N more")."""
    group_cols = list(group_cols)
    w = Window.partitionBy(*group_cols).orderBy(*order_cols) if group_cols else Window.orderBy(*order_cols)
    if not group_cols:
        # Global top-n: TakeOrderedAndProject keeps n rows per partition before one
        # final merge; the remainder comes from a count, not from moving rows.
        total = df.count()
        top = df.orderBy(*order_cols).limit(n)
        return (top.withColumn("rank", F.row_number().over(w).cast("long"))
                .withColumn("remainder", F.lit(max(total - n, 0)).cast("long")))
    # Per group: the rank filter becomes a WindowGroupLimit (n rows per group leave
    # each map task) and the group sizes come from a partial aggregate.
    ranked = df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    return (ranked.join(sizes, group_cols)
            .withColumn("remainder", F.greatest(F.col("_n") - n, F.lit(0)).cast("long")).drop("_n"))


def usage_dashboard(documents: DataFrame, links: DataFrame, interactions: DataFrame,
                    feedback: DataFrame, as_of, days: int = 7, n: int | None = None) -> DataFrame:
    """All analytics results as lines ``(section, rank, name, value)``: both rankings whole
    (or their first ``n`` and a "more" line with the count of the rest, as the page shows
    them) and the summaries. One union of aggregates; nothing passes the driver.

    Both rankings come from one count of the link ⋈ interaction join, all-time and inside
    the window (interaction ids are unique, so the inner join yields one row per link).
    Ranks are numbered on range slices, so no task holds a whole ranking."""
    from lexframe.operators.conversations import positional_rank
    from lexframe.operators.predicates import _ts
    cutoff = _ts(as_of) - F.make_dt_interval(F.lit(days))
    counts = (_links(links).join(interactions.select("interaction_id", "timestamp"), "interaction_id")
              .groupBy("document_id")
              .agg(F.count(F.lit(1)).alias("query_count"),
                   F.count_if(F.col("timestamp") >= cutoff).alias("weekly_query_count"))
              .join(documents.select("document_id", "filename"), "document_id"))
    lines = counts.select("filename", F.explode(F.array(*[
        F.struct(F.lit(c).alias("section"), F.col(c).alias("c")) for c in ("query_count", "weekly_query_count")])).alias("e"))
    lines = lines.select(F.col("e.section").alias("section"), F.col("filename").alias("name"),
                         F.col("e.c").cast("double").alias("value")).where("value > 0")
    out = positional_rank(lines, "section", [F.desc("value"), F.asc("name")], name="rank")
    if n is not None:
        sections = lines.sparkSession.createDataFrame([("query_count",), ("weekly_query_count",)], "section string")
        more = (sections.join(out.groupBy("section").agg(F.count(F.lit(1)).alias("all")), "section", "left")
                .select("section", F.lit(None).cast("long").alias("rank"), F.lit("more").alias("name"),
                        F.greatest(F.coalesce("all", F.lit(0)) - n, F.lit(0)).cast("double").alias("value")))
        out = out.where(F.col("rank") <= n).select("section", "rank", "name", "value").unionByName(more)
    for part in (response_summary(interactions), feedback_summary(feedback)):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in part.columns]))
        out = out.select("section", "rank", "name", "value").unionByName(part.select(pairs.alias("e")).select(
            F.lit("summary").alias("section"), F.lit(None).cast("long").alias("rank"), "e.name", "e.value"))
    return out


def left_feedback_join(interactions: DataFrame, feedback: DataFrame, thread=None) -> DataFrame:
    """Interactions with their vote (NULL when none). For one thread the rows come in
    time order (id breaks ties), as the conversation view reads them; over all
    threads no global sort is imposed (order per thread with ``positional_rank``)."""
    joined = lambda i: i.join(feedback.select("interaction_id", "is_positive"), "interaction_id", "left")
    if thread is None:
        return joined(interactions)
    return joined(interactions.where(F.col("thread_id") == F.lit(thread))).orderBy("timestamp", "interaction_id")
