"""Scans, sinks and tables for norm records (§2.1 #1-#12).

Two kinds of tables, both plain Parquet directories without a log of their own:

- snapshots (``write_version``): every version is a directory ``version=<label>``; the current one is the
  one written last, by the modification time of its files.
- keyed tables (``write_keyed``, ``merge_keyed``): one row per whole-number key, partitioned by ranges of the
  key that are sized to the table when it is made. A merge reads the ranges that its rows fall into
  and replaces them by dynamic partition overwrite; new keys open new ranges. Merges are
  idempotent (a row is replaced by a newer one only), so a merge that failed half-way is simply run again.
  A reader should not run during a merge.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.operators.upsert import dedup_keep_last, late_rows, not_late
from lexframe.session import cut_lineage, dropping_shuffles, scratch_table
from lexframe.schemas import NORM_COLUMNS, NORM_RAW_SCHEMA, NORM_SCHEMA, NULL_TOKENS

CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8",
}


# ---------------------------------------------------------------- scans
#: Column that takes a line which does not have the file's columns.
MALFORMED = "_corrupt_record"
SCAN_SCHEMA = T.StructType(NORM_RAW_SCHEMA.fields + [T.StructField(MALFORMED, T.StringType()), T.StructField("scrape_date", T.DateType())])


def load_order(source: Column, batch: int | None = None) -> Column:
    """The order in which rows arrived, as a struct that compares: when the file was written, the batch of the
    stream that read it, the file's name, the block, and the row. ``source`` is ``_metadata``."""
    return F.struct(source["file_modification_time"].alias("modified"), F.lit(batch).cast("long").alias("batch"), source["file_name"].alias("file"),
                    source["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))


def scan_norms_raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Daily files as text columns, NULL for the null tokens, with their load order: ``scrape_date``
    from the partition directory and ``_ord`` (``load_order``: a file written later comes later, whatever the
    sizes of the files). A multi-line CSV file is one split. A large file whose values hold no line breaks can
    be read with ``multi_line=False``: it is then split over tasks, and ``_ord`` still rises
    in file order. Lines without the file's columns keep their text in ``MALFORMED``."""
    df = spark.read.options(**CSV_OPTIONS | {"multiLine": str(multi_line).lower()}).schema(SCAN_SCHEMA).csv(path)
    cols = [F.when(F.col(c).isin(NULL_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c) for c in NORM_COLUMNS]
    return df.select(*cols, MALFORMED, "scrape_date", load_order(F.col("_metadata")).alias("_ord"))


def _typed(c: str):
    t = NORM_SCHEMA[c].dataType
    if isinstance(t, T.DateType):
        return F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")))
    if isinstance(t, T.LongType):
        return F.col(c).try_cast("long")
    return F.col(c)


def with_reason(raw: DataFrame) -> DataFrame:
    """Text rows with ``reason``: the columns whose raw value is present but does not fit its declared type, and
    whether the line is malformed; empty for a good row."""
    typed_cols = [c for c in NORM_COLUMNS if not isinstance(NORM_SCHEMA[c].dataType, T.StringType)]
    fails = [F.when(F.col(c).isNotNull() & _typed(c).isNull(), F.lit(c)) for c in typed_cols]
    if MALFORMED in raw.columns:
        fails.append(F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed line")))
    return raw.withColumn("reason", F.concat_ws(",", *fails))


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split text rows into typed rows and rejects: a row whose raw value is present
    but does not fit its declared type is rejected with the failing column names in
    ``reason``, and a malformed line as such, instead of sinking the whole day."""
    checked = with_reason(raw)
    extra = [c for c in raw.columns if c not in (*NORM_COLUMNS, MALFORMED)]
    good = (checked.where(F.col("reason") == "")
            .select(*[_typed(c).alias(c) for c in NORM_COLUMNS], *extra))
    bad = checked.where(F.col("reason") != "")
    return good, bad


def scan_norms(spark: SparkSession, path: str, rejects_path: str | None = None) -> DataFrame:
    """Typed norm records of the daily files. Rows that do not fit (see ``quarantine``) are
    written to ``rejects_path``; without one, they fail the scan rather than vanish."""
    good, bad = quarantine(scan_norms_raw(spark, path))
    if rejects_path is not None:
        bad.write.mode("append").parquet(rejects_path)
    else:
        first = bad.limit(1).collect()
        if first:
            raise ValueError(f"rows do not fit their types, e.g. {first[0].reason} of {first[0].id_norma}; give rejects_path")
    return good


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def workday_partitions(spark: SparkSession, start, end) -> DataFrame:
    """Daily partition keys from ``start`` to ``end`` (inclusive), Saturdays and Sundays
    excluded. ``start`` / ``end`` may be literals or one-row frames' columns."""
    s = F.to_date(F.lit(start)) if isinstance(start, str) else start
    e = F.to_date(F.lit(end)) if isinstance(end, str) else end
    days = F.explode(F.sequence(s, e, F.expr("interval 1 day"))).alias("scrape_date")
    return spark.range(1).select(days).where(F.weekday("scrape_date") < 5)


def workdays_of(df: DataFrame, ts_col: str) -> DataFrame:
    """Daily partition keys from the first to the last day of a table's time column, with the
    rows of each (0 for a working day without any); weekends excluded."""
    days = df.groupBy(F.to_date(ts_col).alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    span = days.agg(F.min("d").alias("s"), F.max("d").alias("e"))
    keys = span.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("scrape_date")).where(F.weekday("scrape_date") < 5)
    return keys.join(days, F.col("scrape_date") == F.col("d"), "left").select("scrape_date", F.coalesce("rows", F.lit(0)).alias("rows"))


# ---------------------------------------------------------------- sinks
def write_norms_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Daily files: fixed column order, header, one file per ``scrape_date``
    (a day holds at most the daily cap of rows, so one writer task per day is small).
    Empty text is written as a missing value, which loads as NULL. ``compression``: e.g. ``gzip``, which every scan reads
    (at its fastest level: a tenth larger, and hardly slower to write than plain text)."""
    out = df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in NORM_COLUMNS], "scrape_date")
    with dropping_shuffles(df.sparkSession):
        (out.repartition("scrape_date").write.mode(mode).options(**CSV_OPTIONS, compression=compression).option("zlib.compress.level", "BEST_SPEED")
         .partitionBy("scrape_date").csv(path))


def append_staging(df: DataFrame, path: str) -> DataFrame:
    """Append typed daily rows to the staging table, partitioned by ``scrape_date``.
    Re-running a day replaces that day only (dynamic partition overwrite), so a retry
    never duplicates rows. Returns ``(scrape_date, rows)`` of what was written."""
    spark = df.sparkSession
    rows = cut_lineage(df.select(*NORM_COLUMNS, "scrape_date"))  # written and counted, computed once
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scrape_date").parquet(path)
    return rows.groupBy("scrape_date").agg(F.count(F.lit(1)).alias("rows"))


def append_master(master: DataFrame, daily: DataFrame) -> DataFrame:
    """Master followed by the day's rows, no de-duplication (later rows win at load)."""
    return master.unionByName(daily, allowMissingColumns=True)


# ---------------------------------------------------------------- snapshots
def write_version(df: DataFrame, table_path: str, version: str) -> DataFrame:
    """Write ``df`` as the whole new state ``version``; returns the written table."""
    path = f"{table_path}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def current_version(spark: SparkSession, table_path: str) -> str | None:
    """Label of the version written last; None before the first."""
    try:  # the files are listed, not read
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(table_path)
    except AnalysisException:
        return None
    label = F.regexp_extract("path", "/version=([^/]+)/[^/]+$", 1)
    return files.agg(F.max(F.struct("modificationTime", label.alias("version"))).alias("m")).select("m.version").first()[0]


def read_current(spark: SparkSession, table_path: str) -> DataFrame:
    """The state of a snapshot table that was written last."""
    version = current_version(spark, table_path)
    if version is None:
        raise FileNotFoundError(f"no version under {table_path}")
    return spark.read.parquet(f"{table_path}/version={version}")


# ---------------------------------------------------------------- keyed tables
#: Rows that a key range of a new table is to hold.
RANGE_ROWS = 50_000
#: Steps in which a merge rewrites the ranges that it touches.
MERGE_PARTS = 4
_RANGE = ["key_width", "key_range"]


def _write_ranges(rows: DataFrame, path: str, key: str, width: int) -> None:
    out = rows.withColumns({"key_width": F.lit(width).cast("long"), "key_range": F.floor(F.col(key) / width).cast("long")})
    # Rows of one range go to one directory; a large range is spread over tasks by the size-based rebalance.
    with dropping_shuffles(rows.sparkSession):
        (out.hint("rebalance", "key_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy(*_RANGE).parquet(path))


def write_keyed(df: DataFrame, path: str, key: str, rows: int = RANGE_ROWS, held: bool = False) -> DataFrame:
    """``df`` (one row per ``key``, a whole number; rows without one are left out) as a new keyed table. The
    width of a range follows from the span of the keys and their number, about ``rows`` keys a range. ``held``: the
    rows are materialised already."""
    df = df.where(F.col(key).isNotNull())
    with ExitStack() as stack:
        df = df if held else stack.enter_context(scratch_table(df, "keyed"))
        span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
        width = max(1, -(-(span.hi - span.lo + 1) * rows // span.n)) if span.n else rows
        _write_ranges(df, path, key, width)
    return read_keyed(df.sparkSession, path, df.schema)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A keyed table. ``schema`` is needed while it is empty; columns that the table lacks are null."""
    if schema is None:
        return spark.read.parquet(path).drop(*_RANGE)
    return spark.read.schema(schema).parquet(path)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame | None, int]:
    """The rows of a keyed table with their ranges, and the width of a range; None while there is no table."""
    try:
        stored = spark.read.schema(T.StructType(schema.fields + [T.StructField(c, T.LongType()) for c in _RANGE])).parquet(path)
        first = stored.select("key_width").limit(1).collect()
    except AnalysisException:
        first = []
    return (stored, first[0][0]) if first else (None, 0)


def _touched(rows: DataFrame, key: str, width: int) -> list[int]:
    found = rows.where(F.col(key).isNotNull()).select(F.floor(F.col(key) / width)).distinct().collect()  # at most the table's partitions
    return sorted(r[0] for r in found)


def late_keyed(rows: DataFrame, path: str, key: str, newer: list[str], *columns) -> DataFrame:
    """``columns`` of the ``rows`` that are no newer, by the columns ``newer``, than the row of their key in a keyed table."""
    stored, width = _stored(rows.sparkSession, path, rows.select(key, *newer).schema)
    if stored is None:
        return rows.select(*columns).limit(0)
    return late_rows(rows, stored.where(F.col("key_range").isin(_touched(rows, key, width))), key, newer, *columns)


def merge_keyed(fresh: DataFrame, path: str, key: str, merge, rows: int = RANGE_ROWS, newer: list[str] | None = None, held: bool = False) -> int:
    """Merge ``fresh`` (one row per ``key``) into a keyed table: ``merge(stored rows of the touched ranges,
    fresh)`` gives the new rows of these ranges; the others are neither read nor written. Returns the number of
    ranges rewritten. ``merge`` must give the same when it is applied again. With ``newer`` (columns), rows that are no
    newer than the stored row of their key are left out first, so a range without news is not rewritten.
    The ranges are rewritten in ``MERGE_PARTS`` steps, so that only a part of the table is shuffled and held twice at a time; ``merge``
    is called for each. ``held``: the rows are materialised already."""
    fresh = fresh.where(F.col(key).isNotNull())
    with ExitStack() as stack:
        fresh = fresh if held else stack.enter_context(scratch_table(fresh, "fresh"))
        stored, width = _stored(fresh.sparkSession, path, fresh.schema)
        if stored is None:
            write_keyed(fresh, path, key, rows, held=True)
            return fresh.count()
        ranges = _touched(fresh, key, width)
        if newer and ranges:
            fresh = not_late(fresh, stored.where(F.col("key_range").isin(ranges)), key, newer)
            ranges = _touched(fresh, key, width)
        step = max(1, -(-len(ranges) // MERGE_PARTS))
        for part in (ranges[i:i + step] for i in range(0, len(ranges), step)):
            old = stored.where(F.col("key_range").isin(part)).drop(*_RANGE)
            # Read while it is overwritten: a dynamic partition overwrite replaces files when all new ones are written.
            _write_ranges(merge(old, fresh.where(F.floor(F.col(key) / width).isin(part))), path, key, width)
        return len(ranges)


def load_master(appended: DataFrame, table_path: str, version: str,
                order_cols=("scrape_date", "_ord")) -> DataFrame:
    """De-duplicated master (last row per ``id_norma`` in load order) written as a new
    version. Returns the written table."""
    cols = [c for c in appended.columns if not c.startswith("_")]
    latest = dedup_keep_last(appended, "id_norma", list(order_cols)).select(*cols)
    return write_version(latest, table_path, version)


def create_embeddings_table(norms: DataFrame, table_path: str, dim: int = 768, embedder=None) -> DataFrame:
    """Embeddings of every norm whose embedding succeeded, written as a table keyed by ``id_norma`` (CREATE TABLE
    AS SELECT); load-order columns (``scrape_date``, ``_ord``), if there are any, are kept so
    that later merges can tell older rows from newer ones."""
    from lexframe.operators.predicates import valid_embeddings
    from lexframe.operators.retrieval import embed, embedding_input
    order = [c for c in ("scrape_date", "_ord") if c in norms.columns]
    rows = embedding_input(norms, keep=order)
    return write_keyed(valid_embeddings(embed(rows, dim=dim, embedder=embedder, keep=order)), table_path, "id_norma")


def archive_snapshot(df: DataFrame, archive_path: str, snapshot_date: str) -> tuple[str, float]:
    """Copy a table under ``snapshot_date=<date>``; returns its location and size in MiB
    (rounded to 2) from the written files' metadata."""
    uri = f"{archive_path.rstrip('/')}/snapshot_date={snapshot_date}"
    df.write.mode("overwrite").parquet(uri)
    files = df.sparkSession.read.parquet(uri).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    return uri, round(size / (1024 * 1024), 2)


def consume_staging(spark: SparkSession, path: str, consumed_path: str, load: str) -> DataFrame:
    """Empty the staging table after its rows were merged, recording the consumed dates first:
    ``consumed_path`` holds (scrape_date, rows, load), and is returned. ``load`` names this run: a run that
    failed between the two steps is repeated under its name and replaces what it recorded; one that failed
    after them finds staging empty and leaves the record alone."""
    days = cut_lineage(spark.read.parquet(path).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("rows")))
    if not days.isEmpty():
        days.write.mode("overwrite").parquet(f"{consumed_path}/load={load}")
        truncate_staging(spark, path)
    return spark.read.schema("scrape_date date, rows long, load string").parquet(consumed_path)


def truncate_staging(spark: SparkSession, path: str) -> None:
    """Empty the staging table (same schema, no rows)."""
    schema = T.StructType(NORM_SCHEMA.fields + [T.StructField("scrape_date", T.DateType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str, dim: int | None = None, embedder=None) -> None:
    """Add chunk records to the chunk store; with ``dim``, each with the vector of its text
    (``embedding``), so that searches need not embed the store again."""
    if dim is not None:
        from lexframe.operators.retrieval import with_vectors
        chunks = with_vectors(chunks, "text", dim, embedder)
    chunks.write.mode("append").parquet(path)


def clear_chunks(spark: SparkSession, path: str) -> int:
    """Delete every chunk record; returns how many were deleted."""
    old = spark.read.parquet(path)
    n = old.count()
    spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)
    return n
