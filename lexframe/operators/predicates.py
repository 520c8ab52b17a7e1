"""Filters and predicates (§2.3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_embeddings(df: DataFrame, col: str = "ml_generate_embedding_result") -> DataFrame:
    """Rows whose embedding has at least one value (NULL and empty arrays are failures)."""
    return df.where(F.size(F.col(col)) > 0)


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (dt.datetime, dt.date)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of.isoformat()
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def trailing_window(df: DataFrame, ts_col: str, as_of, days: int = 7) -> DataFrame:
    """``ts_col >= as_of - days``: inclusive lower bound, no upper bound (a pushed-down
    range predicate on the scan)."""
    return df.where(F.col(ts_col) >= _ts(as_of) - F.make_dt_interval(F.lit(days)))


def owner_filter(df: DataFrame, user_id, owner_col: str = "user_id") -> DataFrame:
    """Rows owned by one user; a lookup of an id owned by someone else finds nothing."""
    return df.where(F.col(owner_col) == F.lit(user_id))


# Fixed value: paths whose requests are never logged. Sampling works in millionths.
HEALTH_PATHS = ["/health"]
SAMPLE_BUCKETS = 1_000_000


def sample_bucket(key) -> Column:
    """Reproducible uniform bucket in [0, ``SAMPLE_BUCKETS``) from the md5 of a key
    (the same value in any engine that has md5)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(SAMPLE_BUCKETS))


def tail_sample(log: DataFrame, threshold_ms: float = 1000.0, rate: float = 0.1,
                key: str = "request_id", status_col: str = "status_code",
                duration_col: str = "duration_ms", path_col: str = "http_path") -> DataFrame:
    """Keep every error (status >= 400), every slow request (duration > threshold)
    and a reproducible ``rate`` share of the rest. Requests to ``HEALTH_PATHS`` are not
    logged at all."""
    if path_col in log.columns:
        log = log.where(~F.coalesce(F.col(path_col).isin(HEALTH_PATHS), F.lit(False)))
    keep = ((F.col(status_col) >= 400) | (F.col(duration_col) > F.lit(threshold_ms))
            | (sample_bucket(key) < F.lit(rate * SAMPLE_BUCKETS)))
    return log.where(keep)


# The one accepted upload type and the refusal text.
PDF_MEDIA_TYPE = "application/pdf"
MEDIA_ERROR = "Only PDF files are allowed."


def accept_media(batch: DataFrame, types=(PDF_MEDIA_TYPE,), type_col: str = "content_type") -> DataFrame:
    """Adds ``error``: NULL for an accepted media type, the refusal text otherwise."""
    ok = F.col(type_col).isin(list(types))
    return batch.withColumn("error", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(MEDIA_ERROR)))


def is_empty(df: DataFrame) -> DataFrame:
    """One row, ``empty``: does the collection hold no record? Reads at most one row."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
