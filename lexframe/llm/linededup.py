"""Line de-duplication by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages that contain it over
the host's page total, and lines above a boilerplate ratio are dropped from every page of the host.

Counting is a partial aggregate over (host, line key), so a host with a third of all pages sends
one row per map task and line. A host's boilerplate lines number at most (mean lines a page) /
ratio, whatever the number of its pages, so they are kept as one array per host and joined to the
pages by host; pages are never regrouped by line. The array table is written first, so the planner
sees its true size and broadcasts it only when it is small; otherwise it is a join on host whose
skewed partitions are split at run time.

A page that would lose more than half of its text is left whole: it is not framed by boilerplate but a copy
of other pages, and copies are a matter of de-duplication, which keeps one of them, while dropping the
lines of all would lose the text.

Defined cases: a null host is a site of its own; a null text counts as a page without lines and
stays null; blank lines are never boilerplate and stay; a line twice on a page counts once;
repeated rows and copies of a page count as one page of the host (by a 128-bit hash of the text), so that
copying a page never makes boilerplate of it; without ``copies_once`` as separate pages;
lines are compared without white space at their ends (by a 128-bit hash); extra columns are carried;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import SPACES, materialise

#: A line is boilerplate above this share of its site's pages ...
MAX_RATIO = 0.1
#: ... if at least this many of its pages contain it.
MIN_PAGES = 3
#: A page keeps at least this share of its characters, or is left whole.
MIN_KEPT = 0.5


def _key(line: Column) -> Column:
    """Two 64-bit hashes of the stripped line; null for a blank line."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                copies_once: bool = True) -> DataFrame:
    """One row per host with boilerplate: ``_host`` and ``_drop``, the keys of its lines."""
    rows = pages.select(host.alias("_host"), text.alias("_text"))
    n_pages = F.count(F.lit(1))
    if copies_once:
        # Partial aggregates by host (line) and page first, then by host (line): no host or line is gathered.
        rows = rows.withColumn("_page", F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit("page"), "_text").alias("b")))
        n_pages = F.count_distinct("_page")
    totals = rows.groupBy("_host").agg(n_pages.alias("_pages"))
    keys = F.array_distinct(F.filter(F.transform(F.split("_text", "\n"), _key), lambda k: k.isNotNull()))
    counts = (rows.withColumn("_key", F.explode(keys)).drop("_text")
              .groupBy("_host", "_key").agg(n_pages.alias("_n")).where(F.col("_n") >= min_pages))
    return (counts.join(totals, counts["_host"].eqNullSafe(totals["_host"]))
            .where(F.col("_n") > max_ratio * F.col("_pages"))
            .groupBy(counts["_host"]).agg(F.collect_list("_key").alias("_drop")))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None, copies_once: bool = True,
                     min_kept: float = MIN_KEPT) -> DataFrame:
    """The pages with boilerplate lines dropped from their text. ``counts`` names two columns to
    add: the page's lines, and those dropped."""
    # Names of the working columns cannot clash: the page travels as one struct.
    packed = pages.select(host.alias("_host"), F.struct(*(F.col(c) for c in pages.columns)).alias("_row"))
    drop = materialise(boilerplate(pages, host, F.col(text_col), max_ratio, min_pages, copies_once), "boilerplate")
    drop = drop.withColumnRenamed("_host", "_site")
    joined = packed.join(drop, F.col("_host").eqNullSafe(F.col("_site")), "left")
    text = F.col("_row")[text_col]
    staged = joined.withColumn("_lines", F.split(text, "\n"))
    kept = F.filter("_lines", lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), _key(x)), F.lit(False)))
    staged = staged.withColumn("_left", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
    chars = lambda c: F.char_length(F.array_join(c, ""))
    whole = chars("_left") < min_kept * chars("_lines")
    staged = staged.withColumn("_kept", F.when(whole, F.col("_lines")).otherwise(F.col("_left")))
    new_text = F.array_join("_kept", "\n")
    out = [(new_text if c == text_col else F.col("_row")[c]).alias(c) for c in pages.columns]
    if counts:
        out += [F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias(counts[0]),
                F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias(counts[1])]
    return staged.select(*out)
