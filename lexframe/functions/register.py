"""User-callable surface (§2.11 #63).

``register_functions(spark)`` adds SQL functions written in SQL (Spark SQL UDFs,
inlined by the optimizer: no Python at run time):

  norm_date(text)             bulletin date text → DATE
  source_name(path)           last path segment, "unknown" when NULL
  resolve_url(href, base)     absolute link
  workday_add(start, n)       n-th working day from a working day

``search`` (in ``lexframe.operators.retrieval``) is the Python entry point of the
retrieval tool: a table of questions → context string per question.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexframe.functions.text import SPANISH_MONTHS

_WS = r"[\s\x{00a0}]"
_TRIM = f"regexp_replace(x, r'^{_WS}+|{_WS}+$', '')"
_DASH = r"r'^(\d{2})-([A-Za-z]{3})-(\d{4})'"
_MONTHS = "map(" + ", ".join(f"'{m}', '{i + 1:02d}'" for i, m in enumerate(SPANISH_MONTHS)) + ")"

NORM_DATE_SQL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION norm_date(x STRING) RETURNS DATE RETURN
to_date(coalesce(
  CASE WHEN {_TRIM} RLIKE r'^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$' THEN try_to_timestamp({_TRIM}, 'd/M/yyyy') END,
  CASE WHEN regexp_extract({_TRIM}, {_DASH}, 2) <> '' THEN try_to_timestamp(
    concat(regexp_extract({_TRIM}, {_DASH}, 3), '-',
           try_element_at({_MONTHS}, upper(regexp_extract({_TRIM}, {_DASH}, 2))), '-',
           regexp_extract({_TRIM}, {_DASH}, 1)), 'yyyy-MM-dd') END))
"""

SOURCE_NAME_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION source_name(x STRING) RETURNS STRING RETURN
element_at(split(coalesce(x, 'unknown'), '/'), -1)
"""

RESOLVE_URL_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION resolve_url(href STRING, base STRING) RETURNS STRING RETURN
CASE WHEN startswith(href, 'http') THEN href ELSE concat(base, href) END
"""

WORKDAY_ADD_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION workday_add(start DATE, n BIGINT) RETURNS DATE RETURN
date_add(start, CAST(floor(n / 5) * 7 + pmod(n, 5) + CASE WHEN weekday(start) + pmod(n, 5) >= 5 THEN 2 ELSE 0 END AS INT))
"""


def register_functions(spark: SparkSession) -> list[str]:
    """Register the SQL functions in the session; returns their names."""
    for stmt in (NORM_DATE_SQL, SOURCE_NAME_SQL, RESOLVE_URL_SQL, WORKDAY_ADD_SQL):
        spark.sql(stmt)
    return ["norm_date", "source_name", "resolve_url", "workday_add"]
