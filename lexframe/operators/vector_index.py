"""A stored vector index: rows kept by cell, appended to, and searched without reading the other cells.

An index is a folder with two tables:

- ``centres``: one row per cell, its centre, the metric, and for ``ip`` the length that rows are brought to. Centres are
  a bounded sample of the first rows (at most ``MAX_CELLS``) and stay; exactness does not depend on them.
- ``rows``: the rows with their distance to their centre, partitioned by cell. ``append`` adds to it and never
  rewrites a cell.

A search reads of the rows table two narrow columns for the cells' radii, then the cells that its queries need:
first the nearest of each query, then those that the triangle bound cannot rule out. The cells are a
partition filter, so Spark lists no other directory. The result equals brute force. Query tables of up to
``QUERY_BROADCAST_BYTES`` are broadcast and no stored row is shuffled; larger ones take ``knn`` over the stored rows.

With ``ip``, a row longer than those that the index was made from goes to the cell ``OUTSIDE``, which every search reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.operators import retrieval as R
from lexframe.session import cut_lineage

MAX_CELLS, OUTSIDE = 4096, -1


def create(rows: DataFrame, path: str, metric: str = "l2", n_cells: int | None = None, id_col: str = "id", vec_col: str = "embedding",
           seed: int = 7) -> None:
    """Makes an index of ``rows`` (id, vector, and any columns that are kept) at ``path``. Rows without a vector are left out."""
    rows = cut_lineage(rows.where(F.size(vec_col) > 0))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(R._dot(F.col(vec_col), F.col(vec_col))))).first()
    if not n:
        raise ValueError("an index needs at least one vector to choose its centres from")
    n_cells = n_cells or int(max(8, min(MAX_CELLS, round(n ** 0.5))))
    longest = float(longest) if metric == "ip" else 0.0
    centres = R.cell_space(np.stack(R._sample_centres(rows, vec_col, n_cells, seed, n)), metric, longest)
    table = [(i, [float(x) for x in c], metric, longest) for i, c in enumerate(centres)]
    spark = rows.sparkSession
    spark.createDataFrame(table, "cell int, centre array<double>, metric string, longest double").coalesce(1).write.parquet(f"{path}/centres")
    append(rows, path, id_col, vec_col)


def _centres(spark: SparkSession, path: str):
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MAX_CELLS rows
    return np.array([r.centre for r in found]), found[0].metric, found[0].longest


def append(rows: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Adds rows to the index. An id that is there already is there twice."""
    spark = rows.sparkSession
    centres, metric, longest = _centres(spark, path)
    keep = [c for c in rows.columns if c not in (id_col, vec_col)]
    given = rows.where(F.size(vec_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"),
                                                   *([F.struct(*keep).alias("row")] if keep else []))
    placed = given.mapInPandas(_placed(centres, metric, longest), _placed_schema(given))
    out = placed.select("id", F.col("vec").alias("embedding"), *([F.col("row")[c].alias(c) for c in keep]), "to_centre", "cell")
    out.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def _placed_schema(given: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([*given.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())])


def _placed(centres, metric: str, longest: float):
    near = R._nearest_cell(centres, metric, longest)

    def fn(batches):
        for pdf in near(batches):
            if metric == "ip":
                v = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                pdf.loc[np.sqrt(np.einsum("ij,ij->i", v, v)) > longest * (1 + 1e-12), "cell"] = OUTSIDE
            yield pdf
    return fn


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows."""
    return spark.read.parquet(f"{path}/rows").drop("to_centre", "cell")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Per cell: cell, rows, radius."""
    return spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("to_centre").alias("radius"))


def search(queries: DataFrame, path: str, k: int = R.DEFAULT_K, query_id: str = "query_id", query_vec: str = "embedding", n_probe: int = 2,
           columns: list[str] = []) -> DataFrame:
    """The ``k`` nearest stored rows of each query: query_id, id, rank, distance, and ``columns`` of the row."""
    spark = queries.sparkSession
    centres, metric, longest = _centres(spark, path)
    q = cut_lineage(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec")).where(F.size("qvec") > 0))
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    if not n:
        hits = spark.createDataFrame([], "query_id long, id long, rank long, distance double")
    elif n * width * 4 > R.QUERY_BROADCAST_BYTES:
        hits = R.knn(q, read(spark, path), k, query_vec="qvec", metric=metric, strategy="cells")
    else:
        stats = {r.cell: (r.rows, r.radius) for r in cells(spark, path).collect()}  # one row per cell
        outside = stats.pop(OUTSIDE, None)
        radius = {c: r for c, (_, r) in stats.items()}
        asked = q.withColumn("dk", F.lit(float("inf")))
        if radius:
            probed = asked.mapInPandas(_cells_of(R._probed_cells(centres, n_probe, sorted(radius), metric)), "cell int")
            first = _top(_scan(probed, asked, path, k, metric, longest, centres, radius, n_probe), k)
            bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("dk"))
            asked = cut_lineage(q.join(bound, "query_id", "left").withColumn("dk", F.coalesce("dk", F.lit(float("inf")))))
        reached = (asked.mapInPandas(_cells_of(R._cells_in_reach(centres, 0, radius, metric, longest)), "cell int") if radius else
                   spark.createDataFrame([], "cell int"))
        hits = _top(_scan(reached, asked, path, k, metric, longest, centres, radius, also=[OUTSIDE] if outside else []), k)
    hits = hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance")
    if not columns:
        return hits
    return hits.join(read(spark, path).select("id", *columns), "id").select("query_id", "id", "rank", "distance", *columns)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.select("query_id", "id", "distance").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _cells_of(fn):
    """Per batch, the distinct cells that ``fn`` gives."""
    def cells(batches):
        for pdf in batches:
            found = [np.unique(part["cell"].to_numpy()) for part in fn([pdf])]
            if found:
                yield pd.DataFrame({"cell": np.unique(np.concatenate(found))})
    return cells


def _scan(wanted: DataFrame, asked: DataFrame, path: str, k: int, metric: str, longest: float, centres, radius: dict, n_probe: int = 0,
          also: list[int] = []) -> DataFrame:
    """The at most ``k`` nearest rows a query and partition in the ``wanted`` cells; a query meets those that it looks as far as
    (``n_probe``, or the bound ``dk``), and all queries meet the cells of ``also``. The queries travel to the tasks; they are
    bounded by the check in ``search``. Which cells a query looks at is found there, one cell at a time."""
    spark = asked.sparkSession
    cells = sorted({r.cell for r in wanted.distinct().collect()} | set(also))  # at most MAX_CELLS
    held = np.array(sorted(radius), int)
    shared = spark.sparkContext.broadcast(R.collect_vectors(asked, "dk"))

    def fn(batches):
        best, last, near = None, None, None
        for pdf in batches:
            for cell, group in pdf.groupby("cell"):
                if best is None:
                    ids, vectors, dk = shared.value
                    best, reach = R._Nearest(ids, vectors, k, metric, dk), np.empty(len(ids))
                    for s in range(0, len(ids) if len(held) else 0, R.QUERY_SLICE):
                        v = vectors[s:s + R.QUERY_SLICE].astype(np.float64)
                        reach[s:s + R.QUERY_SLICE] = R._reach(v, centres[held], metric, longest, n_probe, None if n_probe else dk[s:s + R.QUERY_SLICE])
                if cell != last:
                    inner = 0.0 if n_probe else radius.get(cell, 0.0)
                    near = None if cell in also else np.nonzero(R._looks(vectors, reach, centres[[cell]], inner, metric)[:, 0])[0]
                    last = cell
                best.offer(group["id"].to_numpy(), np.stack(group["vec"].to_numpy()), near)
        if best is not None:
            yield best.found()

    stored = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(cells))  # a partition filter
    return stored.select("id", F.col("embedding").alias("vec"), "cell").mapInPandas(fn, "query_id long, id long, distance double")
