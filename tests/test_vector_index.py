"""The stored vector index: appends, partition pruning, exactness for every metric."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexframe.operators import retrieval as R
from lexframe.operators import vector_index as V
from lexframe.session import scratch_path


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(int(i), [float(x) for x in v], f"n{i}") for i, v in rows], f"{name} long, embedding array<float>, note string")


def brute(queries, rows, k, metric):
    out = {}
    for qi, q in queries:
        q = np.asarray(q, np.float32).astype(float)
        found = []
        for i, v in rows:
            v = np.asarray(v, np.float32).astype(float)
            d = {"l2": lambda: np.sqrt(((q - v) ** 2).sum()), "ip": lambda: -(q @ v),
                 "cosine": lambda: 1 - (q @ v) / np.sqrt((q @ q) * (v @ v))}[metric]()
            found.append((round(float(d), 9), i))
        out[qi] = [i for _, i in sorted(found)[:k]]
    return out


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 20
    return [(seed * 10000 + i, centres[i % 12] + rng.normal(size=6) * (0.5 + i % 3)) for i in range(n)]


def got(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_exact_after_appends(spark, metric):
    path = scratch_path(spark, "index")
    first, second, queries = clustered(300, 1), clustered(200, 2), clustered(40, 3)
    second = [(i, v * (5 if i % 7 == 0 else 1)) for i, v in second]  # longer than any row the index was made from
    V.create(frame(spark, first), path, metric, n_cells=20)
    V.append(frame(spark, second), path)
    hits = V.search(frame(spark, queries, "query_id"), path, k=5, columns=["note"])
    assert got(hits) == brute(queries, first + second, 5, metric)
    assert all(r.note == f"n{r.id}" for r in hits.collect())
    assert V.read(spark, path).count() == 500 and set(V.read(spark, path).columns) == {"id", "embedding", "note"}


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_large_query_tables_take_the_cell_plan(spark, monkeypatch, metric):
    monkeypatch.setattr(R, "QUERY_BROADCAST_BYTES", 10)
    path = scratch_path(spark, "index")
    rows, queries = clustered(200, 1), clustered(30, 3)
    V.create(frame(spark, rows), path, metric, n_cells=10)
    assert got(V.search(frame(spark, queries, "query_id"), path, k=3)) == brute(queries, rows, 3, metric)


def test_a_search_lists_only_the_cells_it_needs(spark):
    path = scratch_path(spark, "index")
    rows = clustered(600, 1)
    V.create(frame(spark, rows), path, n_cells=24)
    held = V.cells(spark, path).count()
    one = frame(spark, [(1, rows[0][1])], "query_id")
    hits = V.search(one, path, k=4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters" in line and "cell" in line]
    assert filters and "cell" in filters[0].split("PartitionFilters")[1] and held > 12
    assert got(hits) == brute([(1, rows[0][1])], rows, 4, "l2")


def test_an_append_leaves_stored_files_alone(spark):
    path = scratch_path(spark, "index")
    V.create(frame(spark, clustered(100, 1)), path, n_cells=8)
    files = lambda: {r[0] for r in spark.read.parquet(f"{path}/rows").select("_metadata.file_path").distinct().collect()}
    before = files()
    V.append(frame(spark, clustered(50, 2)), path)
    assert before < files()


def test_cases(spark):
    path = scratch_path(spark, "index")
    schema = "id long, embedding array<float>"
    with pytest.raises(ValueError, match="centres"):
        V.create(spark.createDataFrame([(1, [])], schema), path)
    V.create(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (4, [0.0, 1.0])], schema), path)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert got(V.search(q, path, k=9)) == {7: [1, 4, 4]}  # ties by id, an id stored twice is there twice
    assert V.search(q.limit(0), path).count() == 0


def test_ip_cells_scan_fewer_cells(spark):
    rows = clustered(600, 1)
    corpus = np.array([v for _, v in rows])
    longest = float(np.sqrt((corpus ** 2).sum(1)).max())
    centres = R.cell_space(corpus[:24], "ip", longest)
    import pandas as pd
    placed = pd.concat(R._nearest_cell(centres, "ip", longest)([pd.DataFrame({"id": range(600), "vec": list(corpus)})]))
    radius = placed.groupby("cell").to_centre.max().to_dict()
    dk = [np.sort(-(corpus @ q))[3] for q in corpus[:50]]
    asked = pd.DataFrame({"query_id": range(50), "qvec": list(corpus[:50]), "dk": dk})
    near = pd.concat(R._cells_in_reach(centres, 1, radius, "ip", longest)([asked]))
    assert len(near) < 0.5 * 50 * (len(radius) - 1)
    cell_of = placed.cell.to_numpy()
    for i, q in enumerate(corpus[:50]):  # no cell with a nearer row is left out
        probed = int(np.argsort(R._blas_sq(R.cell_space(q[None], "ip", query=True), centres)[0][sorted(radius)], kind="stable")[0])
        reached = set(near[near.query_id == i].cell) | {sorted(radius)[probed]}
        assert {int(c) for c in cell_of[-(corpus @ q) <= dk[i]]} <= reached


def test_search_reads_the_index(spark):
    path = scratch_path(spark, "index")
    texts = spark.createDataFrame([(i, f"word{i % 7} other{i}", f"dir/f{i}.txt") for i in range(80)], "id long, text string, source string")
    V.create(R.with_vectors(texts, "text", 32), path)
    asked = spark.createDataFrame([(1, "word3 other3"), (2, "other70")], "query_id long, text string")
    got = {r.query_id: r.context for r in R.search(asked, None, k=2, dim=32, index=path).collect()}
    want = {r.query_id: r.context for r in R.search(asked, texts, k=2, dim=32).collect()}
    assert got == want and got[1].startswith("Source: f3.txt")


def test_scratch_tables_are_removed(spark):
    """In a session folder of its own application: what a query wrote is gone after ``drop_scratch``."""
    import os

    from lexframe import session
    own = session._scratch_root
    root = scratch_path(spark, "root")
    try:
        session._scratch_root = lambda s: root
        path = session.scratch_path(spark, "t")
        spark.range(5).write.parquet(path)
        spark.range(5).write.parquet(session.scratch_path(spark, "t"))
        assert os.listdir(root) and len(os.listdir(root)) == 2
        assert session.drop_scratch(spark) == 2 and not os.path.exists(root) and session.drop_scratch(spark) == 0
    finally:
        session._scratch_root = own
