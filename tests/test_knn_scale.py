"""What moves and what is held in a nearest-neighbour search, and the running top k against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexframe.operators import retrieval as R


def uniform(spark, n, seed, name="id", width=8):
    v = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, embedding array<float>")
    return v.astype(float), rows


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_a_query_goes_to_a_region_once(spark, monkeypatch, metric):
    """Vectors that do not cluster: every query looks at most cells, yet it travels once to each region."""
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 2000)  # several query blocks
    c, corpus = uniform(spark, 900, 1)
    q, queries = uniform(spark, 150, 2, "query_id")
    seen = spark.sparkContext.accumulator(0)
    own = R._region_scan

    def counted(*args):
        fn = own(*args)

        def count(batches):
            for pdf in batches:
                seen.add(int((pdf["cell"] < 0).sum()))
                yield pdf
        return lambda batches: fn(count(batches))

    monkeypatch.setattr(R, "_region_scan", counted)
    found = R.knn(queries, corpus, k=3, metric=metric, n_cells=100, block_rows=100, strategy="cells").collect()
    assert 150 <= seen.value <= 2 * 9 * 150  # probe and bound, 9 regions of 100 rows; 100 cells
    got = {i: [x.id for x in sorted((x for x in found if x.query_id == i), key=lambda x: x.rank)] for i in range(150)}
    dot, norm = q @ c.T, lambda x: np.sqrt((x * x).sum(1))
    d = {"l2": ((q[:, None] - c) ** 2).sum(2), "ip": -dot, "cosine": 1 - dot / norm(q)[:, None] / norm(c)}[metric]
    assert got == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(150)}


def test_cells_in_reach_come_in_bounded_pieces():
    rng = np.random.default_rng(1)
    asked = pd.DataFrame({"query_id": range(2000), "qvec": list(rng.normal(size=(2000, 4))), "dk": np.inf})
    pieces = list(R._cells_in_reach(rng.normal(size=(24, 4)), 2, {c: 1.0 for c in range(24)}, "l2", 0.0)([asked]))
    assert sum(map(len, pieces)) == 2000 * 22 and max(map(len, pieces)) <= R.QUERY_SLICE * 22


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_running_top_k(metric):
    """Batches of any size, copies, equal distances, zero and missing numbers."""
    rng = np.random.default_rng(3)
    c = rng.integers(-2, 3, size=(400, 3)).astype(np.float32)  # many copies and ties; zero vectors
    c[7] = np.nan
    q = rng.integers(-2, 3, size=(30, 3)).astype(np.float32)
    ids = rng.permutation(400)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = q.astype(float)[:, None], c.astype(float)[None]
        dot = (a * b).sum(2)
        d = {"l2": np.sqrt(((a - b) ** 2).sum(2)), "ip": -dot, "cosine": 1 - dot / (np.sqrt((a * a).sum(2)) * np.sqrt((b * b).sum(2)))}[metric].round(12)
    want = {i: [int(ids[j]) for j in np.lexsort((ids, d[i]))[:6]] for i in range(30)}
    for step in (1, 2, 50, 400):
        best = R._Nearest(np.arange(30), q, 6, metric, slice_rows=7)
        for s in range(0, 400, step):
            best.offer(ids[s:s + step], c[s:s + step])
        found = best.found()
        if metric != "cosine":  # rounding parts equal cosines
            assert {i: g["id"].tolist() for i, g in found.groupby("query_id")} == want
        distance = found["distance"].to_numpy().reshape(30, 6)
        assert np.allclose(np.where(np.isnan(distance), np.inf, distance), [sorted(r)[:6] for r in np.where(np.isnan(d), np.inf, d)])


def test_recall_searches_once(spark, monkeypatch):
    """The exact search reads the corpus once, beside the pass that chooses the probes."""
    from lexframe.plans import catalog
    read = spark.sparkContext.accumulator(0)
    own = R._broadcast_scan

    def counted(*args):
        fn = own(*args)

        def count(batches):
            for pdf in batches:
                read.add(len(pdf))
                yield pdf
        return lambda batches: fn(count(batches))

    monkeypatch.setattr(R, "_broadcast_scan", counted)
    rows = catalog.q_knn_approx_recall(spark, SF001).collect()
    n = spark.read.parquet(f"{SF001}/embeddings.parquet").where(F.size("embedding") > 0).count()
    assert len(rows) == n and all(r.self_found and r.at_most_k and r.recall_reached for r in rows)
    assert read.value == 2 * n
