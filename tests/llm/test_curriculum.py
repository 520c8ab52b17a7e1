import math

import pytest
from pyspark.sql import functions as F

from lexframe.llm import curriculum as C
from lexframe.llm.common import n_words
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def targets(sizes, weights, budget=1.5, most=2):
    """Brute force: share again until no source is above its cap."""
    left, out = budget * sum(sizes.values()), {}
    while True:
        free = {k: w for k, w in weights.items() if k not in out}
        over = [k for k, w in free.items() if left * w / sum(free.values()) > most * sizes[k]]
        if not over:
            return out | {k: left * w / sum(free.values()) for k, w in free.items()}
        for k in over:
            out[k] = most * sizes[k]
        left = budget * sum(sizes.values()) - sum(out.values())


def test_targets_by_resharing(spark):
    sizes = {None: 40, "a": 10, "b": 1000, "c": 5, "É": 300, "z": 0}
    weights = dict(zip(["a", "b", "c", "z", "É", None], [3, 1, 2, 3, 1, 2]))
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in C.source_targets(df).collect()}
    want = targets(sizes, weights)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_demand_inverse(spark):
    for schedule in [*C.SCHEDULES, [(0.0, 0.0), (0.3, 2.0), (1.0, 0.0)], [(0.0, 1.0), (0.2, 0.0), (0.5, 0.0), (1.0, 1.0)]]:
        shares = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
        for u, t in shares.select("u", C.demand_inverse(F.col("u"), schedule)).collect():
            def area(x):
                total = 0.0
                for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
                    h = min(max(x - t0, 0), t1 - t0)
                    total += w0 * h + (w1 - w0) / (t1 - t0) * h * h / 2
                return total
            assert abs(area(t) / C.integral(schedule) - u) < 1e-6


@pytest.mark.parametrize("name", ["docs", "awkward"])
def test_mix_meets_targets(request, spark, name):
    df = request.getfixturevalue(name)
    rows = C.taken_words(df).collect()
    assert len(rows) == df.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for s, r in [(r.row.source, r) for r in C.plan(df, n_words(F.col("text"))).collect()]:
        by.setdefault(s, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2 + 0.5
        assert all(r.taken == 0 or r.taken % r["size"] == 0 for r in rs)  # whole documents
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, C.taken_words(df).collect()), key=str)


def test_documents_in_training_order(spark, docs, awkward, empty):
    plan = C.plan(docs, n_words(F.col("text")))
    spots = [r.position for r in C.copies(plan).collect()]
    assert spots == sorted(spots) and 0 <= spots[0] and spots[-1] <= 1
    for df in (docs, awkward):
        out = C.mix_documents(df)
        assert out.columns == df.columns
        want = sum(r.taken for r in C.taken_words(df).collect())
        assert out.agg(F.sum(n_words(F.col("text")))).first()[0] == want
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}  # whole texts
    assert C.mix_documents(empty).count() == 0 and C.taken_words(empty).count() == 0


def test_schedule_shifts_sources_in_time(spark):
    """A falling schedule puts more of its words early, a rising one late."""
    df = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 400)], "doc_id long, text string, source string")
    rows = C.copies(C.plan(df, n_words(F.col("text")))).select("source_size", "turn", "position", F.col("size").alias("words")).collect()
    early = {t: sum(r.words for r in rows if r.turn == t and r.position < 0.5) / sum(r.words for r in rows if r.turn == t) for t in (0, 1, 2)}
    assert abs(early[0] - 3.5 / 6) < 0.02 and abs(early[1] - 0.5) < 0.02 and abs(early[2] - 0.75 / 2) < 0.02
