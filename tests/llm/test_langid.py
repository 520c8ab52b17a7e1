import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexframe.llm import langid as L
from lexframe.llm.common import is_training
from llm_data import awkward, empty  # noqa: F401 - fixtures


def test_blocks_equal_all_paths():
    """Marginals against the sum over every label sequence."""
    rng = np.random.default_rng(5)
    t, sizes = rng.random((3, 3)) + 0.1, np.array([5, 0, 1, 7])
    e = rng.random((int(sizes.sum()), 3)) + 0.05
    at, want = 0, np.zeros((4, 3))
    for d, n in enumerate(sizes):
        total = 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            if not n:
                continue
            p = t[:, path[0]].sum() * e[at, path[0]]
            for i in range(1, n):
                p *= t[path[i - 1], path[i]] * e[at + i, path[i]]
            total += p
            for y in path:
                want[d, y] += p
        if n:
            want[d] /= total
        at += n
    for block in (2, 3, 64):
        sums, sure = L.marginal_sums(e, t, sizes, block)
        assert np.allclose(sums, want) and (sure <= sizes).all()
        gamma, _ = L.posteriors(e[None, 6:13], t)
        assert sure[3] == (gamma[0].max(axis=1) >= L.SURE).sum()
    gamma, _ = L.posteriors(e[None, 6:13], t)
    assert np.allclose(gamma.sum(axis=1)[0], want[3])


def test_gradient_of_the_transitions():
    """Expected transition counts are the derivative of log Z."""
    rng = np.random.default_rng(2)
    e, a = rng.random((2, 6, 3)) + 0.1, rng.normal(size=(3, 3))

    def log_z(a):
        total = 0.0
        for chain in e:
            now = np.full(3, 1 / 3) * 1.0
            v = now @ np.exp(a0) * chain[0]  # the first step keeps the start fixed
            for x in chain[1:]:
                v = v @ np.exp(a) * x
            total += np.log(v.sum())
        return total
    a0 = a.copy()
    _, pairs = L.posteriors(e, np.exp(a))
    for i, j in itertools.product(range(3), repeat=2):
        up, down = a.copy(), a.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert abs((log_z(up) - log_z(down)) / 2e-5 - pairs[i, j]) < 1e-5


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, is_training(F.col("doc_id"), 3, 1))
    rows = L.label(docs, model).where(~is_training(F.col("doc_id"), 3, 1)).select("doc_id", "lang", "lang_pred", "score").collect()
    assert {r.doc_id for r in rows} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    en, fr = "the and thing that was", "être les avec que dans"
    mixed = [r.score for r in L.label(spark.createDataFrame([(f"{en} " * 6 + f"{fr} " * 6,), (f"{en} " * 12,)], "text string"), model).collect()]
    assert mixed[0] < 0.7 < 0.9 < mixed[1]  # half of the words carry each language


def test_awkward_rows(spark, awkward, empty):
    model = L.fit(awkward, is_training(F.col("doc_id"), 3, 1))
    out = L.label(awkward, model)
    assert out.columns == [*awkward.columns, "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (r.score == 0) == (not lettered)
    digits = spark.createDataFrame([("² ³ Ⅷ 12",), (None,)], "text string")
    assert {r.lang_pred for r in L.label(digits, model).collect()} == {"und"}
    none = L.fit(empty, F.lit(True))
    assert none.langs == [] and {(r.lang_pred, r.score) for r in L.label(awkward, none).collect()} == {("und", 0.0)}
    assert L.label(empty, model).count() == 0


def test_training_spans_come_from_the_whole_text(spark):
    """A long text gives spans from each of its parts, without the words that a span cuts; a short one is whole."""
    long = " ".join(f"w{i:05d}" for i in range(20000))
    rows = [(1, long), (2, "short text"), (3, "x" * 5000), (4, None)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", L._spans(F.col("t"), F.col("i")).alias("s")).collect()}
    words = got[1].split()
    places = [int(w[1:]) for w in words if len(w) == 6]
    assert len(places) == len(words) and len(got[1]) <= L.FIT_CHARS + L.FIT_SPANS
    assert {p * L.FIT_SPANS // 20000 for p in places} == set(range(L.FIT_SPANS)) and min(places) > 0
    assert got[2] == "short text" and set(got[3]) <= {"x", " "} and got[4] is None


def test_words_are_sure_of_some_language(spark):
    """Three languages in equal parts: no language holds the text, each word is sure of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, is_training(F.col("doc_id"), 3, 1))
    de = docs.where("lang = 'de'").first().text.split()[:40]
    text = " ".join(["the and thing that was with from"] * 6 + ["être les avec que dans une des"] * 6 + de)
    row = L.label(spark.createDataFrame([(text,)], "text string"), model, sure_out="sure").first()
    assert row.score < 0.6 and row.sure > 0.9
