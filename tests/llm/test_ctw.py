import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexframe.llm import ctw as C
from lexframe.llm.common import is_training
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def symbols(text, depth):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode()
    data = bytes([255]) * depth + low + bytes([255])
    return [(data[i:i + depth], data[i + depth]) for i in range(len(data) - depth)]


class SlowTree:
    """The context tree by its definition: block probabilities by products, weights by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for ctx, s in symbols(t, depth):
                for j in range(8):
                    for d in range(depth + 1):
                        self.n.setdefault((ctx[depth - d:], (1 << j) | (s >> (8 - j))), [0, 0])[s >> (7 - j) & 1] += 1
        self.children = {}
        for ctx, node in self.n:
            if ctx:
                self.children.setdefault((ctx[1:], node), set()).add(ctx)
        self.weighted = lru_cache(None)(self._weighted)

    def block(self, key):
        z, o = self.n[key]
        return sum(math.log(i + 0.5) for i in range(z)) + sum(math.log(i + 0.5) for i in range(o)) - sum(math.log(i + 1) for i in range(z + o))

    def _weighted(self, key):
        if len(key[0]) == self.depth:
            return self.block(key)
        return np.logaddexp(self.block(key), sum(self.weighted((c, key[1])) for c in self.children[key])) - math.log(2)

    def log10(self, text):
        total = 0.0
        for ctx, s in symbols(text, self.depth):
            for j in range(8):
                node, bit, p = (1 << j) | (s >> (8 - j)), s >> (7 - j) & 1, None
                for d in range(self.depth, -1, -1):
                    key = (ctx[self.depth - d:], node)
                    if key not in self.n:
                        p = 0.5 if d == 0 else None
                        continue
                    here = (self.n[key][bit] + 0.5) / (sum(self.n[key]) + 1)
                    stop = math.exp(self.block(key) - math.log(2) - self.weighted(key)) if d < self.depth else 1
                    p = here if p is None else stop * here + (1 - stop) * p
                total += math.log10(p)
        return total


def check(df, depth, training=None, **params):
    rows = df.select("doc_id", "text", (training if training is not None else is_training(F.col("doc_id"), 7, 2)).alias("t")).collect()
    tree = SlowTree([r.text for r in rows if r.t], depth)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]
    c = Counter(w for r in rows if r.t for w in tokens(r.text))
    n = sum(c.values())
    want = sorted(((str(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), tree.log10(r.text))
                   for r in rows for w in [tokens(r.text)]))
    got = C.score(df, training if training is not None else is_training(F.col("doc_id"), 7, 2), depth=depth, **params).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-5)


def test_equals_the_tree_by_definition(spark, docs, awkward):
    small = docs.where("n_chars < 900").limit(30).select("doc_id", F.substring("text", 1, 250).alias("text"))
    check(small, 3, chunk_bytes=2000)
    check(small, 2)
    check(awkward.where("length(text) < 2000 OR text IS NULL"), 4)
    check(small.limit(4), 3, F.lit(False))  # nothing is learned


def test_probabilities_sum_to_one():
    """Over all 256 next bytes, after seen and unseen contexts."""
    texts = [b"abracadabra", b"abba", b"cab"]
    keys, _ = C.context_keys(texts, 3)
    keys, counts = np.unique(keys, return_counts=True)
    for ctx in (b"abr", b"xab", b"xyz"):
        ask = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        both = np.unique(np.concatenate([keys, ask]))
        n = np.zeros(len(both), np.int64)
        n[np.searchsorted(both, keys)] = counts
        t = C.Subtrees(keys, counts, 3, 2)
        ids = (t.ids & np.uint64(0xFFFF)).astype(np.int64)
        top = C.Top(ids, t.zeros[2], t.ones[2], t.weighted[2])
        t = C.Subtrees(both, n, 3, 2)
        p = np.exp(t.log_probabilities(top.above(both, t.bit)))
        assert sum(p[np.searchsorted(both, ask)]) == pytest.approx(1)


def test_held_out_texts_gain_with_depth(spark):
    docs, train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), is_training(F.col("doc_id"), 7, 2)
    rows = {d: C.score(docs, train, depth=d).where(~train).select("score", "base_score", "bits_per_byte", "n_chars").collect() for d in (2, 5)}
    total = {d: sum(r.score for r in rows[d]) for d in rows}
    base = sum(r.base_score for r in rows[5])
    # On this small corpus whole words do about as well as bytes; on check_s bytes win.
    assert total[2] < total[5] and total[5] > 1.03 * base
    assert 1.5 < np.mean([r.bits_per_byte for r in rows[5] if r.n_chars > 500]) < 2.5


def test_columns_and_empty(awkward, empty):
    out = C.score(awkward, F.lit(True))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "chunk", "word", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    assert out.count() == awkward.count()
    assert C.score(empty, F.lit(True)).count() == 0
    assert np.allclose(C.log_gamma(np.array([0.5, 1.0, 3.5, 1e6])), [math.lgamma(x) for x in (0.5, 1.0, 3.5, 1e6)])
