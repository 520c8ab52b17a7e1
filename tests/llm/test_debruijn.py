import hashlib
import random

import numpy as np
import pytest

from lexframe.llm import debruijn as D
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def brute(rows, k):
    """Windows as word tuples; a window is repeated if a smaller id holds it."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - k + 1):
                key = tuple(w[p:p + k])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and least[tuple(w[p:p + k])] < i:
                gone[p:p + k] = [True] * k
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def check(df, **params):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = D.remove_repeats(df, **params)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows, params.get("window", 50))
    return got


def test_documents(docs):
    assert sum(r[2] for r in check(docs)) > 1000


def test_awkward(awkward, empty):
    check(awkward)
    check(awkward, window=5, anchor=2)
    assert D.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed):
    """Few distinct words, so many windows repeat within and across documents; ids repeat, some are null."""
    rnd = random.Random(seed)
    passage = [rnd.choice("abcd") for _ in range(60)]
    rows = []
    for i in range(60):
        w = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(50)
            w += passage[a:a + rnd.randrange(5, 30)] + [rnd.choice("abcdefgh") for _ in range(rnd.randrange(6))]
        rows.append((rnd.choice([i, i, i, 7, None]), rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[3], rows[10], (99, rows[4][1]), (7, "a b c d e f " * 20), (8, "x a b c d e f " * 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), window=6, anchor=3)


def test_spans_carry_source_coordinates(spark):
    body = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(body)), (9, " ".join(["x"] + body[20:90] + ["y"] + body[100:170])), (11, " ".join(body[:49]))]
    got = sorted(map(tuple, D.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(9, 1, 70, 5, 20), (9, 72, 70, 5, 100)]


def test_hashes_do_not_depend_on_place():
    texts = [b"", b" a bc  d\t", b"zz a bc d", b"a bc d"]
    hashes, sizes = D.word_hashes(texts)
    assert sizes.tolist() == [0, 3, 4, 3] and len(set(hashes.tolist())) == 4
    assert hashes[:3].tolist() == hashes[4:7].tolist() == hashes[7:].tolist()
    w = D.windows(hashes, 3)
    assert w[0] == w[4] == w[7] != w[3]
    h = np.random.default_rng(1).integers(0, 2**63, 300, np.uint64)
    assert D.anchors(h, 50, 16).tolist() == [min(D.windows(h[i:i + 50], 16)) for i in range(251)]
