import hashlib
import random

import numpy as np

from pyspark.sql import functions as W

from lexframe.llm import lcp as L
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def slow_parse(names):
    """One level of the parse of one text, symbol by symbol."""
    mix = lambda x: int(L._mix(np.array([x % 2**64], np.uint64))[0])
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    a = [x if n == 1 else mix(x + n * int(L._A)) for x, n in runs]
    lab = a
    for _ in range(4):
        new = []
        for i, x in enumerate(lab):
            k = 0 if i == 0 else ((x ^ lab[i - 1]) & -(x ^ lab[i - 1])).bit_length() - 1
            new.append(2 * k + (x >> k & 1))
        lab = new
    assert all(0 <= x < 6 for x in lab[1:])
    starts = [i for i in range(len(a)) if i == 0 or 0 < i < len(a) - 1 and lab[i] < lab[i - 1] and lab[i] < lab[i + 1]]
    return [mix(sum(mix(x + (j + 1) * int(L._A)) for j, x in enumerate(a[s:e]))) for s, e in zip(starts, [*starts[1:], len(a)])]


def slow_fingerprint(text):
    mix = lambda x: int(L._mix(np.array([x % 2**64], np.uint64))[0])
    names, out, high, level = [mix(ord(c) * int(L._A)) for c in text], set(), set(), 0
    while names:
        names = slow_parse(names)
        level += 1
        if level >= L.FIRST_LEVEL:
            found = {mix(x + level) >> 32 for x in names}
            out |= found
            high |= found if len(names) <= L.TOP else set()
            if len(names) == 1:
                break
    return sorted(out)[:L.SKETCH], sorted(high) if len(out) > L.SKETCH else []


TEXTS = ["", "a", "aa", "ab", "aaaaaaaaaaaab", "the cat sat on the mat " * 9, "".join(map(chr, range(200, 900))), "é日本\U0001F600" * 7]


def test_vectorised_parse_equals_symbol_by_symbol(docs):
    texts = TEXTS + [r.text[:1500] for r in docs.limit(25).collect()]
    assert [(x.tolist(), y.tolist()) for x, y in L.fingerprints(texts)] == [slow_fingerprint(t) for t in texts]


def test_equal_substrings_share_interior_names():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    body = " ".join(word() for _ in range(400))
    for shift in (0, 1, 7, 50):
        other = "x" * shift + " ".join(word() for _ in range(30)) + body
        a, b = ({h.item() for h in _names(t)} for t in (body, other))
        assert len(a & b) > 0.95 * len(a)  # only phrases at the edges of the substring differ


def _names(text):
    names = L._mix(np.array([ord(c) for c in text], np.uint64) * L._A)
    first = np.zeros(len(names), bool)
    first[0] = True
    names, first = L.parse(names, first)
    return L.parse(names, first)[0]


def test_edits_against_a_loop_over_sorted_documents(spark, docs, awkward):
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    for df, ranges in ((docs, 7), (docs, None), (awkward, 3), (awkward, 1), (awkward.limit(1), None)):
        rows = sorted(df.collect(), key=key)
        want = []
        for r, after in zip(rows, [*rows[1:], rows[0]]):
            text, following = r.text or "", after.text or ""
            half = len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            f, e, n = L.fingerprints([text, edited, following])
            want.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), L.as_text(f), L.as_text(e), L.likeness(f, e), L.likeness(f, n)))
        assert sorted(map(tuple, L.edits(df, ranges=ranges).collect()), key=str) == sorted(want, key=str)


def test_likeness_follows_the_kept_share(spark, docs):
    rows = [r for r in L.edits(docs).collect() if r.n_chars > 1000]
    assert 0.35 < np.mean([r.near_edited for r in rows]) < 0.65 and np.median([r.near_next for r in rows]) < 0.1
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_cases(spark, awkward, empty):
    a, b = (x for x in L.fingerprints(["", "abc def"]))
    assert L.likeness(a, a) == 1.0 and L.likeness(b, b) == 1.0 and L.likeness(a, b) == 0.0
    out = L.with_fingerprint(awkward)
    assert out.columns == [*awkward.columns, "fingerprint"]
    same = [r.fingerprint for r in out.collect() if r.text and r.text.startswith("the cat")]
    assert len(same) == 3 and len(set(same)) == 1
    assert L.edits(empty).count() == 0 and L.with_fingerprint(empty).count() == 0


def test_one_edited_word_shows(spark):
    """Also in a text of 10,000 words, far longer than the sample; and equal texts stay alike."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(10000)]
    texts = [" ".join(words)]
    for _ in range(20):
        at = rnd.randrange(len(words))
        texts.append(" ".join([*words[:at], "edited", *words[at + 1:]]))
    own, *edited = L.fingerprints(texts)
    assert L.likeness(own, own) == 1.0
    assert all(0.5 < L.likeness(own, x) < 1.0 and L.as_text(x) != L.as_text(own) for x in edited)


def test_bounds_by_halves(spark):
    for bounds in ([], [3], [1, 4, 4, 9, 12], list(range(0, 1000, 7))):
        rows = spark.range(-2, 1010).select("id", L._bounds_upto(W.col("id"), bounds, "bigint").alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in rows)


def test_planning_does_not_grow_with_the_ranges(docs):
    plan = L.with_next(docs, ranges=3000)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40000
