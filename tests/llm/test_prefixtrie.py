import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lexframe.llm import prefixtrie as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, words long"


def plain(rows):
    """Every node of the trie, by a table of all prefixes."""
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}:{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + v[h:])
    return trie_of(paths)


@functools.cache
def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def trie_of(paths):
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (words(q[-1][1]) if q else 0)
            stack += children[q]
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if paths[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def results(turns, **kw):
    out = T.trie(T.rebuilt(T.turn_lists(turns)), **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Few distinct turns, so prefixes are shared at all depths; nulls, ties, repeated rows, absent bases, long conversations."""
    rnd = random.Random(2)
    out = []
    for c in list(range(0, 70)) + [-3, 1000, 1019, 2003]:
        for t in range(rnd.choice([1, 2, 3, 5, 9, 21, 40])):
            x = rnd.choice(["a b", "a  c\n", "", None]) if rnd.random() < 0.15 else f"turn {t}"
            out.append((c, None if rnd.random() < 0.03 else t, rnd.choice(["user", "user", "user", None]) if rnd.random() < 0.2 else "user", x, "p", 5))
    return out + [out[0], out[0], out[-1], (None, 1, "user", "x", "", 1), (None, None, None, None, None, None)]


@pytest.mark.parametrize("shallow", [0, 2, 8, 100])
def test_against_all_prefixes(spark, rows, shallow):
    """Whatever part is peeled in bands, and whatever by aggregates."""
    assert results(spark.createDataFrame(rows, SCHEMA), shallow=shallow) == plain(rows)


def test_hot_parents(spark, rows, monkeypatch):
    turns = spark.createDataFrame(rows, SCHEMA)
    for hot, most in [(0, 10 ** 6), (1, 10 ** 6), (0, 1)]:
        monkeypatch.setattr(T, "HOT", hot)
        monkeypatch.setattr(T, "MAX_HOT", most)
        assert results(turns) == plain(rows)


def test_copies_and_turnless(spark):
    """Many copies of one conversation, one row each before the peeling; conversations without a turn."""
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(2)]
    got = results(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == plain(rows)
    alone = [(c, 0, "user", "x") for c in range(41, 60)]  # their base is absent: those with h > 0 have no turn left
    assert results(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")) == plain(alone)


def test_long_conversation_and_texts(spark):
    rows = [(c, t, "user", "w " * (100000 if t == 5 else 1) + str(t if c < 2 or t < 200 else c)) for c in range(3) for t in range(300)]
    assert results(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain(rows)


def test_empty_table(spark):
    assert results(spark.createDataFrame([], SCHEMA)) == []
