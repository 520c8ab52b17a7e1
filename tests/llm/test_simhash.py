import random
import re

import numpy as np
import xxhash

from lexframe.llm import simhash as S
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in ([" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=3):
    """Component (least id) of each row by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[:i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_grouped_equals_all_pairs(spark, docs, awkward):
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fps = [brute_fp(t) for _, t in rows]
        want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps)), key=str)
        got = S.grouped(df.select("doc_id", "text"))
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert S.grouped(awkward).columns == [*(c for c in awkward.columns if c != "text"), "fingerprint", "component_id"]


def noisy(n, centres, seed):
    rnd, out = random.Random(seed), set()
    base = [rnd.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        f = rnd.choice(base) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(6)):
            f ^= 1 << rnd.randrange(64)
        out.add(f)
    return sorted(out)


def test_tree_shards_and_blocks_lose_no_link(spark):
    for seed, centres in ((1, 300), (2, 1)):  # many small balls; one large ball of near copies
        fps = noisy(2500, centres, seed)
        signed = np.array(fps, np.uint64).view(np.int64)
        df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
        edges = S.links(df, shard=100, home_block=128, query_block=300)
        root = {r.node: r.root for r in S.components(edges).collect()}
        assert edges.count() < 60 * len(fps)
        want = brute_components([int(x) for x in signed], fps)
        assert [root.get(int(x), int(x)) for x in signed] == want


def test_tree_prunes():
    fps = np.array(noisy(20000, 20000, 3), np.uint64)
    tree = S.fit_tree(fps[:4000], 6)
    i, leaf, home = S.visits(fps, tree, 3)
    assert home.sum() == len(fps) and len(i) < 0.5 * len(fps) * len(np.unique(leaf[home]))


def test_one_document_of_each_group_stays(spark, docs, awkward, empty):
    for df in (docs, awkward):
        out = S.drop_near_duplicates(df)
        assert out.columns == df.columns
        groups = {r.component_id for r in S.grouped(df).collect()}
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(groups, key=str)
    assert S.drop_near_duplicates(empty).count() == 0 and S.grouped(empty).count() == 0
