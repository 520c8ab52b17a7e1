"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming distance by vantage-point trees.

1. Each text gets a fingerprint: the majority bits of the XXH64 hashes of its word shingles.
2. Distinct fingerprints are searched once each, whatever the number of their copies. A
   vantage-point tree, fitted on a bounded sample, cuts the space into shards: a node sends
   fingerprints within its radius of the vantage point to one child and the rest to the other. A
   fingerprint lives in one shard and, as a query, also visits every shard that the triangle bound
   cannot exclude (only those numbered after its own: each pair meets once). The tree decides cost only, never which
   pairs are found: any two fingerprints within the distance meet in the shard of one of them.
3. A shard is compared in blocks of bounded size, so a shard full of near copies is spread over
   tasks. A block reports a spanning forest of its links (at most one row per fingerprint), not
   its pairs.
4. Links become connected components by alternating large-star / small-star rounds (joins and
   partial aggregates, each round cut with a reliable checkpoint); component ids join back.

Defined cases: a null text counts as empty; no words give fingerprint zero, linked like any other;
a null id takes part but never names a component that has another id; repeated rows share a
component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lexframe.llm.common import materialise, partitions
from lexframe.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Aim for the size of a shard, the deepest tree, sample points per shard (and in all).
SHARD, MAX_DEPTH, PER_SHARD, MAX_SAMPLE = 4096, 14, 32, 1 << 16
#: Rows of one comparison block: fingerprints that live there, and queries.
HOME_BLOCK, QUERY_BLOCK = 1 << 13, 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    import xxhash

    # bytes.split() cuts at the six ASCII spaces, which are the separators wanted.
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        block = h[lo:lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out_col: str = "fp") -> DataFrame:
    """All columns but the text, and ``out_col``: the fingerprint's bits as a signed long."""
    keep = [c for c in docs.columns if c not in (text_col, out_col)]

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps)], names=[*keep, out_col])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out_col, T.LongType())])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii in heap order; radius -1 marks a leaf. Of a few candidates the
    point whose distances spread widest is taken, and the median distance is the radius."""
    n = (1 << (depth + 1)) - 1
    vantage, radius = np.zeros(n, np.uint64), np.full(n, -1, np.int16)
    todo = [(0, np.unique(sample))]
    while todo:
        node, own = todo.pop()
        if 2 * node + 2 >= n or len(own) < 8:
            continue
        tries = own[np.linspace(0, len(own) - 1, 8).astype(int)]
        d = np.bitwise_count(own[None, :] ^ tries[:, None]).astype(np.int16)
        best = int(np.argmax(d.std(axis=1)))
        r = int(np.median(d[best]))
        inside = d[best] <= r
        if inside.all():
            continue
        vantage[node], radius[node] = tries[best], r
        todo += [(2 * node + 1, own[inside]), (2 * node + 2, own[~inside])]
    return vantage, radius


def visits(fps: np.ndarray, tree, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, is home): the home leaf of each fingerprint and the leaves after it that
    may hold one within ``bits``."""
    vantage, radius = tree
    at, home = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    while True:  # down to the home leaves
        r = radius[at]
        go = r >= 0
        if not go.any():
            break
        d = np.bitwise_count(fps ^ vantage[at]).astype(np.int16)
        at = np.where(go, 2 * at + 1 + (d > r), at)
    home = at
    idx, node, out = np.arange(len(fps)), np.zeros(len(fps), np.int64), []
    while len(idx):
        r = radius[node]
        leaf = r < 0
        i, n = idx[leaf], node[leaf]
        keep = n >= home[i]
        out.append((i[keep], n[keep]))
        idx, node, r = idx[~leaf], node[~leaf], r[~leaf]
        d = np.bitwise_count(fps[idx] ^ vantage[node]).astype(np.int16)
        inner, outer = d - bits <= r, d + bits > r
        idx, node = np.concatenate([idx[inner], idx[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    i, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return i, n, n == home[i]


def forest(home: np.ndarray, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that connect all pairs of home x query within ``bits``.

    Both sides are ordered by distance from one point, so by the triangle bound a query meets only
    a range of the home rows."""
    if not len(home) or not len(query):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    point = home[0]
    dh, dq = np.bitwise_count(home ^ point), np.bitwise_count(query ^ point)
    home, dh = home[o := np.argsort(dh, kind="stable")], dh[o]
    query, dq = query[o := np.argsort(dq, kind="stable")], dq[o]
    root = np.arange(len(home))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    linked_q, linked_h = [], []
    for d in np.unique(dq):
        q_lo, q_hi = np.searchsorted(dq, [d, d + 1])
        h_lo, h_hi = np.searchsorted(dh, [max(0, int(d) - bits), int(d) + bits + 1])
        if h_lo == h_hi:
            continue
        step = max(1, (1 << 20) // int(h_hi - h_lo))
        for lo in range(q_lo, q_hi, step):
            qs = query[lo:min(q_hi, lo + step)]
            qi, hi = np.nonzero(np.bitwise_count(qs[:, None] ^ home[None, h_lo:h_hi]) <= bits)
            if not len(qi):
                continue
            hi = hi + h_lo
            while (root[root] != root).any():
                root = root[root]
            first = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]]))
            lead = np.repeat(root[hi[first]], np.diff(np.concatenate([first, [len(qi)]])))
            other = root[hi]
            for a, b in np.unique(np.stack([lead, other], 1)[lead != other], axis=0):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            linked_q.append(qs[qi[first]])
            linked_h.append(hi[first])
    while (root[root] != root).any():
        root = root[root]
    a = np.concatenate([*linked_q, home])
    b = home[np.concatenate([*(root[h] for h in linked_h), root])]
    return a[a != b], b[a != b]


def links(distinct: DataFrame, bits: int = MAX_BITS, shard: int = SHARD, home_block: int = HOME_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (column fp, one row each) within
    ``bits`` of each other."""
    spark, n = distinct.sparkSession, distinct.count()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n / shard))))))
    sample = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(min(MAX_SAMPLE, PER_SHARD << depth))
    tree = fit_tree(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64), depth)

    def route(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 2000):
                i, leaf, home = visits(fps[lo:lo + 2000], tree, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(fps[lo:lo + 2000][i].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    routed = materialise(distinct.select("fp").mapInArrow(route, "leaf long, fp long, home boolean"), "simhash-visits")
    # At most one row per leaf, so at most 2 ** MAX_DEPTH rows.
    sizes = routed.groupBy(F.col("leaf").alias("_leaf")).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / home_block).cast("int").alias("h"),
        F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("q")).where("h > 0")
    rows = routed.join(F.broadcast(sizes), F.col("leaf") == F.col("_leaf"))
    own = F.xxhash64("fp")
    homes = rows.where("home").select("leaf", F.pmod(own, F.col("h")).cast("int").alias("hb"),
                                      F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "fp", F.lit(True).alias("home"))
    asked = rows.select("leaf", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("hb"),
                        F.pmod(own, F.col("q")).cast("int").alias("qb"), "fp", F.lit(False).alias("home"))

    def compare(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        home = table["home"].to_numpy(zero_copy_only=False)
        a, b = forest(fp[home], fp[~home], bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return homes.union(asked).groupBy("leaf", "hb", "qb").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node of its component."""
    edge = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = cut_lineage(edges.where("a <> b").select(*edge(F.col("a"), F.col("b"))).distinct())
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a AND b <> m").select(*edge(F.col("b"), F.col("m"))).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(least, F.col("a") == F.col("u")).where("b <> m").select(*edge(F.col("b"), F.col("m")))
                 .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        now = cut_lineage(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """Every column but the text, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the
    least id that links reach."""
    keep = [c for c in docs.columns if c not in (text_col, "fingerprint", "component_id")]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = materialise(fingerprints(rows, "text", shingle), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("id").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, F.col("fp") == F.col("f")).select(*(F.col("row")[c].alias(c) for c in keep), digits, "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         bits: int = MAX_BITS) -> DataFrame:
    """The documents with one left of each component: the least id (null last; of rows with one id
    the one whose content hashes least)."""
    content = F.xxhash64(*docs.columns)
    key = docs.select(F.col(id_col).alias("id"), content.alias("h"), F.col(text_col).alias("text"))
    fps = materialise(fingerprints(key, "text", shingle), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h"))
    distinct = materialise(fps.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), bits))
    kept = (distinct.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), content.alias("h"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    # Rows equal in every column share a key; one of them stays.
    once = packed.join(kept, same, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0))))
    return once.where("n = 1").select("row.*")
