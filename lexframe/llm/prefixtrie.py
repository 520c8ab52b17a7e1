"""Prefix trie of conversations, by truncation peeling.

A conversation is a path: one 16-byte key a turn, each the digest of the key before it and the turn's
(role, text), so a key names a whole prefix. Rows hold such paths with their aggregates. From the
greatest depth down, the conversations that end at a depth join the nodes that survived from below,
rows with equal paths are one node, its figures are written, and it goes on without its last turn to be
regrouped one depth higher. A node's subtree sums are complete when it is written, so one descent
discovers and aggregates.

- Depths up to ``SHALLOW`` are peeled by one partial aggregate each: a prefix that a third of all conversations
  share is one row a map task.
- Deeper ones are peeled in bands (d, 2d], one job a band: rows are repartitioned by the prefix at depth d and
  sorted by path, so a task meets equal prefixes together and peels with one stack, as deep as
  the band. A conversation of n turns costs log2(n) jobs, not n.
- Conversations with the same turns are one row before the first band; their ids are hashed in a stream,
  sorted inside the partition, never collected.
- Each node looks up its parent's id: parents with many children are broadcast if they are few
  (``MAX_HOT``), the rest is an equi-join.

A path is held whole: 20 bytes a turn of one conversation. Turn digests and word counts are made next to
the scan; texts are never shuffled.

Defined cases: null role or text is empty; null turns come first; ties of turn go by the digest of (role,
text); repeated rows are turns of their own; a null conv_id is no conversation; other columns are
ignored; a table without conversations gives no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import materialise, n_words

#: Depths that are peeled by aggregates, one job each.
SHALLOW = 8
#: A parent is hot with more children than this; at most ``MAX_HOT`` hot parents are broadcast (24 bytes each).
HOT, MAX_HOT = 1000, 200_000
#: Turns that a rebuilt conversation may take from the first of its family.
HEAD = 3
KEY = 16
_EMPTY = hashlib.sha256(b"").hexdigest()

#: A row on its way up: a path, the words of its turns (4 bytes each), members, least member, children seen,
#: childless nodes and saved tokens below, digest of the ids that end here.
_ROW = "path binary, words binary, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends string"
_NODE = "key binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id and its turns in order, as structs of digest (16 bytes) and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary")))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long"), digest.alias("digest"), n_words(text).cast("int").alias("words")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 20, head: int = HEAD) -> DataFrame:
    """Each conversation c with its first h = crc32(c) % (head + 1) turns taken from c - c % family."""
    first = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, head).alias("heads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (head + 1)).cast("int")
    own = lists.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    taken = F.coalesce(F.slice("heads", F.lit(1), h), F.slice("turns", 1, 0))
    return own.select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))).alias("turns"))


def _paths(batches):
    for batch in batches:
        paths, words = [], []
        for turns in batch.column("turns").to_pylist():
            key, path = b"", []
            for t in turns:
                key = hashlib.blake2b(key + t["digest"], digest_size=KEY).digest()
                path.append(key)
            paths.append(b"".join(path))
            words.append(b"".join(t["words"].to_bytes(4, "big") for t in turns))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(words, pa.binary())],
                                         names=["conv_id", "path", "words"])


def _ended(batches):
    """Conversations sorted by path and id to one row per path, the ids hashed as they pass."""
    schema = pa.schema([("path", pa.binary()), ("words", pa.binary()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    now = sha = None
    for batch in batches:
        out = []
        for conv_id, path, words in zip(*(c.to_pylist() for c in batch.columns)):
            if now and now["path"] == path:
                now["n_convs"] += 1
                sha.update(f",{conv_id}".encode())
            else:
                if now:
                    out.append(now | {"ends": sha.hexdigest()})
                now, sha = {"path": path, "words": words, "n_convs": 1, "conv_id": conv_id}, hashlib.sha256(str(conv_id).encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([now | {"ends": sha.hexdigest()}], schema)


def _peel(low: int):
    """Rows deeper than ``low``, sorted by path, to nodes and to rows at depth ``low``. The open nodes are one chain of
    prefixes of the path last read; they are closed from the deepest up."""
    names = [c.split()[0] for c in _ROW.split(", ")]
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()),
                        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                        ("path", pa.binary()), ("words", pa.binary())])

    def add(node, n, conv, children, leaves, saved, ends):
        node[0], node[1] = node[0] + n, conv if node[1] is None else min(node[1], conv)
        node[2], node[3], node[4], node[5] = node[2] + children, node[3] + leaves, node[4] + saved, node[5] or ends

    def run(batches):
        path, words, chain, out = b"", b"", [], []

        def close():
            depth = low + len(chain)
            n, conv, children, leaves, saved, ends = chain.pop()
            leaves = leaves if children else 1
            saved += (n - 1) * int.from_bytes(words[4 * depth - 4:4 * depth], "big")
            out.append((path[KEY * (depth - 1):KEY * depth], path[KEY * (depth - 2):KEY * (depth - 1)] if depth > 1 else b"", depth, n, conv,
                        children, leaves, saved, ends or _EMPTY, None, None))
            if chain:
                add(chain[-1], n, conv, 1, leaves, saved, None)
            else:
                out.append((None, None, low, n, conv, 1, leaves, saved, None, path[:KEY * low], words[:4 * low]))

        def flush():
            columns = list(zip(*out)) if out else [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for new, new_words, *figures in zip(*(batch.column(c).to_pylist() for c in names)):
                while chain and path[KEY * (low + len(chain) - 1):KEY * (low + len(chain))] != new[KEY * (low + len(chain) - 1):KEY * (low + len(chain))]:
                    close()
                path, words = new, new_words
                chain += [[0, None, 0, 0, 0, None] for _ in range(len(path) // KEY - low - len(chain))]
                add(chain[-1], *figures)
                if len(out) >= 20000:
                    yield flush()
        while chain:
            close()
        yield flush()
    return run


def _regrouped(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows at one depth to its nodes, and these without their last turn."""
    last = F.conv(F.hex(F.substring("words", 4 * depth - 3, 4)), 16, 10).cast("long") if depth else F.lit(0)
    nodes = rows.groupBy("path", "words").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "saved_tokens")), F.sum("n_leaves").alias("below"),
        F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends")).withColumns({
            "n_leaves": F.when(F.col("n_children") > 0, F.col("below")).otherwise(1),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * last})
    nodes = materialise(nodes.drop("below"), f"trie-depth-{depth}")
    key = F.substring("path", KEY * (depth - 1) + 1, KEY) if depth else F.lit(b"")
    parent = F.substring("path", KEY * (depth - 2) + 1, KEY) if depth > 1 else F.lit(b"")
    written = nodes.select(key.alias("key"), parent.alias("parent"), F.lit(depth).cast("long").alias("depth"), "n_convs", "conv_id",
                           "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
    up = nodes.select(F.substring("path", 1, KEY * (depth - 1)).alias("path"), F.substring("words", 1, 4 * (depth - 1)).alias("words"),
                      "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                      F.lit(None).cast("string").alias("ends")) if depth else None
    return written, up


def nodes(paths: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """The trie over ``paths`` (conv_id, turns): a row per node, with the keys of the node and of its parent."""
    own = materialise(paths.mapInArrow(_paths, "conv_id long, path binary, words binary"), "trie-paths")
    ended = materialise(
        own.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(
            _ended, "path binary, words binary, n_convs long, conv_id long, ends string").withColumns(
                {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}), "trie-ended")
    ended = ended.select([c.split()[0] for c in _ROW.split(", ")])
    size = F.octet_length("path")
    deepest = (ended.agg(F.max(size)).first()[0] or 0) // KEY
    written, rows = [], None
    high = deepest
    while high > shallow:
        low = max(shallow, high // 2)
        band = ended.where((size > KEY * low) & (size <= KEY * high))
        band = band.unionByName(rows) if rows is not None else band
        out = materialise(band.repartition(F.substring("path", 1, KEY * low)).sortWithinPartitions("path").mapInArrow(
            _peel(low), _NODE + ", path binary, words binary"), f"trie-band-{low}")
        written.append(out.where("key IS NOT NULL").drop("path", "words"))
        rows = out.where("key IS NULL").select("path", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens",
                                               F.lit(None).cast("string").alias("ends"))
        high = low
    for depth in range(high, -1, -1):
        here = ended.where(size == KEY * depth)
        found, rows = _regrouped(here.unionByName(rows) if rows is not None else here, depth)
        written.append(found)
    out = written[0]
    for part in written[1:]:
        out = out.unionByName(part)
    return out


def trie(paths: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    table = materialise(nodes(paths, shallow), "trie-nodes")
    parents = table.where("n_children > 0").select(F.col("key").alias("k"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") > HOT).select(F.col("k").alias("hot"), F.col("parent_conv_id").alias("hot_conv_id"))
    child = table
    if 0 < hot.count() <= MAX_HOT:
        child = child.join(F.broadcast(hot), (F.col("parent") == F.col("hot")) & (F.col("depth") > 0), "left")
    else:
        child = child.withColumns({"hot": F.lit(None).cast("binary"), "hot_conv_id": F.lit(None).cast("long")})
    # A child whose parent is known, and the root, look up their own key, which spreads them; the answer is not used.
    known = F.col("hot").isNotNull() | (F.col("depth") == 0)
    child = child.withColumn("known", known).withColumn("ask", F.when(known, F.col("key")).otherwise(F.col("parent")))
    found = child.join(parents.drop("n_children"), F.col("ask") == F.col("k"), "left")
    return found.select("conv_id", "depth", F.when(F.col("known"), F.col("hot_conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
                        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
