"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes (A-Z lower-cased) and an end symbol; each byte is eight binary decisions. For every
binary decision and every context of 0..``DEPTH`` preceding bytes the tree holds the counts of both
outcomes in the training texts, their Krichevsky-Trofimov block probability, and the weighted
probability that mixes "stop at this depth" with "go deeper" half and half. A byte's probability mixes
the estimates of all depths on its path by the weights that the training texts earned; a path ends
where its context was never seen. The score of a text is the sum over its bytes and its end.

1. Each chunk of texts is reduced to its distinct (context, byte) keys with their training counts, and
   its distinct words with theirs, cut into pages by bucket. The last two context bytes choose the
   bucket, so a bucket holds whole subtrees; words go to buckets by hash.
2. Pages are shuffled by bucket and merged to one sorted table per bucket, in a stream: memory follows
   the distinct keys of a bucket, not its rows.
3. Weighted probabilities go up the tree: inside a bucket to depth 2, then one aggregate for the depths
   1 and 0, which have at most 257 x 255 nodes, whatever the data; these are broadcast.
4. Each bucket answers the pages' keys with log probabilities (words: with their counts), and the
   answers go back to the chunks, whose texts are scored.

A frequent key is one entry per chunk, so there are no hot keys. Words are told apart by a 64-bit hash.

Defined cases: a null text counts as empty (one end symbol); a null id trains; repeated rows count each
time; without training texts every bit has probability 1/2; extra columns are carried; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm.common import materialise, materialise_bucketed, pack, pack_table, partitions, releasing, text_slices, unpack
from lexframe.llm.debruijn import word_hashes

#: Bytes of the longest context; text bytes of a chunk, and of the part that is worked on at once.
DEPTH, CHUNK_BYTES, PART_BYTES = 5, 16 << 20, 1 << 20
#: Keys whose subtrees are weighted together.
TREE_KEYS = 1 << 15
#: The byte before a text's first and after its last (UTF-8 has none such).
EDGE = 255
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PAGES = "chunk long, bucket int, keys binary, docs binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def context_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context bytes and the byte itself, newest last) of every symbol of the texts, ends
    included, and each text's number of symbols."""
    pad = bytes([EDGE]) * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, pad[:1] or bytes([EDGE]))), np.uint8)
    keys = np.zeros(len(data) - depth, np.uint64) if len(data) > depth else np.zeros(0, np.uint64)
    for j in range(depth + 1):
        keys = (keys << np.uint64(8)) | data[j:len(keys) + j]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    # A text's symbols start at its own offset; between them lie the next text's pads.
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    stop = np.cumsum(sizes)
    return keys[np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)], sizes


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and of its end (key 0), and their numbers."""
    hashes, sizes = word_hashes(texts)
    keys = np.zeros(len(hashes) + len(texts), np.uint64)
    keys[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), sizes)] = hashes
    return keys, sizes + 1


class Tally:
    """Distinct keys with counts, merged from parts."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append((keys, counts))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > 2 * max(len(k) for k, _ in self.parts) + (1 << 16):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(keys) else counts)]
        self.size = len(first)
        return self.parts[0]


def _count(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, distinct = pd.factorize(keys)
    return distinct, np.bincount(code[training], minlength=len(distinct)).astype(np.int64)


def _parts(texts: list[bytes]):
    """(first, end) of consecutive texts of about ``PART_BYTES``."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > PART_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _bucket(keys: np.ndarray, n: int, words: bool) -> np.ndarray:
    """Context buckets 0..n-1 by the two newest context bytes; word buckets n..2n-1."""
    if words:
        return (n + (_mix(keys) % np.uint64(n))).astype(np.int64)
    return (_mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n)).astype(np.int64)


def _texts(table: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes().translate(_LOWER) if x.is_valid else b"" for x in table["text"]]


def _chunk_pages(n: int, depth: int, chunk_bytes: int):
    """Chunk rows: the texts (bucket -1), and a page of sorted keys with training counts per bucket."""
    def run(batches):
        part_no = TaskContext.get().partitionId()
        for k, table in enumerate(text_slices(batches, "text", chunk_bytes)):
            texts, training = _texts(table), table["train"].to_numpy()
            grams, words = Tally(), Tally()
            for lo, hi in _parts(texts):
                for make, tally in ((lambda t: context_keys(t, depth), grams), (word_keys, words)):
                    keys, sizes = make(texts[lo:hi])
                    tally.add(*_count(keys, np.repeat(training[lo:hi], sizes)))
            chunk = (part_no << 32) | k
            rows = [(chunk, -1, None, pack_table(table.select(["row"]).append_column("text", pa.array(texts, pa.binary()))))]
            for tally, is_words in ((grams, False), (words, True)):
                keys, counts = tally.merge()
                bucket = _bucket(keys, n, is_words)
                order = np.argsort(bucket, kind="stable")  # keys stay sorted inside a bucket
                edges = np.searchsorted(bucket[order], np.arange(n * is_words, n * is_words + n + 1))
                for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    if hi > lo:
                        own = order[lo:hi]
                        rows.append((chunk, b + n * is_words, _pack_keys(keys[own], counts[own]), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["chunk", "bucket", "keys", "docs"])
    return run


def _pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes, which pack well, and their counts."""
    step = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return pack(**{f"k{i}": np.ascontiguousarray(step[:, i]) for i in range(8)}, n=counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64))


def _unpack_keys(data) -> tuple[np.ndarray, np.ndarray]:
    t = unpack(data)
    step = np.stack([t[f"k{i}"].to_numpy() for i in range(8)], axis=1).view(np.uint64).reshape(-1)
    return np.cumsum(step, dtype=np.uint64), t["n"].to_numpy().astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2 (Stirling's series six places higher)."""
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a block with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def _group(ids: np.ndarray):
    """Sorted distinct ids, and for each given id its place among them."""
    return np.unique(ids, return_inverse=True)


class Subtrees:
    """All nodes of depth ``top``..``depth`` over sorted keys: arrays per depth, weighted bottom-up."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        symbol, context = (keys & np.uint64(255)).astype(np.int64), keys >> np.uint64(8)
        level = np.arange(8)
        prefix = (1 << level) | (symbol[:, None] >> (8 - level))          # node inside the byte's tree, 1..255
        self.bit = (symbol[:, None] >> (7 - level)) & 1
        ids = (context[:, None] << np.uint64(8)) | prefix.astype(np.uint64)
        self.place, self.zeros, self.ones, self.block, self.weighted = {}, {}, {}, {}, {}
        ids, at = _group(ids.ravel())
        many = np.repeat(counts, 8)
        ones = np.bincount(at, many * self.bit.ravel(), len(ids)).astype(np.int64)
        zeros = np.bincount(at, many * (1 - self.bit.ravel()), len(ids)).astype(np.int64)
        below = None
        for d in range(depth, top - 1, -1):
            if d < depth:  # drop the oldest context byte
                ids, up = _group(ids & np.uint64((1 << (8 * (d + 1))) - 1))
                zeros, ones = (np.bincount(up, x, len(ids)).astype(np.int64) for x in (zeros, ones))
                at, below = up[at], np.bincount(up, self.weighted[d + 1], len(ids))
            self.ids = ids
            self.place[d], self.zeros[d], self.ones[d] = at.reshape(-1, 8), zeros, ones
            self.block[d] = block_log(zeros, ones)
            self.weighted[d] = self.block[d] if below is None else np.logaddexp(self.block[d], below) - np.log(2)

    def log_probabilities(self, above) -> np.ndarray:
        """Natural log probability of each key's byte. ``above``: for each key and bit, from the depth
        over the top up to the root, (probability here, weight of stopping here, whether it was seen)."""
        p, seen = None, None
        for d in range(self.depth, self.top - 1, -1):
            at = self.place[d]
            z, o = self.zeros[d][at], self.ones[d][at]
            here = (np.where(self.bit, o, z) + 0.5) / (z + o + 1)
            if p is None:
                p = here
            else:
                stop = np.exp(self.block[d] - np.log(2) - self.weighted[d])[at]
                p = np.where(seen, stop * here + (1 - stop) * p, here)
            seen = (z + o) > 0
        for here, stop, was in above:
            p = here if p is None else np.where(seen, stop * here + (1 - stop) * p, here)
            seen = was
        return np.log(p).sum(axis=1)


def _merge_buckets(n: int, depth: int):
    """Pages, sorted by bucket, to one row per bucket: its merged table; for context buckets also the
    sums that the depths above need, for words the number of training words and distinct ones."""
    def finish(bucket, tally):
        keys, counts = tally.merge()
        up = None
        if bucket < n:
            seen = counts > 0
            sums = np.zeros((3, 1 << 16))
            for _, t in _subtrees(keys[seen], counts[seen], depth):
                at = (t.ids & np.uint64(0xFFFF)).astype(np.int64)  # newest context byte and node
                for total, values in zip(sums, (t.zeros[2], t.ones[2], t.weighted[2])):
                    np.add.at(total, at, values)
            ids = np.flatnonzero(sums[0] + sums[1])
            if len(ids):
                up = pack(id=ids, zeros=sums[0][ids], ones=sums[1][ids], below=sums[2][ids])
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([_pack_keys(keys, counts)], pa.binary()), pa.array([up], pa.binary()),
             pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64())],
            names=["bucket", "keys", "up", "tokens", "distinct"])

    def run(batches):
        now, tally = None, Tally()
        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys")):
                if bucket != now:
                    if now is not None:
                        yield finish(now, tally)
                    now, tally = bucket, Tally()
                tally.add(*_unpack_keys(keys.as_buffer()))
        if now is not None:
            yield finish(now, tally)
    return run


def _subtrees(keys: np.ndarray, counts: np.ndarray, depth: int):
    """(places of its keys, tree) for groups of whole subtrees of depth 2, of about ``TREE_KEYS`` keys."""
    newest = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    order = np.argsort(newest, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(newest[order], prepend=np.uint64(1 << 16))), len(keys))
    lo = 0
    while lo < len(keys):
        hi = int(edges[max(np.searchsorted(edges, lo + TREE_KEYS, side="right") - 1, np.searchsorted(edges, lo, side="right"))])
        at = order[lo:hi]
        yield at, Subtrees(keys[at], counts[at], depth, 2)
        lo = hi


class Top:
    """Depths 1 and 0 of the tree, as arrays over (newest context byte, node)."""

    def __init__(self, ids, zeros, ones, below):
        self.zeros, self.ones, under = (np.zeros((256, 256)) for _ in range(3))
        spot = ids >> 8, ids & 255
        for table, values in ((self.zeros, zeros), (self.ones, ones), (under, below)):
            np.add.at(table, spot, values)
        block = block_log(self.zeros, self.ones)
        weighted = np.logaddexp(block, under) - np.log(2)
        self.stop = np.exp(block - np.log(2) - weighted)
        self.root_zeros, self.root_ones = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        block = block_log(self.root_zeros, self.root_ones)
        self.root_stop = np.exp(block - np.log(2) - (np.logaddexp(block, weighted.sum(axis=0)) - np.log(2)))

    def above(self, keys: np.ndarray, bit: np.ndarray):
        symbol, newest = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        node = (1 << np.arange(8)) | (symbol[:, None] >> (8 - np.arange(8)))
        z, o = self.zeros[newest[:, None], node], self.ones[newest[:, None], node]
        yield (np.where(bit, o, z) + 0.5) / (z + o + 1), self.stop[newest[:, None], node], (z + o) > 0
        z, o = self.root_zeros[node], self.root_ones[node]
        yield (np.where(bit, o, z) + 0.5) / (z + o + 1), self.root_stop[node], (z + o) > 0


def _answer(n: int, depth: int, top):
    """Rows sorted by bucket, a bucket's table first: each page's keys with their answers, in order."""
    def run(batches):
        above, known, values = Top(*top.value).above, None, None
        for batch in batches:
            for chunk, bucket, keys in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("keys")):
                keys, counts = _unpack_keys(keys.as_buffer())
                if chunk is None:
                    known, values = keys, counts
                    if bucket < n:
                        values = np.zeros(len(keys), np.float32)
                        for at, t in _subtrees(keys, counts, depth):
                            values[at] = t.log_probabilities(above(keys[at], t.bit))
                    continue
                found = values[np.searchsorted(known, keys)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([pack(v=found)], pa.binary())],
                    names=["chunk", "bucket", "values"])
    return run


def _score(n: int, depth: int, totals: tuple[int, int], names: list[str]):
    """A row holds one chunk: its texts, and its answered pages."""
    tokens, distinct = totals

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = unpack(batch.column("docs")[i].as_buffer())
                texts = [x.as_buffer().to_pybytes() for x in table["text"]]
                answers = {p["bucket"].as_py(): unpack(p["values"].as_buffer())["v"].to_numpy() for p in batch.column("pages")[i].values}
                # Each part is coded once: its distinct keys, and each place's key among them.
                grams, words, coded = Tally(), Tally(), []
                for lo, hi in _parts(texts):
                    for make, tally in ((lambda t: context_keys(t, depth), grams), (word_keys, words)):
                        keys, sizes = make(texts[lo:hi])
                        code, distinct_keys = pd.factorize(keys)
                        tally.add(distinct_keys, np.zeros(len(distinct_keys), np.int64))
                        coded.append((code.astype(np.int32), distinct_keys, sizes))
                index = []
                for tally, is_words in ((grams, False), (words, True)):
                    keys = tally.merge()[0]
                    order = np.argsort(_bucket(keys, n, is_words), kind="stable")
                    value = np.empty(len(keys))
                    value[order] = np.concatenate([answers[b] for b in range(n * is_words, n * is_words + n) if b in answers]).astype(np.float64)
                    index.append((keys, value))
                answers = None

                def looked_up(which, part):
                    (keys, value), (code, own, sizes) = index[which], part
                    return value[np.searchsorted(keys, own)][code], sizes, np.cumsum(sizes) - sizes

                for k, (lo, hi) in enumerate(_parts(texts)):
                    p, _, starts = looked_up(0, coded[2 * k])
                    score = np.add.reduceat(p, starts) / np.log(10)
                    c, sizes, starts = looked_up(1, coded[2 * k + 1])
                    coded[2 * k] = coded[2 * k + 1] = None
                    base = np.add.reduceat(np.log10((c + 1) / (tokens + distinct + 1)), starts)
                    symbols = np.fromiter((len(t) + 1 for t in texts[lo:hi]), np.int64, hi - lo)
                    out = pa.table([table["row"].slice(lo, hi - lo), pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                                    pa.array(np.full(hi - lo, tokens, np.int64)), pa.array(base), pa.array(score),
                                    pa.array(-score * np.log2(10) / symbols)], names=names)
                    yield from out.combine_chunks().to_batches()
    return run


def score(docs: DataFrame, training: Column, text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns but the text, with n_tokens, n_known, train_tokens (words and ends), base_score (add-one
    unigrams), score (log10 of the text's probability) and bits_per_byte (code length). ``training``
    marks the rows that are learned from. ``depth``: 2..7."""
    spark, n = docs.sparkSession, partitions(docs)
    buckets = 2 * n
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    carry = [c for c in docs.columns if c not in (text_col, *new)]
    packed = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"), training.alias("train"))
    pages = materialise_bucketed(packed.mapInArrow(releasing(_chunk_pages(buckets, depth, chunk_bytes)), PAGES), "ctw-pages", "chunk", n)
    asked = pages.where("bucket >= 0").select("chunk", "bucket", "keys")
    merged = materialise(asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        releasing(_merge_buckets(buckets, depth)), "bucket int, keys binary, up binary, tokens long, distinct long"), "ctw-buckets")
    total = merged.where(F.col("bucket") >= buckets).agg(F.sum("tokens"), F.sum("distinct")).first()
    totals = (total[0] or 0, total[1] or 0)

    def rows_of(batches):
        for batch in batches:
            for sums in batch.column("up"):
                yield from unpack(sums.as_buffer()).to_batches()

    up = (merged.where("up IS NOT NULL").select("up").mapInArrow(rows_of, "id long, zeros double, ones double, below double")
          .groupBy("id").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect())  # at most 256 x 255 rows
    sums = [np.array(x) for x in zip(*up)] if up else [np.zeros(0, np.int64)] + [np.zeros(0)] * 3
    top = spark.sparkContext.broadcast(sums)
    questions = merged.select(F.lit(None).cast("long").alias("chunk"), "bucket", "keys").unionByName(asked)
    answers = (questions.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
               .mapInArrow(releasing(_answer(buckets, depth, top)), "chunk long, bucket int, values binary")
               .groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("bucket", "values")).alias("pages")))
    kinds = ("long", "long", "long", "double", "double", "double")
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(new, kinds))])
    out = (pages.where("bucket < 0").join(answers, F.col("chunk") == F.col("c")).select("docs", "pages")
           .mapInArrow(releasing(_score(buckets, depth, totals, ["row", *new])), schema))
    return out.select(*(F.col("row")[c].alias(c) for c in carry), *new)
