"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. Runs of one symbol become one symbol; deterministic
coin tossing reduces each symbol, against its left neighbour, to a label of an alphabet of six;
phrases start where labels have a local minimum, and a phrase's name is a hash of its symbols,
which are the next level's text. A phrase boundary depends on a few neighbours only, so equal
substrings get equal phrase names inside, wherever they stand. A fingerprint has two parts, from level
``FIRST_LEVEL`` up (phrases of about 10, 30, 90, ... characters): the ``SKETCH`` least hashes of all phrase names,
a sample that is exact for short texts; and for texts with more names than that, every name of the highest levels, those
with at most ``TOP`` phrases. The last of these names the whole text, so any edit changes the fingerprint.
Likeness is the share of common names (Dice) over the common sample and the highest levels; the sample
alone has a standard error of about 0.06 on long texts.

Fingerprinting is row by row, in numpy over slices of texts, without a shuffle. Comparing a document
with its successor needs the successor's text: rows are cut by id into ranges, each range sorted by
id in one task slice, and the first row of a range is also sent to the range before. The bounds (one number per
range) are one constant, searched by halves; the first id of each range is joined from a table of one row per range.

Defined cases: a null text counts as empty, with an empty fingerprint; two empty fingerprints are
alike (1.0), an empty and another are not (0.0); ids are numbers, null ones come first, and rows of one id follow one
another by text; a single row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm.common import materialise, partitions

FIRST_LEVEL, SKETCH, TOP, SLICE_CHARS = 2, 64, 16, 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of an equal name as one name that also tells its length."""
    start = first.copy()
    start[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(start)
    if len(at) == len(names):
        return names, first
    length = np.diff(at, append=len(names)).astype(np.uint64)
    return np.where(length > 1, _mix(names[at] + length * _A), names[at]), first[at]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing until the alphabet is 0..5. Neighbours differ before each round, so after it."""
    x = names
    for _ in range(4):
        differ = np.empty_like(x)
        differ[0] = 1
        np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
        differ[first] = 1
        lowest = differ & (~differ + differ.dtype.type(1))
        place = np.bitwise_count(lowest - lowest.dtype.type(1))
        bit = (x & lowest) != 0
        x = 2 * place + bit
        x = x.astype(np.uint8)
    return x


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names of concatenated texts (``first`` marks where a text begins)."""
    names, first = _runs(names, first)
    label = _labels(names, first)
    start = first.copy()
    if len(label) > 2:
        start[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]
    at = np.flatnonzero(start)
    inside = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    weighted = _mix(names + (inside.astype(np.uint64) + np.uint64(1)) * _A)
    return _mix(np.add.reduceat(weighted, at)), first[at]


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of texts: (sorted 32-bit hashes, at most ``SKETCH``; those of the highest levels)."""
    none = np.zeros(0, np.uint32)
    out = [(none, none)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    sizes = np.fromiter((len(texts[i]) for i in some), np.int64, len(some))
    names = _mix(np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), "<u4").astype(np.uint64) * _A)
    first = np.zeros(len(names), bool)
    first[np.cumsum(sizes) - sizes] = True
    keys, tops, level, number = [], [], 0, np.arange(len(some))
    while len(names):
        names, first = parse(names, first)
        level += 1
        own = np.cumsum(first) - 1
        if level >= FIRST_LEVEL:
            hashed = _mix(names + np.uint64(level)) >> np.uint64(32)
            keys.append((number[own].astype(np.uint64) << np.uint64(32)) | hashed)
            many = np.bincount(own)
            tops.append(keys[-1][many[own] <= TOP])
            more = many > 1  # texts of several phrases go on
            names, first, number = names[more[own]], first[more[own]], number[more]

    def by_text(parts):
        found = np.unique(np.concatenate(parts))
        doc, hashes = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return hashes, np.searchsorted(doc, np.arange(len(some) + 1))

    (hashes, at), (high, top_at) = by_text(keys), by_text(tops)
    for k, i in enumerate(some):
        long = at[k + 1] - at[k] > SKETCH
        out[i] = hashes[at[k]:min(at[k + 1], at[k] + SKETCH)], high[top_at[k]:top_at[k + 1]] if long else none
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Estimated share of common phrases (Dice) of two fingerprints: exact for short texts."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    x, y = set(a[0].tolist()), set(b[0].tolist())
    least = sorted(x | y)[:SKETCH]
    high, other = set(a[1].tolist()), set(b[1].tolist())
    jaccard = (sum(h in x and h in y for h in least) + len(high & other)) / (len(least) + len(high | other))
    return 2 * jaccard / (1 + jaccard)


def as_text(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Hexadecimal digits of the sample, then after a hyphen those of the highest levels, if there are any."""
    return "-".join(x.astype(">u4").tobytes().hex() for x in fingerprint if len(x) or x is fingerprint[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All columns, and the fingerprint of the text as hexadecimal digits."""
    keep = [c for c in docs.columns if c != out_col]

    def run(batches):
        for batch in batches:
            texts, found = [t.as_py() or "" for t in batch.column(text_col)], []
            for part in _slices(texts):
                found += map(as_text, fingerprints(part))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], names=[*keep, out_col])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out_col, T.StringType())])
    return docs.mapInArrow(run, schema)


def _slices(texts: list[str]):
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, text, range, next) sorted by (range, next, id) in each partition: a range's rows in id order,
    then (``next`` true) the row that follows its last one, the first row of all after the last."""
    n = partitions(docs)
    wanted = ranges or 4 * n
    cut = [i / wanted for i in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx(id_col, cut, 100 * wanted).alias("b")).first()["b"] if cut else []
    bounds = sorted(set(bounds or []))
    place = F.coalesce(_bounds_upto(F.col("id"), bounds, docs.schema[id_col].dataType.simpleString()), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("range", place)
    # One row per range, small enough to be broadcast: its first id and the range before it (before the first: the last).
    least = rows.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("f"))
    least = materialise(least.select(F.col("range").alias("r"), F.col("f.id").alias("lead")), "lcp-ranges")
    before = F.lag("r").over(Window.orderBy("r"))
    least = least.select("r", "lead", F.coalesce(before, F.max("r").over(Window.partitionBy(F.lit(0)))).alias("ahead"))
    joined = rows.join(F.broadcast(least), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("lead")), "left")
    spots = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("next")))
    spots = F.when(F.col("r").isNotNull(), F.concat(spots, F.array(F.struct(F.col("ahead").alias("range"), F.lit(True).alias("next"))))).otherwise(spots)
    return (joined.withColumn("spot", F.explode(spots)).select("id", "text", "spot.range", "spot.next")
            .repartition(n, "range").sortWithinPartitions("range", "next", F.col("id").asc_nulls_first(), "text"))


def _bounds_upto(value: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (null for null): a search by halves in one constant."""
    limits = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def halve(low, step):
        return F.when(F.get(limits, low + step - 1) <= value, low + step).otherwise(low)
    return F.when(value.isNotNull(), F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve) if steps else F.lit(0))


def edit(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of another text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def pairs(batches):
        """(id, text, next text); a pending row waits for its successor."""
        place, pending, open_ = None, None, False
        for batch in batches:
            for i, text, r, is_next in zip(*(c.to_pylist() for c in batch.columns)):
                if r != place:
                    place, pending, open_ = r, None, False
                if is_next:
                    if pending and not open_:
                        yield (*pending, text)
                    open_ = True  # ties of the first row follow; only the first counts
                    continue
                if pending:
                    yield (*pending, text)
                pending = (i, text)

    def finish(part):
        ids, texts, after = zip(*part)
        edited = [edit(a, b) for a, b in zip(texts, after)]
        found = fingerprints(list(dict.fromkeys([*texts, *edited, *after])))
        sketch = dict(zip(dict.fromkeys([*texts, *edited, *after]), found))
        own, other, follow = ([sketch[t] for t in ts] for ts in (texts, edited, after))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(map(as_text, own), pa.string()), pa.array(map(as_text, other), pa.string()),
            pa.array(map(likeness, own, other), pa.float64()), pa.array(map(likeness, own, follow), pa.float64())],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        part, size = [], 0
        for row in pairs(batches):
            part.append(row)
            size += len(row[1])
            if size > SLICE_CHARS:
                yield finish(part)
                part, size = [], 0
        if part:
            yield finish(part)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, ranges).mapInArrow(run, schema).withColumnRenamed("id", id_col)
