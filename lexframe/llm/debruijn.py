"""Substring de-duplication on a De Bruijn graph of word k-mers.

The edges of the graph are the ``WINDOW``-word k-mers of all documents (its nodes are the k-mers one
word shorter). An edge is repeated when a document with a smaller id holds it too. Runs of repeated
edges that follow one another in the document and in their source compact into one nonbranching
path, that is a span with source coordinates, and the words at both coordinates are compared
before anything is removed.

1. Every document is reduced to its anchors: the minimal hash of ``ANCHOR`` consecutive words inside
   each window. Equal windows have equal anchors, so a window can only be repeated if its anchor is.
   Anchors are about a twentieth of the windows. Whole texts with equal words are settled here: all but
   the smallest id are repeated throughout.
2. Anchors met in two documents are joined back; only windows with such an anchor become edges.
3. Edges are counted by a partial aggregate (edge -> least source), joined back to the documents,
   and compacted into spans.
4. Spans are verified: the words at the source coordinates must hash (128 bits) as those they repeat.

A common passage is one row per edge and map task in step 3; joining back, the planner splits a hot
edge's rows. Requests to verify a popular source are cut into batches. No step gathers the documents
that share a passage.

Defined cases: a null text has no words; a null id is neither a source nor repeated; documents with one
id do not repeat each other; texts shorter than a window are kept; repeated rows are judged alike;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexframe.llm.common import materialise
from lexframe.session import cut_lineage

WINDOW, ANCHOR = 50, 16
#: Text bytes that are hashed together, and verification requests of one source in a batch.
SLICE_BYTES, REQUESTS = 1 << 20, 1000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[begin:end], alike wherever the run stands."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * _power(_BASE, len(values)), dtype=np.uint64)])
    return _mix((total[end] - total[begin]) * _power(_INVERSE, len(values) + 1)[begin])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's number of words."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    hashes = _sums(data.astype(np.uint64) + np.uint64(1), begin, end)
    hashes = _mix(hashes + (end - begin).astype(np.uint64) * _BASE)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, stops), prepend=0)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return _sums(hashes, at, at + k)


def anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The least hash of ``anchor`` words inside the window from each place on."""
    least, width, size = windows(hashes, anchor), window - anchor + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:len(least) - (width - size)], least[width - size:]) if size < width else least


def _slices(texts):
    part, size = [], 0
    for i, t in enumerate(texts):
        if part and size + len(t) > SLICE_BYTES:
            yield part[0][0], [x for _, x in part]
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part[0][0], [x for _, x in part]


def _raw(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def profile(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, sha (of its words), and its distinct anchors."""
    def run(batches):
        for batch in batches:
            texts = _raw(batch.column("text"))
            counts, found = [], []
            for _, part in _slices(texts):
                hashes, sizes = word_hashes(part)
                stops = np.cumsum(sizes)
                for a, b in zip(stops - sizes, stops):
                    own = anchors(hashes[a:b], window, anchor) if b - a >= window else hashes[:0]
                    found.append(np.unique(own).view(np.int64))
                counts += sizes.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([_sha(t.split()) for t in texts], pa.string()),
                 pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, n_words long, sha string, anchors array<long>")


def _edges(window: int, anchor: int):
    """Candidate documents with their edges: the hashes of windows with a candidate anchor, each with
    its first place in the text."""
    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = _raw(batch.column("text"))
            rows = []
            for at, part in _slices(texts):
                hashes, sizes = word_hashes(part)
                stops = np.cumsum(sizes)
                for j, (a, b) in enumerate(zip(stops - sizes, stops)):
                    i = at + j
                    words = part[j].split()
                    sha = _sha(words)
                    if sha not in batch.column("shas")[i].as_py():
                        continue  # a whole copy with the id of a candidate; settled by its words
                    wanted = batch.column("wanted")[i].values.to_numpy().view(np.uint64)
                    own = hashes[a:b]
                    edges, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    if len(own) >= window:
                        place = np.flatnonzero(np.isin(anchors(own, window, anchor), wanted))
                        edges, first = np.unique(windows(own, window)[place], return_index=True)
                        first = place[first]
                    rows.append((uid, batch.column("doc_id")[i].as_py(), part[j].decode(), len(words), sha,
                                 edges.view(np.int64), first.astype(np.int32)))
                    uid += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["uid", "doc_id", "text", "n_words", "sha", "edges", "places"])
    return run


_EDGES = "uid long, doc_id long, text string, n_words long, sha string, edges array<long>, places array<int>"


def _digest_requests(batches):
    """Hash of the words at each requested (start, length) of a text."""
    for batch in batches:
        out = []
        for uid, text, asked in zip(*(batch.column(c) for c in ("uid", "text", "asked"))):
            words = text.as_py().encode().split()
            out += [(uid.as_py(), a["start"], a["n"], _digest(words, a["start"], a["n"])) for a in asked.as_py()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))] if out else
            [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())], names=["src", "src_start", "n", "digest"])


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:start + n]), digest_size=16).digest()


class Graph:
    """Written tables of one run: ``profile`` (all rows, with ``copy``), ``texts`` (candidate documents)
    and ``spans`` (uid, start, n, src, src_start, digest: words start..start+n repeat the source's)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int):
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        table = materialise(profile(docs, window, anchor), "substring-profile")
        least = table.groupBy(F.col("sha").alias("s")).agg(F.min("doc_id").alias("least"))
        copies = least.join(table.where(F.col("n_words") >= window).groupBy("sha").agg(F.max("doc_id").alias("last")),
                            F.col("s") == F.col("sha")).where("least < last").select("s", "least")
        copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
        table = table.join(copies, F.col("sha") == F.col("s"), "left").select("doc_id", "n_words", "sha", "anchors", copy.alias("copy"))
        flat = table.where("NOT copy AND doc_id IS NOT NULL").select("doc_id", "sha", F.explode("anchors").alias("anchor"))
        repeated = (flat.groupBy(F.col("anchor").alias("a")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .where("lo < hi").select("a"))
        wanted = materialise(flat.join(repeated, F.col("anchor") == F.col("a")).groupBy(F.col("doc_id").alias("d")).agg(
            F.collect_set("anchor").alias("wanted"), F.collect_set("sha").alias("shas")), "substring-anchors")
        self.texts = materialise(docs.join(wanted, F.col("doc_id") == F.col("d")).select("doc_id", "text", "wanted", "shas")
                                 .mapInArrow(_edges(window, anchor), _EDGES), "substring-edges")
        settled = wanted.select(F.col("d"), F.explode("shas").alias("s"))
        self.profile = table.drop("anchors").join(settled, (F.col("doc_id") == F.col("d")) & (F.col("sha") == F.col("s")), "left_anti")
        self.spans = self._verified(cut_lineage(self._paths(window)))

    def _paths(self, window: int) -> DataFrame:
        """Repeated edges, compacted: maximal runs of places that advance with their source's places."""
        edge = self.texts.select("uid", "doc_id", F.explode(F.arrays_zip("edges", "places")).alias("e")).select(
            "uid", "doc_id", F.col("e.edges").alias("edge"), F.col("e.places").alias("place"))
        source = edge.groupBy(F.col("edge").alias("h")).agg(
            F.min(F.struct("doc_id", "uid", "place")).alias("src"), F.max("doc_id").alias("last")).where("src.doc_id < last")
        back = edge.join(source, F.col("edge") == F.col("h")).where("src.doc_id < doc_id").select(
            "uid", "place", F.col("src.uid").alias("src"), F.col("src.place").alias("src_place"))
        shift = (F.col("src_place") - F.col("place")).alias("shift")
        run = F.col("place") - F.row_number().over(Window.partitionBy("uid", "src", "shift").orderBy("place"))
        return (back.withColumn("shift", shift).withColumn("run", run).groupBy("uid", "src", "shift", "run")
                .agg(F.min("place").alias("start"), F.min("src_place").alias("src_start"),
                     (F.count(F.lit(1)) + window - 1).cast("int").alias("n")).select("uid", "start", "n", "src", "src_start"))

    def _verified(self, paths: DataFrame) -> DataFrame:
        """Adds the digest of the source's words; the repeating document compares it with its own."""
        asked = paths.select("src", "src_start", "n").distinct()
        many = asked.groupBy(F.col("src").alias("s")).agg(F.ceil(F.count(F.lit(1)) / REQUESTS).alias("parts"))
        asked = asked.join(many, F.col("src") == F.col("s")).withColumn("part", F.pmod(F.xxhash64("src_start", "n"), "parts"))
        asked = asked.groupBy("src", "part").agg(F.collect_list(F.struct(F.col("src_start").alias("start"), "n")).alias("asked"))
        digests = (self.texts.select("uid", "text").join(asked, F.col("uid") == F.col("src")).select("uid", "text", "asked")
                   .mapInArrow(_digest_requests, "src long, src_start int, n int, digest binary"))
        return paths.join(digests, ["src", "src_start", "n"])


def _removal(window: int):
    """Kept words of candidate documents: windows of verified spans, at every place that repeats one of
    them inside the document, are covered."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                raw = text.as_py().encode()
                words, spans = raw.split(), spans.as_py() or []
                starts = {p for s in spans if _digest(words, s["start"], s["n"]) == s["digest"]
                          for p in range(s["start"], s["start"] + s["n"] - window + 1)}
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    own = windows(word_hashes([raw])[0], window)
                    at = np.flatnonzero(np.isin(own, own[sorted(starts)]))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                kept = [w for w, c in zip(words, covered) if not c]
                rows.append((doc.as_py(), len(words), len(words) - len(kept), _sha(kept)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The compacted paths outside whole copies: (doc_id, start, n, source_id, source_start), in words.
    Places inside one document that repeat a path of the document itself are not listed again."""
    g = Graph(docs, id_col, text_col, window, anchor)
    ids = g.texts.select(F.col("uid").alias("u"), "doc_id")
    src = ids.select(F.col("u").alias("v"), F.col("doc_id").alias("source_id"))
    return (g.spans.join(ids, F.col("uid") == F.col("u")).join(src, F.col("src") == F.col("v"))
            .select("doc_id", "start", "n", "source_id", F.col("src_start").alias("source_start")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    g = Graph(docs, id_col, text_col, window, anchor)
    nothing = hashlib.sha256(b"").hexdigest()
    plain = g.profile.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
                             F.when(F.col("copy"), F.lit(nothing)).otherwise(F.col("sha")).alias("kept_sha256"))
    spans = g.spans.groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    cut = (g.texts.select("uid", "doc_id", "text").join(spans, F.col("uid") == F.col("u"), "left").select("doc_id", "text", "spans")
           .mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
    return plain.unionByName(cut).withColumnRenamed("doc_id", id_col)
