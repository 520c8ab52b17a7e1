"""The recursive splitter against a plain recursive one."""

import random

import pytest
from pyspark.sql import functions as F

from lexframe.functions.splitting import recursive_chunks
from lexframe.operators import retrieval as R
from lexframe.plans import bindings as B

RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]


def _pieces(text: str, sep: str) -> list:
    """Split keeping each separator at the start of the piece that follows it."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    return [p for p in [parts[0]] + [sep + x for x in parts[1:]] if p != ""]


def _merge_pieces(pieces: list, size: int, overlap: int) -> list:
    """Greedily pack consecutive pieces up to ``size``; the next chunk restarts from
    the trailing pieces that fit in ``overlap``."""
    out, cur, total = [], [], 0
    for p in pieces:
        if total + len(p) > size and cur:
            doc = "".join(cur).strip()
            if doc:
                out.append(doc)
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(cur[0])
                cur = cur[1:]
        cur.append(p)
        total += len(p)
    doc = "".join(cur).strip()
    if doc:
        out.append(doc)
    return out


def recursive_split(text: str, size: int = 2000, overlap: int = 200,
                    separators=RECURSIVE_SEPARATORS) -> list:
    """Chunks of at most ``size`` characters: split at the coarsest separator present,
    pack the pieces, and split any piece that is still too long at the next one."""
    sep, finer = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, finer = s, ([] if s == "" else separators[i + 1:])
            break
    chunks, short = [], []
    for piece in _pieces(text, sep):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            chunks.extend(_merge_pieces(short, size, overlap))
            short = []
        chunks.extend(recursive_split(piece, size, overlap, finer) if finer else [piece])
    if short:
        chunks.extend(_merge_pieces(short, size, overlap))
    return chunks


def plain(text, size, overlap):
    out, index, prev = [], 0, 0
    for chunk in recursive_split(text, size, overlap) if text else []:
        index = text.find(chunk, max(0, index + prev - overlap))
        prev = len(chunk)
        out.append((index, chunk))
    return out


@pytest.mark.parametrize("size,overlap", [(7, 2), (20, 0), (30, 12)])
def test_against_the_plain_splitter(spark, size, overlap):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice(["a", "bc", "d\u00e9", " ", " ", "\n", "\n\n", "\t", "\u00a0", "x" * rnd.randrange(1, 40), "\U0001F600"]) for _ in range(rnd.randrange(60)))
             for _ in range(400)] + ["", " ", "\n\n\n", "x" * 100, " " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", recursive_chunks(F.col("t"), size, overlap).alias("c")).collect():
        assert [(c.start, c.text) for c in r.c] == plain(r.t, size, overlap), repr(r.t)


def test_documents(spark):
    docs = B.table(spark, "/root/testdata/sf0.001", "documents")
    rows = R.chunk_documents(docs, mode="recursive")
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.chunk_ix, r.start_index, r.text) for r in rows.collect())
    want = sorted((r.doc_id, i, s, c) for r in docs.collect() for i, (s, c) in enumerate(plain(r.text, 2000, 200)))
    assert got == want and len(got) > 200
