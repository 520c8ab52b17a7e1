import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from lexframe.llm import bpe
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures

RANKS = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def expected(text):
    ids = ENC.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_equals_the_library_on_whole_texts(spark, docs, awkward):
    for df in (docs, awkward):
        got = bpe.tokenised(df, RANKS, P.PATTERN, ["doc_id"], with_ids=False, chunk_bytes=40_000).collect()
        want = [(r.doc_id, *expected(r.text)) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def merges(piece, ranks):
    """Brute force: join the adjacent pair of lowest rank until none is in the vocabulary."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_merges_by_brute_force(spark):
    import regex
    ranks = bpe.read_ranks(RANKS)
    df = spark.createDataFrame([(1, "Thequick  brown fóx's 12345 ---- tions\n\n")], "doc_id long, text string")
    want = [i for w in regex.findall(P.PATTERN, df.first().text) for i in merges(w.encode(), ranks)]
    assert bpe.encode(df, RANKS, P.PATTERN).first().ids == want


def test_columns_and_empty(spark, awkward, empty):
    out = bpe.encode(awkward, RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "chunk", "word", "ids"]
    assert sorted((r.chunk or 0, r.word or "") for r in out.collect()) == sorted((r.chunk or 0, r.word or "") for r in awkward.collect())
    back = bpe.decode(out, RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in awkward.collect())
    assert bpe.tokenised(empty, RANKS, P.PATTERN, ["doc_id"]).count() == 0
