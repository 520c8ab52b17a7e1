"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Encoding. Each text is split into pre-tokens by the tokenizer's pattern. Rows of about
``CHUNK_BYTES`` of text form a chunk, which keeps the position of every pre-token as a code into
the chunk's own word list. Word lists are cut by word hash into pages and the pages are shuffled
by hash bucket, so all occurrences of a word in the corpus meet in one bucket and the word is
merged once there. The ids travel back as pages to their chunk, and the chunk's position codes
put them in order. Only distinct words of a chunk are shuffled, never one row per pre-token, so
the most frequent word costs one entry per chunk.

Decoding. The token-byte table (one row per token of the vocabulary, a fixed size) is broadcast
and joined to the ids of every row by position in the table.

Defined cases: a null text has no tokens, as an empty one; repeated rows stay repeated; all other
columns are carried through unchanged, whatever their names (an input column with the output's
name is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm.common import (materialise_bucketed, pack, pack_table, partitions, release_memory, releasing, text_slices,
                                 unpack)

#: Text bytes of one chunk; bounds a worker's memory (about 6 times as much).
CHUNK_BYTES = 16 << 20
PAGE_SCHEMA = "chunk long, bucket int, words binary, codes binary, docs binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(ranks: dict, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokenise(text_col: str, carry: list[str], pattern: str, n_buckets: int, chunk_bytes: int):
    """Chunk rows: one with position codes and carried columns (bucket -1), and one per word page."""
    def run(batches):
        import regex

        findall = regex.compile(pattern).findall
        part = TaskContext.get().partitionId()
        for k, table in enumerate(text_slices(batches, text_col, chunk_bytes)):
            chunk = (part << 32) | k
            flat, lens, done = [], [], []
            for text in table[text_col]:
                found = findall(text.as_py() or "")
                lens.append(len(found))
                flat += found
                if len(flat) > 1 << 17:  # pre-tokens are Python objects only a few at a time
                    done.append(pa.array(flat, pa.string()))
                    flat = []
            coded = pa.concat_arrays([*done, pa.array(flat, pa.string())]).dictionary_encode()
            del flat, done
            words = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            # Frequent words get small codes, which pack well in byte planes.
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            planes = rank[codes].view(np.uint8).reshape(-1, 4)
            words = [words[i].encode() for i in order]
            bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.uint32, len(words))
            docs = table.select(carry) if carry else pa.table({"_": pa.nulls(table.num_rows)})
            sizes = pack(n=np.array(lens, np.uint32))
            rows = [(chunk, -1, pack(bucket=bucket), pack(**{f"b{i}": np.ascontiguousarray(planes[:, i]) for i in range(4)}),
                     len(sizes).to_bytes(8, "little") + sizes + pack_table(docs))]
            by_bucket = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=n_buckets)) if len(words) else np.zeros(n_buckets, int)
            start = 0
            for b, end in enumerate(ends):
                if end > start:
                    page = pa.array([words[i] for i in by_bucket[start:end]], pa.binary())
                    rows.append((chunk, b, pack(w=page), None, None))
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["chunk", "bucket", "words", "codes", "docs"])
            del coded, words, codes, planes, rank, order, bucket, rows, docs
            release_memory()
    return run


def _merge_pages(ranks_b, pattern: str):
    """Word pages, sorted by bucket, to id pages; each distinct word of a bucket is merged once."""
    def run(batches):
        ranks = ranks_b.value
        encode = _encoder(ranks, pattern)._encode_single_piece
        kind = pa.list_(pa.uint16() if max(ranks.values(), default=0) < 1 << 16 else pa.uint32())
        now, memo = None, {}
        for batch in batches:
            for chunk, bucket, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    now, memo = bucket, {}
                ids = []
                for w in unpack(words)["w"].to_pylist():
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = encode(w)
                    ids.append(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()),
                     pa.array([pack(i=pa.array(ids, kind))], pa.binary())], names=["chunk", "bucket", "ids"])
    return run


def _reassemble(carry: list[str], out_col: str, then, rows_at_once: int = 1 << 18):
    """A row holds one chunk: its position codes and carried columns, and its id pages. ``then`` maps
    each batch of the result in the same worker."""
    def run(batches):
        finish = then() if then else lambda batch: batch
        for batch in batches:
            for i in range(batch.num_rows):
                words, codes, docs, pages = (batch.column(n)[i] for n in ("words", "codes", "docs", "pages"))
                bucket_of = unpack(words.as_buffer())["bucket"].to_numpy()
                lens, starts, flats, done = np.zeros(len(bucket_of), np.int64), np.zeros(len(bucket_of), np.int64), [], 0
                for entry in pages.values if pages.is_valid else ():
                    page, at = unpack(entry["ids"].as_buffer())["i"].combine_chunks(), np.flatnonzero(bucket_of == entry["bucket"].as_py())
                    own = page.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    lens[at], starts[at] = own, done + np.cumsum(own) - own
                    flats.append(page.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
                    done += len(flats[-1])
                flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
                planes, docs = unpack(codes.as_buffer()), docs.as_py()
                code = np.stack([planes[f"b{j}"].to_numpy() for j in range(4)], axis=1).view(np.uint32).reshape(-1)
                cut = 8 + int.from_bytes(docs[:8], "little")
                n, table = unpack(docs[8:cut])["n"].to_numpy().astype(np.int64), unpack(docs[cut:])
                ends = np.cumsum(n)
                lo = 0
                while lo < len(n):  # some rows at a time, at least one
                    before = ends[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, before + rows_at_once, side="right")))
                    c = code[before:ends[hi - 1]]
                    each = lens[c]
                    stop = np.cumsum(each)
                    total = int(stop[-1]) if len(stop) else 0
                    ids = flat[np.repeat(starts[c] - (stop - each), each) + np.arange(total)]
                    edges = np.concatenate([[0], stop])[np.concatenate([[0], ends[lo:hi] - before])]
                    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                    part = table.slice(lo, hi - lo)
                    out = pa.table([*(part[c] for c in carry), lists], names=[*carry, out_col])
                    yield from map(finish, out.combine_chunks().to_batches())
                    lo = hi
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids",
           chunk_bytes: int = CHUNK_BYTES, then=None, then_schema: T.StructType | None = None) -> DataFrame:
    """All columns but the text, and ``out_col``: the text's token ids (array of int). ``then``, if given,
    makes a function that maps each Arrow batch of that result, in the same worker, to ``then_schema``."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary: a fixed size
    n = partitions(docs)
    carry = [c for c in docs.columns if c not in (text_col, out_col)]
    pages = materialise_bucketed(docs.select(text_col, *carry).mapInArrow(
        _tokenise(text_col, carry, pattern, 2 * n, chunk_bytes), PAGE_SCHEMA), "bpe-pages", "chunk", n)
    ids = (pages.where("bucket >= 0").select("chunk", "bucket", "words")
           .repartition(n, "bucket").sortWithinPartitions("bucket")
           .mapInArrow(releasing(_merge_pages(ranks, pattern)), "chunk long, bucket int, ids binary"))
    # A chunk has at most one page per bucket, and all of them are smaller than the chunk.
    back = ids.groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list(F.struct("bucket", "ids")).alias("pages"))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return (pages.where("bucket < 0").join(back, F.col("chunk") == F.col("_chunk"), "left")
            .select("words", "codes", "docs", "pages").mapInArrow(releasing(_reassemble(carry, out_col, then)), then_schema or schema))


def _joined(lists, table: pa.Array, rank: np.ndarray):
    """(first row, end row, the rows' bytes as a binary array), for rows of about 1M tokens at a time:
    the join of the ids with the token-byte table, concatenated by row."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.searchsorted(rank, flat)
    if len(flat) and (at.max() >= len(rank) or (rank[at] != flat).any()):
        raise ValueError("an id is not in the vocabulary")
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), side="right")) - 1)
        got = table.take(pa.array(at[ends[lo]:ends[hi]]))
        offsets = np.frombuffer(got.buffers()[1], np.int32)[:len(got) + 1] if len(got) else np.zeros(1, np.int32)
        edges = np.ascontiguousarray(offsets[ends[lo:hi + 1] - ends[lo]])
        yield lo, hi, pa.Array.from_buffers(
            pa.binary(), hi - lo, [None, pa.py_buffer(edges), got.buffers()[2] if len(got) else pa.py_buffer(b"")])
        lo = hi


def _token_bytes(spark, ranks_path: str):
    """The token-byte table, sorted by id, as a broadcast (one row per token of the vocabulary)."""
    by_rank = sorted((r, b) for b, r in read_ranks(ranks_path).items())
    return spark.sparkContext.broadcast(([b for _, b in by_rank], [r for r, _ in by_rank]))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns, and ``out_col``: the bytes of the row's ids (null ids: no bytes). An id
    outside the vocabulary fails the job, as it has no bytes."""
    shared = _token_bytes(tokens.sparkSession, ranks_path)
    keep = [c for c in tokens.columns if c != out_col]

    def run(batches):
        table, rank = pa.array(shared.value[0], pa.binary()), np.array(shared.value[1], np.int64)
        for batch in batches:
            for lo, hi, out in _joined(batch.column(ids_col), table, rank):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], names=[*keep, out_col])

    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField(out_col, T.BinaryType())])
    return tokens.select(*dict.fromkeys([*keep, ids_col])).mapInArrow(run, schema)


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str], text_col: str = "text", with_ids: bool = True,
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encodes, decodes the ids, and returns the ``carry`` columns, n_tokens, the ids (if ``with_ids``),
    ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (the bytes that the
    ids decode to)."""
    import hashlib

    shared = _token_bytes(docs.sparkSession, ranks_path)
    new = {"n_tokens": "long"} | ({"ids": "array<int>"} if with_ids else {}) | {"ids_sha256": "string", "decoded_sha256": "string"}

    def then():
        table, rank = pa.array(shared.value[0], pa.binary()), np.array(shared.value[1], np.int64)

        def finish(batch):
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids_sha = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
            dec_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for _, _, out in _joined(lists, table, rank) for x in out]
            columns = [pa.array(sizes), *([lists] if with_ids else []), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=[*carry, *new])
        return finish

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in new.items())])
    return encode(docs.select(*carry, text_col), ranks_path, pattern, text_col, "ids", chunk_bytes, then, schema)
