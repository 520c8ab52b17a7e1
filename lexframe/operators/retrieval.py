"""Chunking, embedding and nearest-neighbour retrieval (§2.8).

Embedding: a pluggable batch job. The default embedder is native feature hashing
(tokens → md5 bucket and sign → counts → L2-normalised dense vector), entirely in
JVM built-ins; a user embedder (any ``list[str] -> array`` callable) runs in
``mapInPandas`` over Arrow batches.

Search: exact k-NN without an all-pairs product. The corpus is clustered into
``n_cells`` cells (around a bounded sample of its vectors), each row gets its cell, and each cell its radius. A query first probes its nearest cells, which bounds its k-th distance;
then it meets every cell whose triangle-inequality lower bound ``|q - c| - radius`` does
not exceed that distance. Queries travel to regions of cells, not to every cell. Whatever is left out provably cannot enter the top k, so the answer
equals brute force. ``knn_approx`` stops after the probe step.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.session import cut_lineage

from lexframe.functions.splitting import recursive_chunks
from lexframe.functions.text import source_name

# Retrieval depth, chunk size and overlap, embedding size, empty-store notice.
DEFAULT_K = 4
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
EMBEDDING_DIM = 768
#: Texts that a loaded model gets at once.
MODEL_BATCH = 32
EMPTY_STORE_NOTICE = "The document vector store is currently empty. Notify the user and suggest to upload documents."
CONTEXT_TEMPLATE = ("Source: ", "\nContent: ")
CONTEXT_SEPARATOR = "\n\n"

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# Query vectors (float32) up to this size are broadcast and the corpus streamed past
# them; larger query tables take the cell plan.
QUERY_BROADCAST_BYTES = 64 << 20
# Query vectors that a task of the cell plan holds.
QUERY_BLOCK_BYTES = 32 << 20
# Queries and rows that meet in one matrix product, and values of candidates that are looked at at once.
QUERY_SLICE, ROW_SLICE, EXACT_VALUES = 512, 4096, 1 << 21

# Share of the true neighbours that approximate search aims at (the promise is 0.9; the rest covers the
# sample's error), and the sample of queries on which it is measured.
RECALL, RECALL_SAMPLE = 0.95, 256


# ---------------------------------------------------------------- inputs
def embedding_input(norms: DataFrame, keep=()) -> DataFrame:
    """The embedder's input: id, summary text as ``content``, short title as ``title``
    (and the columns ``keep``)."""
    return norms.select("id_norma", F.col("texto_resumido").alias("content"),
                        F.col("titulo_resumido").alias("title"), *keep)


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    source_col: str | None = "source", mode: str = "fixed") -> DataFrame:
    """Chunks of at most ``size`` characters with ``start_index`` (0-based offset).

    ``fixed``: windows every ``size - overlap`` characters, so consecutive chunks share
    ``overlap`` characters; a row-local ``explode`` (no shuffle, linear in text length).
    ``recursive``: the separator splitter of the question-answering upload path
    (paragraphs, lines, words, characters; ``functions/splitting.py``). Both are row-local
    expressions, and empty texts give no chunk in either.
    """
    src = F.col(source_col) if source_col else F.lit(None).cast("string")
    if mode == "recursive":
        base = df.select(F.col(id_col).alias("doc_id"), src.alias("source"), F.col(text_col).alias("text"))
        found = base.where(F.length("text") > 0).select("doc_id", "source", F.posexplode(recursive_chunks(F.col("text"), size, overlap)).alias("chunk_ix", "c"))
        return found.select(F.col("doc_id").cast("long"), "chunk_ix", F.col("c.start").alias("start_index"), "source", F.col("c.text").alias("text"))
    step = size - overlap
    n = F.length(F.col(text_col))
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return (df.where(n > 0)
            .select(F.col(id_col).alias("doc_id"), src.alias("source"), text_col,
                    F.posexplode(starts).alias("chunk_ix", "start_index"))
            .select("doc_id", F.col("chunk_ix").cast("int").alias("chunk_ix"),
                    F.col("start_index").cast("long").alias("start_index"), "source",
                    F.substring(F.col(text_col), F.col("start_index") + 1, size).alias("text")))


# ---------------------------------------------------------------- embedding
def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), TOKEN_SPLIT), "")


def _token_code(tok: str, dim: int) -> int:
    """Bucket + 1 of a token, negated for a negative sign: md5 hex digits 1-8 mod dim,
    sign from hex digit 9 (< 8 positive) — the same rule any engine with md5 can state."""
    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
    b = int(h[:8], 16) % dim + 1
    return b if int(h[8], 16) < 8 else -b


def _dense_udf(dim: int):
    """Tokens → L2-normalised dense float vector, one Arrow batch at a time.
    No token → empty array; every bucket cancelling → all zeros.

    Tokens are split in the JVM. Per batch, the token lists are flattened and
    dictionary-encoded in Arrow, each distinct token is hashed once, and one numpy
    ``bincount`` over (row, bucket) builds every row's signed counts: no per-token
    Python loop. Marked non-deterministic only so that the optimizer never copies
    the call into a pushed-down filter (which would run the Python step twice); the
    result is a pure function of the input.
    """
    @F.arrow_udf("array<float>")
    def dense(toks: pa.Array) -> pa.Array:
        n = len(toks)
        lengths = pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        enc = pc.dictionary_encode(pc.list_flatten(toks))
        codes = np.fromiter((_token_code(t, dim) for t in enc.dictionary.to_pylist()), dtype=np.int64,
                            count=len(enc.dictionary))
        code = codes[enc.indices.to_numpy(zero_copy_only=False)] if len(enc.indices) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n, dtype=np.int64), lengths)
        counts = np.bincount(row * dim + np.abs(code) - 1, weights=np.sign(code).astype(np.float64),
                             minlength=n * dim).reshape(n, dim)
        ss = np.einsum("ij,ij->i", counts, counts)
        scale = np.zeros(n)
        np.divide(1.0, np.sqrt(ss), out=scale, where=ss > 0)
        filled = lengths > 0
        values = (counts[filled] * scale[filled, None]).astype(np.float32).ravel()
        offsets = np.concatenate([[0], np.cumsum(np.where(filled, dim, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.float32()))
    return dense.asNondeterministic()


def embed(df: DataFrame, id_col: str = "id_norma", content_col: str = "content", title_col: str | None = "title",
          dim: int = EMBEDDING_DIM, embedder=None, keep=(), model=None, batch_size: int = MODEL_BATCH) -> DataFrame:
    """Adds an embedding per row with status and statistics, in the shape of the
    embeddings table: ``(id, ml_generate_embedding_result array<float>,
    ml_generate_embedding_statistics, ml_generate_embedding_status, content, title)``.

    A row whose content has no token gets an empty array and a non-empty status (it
    is dropped by ``valid_embeddings`` before a merge). The columns ``keep`` follow.

    By default texts are hashed. ``embedder(list[str]) -> vectors`` is called in Arrow batches; ``model`` is a
    function that loads such an embedder, called once in each Python worker, whose batches hold ``batch_size``
    texts, taken in order of their length so that a batch pads little.
    """
    base = df.select(F.col(id_col).alias(id_col), content_col,
                     (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("title"), *keep)
    if model is not None:
        return _embed_by_model(base, id_col, content_col, dim, model, batch_size, list(keep))
    if embedder is not None:
        return _embed_with(base, id_col, content_col, dim, embedder, list(keep))
    base = base.withColumn("_tok", tokens(content_col))
    out = base.withColumn("_v", _dense_udf(dim)(F.col("_tok")))
    ok = F.size("_v") > 0
    return out.select(
        id_col,
        F.col("_v").alias("ml_generate_embedding_result"),
        F.to_json(F.struct(F.size("_tok").alias("token_count"), F.lit(False).alias("truncated")))
        .alias("ml_generate_embedding_statistics"),
        F.when(ok, F.lit("")).otherwise(F.lit("empty content")).alias("ml_generate_embedding_status"),
        content_col, "title", *keep)


def with_vectors(df: DataFrame, text_col: str, dim: int = EMBEDDING_DIM, embedder=None, out_col: str = "embedding") -> DataFrame:
    """All columns and the vector of a text column (empty where the embedding failed)."""
    if embedder is None:
        return df.withColumn(out_col, _dense_udf(dim)(tokens(text_col)))
    rows = df.withColumn("_row", F.struct(*df.columns)).withColumn("_id", F.lit(0).cast("long"))
    done = embed(rows, "_id", text_col, None, dim, embedder, keep=["_row"])
    return done.select("_row.*", F.col("ml_generate_embedding_result").alias(out_col))


def embed_rows(embedder, texts: list[str], dim: int) -> tuple[list[list[float]], list[str]]:
    """Vectors and statuses of texts. When the batch call fails (or gives another number of
    vectors), each text is tried alone, so one bad text costs one row; a failed or
    wrong-length vector is empty and its status says why."""
    def checked(vector):
        v = [float(x) for x in vector]
        return (v, "") if len(v) == dim else ([], f"dimension {len(v)}")

    try:
        out = [checked(v) for v in embedder(texts)]
        if len(out) == len(texts):
            return [v for v, _ in out], [s for _, s in out]
    except Exception:  # noqa: BLE001 - the rows are tried one by one below
        pass
    done = []
    for t in texts:
        try:
            (vector,) = embedder([t])
            done.append(checked(vector))
        except Exception as e:  # noqa: BLE001 - reported per row, not raised
            done.append(([], f"error: {type(e).__name__}"))
    return [v for v, _ in done], [s for _, s in done]


def _embed_with(base: DataFrame, id_col: str, content_col: str, dim: int, embedder, keep: list) -> DataFrame:
    """User embedder over Arrow batches: ``embedder(list[str]) -> sequence of vectors``."""
    from pyspark.sql import types as T

    packed = base.select(F.struct(*base.columns).alias("row"), F.coalesce(F.col(content_col), F.lit("")).alias("text"))
    out = T.StructType([packed.schema["row"], T.StructField("vec", T.ArrayType(T.FloatType())),
                        T.StructField("status", T.StringType()), T.StructField("tokens", T.IntegerType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            vecs, status = embed_rows(embedder, texts, dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(vecs, pa.list_(pa.float32())), pa.array(status, pa.string()),
                 pa.array([len(t.split()) for t in texts], pa.int32())], names=["row", "vec", "status", "tokens"])

    done = packed.mapInArrow(run, out)
    return done.select(
        F.col("row")[id_col].alias(id_col), F.col("vec").alias("ml_generate_embedding_result"),
        F.to_json(F.struct(F.col("tokens").alias("token_count"))).alias("ml_generate_embedding_statistics"),
        F.col("status").alias("ml_generate_embedding_status"), F.col("row")[content_col].alias(content_col),
        F.col("row")["title"].alias("title"), *(F.col("row")[c].alias(c) for c in keep))


def _embed_by_model(base: DataFrame, id_col: str, content_col: str, dim: int, load, batch_size: int, keep: list) -> DataFrame:
    """A loaded model over batches of texts (Spark's batch inference keeps what it loaded for the life of a worker)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def make():
        embedder = load()

        def predict(texts):
            texts = [str(t) for t in texts]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out = [None] * len(texts)
            for lo in range(0, len(order), batch_size):
                part = order[lo:lo + batch_size]
                for i, vec, status in zip(part, *embed_rows(embedder, [texts[i] for i in part], dim)):
                    out[i] = {"vec": np.asarray(vec, np.float32), "status": status, "tokens": len(texts[i].split())}
            return out
        return predict

    result = T.StructType([T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType()), T.StructField("tokens", T.IntegerType())])
    # Batches to sort come by the Arrow batch; the model sees ``batch_size`` texts at a time.
    infer = predict_batch_udf(make, return_type=result, batch_size=16 * batch_size)
    done = base.withColumn("_out", infer(F.coalesce(F.col(content_col), F.lit(""))))
    return done.select(
        id_col, F.col("_out.vec").alias("ml_generate_embedding_result"),
        F.to_json(F.struct(F.col("_out.tokens").alias("token_count"))).alias("ml_generate_embedding_statistics"),
        F.col("_out.status").alias("ml_generate_embedding_status"), content_col, "title", *keep)


# ---------------------------------------------------------------- distances
def _sqdist(a, b) -> Column:
    """Squared Euclidean distance of two float arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) *
                                  (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def distance(a, b, metric: str = "l2") -> Column:
    if metric == "l2":
        return F.sqrt(_sqdist(a, b))
    if metric == "ip":
        return -_dot(a, b)
    if metric == "cosine":
        return F.lit(1.0) - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    raise ValueError(f"unknown metric {metric}")


# ---------------------------------------------------------------- cells
def _sample_centres(corpus: DataFrame, vec_col: str, n_cells: int, seed: int, n: int) -> list:
    """Cell centres: the ``n_cells`` corpus vectors of least seeded hash, wherever they are
    stored (one pass; the bounded list is what the tasks carry). Exactness never depends
    on how good the cells are — only how much the bound prunes."""
    k = max(1, min(n_cells, n))
    rows = corpus.select(vec_col, F.xxhash64(F.lit(seed), vec_col).alias("_h")).orderBy("_h").limit(k).collect()
    return [np.asarray(r[0], dtype=np.float64) for r in rows]


def _blas_sq(v, centres):
    """Squared distances (rows × centres) by one matrix product (for choosing cells)."""
    d2 = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (v @ centres.T)
    return np.maximum(d2, 0.0)


def _unit(v):
    """Rows scaled to length 1 (zero rows stay zero)."""
    n = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(n > 0, n, 1.0)[:, None]


def cell_space(v, metric: str, longest: float = 0.0, query: bool = False):
    """Vectors where l2 orders rows as the metric does: unit vectors for cosine; for ip one more coordinate that
    brings every row to the length of the ``longest`` (and is 0 in a query)."""
    if metric == "cosine":
        return _unit(v)
    if metric == "ip":
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest ** 2 - np.einsum("ij,ij->i", v, v), 0.0))
        return np.concatenate([v, more[:, None]], axis=1)
    return v


def cell_reach(dk, metric: str, longest: float, length):
    """The metric's distance as an l2 distance in cell space, widened by more than the rounding of both."""
    if metric == "cosine":
        reach = np.sqrt(np.maximum(2.0 * dk, 0.0))
        return reach + 1e-6 * (1.0 + reach)
    if metric == "ip":
        reach = np.sqrt(np.maximum(length ** 2 + longest ** 2 + 2.0 * dk, 0.0))
        return reach + 1e-6 * (1.0 + reach + longest + length)
    return dk + 1e-9 * (1.0 + dk)


def _nearest_cell(centres, metric: str, longest: float):
    """Per Arrow batch: each corpus row's nearest centre (matrix product) and its exact
    distance to that centre (direct difference; the cell radius is its maximum)."""
    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            v = cell_space(np.stack(pdf["vec"].to_numpy()).astype(np.float64), metric, longest)
            cell = np.argmin(_blas_sq(v, centres), axis=1)
            diff = v - centres[cell]
            yield pdf.assign(cell=cell.astype("int32"), to_centre=np.sqrt(np.einsum("ij,ij->i", diff, diff)))
    return fn


def _probed_cells(centres, n_probe: int, held: list, metric: str):
    """Per Arrow batch: the ``n_probe`` nearest of the cells that hold rows, for each query."""
    held = np.array(held)

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            v = cell_space(np.stack(pdf["qvec"].to_numpy()).astype(np.float64), metric, query=True)
            near = held[np.argsort(_blas_sq(v, centres)[:, held], axis=1, kind="stable")[:, :n_probe]]
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), near.shape[1]), "cell": near.ravel().astype("int32")})
    return fn


def _cells_in_reach(centres, n_probe: int, radius: dict, metric: str, longest: float):
    """Per Arrow batch: of each query with its k-th distance so far, the cells (beyond the ``n_probe`` nearest) that may hold a nearer row."""
    held = np.array(sorted(radius))
    radii = np.array([radius[c] for c in sorted(radius)])

    def fn(batches):
        for pdf in batches:
            for s in range(0, len(pdf), QUERY_SLICE):
                part = pdf.iloc[s:s + QUERY_SLICE]
                v = np.stack(part["qvec"].to_numpy()).astype(np.float64)
                far = _reach(v, centres[held], metric, longest, dk=part["dk"].to_numpy(dtype=np.float64))
                d2 = _blas_sq(cell_space(v, metric, query=True), centres[held])
                close = ~(np.sqrt(d2) - radii > far[:, None])
                np.put_along_axis(close, np.argsort(d2, axis=1, kind="stable")[:, :n_probe], False, axis=1)
                row, at = np.nonzero(close)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "cell": held[at].astype("int32")})
    return fn


def _reach(v, centres, metric: str, longest: float, n_probe: int = 0, dk=None):
    """How far, in cell space, each query looks: to its ``n_probe``-th nearest centre or, with its k-th distance so far,
    as far as a nearer row can be; plus the matrix product's rounding, at worst, as a distance."""
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    rounding = np.sqrt(1e-12 * (1.0 + length ** 2 + longest ** 2 + np.einsum("ij,ij->i", centres, centres).max()))
    if dk is not None:
        return cell_reach(dk, metric, longest, length) + rounding
    at = min(n_probe, len(centres)) - 1
    return np.sqrt(np.partition(_blas_sq(cell_space(v, metric, query=True), centres), at, axis=1)[:, at]) + rounding


def _looks(v, reach, centres, inner, metric: str):
    """Queries × cells: does the query look as far as the cell (its centre, less ``inner``)? A bounded slice of queries at a time."""
    out = np.empty((len(v), len(centres)), bool)
    for s in range(0, len(v), QUERY_SLICE):
        q = cell_space(v[s:s + QUERY_SLICE].astype(np.float64), metric, query=True)
        out[s:s + QUERY_SLICE] = ~(np.sqrt(_blas_sq(q, centres)) - inner > reach[s:s + QUERY_SLICE, None])
    return out


def _routes(centres, inner, members, metric: str, longest: float, n_probe: int):
    """Per Arrow batch: how far each query looks (``_reach``) and the regions that hold a cell within that;
    ``members`` says which cells (rows) have rows in which regions."""
    def fn(batches):
        for pdf in batches:
            for s in range(0, len(pdf), QUERY_SLICE):
                part = pdf.iloc[s:s + QUERY_SLICE]
                v = np.stack(part["qvec"].to_numpy())
                dk = None if n_probe else part["dk"].to_numpy(dtype=np.float64)
                reach = _reach(v.astype(np.float64), centres, metric, longest, n_probe, dk)
                regions = _looks(v, reach, centres, inner, metric).astype(np.float32) @ members > 0
                yield part.assign(reach=reach, regions=[np.nonzero(r)[0].astype("int32") for r in regions])
    return fn


def _probes_for(recall: float, q: DataFrame, assigned: DataFrame, top, centres, held: list, k: int, metric: str,
                seed: int, query_block_rows: int) -> int:
    """The least number of probes with which a bounded sample of the queries (by hash) finds the share
    ``recall`` of its exact ``k`` nearest rows. One pass over the corpus: each sampled query's true
    neighbours come back as their cells, at most ``k`` rows a query."""
    rows = q.orderBy(F.xxhash64(F.lit(seed), "query_id", "qvec")).limit(RECALL_SAMPLE).select("qvec").collect()
    if not rows:
        return 1
    v = np.array([r[0] for r in rows], dtype=np.float32).reshape(len(rows), -1)
    bc = q.sparkSession.sparkContext.broadcast((np.arange(len(v)), v))
    cells = assigned.select(F.col("cell").cast("long").alias("id"), "vec")
    near = top(cells.mapInPandas(_broadcast_scan(bc, k, metric, query_block_rows), "query_id long, id long, distance double")).collect()
    d = _blas_sq(cell_space(v.astype(np.float64), metric, query=True), centres)[:, held]
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    at = {c: i for i, c in enumerate(held)}
    needed = np.sort([rank[r["query_id"], at[r["id"]]] + 1 for r in near])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else 1


class _Nearest:
    """The ``k`` nearest rows so far of each query of a bounded block, ties by id.

    Rows are offered in batches. A matrix product ranks the pairs of a slice. A pair that is not worse than its
    query's limit (its k-th distance so far, or one that is known beforehand) by more than a safe margin
    is a candidate. The margin is far above the rounding error of the product, so the true top k is always
    among the candidates. Candidates get their exact distance, summed dimension by dimension in index
    order (``cumsum`` along the row: the same arithmetic as the SQL form), and the top k is taken on that.
    A distance that is no number comes last.
    """

    def __init__(self, ids, vectors, k: int, metric: str, limit=None, slice_rows: int = 512):
        self.ids, self.vectors, self.k, self.metric, self.slice_rows = ids, vectors, k, metric, slice_rows
        self.given = np.full(len(ids), np.inf) if limit is None else np.where(np.isnan(limit), np.inf, limit)
        self.limit = self.given.copy()
        self.distance = np.full((len(ids), k), np.inf)
        self.row = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros((len(ids), k), bool)

    def offer(self, rows, vectors, at=None) -> None:
        """Offers ``rows`` (ids, with their vectors) to the queries at the places ``at`` (None: all)."""
        for lo in range(0, len(rows), ROW_SLICE):
            first = self._without_copies(rows[lo:lo + ROW_SLICE], vectors[lo:lo + ROW_SLICE])
            cids, c = rows[lo:lo + ROW_SLICE][first], vectors[lo:lo + ROW_SLICE][first].astype(np.float64)
            cc = np.einsum("ij,ij->i", c, c)
            n = len(self.ids) if at is None else len(at)
            for s in range(0, n, self.slice_rows):
                place = np.arange(s, min(s + self.slice_rows, n)) if at is None else at[s:s + self.slice_rows]
                q = self.vectors[place].astype(np.float64)
                one, other = self._candidates(q, c, cc, self.limit[place])
                step = max(1, EXACT_VALUES // q.shape[1])
                for e in range(0, len(one), step):
                    self._take(place, q, one[e:e + step], cids, c, other[e:e + step])

    def _without_copies(self, rows, vectors):
        """The places of the rows, of equal vectors only the ``k`` of least id: no query can need the others."""
        raw = np.ascontiguousarray(vectors)
        _, same = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((rows, same))
        count = np.bincount(same)
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        return np.sort(order[rank < self.k])

    def _candidates(self, q, c, cc, limit):
        qq = np.einsum("ij,ij->i", q, q)
        if self.metric == "l2":
            score = q @ c.T
            score -= 0.5 * cc
            least, margin = 0.5 * (qq - limit * limit), 1e-9 * (qq + cc.max()) + 1e-300
        elif self.metric == "ip":
            score = q @ c.T
            least, margin = -limit, 1e-9 * np.sqrt(qq * cc.max()) + 1e-300
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (q / np.sqrt(qq)[:, None]) @ (c / np.sqrt(cc)[:, None]).T
            least, margin = 1.0 - limit, np.full(len(q), 1e-9)
        with np.errstate(invalid="ignore"):
            least = least - margin
        free = np.nonzero(~np.isfinite(limit))[0]  # nothing known yet: the k best of this slice bound it
        if len(free) and c.shape[0] > self.k:
            known = score[free]
            known[np.isnan(known)] = -np.inf
            with np.errstate(invalid="ignore"):
                least[free] = np.partition(known, c.shape[0] - self.k, axis=1)[:, c.shape[0] - self.k] - 2 * margin[free]
        elif len(free):
            least[free] = -np.inf
        # A pair whose score is no number is a candidate while its query has fewer than k rows.
        hit = score >= least[:, None]
        if len(free):
            hit[free] = ~(score[free] < least[free][:, None])
        return np.nonzero(hit)

    def _exact(self, q, c):
        if self.metric == "l2":
            diff = c - q
            return np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
        dot = np.cumsum(c * q, axis=1)[:, -1]
        if self.metric == "ip":
            return -dot
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - dot / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", c, c)))

    def _take(self, place, q, one, cids, c, other) -> None:
        d = self._exact(q[one], c[other])
        keep = ~(d > self.limit[place[one]])
        one, other, d = one[keep], other[keep], d[keep]
        if not len(one):
            return
        held, back = np.unique(one, return_inverse=True)
        mine = place[held]
        # The rows held so far and the new ones, by query, distance and id; places not filled come last.
        query = np.concatenate([np.repeat(np.arange(len(held)), self.k), back])
        distance = np.concatenate([self.distance[mine].ravel(), d])
        row = np.concatenate([self.row[mine].ravel(), cids[other]])
        filled = np.concatenate([self.filled[mine].ravel(), np.ones(len(d), bool)])
        order = np.lexsort((row, distance, ~filled, query))
        count = np.bincount(query)
        best = order[(np.cumsum(count) - count)[:, None] + np.arange(self.k)]
        self.distance[mine], self.row[mine], self.filled[mine] = distance[best], row[best], filled[best]
        kth = np.where(self.filled[mine, -1] & ~np.isnan(self.distance[mine, -1]), self.distance[mine, -1], np.inf)
        self.limit[mine] = np.minimum(self.given[mine], kth)

    def found(self) -> pd.DataFrame:
        at, _ = np.nonzero(self.filled)
        return pd.DataFrame({"query_id": self.ids[at].astype("int64"), "id": self.row[self.filled], "distance": self.distance[self.filled]})


def _broadcast_scan(bc, k: int, metric: str, query_block_rows: int):
    """Per partition of corpus rows: every batch is offered to the broadcast query vectors. The running top k of
    each query is emitted once, so a partition gives at most k rows per query however many batches it has."""
    def fn(batches):
        best = None
        for cpdf in batches:
            if cpdf.empty:
                continue
            best = best or _Nearest(*bc.value, k, metric, slice_rows=query_block_rows)
            best.offer(cpdf["id"].to_numpy(), np.stack(cpdf["vec"].to_numpy()))
        if best is not None:
            yield best.found()
    return fn


def collect_vectors(q: DataFrame, *more: str):
    """The ids and vectors (float32) of a bounded table of queries, and further columns, as arrays."""
    t = q.select("query_id", "qvec", *more).toArrow()
    values = t["qvec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return t["query_id"].to_numpy(), values.reshape(len(t), len(values) // max(1, len(t))), *(t[c].to_numpy() for c in more)


def _region_scan(centres, inner, lo, hi, at: dict, k: int, metric: str, n_regions: int, query_block_rows: int):
    """Per partition, rows sorted by part (query block and region) and cell, the part's queries first (cell -1). The
    queries of one part are held; its corpus rows stream past those that look as far as their cell."""
    def fn(batches):
        part, waiting, best, cell, near = None, [], None, None, None
        for pdf in batches:
            for (p, c), rows in pdf.groupby(["part", "cell"]):
                if p != part:
                    if best is not None:
                        yield best.found()
                    part, waiting, best, cell = p, [], None, None
                ids, vectors = rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy())
                if c < 0:
                    waiting.append((ids, vectors, rows["reach"].to_numpy(), rows["limit"].to_numpy()))
                    continue
                if best is None:
                    if not waiting:  # no query looks here
                        continue
                    asked, v, reach, limit = (np.concatenate(x) for x in zip(*waiting))
                    waiting, best = [], _Nearest(asked, v, k, metric, limit, query_block_rows)
                    mine = np.nonzero((lo <= p % n_regions) & (hi >= p % n_regions))[0]
                    looks = _looks(v, reach, centres[mine], inner[mine], metric)
                    column = {m: i for i, m in enumerate(mine)}
                if c != cell:
                    cell, near = c, np.nonzero(looks[:, column[at[c]]])[0]
                best.offer(ids, vectors, near)
        if best is not None:
            yield best.found()
    return fn


def knn(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, query_id: str = "query_id",
        corpus_id: str = "id", vec_col: str = "embedding", query_vec: str | None = None,
        metric: str = "l2", n_cells: int | None = None, n_probe: int | None = None, exact: bool = True,
        seed: int = 7, block_rows: int = 4096,
        query_block_rows: int = 512, strategy: str = "auto", recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest corpus rows per query: ``(query_id, id, rank, distance)``.

    ``strategy``: "broadcast", "cells" or "auto". "auto" broadcasts the query vectors
    when a count proves them at most ``QUERY_BROADCAST_BYTES`` (a table of questions
    against a large store). The corpus is then read once and never shuffled: each
    corpus batch meets every query in the block kernel, and only ≤ k rows per query
    and batch reach the final top-k. Larger query tables (and ``exact=False``) take
    the cell plan below.

    Cell plan (all partitioning and shuffles by Spark):
      1. cells: centres are a seeded sample of ≤ ``n_cells`` corpus vectors (shipped to
         tasks with the function); every corpus row gets its nearest cell and the
         distance to it (numpy per Arrow batch); per cell a row count and a radius.
      2. regions: neighbouring cells make a region; regions hold as many rows each (at least
         ``block_rows``), so a hot cell is spread over several. Their number follows the cluster's cores, not the
         input. Queries are dealt into blocks of at most ``QUERY_BLOCK_BYTES``.
      3. probe: each query looks as far as its ``n_probe``-th nearest cell (by default 2; with ``exact=False``, as
         many as a bounded sample of the queries needs for ``recall``).
      4. scan: a query goes once to every region that holds a cell it looks at, a corpus row once to
         every query block. A task holds the queries of one block and region and the rows of the region, sorted
         by cell, stream past those that look as far (``_Nearest``); ≤ k rows per query and region come back.
      5. bound (``exact``): with the probe's k-th distance a query looks at every cell
         whose lower bound ``|q − centre| − radius`` is within it, and these are scanned.
         Cells left out cannot hold a nearer row, so the result equals brute force.
         Cells and bound work in a space where l2 orders rows as the metric does
         (``cell_space``): unit vectors for cosine, and for ``ip`` vectors that one more
         coordinate brings to one length.
      6. top-k per query over the candidates (partial WindowGroupLimit).
    """
    spark = corpus.sparkSession
    qv = query_vec or vec_col
    # A question without a vector has no hit, on either plan.
    q = queries.select(F.col(query_id).alias("query_id"), F.col(qv).alias("qvec")).where(F.size("qvec") > 0)
    # Both inputs are read several times (count, k-means passes, assignment, probe):
    # materialise them once in the checkpoint folder so upstream work runs once.
    q = cut_lineage(q)
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(vec_col).alias("vec")).where(F.size("vec") > 0)
    none = "query_id long, id long, rank long, distance double"

    def top(cands: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    out_schema = "query_id long, id long, distance double"
    if strategy == "auto":
        nq, width = q.where(F.size("qvec") > 0).agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
        strategy = "broadcast" if exact and nq * (width or 0) * 4 <= QUERY_BROADCAST_BYTES else "cells"
    if strategy == "broadcast":
        # Bounded by the check above (or asked for explicitly): the query vectors only.
        ids, vectors = collect_vectors(q)
        if not len(ids):  # no query with a vector: no hits
            return spark.createDataFrame([], none)
        bc = spark.sparkContext.broadcast((ids, vectors))
        cands = c.mapInPandas(_broadcast_scan(bc, k, metric, query_block_rows), out_schema)
        return top(cands).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance")
    c = cut_lineage(c)  # read several times below
    n = c.count()
    if n == 0:  # an empty store: no hits (``build_context`` then gives the notice)
        return spark.createDataFrame([], none)
    if n_cells is None:
        n_cells = int(max(8, min(1024, round(n ** 0.5))))
    longest = c.agg(F.max(F.sqrt(_dot(F.col("vec"), F.col("vec"))))).first()[0] if metric == "ip" else 0.0
    centres = cell_space(np.stack(_sample_centres(c, "vec", n_cells, seed, n)), metric, longest)
    assigned = c.mapInPandas(_nearest_cell(centres, metric, longest), "id long, vec array<float>, cell int, to_centre double")
    assigned = cut_lineage(assigned)
    # At most ``n_cells`` rows: the rows and the radius of every cell that holds rows.
    cells = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_centre").alias("radius")).orderBy("cell").collect()
    held, count, radius = (np.array([r[i] for r in cells]) for i in range(3))
    if n_probe is None:
        n_probe = 2 if exact else _probes_for(recall, q, assigned, top, centres, held.tolist(), k, metric, seed, query_block_rows)
    q = q.where("query_id IS NOT NULL")
    nq, width = q.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    blocks = max(1, -(-nq * (width or 0) * 4 // QUERY_BLOCK_BYTES))
    cores = spark.sparkContext.defaultParallelism
    regions = int(max(1, min(-(-n // block_rows), max(8, 2 * cores // blocks))))
    # Cells in the order of a few of them that they lie next to, cut into regions of as many rows.
    home = np.argmin(_blas_sq(centres[held], centres[held][:regions]), axis=1)
    order = np.lexsort((held, home))
    start = np.empty_like(count)
    start[order] = np.cumsum(count[order]) - count[order]
    lo, hi = start * regions // n, (start + count - 1) * regions // n
    members = ((lo[:, None] <= np.arange(regions)) & (hi[:, None] >= np.arange(regions))).astype(np.float32)
    places = spark.createDataFrame([(int(c), int(s), int(m)) for c, s, m in zip(held, start, count)], "cell int, _start long, _count long")
    kind = q.schema["qvec"].dataType
    rows = (assigned.join(F.broadcast(places), "cell")  # one row per cell
            .withColumn("region", F.floor((F.col("_start") + F.pmod(F.xxhash64("id"), "_count")) * regions / n))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select((F.col("block") * regions + F.col("region")).cast("int").alias("part"), "cell", "id", F.col("vec").cast(kind).alias("vec"),
                    F.lit(None).cast("double").alias("reach"), F.lit(None).cast("double").alias("limit")))
    index = {int(c): i for i, c in enumerate(held)}

    def scan(asked: DataFrame, probe: int) -> DataFrame:
        inner = np.zeros(len(held)) if probe else radius
        from pyspark.sql import types as T
        schema = T.StructType([*asked.schema.fields, T.StructField("reach", T.DoubleType()), T.StructField("regions", T.ArrayType(T.IntegerType()))])
        looking = asked.mapInPandas(_routes(centres[held], inner, members, metric, longest, probe), schema)
        qs = (looking.withColumn("region", F.explode("regions"))
              .select((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * regions + F.col("region")).cast("int").alias("part"), F.lit(-1).alias("cell"),
                      F.col("query_id").alias("id"), F.col("qvec").alias("vec"), "reach", F.col("dk").alias("limit")))
        met = qs.unionByName(rows).repartitionById(blocks * regions, F.col("part")).sortWithinPartitions("part", "cell")
        return met.mapInPandas(_region_scan(centres[held], inner, lo, hi, index, k, metric, regions, query_block_rows), out_schema)

    first = cut_lineage(top(scan(q.withColumn("dk", F.lit(float("inf"))), n_probe)))
    if not exact:
        return first.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance")

    # k-th distance per query; +inf when the probe found fewer than k rows.
    bound = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("dk"))
    asked = q.join(bound, "query_id", "left").withColumn("dk", F.coalesce("dk", F.lit(float("inf"))))
    final = top(scan(asked, 0))
    return final.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance")


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, **kw) -> DataFrame:
    """Approximate k-NN: only the ``n_probe`` nearest cells of each query are scanned. By default the
    number is measured (``recall``); it is a growing share of the cells where vectors do not cluster."""
    return knn(queries, corpus, k, exact=False, **kw)


# ---------------------------------------------------------------- context
def build_context(hits: DataFrame, records: DataFrame, id_col: str = "id", text_col: str = "text",
                  source_col: str = "source", all_queries: DataFrame | None = None) -> DataFrame:
    """Per query, ``"Source: <name>\\nContent: <text>"`` in rank order joined by a blank
    line. ``hits (query_id, id, rank)`` hold at most k rows per query, so the ordered
    gather per query is bounded. With ``all_queries``, a query without a hit gets the
    empty-store notice when ``records`` is empty, and an empty context otherwise."""
    h = hits.join(records.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"),
                                 source_name(F.col(source_col)).alias("_s")), "id")
    piece = F.concat(F.lit(CONTEXT_TEMPLATE[0]), F.col("_s"), F.lit(CONTEXT_TEMPLATE[1]), F.col("_t"))
    ctx = (h.groupBy("query_id")
           .agg(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))).alias("l"))
           .select("query_id", F.array_join(F.transform("l", lambda x: x["p"]), CONTEXT_SEPARATOR).alias("context")))
    if all_queries is not None:
        notice = EMPTY_STORE_NOTICE if records.isEmpty() else ""
        ctx = all_queries.select("query_id").join(ctx, "query_id", "left").select(
            "query_id", F.coalesce("context", F.lit(notice)).alias("context"))
    return ctx


def search(queries: DataFrame, records: DataFrame | None, k: int = DEFAULT_K, dim: int = EMBEDDING_DIM,
           embedder=None, query_text: str = "text", record_id: str = "id", record_text: str = "text",
           record_source: str = "source", record_vector: str | None = None, index: str | None = None, **knn_kw) -> DataFrame:
    """Question answering's retrieval step for a table of questions:
    embed → k-NN → context string per ``query_id``. With ``index``, the stored vector index there is searched (it keeps
    ``record_text`` and ``record_source``, and only the cells that the questions need are read); with
    ``record_vector``, the stored vectors of the records; otherwise the records are embedded here."""
    qe = embed(queries.select("query_id", F.col(query_text).alias("content")), "query_id", "content", None,
               dim, embedder)
    if index is not None:
        from lexframe.operators import vector_index
        asked = qe.select("query_id", F.col("ml_generate_embedding_result").alias("embedding"))
        hits = cut_lineage(vector_index.search(asked, index, k, columns=[record_text, record_source]))
        found = hits.select("id", F.col(record_text).alias("text"), F.col(record_source).alias("source")).dropDuplicates(["id"])
        return build_context(hits.select("query_id", "id", "rank"), found, all_queries=queries.select("query_id"))
    if record_vector is None:
        done = embed(records.select(F.col(record_id).alias("id"), F.col(record_text).alias("content")), "id",
                     "content", None, dim, embedder)
        store = done.select("id", F.col("ml_generate_embedding_result").alias("embedding"))
    else:
        store = records.select(F.col(record_id).alias("id"), F.col(record_vector).alias("embedding"))
    hits = knn(qe.select("query_id", F.col("ml_generate_embedding_result").alias("embedding")), store, k, **knn_kw)
    return build_context(hits, records.select(F.col(record_id).alias("id"), F.col(record_text).alias("text"),
                                              F.col(record_source).alias("source")),
                         all_queries=queries.select("query_id"))
