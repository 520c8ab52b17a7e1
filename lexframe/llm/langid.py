"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's emission scores are sums of learned
weights of its affixes and character n-grams (hashed) and of its lexicon entry; learned transition
scores link neighbouring words, so code-switched text changes label where the words do. Marginals
come from exact forward-backward, and a document's language is the one with the largest mean
marginal (the score).

The model is fitted on a bounded sample: at most ``FIT_DOCS`` labelled documents in all, shared
evenly by the languages and chosen by id hash, and of a longer text ``FIT_SPANS`` spans of together
``FIT_CHARS`` characters, one from each of as many equal parts of the whole text, at a place chosen by
hash. Spans of different documents are chained in training, which is what teaches the transitions to switch. The
fit is stochastic gradient ascent on the conditional likelihood in one task (its input is bounded),
and the model (``BUCKETS`` x languages weights) is broadcast.

Prediction reads every word of every text, row by row; there is no shuffle. Texts of one Arrow
slice are cut into blocks of ``BLOCK`` words that run forward-backward side by side: transfer
matrices of the blocks first, then messages from block to block, then marginals inside. The result
is the same as word by word.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when
no labelled row can be learned from; ties between languages go to the first by code point; repeated
rows get equal results; extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lexframe.llm.common import releasing, text_slices

#: Bounds of the training sample, and of the model.
FIT_DOCS, FIT_CHARS, FIT_SPANS, BUCKETS = 3000, 1200, 6, 1 << 16
#: A word counts as sure when one language has this marginal at least.
SURE = 0.5
#: Training: words of a chain, epochs, step size, chains of one step; lexicon words occur so often.
CHAIN, EPOCHS, STEP, BATCH, LEXICON_MIN = 48, 4, 0.3, 64, 3
BLOCK, SLICE_BYTES = 64, 1 << 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Features:
    """Feature rows of distinct words: hashed n-grams of ^word$ of 2 to 4 characters (those that hold
    an end mark are the affixes of 1 to 3 characters), and a hash of the whole word for the lexicon."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - self.starts[word] if len(words) else word
        self.words, self.index, self.of = len(words), [], []
        h = codes.copy()
        for n in (2, 3, 4):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] if len(codes) >= n else h[:0]
            inside = word[:len(h)] == word[n - 1:]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.index.append(((mixed[inside] >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64))
            self.of.append(word[:len(h)][inside])
        # A word's lexicon hash: its characters, each mixed with its place, summed.
        mixed = (codes + np.uint64(1)) * (np.uint64(0xD6E8FEB86659FD93) * (2 * place.astype(np.uint64) + np.uint64(1)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        self.hash = np.add.reduceat(mixed, self.starts) if len(words) else np.zeros(0, np.uint64)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.index), np.concatenate(self.of)


class Model:
    """Weights of a fitted field. ``lexicon`` holds sorted word hashes, a weight row each."""

    def __init__(self, langs, grams, lexicon, entries, transitions):
        self.langs, self.grams, self.lexicon, self.entries, self.transitions = langs, grams, lexicon, entries, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        f, out = Features(words), np.zeros((len(words), len(self.langs)), np.float32)
        for index, of in zip(f.index, f.of):
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[first]] += np.add.reduceat(self.grams[index], first, axis=0)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, f.hash), len(self.lexicon) - 1)
            known = self.lexicon[at] == f.hash
            out[known] += self.entries[at[known]]
        return out


def chains(docs: list[tuple[int, list[str]]], seed: int = 1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and training chains of ``CHAIN`` (word, label) from spans of shuffled documents."""
    rng, spans = np.random.default_rng(seed), []
    for label, ws in docs:
        i = 0
        while i < len(ws):
            n = int(rng.integers(4, 33))
            spans.append((label, ws[i:i + n]))
            i += n
    order = rng.permutation(len(spans))
    words = [w for k in order for w in spans[k][1]]
    labels = np.array([spans[k][0] for k in order for _ in spans[k][1]], np.int64)
    coded = pa.array(words, pa.string()).dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    n = len(words) // CHAIN
    if not n and words:  # a tiny sample: one chain, its words repeated
        code, labels, n = np.resize(code, CHAIN), np.resize(labels, CHAIN), 1
    return distinct, code[:n * CHAIN].reshape(n, CHAIN), labels[:n * CHAIN].reshape(n, CHAIN)


def train(docs: list[tuple[int, list[str]]], langs: list[str], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Gradient ascent (AdaGrad) on the log likelihood of the labels of the training chains."""
    k = len(langs)
    distinct, code, label = chains(docs, seed)
    feats = Features(distinct)
    counts = np.bincount(code.ravel(), minlength=len(distinct))
    lexicon = np.unique(feats.hash[counts >= LEXICON_MIN])
    index, of = feats.flat()
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, feats.hash), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == feats.hash)
        index, of = np.concatenate([index, BUCKETS + at[known]]), np.concatenate([of, known])
    by_word = np.argsort(of, kind="stable")
    index, of = index[by_word], of[by_word]
    begin = np.searchsorted(of, np.arange(len(distinct) + 1))
    w, w2 = np.zeros((BUCKETS + len(lexicon), k)), np.full((BUCKETS + len(lexicon), k), 1e-3)
    a, a2 = np.zeros((k, k)), np.full((k, k), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(code))
        for lo in range(0, len(order), BATCH):
            batch = order[lo:lo + BATCH]
            used, inverse = np.unique(code[batch], return_inverse=True)
            size = begin[used + 1] - begin[used]
            stop = np.cumsum(size)
            rows = index[np.repeat(begin[used] - (stop - size), size) + np.arange(stop[-1])]
            owner = np.repeat(np.arange(len(used)), size)
            score = np.zeros((len(used), k))
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            score[owner[first]] = np.add.reduceat(w[rows], first, axis=0)
            e = np.exp(score - score.max(axis=1, keepdims=True))[inverse.reshape(len(batch), CHAIN)]
            t = np.exp(a - a.max())
            gamma, pairs = posteriors(e, t)
            hot = np.eye(k)[label[batch]]
            grad = np.zeros((len(used), k))
            np.add.at(grad, inverse.ravel(), (hot - gamma).reshape(-1, k))
            g = np.zeros_like(a)
            np.add.at(g, (label[batch][:, :-1].ravel(), label[batch][:, 1:].ravel()), 1.0)
            g -= pairs
            a2 += (g / len(batch)) ** 2
            a += STEP * g / len(batch) / np.sqrt(a2)
            touched, back = np.unique(rows, return_inverse=True)
            own = np.zeros((len(touched), k))
            np.add.at(own, back, grad[owner])
            own /= len(batch)
            w2[touched] += own ** 2
            w[touched] += STEP * own / np.sqrt(w2[touched])
    return Model(langs, w[:BUCKETS].astype(np.float32), lexicon, w[BUCKETS:].astype(np.float32), a)


def posteriors(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on chains of one length: ``e`` [chains, words, labels] and ``t`` [labels,
    labels] are exponentiated scores. Marginals of words, and expected counts of transitions."""
    n, size, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = np.full((n, k), 1.0 / k)
    for i in range(size):
        now = (now @ t) * e[:, i]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, i] = now
    now = np.ones((n, k))
    for i in range(size - 1, -1, -1):
        beta[:, i] = now
        now = (e[:, i] * now) @ t.T
        now /= now.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    right = e[:, 1:] * beta[:, 1:]
    z = np.einsum("nti,ij,ntj->nt", alpha[:, :-1], t, right)
    pairs = np.einsum("nti,ntj->ij", alpha[:, :-1] / z[..., None], right) * t
    return gamma, pairs


def marginal_sums(e: np.ndarray, t: np.ndarray, sizes: np.ndarray, block: int = BLOCK, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the word marginals of each document, and its number of sure words. ``e``: exponentiated emissions of all words, one
    document after another; ``sizes``: their words. Exact forward-backward, by blocks side by side."""
    k, n_docs = e.shape[1], len(sizes)
    per_doc = -(-sizes // block)
    n_blocks = int(per_doc.sum())
    out, certain = np.zeros((n_docs, k)), np.zeros(n_docs, np.int64)
    if not n_blocks:
        return out, certain
    doc = np.repeat(np.arange(n_docs), per_doc)
    first_block, first_word = np.cumsum(per_doc) - per_doc, np.cumsum(sizes) - sizes
    place = np.arange(n_blocks) - first_block[doc]
    at = first_word[doc][:, None] + place[:, None] * block + np.arange(block)
    live = at < (first_word + sizes)[doc][:, None]
    x = e[np.minimum(at, len(e) - 1)]

    transfer = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for i in range(block):
        on = live[:, i]
        step = (transfer[on] @ t) * x[on, i][:, None, :]
        transfer[on] = step / step.max(axis=(1, 2), keepdims=True)
    # Messages at block edges, block by block, for all documents at once (longest first).
    order = np.argsort(-per_doc, kind="stable")
    left, right = np.empty((n_blocks, k)), np.empty((n_blocks, k))
    fore, back = np.full((n_docs, k), 1.0 / k), np.ones((n_docs, k))
    for j in range(int(per_doc.max())):
        d = order[:np.searchsorted(-per_doc[order], -j, side="left")]
        b = first_block[d] + j
        left[b] = fore[d]
        new = (fore[d][:, None, :] @ transfer[b])[:, 0]
        fore[d] = new / new.sum(axis=1, keepdims=True)
        b = first_block[d] + per_doc[d] - 1 - j
        right[b] = back[d]
        new = (transfer[b] @ back[d][:, :, None])[:, :, 0]
        back[d] = new / new.sum(axis=1, keepdims=True)
    alpha = np.empty((n_blocks, block, k))
    now = left
    for i in range(block):
        new = (now @ t) * x[:, i]
        now = np.where(live[:, i, None], new / new.sum(axis=1, keepdims=True), now)
        alpha[:, i] = now
    sums, firm, now = np.zeros((n_blocks, k)), np.zeros(n_blocks, np.int64), right
    for i in range(block - 1, -1, -1):
        g = alpha[:, i] * now
        g = g / g.sum(axis=1, keepdims=True)
        sums += np.where(live[:, i, None], g, 0.0)
        firm += live[:, i] & (g.max(axis=1) >= sure)
        new = (x[:, i] * now) @ t.T
        now = np.where(live[:, i, None], new / new.sum(axis=1, keepdims=True), now)
    np.add.at(out, doc, sums)
    np.add.at(certain, doc, firm)
    return out, certain


def _spans(text: Column, seed: Column) -> Column:
    """``FIT_CHARS`` characters of a text as spans from all over it; a shorter text whole. Words that a span cuts go."""
    size, span = F.char_length(text), FIT_CHARS // FIT_SPANS
    part = F.floor((size - span) / FIT_SPANS)
    pieces = []
    for i in range(FIT_SPANS):
        begin = part * i + F.pmod(F.xxhash64(seed, F.lit(i)), F.greatest(part, F.lit(1)))
        piece = F.substring(text, (begin + 1).cast("int"), F.lit(span))
        pieces.append(F.regexp_replace(piece, r"^\S{1,30}\s|\s\S{1,30}$", " "))
    return F.when(size > FIT_CHARS, F.concat_ws(" ", *pieces)).otherwise(text)


def fit(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        fit_docs: int = FIT_DOCS) -> Model:
    """The model, from a bounded sample of the labelled rows for which ``training`` holds."""
    rows = docs.where(training).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    each = max(1, fit_docs // len(langs))
    # A hash threshold leaves about four times the wanted rows of each language, so that few rows travel.
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, (4.0 * each + 20) / counts[lang]))))
    chosen = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("whole"),
                         F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    chosen = chosen.where(F.col("h").cast("double") / float(1 << 64) + 0.5 <= share[F.col("lang")])
    chosen = chosen.select("lang", _spans(F.col("whole"), F.col("h")).alias("text"), "h")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = chosen.withColumn("n", first).where(F.col("n") <= each).drop("n")

    def run(batches):
        import pickle

        got = sorted((h, lang, text) for b in batches for lang, text, h in zip(*(c.to_pylist() for c in b.columns)))
        labelled = [(langs.index(lang), words_of(text)) for _, lang, text in got]
        del got
        model = train(labelled, langs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], names=["model"])

    import pickle

    state = chosen.repartition(1).mapInArrow(releasing(run), "model binary").first()
    return Model(**pickle.loads(bytes(state["model"])))


def label(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score",
          sure_out: str | None = None) -> DataFrame:
    """All columns, with the predicted language and its mean marginal (0..1); ``sure_out`` names a column for
    the share of words that are sure of a language, whichever it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)  # BUCKETS x languages and a bounded lexicon
    new = [lang_out, score_out, *([sure_out] if sure_out else [])]
    keep = [c for c in docs.columns if c not in new]

    def run(batches):
        m = Model(**shared.value)
        t = np.exp(m.transitions - m.transitions.max(initial=0))
        for table in text_slices(batches, text_col, SLICE_BYTES):
            found = [words_of(x.as_py()) if m.langs else [] for x in table[text_col]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
            del found
            code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            # Digits that are no decimals also match the word pattern; a word has a letter.
            lettered = np.fromiter((any(c.isalpha() for c in w) for w in words), bool, len(words))
            if not lettered.all():
                on = lettered[code]
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[on], minlength=len(sizes))
                code = code[on]
            names, best, sure = np.full(len(sizes), UNKNOWN, object), np.zeros(len(sizes)), np.zeros(len(sizes))
            if len(code):
                e = m.emissions(words).astype(np.float64)
                e = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60.0))
                sums, certain = marginal_sums(e[code], t, sizes)
                some = sizes > 0
                sure[some] = certain[some] / sizes[some]
                top = sums.argmax(axis=1)
                names[some] = np.array(m.langs, object)[top[some]]
                best[some] = np.clip(sums[some, top[some]] / sizes[some], 0.0, 1.0)
            columns = [pa.array(names, pa.string()), pa.array(best), pa.array(sure)][:len(new)]
            out = pa.table([*(table[c] for c in keep), *columns], names=[*keep, *new])
            yield from out.combine_chunks().to_batches()

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(new, kinds))])
    return docs.mapInArrow(releasing(run), schema)
