import hashlib
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexframe.llm import bpe, curriculum, langid
from lexframe.llm.common import is_training, n_words
from test_linededup import brute as plain_lines
from test_simhash import brute_components, brute_fp
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures

ENC = tiktoken.Encoding("own", pat_str=P.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(P.RANKS), special_tokens={})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["docs", "awkward", "empty"])
def test_every_stage_against_a_plain_version(request, spark, name):
    docs = request.getfixturevalue(name).select("doc_id", "text", "lang", "source", "n_chars")
    out = {}
    for stage, run in P.STAGES:
        before, docs = docs, P.materialise(run(spark, docs, ""), "test")
        out[stage] = before, docs
        if stage != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = out["language_id"]
    labels = langid.label(before, langid.fit(before, is_training(F.col("doc_id"), 3, 1)), sure_out="sure").collect()
    assert rows(after) == sorted((tuple(r)[:5] for r in labels if r.lang_pred != "und" and r.sure >= 0.5), key=str)

    before, after = out["line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == plain_lines([(r.doc_id, r.source, r.text) for r in before.collect()], 0.1, 3)
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = out["near_dedup"]
    found = before.collect()
    groups = brute_components([r.doc_id for r in found], [brute_fp(r.text) for r in found])
    assert sorted((r.doc_id for r in after.collect()), key=str) == sorted(set(groups), key=str)
    assert set(rows(after)) <= set(rows(before))

    before, after = out["mix"]
    plan = curriculum.plan(before, n_words(F.col("text"))).collect()
    assert Counter(r.doc_id for r in after.collect()) == sum((Counter({r.row.doc_id: r.taken // r["size"]}) for r in plan if r.taken), Counter())
    assert after.agg(F.sum(n_words(F.col("text")))).first()[0] == (sum(r.taken for r in plan) or None)

    before, after = out["tokens"]
    want, places = [], after.select("shard", "shard_row").collect()
    assert len(set(places)) == len(places)  # copies are told apart
    spots = before.select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))
    assert rows(spots) == rows(after.select("doc_id", "shard", "shard_row"))
    after = after.drop("shard", "shard_row")
    for r in before.collect():
        ids = ENC.encode_ordinary(r.text)
        want.append((r.doc_id, r.lang, r.source, len(ids), ids, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert rows(after) == sorted(want, key=str)


def test_run_applies_all_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["shard", "shard_row", "doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_one_whole_document_of_a_copy_group_stays(spark, docs):
    """A third of all rows are copies of one text of several lines, in two sources."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    words = own.where("lang = 'en' and n_chars > 600").orderBy("doc_id").first().text.split()[:90]
    text = "\n".join(" ".join(words[i:i + 15]) for i in range(0, 90, 15))
    sources = [r.source for r in own.select("source").distinct().orderBy("source").limit(2).collect()]
    copies = spark.createDataFrame([(10**6 + i, text, "en", sources[i % 2], len(text)) for i in range(100)], own.schema)
    got = own.unionByName(copies)
    for _, run in P.STAGES[:3]:
        got = P.materialise(run(spark, got, ""), "test")
    assert [r.text for r in got.where("doc_id >= 1000000").collect()] == [text]


def test_near_copies_and_code_switched_documents_stay(spark, docs):
    """Near copies on more than a third of a site's pages leave one whole document; a text in three languages stays."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    picked = {r.lang: r.text.split() for r in own.where("n_chars > 900").collect()}
    body = "\n".join(" ".join(picked["en"][i:i + 12]) for i in range(0, 120, 12))
    near = [(10**6 + i, f"{body}\nlast{i}", "en", "src0", 0) for i in range(60)]
    mixed = " ".join(w for k in ("en", "fr", "de") for w in picked[k][:50])
    got = own.unionByName(spark.createDataFrame([*near, (2 * 10**6, mixed, "en", "src1", 0)], own.schema))
    for _, run in P.STAGES[:3]:
        got = P.materialise(run(spark, got, ""), "test")
    rows_ = {r.doc_id: r.text for r in got.where("doc_id >= 1000000").collect()}
    assert rows_.pop(2 * 10**6) == mixed and rows_ and all(t.startswith(body) for t in rows_.values())
