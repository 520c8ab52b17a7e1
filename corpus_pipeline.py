"""Corpus pipeline: documents to training tokens, one operator of ``lexframe.llm`` a stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the
columns of ``documents``; the last returns tokens. Between stages the rows are written as Parquet to the
shared checkpoint folder and read again.

- language ID: learned from the labelled training rows; drops documents without a letter and those in
  which fewer than ``MIN_SURE`` of the words are sure of a language. Code-switched documents stay.
- line dedup: the source is the site, and copies of a text count as one page of it, so that the next
  stage finds them whole; ``n_chars`` follows the text. A document loses at most half of its text.
- near-duplicates: three-word shingles, at most three differing bits; the least id of a group stays.
- mixing: a row per copy, whole texts, in training order.
- tokens: shard and shard_row (the place in training: the mix's files in name order, their rows in order; they tell
  copies apart), doc_id, lang, source, n_tokens, the ids, and digests of ids and decoded bytes. Rows of a chunk of
  text stay in order; a reader that wants all of them in order sorts by the place, which costs a shuffle of the ids.

Nulls, empty texts, repeated rows and empty tables follow the operators' docstrings.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark.sql import functions as F

from lexframe.llm import bpe, curriculum, langid, linededup, simhash
from lexframe.llm.common import is_training, materialise

MIN_SURE = 0.5
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark, docs, sf_dir):
    model = langid.fit(docs, is_training(F.col("doc_id"), 3, 1))
    kept = langid.label(docs, model, sure_out="sure").where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("sure") >= MIN_SURE))
    return kept.select(docs.columns)


def line_dedup(spark, docs, sf_dir):
    out = linededup.drop_boilerplate(docs, F.col("source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark, docs, sf_dir):
    return simhash.drop_near_duplicates(docs)


def mix(spark, docs, sf_dir):
    return curriculum.mix_documents(docs)


def tokens(spark, docs, sf_dir):
    order = ["shard", "shard_row"]
    placed = docs.select("doc_id", "text", "lang", "source", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))
    return bpe.tokenised(placed, RANKS, public_tokenizers.PATTERN, carry=[*order, "doc_id", "lang", "source"])


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: No SQL: the first stage learns a model, the third needs connected components. tests/llm/test_pipeline.py
#: compares every stage with a plain version of it.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
