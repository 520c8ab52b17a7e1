"""Invariants of the operators (SURVEY §5 (3)) and plan shapes (§5 (4))."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from lexframe.operators import conversations as C
from lexframe.operators import predicates as P
from lexframe.operators import retrieval as R
from lexframe.operators import upsert as U
from lexframe.operators import usage as S
from lexframe.plans import bindings as B
from lexframe.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_keys_unique_and_last(spark):
    ev = B.table(spark, SF01, "events")
    out = U.dedup_keep_last(ev, "user_id", ["ts", "event_id"])
    assert out.count() == ev.select("user_id").distinct().count()
    latest = ev.groupBy("user_id").agg(F.max("ts").alias("m"))
    assert out.join(latest, "user_id").where(F.col("ts") != F.col("m")).count() == 0


def test_dedup_plan_limits_before_shuffle(spark):
    out = U.dedup_keep_last(B.table(spark, SF01, "events"), "user_id", ["ts", "event_id"])
    out.collect()
    p = out._jdf.queryExecution().executedPlan().toString()
    assert p.index("WindowGroupLimit") and "Partial" in p[p.index("WindowGroupLimit"):]
    assert p.rindex("WindowGroupLimit") > p.index("Exchange")  # one stands below the shuffle


def test_merge_counts_and_idempotence(spark):
    from lexframe.operators.retrieval import embedding_input
    target = embedding_input(B.norm_rows(spark, SF01))
    source = embedding_input(B.revised_norms(spark, SF01))
    merged, modified = U.merge_embeddings(target, source)
    keys = target.select("id_norma").union(source.select("id_norma")).distinct().count()
    assert merged.count() == keys and modified == source.count()
    again, _ = U.merge_embeddings(merged, source)
    assert again.exceptAll(merged).count() == 0 and merged.exceptAll(again).count() == 0


def test_merge_does_not_shuffle_the_target(spark):
    from lexframe.operators.retrieval import embedding_input
    merged, _ = U.merge_embeddings(embedding_input(B.norm_rows(spark, SF01)),
                                   embedding_input(B.revised_norms(spark, SF01)))
    assert "BroadcastHashJoin" in plan(merged) or "BroadcastHashJoin" in merged._jdf.queryExecution().toString()


def test_chunks_cover_text(spark):
    docs = spark.createDataFrame([(1, "a" * 4500, "s/x"), (2, "b" * 10, None), (3, "", "s")],
                                 "doc_id long, text string, source string")
    ch = R.chunk_documents(docs).orderBy("doc_id", "chunk_ix").collect()
    one = [r for r in ch if r.doc_id == 1]
    assert [r.start_index for r in one] == [0, 1800, 3600]
    assert all(len(r.text) <= 2000 for r in one)
    assert one[-1].start_index + len(one[-1].text) == 4500
    assert [r.doc_id for r in ch].count(3) == 0 and [r.doc_id for r in ch].count(2) == 1


def _brute(q, c, k):
    import numpy as np
    out = {}
    for qid, qv in q:
        d = sorted((float(np.sqrt(np.sum((np.array(qv, dtype=float) - np.array(cv, dtype=float)) ** 2))), cid)
                   for cid, cv in c)
        out[qid] = [cid for _, cid in d[:k]]
    return out


@pytest.mark.parametrize("strategy", ["cells", "broadcast"])
def test_knn_equals_brute_force_with_a_hot_cell(spark, strategy):
    import random
    rnd = random.Random(3)
    # A third of the corpus sits in one tight cluster (a hot cell).
    corpus = [(i, [rnd.gauss(5, 0.01) for _ in range(8)] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(8)])
              for i in range(600)]
    queries = [(1000 + j, [rnd.gauss(0, 1.5) for _ in range(8)]) for j in range(40)]
    c = spark.createDataFrame(corpus, "id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {}
    for r in R.knn(q, c, k=4, n_cells=12, block_rows=64, query_block_rows=8, strategy=strategy).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    got = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    cf = [(r.id, r.embedding) for r in c.collect()]
    qf = [(r.query_id, r.embedding) for r in q.collect()]
    assert got == _brute(qf, cf, 4)


@pytest.mark.parametrize("sf", [SF01, "/root/testdata/sf0.1"])
def test_knn_approx_query_recall(spark, sf):
    from lexframe.plans import catalog
    exact = catalog.q_knn(spark, sf)
    hit = exact.join(catalog.q_knn_approx(spark, sf), ["query_id", "id"]).count()
    assert hit / exact.count() >= 0.9


def test_embed_is_normalised_and_plan_has_one_python_step(spark):
    docs = B.table(spark, SF01, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    e = R.embed(docs, "id", "content", None, dim=64)
    norms = e.select(F.aggregate("ml_generate_embedding_result", F.lit(0.0),
                                 lambda a, x: a + x.cast("double") * x.cast("double")).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-5 or r.n == 0.0 for r in norms)
    p = plan(e.where(F.size("ml_generate_embedding_result") > 0))
    assert p.count("ArrowEvalPython") == 1 and "Exchange" not in p


def test_build_context_empty_store_notice(spark):
    hits = spark.createDataFrame([], "query_id long, id long, rank int")
    recs = spark.createDataFrame([], "id long, text string, source string")
    qs = spark.createDataFrame([(1,)], "query_id long")
    r = R.build_context(hits, recs, all_queries=qs).first()
    assert r.context == R.EMPTY_STORE_NOTICE


def test_context_format(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id long, id long, rank int")
    recs = spark.createDataFrame([(10, "B", "a/b/doc2.pdf"), (11, "A", None)], "id long, text string, source string")
    assert R.build_context(hits, recs).first().context == "Source: unknown\nContent: A\n\nSource: doc2.pdf\nContent: B"


def test_feedback_summary_golden(spark):
    empty = spark.createDataFrame([], "feedback_id long, interaction_id long, is_positive boolean")
    assert tuple(S.feedback_summary(empty).first()) == (0, 0, 0, 0.0)
    three = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 3, False)],
                                  "feedback_id long, interaction_id long, is_positive boolean")
    assert tuple(S.feedback_summary(three).first()) == (3, 2, 1, 66.67)


def test_intake_golden(spark):
    existing = spark.createDataFrame([("a.pdf",)], "filename string")
    batch = spark.createDataFrame([(0, "a.pdf", "application/pdf"), (1, "b.pdf", "application/pdf"),
                                   (2, "b.pdf", "application/pdf"), (3, "c.txt", "text/plain")],
                                  "ord int, filename string, content_type string")
    got = [(r.status, r.error) for r in S.intake_documents(batch, existing).orderBy("ord").collect()]
    assert got == [("failed", S.DUPLICATE_ERROR), ("accepted", None), ("failed", S.DUPLICATE_ERROR),
                   ("failed", P.MEDIA_ERROR)]


def test_align_interactions_golden(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "user", "q1"), (1, 1, "assistant", ""), (1, 2, "tool", "t"), (1, 3, "assistant", "A"),
         (1, 4, "user", "q2"), (1, 5, "assistant", "B"), (1, 6, "assistant", "C")],
        "thread_id long, turn long, role string, content string")
    msgs = C.message_content(msgs.withColumnRenamed("content", "text"), blocks_col=None)
    inter = spark.createDataFrame([(7, 1, dt.datetime(2024, 1, 1)), (8, 1, dt.datetime(2024, 1, 2))],
                                  "interaction_id long, thread_id long, timestamp timestamp_ntz")
    fb = spark.createDataFrame([(7, True)], "interaction_id long, is_positive boolean")
    got = [(r.role, r.content, r.interaction_id, r.feedback)
           for r in C.align_interactions(msgs, inter, fb).orderBy("turn").collect()]
    assert got == [("user", "q1", None, None), ("assistant", "A", 7, True), ("user", "q2", None, None),
                   ("assistant", "B", 8, None), ("assistant", "C", None, None)]


def test_message_content_from_blocks(spark):
    df = spark.createDataFrame([("", '[{"type":"text","args":{}},{"type":"tool_call","args":{"answer":"X"}}]'),
                                ("hola", None), ("", "[]")], "text string, blocks string")
    assert [r.content for r in C.message_content(df).collect()] == ["X", "hola", None]


def test_recency_buckets_golden(spark):
    as_of = dt.datetime(2024, 1, 30, 12, 0)
    rows = [(1, dt.datetime(2024, 1, 30, 1)), (2, dt.datetime(2024, 1, 29, 23)), (3, dt.datetime(2024, 1, 25)),
            (4, dt.datetime(2024, 1, 5)), (5, dt.datetime(2023, 12, 1))]
    df = spark.createDataFrame(rows, "id long, updated_at timestamp_ntz")
    got = [r.period for r in C.recency_buckets(df, as_of).orderBy("id").collect()]
    assert got == ["Today", "Yesterday", "Last 7 days", "Last month", "Older"]


def test_upsert_feedback_late_vote_does_not_win(spark):
    cur = spark.createDataFrame([(1, True, dt.datetime(2024, 1, 10))], "interaction_id long, is_positive boolean, ts timestamp_ntz")
    votes = spark.createDataFrame([(5, 1, False, dt.datetime(2024, 1, 9)), (6, 2, True, dt.datetime(2024, 1, 9))],
                                  "vote_id long, interaction_id long, is_positive boolean, ts timestamp_ntz")
    got = {r.interaction_id: (r.is_positive, r.action) for r in U.upsert_feedback(cur, votes).collect()}
    assert got == {1: (True, "unchanged"), 2: (True, "created")}


def test_tail_sample_keeps_errors_and_slow(spark):
    log = spark.createDataFrame([("a", 500, 1.0), ("b", 200, 2000.0), ("c", 200, 1000.0)],
                                "request_id string, status_code int, duration_ms double")
    kept = {r.request_id for r in P.tail_sample(log, 1000.0, 0.0).collect()}
    assert kept == {"a", "b"}


def test_the_version_written_last_is_current(spark):
    from lexframe.sources.norms import current_version, read_current, write_version
    path = scratch_path(spark, "t")
    assert current_version(spark, path) is None
    write_version(spark.range(3), path, "2025-10-02")
    assert current_version(spark, path) == "2025-10-02"
    write_version(spark.range(0), path, "01")
    assert current_version(spark, path) == "01" and read_current(spark, path).count() == 0


def _files(spark, path):
    return {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}


def test_a_merge_rewrites_touched_ranges_only(spark):
    from lexframe.sources.norms import merge_keyed, read_keyed, write_keyed
    path = scratch_path(spark, "t")
    merge = lambda old, new: U.merge_embeddings(old, new, "id", new.columns)[0]
    write_keyed(spark.range(10000).withColumn("v", F.lit("a")), path, "id", rows=500)
    before = _files(spark, path)
    fresh = spark.range(10000, 10200).withColumn("v", F.lit("b"))  # a day's new ids
    assert merge_keyed(fresh, path, "id", merge) <= 2
    assert len(before - _files(spark, path)) <= 1
    edited = spark.createDataFrame([(5, "c"), (7000, "c"), (None, "lost")], "id long, v string")
    for _ in range(2):  # run again, as after a failure
        assert merge_keyed(edited, path, "id", merge) == 2
    rows = [(r.id, r.v) for r in read_keyed(spark, path).collect()]
    assert len(rows) == 10200 == len(dict(rows)) and {k for k, v in rows if v == "c"} == {5, 7000}


def test_empty_keyed_table(spark):
    from lexframe.sources.norms import merge_keyed, read_keyed, write_keyed
    path = scratch_path(spark, "t")
    empty = spark.createDataFrame([], "id long, v string")
    assert write_keyed(empty, path, "id").count() == 0
    merge = lambda old, new: U.merge_embeddings(old, new, "id", new.columns)[0]
    merge_keyed(empty, path, "id", merge)
    merge_keyed(spark.createDataFrame([(-3, "x")], empty.schema), path, "id", merge)
    merge_keyed(empty, path, "id", merge)
    assert [tuple(r) for r in read_keyed(spark, path).collect()] == [(-3, "x")]


def test_stream_merge_loses_no_batch_and_keeps_the_newest(spark):
    from pyspark.sql import types as T
    from lexframe.schemas import NORM_RAW_SCHEMA
    from lexframe.sources.norms import create_embeddings_table, read_keyed
    from lexframe.streaming.streams import merge_norm_batch

    schema = T.StructType(NORM_RAW_SCHEMA.fields + [T.StructField("scrape_date", T.DateType())])

    def day(date, **rows):
        names = [f.name for f in NORM_RAW_SCHEMA.fields]
        return spark.createDataFrame([tuple({"id_norma": k[1:], "texto_resumido": v}.get(n) for n in names) + (date,) for k, v in rows.items()], schema)

    path = scratch_path(spark, "emb")
    first = spark.createDataFrame([(1, "created", "t"), (9, "---", "t")], "id_norma long, texto_resumido string, titulo_resumido string")
    create_embeddings_table(first, path, dim=8)
    now = lambda: {r.id_norma: r.content for r in read_keyed(spark, path).collect()}
    assert now() == {1: "created"}  # a failed embedding is not in the table
    d = dt.date
    merge_norm_batch(day(d(2025, 10, 2), _1="newest text", _2="two"), 0, path, path + "_r", 8)
    assert now() == {1: "newest text", 2: "two"}
    merge_norm_batch(day(d(2025, 10, 2), _1="replayed"), 0, path, path + "_r", 8)  # a replay
    merge_norm_batch(day(d(2025, 10, 1), _1="older backfill", _3="three"), 1, path, path + "_r", 8)
    assert now() == {1: "newest text", 2: "two", 3: "three"}
    merge_norm_batch(day(d(2025, 10, 3), _2="second stream", _4="!!!"), 0, path, path + "_r", 8)
    assert now() == {1: "newest text", 2: "second stream", 3: "three"}
    assert [r.id_norma for r in spark.read.parquet(path + "_r/embeddings").collect()] == [4]


def test_same_day_corrections_and_two_files_of_a_day(spark, tmp_path):
    """An id in row 3 of a day, then in row 1 of a smaller, later file; by stream and by batch load."""
    import os
    from lexframe.schemas import NORM_COLUMNS
    from lexframe.sources.norms import load_master, quarantine, read_keyed, scan_norms_raw
    from lexframe.streaming.streams import stream_merge_norms
    line = lambda i, t: ",".join([str(i)] + [t if c == "texto_resumido" else "" for c in NORM_COLUMNS[1:]])
    inbox, table, ckpt = str(tmp_path / "in"), scratch_path(spark, "emb"), scratch_path(spark, "ckpt")
    day = tmp_path / "in" / "scrape_date=2025-10-01"
    day.mkdir(parents=True)

    def drop(name, rows, when):
        path = day / name
        path.write_text("\n".join([",".join(NORM_COLUMNS), *(line(i, t) for i, t in rows)]) + "\n")
        os.utime(path, (when, when))

    def now():
        stream_merge_norms(spark, inbox, table, ckpt, dim=8).awaitTermination()
        return {r.id_norma: r.content for r in read_keyed(spark, table).collect()}

    drop("z-big.csv", [(5, "five " * 50), (6, "six " * 50), (7, "old"), (7, "old again")], 1_700_000_000)
    assert now()[7] == "old again"
    drop("a-small.csv", [(7, "corrected")], 1_700_000_100)
    assert now()[7] == "corrected"
    drop("b-late-copy.csv", [(7, "stale copy of an older file")], 1_600_000_000)
    assert now()[7] == "corrected"
    good, _ = quarantine(scan_norms_raw(spark, inbox))
    master = load_master(good, scratch_path(spark, "master"), "1")
    assert {r.id_norma: r.texto_resumido for r in master.collect()}[7] == "corrected"
    ckpt = scratch_path(spark, "ckpt")  # a new stream reads all files again
    assert now()[7] == "corrected"


def test_rows_without_an_id_are_rejects(spark):
    from pyspark.sql import types as T
    from lexframe.schemas import NORM_RAW_SCHEMA
    from lexframe.sources.norms import read_keyed
    from lexframe.streaming.streams import merge_norm_batch
    schema = T.StructType(NORM_RAW_SCHEMA.fields + [T.StructField("scrape_date", T.DateType())])
    row = lambda i: tuple({"id_norma": i, "texto_resumido": "text"}.get(f.name) for f in NORM_RAW_SCHEMA.fields) + (dt.date(2025, 10, 1),)
    path = scratch_path(spark, "emb")
    merge_norm_batch(spark.createDataFrame([row("1"), row(None), row("x")], schema), 0, path, path + "_r", 8)
    assert [r.id_norma for r in read_keyed(spark, path).collect()] == [1]
    assert sorted((str(r.id_norma), r.reason) for r in spark.read.parquet(path + "_r/rows").collect()) == [("None", "id_norma"), ("x", "id_norma")]


def test_votes_wait_for_their_interaction(spark):
    """A vote is in one table whatever happens, and counts once its interaction is known; batches may be replayed."""
    from lexframe.streaming.streams import accepted_votes, feedback_batch
    path = scratch_path(spark, "votes")
    ids = lambda *known: spark.createDataFrame([(i,) for i in known], "interaction_id long")
    vote = lambda *rows, t=1, v=True: spark.createDataFrame([(i, i, v, dt.datetime(2024, 1, t)) for i in rows],
                                                            "vote_id long, interaction_id long, is_positive boolean, ts timestamp_ntz")
    got = lambda *known: [sorted((r.interaction_id, r.is_positive) for r in x.collect()) for x in accepted_votes(spark, path, ids(*known))]
    feedback_batch(vote(1, 2), path)
    assert got(1) == [[(1, True)], [(2, True)]]
    feedback_batch(vote(3), path)
    feedback_batch(vote(3), path)  # a replay
    assert got(1, 2) == [[(1, True), (2, True)], [(3, True)]]
    feedback_batch(vote(2, t=5, v=False), path)
    feedback_batch(vote(2, t=3), path)  # late
    assert got(1, 2, 3) == [[(1, True), (2, False), (3, True)], []]
    assert accepted_votes(spark, path)[0].count() == 3


def test_consumed_staging_is_recorded_once(spark, monkeypatch):
    from lexframe.sources import norms as N
    path, log = scratch_path(spark, "staging"), scratch_path(spark, "consumed")
    cols = [F.lit(None).cast(f.dataType).alias(f.name) for f in N.NORM_SCHEMA.fields]
    rows = spark.range(4).select(*cols, F.to_date(F.lit("2025-10-01")).alias("scrape_date"))
    N.append_staging(rows, path)
    truncate = N.truncate_staging
    monkeypatch.setattr(N, "truncate_staging", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        N.consume_staging(spark, path, log, "a")
    monkeypatch.setattr(N, "truncate_staging", truncate)
    for _ in range(2):  # the run again, and once more after it was done
        assert [(r.rows, r.load) for r in N.consume_staging(spark, path, log, "a").collect()] == [(4, "a")]
    assert spark.read.parquet(path).count() == 0


def test_embedder_failures_cost_one_row_each():
    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0, 2.0][: 1 if t == "short" else 2] for t in texts]
    vecs, status = R.embed_rows(embedder, ["a", "bad", "short", "b"], 2)
    assert vecs == [[1.0, 2.0], [], [], [1.0, 2.0]] and status == ["", "error: ValueError", "dimension 1", ""]


def test_centres_come_from_the_whole_corpus(spark):
    rows = [(i, [float(i // 500), 0.5]) for i in range(4000)]  # eight topics, stored in order
    df = spark.createDataFrame(rows, "id long, vec array<float>").repartition(8, "id")
    topics = [c[0] for c in R._sample_centres(spark.createDataFrame(rows, "id long, vec array<float>").coalesce(1)
                                             .withColumn("vec", F.expr("transform(vec, x -> x + id / 1e6f)")), "vec", 64, 7, 4000)]
    assert len({int(t + 0.3) for t in topics}) == 8 and df.count() == 4000


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexframe.session import checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_untouched_conversations_stay_as_they_are(spark):
    from lexframe.operators.conversations import touch_conversations
    t = dt.datetime(2024, 1, 1)
    conv = spark.createDataFrame([(1, "u", None, t, t), (2, "u", "x", t, t)], "id long, user_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(2, dt.datetime(2024, 1, 2), "message", None, None), (3, t, "message", None, None), (4, t, "rename", "r", None)],
                               "id long, ts timestamp_ntz, kind string, title string, user_id string")
    got = {r.id: (r.title, r.updated_at.day) for r in touch_conversations(conv, ch).collect()}
    assert got == {1: (None, 1), 2: ("x", 2)}  # no row for the unknown ids 3 and 4


def test_unknown_media_types_are_refused(spark):
    from lexframe.operators.usage import intake_documents
    batch = spark.createDataFrame([(1, "a.pdf", None), (2, "a.pdf", "application/pdf")], "ord long, filename string, content_type string")
    got = {r.ord: r.status for r in intake_documents(batch, spark.createDataFrame([], "filename string")).collect()}
    assert got == {1: "failed", 2: "accepted"}


def test_health_checks_are_not_logged(spark):
    log = spark.createDataFrame([("a", "/health", 500, 1.0), ("b", "/x", 500, 1.0)], "request_id string, http_path string, status_code int, duration_ms double")
    assert [r.request_id for r in P.tail_sample(log, 1000.0, 0.0).collect()] == ["b"]


def test_positional_rank_splits_a_hot_group(spark):
    from pyspark.sql import Window
    rows = [(0 if i % 3 == 0 else i % 50, i) for i in range(3000)]  # group 0 holds a third
    df = spark.createDataFrame(rows, "g long, o long")
    got = C.positional_rank(df, "g", ["o"], slices=8)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_recursive_chunks(spark):
    words = " ".join(f"w{i}" for i in range(900))
    text = "Titulo\n\n" + words + "\n\nCierre corto.\n" + "x" * 2500
    docs = spark.createDataFrame([(1, text, "a/b.pdf"), (2, "", "c"), (3, "hola", None)],
                                 "doc_id long, text string, source string")
    rows = R.chunk_documents(docs, mode="recursive", size=2000, overlap=200).orderBy("doc_id", "chunk_ix").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert all(len(r.text) <= 2000 for r in one)
    assert all(text[r.start_index:r.start_index + len(r.text)] == r.text for r in one)
    assert [r.start_index for r in one] == sorted(r.start_index for r in one)
    covered = set()
    for r in one:
        covered.update(range(r.start_index, r.start_index + len(r.text)))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())
    assert [(r.doc_id, r.text) for r in rows if r.doc_id != 1] == [(3, "hola")]
    small = lambda t, n, o: [r.text for r in R.chunk_documents(spark.createDataFrame([(1, t, "")], "doc_id long, text string, source string"),
                                                               mode="recursive", size=n, overlap=o).orderBy("chunk_ix").collect()]
    assert small("a b c", 3, 1) == ["a b", "c"]
    assert small("a b c d", 5, 2) == ["a b c", "c d"]


@pytest.mark.parametrize("strategy", ["cells", "broadcast"])
def test_knn_other_metrics_equal_brute_force(spark, strategy):
    import random

    import numpy as np
    rnd = random.Random(5)
    corpus = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    queries = [(1000 + j, [rnd.gauss(0, 1) for _ in range(6)]) for j in range(20)]
    c = spark.createDataFrame(corpus, "id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    cf = {r.id: np.array(r.embedding, dtype=float) for r in c.collect()}
    for metric in ("cosine", "ip"):
        got = {}
        for r in R.knn(q, c, k=3, metric=metric, n_cells=8, block_rows=50, strategy=strategy).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        for qr in q.collect():
            v = np.array(qr.embedding, dtype=float)
            if metric == "ip":
                d = {i: -float(v @ x) for i, x in cf.items()}
            else:
                d = {i: 1 - float(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)) for i, x in cf.items()}
            want = [i for _, i in sorted((dv, i) for i, dv in d.items())[:3]]
            assert [i for _, i in sorted(got[qr.query_id])] == want, metric


def test_global_top_with_remainder(spark):
    df = spark.createDataFrame([(f"f{i:02d}", i % 4) for i in range(12)], "filename string, c long")
    rows = S.top_with_remainder(df, [F.desc("c"), F.asc("filename")], 5).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and {r.remainder for r in rows} == {7}
    assert [r.filename for r in rows] == ["f03", "f07", "f11", "f02", "f06"]


def test_touch_conversations_golden(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    convs = spark.createDataFrame([(1, "u1", "New Conversation", t[0], t[0]), (2, "u1", "Old", t[0], t[0]),
                                   (3, "u2", "X", t[0], t[0])],
                                  "id long, user_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, t[1], "message", None, None), (2, t[2], "rename", "  Nuevo titulo  ", None),
                                     (2, t[3], "rename", "   ", None), (3, t[1], "delete", None, None),
                                     (4, t[1], "create", None, "u9"), (5, t[2], "create", "Hola", "u9")],
                                    "id long, ts timestamp_ntz, kind string, title string, user_id string")
    got = [tuple(r) for r in C.touch_conversations(convs, changes).orderBy("id").collect()]
    assert got == [(1, "u1", "New Conversation", t[0], t[1]), (2, "u1", "Nuevo titulo", t[0], t[2]),
                   (4, "u9", "New Conversation", t[1], t[1]), (5, "u9", "Hola", t[2], t[2])]


def test_search_on_an_empty_store_gives_the_notice(spark):
    qs = spark.createDataFrame([(1, "ley de presupuesto"), (2, "decreto")], "query_id long, text string")
    recs = spark.createDataFrame([], "id long, text string, source string")
    got = {r.query_id: r.context for r in R.search(qs, recs, k=4, dim=32).collect()}
    assert got == {1: R.EMPTY_STORE_NOTICE, 2: R.EMPTY_STORE_NOTICE}


@pytest.mark.parametrize("strategy", ["auto", "broadcast"])
def test_knn_without_query_vectors_gives_no_hits(spark, strategy):
    c = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    blank = spark.createDataFrame([(7, [])], "query_id long, embedding array<float>")
    assert R.knn(none, c, k=1, strategy=strategy).count() == 0
    assert R.knn(blank, c, k=1, strategy=strategy).count() == 0
    qs = spark.createDataFrame([(1, "!!!")], "query_id long, text string")  # no token: no hit, though the store has text
    recs = spark.createDataFrame([(1, "ley", "a.pdf")], "id long, text string, source string")
    assert R.search(qs, recs, k=1, dim=16).first().context == ""


def test_search_finds_the_passage(spark):
    recs = spark.createDataFrame([(1, "el presupuesto nacional de salud para el año", "a/ley.pdf"),
                                  (2, "los perros y los gatos del barrio", "b/otro.pdf"),
                                  (3, "reglamento de tránsito y seguridad vial", "c/vial.pdf")],
                                 "id long, text string, source string")
    qs = spark.createDataFrame([(9, "presupuesto de salud")], "query_id long, text string")
    ctx = R.search(qs, recs, k=1, dim=256).first().context
    assert ctx == "Source: ley.pdf\nContent: el presupuesto nacional de salud para el año"


def test_scrape_metrics_counts_missing(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20)], "page_id long, norm_id long")
    scraped = spark.createDataFrame([("10",), ("12",), ("99",)], "id_norma string")
    got = {r.page_id: (r.ids_found, r.rows_scraped, r.missing) for r in S.scrape_metrics(found, scraped).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 0, 1)}


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    """3,000 texts in batches of 8: a load per worker, not per batch; batches are sorted by length; order is kept."""
    loads, calls = str(tmp_path / "loads"), str(tmp_path / "calls")

    def load():
        with open(loads, "a") as f:
            f.write("x")

        def embedder(texts):
            with open(calls, "a") as f:
                f.write(f"{len(texts)} {max(map(len, texts)) - min(map(len, texts))}\n")
            return [[float(len(t)), 2.0] for t in texts]
        return embedder

    docs = spark.range(3000, numPartitions=6).select(F.col("id").alias("id_norma"), F.when(F.col("id") != 5, F.repeat(F.lit("w"), F.pmod("id", F.lit(50)).cast("int"))).alias("content"))
    out = R.embed(docs, title_col=None, dim=2, model=load, batch_size=8).collect()
    assert all(r.ml_generate_embedding_result == [0.0 if r.id_norma == 5 else r.id_norma % 50, 2.0] for r in out) and len(out) == 3000
    spreads = [tuple(map(int, x.split())) for x in open(calls)]
    assert len(open(loads).read()) <= 8 and len(spreads) >= 375 and max(n for n, _ in spreads) == 8
    assert sum(s for _, s in spreads) / len(spreads) < 10


def test_metrics_of_a_load_without_a_second_read(spark):
    from lexframe.sources.norms import write_version
    rows = spark.createDataFrame([(1, dt.date(2025, 10, 2)), (None, dt.date(2025, 10, 1)), (3, None)], "id_norma long, scrape_date date")
    out, metrics = S.observed(rows)
    write_version(out, scratch_path(spark, "m"), "1")
    assert metrics.get == {"rows": 3, "without_key": 1, "first": dt.date(2025, 10, 1), "last": dt.date(2025, 10, 2)}
