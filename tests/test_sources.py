"""Golden cases of the scans and sinks (FIXTURES.md "CSV null tokens")."""

import pytest

import datetime as dt
import os

from pyspark.sql import functions as F

from lexframe.schemas import NORM_COLUMNS
from lexframe.session import scratch_path
from lexframe.sources import norms as N

HEADER = ",".join(NORM_COLUMNS)


def _day_file(spark, day: str, body: str) -> str:
    root = scratch_path(spark, "csv-golden")
    d = os.path.join(root.replace("file:", ""), f"scrape_date={day}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part-0.csv"), "w", encoding="utf-8") as f:
        f.write(HEADER + "\n" + body)
    return root


def _row(**kw):
    vals = {c: "" for c in NORM_COLUMNS}
    vals.update(kw)
    out = []
    for c in NORM_COLUMNS:
        v = str(vals[c])
        out.append('"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\n') else v)
    return ",".join(out)


def test_null_tokens_multiline_and_blank_lines(spark):
    body = "\n".join([
        _row(id_norma=1, numero_norma="S/N", fecha_sancion="2024-01-02", modifica_a=0, modificada_por=0),
        "",
        _row(id_norma=2, numero_norma="s/n", titulo_resumido='dos "lineas"\nsegunda', fecha_sancion="2024-01-03",
             modifica_a=3, modificada_por=0),
    ]) + "\n"
    root = _day_file(spark, "2025-10-01", body)
    rows = {r.id_norma: r for r in N.scan_norms(spark, root).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].numero_norma is None and rows[1].observaciones is None
    assert rows[1].fecha_sancion == dt.date(2024, 1, 2) and rows[1].scrape_date == dt.date(2025, 10, 1)
    assert rows[2].numero_norma is None and rows[2].titulo_resumido == 'dos "lineas"\nsegunda'
    assert rows[2].modifica_a == 3


def test_bad_date_goes_to_quarantine(spark):
    root = _day_file(spark, "2025-10-02", _row(id_norma=7, fecha_sancion="bad") + "\n"
                     + _row(id_norma=8, fecha_sancion="2024-02-31", pagina_boletin="x") + "\n")
    good, bad = N.quarantine(N.scan_norms_raw(spark, root))
    assert good.count() == 0
    assert {(r.id_norma, r.reason) for r in bad.collect()} == {("7", "fecha_sancion"),
                                                               ("8", "fecha_sancion,pagina_boletin")}


def test_write_then_scan_round_trip_keeps_load_order(spark):
    rows = [(i, f"t{i}", dt.date(2025, 10, 1 + (i % 2))) for i in range(6)]
    df = spark.createDataFrame(rows, "id_norma long, texto_resumido string, scrape_date date")
    for c in NORM_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    root = scratch_path(spark, "daily")
    N.write_norms_csv(df, root)
    back = N.scan_norms_raw(spark, root)
    assert back.count() == 6
    assert back.select("scrape_date").distinct().count() == 2
    files = back.select(F.input_file_name()).distinct().count()
    assert files == 2  # one file per day


def test_workdays_skip_weekends(spark):
    days = [r.scrape_date for r in N.workday_partitions(spark, "2025-10-01", "2025-10-08").orderBy("scrape_date").collect()]
    assert days == [dt.date(2025, 10, d) for d in (1, 2, 3, 6, 7, 8)]


def test_load_master_keeps_last_and_moves_pointer(spark):
    rows = [(1, "a", dt.date(2025, 10, 1), 0), (1, "b", dt.date(2025, 10, 2), 0), (2, "c", dt.date(2025, 10, 1), 0),
            (2, "d", dt.date(2025, 10, 1), 1)]
    df = spark.createDataFrame(rows, "id_norma long, texto_resumido string, scrape_date date, _ord long")
    path = scratch_path(spark, "master")
    N.load_master(df, path, "1")
    got = {r.id_norma: r.texto_resumido for r in N.read_current(spark, path).collect()}
    assert got == {1: "b", 2: "d"}
    N.load_master(df.where("id_norma = 1"), path, "2")
    assert N.read_current(spark, path).count() == 1


def test_archive_size_and_truncate_and_clear(spark):
    df = spark.range(1000).withColumn("x", F.lit("y"))
    uri, mb = N.archive_snapshot(df, scratch_path(spark, "archive"), "2025-12-31")
    assert uri.endswith("snapshot_date=2025-12-31") and mb >= 0.0
    assert spark.read.parquet(uri).count() == 1000
    st = scratch_path(spark, "staging")
    N.truncate_staging(spark, st)
    assert spark.read.parquet(st).count() == 0
    ch = scratch_path(spark, "chunks")
    N.write_chunks(spark.range(5).withColumnRenamed("id", "doc_id"), ch)
    assert N.clear_chunks(spark, ch) == 5 and spark.read.parquet(ch).count() == 0


def test_sql_functions(spark):
    from lexframe.functions.register import register_functions
    register_functions(spark)
    r = spark.sql("""SELECT norm_date('01-ENE-2024') AS a, norm_date('31/02/2024') AS b, norm_date(' 2/1/2024 ') AS c,
                            source_name('x/y/z.pdf') AS d, source_name(NULL) AS e, resolve_url('p.htm', 'http://b/') AS f,
                            workday_add(DATE '2025-10-01', 3) AS g""").first()
    assert (r.a, r.b, r.c) == (dt.date(2024, 1, 1), None, dt.date(2024, 1, 2))
    assert (r.d, r.e, r.f, r.g) == ("z.pdf", "unknown", "http://b/p.htm", dt.date(2025, 10, 6))
    plan = spark.sql("SELECT norm_date(x) FROM VALUES ('1/1/2024') t(x)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_malformed_lines_are_rejected_not_loaded(spark, tmp_path):
    from lexframe.schemas import NORM_COLUMNS
    day = tmp_path / "scrape_date=2025-10-01"
    day.mkdir()
    good = ",".join(["7"] + [""] * 16)
    (day / "a.csv").write_text(",".join(NORM_COLUMNS) + "\n" + good + "\n8,too,few\n" + good.replace("7", "9", 1) + "\n")
    for multi_line in (True, False):
        ok, bad = N.quarantine(N.scan_norms_raw(spark, str(tmp_path), multi_line))
        assert [r.id_norma for r in ok.orderBy("_ord").collect()] == [7, 9]
        assert [r.reason for r in bad.collect()] == ["malformed line"]
    with pytest.raises(ValueError, match="rejects_path"):
        N.scan_norms(spark, str(tmp_path))
    rejects = scratch_path(spark, "rejects")
    assert N.scan_norms(spark, str(tmp_path), rejects).count() == 2 and spark.read.parquet(rejects).count() == 1


def test_a_replay_rewrites_nothing_and_rows_are_not_shuffled_to_be_deduplicated(spark):
    from lexframe.operators import upsert as U
    from lexframe.session import cut_lineage, scratch_path
    from lexframe.sources.norms import merge_keyed, read_keyed
    path = scratch_path(spark, "t")
    merge = lambda old, new: U.merge_embeddings(old, new, "id", new.columns, newer=["day"])[0]
    files = lambda: {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    rows = lambda *r: spark.createDataFrame(list(r), "id long, day int, v string")
    first = rows(*((i, 2, "first") for i in range(100)))
    merge_keyed(first, path, "id", merge, rows=10, newer=["day"])
    before = files()
    for late in (first, rows((3, 1, "late"), (40, 2, "same day"))):
        assert merge_keyed(late, path, "id", merge, rows=10, newer=["day"]) == 0 and files() == before
    assert merge_keyed(rows((3, 1, "late"), (45, 3, "new"), (1000, 1, "far")), path, "id", merge, rows=10, newer=["day"]) == 2
    got = {r.id: r.v for r in read_keyed(spark, path).collect()}
    assert len(got) == 101 and got[45] == "new" and got[1000] == "far" and got[3] == "first"

    many = cut_lineage(spark.createDataFrame([(i % 50, i // 50, i, "text") for i in range(170)], "id long, day int, row long, v string"))
    last = U.last_rows(many, "id", ["day"], F.col("row"))
    assert "Exchange hashpartitioning" not in last._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, U.dedup_keep_last(many, "id", ["day", "row"]).collect()))


def _left_behind(spark, *kept):
    """Bytes in the shared scratch folder, without the tables named."""
    from lexframe.session import checkpoint_dir
    kept = tuple(k.replace("file:", "") for k in kept)
    files = (os.path.join(d, f) for d, _, names in os.walk(checkpoint_dir(spark).replace("file:", "")) for f in names if not d.startswith(kept))
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def _noise(spark, days, n=100, times=80):
    """``days`` x ``n`` norms with texts that do not compress, an id in every day."""
    text = F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f"-{k}"), "day"), 512) for k in range(times)])
    rows = spark.range(n).crossJoin(spark.createDataFrame([(d,) for d in days], "day string")).withColumn("text", text)
    return rows.select(*[{"id_norma": F.col("id"), "texto_resumido": F.col("text")}.get(c, F.lit(None).cast("string")).alias(c) for c in NORM_COLUMNS],
                       F.to_date("day").alias("scrape_date"))


def test_a_merge_leaves_no_copies_of_texts_behind(spark):
    """Two days of each id from compressed files, then a replay: what stays is the table, not checkpoints of the texts on the way."""
    from lexframe.sources.norms import read_keyed, write_norms_csv
    from lexframe.streaming.streams import merge_norm_batch, stream_merge_norms
    inbox, table = scratch_path(spark, "inbox"), scratch_path(spark, "emb")
    rows = _noise(spark, ["2025-10-01", "2025-10-02"])
    texts = rows.agg(F.sum(F.length("texto_resumido"))).first()[0]
    write_norms_csv(rows, inbox, compression="gzip")
    before = _left_behind(spark, inbox, table)
    for _ in range(2):
        stream_merge_norms(spark, inbox, table, scratch_path(spark, "ckpt"), dim=8).awaitTermination()
    merge_norm_batch(rows.withColumn("scrape_date", F.date_add("scrape_date", 1)), 0, table, table + "_other", dim=8)
    assert _left_behind(spark, inbox, table) - before < texts / 3
    want = {r.id_norma: r.texto_resumido for r in rows.where("scrape_date = '2025-10-02'").collect()}
    assert {r.id_norma: r.content for r in read_keyed(spark, table).collect()} == want and len(want) == 100


def test_a_merge_rewrites_a_part_of_the_table_at_a_time(spark, monkeypatch):
    from lexframe.operators import upsert as U
    steps, write = [], N._write_ranges
    path = scratch_path(spark, "t")
    N.write_keyed(spark.range(1000).withColumn("v", F.lit("old")), path, "id", rows=100)
    monkeypatch.setattr(N, "_write_ranges", lambda rows, p, key, width: (steps.append(rows.select(F.floor(F.col(key) / width)).distinct().count()), write(rows, p, key, width)))
    fresh = spark.range(0, 2000, 2).withColumn("v", F.lit("new"))
    assert N.merge_keyed(fresh, path, "id", lambda old, new: U.merge_embeddings(old, new, "id", new.columns)[0]) == 20 == sum(steps)
    assert max(steps) <= 5
    got = {r.id: r.v for r in N.read_keyed(spark, path).collect()}
    assert got == {i: "old" for i in range(1, 1000, 2)} | {i: "new" for i in range(0, 2000, 2)}


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_not_shuffled_for_many_keys(spark, monkeypatch, no_small_tables):
    """More keys than are broadcast one by one: they travel as bitmaps."""
    from lexframe.operators import upsert as U
    from lexframe.session import cut_lineage
    monkeypatch.setattr(U, "BROADCAST_KEYS", 10)
    shuffled = lambda df: "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()
    many = cut_lineage(spark.range(500).select((F.col("id") % 200).alias("id"), F.floor(F.col("id") / 200).alias("day"), F.col("id").alias("row"), F.lit("text").alias("v")))
    last = U.last_rows(many, "id", ["day"], F.col("row"))
    assert not shuffled(last)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, U.dedup_keep_last(many, "id", ["day", "row"]).collect()))
    stored, fresh = (cut_lineage(many.where(f"day = {d}")) for d in (0, 1))
    news = U.not_late(stored, cut_lineage(fresh.where("id < 60")), "id", ["day"])
    assert not shuffled(news) and sorted(r.id for r in news.collect()) == [*range(60, 200)]
    merged, n = U.merge_embeddings(stored, cut_lineage(fresh.where("id < 60")), "id", held=True)
    assert n == 60 and not shuffled(merged) and sorted((r.id, r.day) for r in merged.collect()) == [(i, int(i < 60)) for i in range(200)]


def test_membership_of_any_numbers(spark, monkeypatch):
    from lexframe.operators import upsert as U
    some = [-(2**62), -40000, -3, 0, 1, 5, 32768, 32769, 2**33, 2**62]
    asked = spark.createDataFrame([(i,) for i in sorted({j for i in some for j in (i - 1, i, i + 1)})] + [(None,)], "n long")
    members = spark.createDataFrame([(i,) for i in [*some, None, 5]], "n long")
    for blocks, keys in ((100, 100), (1, 100), (1, 1)):  # bitmaps, keys broadcast, keys shuffled
        monkeypatch.setattr(U, "BITMAP_BLOCKS", blocks)
        monkeypatch.setattr(U, "BROADCAST_KEYS", keys)
        got = U.with_member(asked, F.col("n"), members, "found").collect()
        assert len(got) == asked.count() and sorted(r.n for r in got if r.found) == some
    words = spark.createDataFrame([("a",), ("b",), (None,)], "w string")
    assert [r.w for r in U.with_member(words, F.col("w"), words.limit(1), "found").collect() if r.found] == ["a"]


def test_a_new_table_leaves_no_copy_of_its_texts_behind(spark):
    table = scratch_path(spark, "emb")
    rows = _noise(spark, ["2025-10-01"])
    texts = rows.agg(F.sum(F.length("texto_resumido"))).first()[0]
    before = _left_behind(spark, table)
    made = N.create_embeddings_table(rows.withColumn("id_norma", F.col("id_norma").cast("long")), table, dim=8)
    assert _left_behind(spark, table) - before < texts / 3
    assert {r.id_norma: r.content for r in made.collect()} == {r.id_norma: r.texto_resumido for r in rows.collect()}
