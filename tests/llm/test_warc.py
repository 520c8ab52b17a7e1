import hashlib
import random
import tempfile

import pytest

from lexframe.llm import warc as W

SCHEMA = "page_id long, url string, html string, type string, at long"
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: %d\r\n\r\n"


def plain(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, rows[i][1] or ""))
    first, out = {}, []
    for i in order:
        data = (rows[i][2] or "").encode()
        sha = hashlib.sha256(data).hexdigest()
        copy = len(data) >= least and sha in first
        out.append((rows[i][0], len(data), sha, "revisit" if copy else "response", first[sha] if copy else None))
        first.setdefault(sha, rows[i][0])
    return sorted(out, key=str)


def read(spark, path):
    index = W.Archives(spark, path).index()
    return sorted((tuple(r) for r in index.select(W.page_number(W.F.col("record_id")), "payload_bytes", "payload_digest", "type",
                                                  W.page_number(W.F.col("refers_to"))).collect()), key=str)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="warc-test-") + "/a"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(300):
        body = "".join(rnd.choice(["<p>x</p>\n", "\r\n", "é\U0001F600", "WARC/1.0", "WARC/1.0\r\n", "WARC/1.WARC/1.0\r\n\r\n\r\n", FAKE % rnd.randrange(0, 5000), "text " * 20])
                       for _ in range(rnd.randrange(30)))
        out.append((i, f"http://x/{i}", body, "t", 3))
    big = "w " * 200000 + FAKE % 10 + "z" * 300000
    out += [(400, None, big, "t", 1), (401, "http://x/a b\r\nWARC/1.0\r\n", "é" * 60, "t", 1), (402, "u", None, None, None), (403, "u", "", None, None)]
    out += [(c, f"http://copy/{c}", "<html>" + "copy " * 50 + FAKE % 7 + "</html>", "t", 1) for c in range(500, 800)]
    return out + [out[3], out[3], out[-1], (None, "n", "null id " * 30, "", 1), (None, None, "null id " * 30, "", 1), (None, None, "short", "", 1),
                  (5, "s", "x" * 99, "", 1), (6, "s", "x" * 99, "", 1), (7, "s", "y" * 100, "", 1), (8, "s", "y" * 100, "", 1)]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_round_trip(spark, rows, folder, compression):
    W.write(spark.createDataFrame(rows, SCHEMA), folder, compression=compression)
    got = read(spark, folder)
    assert got == plain(rows) and sum(r[3] == "revisit" for r in got) > 300


@pytest.mark.parametrize("split", [20011])
def test_many_blocks(spark, rows, folder, split):
    """One file in many splits, whose borders fall inside headers, payloads and magic."""
    W.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        archives = W.Archives(spark, folder)
        assert archives.blocks.count() > 8
        assert read(spark, folder) == plain(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_contents(spark, rows, folder):
    W.write(spark.createDataFrame(rows, SCHEMA), folder)
    archives = W.Archives(spark, folder)
    got = archives.contents(archives.index()).where("type = 'response'").select("payload", "payload_digest", "declared").collect()
    want = sorted((r[2] or "") for r in {i: x for i, x in enumerate(rows)}.values())
    assert {bytes(r.payload).decode() for r in got} == set(want)
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest == r.declared.removeprefix("sha256:") for r in got)


def test_damaged_files(spark, folder):
    """Bytes of other writers: a bare record type, folded header lines, a broken chain, a cut file, a file that is none."""
    def record(body, extra=b""):
        return W.MAGIC + b"WARC-Type: resource\r\n" + extra + b"content-length:%d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    fake = record(b"inner")
    files = {"a": record(b"one") + record(fake + fake) + record(b"two", b"X-Long: a\r\n  b\r\n") + b"junk" + record(b"lost"),
             "b": record(b"three") + record(b"cut off")[:-6], "c": b"junk" + record(b"never"), "d": b"", "e": record(b"") + W.MAGIC}
    import os
    os.makedirs(folder)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    archives = W.Archives(spark, folder)
    index = archives.index()
    got = sorted((r.file[-1], r.at, r.payload_bytes) for r in index.collect())
    assert got == [("a", 0, 3), ("a", len(record(b"one")), 2 * len(fake)), ("a", len(record(b"one") + record(fake + fake)), 3), ("b", 0, 5), ("e", 0, 0)]
    assert sorted(bytes(r.content) for r in archives.contents(index).collect()) == sorted([b"one", fake + fake, b"two", b"three", b""])


def test_chains():
    import numpy as np
    r, n = np.array([0, 10, 12, 30, 45]), np.array([10, 30, 45, 60, 45 + 99])
    assert W._exits(r, n).tolist() == [60, 60, 144, 60, 144]
    assert W._exits(r[:0], n[:0]).tolist() == []


def test_empty_table(spark, folder):
    W.write(spark.createDataFrame([], SCHEMA), folder)
    assert read(spark, folder) == []
