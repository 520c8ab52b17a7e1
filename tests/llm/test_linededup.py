from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexframe.llm import linededup as L
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def brute(rows, ratio, least, copies_once=True, min_kept=0.5):
    pages, seen = Counter(), defaultdict(Counter)
    ws = " \t\n\x0b\x0c\r"
    for host, text in ({(h, t) for _, h, t in rows} if copies_once else [(h, t) for _, h, t in rows]):
        pages[host] += text is not None or not copies_once
        for line in {x.strip(ws) for x in (text or "").split("\n")} - {""}:
            seen[host][line] += 1
    out = []
    for i, host, text in rows:
        drop = lambda x: (n := seen[host][x.strip(ws)]) >= least and n > ratio * pages[host] and x.strip(ws) != ""
        lines = (text or "").split("\n")
        kept = [x for x in lines if not drop(x)]
        kept = lines if len("".join(kept)) < min_kept * len("".join(lines)) else kept
        out.append((i, None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, docs, awkward):
    for df, ratio, least in ((docs, 0.1, 2), (docs, 0.02, 1), (awkward, 0.3, 2), (awkward, 0.0, 1)):
        for once, kept in ((True, 0.5), (False, 0.0)):
            got = L.drop_boilerplate(df, F.col("source"), max_ratio=ratio, min_pages=least, copies_once=once, min_kept=kept)
            assert got.columns == df.columns
            rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows, ratio, least, once, kept)


def test_counts_hosts_and_boundary(spark, empty):
    # 10 pages a host: "menu" on 3 of them is exactly the ratio and stays, "foot" on 4 goes; the null host is a host.
    rows = [(i, h, f"body {h} {i}\n" + ("menu\n" if i < 3 else "") + (" foot \n\n" if i < 4 else "")) for h in ("a", None) for i in range(10)]
    df = spark.createDataFrame(rows, "n int, _host string, text string")  # a name that clashes with an internal one
    got = L.drop_boilerplate(df, F.col("_host"), max_ratio=0.3, min_pages=2, counts=("lines", "gone"), copies_once=False).collect()
    assert len(got) == 20 and sum(r.gone for r in got) == 8 and not any("foot" in r.text for r in got)
    assert sum("menu" in r.text for r in got) == 6
    assert L.drop_boilerplate(empty, F.col("source")).count() == 0


def test_copies_once(spark):
    """Copies of a page are one page, in the counts and in the host's total: "foot" is on 12 of 14
    different pages, "rare" on 3 of them (though on 3 of 34 rows), the copied lines on one."""
    rows = ([(i, "a", "copied one\ncopied two") for i in range(20)] + [(100 + i, "a", f"own {i}\nfoot" + "\nrare" * (i < 3)) for i in range(12)]
            + [(200, "a", None), (201, "a", None), (300, "b", "copied one")])
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = {r.doc_id: r.text for r in L.drop_boilerplate(df, F.col("source"), max_ratio=0.2, min_pages=3, copies_once=True, min_kept=0.0).collect()}
    assert got == {i: f"own {i - 100}" if 100 <= i < 200 else t for i, _, t in rows}
    by_row = {r.doc_id: r.text for r in L.drop_boilerplate(df, F.col("source"), max_ratio=0.2, min_pages=3, copies_once=False, min_kept=0.0).collect()}
    assert all(by_row[i] == "" for i in range(20)) and by_row[100] == "own 0\nrare"


def test_near_copies_keep_their_text(spark):
    """A third of a site's pages share all but their last line: none of them is emptied; the site's footer goes."""
    body = "\n".join(f"shared line {i} of the copied text" for i in range(8))
    rows = [(i, "a", f"{body}\nown last line {i}\nfooter") for i in range(200)] + [(1000 + i, "a", f"page {i} " * 9 + "\nfooter") for i in range(400)]
    got = {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string"), F.col("source")).collect()}
    assert all(got[i].startswith(body) for i in range(200)) and not any("footer" in got[1000 + i] for i in range(400))
