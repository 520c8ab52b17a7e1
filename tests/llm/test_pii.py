import hashlib
import re

from lexframe.llm import pii as P
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def brute(text):
    """The contract's base spans, without any shortcut."""
    out = []
    for kind, pattern in enumerate((P.EMAIL, P.IP, P.CARD, P.PHONE)):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark, docs, awkward):
    extra = spark.createDataFrame([(50, "a@b.c x@y 1.2.3.4.5 300.1.1.1 0001.02.3.4 4111-1111 1111 1111 +1 (555) 1234567. +12 é\U0001F600 é@x.y +1.2.3.4"),
                                   (51, "999.999.999.999 4111111111111112 " * 30)], "doc_id long, text string")
    for df in (docs, awkward, extra):
        got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in P.digests(P.extract(df)).collect()}
        want = set()
        for r in df.collect():
            spans = brute(r.text)
            digest = hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
            want.add((r.doc_id, *(sum(k == j for _, k, _ in spans) for j in range(4)), digest))
        assert got == want


def test_confident_patterns_discover_unseen_identifiers(spark):
    known = [(i, f"text {i} call me at +1 (555) 010-{1000 + i} now") for i in range(8)]
    unseen = [(100, "she said call me at 555-0199-77 now"), (101, "the price of 555-0199-88 things"), (102, "call me at home now"),
              (103, "twice 555-0199-77 without its context")]
    df = spark.createDataFrame(known + unseen, "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digests(P.extract(df)).collect()}
    assert rows[100].spans == "phone:20:31" and rows[100].n_phone == 0  # counts and digest are the base's
    assert rows[101].spans == rows[102].spans == "" and rows[103].spans == "phone:6:17"
    assert all(rows[i].n_phone == 1 and rows[i].spans.startswith("phone:") for i in range(8))
    # The same word pair before many other numbers makes the pattern worthless.
    noise = [(200 + i, f"call me at {70000 + i} now") for i in range(30)]
    rows = {r.doc_id: r for r in P.digests(P.extract(spark.createDataFrame(known + unseen + noise, "doc_id long, text string"))).collect()}
    assert rows[100].spans == ""


def test_scores_equal_a_loop(spark):
    """Rounds of the pattern-instance graph in plain Python."""
    graph = [(3, f"s{i}", ["a", "b"]) for i in range(6)] + [(None, "x", ["a", "c"]), (0, "m", ["a"])] \
        + [(None, f"y{i}", ["c"]) for i in range(5)] + [(3, f"t{i}", ["c"]) for i in range(60)]
    df = spark.createDataFrame(graph, "kind int, instance string, patterns array<string>")
    seeds = {i: (k, 1.0) for k, i, _ in graph if k is not None}
    members = {}
    for _, i, ps in graph:
        for p in ps:
            members.setdefault(p, set()).add(i)
    known, found = dict(seeds), {}
    for _ in range(2):
        sure = {}
        for p, inst in members.items():
            for kind in (0, 3):
                hits = [known[i][1] for i in inst if i in known and known[i][0] == kind]
                if len(hits) >= 5 and sum(hits) / len(inst) >= 0.7:
                    sure[p] = max(sure.get(p, (0, 0)), (sum(hits) / len(inst), -kind))
        found = {}
        for p, best in sure.items():
            for i in members[p] - set(seeds):
                found[i] = max(found.get(i, (0, 0)), best)
        known = seeds | {i: (-k, c) for i, (c, k) in found.items()}
    got = {r.instance: (round(r.score, 9), -r.kind) for r in P.discover(df, rounds=2, confidence=0.7).collect()}
    assert got == {i: (round(c, 9), k) for i, (c, k) in found.items()} and len(got) == 6


def test_columns_and_empty(awkward, empty):
    out = P.extract(awkward)
    assert out.columns == [*(c for c in awkward.columns if c != "text"), "spans"] and out.count() == awkward.count()
    assert P.extract(empty).count() == 0


def test_search_equals_the_patterns():
    """Searching outwards and from run starts finds what the plain patterns find, on strings made of their characters."""
    import random
    rnd = random.Random(7)
    token = re.compile(r"[^\s=:\"'<>,;|]*[0-9@][^\s=:\"'<>,;|]*(?:[ ][(]?[0-9][0-9().-]*(?=[\s,;:]|$))*")
    for _ in range(4000):
        text = "".join(rnd.choice("a.-@@1205  +(:;,é%" if rnd.random() < 0.9 else "...1.2") for _ in range(rnd.randrange(40)))
        assert [(s, k, e) for k, s, e in P.base_spans(text)] == brute(text)
        assert [m.span() for m in P._TOKEN.finditer(text)] == [m.span() for m in token.finditer(text)]
        base = P.base_spans(text)
        for kind, s, e, *_ in P.scan_text(text):
            assert kind is not None or not any(a < e and s < b for _, a, b in base)


def test_long_unbroken_runs_and_numbers():
    """A million characters without a break, in seconds; digits beyond what an integer may have."""
    import time
    n = 10 ** 6
    start = time.time()
    for text in ("字" * n + "1", "1" * n, "a" * n + "@", "a." * (n // 2) + "@b", "1." * (n // 2), "@" * n, "a@" * (n // 2), "+1" * (n // 2),
                 "(" * n + "12345", "a@b.c " * 20000 + "12345 " * 20000):
        P.scan_text(text)
    assert time.time() - start < 60
    assert P.base_spans("x " + "0" * 5000 + "1.2.3.4 " + "9" * 5000 + ".1.1.1") == [(1, 2, 5009)]
