import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexframe.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Plain version of ``damaged``: (conv_id, turn, role, text) or (conv_id,) for a dropped row."""
    for c, t, r, x in rows:
        sp = lambda v: " " if v is None else v
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        r, x = sp(r), sp(x)
        if k == 0:
            yield (c,)
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        for _ in range(2 if k == 3 else 1):
            yield (c, t, "user" if k == 4 else r, x)


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        solid = _SOLID.findall(x)
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def search(rows, insert=5):
    """Cheapest edits by trying all: every edit of every row, up to two inserts in every gap."""
    kinds, best = faults(rows), None
    choices = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    gaps = ["", "u", "a", "ua", "au"]
    for ops in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            audit, roles, lines, cost = "", "", [], 0
            for i in range(len(rows) + 1):
                for g in ins[i]:
                    audit, roles, cost = audit + "I", roles + g, cost + insert
                    lines.append({"u": "user:", "a": "assistant:"}[g])
                if i < len(rows):
                    op, (_, r, x) = ops[i], rows[i]
                    audit += op[0]
                    cost += {"D": 2, "K": 0, "R": 1}[op[0]] + (5 if op != "D" and kinds[i] == "truncated" else 0)
                    if op != "D":
                        role = r if op == "K" else {"u": "user", "a": "assistant"}[op[1]]
                        roles, lines = roles + (role[:1] or "?"), lines + [f"{role}:{x}"]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return best


def plain(rows):
    """The whole result by brute force."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damage([r for r in rows if r[0] == c]) if len(r) > 1), key=lambda r: (r[0] is not None, r))
        turns = [t for t, _, _ in own if t is not None]
        kinds = faults(own)
        cost, audit, sha, lines = search(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                  kinds.count("truncated"), illegal, cost, audit, sha, lines)
    return out


def results(turns, **kw):
    audits = R.repair(turns, **kw)
    fixed = {}
    for r in sorted(R.repaired_turns(turns, audits).collect(), key=lambda r: (str(r.conv_id), r.place)):
        fixed.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    rows = audits.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256, fixed.get(r.conv_id, [])) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for c in range(100):
        for t in range(rnd.randrange(1, 4)):
            out.append((c, rnd.choice([t, t, t + 2, 1, None]), rnd.choice(["user", "assistant", "system", "usher", "", None, "tool"]),
                        rnd.choice(["a.", "b!", "no end", " ", "", None, "x? \n", "é\x1c"]), "clash"))
    return out + [out[0], out[0], (None, 1, "user", "hi.", ""), (None, None, "assistant", "hi.", ""), (-5, 1, "system", "only.", "")]


def test_against_all_edits(spark, rows):
    want = plain([r[:4] for r in rows])
    assert results(R.damaged(spark.createDataFrame(rows, SCHEMA))) == want
    assert len({v[6] for v in want.values()}) > 10


@pytest.mark.parametrize("insert", [1, 2])
def test_cheap_inserts(monkeypatch, insert):
    """At a price of 5 deleting always beats inserting, so the inserts are tried at a lower one."""
    monkeypatch.setattr(R, "INSERT", insert)
    rnd, audits = random.Random(insert), set()
    for _ in range(400):
        rows = [(t, rnd.choice(["user", "assistant", "system", " "]), rnd.choice(["a.", "b", "c!", " "])) for t in range(rnd.randrange(4))]
        program = R._Program()
        for (_, role, text), kind in zip(rows, faults(rows)):
            program.turn(role, text, kind in ("blank", "duplicate"), kind == "truncated")
        cost, sha, place, n = program.end()
        audit, _, first = R._walk(program.pointers, place, n)
        assert (cost, "I" * first + audit, sha) == search(rows, insert)[:3]
        audits.add("I" * first + audit)
    assert sum("I" in a for a in audits) > 10


@pytest.mark.parametrize("chunk", [1, 2])
def test_spilled_pointers(spark, rows, chunk):
    turns = R.damaged(spark.createDataFrame(rows, SCHEMA)).cache()
    assert results(turns, chunk=chunk) == results(turns)


def test_giant_conversation_across_batches(spark):
    """25,000 turns: more than two Arrow batches, pointers in chunks; the same as one piece."""
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant"]), f"{rnd.randrange(20000)} {rnd.choice('.,!')}") for t in range(25000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = results(turns), results(turns, chunk=3000)
    assert a == b and a[7][2] > 1000 and len(a[7][6]) >= 25000
    assert hashlib.sha256("\n".join(a[7][8]).encode()).hexdigest() == a[7][7]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in a[7][8]))


def test_very_long_text_and_empty_table(spark):
    long = "word " * 400000 + "."
    got = results(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok.")], "conv_id long, turn long, role string, text string"))
    assert got[1][6] == "KK" and got[1][8][0] == "user:" + long
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_seen_digests_in_runs():
    seen = R._Seen()
    digests = [hashlib.md5(str(i).encode()).digest() for i in range(200000)]
    assert not any(seen.add(d) for d in digests) and len(seen.old)
    assert all(seen.add(d) for d in digests[::97])
