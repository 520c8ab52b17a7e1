import re

from lexframe.llm import rules
from llm_data import awkward, docs, empty  # noqa: F401 - fixtures


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(grams) < 3000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    m = [n, len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)]
    fails = [n < 50, 100 * m[5] > 50 * n, 10 * m[2] > n and m[2] > 0, m[1] < 2 * n, m[1] > 20 * n, 100 * m[4] > 50 * m[3]]
    return (*m, sum(1 << i for i, f in enumerate(fails) if f))


def test_ledger_equals_brute_force(spark, docs, awkward, empty):
    extra = spark.createDataFrame([(100, "a b c a b c a\na b c a b c a\n\n x"), (101, "a a a a"), (102, "a a a")], "doc_id long, text string")
    for df in (docs.where("n_chars < 9000"), awkward, extra):
        got = sorted((tuple(r) for r in rules.ledger(df).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert rules.ledger(empty).count() == 0


def test_native_plan(docs):
    plan = rules.apply_policy(rules.ledger(docs), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_policies_and_ablation_from_bits(spark):
    entries = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 4), (6, 2)], "doc_id long, fail_bits long")
    kept = {v: {r.doc_id for r in rules.apply_policy(entries, v).where("kept").collect()} for v in rules.POLICIES}
    assert kept == {1: {1, 4, 5}, 2: {1}}
    got = {r.rule: (r.failing, r.failing_alone, r.kept_without) for r in rules.ablation(entries, 2).collect()}
    assert got["symbols"] == (2, 2, 3) and got["few_words"] == (2, 1, 2) and got["long_words"] == (0, 0, 1)
    for name in rules.POLICIES[2]:  # against applying the policy without the rule
        m = rules.mask([x for x in rules.POLICIES[2] if x != name])
        assert got[name][2] == entries.where(f"fail_bits & {m} = 0").count()
