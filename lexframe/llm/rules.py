"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores the measurements and one failure bit per rule.
``apply_policy`` keeps the rows whose failure bits miss a policy's mask, so a new policy version
costs no new pass over the texts. ``ablation`` counts, per rule, what the policy would keep
without it, from the bits alone.

A document is one row and is never gathered with others, so there is no shuffle and no hot group.
Three-word windows are compared by a 64-bit hash first; only a document with an equal pair of
hashes is measured on the words themselves, so hash collisions cannot change a result.

Defined cases: a null text counts as an empty one (no words, all counts zero); repeated rows stay
repeated; only the id column is carried, so other columns cannot clash; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in bit order: name and the SQL condition under which a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words AND n_symbols > 0",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
}
#: Policy versions: the rules that each applies.
POLICIES: dict[int, list[str]] = {
    1: ["few_words", "repeated_words"],
    2: ["few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines"],
}


def mask(rules: list[str]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside three-word windows that the text holds twice or more.
    Needs the word array ``_w``. Each stage is a column of its own, read several times by the
    next, so that no array is built again per element."""
    w = F.col("_w")
    n = F.size(w)
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_differ", F.size(F.array_distinct(hashed)))
    gram = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
    df = df.withColumn("_s", F.when((n >= 3) & (F.col("_differ") < n - 2), F.sort_array(F.transform(windows, gram))))
    s = F.col("_s")
    at = F.sequence(F.lit(0), F.size(s) - 1)
    same = lambda k: (F.get(s, k)["g"] == F.get(s, k - 1)["g"]) | (F.get(s, k)["g"] == F.get(s, k + 1)["g"])
    found = F.transform(F.filter(at, lambda k: F.coalesce(same(k), F.lit(False))), lambda k: F.get(s, k)["i"])
    df = df.withColumn("_at", F.when(s.isNotNull(), found))
    covered = F.array_distinct(F.concat(F.col("_at"), F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2)))
    return df.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), F.size(covered)).otherwise(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines (long;
    lines are those with a word), n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col), text.alias("_t"))
    df = df.withColumns({
        "_w": F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda x: x != ""),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    })
    return _repeat_words(df).select(
        F.col(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits`` (long): bit i is set when the i-th rule fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            for i, cond in enumerate(RULES.values())]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("fail_bits", total)


def apply_policy(entries: DataFrame, version: int, name: str = "kept") -> DataFrame:
    """Adds ``name`` (boolean): no rule of the policy fails."""
    return entries.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(entries: DataFrame, version: int) -> DataFrame:
    """One row per rule of the policy: documents failing it, those failing it alone among the
    policy's rules (what dropping the rule would bring back), and all kept without it."""
    full = mask(POLICIES[version])
    groups = (entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full).cast("long")).alias("bits"))
              .agg(F.count(F.lit(1)).alias("n")))  # at most one row per combination of rules
    rules = entries.sparkSession.createDataFrame(
        [(name, 1 << i) for i, name in enumerate(RULES) if name in POLICIES[version]], "rule string, bit long")
    without = F.col("bits").bitwiseAND(F.lit(full).cast("long").bitwiseXOR(F.col("bit")))
    return (groups.crossJoin(F.broadcast(rules))  # both sides bounded by the rule count
            .groupBy("rule").agg(
                F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
                F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
                F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without")))
