"""Personal data by bootstrapped contextual extraction.

1. Fixed patterns find base spans (email, ip, card, phone) in every text. They are the seeds.
2. Identifier-like tokens (with an ``@`` or at least ``MIN_DIGITS`` digits) that no base span covers are
   candidates. Every seed and candidate is an instance, linked to lexical patterns of its place: the
   two tokens before it, and the token before with the token after.
3. Spark scores the pattern-instance graph in ``ROUNDS`` rounds: a pattern's confidence for a kind is the
   mean score of its distinct instances (at least ``MIN_SUPPORT`` of them scored), and a candidate's
   score is the best confidence of its patterns; candidates at or above ``MIN_CONFIDENCE`` join the
   instances that patterns are judged by.
4. Discovered candidates of a plausible shape for their kind become added spans. Base spans stay.

The texts are read once; what follows works on the table of spans and candidates, written with stable
row numbers. Counts per pattern and per instance are partial aggregates over distinct edges, so a
common pattern or an often repeated instance sends one row per map task and edge. Spans are gathered
per row only, so a group is bounded by one text.

Defined cases: a null text counts as empty, without spans; repeated rows get equal results; all columns
but the text are carried (one that is named as the new column is replaced); offsets are code points, ends exclusive; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm.common import materialise
from lexframe.session import cut_lineage

# The kinds, in the order that ties in spans follow, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_DIGITS = 3, 5, 0.8, 5
_SPAN = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>,fits:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: int, s: str) -> bool:
    if kind == 1:
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == 2:
        d = _digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 10 <= len(_digits(s)) <= 15


def _emails(text: str):
    """Spans of the email pattern, from each ``@`` outwards: its local part is the run before it, its domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by start, then kind."""
    out = [(0, *x) for x in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE) if "+" in text else (3, None)):
            if pattern:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(out, key=lambda x: (x[1], x[0]))


# The patterns as they are searched: a match of the ip pattern can only begin where a run of digits does, and a token
# where nothing of a token stands before, so an unbroken run is tried once and not from each of its characters.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(EMAIL.partition("@")[2])
_IP, _CARD, _PHONE, _DIGIT = (re.compile(p) for p in ("(?<![0-9])" + IP, CARD, PHONE, "[0-9]"))
#: An identifier-like token: no spaces or separators, with a digit or @ somewhere; digit groups may follow.
_TOKEN = re.compile(r"(?<![^\s=:\"'<>,;|])[^\s=:\"'<>,;|]*[0-9@][^\s=:\"'<>,;|]*(?:[ ][(]?[0-9][0-9().-]*(?=[\s,;:]|$))*")
_CONTEXT = re.compile(r"\w+|[^\w\s]")


def plausible(kind: int, s: str) -> bool:
    """Whether a discovered candidate has a shape that the kind may take."""
    n = len(_digits(s))
    if kind == 0:
        return "@" in s.strip("@")
    if kind == 1:
        return s.count(".") >= 3 and n >= 4
    return n >= 12 if kind == 2 else 7 <= n <= 15 and not re.search(r"[A-Za-z]", s)


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: the two tokens before it; the one before and the one after."""
    shape = lambda t: re.sub(r"[0-9]", "0", t.lower())
    before = ["^", "^", *map(shape, _CONTEXT.findall(text[max(0, start - 40):start]))]
    after = _CONTEXT.search(text, end, end + 40)
    return [f"{before[-2]} {before[-1]} _", f"{before[-1]} _ {shape(after.group()) if after else '$'}"]


def scan_text(text: str) -> list[tuple]:
    """Base spans and candidates (kind None): (kind, start, end, instance, patterns, and one bit for
    each kind of which the instance has a plausible shape)."""
    base = base_spans(text)
    out = [(k, s, e, text[s:e].lower(), patterns_at(text, s, e), 1 << k) for k, s, e in base]
    if "@" not in text and not _DIGIT.search(text):
        return out
    ends, covered = [], 0  # base spans by start, each with the furthest end so far
    for _, _, e in base:
        ends.append(max(e, ends[-1] if ends else 0))
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in ".!?)]}-":
            e -= 1
        while s < e and text[s] in "([{":
            s += 1
        token = text[s:e]
        while covered < len(base) and base[covered][1] < e:
            covered += 1  # base spans that begin before the token ends
        if ("@" in token.strip("@") or len(_digits(token)) >= MIN_DIGITS) and not (covered and ends[covered - 1] > s):
            fits = sum(1 << k for k in range(len(KINDS)) if plausible(k, token))
            out.append((None, s, e, token.lower(), patterns_at(text, s, e), fits))
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``uid`` (a row number), ``row`` (all columns but the text) and ``spans`` (base and candidates)."""
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    names = ("kind", "start", "end", "instance", "patterns", "fits")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32())
    entry = pa.struct(list(zip(names, kinds)))

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [[dict(zip(names, x)) for x in scan_text(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + batch.num_rows), pa.int64()), batch.column("row"), pa.array(found, pa.list_(entry))],
                names=["uid", "row", "spans"])
            uid += batch.num_rows

    schema = T.StructType([T.StructField("uid", T.LongType()), rows.schema["row"],
                           T.StructField("spans", T._parse_datatype_string(_SPAN))])
    return materialise(rows.mapInArrow(run, schema), "pii-spans")


def discover(spans: DataFrame, rounds: int = ROUNDS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(instance, kind, score) of the candidates that confident patterns find; ``spans`` is one row per
    base span or candidate (kind, instance, patterns)."""
    seeds = spans.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("score"))
    edges = cut_lineage(spans.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    total = edges.groupBy(F.col("pattern").alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    known = seeds = cut_lineage(seeds)
    found = None
    for _ in range(rounds):
        scored = known.withColumnRenamed("instance", "i")
        judged = (edges.join(scored, F.col("instance") == F.col("i")).groupBy("pattern", "kind")
                  .agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= support))
        sure = judged.join(total, F.col("pattern") == F.col("p")).select(
            F.col("pattern").alias("q"), F.col("kind"), (F.col("s") / F.col("n")).alias("c")).where(F.col("c") >= confidence)
        new = (edges.join(sure, F.col("pattern") == F.col("q"))
               .groupBy("instance").agg(F.max(F.struct("c", -F.col("kind"))).alias("best"))
               .select("instance", (-F.col("best.col2")).cast("int").alias("kind"), F.col("best.c").alias("score")))
        found = cut_lineage(new.join(seeds.select(F.col("instance").alias("i")), F.col("instance") == F.col("i"), "left_anti"))
        known = seeds.unionByName(found)
    return found


def extract(docs: DataFrame, text_col: str = "text", out_col: str = "spans", **params) -> DataFrame:
    """All columns but the text, and ``out_col``: array of (kind, start, end, base), by start, then kind."""
    rows = scan(docs, text_col)
    flat = rows.select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    found = discover(flat, **params).withColumnRenamed("kind", "k").withColumnRenamed("instance", "i")
    added = (flat.where("kind IS NULL").join(found, F.col("instance") == F.col("i"))
             .where("shiftright(fits, k) % 2 = 1")
             .groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct(
                 "start", F.col("k").alias("kind"), "end", F.lit(False).alias("base"))).alias("more")))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isNotNull()),
                       lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(True).alias("base")))
    out = rows.join(added, F.col("uid") == F.col("u"), "left")
    spans = F.sort_array(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>"))))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    keep = [c for c in docs.columns if c not in (text_col, out_col)]
    return out.select(*(F.col("row")[c].alias(c) for c in keep), spans.alias(out_col))


def digests(spans: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """``id_col``, the number of base spans of each kind, base_sha256 and spans (kind:start:end, joined by commas)."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans_col, lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return spans.select(F.col(id_col), *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(spans_col, text), ",").alias("spans"))
