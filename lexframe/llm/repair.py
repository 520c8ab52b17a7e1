"""Repair of conversation structure: secondary-sorted streaming of a small dynamic program.

Turns are repartitioned by conversation and sorted by turn inside the partition; ``mapInArrow`` then
streams them, carrying one conversation's state from batch to batch. The roles of a repaired
conversation read ``(s?(ua)+)?`` (s: system, u: user, a: assistant). Edits: keep (0), rerole to user or
assistant (1), delete (2, the only one for a blank or repeated turn), insert an empty turn (5); a
truncated turn that stays costs 5 more. The cheapest edits win, then the ASCII-least audit string of
their initials.

The state of the program: for each of four places in the pattern (start, after s, after u, after a) the
cost, the running hash of the repaired text, and the order of the audit strings so far. Strings that
have consumed the same turns and end in no insert are never prefixes of one another, so their rank and
the inserts behind them order all their extensions; no string is kept. Back-pointers take four bytes a
turn. Every ``CHUNK`` turns of a giant conversation they leave the task as a row, and a second pass, sorted
by descending chunk, walks them back. Texts are hashed and dropped; turns already seen are kept as
16-byte digests in sorted runs.

A conversation is streamed by one task, since every step needs the one before, in memory of about 16
bytes a distinct turn; its texts are never held together.

Defined cases: null conv_id is a conversation of its own; null turns come first; ties of turn go by
role, then text; null role or text is one space; repeated rows are repeated turns; a conversation
without turns costs nothing and has an empty audit; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import SPACES, materialise

#: Back-pointers that a task holds of one conversation before they leave it as a row.
CHUNK = 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place after the turn that may follow each place, and the role of a turn made for it.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_OPS = "DIKR"
_LEGAL = {"su", "ua", "au"}


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row
    (``gone`` is true and nothing but the conv_id stays), 1 empties its text, 2 removes ``[.!?]``, 3 repeats
    it, 4 makes it the user's. Nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    keep = [F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")]
    return rows.select("conv_id", *keep, "gone", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("n")).drop("n")


class _Seen:
    """Digests met so far: a small set, folded into one sorted array of 16 bytes a digest."""

    def __init__(self):
        self.new, self.old = set(), np.zeros(0, "S16")

    def add(self, digest: bytes) -> bool:
        """True if the digest was there before."""
        if digest in self.new:
            return True
        if len(self.old):
            key = np.bytes_(digest.rstrip(b"\0"))  # the array's elements come without the zero bytes at their end
            at = int(np.searchsorted(self.old, key))
            if at < len(self.old) and self.old[at] == key:
                return True
        self.new.add(digest)
        if len(self.new) >= 1 << 17:
            self.old, self.new = np.sort(np.concatenate([self.old, np.array(list(self.new), "S16")])), set()
        return False


def _ended_by(places):
    """Places reached by inserting turns behind the ``places`` just left by a turn: {place: (cost, rank, inserts, from)}."""
    best = {p: (cost, rank, 0, p) for p, (cost, rank) in places.items()}
    for p in (START, SYSTEM, ASSISTANT, USER):  # USER last: a turn inserted there may follow an inserted one
        if p in best:
            cost, rank, n, source = best[p]
            to, new = _NEXT[p], (cost + INSERT, rank, n + 1, source)
            if to not in best or new < best[to]:
                best[to] = new
    return best


class _Program:
    """The dynamic program over the turns of one conversation."""

    def __init__(self):
        self.places = _ended_by({START: (0, 0)})
        self.hashes = {START: (hashlib.sha256(), True)}  # of the place just left by a turn: hash, nothing hashed yet
        self.pointers = array("I")

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found = {}
        extra = TRUNCATED if truncated else 0
        for p, (cost, rank, n, source) in self.places.items():
            options = [(p, DELETE, "D")]
            if not must_go:
                to, initial = _NEXT[p], role[:1]
                if initial == "s" and p == START:
                    options.append((SYSTEM, KEEP + extra, "K"))
                options.append((to, KEEP + extra, "K") if initial == _ROLE[to][0] else (to, REROLE + extra, "R"))
            for to, price, op in options:
                new = (cost + price, rank, "I" * n + op, n, source, p)
                if to not in found or new < found[to]:
                    found[to] = new
        order = sorted(found, key=lambda to: found[to][1:3])
        hashes, packed, left = {}, 0, {}
        for rank, to in enumerate(order):
            cost, _, ops, n, source, p = found[to]
            packed |= (source | n << 2 | _OPS.index(ops[-1]) << 4) << 6 * to
            left[to] = (cost, rank)
            state, blank = self.hashes[source]
            if ops[-1] != "D" or n:
                state, lines = state.copy(), _inserted(source, n)
                if ops[-1] != "D":
                    lines.append(f"{role if ops[-1] == 'K' else _ROLE[to]}:{text}")
                state.update(("" if blank else "\n").encode() + "\n".join(lines).encode("utf-8", "surrogatepass"))
                blank = False
            hashes[to] = (state, blank)
        self.hashes, self.places = hashes, _ended_by(left)
        self.pointers.append(packed)

    def end(self):
        """(cost, hash, last place, inserts behind it) of the best repair."""
        cost, _, n, source = min(self.places[p] for p in (START, ASSISTANT) if p in self.places)
        state, blank = self.hashes[source]
        if n:
            state = state.copy()
            state.update((("" if blank else "\n") + "\n".join(_inserted(source, n))).encode())
        return cost, state.hexdigest(), source, n


def _inserted(place: int, n: int) -> list[str]:
    out = []
    for _ in range(n):
        place = _NEXT[place]
        out.append(_ROLE[place] + ":")
    return out


def _walk(pointers, place: int, n: int) -> tuple[str, int, int]:
    """Audit of the turns of ``pointers``, walked back from ``place`` with ``n`` inserts behind it; and where it begins."""
    out = []
    for packed in reversed(pointers):
        bits = packed >> 6 * place
        out.append("I" * n)
        out.append(_OPS[bits >> 4 & 3])
        place, n = bits & 3, bits >> 2 & 3
    return "".join(reversed(out)), place, n


class _Conversation:
    def __init__(self, conv_id):
        self.id, self.program, self.seen = conv_id, _Program(), _Seen()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.chunks = 0
        self.first = self.last = self.before = None

    def add(self, turn, role, text, blank, truncated):
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.distinct += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        duplicate = self.seen.add(digest) and not blank
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.program.turn(role, text, blank or duplicate, truncated)

    def spill(self, chunk):
        """A row of back-pointers, when there are ``chunk`` of them."""
        if len(self.program.pointers) >= chunk:
            row = {"conv_id": self.id, "seq": self.chunks, "pointers": self.program.pointers.tobytes()}
            self.program.pointers, self.chunks = array("I"), self.chunks + 1
            yield row

    def rows(self):
        cost, sha, place, n = self.program.end()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        row = {"conv_id": self.id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
               "illegal": self.illegal, "cost": cost, "repaired_sha256": sha}
        if self.chunks:
            yield {"conv_id": self.id, "seq": self.chunks, "pointers": self.program.pointers.tobytes(), "place": place | n << 2}
        else:
            audit, _, first = _walk(self.program.pointers, place, n)
            row["audit"] = "I" * first + audit
        yield row


_STREAMED = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                      + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("seq", pa.int32()), ("pointers", pa.binary()), ("place", pa.int32())])


def _stream(chunk):
    def run(batches):
        now = None
        for batch in batches:
            out = []
            for conv_id, turn, role, text, gone, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.id:
                    if now:
                        out += now.rows()
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, blank, truncated)
                    out += now.spill(chunk)
            yield pa.RecordBatch.from_pylist(out, _STREAMED)
        if now:
            yield pa.RecordBatch.from_pylist(list(now.rows()), _STREAMED)
    return run


def _walk_back(batches):
    """Chunks of a conversation, the last first, to pieces of its audit."""
    now = place = n = None
    for batch in batches:
        out = []
        for conv_id, seq, pointers, end in zip(*(c.to_pylist() for c in batch.columns)):
            if end is not None:
                now, place, n = conv_id, end & 3, end >> 2
            assert now == conv_id, "chunks of a conversation come together"
            piece, place, n = _walk(array("I", pointers), place, n)
            out.append({"conv_id": conv_id, "seq": seq, "piece": ("I" * n if seq == 0 else "") + piece})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("seq", pa.int32()), ("piece", pa.string())]))


def _sorted_turns(turns: DataFrame, extra: list[str] = []) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *extra, F.col("turn").asc_nulls_first(), "role", "text")


def _gone(turns: DataFrame) -> Column:
    return F.col("gone") if "gone" in turns.columns else F.lit(False)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text and maybe ``gone`` (a row that only names its conversation)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = (turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), _gone(turns).alias("gone"))
            .withColumns({"blank": solid == "", "truncated": ~F.right(solid, F.lit(1)).isin(".", "!", "?")}))
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string, seq int, pointers binary, place int")
    out = materialise(_sorted_turns(rows).mapInArrow(_stream(chunk), schema), "repaired")
    done = out.where("seq IS NULL").drop("seq", "pointers", "place")
    pieces = (out.where("seq IS NOT NULL").select("conv_id", "seq", "pointers", "place").repartition("conv_id")
              .sortWithinPartitions("conv_id", F.col("seq").desc()).mapInArrow(_walk_back, "conv_id long, seq int, piece string"))
    whole = pieces.groupBy(F.col("conv_id").alias("c")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("walked"))
    giant = done.where("audit IS NULL").join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("audit", F.col("walked"))
    return done.where("audit IS NOT NULL").unionByName(giant.select(done.columns))


def _apply(batches):
    """The audit of each conversation, then its turns: the repaired turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    now, audit, at, place, state = None, "", 0, 0, START

    def inserted(out):
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            out.append({"conv_id": now, "place": place, "role": _ROLE[state], "text": ""})
            at, place = at + 1, place + 1

    for batch in batches:
        out = []
        for conv_id, edits, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if edits is not None:
                now, audit, at, place, state = conv_id, edits, 0, 0, START
            else:
                op, at = audit[at], at + 1
                if op != "D":
                    state = SYSTEM if op == "K" and role[:1] == "s" else _NEXT[state]
                    out.append({"conv_id": now, "place": place, "role": role if op == "K" else _ROLE[state], "text": text})
                    place += 1
            inserted(out)
        yield pa.RecordBatch.from_pylist(out, schema)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. ``audits`` is ``repair(turns)``."""
    rows = turns.where(~_gone(turns)).select(
        F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long"), F.lit(None).cast("string").alias("audit"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit",
                          F.lit("").alias("role"), F.lit("").alias("text"))
    return _sorted_turns(heads.unionByName(rows), ["kind"]).select("conv_id", "audit", "role", "text").mapInArrow(
        _apply, "conv_id long, place long, role string, text string")
