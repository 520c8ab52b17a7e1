"""WARC archives: written as text parts, read back by boundary-chain verification.

Writing: each page is one record. Of equal payloads the row with the least id (then URL) is a response
that holds the bytes; the others are revisits that hold only the HTTP head and refer to it. Responses come
out of one aggregate by digest, so each distinct payload is shuffled once, and copies are combined
before the shuffle; revisits are joined from (id, URL, digest), never with payloads.

Reading trusts no magic number. Spark's text source splits the archives at the magic (files of any
size, in parallel); every piece that begins with a well-formed header is a candidate. Tasks emit
(candidate -> successor), the place where the header's Content-Length says that the next record begins.

1. Inside a block (one split of a file), the task jumps pointers in arrays: for each candidate, where its
   chain leaves the block.
2. Blocks learn their place in the file from the bytes that the blocks before them covered: one row a block.
3. Across blocks, pointers are jumped by joins: after k rounds everything within 2^k blocks from the
   file's start is reached. The number of rounds is the logarithm of the blocks of the longest file.
4. Each block is entered at one offset at most; following its chain from there keeps the real records.
   Magic inside a payload is never on the chain and is rejected.

A record with magic in its payload lies in several pieces; its bytes are joined together again by
position, each record by itself.

Defined cases: a null payload is empty; payloads below ``min_revisit`` bytes are all responses; null ids
come last among copies and are written without a number; repeated rows are copies; a URL with blanks or
control characters is form-encoded, a null one left out; other columns are ignored; an empty table
gives archives without records. A chain that breaks (damaged or cut file) keeps the records before the
break; a record that ends behind the file's end is dropped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexframe.llm.common import materialise

# Fixed values of the format: the first line of a record, its line end, and the profile of revisits.
MAGIC, EOL = b"WARC/1.0\r\n", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Parts into which the copies of one payload are dealt when they look up their response.
SALT = 16
#: Bytes of a file that meet in one piece of the join of records with their bytes.
STRETCH = 1 << 16


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit: int = 100, date: str = DATE, compression: str | None = None) -> None:
    """One WARC record a row of ``pages``, in text parts under ``path``. Parts without ``compression`` can be read in
    several blocks; a compressed part (``gzip``) takes a quarter of the disk and is one block."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("url").isNull().alias("bare"), "url")
    listed = materialise(rows.where(F.col("size") >= min_revisit).select("id", "url", "digest", "size", F.monotonically_increasing_id().alias("uid")), "warc-copies")
    first = (listed.groupBy(F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.min_by("uid", F.struct(order, "uid")).alias("chosen"),
                                                            F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("d", "chosen", F.col("first.id").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s")))
    revisits = listed.join(first, (F.col("digest") == F.col("d")) & (F.pmod(F.xxhash64("uid"), F.lit(SALT)).cast("int") == F.col("s"))).where("uid <> chosen")
    responses = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.min_by(F.struct("id", "url", "payload"), order).alias("r"))
    responses = responses.select("digest", "size", "r.*").unionByName(rows.where(F.col("size") < min_revisit))
    records = (responses.select(_record("response", date, F.col("payload"))).union(
        revisits.select(_record("revisit", date, F.lit(""), F.col("refers_to")))))
    records.write.options(lineSep=EOL.decode(), compression=compression or "none").text(path)


def _record(kind: str, date: str, payload: Column, refers_to: Column | None = None) -> Column:
    """The text of a record but for the last line end, which the writer adds."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.url_encode("url")).otherwise(F.col("url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(head) + F.octet_length(payload)
    fields = [F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))), F.lit(f"WARC-Date: {date}"),
              F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))]
    if refers_to is not None:
        fields += [F.concat(F.lit("WARC-Refers-To: "), urn(refers_to)), F.lit(f"WARC-Profile: {PROFILE}")]
    fields += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.lit(MAGIC.decode()), F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), head, payload, F.lit("\r\n")).alias("value")


def _header(piece: bytes):
    """(fields, where the header ends, content length) of what follows the magic, or None."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields, name = {}, None
    for line in piece[:end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon or not name:
            return None
        fields[name] = value.strip()
    length = fields.get(b"content-length", b"")
    if b"warc-type" not in fields or not length.isdigit() or len(length) > 18:
        return None
    return fields, end + 4, int(length)


def _payload(fields: dict, content: bytes):
    """(payload bytes, length, digest) of a record's content: of a revisit as its heads state them."""
    declared = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:") or None
    head = b""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, content = content.partition(b"\r\n\r\n")
    if fields[b"warc-type"] == b"revisit":
        sizes = [v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        return b"", int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None, declared
    return content, len(content), hashlib.sha256(content).hexdigest()


_INFO = [("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
         ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("covered", pa.int64()), ("rels", pa.list_(pa.int64())), ("nexts", pa.list_(pa.int64())),
                    ("exits", pa.list_(pa.int64())), ("rel", pa.int64()), ("split", pa.bool_()), *_INFO])
_INFO_DDL = "type string, record_id string, target_uri string, refers_to string, declared string, payload_bytes long, payload_digest string"
_PIECE_DDL = ("file string, block long, covered long, rels array<long>, nexts array<long>, exits array<long>, rel long, `split` boolean, " + _INFO_DDL)


def _info(fields: dict, content: bytes | None) -> dict:
    get = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    _, size, digest = _payload(fields, content) if content is not None else (None, None, None)
    return {"type": get(b"warc-type"), "record_id": get(b"warc-record-id"), "target_uri": get(b"warc-target-uri"), "refers_to": get(b"warc-refers-to"),
            "declared": get(b"warc-payload-digest"), "payload_bytes": size, "payload_digest": digest}


def _chains(rels, nexts):
    """For each candidate the index of its successor in the block (itself if there is none)."""
    at = np.searchsorted(rels, nexts)
    inside = np.flatnonzero((at < len(rels)) & (rels[np.minimum(at, len(rels) - 1)] == nexts)) if len(rels) else at
    to = np.arange(len(rels))
    to[inside] = at[inside]
    return to


def _exits(rels, nexts):
    """Where the chain from each candidate leaves the block, by pointer jumping."""
    to = _chains(rels, nexts)
    while len(to) and (to[to] != to).any():
        to = to[to]
    return nexts[to] if len(to) else nexts


def _candidates(batches):
    """Pieces of the archives, in the order of each split, to candidate records and one row a block."""
    def block_row():
        r, n = np.array(rels, np.int64), np.array(nexts, np.int64)
        return {"file": now[0], "block": now[1], "covered": pos, "rels": r, "nexts": n, "exits": _exits(r, n)}

    now, pos, rels, nexts = None, 0, [], []
    for batch in batches:
        out = []
        for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            if now != (file, block):
                if now:
                    out.append(block_row())
                now, pos, rels, nexts = (file, block), 0, [], []
            piece = value.as_buffer().to_pybytes()
            found = _header(piece) if pos or block else None  # what stands before the first magic is no record
            if found:
                fields, start, length = found
                rels.append(pos - len(MAGIC))
                nexts.append(pos + start + length + 2 * len(EOL))
                split = start + length + 2 * len(EOL) > len(piece)
                out.append({"file": file, "block": block, "rel": rels[-1], "split": split} | _info(fields, None if split else piece[start:start + length]))
            pos += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(out, _PIECE)
    if now:
        yield pa.RecordBatch.from_pylist([block_row()], _PIECE)


def _reached(batches):
    """Blocks with the offset at which their chain is entered: the records on the chain."""
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("r", pa.int64()), ("at", pa.int64()), ("next", pa.int64())])
    for batch in batches:
        out = []
        for file, block, base, total, entry, rels, nexts in zip(*(batch.column(c) for c in ("file", "block", "base", "total", "entry", "rels", "nexts"))):
            base, total = base.as_py(), total.as_py()
            rels, nexts = rels.values.to_numpy(), nexts.values.to_numpy()
            to, i = _chains(rels, nexts), int(np.searchsorted(rels, entry.as_py() - base))
            while base + int(nexts[i]) <= total:
                out.append({"f": file.as_py(), "b": block.as_py(), "r": int(rels[i]), "at": base + int(rels[i]), "next": base + int(nexts[i])})
                if to[i] == i:
                    break
                i = int(to[i])
        yield pa.RecordBatch.from_pylist(out, schema)


def _positions(batches):
    """Pieces with their place in the block; each begins with its magic."""
    schema = pa.schema([("f", pa.string()), ("b", pa.int64()), ("rel", pa.int64()), ("value", pa.binary())])
    now, pos = None, 0
    for batch in batches:
        rel, values = [], []
        for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            if now != (file, block):
                now, pos = (file, block), 0
            piece = value.as_buffer().to_pybytes()
            rel.append(pos - len(MAGIC))
            values.append(MAGIC + piece)
            pos += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(rel, pa.int64()), pa.array(values, pa.binary())], schema=schema)


def _joined(batches):
    """The pieces of each record to its content and what the heads say of it."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("content", pa.binary()), ("payload", pa.binary()), *_INFO])
    for batch in batches:
        out = []
        for file, at, pieces in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("pieces").to_pylist()):
            record = b"".join(p["value"] for p in pieces)[len(MAGIC):]
            fields, start, length = _header(record)
            content = record[start:start + length]
            out.append({"file": file, "at": at, "content": content, "payload": _payload(fields, content)[0]} | _info(fields, content))
        yield pa.RecordBatch.from_pylist(out, schema)


class Archives:
    """Archives under ``path``, read once for their candidates (written to the scratch folder)."""

    def __init__(self, spark: SparkSession, path: str):
        self.pieces = spark.read.option("lineSep", MAGIC.decode()).text(path).select(
            F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        self.table = materialise(self.pieces.mapInArrow(_candidates, _PIECE_DDL), "warc-candidates")
        before = Window.partitionBy("file").orderBy("block")  # one row a block, not a record
        base = F.sum("covered").over(before) - F.col("covered")
        total = F.sum("covered").over(Window.partitionBy("file")) - len(MAGIC)
        self.blocks = materialise(self.table.where("rels IS NOT NULL").select(
            "file", "block", base.alias("base"), total.alias("total"), "rels", "nexts", "exits"), "warc-blocks")

    def entries(self) -> DataFrame:
        """(file, block, entry): the offset at which the chain from the file's start enters each block."""
        most = self.blocks.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        hops = self.blocks.select("file", "block", "base", F.explode(F.arrays_zip("rels", "exits")).alias("c")).select(
            "file", "block", (F.col("base") + F.col("c.rels")).alias("at"), (F.col("base") + F.col("c.exits")).alias("to"))
        if most > 1:  # only candidates where some chain enters a block, or the file begins
            entered = hops.select(F.col("file").alias("f"), F.col("to").alias("t")).distinct()
            inner = hops.where("at <> 0").join(entered, (F.col("file") == F.col("f")) & (F.col("at") == F.col("t")), "left_semi")
            hops = materialise(hops.where("at = 0").unionByName(inner), "warc-hops")
        reach, jump = hops.where("at = 0").select("file", "at"), hops.select("file", "at", "to")
        for k in range(math.ceil(math.log2(most))):
            step = jump.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("to").alias("t"))
            on = F.col("file") == F.col("f")
            reach = materialise(reach.union(reach.join(step, on & (F.col("at") == F.col("a"))).select("file", "t")), f"warc-reach-{k}")
            jump = materialise(jump.join(step, on & (F.col("to") == F.col("a"))).select("file", "at", F.col("t").alias("to")), f"warc-jump-{k}")
        reach = reach.select(F.col("file").alias("f"), F.col("at").alias("a"))
        return hops.join(reach, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a"))).select("file", "block", F.col("at").alias("entry"))

    def index(self) -> DataFrame:
        """The records on the chains: file, at, next, type, record_id, target_uri, refers_to, declared (digest),
        payload_bytes, payload_digest (of the bytes read; of a revisit as declared)."""
        entries = self.entries().select(F.col("file").alias("f"), F.col("block").alias("b"), "entry")
        kept = self.blocks.join(entries, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
            "file", "block", "base", "total", "entry", "rels", "nexts").mapInArrow(_reached, "f string, b long, r long, at long, next long")
        records = self.table.where("rel IS NOT NULL").join(
            kept, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("rel") == F.col("r")))
        names = ["file", "at", "next", *(n for n, _ in _INFO)]
        records = materialise(records.select("split", *names), "warc-records")
        whole, split = records.where("NOT split").select(names), records.where("split")
        if split.isEmpty():
            return whole
        return whole.unionByName(split.select("file", "at", "next").join(self.contents(split).drop("content", "payload"), ["file", "at"]).select(names))

    def contents(self, records: DataFrame) -> DataFrame:
        """``records`` (file, at, next) with their bytes: file, at, content, payload and the columns of the index."""
        base = self.blocks.select("file", "block", "base")
        pieces = self.pieces.mapInArrow(_positions, "f string, b long, rel long, value binary")
        placed = pieces.join(base, (F.col("f") == F.col("file")) & (F.col("b") == F.col("block"))).select(
            "f", (F.col("base") + F.col("rel")).alias("pos"), "value").withColumn("stretch", F.floor(F.col("pos") / STRETCH))
        asked = records.select("file", "at", "next", F.explode(F.sequence(F.floor(F.col("at") / STRETCH), F.floor(F.col("next") / STRETCH))).alias("k"))
        met = asked.join(placed, (F.col("file") == F.col("f")) & (F.col("k") == F.col("stretch")) & (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("next")))
        gathered = met.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("pieces"))
        return gathered.mapInArrow(_joined, "file string, at long, content binary, payload binary, " + _INFO_DDL)


def page_number(urn: Column) -> Column:
    """The id of ``<urn:page:id>``; null without one."""
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
