"""Recursive text splitting as column expressions.

A text is cut at the coarsest separator that it holds, every piece keeping the separator before it. Pieces are packed
into chunks of at most ``size`` characters; a chunk begins with the last pieces of the one before, at most ``overlap``
characters of them. A piece that is itself too long is split in the same way at the finer separators, and at last by
characters, which are plain windows. The packing is a fold over the pieces; each separator nests one fold in the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, coarsest first ("" = characters), and white space that is trimmed from chunks.
SEPARATORS = ["\n\n", "\n", " ", ""]
BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_PACK = "struct<out:array<string>,now:array<string>,chars:int>"


def _strings(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def _flushed(out: Column, now: Column) -> Column:
    """``out`` with the chunk of the collected pieces, unless it is blank."""
    chunk = F.btrim(F.array_join(now, ""), F.lit(BLANK))
    return F.when(chunk != "", F.array_append(out, chunk)).otherwise(out)


def _windows(text: Column, size: int, overlap: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda s: F.btrim(F.substr(text, s + 1, F.lit(size)), F.lit(BLANK))), lambda x: x != "")


def _chunks(text: Column, separators: list[str], size: int, overlap: int) -> Column:
    sep, finer = separators[0], separators[1:]
    if sep == "":
        return _windows(text, size, overlap)
    pieces = F.transform(F.split(text, sep), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(sep), x)))
    pieces = F.filter(pieces, lambda x: x != "")

    def fits(acc, n):
        """Pieces collected so far, without the first ones that must go before ``n`` more characters come."""
        def drop(state, piece):
            go = (state["chars"] > overlap) | ((state["chars"] + n > size) & (state["chars"] > 0))
            return F.when(go, F.struct((state["chars"] - F.char_length(piece)).alias("chars"), (state["gone"] + 1).alias("gone"))).otherwise(state)
        left = F.aggregate(acc["now"], F.struct(acc["chars"].alias("chars"), F.lit(0).alias("gone")), drop)
        return F.when(acc["chars"] + n > size, F.struct(F.slice(acc["now"], left["gone"] + 1, F.size(acc["now"])).alias("now"), left["chars"].alias("chars"))
                      ).otherwise(F.struct(acc["now"].alias("now"), acc["chars"].alias("chars")))

    def step(acc, piece):
        n = F.char_length(piece)
        done = F.when((acc["chars"] + n > size) | (n >= size), _flushed(acc["out"], acc["now"])).otherwise(acc["out"])
        kept = fits(acc, n)
        short = F.struct(done.alias("out"), F.array_append(kept["now"], piece).alias("now"), (kept["chars"] + n).alias("chars")).cast(_PACK)
        long = F.struct(F.concat(done, _chunks(piece, finer, size, overlap)).alias("out"), _strings().alias("now"), F.lit(0).alias("chars")).cast(_PACK)
        return F.when(n >= size, long).otherwise(short)

    start = F.struct(_strings().alias("out"), _strings().alias("now"), F.lit(0).alias("chars")).cast(_PACK)
    packed = F.aggregate(pieces, start, step, lambda acc: _flushed(acc["out"], acc["now"]))
    return F.when(F.instr(text, sep) > 0, packed).otherwise(_chunks(text, finer, size, overlap))


def recursive_chunks(text: Column, size: int, overlap: int, separators: list[str] = SEPARATORS) -> Column:
    """Array of (start, text): the chunks with their offsets, each looked for from where the one before lets it begin."""
    state = "struct<start:bigint,chars:int,out:array<struct<start:bigint,text:string>>>"

    def place(acc, chunk):
        begin = F.greatest(F.lit(0), acc["start"] + acc["chars"] - overlap) + 1
        at = (F.position(chunk, text, begin.cast("int")) - 1).cast("bigint")
        return F.struct(at.alias("start"), F.char_length(chunk).alias("chars"),
                        F.array_append(acc["out"], F.struct(at.alias("start"), chunk.alias("text"))).alias("out")).cast(state)
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("chars"), F.array().cast("array<struct<start:bigint,text:string>>").alias("out")).cast(state)
    return F.aggregate(_chunks(text, separators, size, overlap), start, place, lambda acc: acc["out"])
