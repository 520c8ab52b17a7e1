"""Small shared helpers: packed Arrow pages, written intermediate tables, word counting."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.session import scratch_path

# The characters between words (space and \t \n \v \f \r) and the word pattern.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back. Later uses read
    the files, so a lost executor costs a re-read and never a recomputation with other ids."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialise``, hashed by ``key`` into ``buckets`` files a task, so that a later join on the
    key reads this side in place instead of shuffling it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    entry = "llm_" + path.rsplit("-", 1)[1]
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the name only: files at a given path stay
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(**columns) -> bytes:
    """Columns (Arrow or numpy arrays of one length) as one zstd-compressed Arrow stream."""
    table = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    return pack_table(table)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def release_memory() -> None:
    """Hand freed memory back to the system: Python workers stay alive between stages, and what they
    hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def releasing(run):
    """A batch function that releases memory when its partition is done."""
    def wrapped(batches):
        yield from run(batches)
        release_memory()
    return wrapped


def text_slices(batches, text_col: str, max_bytes: int):
    """Tables of consecutive rows whose texts take at most ``max_bytes`` together. A longer text
    is a table of its own."""
    rows, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        lens = pc.fill_null(pc.binary_length(table[text_col]), 0).to_numpy()
        start = 0
        for i, n in enumerate(lens):
            if size and size + n > max_bytes:
                if i > start:
                    rows.append(table.slice(start, i - start))
                yield pa.concat_tables(rows).combine_chunks()
                rows, size, start = [], 0, i
            size += int(n)
        if len(lens) > start:
            rows.append(table.slice(start))
    if rows:
        yield pa.concat_tables(rows).combine_chunks()


def is_training(id_col: Column, mod: int, held_out: int) -> Column:
    """True where crc32 of the id as text leaves another remainder than ``held_out``; a null id trains."""
    return ~F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == held_out, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
