"""Declared schemas of the data the engine works on."""

from __future__ import annotations

from pyspark.sql import types as T

# The norm record's columns, in the order they appear in the daily files.
NORM_COLUMNS = [
    "id_norma", "tipo_norma", "numero_norma", "clase_norma", "organismo_origen",
    "fecha_sancion", "numero_boletin", "fecha_boletin", "pagina_boletin",
    "titulo_resumido", "titulo_sumario", "texto_resumido", "observaciones",
    "texto_original", "texto_actualizado", "modificada_por", "modifica_a",
]

# Typed column kinds of the norm record.
_NORM_TYPES = {
    "id_norma": T.LongType(),
    "fecha_sancion": T.DateType(),
    "fecha_boletin": T.DateType(),
    "pagina_boletin": T.LongType(),
    "modificada_por": T.LongType(),
    "modifica_a": T.LongType(),
}

# Tokens read as NULL in every column of a daily file.
NULL_TOKENS = ["S/N", "s/n"]

NORM_SCHEMA = T.StructType(
    [T.StructField(c, _NORM_TYPES.get(c, T.StringType()), True) for c in NORM_COLUMNS]
)

# Every column as text: how a daily file is scanned before typing.
NORM_RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in NORM_COLUMNS])

EMBEDDING_SCHEMA = T.StructType([
    T.StructField("id_norma", T.LongType(), False),
    T.StructField("ml_generate_embedding_result", T.ArrayType(T.FloatType()), True),
    T.StructField("ml_generate_embedding_statistics", T.StringType(), True),
    T.StructField("ml_generate_embedding_status", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("chunk_ix", T.IntegerType(), False),
    T.StructField("start_index", T.LongType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

MESSAGE_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("args", T.StructType([T.StructField("answer", T.StringType())])),
]))

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("http_path", T.StringType(), True),
    T.StructField("status_code", T.IntegerType(), True),
    T.StructField("duration_ms", T.DoubleType(), True),
])
