"""Binding of the engine's roles to the driver's tables.

Each function reads whole tables and renames columns into a role; nothing is
subset. The same mapping is written in SQL next to each registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.functions.text import SPANISH_MONTHS, workday_add

# The first daily partition and the per-day cap of the ingest.
FIRST_DAY = "2025-10-01"
DAILY_CAP = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark, d) -> DataFrame:
    """orders → interaction: id, thread, answer time, time stamp."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("thread_id"),
        F.col("o_totalprice").alias("response_time"), F.col("o_orderdate").alias("timestamp"))


def documents(spark, d) -> DataFrame:
    """part → document: id and a unique file name."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("document_id"),
        F.concat(F.col("p_name"), F.lit("-"), F.col("p_partkey").cast("string")).alias("filename"))


def links(spark, d) -> DataFrame:
    """lineitem → (interaction, document) junction."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("interaction_id"), F.col("l_partkey").alias("document_id"))


def feedback(spark, d) -> DataFrame:
    """labels → one vote per interaction, positive when quality = 1."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("interaction_id"),
        (F.col("quality") == 1).alias("is_positive"))


def orders_as_of(spark, d):
    """The analytics clock: the latest interaction time."""
    return table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))


def messages(spark, d) -> DataFrame:
    """conversations → chat history (thread, turn, role, text)."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", "role", "text")


def thread_interactions(spark, d) -> DataFrame:
    """events → interactions of a chat thread (thread = user)."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("interaction_id"), F.col("user_id").alias("thread_id"),
        F.col("ts").alias("timestamp"))


def request_log(spark, d) -> DataFrame:
    """events → request log: errors are status 500, value is the duration in ms."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("request_id"), "ts",
        F.lit("GET").alias("method"),
        F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit("/health")).otherwise(F.concat(F.lit("/"), F.col("event_type"))).alias("http_path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"))


def conversation_list(spark, d) -> DataFrame:
    """events → conversations: id, owner, title, last update."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user_id"),
        F.col("event_type").alias("title"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def norm_rows(spark, d) -> DataFrame:
    """documents → typed norm records of daily files.

    Ids are published ``DAILY_CAP`` per working day from ``FIRST_DAY`` in id order.
    """
    doc = table(spark, d, "documents")
    day = workday_add(FIRST_DAY, F.floor(F.col("doc_id") / DAILY_CAP))
    return doc.select(
        F.col("doc_id").alias("id_norma"),
        F.col("lang").alias("tipo_norma"),
        F.col("n_chars").cast("string").alias("numero_norma"),
        F.lit(None).cast("string").alias("clase_norma"),
        F.col("source").alias("organismo_origen"),
        day.alias("fecha_sancion"),
        F.floor(F.col("doc_id") / DAILY_CAP).cast("string").alias("numero_boletin"),
        day.alias("fecha_boletin"),
        (F.pmod(F.col("doc_id"), F.lit(DAILY_CAP)) + 1).cast("long").alias("pagina_boletin"),
        F.substring("text", 1, 50).alias("titulo_resumido"),
        F.lit(None).cast("string").alias("titulo_sumario"),
        F.col("text").alias("texto_resumido"),
        F.lit(None).cast("string").alias("observaciones"),
        F.concat(F.lit("http://bulletin.example/norma/"), F.col("doc_id").cast("string")).alias("texto_original"),
        F.lit(None).cast("string").alias("texto_actualizado"),
        F.lit(0).cast("long").alias("modificada_por"),
        F.lit(0).cast("long").alias("modifica_a"),
        day.alias("scrape_date"),
    )


# The same binding for DuckDB (one CTE body, used by the oracle SQL).
NORM_ROWS_SQL = f"""
  SELECT doc_id AS id_norma, lang AS tipo_norma, CAST(n_chars AS VARCHAR) AS numero_norma,
         CAST(NULL AS VARCHAR) AS clase_norma, source AS organismo_origen,
         d AS fecha_sancion, CAST(doc_id // {DAILY_CAP} AS VARCHAR) AS numero_boletin, d AS fecha_boletin,
         CAST(doc_id % {DAILY_CAP} + 1 AS BIGINT) AS pagina_boletin,
         substring(text, 1, 50) AS titulo_resumido, CAST(NULL AS VARCHAR) AS titulo_sumario,
         text AS texto_resumido, CAST(NULL AS VARCHAR) AS observaciones,
         'http://bulletin.example/norma/' || CAST(doc_id AS VARCHAR) AS texto_original,
         CAST(NULL AS VARCHAR) AS texto_actualizado, CAST(0 AS BIGINT) AS modificada_por,
         CAST(0 AS BIGINT) AS modifica_a, d AS scrape_date
  FROM (SELECT *, CAST(DATE '{FIRST_DAY}' + CAST(7 * ((doc_id // {DAILY_CAP}) // 5) + (doc_id // {DAILY_CAP}) % 5
               + CASE WHEN isodow(DATE '{FIRST_DAY}') - 1 + (doc_id // {DAILY_CAP}) % 5 >= 5 THEN 2 ELSE 0 END
               AS INTEGER) AS DATE) AS d
        FROM documents)
"""


def revised_norms(spark, d) -> DataFrame:
    """Later daily batches: English and German norms re-published with a revised text from
    two days after the last original day on, at most ``DAILY_CAP`` a day (German ids are new
    ids, shifted past the table's key range, so the batches both update and insert)."""
    base = norm_rows(spark, d)
    top = table(spark, d, "documents").agg(F.max("doc_id")).first()[0]
    last = base.agg(F.max("scrape_date")).first()[0]
    return (base.where(F.col("tipo_norma").isin("en", "de"))
            .withColumn("scrape_date", F.date_add(F.lit(last), (F.floor(F.col("id_norma") / DAILY_CAP) + 2).cast("int")))
            .withColumn("id_norma", F.when(F.col("tipo_norma") == "de", F.col("id_norma") + F.lit(top + 1))
                        .otherwise(F.col("id_norma")))
            .withColumn("texto_resumido", F.concat(F.lit("v2 "), F.col("texto_resumido"))))


REVISED_NORMS_SQL = f"""
  SELECT * REPLACE (CASE WHEN tipo_norma = 'de' THEN id_norma + (SELECT max(doc_id) FROM documents) + 1
                         ELSE id_norma END AS id_norma,
                    'v2 ' || texto_resumido AS texto_resumido,
                    CAST((SELECT max(scrape_date) FROM norm_rows) + CAST(2 + id_norma // {DAILY_CAP} AS INTEGER) AS DATE) AS scrape_date)
  FROM norm_rows WHERE tipo_norma IN ('en', 'de')
"""


# Fixed values (of this binding): norm types rendered per document language.
TIPO_BY_LANG = [("en", "Ley"), ("es", "Decreto"), ("fr", "Resolución Conjunta"), ("de", "Disposición")]


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def norm_pages(spark, d) -> DataFrame:
    """Bulletin-style norm pages rendered from the norm records of ``documents``
    (``page_id`` = norm id), with the markup the bulletin's pages use. The form varies with
    the id, so that every page rule has pages that need it (``catalog.EXTRACTED_SQL``
    states what each must give): numeric entities, month names in dates, summaries in a
    ``div``, labels inside five tags, nested link texts, several links of a kind, attributes
    without quotes, unclosed paragraphs, and pages without a title, a summary or a number."""
    n = norm_rows(spark, d)
    i = F.col("id_norma")
    every = lambda k, r=0: F.pmod(i, F.lit(k)) == r
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    tipo = F.create_map(*[F.lit(x) for kv in TIPO_BY_LANG for x in kv])[F.col("tipo_norma")]
    tipo = pick(every(2), F.replace(tipo, F.lit("ó"), F.lit("&#243;")), F.replace(tipo, F.lit("ó"), F.lit("&oacute;")))
    dmy = F.date_format("fecha_sancion", "dd/MM/yyyy")
    months = F.array(*[F.lit(m) for m in SPANISH_MONTHS])
    named = text(F.date_format("fecha_sancion", "dd-"), F.element_at(months, F.month("fecha_sancion")), F.date_format("fecha_sancion", "-yyyy"))
    header = text("<strong>", tipo, pick(every(17), F.lit(" "), text("&nbsp;<b>", F.col("numero_norma"), "/", F.year("fecha_sancion").cast("string"), "</b> ")),
                  F.upper(F.col("organismo_origen")), " NACIONAL</strong>")
    bare = every(7)
    sancion = text('<span class="no-vr_azul11x">1/1/1900</span>', pick(bare, F.lit("<span class=vr_azul11>"), F.lit('<span title="a>b" class="c vr_azul11">')), pick(every(6, 5), named, dmy), "</span>")
    title = pick(every(11), F.lit("<h2>sin t&iacute;tulo</h2>"), text("<h1>", _esc(F.col("titulo_resumido")), "</h1>"))
    sumario = text('<span class="no-destacado">otro</span><span class="x destacado">', _esc(F.col("organismo_origen")), "</span>")
    boletin = text('<div><p>N&uacute;mero: 999</p></div><p>Publicada en el Bolet&iacute;n Oficial del ',
                   pick(every(4, 3), text(named, " "), text('<a href="?page_id=216&amp;n=', F.col("numero_boletin"), '"><i>', dmy, "</i></a> ")),
                   "N&uacute;mero: ", F.col("numero_boletin"), " P&aacute;gina: ", F.col("pagina_boletin").cast("string"),
                   pick(every(13), F.lit(""), F.lit("</p>")))
    body = _esc(F.col("texto_resumido"))
    resumen = pick(every(19), F.lit("<p>nada</p>"), pick(
        every(5, 1), text(pick(every(3), F.lit("<div><strong><u><i><b><em><a name=r>Resumen:</a></em></b></i></u></strong> "), F.lit("<div><strong><b>Resumen:</b></strong> ")),
                          body, "</div>"), pick(
            every(5, 2), text("<p>Resumen: ", body, "</p>"), text("<p><strong>Resumen:</strong><br>", body, "</p>"))))
    full = pick(every(3, 1), F.lit("<i><b>TEXTO COMPLETO</b></i>"), F.lit("Texto completo de la norma"))
    links = text('<a href="no.htm">Texto <b>completo</b></a>', pick(bare, text("<a href=anexos/", i.cast("string"), "/norma.htm>"), text('<a href="anexos/', i.cast("string"), '/norma.htm">')), full, "</a>",
                 pick(every(4, 1), text('<a href="http://bulletin.example/upd/', i.cast("string"), '">Texto actualizado</a>'),
                      pick(every(4, 2), text('<a href="upd/', i.cast("string"), '"><b>Texto actualizado</b></a>'), F.lit(""))))
    counts = text(pick(bare, text("<a target=x href=verVinculos.do?modo=1&amp;id=", i.cast("string"), ">"), text('<a href="verVinculos.do?modo=1&amp;id=', i.cast("string"), '">')), "Modifica a ", F.pmod(i, F.lit(23)).cast("string"),
                  ' normas</a><a href="verVinculos.do?modo=1">77</a>',
                  pick(every(3), F.lit(""), text('<a href="verVinculos.do?modo=2&amp;id=', i.cast("string"), '">modificada por ',
                                                 F.pmod(i, F.lit(29)).cast("string"), "</a>")))
    obs = pick(every(5, 2), F.lit(""), text("<p><strong><b>Observaciones:</b></strong> n&ordm; ", F.pmod(i, F.lit(7)).cast("string"), " <br></p>"))
    html = text('<html><head><title>norma</title><script>var x="</p>";</script></head><body>\n', header, "\n", sancion, "<div>", title, sumario,
                "\n", boletin, "</div>\n", resumen, "\n", links, "\n", counts, "\n", obs, "\n</body></html>")
    return n.select(i.alias("page_id"), F.concat(F.lit("http://bulletin.example/norma/"), i.cast("string")).alias("url"), html.alias("html"))


LISTING_BULLETINS = 5  # bulletins (days) per rendered listing page


def listing_pages(spark, d) -> DataFrame:
    """Bulletin listing pages rendered from the norm records of ``documents``: one page
    per ``LISTING_BULLETINS`` consecutive bulletins linking each of their norm ids twice
    (title link, then a "ver" link), newest id first; plus, per page, a "no results"
    page and a page with neither ids nor that notice. A page's id list is bounded by
    ``LISTING_BULLETINS * DAILY_CAP``."""
    n = norm_rows(spark, d).select("id_norma", F.floor(F.col("id_norma") / (DAILY_CAP * LISTING_BULLETINS))
                                   .alias("grp"))
    ids = n.groupBy("grp").agg(F.sort_array(F.collect_list("id_norma"), asc=False).alias("ids"))
    links = F.array_join(F.transform("ids", lambda i: F.concat(
        F.when(i % 2 == 0, F.lit("<li><a href=verNorma.do?id=")).otherwise(F.lit('<li><a href="verNorma.do?id=')), i.cast("string"),
        F.when(i % 2 == 0, F.lit(">Norma ")).otherwise(F.lit('">Norma ')), i.cast("string"),
        F.lit('</a> <a href="http://bulletin.example/verNorma.do;s=1?id='), i.cast("string"),
        F.lit('&amp;v=1">ver</a></li>'))), "")
    found = ids.select((F.col("grp") * 3).alias("page_id"),
                       F.concat(F.lit("<html><body><h2>Normas publicadas</h2><ul>"), links,
                                F.lit("</ul></body></html>")).alias("html"))
    empty = ids.select((F.col("grp") * 3 + 1).alias("page_id"),
                       F.lit("<html><body><p>No se encontraron normas para la fecha.</p></body></html>").alias("html"))
    odd = ids.select((F.col("grp") * 3 + 2).alias("page_id"),
                     F.lit("<html><body><p>Servicio no disponible</p></body></html>").alias("html"))
    return (found.unionByName(empty).unionByName(odd)
            .withColumn("url", F.concat(F.lit("http://bulletin.example/listing/"), F.col("page_id").cast("string")))
            .select("page_id", "url", "html"))
