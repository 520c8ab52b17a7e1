"""Typed fields of norm pages and listing pages, as one native projection (§2.2).

Every rule is a column expression over the page's element table (``functions/html.py``: tags, texts and
depths as arrays), JVM built-ins only: no per-row parser, no Python worker, no shuffle. Scripts, styles and
comments are removed first, so text inside them is never read.

Texts follow the page parser: pieces between tags, decoded; ``joined_text(sep)`` trims each piece, drops empty
ones and joins with ``sep``; a raw text is their concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.html import (first_tag, has_class, href, joined_text, next_sibling, only_text, parent_of, places, text_behind,
                                     text_pieces, with_elements)
from lexframe.functions.text import JAVA_SPACE_CHARS, collapse_ws, norm_date, resolve_url, strip_ws
from lexframe.schemas import NORM_COLUMNS

# Markers of the bulletin's pages.
NORM_LINK = r"verNorma\.do.*\?id=\d+"
NORM_ID = r"\?id=(\d+)"
EMPTY_LISTING_MARKERS = ["no se encontraron", "sin resultados"]
DATE_CLASS = "vr_azul11"
SUMMARY_CLASS = "destacado"
BULLETIN_DATE_LINK = "page_id=216"
BULLETIN_DATE = r"(\d{2}-[A-Z]{3}-\d{4})"
BULLETIN_NUMBER = r"N[uú]mero:\s*(\d+)"
BULLETIN_PAGE = r"P[aá]gina:\s*(\d+)"
TIPO_LETTERS = "A-ZÀÁÉÍÓÚÑa-zàáéíóúñ"
TIPO = rf"^([{TIPO_LETTERS}]+(?:\s+[{TIPO_LETTERS}]+)*?)\s+\d+"
NUMERO = r"\b(\d+)(?:/\d{4})?\b"
ORGANISMO = r"\d+(?:/\d{4})?\s+(.+)"
LABEL = "resumen:"
RESUMEN_MIN_LEN = 10
FULL_TEXT_LINK = "Texto completo"
UPDATED_TEXT_LINK = "Texto actualizado"
MODIFIES_LINK = r"verVinculos\.do.*modo=1"
MODIFIED_BY_LINK = r"verVinculos\.do.*modo=2"
OBSERVATIONS_LABEL = "Observaciones:"
NO_NUMBER = "S/N"
NO_COUNT = "0"

# Java regex reads \d, \s and \b as ASCII unless asked for Unicode classes.
U = "(?U)"

# ---------------------------------------------------------------- listing pages
def _listing(pages: DataFrame) -> DataFrame:
    """Adds ``_ids`` to the element table: the norm ids linked from a listing page, distinct, in first-seen order."""
    hits = F.filter("hrefs", lambda h: F.coalesce(h.rlike(NORM_LINK), F.lit(False)))
    # An id beyond 64 bits is no norm id (null): it is dropped, not an error.
    ids = F.array_distinct(F.array_compact(F.transform(hits, lambda h: F.regexp_extract(h, NORM_ID, 1).try_cast("long"))))
    return with_elements(pages).withColumn("_ids", ids)


def extract_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, norm_id)``: one row per linked norm id, ``pos`` 0-based."""
    return _listing(pages).select(F.col("_id").alias("page_id"), F.posexplode("_ids").alias("pos", "norm_id")) \
        .select("page_id", F.col("pos").cast("long").alias("pos"), "norm_id")


def classify_listing(pages: DataFrame) -> DataFrame:
    """``(page_id, status, n_ids)``: "found" with ids; without ids "empty" when the page
    says there are no results, else "suspect" (a day that must not pass silently)."""
    n = F.size("_ids")
    low = F.lower(F.col("_id.html"))
    says_empty = F.lit(False)
    for m in EMPTY_LISTING_MARKERS:
        says_empty = says_empty | low.contains(m)
    status = F.when(n > 0, "found").when(says_empty, "empty").otherwise("suspect")
    listed = _listing(pages.select(F.struct("page_id", "html").alias("page_id"), "html"))
    return listed.select(F.col("_id.page_id").alias("page_id"), status.alias("status"), n.cast("long").alias("n_ids"))


def cap_flags(links: DataFrame, n: int | None = None) -> DataFrame:
    """Every id of each listing with ``kept``: whether it is among the first ``n`` in page
    order (``pos`` from ``extract_links``; no cap when ``n`` is None)."""
    return links.withColumn("kept", F.lit(True) if n is None else F.col("pos") < n)


def daily_cap(links: DataFrame, n: int | None = None) -> DataFrame:
    """The ids that ``cap_flags`` keeps: all of them unless a cap is asked for."""
    return cap_flags(links, n).where("kept").drop("kept")


# ---------------------------------------------------------------- rules over the element table
def _text_of(place, sep: str = "") -> Column:
    """Text of the element at a place; '' without one."""
    return F.coalesce(joined_text(text_pieces(place), sep), F.lit(""))


def _raw_text(place) -> Column:
    return F.coalesce(F.array_join(text_pieces(place), ""), F.lit(""))


def date_text(c) -> Column:
    """Normalised ``yyyy-MM-dd`` text of a bulletin date, NULL when not a date."""
    return F.date_format(norm_date(c), "yyyy-MM-dd")


def _header(table: DataFrame) -> DataFrame:
    """``_hdr``: the text of the first <strong>, pieces joined by a space, whitespace collapsed; NULL without one."""
    table = table.withColumn("_strong", first_tag("strong"))
    return table.withColumn("_hdr", F.when(F.col("_strong").isNotNull(), strip_ws(collapse_ws(_text_of(F.col("_strong"), " ")))))


def _header_fields() -> dict[str, Column]:
    # The type rule already takes every word before the number, so nothing is ever left for the class:
    # the column is kept, always empty.
    header = F.coalesce("_hdr", F.lit(""))
    number = F.regexp_extract(header, U + NUMERO, 1)
    return {"tipo_norma": strip_ws(F.regexp_extract(header, U + TIPO, 1)),
            "numero_norma": F.when(number != "", number).otherwise(F.lit(NO_NUMBER)),
            "clase_norma": F.lit(""),
            "organismo_origen": strip_ws(F.regexp_extract(header, U + ORGANISMO, 1))}


def _titles(table: DataFrame) -> DataFrame:
    """``_h1``, and ``_date`` and ``_sum``, the texts of the first spans of the two classes."""
    table = table.withColumns({"_h1": first_tag("h1"), "_date_at": first_tag("span", lambda i: has_class(i, DATE_CLASS)),
                               "_sum_at": first_tag("span", lambda i: has_class(i, SUMMARY_CLASS))})
    return table.withColumns({"_date": _text_of(F.col("_date_at")), "_sum": _text_of(F.col("_sum_at"))})


def _title_fields() -> dict[str, Column]:
    titled = F.col("_h1").isNotNull()
    return {"fecha_sancion": F.coalesce(date_text(F.col("_date")), F.col("_date")),
            "titulo_resumido": _text_of(F.col("_h1")), "titulo_sumario": F.when(titled, F.col("_sum")).otherwise(F.lit(""))}


def _bulletin(table: DataFrame) -> DataFrame:
    """``_bp``, the first <p> that follows <h1> under the same parent, its text ``_bt``, and ``_bl``, the text of its date link."""
    table = table.withColumn("_bp", F.when(F.col("_h1").isNotNull(), next_sibling(F.col("_h1"), "p")))
    table = table.withColumns({"_bt": _raw_text(F.col("_bp")), "_be": F.size(text_pieces(F.col("_bp")))})
    link = F.get(F.filter(places(F.col("_bp") + 1, F.col("_bp") + F.col("_be") - 1),
                          lambda i: (F.get(F.col("tags"), i - 1) == "a") & href(i).contains(BULLETIN_DATE_LINK)), 0)
    return table.withColumn("_bl_at", F.when(F.col("_bp").isNotNull(), link)).withColumn("_bl", _text_of(F.col("_bl_at")))


def _bulletin_fields() -> dict[str, Column]:
    text = F.col("_bt")
    return {"numero_boletin": F.regexp_extract(text, U + BULLETIN_NUMBER, 1),
            "fecha_boletin": F.coalesce(date_text(F.col("_bl")), date_text(F.regexp_extract(text, BULLETIN_DATE, 1)), F.lit("")),
            "pagina_boletin": F.regexp_extract(text, U + BULLETIN_PAGE, 1)}


def _unlabelled(t) -> Column:
    """``t`` without a leading ``LABEL`` (any case, then Java whitespace): a test
    of the first characters and a character trim, so a long text is not scanned
    position by position as an anchored ``regexp_replace`` would."""
    return F.when(F.lower(F.substring(t, 1, len(LABEL))) == LABEL,
                  F.ltrim(F.substring(t, len(LABEL) + 1, 1 << 30), F.lit(JAVA_SPACE_CHARS))).otherwise(t)


def _label_paragraphs() -> Column:
    """Places of the <p> whose text begins with the label. The label may be cut by tags, so a paragraph counts if its
    first text can begin the label; its whole text decides."""
    first = lambda i: F.get(F.filter(F.transform(text_pieces(i), strip_ws), lambda x: x != ""), 0)
    begins = lambda t: F.startswith(F.lit(LABEL), F.lower(F.substring(t, 1, len(LABEL))))
    labelled = lambda i: F.substring(_text_of(i), 1, len(LABEL)).isin(LABEL, LABEL.capitalize())
    return F.filter(places(F.lit(1), F.size("tags")), lambda i: (F.get(F.col("tags"), i - 1) == "p")
                    & F.when(begins(first(i)), labelled(i)).otherwise(F.lit(False)))


def _summary(table: DataFrame) -> DataFrame:
    """``_res_a``: the text of the element around the first <strong> whose only text contains the label, label removed
    (NULL without one); ``_res_b``: the texts of the paragraphs that begin with the label, label removed."""
    table = table.withColumns({"_lab": only_text("strong", "Resumen", any_case=False), "_lp": _label_paragraphs()})
    table = table.withColumn("_par", F.when(F.col("_lab").isNotNull(), parent_of(F.col("_lab"))))
    table = table.withColumns({"_res_t": F.when(F.col("_par").isNotNull(), _text_of(F.col("_par"))), "_res_p": F.transform("_lp", lambda i: _text_of(i))})
    return table.withColumns({"_res_a": _unlabelled(F.col("_res_t")), "_res_b": F.transform("_res_p", _unlabelled)})


def _summary_fields() -> dict[str, Column]:
    """The labelled element's text, else the first labelled paragraph's, if long enough."""
    first = F.get(F.filter("_res_b", lambda t: F.length(t) > RESUMEN_MIN_LEN), 0)
    return {"texto_resumido": F.coalesce(F.when(F.length("_res_a") > RESUMEN_MIN_LEN, F.col("_res_a")), first, F.lit(""))}


def _links(table: DataFrame) -> DataFrame:
    """``_full`` and ``_upd``, the targets of the links with these texts, and ``_to`` and ``_by``, the texts of the counting links."""
    counting = lambda rule: first_tag("a", lambda i: F.coalesce(href(i).rlike(rule), F.lit(False)))
    table = table.withColumns({"_full_at": only_text("a", FULL_TEXT_LINK), "_upd_at": only_text("a", UPDATED_TEXT_LINK),
                               "_to_at": counting(MODIFIES_LINK), "_by_at": counting(MODIFIED_BY_LINK)})
    return table.withColumns({"_full": F.coalesce(href(F.col("_full_at")), F.lit("")), "_upd": F.coalesce(href(F.col("_upd_at")), F.lit("")),
                              "_to": _raw_text(F.col("_to_at")), "_by": _raw_text(F.col("_by_at"))})


def _link_fields(base: str) -> dict[str, Column]:
    absolute = lambda c: F.when(F.col(c) != "", resolve_url(F.col(c), base)).otherwise(F.lit(""))
    count = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, U + r"(\d+)", 1), F.lit("")), F.lit(NO_COUNT))
    return {"texto_original": absolute("_full"), "texto_actualizado": absolute("_upd"), "modificada_por": count("_by"), "modifica_a": count("_to")}


def _observations(table: DataFrame) -> DataFrame:
    table = table.withColumn("_obs_at", only_text("strong", OBSERVATIONS_LABEL))
    return table.withColumn("_obs", F.coalesce(text_behind(F.col("_obs_at")), F.lit("")))


def _fields(table: DataFrame, fields: dict[str, Column], *names: str) -> DataFrame:
    return table.select(F.col("_id").alias("page_id"), *[fields[n].alias(n) for n in names or fields])


# ---------------------------------------------------------------- the fields one by one
def extract_tipo(pages: DataFrame) -> DataFrame:
    return _fields(_header(with_elements(pages)), _header_fields(), "tipo_norma")


def extract_numero(pages: DataFrame) -> DataFrame:
    return _fields(_header(with_elements(pages)), _header_fields(), "numero_norma")


def extract_organismo(pages: DataFrame) -> DataFrame:
    return _fields(_header(with_elements(pages)), _header_fields(), "organismo_origen")


def extract_clase(pages: DataFrame) -> DataFrame:
    """The class between type and number: always empty (see ``_header_fields``)."""
    return _fields(_header(with_elements(pages)), _header_fields(), "clase_norma")


def extract_fecha_sancion(pages: DataFrame) -> DataFrame:
    """Sanction date: normalised when it parses, else the raw text (quarantined at load)."""
    return _fields(_titles(with_elements(pages)), _title_fields(), "fecha_sancion")


def extract_titles(pages: DataFrame) -> DataFrame:
    """Title from the first <h1> (pieces joined with no separator); summary title from
    the first ``span.destacado``, only on pages that have an <h1>."""
    return _fields(_titles(with_elements(pages)), _title_fields(), "titulo_resumido", "titulo_sumario")


def extract_boletin(pages: DataFrame) -> DataFrame:
    """Bulletin date (from the ``page_id=216`` link, else a DD-MMM-YYYY text), number
    and page, read from the paragraph after the title."""
    return _fields(_bulletin(_titles(with_elements(pages))), _bulletin_fields(), "fecha_boletin", "numero_boletin", "pagina_boletin")


def extract_resumen(pages: DataFrame) -> DataFrame:
    """Summary text after the "Resumen:" label (kept only when longer than 10 characters)."""
    return _fields(_summary(with_elements(pages)), _summary_fields())


def extract_text_links(pages: DataFrame, base: str) -> DataFrame:
    """Links of the full and the updated text, made absolute against ``base``."""
    return _fields(_links(with_elements(pages)), _link_fields(base), "texto_original", "texto_actualizado")


def extract_modifications(pages: DataFrame) -> DataFrame:
    """How many norms this one modifies (``modo=1`` link) and is modified by (``modo=2``)."""
    return _fields(_links(with_elements(pages)), _link_fields(""), "modifica_a", "modificada_por")


def extract_observaciones(pages: DataFrame) -> DataFrame:
    """The text right after the "Observaciones:" label."""
    return _fields(_observations(with_elements(pages)), {"observaciones": strip_ws("_obs")})


def extract_norms(pages: DataFrame, base: str, id_col: str = "page_id") -> DataFrame:
    """All 17 fields of each norm page as text (the daily file's row), in file order.

    Narrow projections over the pages (no shuffle): the element table once, then the places that the rules
    need, then the fields. Each step's columns are read more than once, so Catalyst keeps them instead of
    repeating them.
    """
    table = _observations(_links(_summary(_bulletin(_titles(_header(with_elements(pages, id_col)))))))
    fields = {"id_norma": F.col("_id").cast("long").cast("string"), "observaciones": strip_ws("_obs"),
              **_header_fields(), **_title_fields(), **_bulletin_fields(), **_summary_fields(), **_link_fields(base)}
    return table.select(*[fields[c].alias(c) for c in NORM_COLUMNS])
