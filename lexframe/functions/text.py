"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class written so that Java regex and RE2 read it the same way (NBSP included).
WS = r"[\s\x{00a0}]"

# Named character references as Python ships them: HTML 4's first, since a map is searched in order, then HTML 5's.
HTML_ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()}
HTML_ENTITIES |= {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";") and name[:-1] not in HTML_ENTITIES}
# Those that are read without their semicolon, too.
BARE_ENTITIES = {name: text for name, text in html.entities.html5.items() if not name.endswith(";")}

# Spanish month abbreviations of the bulletin's DD-MMM-YYYY dates.
SPANISH_MONTHS = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _entity_map(entities: dict) -> Column:
    # One constant instead of two literals per entity: it is folded once when a query is planned.
    return F.from_json(F.lit(json.dumps(entities)), "map<string,string>")


# Numeric references from 128 to 159 name bytes of windows-1252 (five of which are undefined there).
WINDOWS_1252 = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _code_point(n) -> Column:
    """The character of a numeric reference, NULL outside Unicode's scalar values: its UTF-32 bytes decoded."""
    valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.coalesce(F.when(n.between(0x80, 0x9F), F.try_element_at(_entity_map(WINDOWS_1252), n.cast("string"))),
                      F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def decode_entities(c, attribute: bool = False) -> Column:
    """Decode named references (``&aacute;``, HTML 5's too) and numeric ones (``&#243;``, ``&#xF3;``) in one
    pass: the text is split at each ``&`` and a piece starting with a known name gets its character back (each
    is decoded once, so ``&amp;lt;`` stays ``&lt;``; an unknown one stays as it is). Numbers and the names of
    ``BARE_ENTITIES`` need no semicolon; in an attribute a bare name before ``=`` is a parameter of a link."""
    names, bare = _entity_map(HTML_ENTITIES), _entity_map(BARE_ENTITIES)

    def piece(p, i):
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*)", 1)
        after = F.substr(p, F.length(name) + 1, F.lit(1))
        closed = after == ";"
        hexed = F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x"
        code = F.when(hexed, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        named = F.when(closed, F.try_element_at(names, name)).otherwise(F.try_element_at(bare, name) if not attribute else
                                                                        F.when(after != "=", F.try_element_at(bare, name)))
        char = F.when(name.startswith("#"), _code_point(code.try_cast("int"))).otherwise(named)
        return (F.when(i == 0, p)
                .when(char.isNotNull(), F.concat(char, F.substr(p, F.length(name) + F.when(closed, 2).otherwise(1))))
                .otherwise(F.concat(F.lit("&"), p)))
    x = _col(c)
    return F.when(F.instr(x, "&") == 0, x).otherwise(F.array_join(F.transform(F.split(x, "&"), piece), ""))


# The characters of ``WS``: Java regex ``\s`` without the Unicode flag, and NBSP.
JAVA_SPACE_CHARS = " \t\n\x0b\f\r"
WS_CHARS = JAVA_SPACE_CHARS + "\u00a0"


def strip_ws(c) -> Column:
    """Trim the ``WS`` characters at both ends (Spark's one-argument ``trim`` only
    removes spaces); a plain character trim, no regular expression."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    return F.regexp_replace(_col(c), rf"{WS}+", " ")


def clean_html(c) -> Column:
    """Drop scripts, styles, comments and declarations so that their text is never extracted."""
    # the shared "<" is factored out so the matcher rejects every other position at once
    return F.regexp_replace(
        _col(c), r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->|[!?][^>]*>)", "")


def norm_date(c) -> Column:
    """Bulletin date text → DATE.

    ``D/M/YYYY`` (whole value, calendar-checked) first; else a leading
    ``DD-MMM-YYYY`` with a Spanish month, any case, trailing text allowed; else NULL.
    Impossible calendar days (31-FEB) are NULL here and go to quarantine.
    """
    s = strip_ws(_col(c))
    slash = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(s, F.lit("d/M/yyyy")))
    m = F.regexp_extract(s, r"^(\d{2})-([A-Za-z]{3})-(\d{4})", 2)
    month_map = F.create_map(*[x for i, name in enumerate(SPANISH_MONTHS)
                               for x in (F.lit(name), F.lit(f"{i + 1:02d}"))])
    month = F.try_element_at(month_map, F.upper(m))
    iso = F.concat(F.regexp_extract(s, r"^(\d{2})-([A-Za-z]{3})-(\d{4})", 3), F.lit("-"), month,
                   F.lit("-"), F.regexp_extract(s, r"^(\d{2})-([A-Za-z]{3})-(\d{4})", 1))
    dashed = F.when(m != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
    return F.to_date(F.coalesce(slash, dashed))


def resolve_url(href, base: str) -> Column:
    """Absolute link: kept when it starts with ``http``, else prefixed with ``base``."""
    h = _col(href)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base), h))


def source_name(c) -> Column:
    """Last ``/`` segment of a source path; "unknown" when missing."""
    return F.element_at(F.split(F.coalesce(_col(c), F.lit("unknown")), "/"), -1)


def workday_add(start: str, n) -> Column:
    """The ``n``-th working day (Mon–Fri) counted from ``start`` (itself a working day)."""
    n = _col(n).cast("long")
    d0 = F.to_date(F.lit(start))
    rem = F.pmod(n, F.lit(5))
    extra = F.when(F.weekday(d0) + rem >= 5, 2).otherwise(0)
    days = (F.floor(n / 5) * 7 + rem + extra).cast("int")
    return F.date_add(d0, days)
