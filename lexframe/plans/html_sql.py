"""DuckDB SQL over raw page HTML, used only by the oracle queries.

Nothing is imported from the code under test: the patterns are stated again here, for
RE2. The page fields themselves are checked against the records that the pages are
rendered from (``catalog.EXTRACTED_SQL``), which needs no HTML in SQL at all.
"""

from __future__ import annotations

# Entities that the driver's pages may hold in links, and month names.
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
MONTHS = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def decode(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def strip(x: str) -> str:
    pat = r"^[\s\x{00a0}]+|[\s\x{00a0}]+$"
    return f"regexp_replace({x}, {q(pat)}, '', 'g')"


def clean(x: str) -> str:
    pat = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
    return f"regexp_replace({x}, {q(pat)}, '', 'g')"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def date_text(x: str) -> str:
    s = strip(x)
    dash = r"^(\d{2})-([A-Za-z]{3})-(\d{4})"
    month = "CASE upper(" + extract(s, dash, 2) + ") " + " ".join(
        f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(MONTHS)) + " END"
    slash = f"CASE WHEN regexp_matches({s}, {q(r'^\d{1,2}/\d{1,2}/\d{4}$')}) THEN try_strptime({s}, '%d/%m/%Y') END"
    dashed = (f"CASE WHEN {extract(s, dash, 2)} <> '' THEN try_strptime({extract(s, dash, 3)} || '-' || {month}"
              f" || '-' || {extract(s, dash, 1)}, '%Y-%m-%d') END")
    return f"strftime(coalesce({slash}, {dashed}), '%Y-%m-%d')"


H = clean("html")
HREF = r"""\bhref\s*=\s*["']?([^"'\s>]*)["']?"""
#: href of every link of a page that has one and is closed, decoded, in page order.
HREFS = (f"list_transform(regexp_extract_all({H}, {q(r'(?is)<a\b[^>]*' + HREF + r'[^>]*>.*?</a')}, 1), lambda h: {decode('h')})")
_IDS = (f"list_transform(list_filter({HREFS}, lambda h: regexp_matches(h, {q(r'verNorma\.do.*\?id=\d+')})),"
        f" lambda h: TRY_CAST({extract('h', r'\?id=(\d+)')} AS BIGINT))")
# Distinct ids in first-seen order.
LISTING_IDS = f"list_filter({_IDS}, lambda x, i: x IS NOT NULL AND list_position({_IDS}, x) = i)"
