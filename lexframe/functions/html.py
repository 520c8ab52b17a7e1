"""The element table of a page, as native array columns.

``with_elements`` cuts the HTML into tokens, a tag and the text up to the next one, and adds per token the
tag's name (``/name`` when it closes), the text (decoded), the target of a link, the classes of a span, and
the depth: how many elements are open after it. One fold keeps the open elements, as the page parser does: a closing tag closes everything down to its last
opening, and is ignored without one; void and self-closing tags stay closed. Place 1 is the
page itself. All else follows from these arrays, without a look at the HTML: an element ends at the first later
place that is less deep than it, and its parent's children are as deep as itself.

Attributes may be quoted either way, bare or missing; a ``>`` inside quotes does not end a tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.text import clean_html, decode_entities, strip_ws

# Elements without content, which never stay open.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: A tag: quotes count after an equals sign only, as in ``title=it's``.
TAG = r"""<[A-Za-z/](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>"""
_TEXT = r"(?:[^<]++|<(?![A-Za-z/]))*+"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
_ATTRIBUTE = r"""(?:[\s/]+(?!%s[\s=/>])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*+"""
_PAGE = "<page_>"


def with_elements(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(_id, tokens, tags, texts, hrefs, classes, depths)`` of each page. A null page is an empty one."""
    staged = pages.select(F.col(id_col).alias("_id"), F.concat(F.lit(_PAGE), F.coalesce(clean_html(F.col("html")), F.lit(""))).alias("_page"))
    staged = staged.select("_id", F.regexp_extract_all("_page", F.lit(f"({TAG}){_TEXT}"), 1).alias("tokens"),
                           F.regexp_extract_all("_page", F.lit(f"{TAG}({_TEXT})"), 1).alias("texts"))
    staged = staged.withColumns({"tags": _once(F.transform("tokens", lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][^\s/>]*)", 1)))),
                                 "texts": _once(F.transform("texts", lambda t: decode_entities(t)))})
    own = lambda tag, name: F.zip_with("tags", "tokens", lambda x, t: F.when(x == tag, _attribute(t, name)))
    return staged.withColumns({"hrefs": _once(own("a", "href")), "classes": _once(own("span", "class")),
                               "depths": _once(_depths(F.zip_with("tags", "tokens", lambda x, t: F.struct(x.alias("tag"), _opens(x, t).alias("opens")))))})


def _once(column: Column) -> Column:
    """The column, marked so that Catalyst never copies it into the lambdas that look it up place by place, where it
    would be computed anew for each place: a column that depends on a random number (any will do) is not copied."""
    return F.when(F.rand(1) >= 0, column)


def _opens(tag: Column, token: Column) -> Column:
    """Whether a token opens an element that stays open."""
    return (tag != "") & ~tag.startswith("/") & ~tag.isin(VOID_TAGS) & ~(token.endswith("/>") & token.rlike(r"""(?s)^<[^\s/>]*/>$|[\s"']/>$"""))


def _attribute(token: Column, name: str) -> Column:
    """The value of a tag's attribute (decoded; '' when bare or empty), NULL when the tag lacks it."""
    head = rf"(?is)^<[a-z][^\s/>]*{_ATTRIBUTE % name}[\s/]+{name}"
    value = F.concat(*(F.regexp_extract(token, rf"{head}\s*=\s*{_VALUE}", g) for g in (1, 2, 3)))
    return F.when(token.rlike(rf"{head}(?=[\s=/>])"), decode_entities(value, attribute=True))


def _depths(tokens: Column) -> Column:
    state = "struct<open:array<string>,depths:array<int>>"

    def step(acc, token):
        tag, held = token["tag"], acc["open"]
        last = F.array_position(F.reverse(held), F.substr(tag, F.lit(2)))  # from the innermost; 0 if it is not open
        now = (F.when(token["opens"], F.array_append(held, tag))
               .when(tag.startswith("/") & (last > 0), F.slice(held, F.lit(1), (F.size(held) - last).cast("int"))).otherwise(held))
        return F.struct(now.alias("open"), F.array_append(acc["depths"], F.size(now)).alias("depths")).cast(state)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("depths")).cast(state)
    return F.aggregate(tokens, start, step)["depths"]


def places(first, last) -> Column:
    """Places from ``first`` to ``last``, none if there are none between."""
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _at(column: str, place) -> Column:
    return F.get(F.col(column), place.cast("int") - 1)


def _size() -> Column:
    return F.size("tags")


def stays_open(place) -> Column:
    """Whether the tag at a place opened an element: its depth counts it."""
    return _at("depths", place) > F.coalesce(_at("depths", place - 1), F.lit(0))


def end_of(place) -> Column:
    """The first place behind the element that begins at ``place``; a tag that stays closed ends at the next."""
    depth = _at("depths", place)
    behind = F.array_position(F.transform(F.slice("depths", place.cast("int") + 1, _size()), lambda d: d < depth), True)
    return F.when(~stays_open(place), place + 1).when(behind > 0, place + behind).otherwise(_size() + 1).cast("int")


def first_tag(tag: str, also=None) -> Column:
    """The place of the first ``tag`` (for which ``also(place)`` holds); NULL without one."""
    if also is None:
        return F.nullif(F.array_position("tags", tag), F.lit(0)).cast("int")
    return F.get(F.filter(places(F.lit(1), _size()), lambda i: (_at("tags", i) == tag) & also(i)), 0)


def text_pieces(place) -> Column:
    """The texts inside the element at ``place``."""
    return F.slice("texts", place.cast("int"), end_of(place) - place.cast("int"))


def joined_text(pieces, sep: str = "") -> Column:
    """Pieces trimmed, empty ones dropped, joined by ``sep``."""
    return F.array_join(F.filter(F.transform(pieces, strip_ws), lambda x: x != ""), sep)


def href(place) -> Column:
    """The target of the link at a place, NULL when it has none."""
    return _at("hrefs", place)


def has_class(place, cls: str) -> Column:
    """Whether ``cls`` is among the classes of the span at a place."""
    return F.coalesce(F.array_contains(F.split(_at("classes", place), r"\s+"), cls), F.lit(False))


def only_text(tag: str, needle: str, any_case: bool = True) -> Column:
    """The place of the first ``tag`` whose whole content is one text that contains ``needle``, bare or inside
    elements that hold nothing else; NULL without one.

    From each text with the needle outwards: the tags before it that open with no text between them, and the
    element's end, with nothing but closing tags before it."""
    fold = F.lower if any_case else (lambda x: x)
    wanted = needle.lower() if any_case else needle
    hits = F.filter(places(F.lit(1), _size()), lambda k: F.contains(fold(_at("texts", k)), F.lit(wanted)))

    def holder(k):
        breaks = F.filter(places(F.lit(1), k - 1), lambda j: (_at("texts", j) != "") | ~stays_open(j))
        first = F.coalesce(F.element_at(F.when(F.size(breaks) > 0, breaks), -1) + 1, F.lit(1))
        closed = lambda i: F.forall(places(k + 1, end_of(i) - 1), lambda j: _at("tags", j).startswith("/") & (_at("texts", j) == ""))
        around = F.filter(places(first, k), lambda i: (_at("tags", i) == tag) & stays_open(i))
        return F.get(F.filter(around, closed), 0)
    return F.get(F.filter(F.transform(hits, holder), lambda i: i.isNotNull()), 0)


def parent_of(place) -> Column:
    """The place of the element around the one at ``place``: the last earlier tag that is less deep and opened one."""
    depth = _at("depths", place)
    return F.element_at(F.filter(places(F.lit(1), place - 1), lambda j: (_at("depths", j) == depth - 1) & stays_open(j)), -1)


def next_sibling(place, tag: str) -> Column:
    """The first ``tag`` behind the element at ``place`` under the same parent; NULL without one."""
    depth = _at("depths", place)
    behind = end_of(place)
    over = F.array_position(F.transform(F.slice("depths", behind, _size()), lambda d: d < depth - 1), True)
    stop = F.when(over > 0, behind + over - 1).otherwise(_size() + 1)
    own = lambda j: F.when(stays_open(j), _at("depths", j)).otherwise(_at("depths", j) + 1)
    return F.get(F.filter(places(behind, stop - 1), lambda j: (_at("tags", j) == tag) & (own(j) == depth)), 0)


def text_behind(place) -> Column:
    """The text right behind the closing tag of the element at ``place`` ('' when another tag closes it)."""
    end = end_of(place)
    return F.when(_at("tags", end) == F.concat(F.lit("/"), _at("tags", place)), _at("texts", end)).otherwise(F.lit(""))
