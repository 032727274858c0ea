"""Pages as nested columns, and selectors over them.

parse_dom() turns a page into one struct: its elements in document order (each knows its last descendant,
so "inside" is a range test, and its keys: tag, .class and #id), its visible strings and its scripts. The selectors of
the rule table are matched in the same pass, through an index by tag, class and id: each element carries the numbers of
those it matches, so a selector in a plan is one lookup, however many rules there are. Everything after parsing is
built-in array functions on that struct, so extraction never moves a page between tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrawl import fixed_values as fv
from papertrawl.functions.text import or_blank
from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

ELEMENT = (
    T.StructType()
    .add("idx", T.IntegerType()).add("last", T.IntegerType()).add("parent", T.IntegerType())
    .add("tag", T.StringType()).add("keys", T.ArrayType(T.StringType()))
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    # places of its strings and scripts, those of its descendants included: first, and past the last
    .add("strings_from", T.IntegerType()).add("strings_to", T.IntegerType())
    .add("scripts_from", T.IntegerType()).add("scripts_to", T.IntegerType())
    # rules it matches, each with the highest of the elements that the match stands on
    .add("rules", T.MapType(T.IntegerType(), T.IntegerType()))
)
ELEMENTS = T.ArrayType(ELEMENT)
STRINGS = T.ArrayType(T.StructType().add("el", T.IntegerType()).add("text", T.StringType()))
# strings_at, scripts_at: how many of the page's strings and scripts come before those of this tree; above: the
# element the tree lies below
DOM = (T.StructType().add("elements", ELEMENTS).add("strings", STRINGS).add("scripts", STRINGS)
       .add("strings_at", T.IntegerType()).add("scripts_at", T.IntegerType()).add("above", T.IntegerType()))

_STRING_TYPE = pa.list_(pa.struct([("el", pa.int32()), ("text", pa.string())]))
_DOM_TYPE = pa.struct([
    ("elements", pa.list_(pa.struct([
        ("idx", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()),
        ("keys", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        *[(f"{part}_{end}", pa.int32()) for part in ("strings", "scripts") for end in ("from", "to")],
        ("rules", pa.map_(pa.int32(), pa.int32())),
    ]))),
    ("strings", _STRING_TYPE),
    ("scripts", _STRING_TYPE),
    ("strings_at", pa.int32()), ("scripts_at", pa.int32()), ("above", pa.int32()),
])
# HTML's elements without content, and those whose content is not text
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}
#: Characters of the pages whose trees are held at a time.
PARSED_CHARS = 500_000


# ---- the rule table -------------------------------------------------------------------------------

_PART = re.compile(
    r"\.[\w-]+|#[\w-]+|\[(?P<attr>[\w-]+)(?P<op>[*^]?=)'(?P<value>[^']*)'\]"
    r"|:not\(\.(?P<no>[\w-]+)\)|^[\w-]+"
)


def _selectors(values) -> list[str]:
    """The strings in nested lists, tuples and dictionaries of them, in order."""
    if isinstance(values, str):
        return [values]
    if isinstance(values, dict):
        values = list(values.values())
    return [s for v in values for s in _selectors(v)]


#: Selectors matched while a page is read; their place is their number. Others work too, as expressions.
RULES = {s: i for i, s in enumerate(dict.fromkeys([
    *_selectors([fv.LISTING_CARDS, fv.LISTING_NAME, fv.LISTING_PHONE, fv.LISTING_ADDRESS, fv.SERVICE_CARDS, fv.SERVICE_NAME,
                 fv.SERVICE_ADDRESS, fv.SERP_ITEMS, fv.SERP_TITLE, fv.SERP_SNIPPET, fv.BUSINESS_NAME, fv.SITE_ADDRESS,
                 fv.AMAZON_SELECTORS, fv.FLIPKART_SELECTORS, fv.RESTAURANT_TITLE, fv.RESTAURANT_CUISINE,
                 [rule[1:] for rule in fv.BRAND_SELECTORS]]),
    ", ".join(fv.HEADINGS), "[data-email*='']", "a[href^='http']", "ul a[href^='/']", "li a", "span", "title",
]))}


def _steps(selector: str) -> list[tuple[bool, list[tuple]]]:
    """Compounds from right to left, each as tests of (kind, name, value); whether it must be the parent of the last."""
    steps = [s for s in re.split(r"\s*(>)\s*|\s+", selector.strip()) if s]
    out, child = [], False
    for step in reversed(steps):
        if step == ">":
            child = True
            continue
        tests = [("no", "." + p["no"], "") if p["no"] else (p["op"], p["attr"], p["value"]) if p["attr"] else ("key", p[0], "")
                 for p in _PART.finditer(step)]
        out.append((child, tests))
        child = False
    return out


class Matcher:
    """The rule table, found by the keys of an element."""

    def __init__(self, rules: dict[str, int]):
        self.by_key: dict[str, list] = {}
        self.by_attr: dict[str, list] = {}
        for selector, number in rules.items():
            for one in selector.split(","):
                steps = _steps(one)
                keys = [name for kind, name, _ in steps[0][1] if kind == "key"]
                attrs = [name for kind, name, _ in steps[0][1] if kind.endswith("=")]
                index, at = (self.by_key, keys[-1]) if keys else (self.by_attr, attrs[0])
                index.setdefault(at, []).append((number, steps))

    @staticmethod
    def holds(el: dict, tests: list[tuple]) -> bool:
        for kind, name, value in tests:
            if kind == "key":
                good = name in el["keys"]
            elif kind == "no":
                good = name not in el["keys"]
            else:
                own = el["values"].get(name, "")
                good = value in own if kind == "*=" else own.startswith(value) if kind == "^=" else own == value
            if not good:
                return False
        return True

    def highest(self, elements: list[dict], el: dict, steps: list, k: int) -> int:
        """The lowest-lying choice for the highest element that a match of steps k and on stands on; -1 without a match."""
        if not self.holds(el, steps[k][1]):
            return -1
        if k + 1 == len(steps):
            return el["idx"]
        best, up = -1, el["parent"]
        while up >= 0:
            best = max(best, self.highest(elements, elements[up], steps, k + 1))
            if steps[k + 1][0]:
                break  # only the parent counts
            up = elements[up]["parent"] if best < 0 else -1  # a nearer ancestor stands on nearer ones
        return best

    def rules_of(self, elements: list[dict], el: dict) -> dict[int, int]:
        found: dict[int, int] = {}
        for index, names in ((self.by_key, el["keys"]), (self.by_attr, el["values"])):
            for name in names:
                for number, steps in index.get(name, ()):
                    top = self.highest(elements, el, steps, 0)
                    if top > found.get(number, -1):
                        found[number] = top
        return found


_MATCHER = Matcher(RULES)


class _Tree(HTMLParser):
    """Collects elements and strings; unclosed tags nest, an end tag closes up to its nearest opener."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [{"idx": 0, "last": 0, "parent": -1, "tag": "[document]", "keys": [], "attrs": [],
                          "strings_from": 0, "strings_to": 0, "scripts_from": 0, "scripts_to": 0, "rules": [], "values": {}}]
        self.strings: list[dict] = []
        self.scripts: list[dict] = []
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        idx = len(self.elements)
        values = {name: value or "" for name, value in attrs}
        keys = [tag, *("." + c for c in values.get("class", "").split()), "#" + values.get("id", "")]
        self.elements.append({"idx": idx, "last": idx, "parent": self.open[-1], "tag": tag, "keys": keys,
                              "attrs": list(values.items()),
                              "strings_from": len(self.strings), "strings_to": len(self.strings),
                              "scripts_from": len(self.scripts), "scripts_to": len(self.scripts), "values": values})
        self.elements[-1]["rules"] = list(_MATCHER.rules_of(self.elements, self.elements[-1]).items())
        if tag not in _VOID:
            self.open.append(idx)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        text = data.strip()
        if text:
            owner = self.open[-1]
            hidden = self.elements[owner]["tag"] in _HIDDEN
            (self.scripts if hidden else self.strings).append({"el": owner, "text": text})

    def _close(self, depth: int) -> None:
        newest = len(self.elements) - 1
        for idx in self.open[depth:]:
            self.elements[idx] |= {"last": newest, "strings_to": len(self.strings), "scripts_to": len(self.scripts)}
        del self.open[depth:]

    def tree(self, html: str) -> dict:
        self.feed(html)
        self.close()
        self._close(0)
        return {"elements": self.elements, "strings": self.strings, "scripts": self.scripts, "strings_at": 0, "scripts_at": 0, "above": -1}


def _slices(html: pa.Array, chars: int = PARSED_CHARS) -> Iterator[list[str]]:
    """Pages in order, as many at a time as hold so many characters."""
    pages, size = [], 0
    for page in html:
        pages.append(page.as_py() or "")
        size += len(pages[-1]) + 1000
        if size >= chars:
            yield pages
            pages, size = [], 0
    if pages:
        yield pages


@F.arrow_udf(DOM)
def parse_dom(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Trees of pages, a slice at a time: a batch of rows may hold any number of long pages."""
    for html in batches:
        for pages in _slices(html):
            yield pa.array([_Tree().tree(page) for page in pages], type=_DOM_TYPE)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside array functions nothing else shares work."""
    return F.get(F.transform(F.array(value), use), 0)


# ---- reading a tree -------------------------------------------------------------------------------


def inside(dom: Column, part: str, el: Column) -> Column:
    """Strings or scripts of an element and its descendants: a slice, as they stand in document order."""
    first = el[f"{part}_from"]
    return F.slice(dom[part], first - dom[f"{part}_at"] + 1, el[f"{part}_to"] - first)


def text_of(dom: Column, el: Column, separator: str = " ") -> Column:
    """Visible text of an element and its descendants; blank for a missing element."""
    return or_blank(bind(
        el, lambda e: F.array_join(F.transform(inside(dom, "strings", e), lambda s: s["text"]), separator)
    ))


def page_text(dom: Column) -> Column:
    return F.array_join(F.transform(dom["strings"], lambda s: s["text"]), " ")


def attr(el: Column, name: str) -> Column:
    return or_blank(F.try_element_at(el["attrs"], F.lit(name)))


def subtree(dom: Column, el: Column) -> Column:
    """The tree below an element, in the same shape, so that selectors apply to it alone."""
    return F.struct(
        F.filter(dom["elements"], lambda e: (e["idx"] > el["idx"]) & (e["idx"] <= el["last"])).alias("elements"),
        inside(dom, "strings", el).alias("strings"),
        inside(dom, "scripts", el).alias("scripts"),
        el["strings_from"].alias("strings_at"), el["scripts_from"].alias("scripts_at"), el["idx"].alias("above"),
    )


def jsonld_scripts(dom: Column) -> Column:
    """Contents of the ld+json scripts of a tree."""
    owners = F.transform(
        F.filter(dom["elements"], lambda e: (e["tag"] == "script") & (attr(e, "type") == "application/ld+json")),
        lambda e: e["idx"],
    )
    return F.transform(
        F.filter(dom["scripts"], lambda s: F.array_contains(owners, s["el"])), lambda s: s["text"]
    )


# ---- selectors ------------------------------------------------------------------------------------

def _simple(selector: str) -> Callable[[Column], Column]:
    """One compound selector: tag, .class, #id, [attr='v'], [attr*='v'], [attr^='v'], :not(.class)."""
    def check(el: Column, part: re.Match) -> Column:
        if part["attr"]:
            value = attr(el, part["attr"])
            if part["op"] == "*=":
                return F.contains(value, F.lit(part["value"]))
            return value.startswith(part["value"]) if part["op"] == "^=" else value == part["value"]
        if part["no"]:
            return ~F.array_contains(el["keys"], "." + part["no"])
        return F.array_contains(el["keys"], part[0])

    def test(el: Column) -> Column:
        return reduce(and_, [check(el, part) for part in _PART.finditer(selector)])

    return test


def _matches(dom: Column, el: Column, selector: str) -> Column:
    """One selector without commas; ancestors are looked up in the same tree."""
    steps = re.split(r"\s*(>)\s*|\s+", selector.strip())
    steps = [s for s in steps if s]
    hit = _simple(steps[-1])(el)
    if len(steps) == 1:
        return hit
    child_only = steps[-2] == ">"
    above = " ".join(steps[:-2] if child_only else steps[:-1])

    def is_above(a: Column) -> Column:
        place = (a["idx"] == el["parent"]) if child_only else (
            (a["idx"] < el["idx"]) & (a["last"] >= el["last"])
        )
        return place & _matches(dom, a, above)

    return hit & F.exists(dom["elements"], is_above)


def matches(dom: Column, el: Column, selector: str) -> Column:
    """Whether an element matches inside this tree: all that the match stands on must lie in it."""
    if selector in RULES:
        return F.coalesce(F.try_element_at(el["rules"], F.lit(RULES[selector])) > dom["above"], F.lit(False))
    return reduce(or_, [_matches(dom, el, one) for one in selector.split(",")])


def select(dom: Column, selector: str) -> Column:
    return F.filter(dom["elements"], lambda el: matches(dom, el, selector))


def select_one(dom: Column, selector: str) -> Column:
    return F.get(select(dom, selector), 0)


def select_cascade(dom: Column, selectors: list[str]) -> Column:
    """All elements of the first selector that matches anything."""
    found = [bind(select(dom, s), lambda f: F.when(F.size(f) > 0, f)) for s in selectors]
    return F.coalesce(*found, F.array().cast(ELEMENTS))


def first_match(dom: Column, selectors: list[str]) -> Column:
    """First match of the first selector that matches at all."""
    return F.coalesce(*[select_one(dom, s) for s in selectors])


def first_element(dom: Column, selectors: list[str]) -> Column:
    """First match of the first selector whose first match has text."""
    def with_text(el: Column) -> Column:
        return F.when(F.exists(dom["strings"], lambda s: s["el"].between(el["idx"], el["last"])), el)

    return F.coalesce(*[bind(select_one(dom, s), with_text) for s in selectors])


def first_filled_text(dom: Column, selectors: list[str]) -> Column:
    return text_of(dom, first_element(dom, selectors))


def first_text(dom: Column, selectors: list[str]) -> Column:
    """Text of the first selector that matches, even when that text is blank."""
    return text_of(dom, first_match(dom, selectors), "")
