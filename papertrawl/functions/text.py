"""Column functions for text, numbers and names. Everything here is a built-in expression."""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(col(c), F.lit(""))


def or_blank(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.lit(""))


def is_filled(c: ColumnOrName) -> Column:
    return or_blank(c) != ""


def strip(c: ColumnOrName) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(fv.WHITESPACE))


def squeeze(c: ColumnOrName) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


#: Letters of the alphabet to what else stands for them where case is ignored.
_SAME_LETTER = {"i": "ı\u0130", "k": "\u212a", "s": "ſ"}
_ALTERNATIVES = re.compile(r"\(\?:((?:[^()\[\]\\]|\\.|\[[^\]]*\]|\((?:[^()\\]|\\.)*\))*)\)(?![?*{])")


def _one_of(letters: str) -> str:
    return "[" + "".join(c.lower() + c.upper() + _SAME_LETTER.get(c.lower(), "") if c.isalpha() else c for c in dict.fromkeys(letters)) + "]"


@cache
def ahead(pattern: str) -> str:
    """The same pattern, tried only at places where its first two letters may stand; such places are quickly told.

    Patterns that do not begin with letters, or alternatives of letters, stay as they are.
    """
    flags, body = re.fullmatch(r"((?:\(\?\w+\))?\^?)(.*)", pattern, re.S).groups()
    choices = _ALTERNATIVES.match(body)
    starts = re.split(r"\|(?![^(]*\))", choices[1]) if choices else [body]
    if "x" in flags or not all(re.match(r"[A-Za-z](?![?*{])", x) for x in starts):
        return pattern
    known = all(re.match(r"[A-Za-z][A-Za-z/](?![?*{])", x) for x in starts)
    look = _one_of([x[0].lower() for x in starts]) + (_one_of([x[1].lower() for x in starts]) if known else "")
    return f"{flags}(?-iU:(?={look})){body}"


def group(text: ColumnOrName, pattern: str, n: int = 1) -> Column:
    """Capture group of the first match, stripped; null when there is no match or it is empty."""
    found = F.array(strip(F.regexp_extract(col(text), ahead(pattern), n)))  # in an array function the match is made once
    return F.get(F.filter(found, lambda x: x != ""), 0)


def groups(text: ColumnOrName, pattern: str, n: int = 1) -> Column:
    """The same capture group of every match."""
    return F.regexp_extract_all(col(text), F.lit(ahead(pattern)), F.lit(n))


def first_group(text: ColumnOrName, patterns: list[str]) -> Column:
    return F.coalesce(*[group(text, p) for p in patterns])


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def number(c: ColumnOrName) -> Column:
    """Digits and dots only, read as a double with two decimals; null when that is no number."""
    digits = F.regexp_replace(col(c), r"[^0-9.]", "")
    return F.round(digits.try_cast("double"), 2)


def number_text(c: Column) -> Column:
    """Shortest text of a two-decimal number with at least one decimal: 508.0, 0.76, 12345678.9."""
    return F.regexp_replace(c.try_cast("decimal(30,2)").cast("string"), r"(\.\d)0$", "$1")


def money(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2))


def percent(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def title_case(c: ColumnOrName) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = groups(c, r"(\p{L}+|[^\p{L}]+)")
    cased = F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(cased, "")


def sentence_case(c: ColumnOrName) -> Column:
    return F.concat(F.upper(F.left(col(c), F.lit(1))), F.lower(F.substr(col(c), F.lit(2))))


def contains_any(text: ColumnOrName, words: list[str]) -> Column:
    return reduce(or_, [F.contains(col(text), F.lit(w)) for w in words])


def _marked(text: Column, words: list[str], whole_words: bool) -> Column:
    """Whether a marker occurs; plain ones are searched as they are, without a pattern."""
    if whole_words and any(len(w) <= 4 for w in words):
        return text.rlike(marker_pattern(words, whole_words))
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def marker_pattern(words: list[str], whole_words: bool) -> str:
    """Markers of up to four letters match as whole words only, unless asked otherwise."""
    def one(word: str) -> str:
        w = re.escape(word)
        return rf"\b{w}\b" if whole_words and len(word) <= 4 else w

    return "|".join(one(w) for w in words)


def first_marked(text: ColumnOrName, rules: list[tuple[list[str], str]], whole_words: bool = True) -> Column:
    """Value of the first rule one of whose markers occurs in the text; null when none does."""
    def first(lowered: Column) -> Column:
        return F.coalesce(*[F.when(_marked(lowered, words, whole_words), F.lit(value)) for words, value in rules])

    return F.get(F.transform(F.array(F.lower(col(text))), first), 0)


def field(value: Column, confidence: Column, engine: str) -> Column:
    """A value with its provenance."""
    return F.struct(
        or_blank(value.cast("string")).alias("value"),
        F.round(confidence.cast("double"), 4).alias("confidence"),
        F.lit("regex").alias("source"),
        F.lit(engine).alias("engine"),
        F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("bbox"),
        F.lit("").alias("raw_ocr"),
    )


# ---- addresses on the web -------------------------------------------------------------------------


def url_host(url: ColumnOrName) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def bare_host(url: ColumnOrName) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def site_base(url: ColumnOrName) -> Column:
    """Scheme and host; empty when either is missing."""
    return F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def url_path(url: ColumnOrName) -> Column:
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


# ---- prices and ratings ---------------------------------------------------------------------------


def price(c: ColumnOrName, strict_parity: bool = False) -> Column:
    """First amount in a price text. With strict_parity every digit and dot is glued together instead."""
    raw = (
        F.regexp_replace(col(c), r"[^0-9.]", "") if strict_parity
        else F.replace(F.regexp_extract(col(c), r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit(""))
    )
    value = raw.try_cast("double")
    return F.when(value > 0, F.round(value, 2))


def first_number(c: ColumnOrName) -> Column:
    return F.regexp_extract(col(c), r"\d+(?:\.\d+)?", 0).try_cast("double")


def rating(c: ColumnOrName, highest: float | None = 5.0) -> Column:
    value = F.regexp_extract(col(c), r"[\d.]+", 0).try_cast("double")
    return value if highest is None else F.when(value <= highest, value)


def review_count(c: ColumnOrName) -> Column:
    return F.replace(F.regexp_extract(col(c), r"[\d,]+", 0), F.lit(","), F.lit("")).try_cast("int")


def discount(now: Column, before: Column) -> Column:
    """Percent off, one decimal; null unless the old price is higher."""
    return F.when((now > 0) & (before > now), F.round((before - now) / before * 100, 1))


def availability_from_text(text: ColumnOrName, has_cart: Column) -> Column:
    t = F.lower(or_blank(text))
    return (
        F.when(t.contains("in stock") | has_cart, "in_stock")
        .when(t.contains("out of stock") | t.contains("currently unavailable"), "out_of_stock")
        .otherwise("limited")
    )


def availability_from_schema(url: ColumnOrName) -> Column:
    t = F.lower(or_blank(url))
    return (
        F.when(t.contains("instock"), "in_stock").when(t.contains("outofstock"), "out_of_stock").otherwise("limited")
    )


def clean_brand(c: ColumnOrName) -> Column:
    text = F.replace(F.replace(col(c), F.lit("Brand: "), F.lit("")), F.lit("Visit the "), F.lit(""))
    return blank_to_null(strip(F.substring_index(text, " Store", 1)))


def product_id(url: ColumnOrName, platform: ColumnOrName) -> Column:
    return (
        F.when(col(platform) == "amazon", blank_to_null(F.regexp_extract(col(url), r"/dp/([A-Z0-9]{10})", 1)))
        .when(col(platform) == "flipkart", blank_to_null(F.regexp_extract(col(url), r"/p/([A-Z0-9]+)", 1)))
    )


# ---- OCR text -------------------------------------------------------------------------------------


def clean_ocr_text(c: ColumnOrName) -> Column:
    """One line of text: odd blanks normalised, lines made of symbols only dropped."""
    plain = F.translate(col(c), "\u00a0\u00ad", " ")
    squeezed = F.regexp_replace(plain, r"[ \t]+", " ")
    lines = F.transform(F.split(squeezed, "\n"), strip)
    kept = F.filter(lines, lambda line: (line != "") & ~line.rlike(fv.OCR_NOISE_LINE))
    return or_blank(strip(F.array_join(kept, " ")))


def page_number(region_id: ColumnOrName) -> Column:
    """'page0-region-3' is on page 1; ids without a page number belong to page 1."""
    return F.coalesce(F.regexp_extract(col(region_id), r"page(\d+)", 1).try_cast("int") + 1, F.lit(1))
