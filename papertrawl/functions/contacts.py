"""Phones, e-mails, names and scores of businesses, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions.text import ColumnOrName, col, groups, is_filled, or_blank, strip

NO_STRINGS = "array<string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _is_mobile(digits: Column) -> Column:
    return (F.length(digits) == 10) & digits.rlike("^[6-9]")


def _national(digits: Column) -> Column:
    """Drop the country or trunk prefix of a full-length number."""
    n = F.length(digits)
    return (
        F.when((n == 12) & digits.startswith("91"), F.substr(digits, F.lit(3)))
        .when((n == 11) & digits.startswith("0"), F.substr(digits, F.lit(2)))
        .when((n == 13) & digits.startswith("091"), F.substr(digits, F.lit(4)))
        .otherwise(digits)
    )


def phones(text: ColumnOrName) -> Column:
    """Distinct phone numbers, mobiles before landlines, each group in order of first appearance.

    Prefixed numbers (any spacing) are read first, then every other phone-like run.
    """
    prefixed = F.filter(
        F.transform(groups(text, fv.PHONE_PREFIXED), lambda m: F.left(_digits(m), F.lit(10))), _is_mobile
    )
    others = F.filter(
        F.transform(groups(text, fv.PHONE_ANY, 0), lambda m: _national(_digits(m))),
        lambda d: F.length(d).between(8, 10),
    )
    found = F.array_distinct(F.concat(prefixed, others))
    mobiles = F.filter(found, _is_mobile)
    return F.concat(mobiles, F.array_except(found, mobiles))


def emails(text: ColumnOrName) -> Column:
    """Distinct addresses in order, lower case, without asset names and placeholder hosts."""
    lowered = F.transform(groups(text, fv.EMAIL, 0), lambda e: F.rtrim(F.lower(e), F.lit(".")))
    return F.array_distinct(
        F.filter(lowered, lambda e: ~e.rlike(fv.ASSET_SUFFIX) & ~e.rlike(fv.EMAIL_BLACKLIST))
    )


def jsonld_blocks(html: ColumnOrName) -> Column:
    """Contents of all ld+json scripts of a page."""
    return groups(html, fv.JSONLD_BLOCK)


def jsonld_objects(blocks: Column) -> Column:
    """All top-level objects of some ld+json blocks, as variants."""
    as_lists = F.transform(
        F.transform(blocks, F.try_parse_json),
        lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
    )
    return F.filter(
        F.flatten(F.filter(as_lists, lambda a: a.isNotNull())),
        lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"),
    )


def _text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_text(v: Column, path: str) -> Column:
    return or_blank(F.schema_of_variant(F.try_variant_get(v, path, "variant"))) == "STRING"


def jsonld_phones(blocks: Column) -> Column:
    def of(v: Column, key: str) -> Column:
        direct = F.when(_is_text(v, f"$.{key}"), _text_at(v, f"$.{key}"))
        return or_blank(F.coalesce(direct, _text_at(v, f"$.{key}.telephone")))

    lists = F.transform(
        jsonld_objects(blocks), lambda v: F.concat(phones(of(v, "telephone")), phones(of(v, "phone")))
    )
    return F.coalesce(F.flatten(lists), F.array().cast(NO_STRINGS))


def jsonld_emails(blocks: Column) -> Column:
    lists = F.transform(
        jsonld_objects(blocks),
        lambda v: emails(or_blank(F.when(_is_text(v, "$.email"), _text_at(v, "$.email")))),
    )
    return F.coalesce(F.flatten(lists), F.array().cast(NO_STRINGS))


def prefer(first: Column, second: Column) -> Column:
    """The first list unless it is empty."""
    return F.when(F.size(first) > 0, first).otherwise(second)


def clean_name(c: ColumnOrName) -> Column:
    """Name without the part after a dash or bar and without a trailing place, at most 120 characters."""
    cut = F.regexp_replace(col(c), fv.NAME_TAIL_AFTER_DASH, "")
    cut = F.regexp_replace(cut, fv.NAME_TAIL_PLACE, "")
    return F.left(strip(F.regexp_replace(cut, r"(?U)\s+", " ")), F.lit(120))


def name_key(name: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(col(name)), fv.NON_WORD + "+", "")


def dedup_key(name: ColumnOrName, city: ColumnOrName) -> Column:
    return F.md5(F.concat(F.left(name_key(name), F.lit(40)), F.lit(":"), F.lower(or_blank(city))))


def has_phone() -> Column:
    return is_filled("phone") | is_filled("mobile")


def has_contact() -> Column:
    return has_phone() | is_filled("email")


def quality_score() -> Column:
    """0 to 8: three for a phone, three for an e-mail, one each for web site and address."""
    return (
        F.when(has_phone(), 3).otherwise(0)
        + F.when(is_filled("email"), 3).otherwise(0)
        + F.when(is_filled("website"), 1).otherwise(0)
        + F.when(is_filled("address"), 1).otherwise(0)
    )


def confidence_score(score: ColumnOrName) -> Column:
    return F.least(F.round(F.coalesce(col(score), F.lit(0)) / F.lit(8.0), 3), F.lit(1.0))


def excluded_host(host: ColumnOrName) -> Column:
    """Host belongs to a search engine or social network."""
    return F.exists(F.lit(fv.SKIP_HOSTS), lambda d: F.contains(col(host), d))


def looks_like_ip(phone: ColumnOrName, text: ColumnOrName) -> Column:
    """The digits also occur in the text as parts of a dotted address."""
    quads = F.transform(
        groups(text, r"\d{1,3}(?:\.\d{1,3}){3}", 0), lambda q: F.replace(q, F.lit("."), F.lit(""))
    )
    return F.exists(quads, lambda q: F.contains(q, col(phone)))
