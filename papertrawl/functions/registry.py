"""Names callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from papertrawl.fixed_values import CHARS_PER_TOKEN, WHITESPACE
from papertrawl.functions.dom import parse_dom

# plain SQL bodies: calls are inlined into the plan like any built-in expression
SQL_FUNCTIONS = {
    "parse_num": "(s STRING) RETURNS DOUBLE RETURN round(try_cast(regexp_replace(s, '[^0-9.]', '') AS DOUBLE), 2)",
    "dedup_key": (
        "(name STRING, city STRING) RETURNS STRING RETURN "
        r"md5(concat(left(regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', ''), 40), ':', lower(coalesce(city, ''))))"
    ),
    "quality_score": (
        "(phone STRING, mobile STRING, email STRING, website STRING, address STRING) RETURNS INT RETURN "
        "if(coalesce(phone, '') <> '' OR coalesce(mobile, '') <> '', 3, 0) + if(coalesce(email, '') <> '', 3, 0)"
        " + if(coalesce(website, '') <> '', 1, 0) + if(coalesce(address, '') <> '', 1, 0)"
    ),
    "cosine_similarity": (
        "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"
        " * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
    ),
}


_CUT = """aggregate(
    sequence(1, greatest(1, CAST(2 * ceil(length(text) / ((tokens - overlap) * {chars})) + 2 AS INT))),
    named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)),
    (acc, k) -> if(acc.at >= length(text), acc, transform(array(
        transform(array(locate(' ', reverse(substring(text, acc.at + 1, tokens * {chars})))), gap ->
          if(acc.at + tokens * {chars} < length(text) AND gap > 0 AND (tokens - overlap) * {chars} > gap,
             acc.at + tokens * {chars} - gap, acc.at + tokens * {chars}))[0]),
      stop -> named_struct('at', stop - overlap * {chars}, 'spans', array_append(acc.spans, named_struct('start', acc.at, 'stop', stop))))[0]),
    acc -> acc.spans)""".format(chars=CHARS_PER_TOKEN)
_BLANKS = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
_STRIPPED = f"btrim(substring(text, s.start + 1, s.stop - s.start), {_BLANKS})"
# a body that is one inline() stays a generator over the calling row: no join, no shuffle
TABLE_FUNCTIONS = {
    "chunk_text": (
        "(text STRING, tokens INT, overlap INT) RETURNS TABLE (chunk_index INT, text STRING) RETURN SELECT inline(transform(filter("
        f"transform({_CUT}, s -> {_STRIPPED}), piece -> length(piece) > 0), (piece, i) -> named_struct('chunk_index', i, 'text', piece)))"
    ),
    "html_elements": (
        "(html STRING) RETURNS TABLE (el_idx INT, parent INT, tag STRING, id STRING, class STRING, attrs MAP<STRING, STRING>, text STRING) "
        "RETURN SELECT inline(transform(array(parse_dom(html)), dom -> transform(filter(dom.elements, e -> e.idx > 0), e -> named_struct("
        "'el_idx', e.idx, 'parent', e.parent, 'tag', e.tag, 'id', try_element_at(e.attrs, 'id'), 'class', try_element_at(e.attrs, 'class'), "
        "'attrs', e.attrs, 'text', array_join(transform(slice(dom.strings, e.strings_from + 1, e.strings_to - e.strings_from), x -> x.text), ' '))))[0])"
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions available to spark.sql in this session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("parse_dom", parse_dom)
    for name, body in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
