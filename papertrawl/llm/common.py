"""Words, lines and row keys shared by the operators of this folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl.operators.once import compute_once

__all__ = ["bind", "compute_once", "join_on", "lines", "pack", "text_key", "whole", "words"]

#: White space between words, the space aside: tab, line feed, vertical tab, form feed, carriage return.
BREAKS = "\t\n\x0b\x0c\r"
#: Letters and digits that normalised lines fold: A-Z to a-z, digits to zero.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789"
FOLD_TO = "abcdefghijklmnopqrstuvwxyz000000000"


def whole(text: Column) -> Column:
    """The text, blank for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of [^\\x20\\x09-\\x0D], in order."""
    return F.array_remove(F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " ", -1), "")


def lines(text: Column) -> Column:
    """The \\n-split lines as they are."""
    return F.split(text, "\n", -1)


def normal_line(line: Column) -> Column:
    """A-Z in lower case, digits as zero, one space between words; blank for a line without words."""
    return F.array_join(words(F.translate(line, FOLD_FROM, FOLD_TO)), " ")


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once even where use() reads it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def text_key() -> Column:
    """Tells rows of the same doc_id apart; equal rows share it and are judged alike."""
    return F.xxhash64(F.col("text"))


def pack(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of docs as the struct `row`, next to the named ones: no name in docs can clash with ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       *[c.alias(name) for name, c in columns.items()])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where all keys agree and null equals null; the keys appear once."""
    theirs = {k: f"{k} of the right" for k in keys}
    right = right.select(*[F.col(c).alias(theirs.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"`{t}`")) for k, t in theirs.items()])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*theirs.values())
