"""Contacts of documents and pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl.functions import contacts as C


def contacts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, rank, value): every phone and e-mail of every text, in order. No shuffle."""
    found = F.array(
        F.struct(F.lit("phone").alias("kind"), C.phones(text).alias("values")),
        F.struct(F.lit("email").alias("kind"), C.emails(text).alias("values")),
    )
    kinds = df.select(key, F.inline(found))
    return kinds.select(key, "kind", F.posexplode("values").alias("pos", "value")).select(
        key, "kind", (F.col("pos") + 1).alias("rank"), "value"
    )


def contact_index(found: DataFrame, key: str) -> DataFrame:
    """Every contact with the number of texts it occurs in; counts combine before the shuffle."""
    return found.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("documents"), F.min(key).alias("first_document")
    )


def contact_coverage(df: DataFrame, group: str, text: str) -> DataFrame:
    read = df.select(
        group, (F.size(C.phones(text)) > 0).alias("p"), (F.size(C.emails(text)) > 0).alias("e")
    )
    return read.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("p").alias("with_phone"),
        F.count_if("e").alias("with_email"), F.count_if(F.col("p") & F.col("e")).alias("with_both"),
    )


def best_contact(html: str) -> tuple[Column, Column]:
    """First phone and e-mail of a page: structured data first, then the text."""
    blocks = C.jsonld_blocks(html)
    phone = F.coalesce(F.get(C.jsonld_phones(blocks), 0), F.get(C.phones(html), 0))
    email = F.coalesce(F.get(C.jsonld_emails(blocks), 0), F.get(C.emails(html), 0))
    return phone, email
