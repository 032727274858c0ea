"""Keep-first, first-n, numbering and paging.

A key may hold a third of all rows, so nothing here sends all rows of a key to one task: row_number()
filtered by a small constant is cut per map task before the shuffle (WindowGroupLimit), and numbering
works on ranges of the sort order with per-range offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrawl.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key; each map task forwards at most n rows per key."""
    if n > 1000:
        raise ValueError("more than 1000 rows per key are not cut before the shuffle; sort and write instead")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def ranked_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """As first_per_key, keeping the place as a column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str = "row_no", ranges: int | None = None
) -> DataFrame:
    """Number the rows of every key from 1 in the given order, however many rows a key has.

    The rows are range-partitioned on (keys, order), so a big key spreads over many tasks. Each range is
    numbered on its own and shifted by the number of rows of the same key in earlier ranges; that offset
    table has at most one row per (range, key) pair present.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = cut_lineage(
        df.repartitionByRange(ranges, *keys, *order)
        .withColumn("_range", F.spark_partition_id()),
        "numbered",
    )
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    running = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sorted_rows.groupBy("_range", *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .drop("_rows")
    )
    return (
        sorted_rows.withColumn("_local", local)
        .join(offsets, ["_range", *keys])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_range", "_local", "_before")
    )


def page(df: DataFrame, order: list[Column], page_no: int, per_page: int) -> DataFrame:
    """One page of a sorted result (a top-n plan, never a full sort)."""
    if page_no < 1 or not 1 <= per_page <= 500:
        raise ValueError("page numbers start at 1, pages hold 1 to 500 rows")
    return df.orderBy(*order).offset((page_no - 1) * per_page).limit(per_page)


def page_envelope(df: DataFrame, page_no: int, per_page: int) -> DataFrame:
    """Total rows and number of pages."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.lit(page_no).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(total / per_page).cast("bigint").alias("total_pages"),
    )
