"""The input tables and the fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table with its declared schema; no footer inference, columns prune down to the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over as many tasks as papertrawl.deal.tasks says; where it is unset, as they were read.

    For one-file inputs on one machine, whose single split would keep one core busy. Clusters leave it unset:
    texts then stay where they are read, and spark.sql.files.maxPartitionBytes sets the size of a task.
    """
    tasks = df.sparkSession.conf.get("papertrawl.deal.tasks", None)
    return df.repartition(int(tasks)) if tasks else df


def deal(df: DataFrame) -> DataFrame:
    """Short rows that texts are rendered from, dealt out evenly over as many tasks as a shuffle has, or as set for spread().

    A file of short rows is one split, which would keep one core busy with all the texts that are made from it.
    """
    conf = df.sparkSession.conf
    return df.repartition(int(conf.get("papertrawl.deal.tasks", None) or conf.get("spark.sql.shuffle.partitions")))


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fv.CATEGORIES)]
    return spark.createDataFrame(
        rows, "category_no int, category string, label string, keywords array<string>, listing_term string, "
              "services_slug string"
    )


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(fv.CITIES)], "city_no int, city string, region string"
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SOURCES, "source string, label string, coverage string, best_for string")


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SEGMENT_LABELS, "segment string, label string")


def contact_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fv.CONTACT_PATHS)), "path_rank int, path string")


def label_of(key, labels: list[tuple[str, str]]):
    """Label of a key from a short fixed list, else the key in title case; a plain expression, no join."""
    known = F.create_map(*[F.lit(x) for pair in labels for x in pair])
    return F.coalesce(known[key], F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))
