"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents of equal text form a group and go to one shard. Small groups are bundled by hash into a fixed number of
items; a group that is large in any of the three measures is an item of its own. The items, largest first, go where
the dot product of their vector with the residual capacity is highest. The number of items has a bound that does not
depend on the data (BUNDLES plus three times LARGE), so they are packed on the driver; the rows never leave their
tasks. A group above half a shard is cut into pieces by doc_id, since no packing could balance it whole.

Slots number the rows of a shard without gaps: bundles are cut into cells of some thousand rows by doc_id, so that a
group is many cells, cells are numbered on their own, and running sums give each cell its first slot.

Defined results: a null text has no bytes and counts as size 1 without a checksum; null texts form one group; rows
that agree in text and doc_id are interchangeable and get neighbouring slots; an empty table gives an empty result;
columns of the input named like ours are replaced by ours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrawl.llm.common import pack, whole, words
from papertrawl.session import cut_lineage

#: Hash bundles of small groups; a group above 1/LARGE of the bytes, tokens or rows is an item of its own.
BUNDLES, LARGE = 4096, 512
#: Rows of a cell on average.
CELL = 512
MEASURES = ("bytes", "tokens", "rows")


def pack_items(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. vectors: a row per item, a column per measure, as shares of the whole."""
    residual, where = np.full((shards, vectors.shape[1]), 1.0 / shards), np.zeros(len(vectors), int)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        where[i] = int(np.argmax(residual @ vectors[i]))
        residual[where[i]] -= vectors[i]
    return where


def assign(docs: DataFrame, shards: int = 8, payload: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; with payload also the document as `row`."""
    spark = docs.sparkSession
    text = docs["text"]
    measured = {"doc_id": docs["doc_id"], "grp": F.xxhash64(text), "crc": F.crc32(text),
                "bytes": F.octet_length(whole(text)).cast("bigint") + 1,
                "tokens": F.size(words(whole(text))).cast("bigint")}
    narrow = cut_lineage(docs.select(*[c.alias(n) for n, c in measured.items()]), "measured")
    total = narrow.agg(F.count("*"), F.sum("bytes"), F.sum("tokens")).first()
    n, totals = total[0], [float(total[1] or 1), float(total[2] or 0) or 1.0, float(total[0] or 1)]

    sums = (F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    big = [r for r in narrow.groupBy("grp").agg(*sums).filter(
        " or ".join(f"{m} > {t / LARGE!r}" for m, t in zip(MEASURES, totals, strict=True))).orderBy("grp").collect()]
    share = [max(r[m] / t for m, t in zip(MEASURES, totals, strict=True)) for r in big]
    pieces = [max(1, int(np.ceil(2 * shards * s))) if s > 0.5 / shards else 1 for s in share]
    large = F.broadcast(spark.createDataFrame(  # at most three times LARGE rows
        [(r["grp"], k, p, max(1, -(-r["rows"] // p // CELL))) for k, (r, p) in enumerate(zip(big, pieces, strict=True))],
        "grp long, big_no long, pieces long, big_cells long"))
    cells = max(1, -(-n // (BUNDLES * CELL)))
    salt = lambda k: F.xxhash64("doc_id", "grp", F.lit(k))
    is_big = F.col("big_no").isNotNull()

    def placed(df: DataFrame) -> DataFrame:
        return df.join(large, "grp", "left").select(
            *df.columns,
            F.when(is_big, BUNDLES + F.col("big_no")).otherwise(F.pmod("grp", F.lit(BUNDLES))).alias("bundle"),
            F.when(is_big, F.pmod(salt(1), "pieces")).otherwise(0).alias("piece"),
            F.pmod(salt(2), F.coalesce("big_cells", F.lit(cells))).alias("cell"))

    units = cut_lineage(placed(narrow).groupBy("bundle", "piece", "cell").agg(*sums), "cells")
    items = units.groupBy("bundle", "piece").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy(
        "bundle", "piece").collect()  # bounded: bundles, and pieces of large groups
    vectors = np.array([[r[m] for m in MEASURES] for r in items], float).reshape(-1, 3) / totals
    where = pack_items(vectors, shards)
    shard_of = spark.createDataFrame(
        [(r["bundle"], r["piece"], int(s), int(r["rows"])) for r, s in zip(items, where, strict=True)],
        "bundle long, piece long, shard int, item_rows long")
    in_shard = Window.partitionBy("shard").orderBy("bundle", "piece").rowsBetween(Window.unboundedPreceding, -1)
    first = shard_of.select("bundle", "piece", "shard", F.coalesce(F.sum("item_rows").over(in_shard), F.lit(0)).alias(
        "item_first"))
    in_item = Window.partitionBy("bundle", "piece").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.join(F.broadcast(first), ["bundle", "piece"]).select(
        "bundle", "piece", "cell", "shard",
        (F.col("item_first") + F.coalesce(F.sum("rows").over(in_item), F.lit(0))).alias("start"))
    starts = cut_lineage(starts, "slots")
    rows = narrow if not payload else pack(docs, **measured)
    numbered = placed(rows).withColumn("at", F.row_number().over(
        Window.partitionBy("bundle", "piece", "cell").orderBy("grp", "doc_id", "bytes", "crc")))
    return numbered.join(starts, ["bundle", "piece", "cell"]).select(
        "doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("at") - 1).cast("bigint").alias("slot"), *(["row"] if payload else []))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with their columns `shard` and `slot`."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return assign(docs, shards, payload=True).select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot")
