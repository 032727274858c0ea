"""Running totals over sorted rows of a key, however many rows a key has.

Rows are cut into ranges of the sort order, so a large key spreads over many tasks. Each range is summed up on its
own; what a key had in earlier ranges is added afterwards. Only the first key of a range can have come before, so
that table has at most one row per range and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrawl.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)


def _local(key: str, sums: list[str], xors: list[str]):
    """place and running totals of each key within the task; `opens` marks rows of the task's first key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        held = dict.fromkeys([*sums, *xors], 0)
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            n = len(keys)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            begin = np.repeat(starts, np.diff(np.append(starts, n)))  # where each row's key starts in the batch
            carried = begin == 0 if keys[0] == last else np.zeros(n, bool)
            first = keys[0] if first is None else first
            out = {name: batch.column(name) for name in batch.schema.names}
            here = np.arange(n) - begin + 1 + np.where(carried, place, 0)
            for name in [*sums, *xors]:
                values = batch.column(name).to_numpy(zero_copy_only=False)
                if name in sums:
                    total = np.concatenate(([0], np.cumsum(values)))
                    value = total[1:] - total[begin] + np.where(carried, held[name], 0)
                else:
                    total = np.concatenate(([0], np.bitwise_xor.accumulate(values)))
                    value = total[1:] ^ total[begin] ^ np.where(carried, held[name], 0)
                out[f"run_{name}"] = pa.array(value, pa.int64())
                held[name] = int(value[-1])
            out["place"], out["opens"] = pa.array(here, pa.int64()), pa.array(keys == first)
            last, place = keys[-1], int(here[-1])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def running(df: DataFrame, key: str, order: list[Column], keep: list[str], sums: list[str] = (),
            xors: list[str] = ()) -> DataFrame:
    """key, the columns keep, place (from 1), and run_x for each x of sums and xors: totals up to this row.

    key and all columns kept, summed or xored are bigint without nulls; order may use any column of df.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = list(dict.fromkeys([key, *keep, *sums, *xors]))
    totals = [f"run_{x}" for x in (*sums, *xors)]
    schema = ", ".join([*[f"`{c}` bigint" for c in (*taken, *totals)], "place bigint", "opens boolean"])
    rows = (df.repartitionByRange(ranges, F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*taken)
            .mapInArrow(_local(key, list(sums), list(xors)), schema).withColumn("range", F.spark_partition_id()))
    rows = cut_lineage(rows, "running")
    opening = rows.filter("opens").select(key, "range").distinct()  # a row per range
    parts = (rows.join(F.broadcast(opening.select(key).distinct()), key, "left_semi").groupBy(key, "range").agg(
        F.max("place").alias("place"), *[F.max_by(t, "place").alias(t) for t in totals]))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    merged = {"place": F.sum, **{f"run_{x}": F.sum for x in sums}, **{f"run_{x}": F.bit_xor for x in xors}}
    parts = parts.select(key, "range", *[f(c).over(before).alias(f"{c}_before") for c, f in merged.items()]).filter(
        "place_before is not null")
    rows = rows.join(F.broadcast(parts), [key, "range"], "left")
    none = F.lit(0).cast("bigint")
    shifted = {c: F.col(c) + F.coalesce(f"{c}_before", none) for c in merged}
    shifted |= {f"run_{x}": F.col(f"run_{x}").bitwiseXOR(F.coalesce(f"run_{x}_before", none)) for x in xors}
    return rows.select(*taken, *[v.alias(c) for c, v in shifted.items()])
