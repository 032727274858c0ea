"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets its source's copy probability: target words over words. The whole part is taken for sure. The
fractions are paired: two documents move the same number of words between them, in a random direction chosen so
that neither's expectation changes, until one becomes whole; what is left pairs with the next document. A leaf of
some thousand documents leaves one fraction, which moves up a reduction tree, so the words taken from a source miss
its target by less than one document of it. Leaves are dealt by hash within a source: a source of a third of all
rows is many leaves.

Random numbers come from hashes of documents and the seed, so reruns agree on any cluster. Documents that agree in
doc_id, source and size are rounded as one unit and get the same copies.

Defined results: null and empty texts have size zero and take no words; a null source is a source of its own, after
all others; a source without words has target zero and takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl.llm.common import join_on, pack, whole, words
from papertrawl.operators.ranking import number_rows
from papertrawl.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: Documents of a leaf on average, and residuals that meet in an inner node.
LEAF, FAN_IN = 1024, 256


def word_count(text: Column) -> Column:
    return F.size(words(whole(text))).cast("bigint")


def source_targets(units: DataFrame, weights: Sequence[float], max_repeats: float, share: float = 1.0) -> DataFrame:
    """source, source_no, source_size, n_units, target: a row per source. The driver sees totals only.

    Targets share the words by weight; a source above max_repeats times its words stops there and the excess is
    shared by weight among the others, until none is above.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"),
                                        F.count("*").alias("n_units"))
    ranked = number_rows(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))))
    table = cut_lineage(ranked.select("source", F.col("place").alias("source_no"), "source_size", "n_units",
                                      weight.alias("weight")), "sources")
    cap = F.col("source_size") * float(max_repeats)
    level, total = None, None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * level > cap
        words_, given, free = table.agg(
            F.sum("source_size"), F.sum(F.when(stopped, cap).otherwise(0.0)),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        total = (words_ or 0) * share
        now = (total - given) / free if free else math.inf
        if not words_ or now == level or not free:
            break
        level = now if level is None else max(level, now)
    target = F.least(F.col("weight") * F.lit(level or 0.0), cap)
    return table.select("source", "source_no", "source_size", "n_units", target.alias("target"))


def _pivot(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Round the fractions of one node; at most one row keeps a fraction."""
    part = part.sort_values(["order_no", "doc_id", "size", "p"], ignore_index=True)
    p, mass = part["p"].to_numpy(float).copy(), (part["size"] * part["n_rows"]).to_numpy(float)
    draw = part["draw"].to_numpy(float)
    held = -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if held < 0:
            held = i
            continue
        a, b = mass[held], mass[i]
        up = min(a * (1 - p[held]), b * p[i])  # words that may move from i to the held one
        down = min(a * p[held], b * (1 - p[i]))
        move = up if draw[i] * (up + down) < down else -down
        p[held] += move / a
        p[i] -= move / b
        for k in (held, i):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    part["p"] = p
    return part


def decide(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS,
           seed: int = 7, leaf: int = LEAF, source: str = "source") -> DataFrame:
    """doc_id, source, size, n_rows, source_size, target, copies: a row per document, copies how often to take it."""
    units = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), docs[source].alias("source"),
                        size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows"))
    units = cut_lineage(units, "units")
    table = cut_lineage(source_targets(units, weights, max_repeats), "targets")
    most = table.agg(F.max("n_units")).first()[0] or 0
    table = table.withColumn("leaves", F.greatest(F.lit(1), F.ceil(F.col("n_units") / leaf)))
    joined = join_on(units, table, ["source"]).withColumn("order_no", F.xxhash64("doc_id", F.lit(seed)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64("order_no", "size", F.lit(seed + 1)), 11) / float(1 << 53)
    level = joined.withColumn("rate", rate).select(
        "doc_id", "source", "size", "n_rows", "source_no", "source_size", "target", "order_no", draw.alias("draw"),
        F.floor("rate").cast("bigint").alias("sure"), fraction.alias("p"),
        F.pmod(F.xxhash64("order_no"), F.col("leaves")).cast("bigint").alias("node"))
    done, height = [], 1 + max(0, math.ceil(math.log(max(1, -(-most // leaf)), FAN_IN)))
    for step in range(height):
        rounded = cut_lineage(level.groupBy("source_no", "node").applyInPandas(_pivot, level.schema), "rounded")
        last = step == height - 1
        # the one fraction left of a source is rounded by its draw
        done.append(rounded.filter((F.col("p") == 0) | (F.col("p") == 1)) if not last else rounded.withColumn(
            "p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0)))
        level = rounded.filter("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target",
                      (F.col("sure") + F.col("p").cast("bigint")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS, seed: int = 7,
        source: str = "source") -> DataFrame:
    """The documents of the mix: a row of docs for each copy taken, documents that are not taken left out."""
    plan = cut_lineage(decide(docs, word_count(docs["text"]), weights, max_repeats, seed, source=source).filter(
        "copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"),
                             "copies"), "mix-plan")
    own = pack(docs, id=docs["doc_id"].cast("bigint"), of=docs[source], n=word_count(docs["text"]))
    taken = join_on(own, plan, ["id", "of", "n"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
