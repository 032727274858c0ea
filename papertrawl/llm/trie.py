"""Prefix trie of conversations by collapsing whole sequences.

Conversations are first rebuilt: the opening turns come from another conversation. Identical rebuilt conversations
then collapse into one weighted sequence with the list of the conversations that end there. A sequence that is a
proper prefix of another one is not a leaf: an anti-join with all proper prefixes leaves the leaves. All numbers of a
node are sums over the weighted sequences that pass through it, so a shared opening costs a partial sum per task and
no rows are ever sent along a path of ancestors.

A prefix is known by its depth and 128 bits: the exclusive or of two 64-bit hashes of each turn with its place. Each
node belongs to the sequence with the smallest conversation among those through it; a sequence owns the end of
its path from one depth on. So the distinct turns below a node are summed without looking at pairs of nodes: every
sequence adds what it owns.

Defined results: rows without conv_id belong to no conversation and are left out; null role or text is empty; turns
are ordered by (turn, role, text), null turns first, so ties and repeated rows have one order and all stay; a
conversation without turns of its own beyond the opening is a member of the node where it ends, the root if it has none;
an empty table has no nodes; other columns are not read. Conversations may have any number of turns and a sequence any
number of conversations: rows of one key are cut into ranges, and end lists are hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.llm.common import whole
from papertrawl.llm.scan import running
from papertrawl.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

#: The opening of conversation c comes from c - c % FAMILY and has crc32(c) % MAX_OPENING turns.
FAMILY, MAX_OPENING = 5, 9
#: Ids of an end list that travel as one row.
LIST_BLOCK = 50_000
NODE = ["depth", "x1", "x2"]


def _long(value) -> F.Column:
    return F.lit(value).cast("bigint")


def rebuild(turns: DataFrame, family: int = FAMILY, max_opening: int = MAX_OPENING) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv_id, length) and their turns (conv_id, depth, length, h1, h2, bytes), without texts.

    h1 and h2 are hashes of role and text.
    """
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", whole(F.col("role")).alias("role"),
        whole(F.col("text")).alias("text"))
    rows = rows.select("*", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"),
                       F.octet_length("text").cast("bigint").alias("bytes"))
    own = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["h1", "h2", "bytes"])
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("origin"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % max_opening).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("origin"), F.col("n").alias("there")), "origin", "left")
    opening = F.least("h", F.coalesce("there", _long(0)))
    convs = cut_lineage(convs.select("conv_id", "origin", "h", opening.alias("opening"),
                                     (opening + F.greatest(F.col("n") - F.col("h"), _long(0))).alias("length")), "rebuilt")
    taken = ["length", "h1", "h2", "bytes"]
    tail = own.join(convs, "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("opening")).alias("depth"), *taken)
    head = (own.filter(F.col("place") < max_opening).withColumnRenamed("conv_id", "origin").join(convs, "origin")
            .filter("place <= opening").select("conv_id", F.col("place").alias("depth"), *taken))
    return convs.select("conv_id", "length"), tail.union(head)


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x1, x2, conv_id) as pieces of comma-joined ids, each of at most a batch and LIST_BLOCK ids."""
    no = 0
    for batch in rows:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE], axis=1)
        ids = batch.column("conv_id").to_pylist()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(key) else []
        edges = sorted({0, len(ids), *map(int, cuts), *range(0, len(ids), LIST_BLOCK)})
        lists = [",".join(map(str, ids[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(key[edges[:-1], i], pa.int64()) for i in range(3)],
             pa.array(range(no, no + len(lists)), pa.int64()), pa.array(lists, pa.string())], [*NODE, "no", "ids"])
        no += len(lists)


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined pieces, which come in order."""
    def out(found: list) -> pa.RecordBatch:
        *key, sha = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in key], pa.array(sha)], [*NODE, "ends_sha256"])

    last = digest = None
    for batch in rows:
        found = []
        for d, x1, x2, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if (d, x1, x2) == last:
                digest.update(b",")
            else:
                if last:
                    found.append((*last, digest.hexdigest()))
                last, digest = (d, x1, x2), hashlib.sha256()
            digest.update(ids.encode())
        if found:
            yield out(found)
    if last:
        yield out([(*last, digest.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """Node and SHA-256 of the ascending, comma-joined ids of the conversations that end there.

    ends: depth, x1, x2, conv_id. A hash reads its input in order, so a list of any length ends in one task, but as
    blocks of ids that other tasks have sorted and joined; nothing holds a whole list.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(c) for c in NODE]
    blocks = (ends.select(*key, "conv_id").repartitionByRange(ranges, *key, "conv_id")
              .sortWithinPartitions(*key, "conv_id").mapInArrow(
                  _blocks, "depth bigint, x1 bigint, x2 bigint, no bigint, ids string")
              .withColumn("range", F.spark_partition_id()))
    return blocks.repartition(ranges, *key).sortWithinPartitions(*key, "range", "no").select(*key, "ids").mapInArrow(
        _digests, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, family: int = FAMILY, max_opening: int = MAX_OPENING) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, rebuilt = rebuild(turns, family, max_opening)
    placed = rebuilt.select("conv_id", "depth", "length", "bytes", F.xxhash64("h1", "h2", "depth").alias("x1"),
                            F.xxhash64("depth", "h2", "h1").alias("x2"))
    paths = running(placed, "conv_id", [F.col("depth")], ["depth", "length", "bytes"], sums=["bytes"], xors=["x1", "x2"]).select(
        "conv_id", "depth", "length", "bytes", F.col("run_bytes").alias("so_far"), F.col("run_x1").alias("x1"),
        F.col("run_x2").alias("x2"))
    zero = _long(0)
    rootless = convs.filter("length = 0").select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"),
                                                 zero.alias("total"))
    ends = cut_lineage(paths.filter("depth = length").select("conv_id", *NODE, F.col("so_far").alias("total")).union(rootless), "ends")

    # whole sequences with their weight; the smallest conversation stands for each
    weighted = ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.min("total").alias("total"))
    steps = paths.join(weighted.select("conv_id", "weight", "total"), "conv_id").drop("length")
    roots = weighted.select("conv_id", zero.alias("depth"), zero.alias("bytes"), zero.alias("so_far"), zero.alias("x1"),
                            zero.alias("x2"), "weight", "total")
    length = weighted.select("conv_id", F.col("depth").alias("length"))
    steps = cut_lineage(steps.unionByName(roots).join(length, "conv_id"), "steps")

    proper = steps.filter("depth < length").select(*NODE).distinct()
    leaves = weighted.join(proper, NODE, "left_anti").select("conv_id", _long(1).alias("leaf"))

    # the first depth a sequence owns, and whose node it leaves there
    owners = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"))
    owners = cut_lineage(owners, "owners")
    starts = owners.groupBy("conv_id").agg(F.min("depth").alias("start"))
    at = steps.select("conv_id", "so_far", *NODE)
    left_at = (at.join(starts, "conv_id").filter(F.col("depth") == F.col("start") - 1)
               .join(owners.select(*NODE, F.col("conv_id").alias("above")), NODE).select("conv_id", "above", "so_far"))
    own = (weighted.select("conv_id", "total", F.col("depth").alias("length")).join(starts, "conv_id", "left")
           .join(left_at.withColumnRenamed("so_far", "shared"), "conv_id", "left").join(leaves, "conv_id", "left"))
    # a sequence that lies wholly on the path of a smaller one owns nothing: it starts behind its end
    own = own.select("conv_id", "above", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("start", F.col("length") + 1).alias("start"),
                     F.when(F.col("start").isNull(), F.col("total")).otherwise(F.coalesce("shared", zero)).alias("shared"))

    # every number of a node is a sum over its sequences
    s = steps.join(own, "conv_id")
    below = F.col("total") - F.col("so_far") + F.col("bytes")
    once = F.when(F.col("depth") >= F.col("start"), below).otherwise(F.col("total") - F.col("shared"))
    nodes = s.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("depth") == F.col("start"), F.col("above"))).alias("above"),
        F.sum("weight").alias("n_convs"),
        F.sum(((F.col("length") > F.col("depth")) & (F.col("start") <= F.col("depth") + 1)).cast("bigint")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * below - once).alias("saved_tokens"))
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(end_lists(ends), NODE, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
