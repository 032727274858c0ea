"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits come from 3-word shingles. Distinct fingerprints form a binary trie; the self-join walks
pairs of nodes together from the top, adds up the bits in which the two paths differ, and drops a pair as soon as
its budget is used up. Two fingerprints at distance 3 or less differ by at most one bit in one of their halves, so
two tries are walked, one starting at either half, with a budget of one bit for the first 32 levels and of three
for the rest: nothing is lost and few pairs survive the top. The first levels are dealt out by Spark: a task holds
one pair of subtries. Pairs that are still large, where many fingerprints share their first bits, go down further
levels the same way before a task takes them, so no task's share grows with a group of near copies. A task returns
only a spanning forest of its links, so dense groups never become pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id takes part and
gets its component's smallest doc_id; repeated rows give repeated rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrawl.llm.common import pack
from papertrawl.llm.components import components
from papertrawl.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

BITS, BUDGET, FIRST_HALF_BUDGET = 64, 3, 1
#: Fingerprints of a subtrie that a task joins, on average; the number of top levels dealt out follows from it.
SUBTRIE = 16_384
#: A pair of subtries with more than HOT times as many goes down STEP more levels; prefixes stay within a long.
HOT, STEP, DEEPEST = 8, 4, 60
#: Node pairs, and candidate pairs of fingerprints, looked at in one go: bounds a task's memory.
NODE_BLOCK, PAIR_BLOCK = 1 << 16, 1 << 20


# ---- fingerprints -----------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; a bit is 1 if set in over half the hashes."""
    ws = text.lower().split()
    if not ws:
        return 0
    joined, digest = memoryview(b" ".join(ws)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ws) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(ws) - size + 1], ends[size - 1:]
    ones, total = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, total, 65_536):
        part = zip(starts[at:at + 65_536].tolist(), ends[at:at + 65_536].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)],
                                         ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id bigint, text_hash bigint, fp bigint")


# ---- joining two subtries ---------------------------------------------------------------------------


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest label over links a-b, in place: hook larger roots under smaller ones and compress, until stable."""
    while True:
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def _runs(label: np.ndarray) -> np.ndarray:
    """For each place the first later place with another label."""
    n = len(label)
    change = np.flatnonzero(label[1:] != label[:-1]) + 1
    return np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]


def _expand(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the given pairs of ranges."""
    wide = hi2 - lo2
    count = (hi - lo) * wide
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wide = np.repeat(wide, count)
    return np.repeat(lo, count) + k // wide, np.repeat(lo2, count) + k % wide


def join_subtries(fps: np.ndarray, split: int | None, depth: int, errors: int) -> np.ndarray:
    """Labels of fps after linking all pairs within the budget: the index of the first member of each class.

    fps: sorted and distinct within each of its two parts, fps[:split] and fps[split:], whose paths already differ
    in `errors` of the first `depth` bits; split None: one subtrie with itself.
    """
    n = len(fps)
    label, runs = np.arange(n), np.arange(1, n + 1)
    if n < 2 or split in (0, n):
        return label
    first = np.array([[0, n, 0, n, 0]] if split is None else [[0, split, split, n, errors]])
    stack = [(depth, first)]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > NODE_BLOCK:
            stack += [(depth, nodes[NODE_BLOCK:])]
            nodes = nodes[:NODE_BLOCK]
        xl, xh, yl, yh, e = nodes.T
        # nothing to learn where both sides are one class already
        done = (runs[xl] >= xh) & (runs[yl] >= yh) & (label[xl] == label[yl])
        nodes = nodes[~done]
        xl, xh, yl, yh, e = nodes.T
        pairs = (xh - xl) * (yh - yl)
        small = (pairs <= 32) | (depth >= BITS)
        if small.any():
            few = nodes[small]
            bound = np.cumsum(pairs[small]) // PAIR_BLOCK
            for part in np.split(few, np.flatnonzero(np.diff(bound)) + 1):
                i, j = _expand(*part[:, :4].T)
                near = (np.bitwise_count(fps[i] ^ fps[j]) <= BUDGET) & (i != j)
                if near.any():
                    _merge(label, i[near], j[near])
            runs = _runs(label)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        xl, xh, yl, yh, e = nodes.T
        bit, high = np.uint64(1 << (BITS - 1 - depth)), np.uint64((1 << BITS) - (1 << (BITS - depth)))
        if split is None:
            xm = np.searchsorted(fps, (fps[xl] & high) | bit)
            ym = np.searchsorted(fps, (fps[yl] & high) | bit)
        else:
            xm = np.searchsorted(fps[:split], (fps[xl] & high) | bit)
            ym = np.searchsorted(fps[split:], (fps[yl] & high) | bit) + split
        # the prefix of a one-sided node may lie wholly before or after the bit
        xm, ym = np.clip(xm, xl, xh), np.clip(ym, yl, yh)
        same = xl == yl
        below = np.concatenate([
            np.stack([xl, xm, yl, ym, e], 1), np.stack([xm, xh, ym, yh, e], 1),
            np.stack([xl, xm, ym, yh, e + 1], 1), np.stack([xm, xh, yl, ym, e + 1], 1)[~same]])
        budget = FIRST_HALF_BUDGET if depth < BITS // 2 else BUDGET
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            stack.append((depth + 1, below))
    return label


def _links(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    trie, top_a, top_b, depth, errors = key
    fps = part["path"].to_numpy().astype(np.int64).view(np.uint64)
    if top_a == top_b:
        fps, split = np.sort(fps), None
    else:
        second = (part["side"] == 1).to_numpy()
        split = int((~second).sum())
        fps = np.concatenate([np.sort(fps[~second]), np.sort(fps[second])])
    label = join_subtries(fps, split, int(depth), int(errors))
    linked = np.flatnonzero(label != np.arange(len(label)))
    turned = int(trie) * (BITS // 2)
    back = (fps << np.uint64(turned)) | (fps >> np.uint64(BITS - turned)) if turned else fps
    return pd.DataFrame({"u": back[linked].view(np.int64), "v": back[label[linked]].view(np.int64)})


_PAIR = ["trie", "a", "b", "depth", "errors"]


def _meet(paths: DataFrame, own: Column, other: Column, flips: list[int], budget: int, depth: int) -> DataFrame:
    """Every path in the pairs of nodes that it is in: its own node with all within the budget of its other node."""
    met = paths.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("bigint") for x in flips]))).select(
        "trie", own.alias("own"), other.bitwiseXOR(F.col("flip")).alias("other"),
        (F.col("errors") + F.bit_count("flip")).cast("int").alias("errors"), "path")
    return met.filter(F.col("errors") <= budget).select(
        "trie", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.lit(depth).alias("depth"),
        "errors", (F.col("own") > F.col("other")).cast("int").alias("side"), "path")


def _down(hot: DataFrame, depth: int) -> DataFrame:
    """The pairs of nodes STEP levels below the given ones of one depth, where both nodes have fingerprints."""
    below = depth + STEP
    bits = F.shiftrightunsigned("path", BITS - below).bitwiseAND(F.lit((1 << STEP) - 1))
    node = lambda c: F.shiftleft(c, STEP).bitwiseOR(bits)
    first = F.col("side") == 0
    own, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    budget = FIRST_HALF_BUDGET if below <= BITS // 2 else BUDGET
    flips = [x for x in range(1 << STEP) if x.bit_count() <= budget]
    met = cut_lineage(_meet(hot, node(own), node(other), flips, budget, below), "subtries")
    two_sided = met.groupBy(*_PAIR).agg(F.min("side").alias("x"), F.max("side").alias("y")).filter("a = b or x < y")
    return met.join(two_sided.select(*_PAIR), _PAIR, "left_semi")


def trie_links(distinct: DataFrame, subtrie: int = SUBTRIE) -> DataFrame:
    """Links u-v between distinct fingerprints (column fp) that connect all within three bits."""
    rows = distinct.count()
    depth = min(24, max(0, math.ceil(math.log2(max(1, rows / subtrie)))))
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    paths = distinct.select(F.inline(F.array(
        F.struct(F.lit(0).alias("trie"), F.col("fp").alias("path")),
        F.struct(F.lit(1).alias("trie"), turned.alias("path"))))).withColumn("errors", F.lit(0))
    top = F.shiftrightunsigned("path", BITS - depth) if depth else F.lit(0).cast("bigint")
    # a subtrie meets itself and those whose top differs in one bit
    pairs = _meet(paths, top, top, [0, *[1 << k for k in range(depth)]], FIRST_HALF_BUDGET, depth)
    ready = []
    while depth + STEP <= DEEPEST:
        hot = cut_lineage(pairs.groupBy(*_PAIR).count().filter(F.col("count") > HOT * subtrie).select(*_PAIR), "hot")
        if hot.isEmpty():
            break
        ready.append(pairs.join(hot, _PAIR, "left_anti"))
        pairs, depth = _down(pairs.join(hot, _PAIR, "left_semi"), depth), depth + STEP
    return reduce(DataFrame.union, ready, pairs).groupBy(*_PAIR).applyInPandas(_links, "u bigint, v bigint")


# ---- classes ----------------------------------------------------------------------------------------


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp and component_id (smallest doc_id reachable over links) of every row."""
    rows = cut_lineage(fingerprints(docs), "fingerprints")
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    classes = components(trie_links(distinct.select("fp")))
    rooted = distinct.join(classes, distinct["fp"] == classes["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    return rows.join(named, rows["fp"] == named["of"]).drop("of")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class stays: that of the smallest doc_id; of equal ids that of the smallest text hash.

    A class whose doc_ids are all null keeps its row of the smallest text hash. Repeated rows count as one document.
    """
    found = cut_lineage(near_classes(docs), "near-classes")
    best = (found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own"))
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
            .select("best.doc_id", "best.text_hash"))
    keys = ["id", "no_id", "text_hash"]
    named = lambda df: df.select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash",
        *[c for c in df.columns if c == "row"])
    own = named(pack(docs, doc_id=docs["doc_id"].cast("bigint"), text_hash=F.xxhash64(docs["text"])))
    # the join and the numbering of repeated rows share one shuffle of the texts
    kept = own.join(named(best), keys, "left_semi").withColumn(
        "copy", F.row_number().over(Window.partitionBy(*keys).orderBy("text_hash")))
    return kept.filter("copy = 1").select("row.*")
