"""Ranked lexical search by K2-treaps over grids of terms and documents.

A task packs the documents it reads into blocks. Each block is a grid, its rows the terms it holds (frequent ones first),
its columns its documents by id, and each filled point the impact of a term on a document. The grid is a quadtree: one
level of cells below the other, a mask of four bits a cell for the children that hold points, and the largest impact
below each cell as its difference to the cell above, compressed. An item follows the paths of all its rows at once:
a range of documents is bounded by the weighted sum of the maxima of its rows' cells, the range with the highest
bound is opened first, in numpy strips of ranges, and ranges that cannot reach the k best so far are never opened.
A task carries the k best from block to block and hands on k rows an item.

The index is a table of blocks and answers any items: `build` reads the texts twice, once for the two counts that
impacts depend on; `search` reads the index twice, first the document frequencies of the items' terms. Items are sent in
slices of bounded size, one pass over the index each.

Defined results: null and texts without terms are not counted and never found; rows of the same doc_id are ranked each
for itself; a null doc_id comes last among equal scores (it is kept as the largest bigint); items of the same item_id are
one item with the terms of all; a null item_id is an item; items without terms have no rows; equal scores go by
ascending doc_id; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.operators.ranking import ranked_per_key
from papertrawl.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

K = 50
#: Bytes that stand between terms become spaces, A-Z small letters; all from 0x80 on belongs to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A block is closed at so many points or documents; one document may have more points.
BLOCK_POINTS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Ranges opened at once, and bytes of items' terms that are sent at once.
STRIP, SLICE_BYTES = 256, 8 << 20
#: Partial results of an item are first ranked in so many parts.
PARTS = 32
_NO_ID = np.iinfo(np.int64).max
_CHILDREN = np.array([bin(m).count("1") for m in range(16)], np.int64)
#: Children before the q-th in a cell with mask m.
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order: runs of digits, letters and everything outside of ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


# ---- the grid of a block ----------------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers under 2^32, each moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def grid_levels(rows: np.ndarray, docs: np.ndarray, impacts: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the root down to the points: masks of children (none for points) and largest impacts."""
    code = _spread(rows) << np.uint64(1) | _spread(docs)
    order = np.argsort(code, kind="stable")
    code, most = code[order], impacts[order].astype(np.int32)
    levels = [(np.zeros(0, np.uint8), most)]
    for _ in range(depth):
        above = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        mask = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first)
        most = np.maximum.reduceat(most, first)
        levels.append((mask, most))
        code = above[first]
    return levels[::-1]


def pack_levels(levels: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Counts of cells, masks, and maxima as differences to the cell above."""
    sizes = np.array([len(most) for _, most in levels], np.int64)
    below = [levels[0][1], *[np.repeat(most, _CHILDREN[mask]) - under for (mask, most), (_, under) in
                             zip(levels[:-1], levels[1:], strict=True)]]
    body = b"".join(mask.tobytes() for mask, _ in levels) + np.concatenate(below).astype("<i4").tobytes()
    return np.int64(len(levels)).tobytes() + sizes.tobytes() + zlib.compress(body, 1)


class Grid:
    """A block's quadtree, opened for search. Each level has one more cell, empty, for what isn't there."""

    def __init__(self, packed: bytes):
        n = int(np.frombuffer(packed, np.int64, 1)[0])
        sizes = np.frombuffer(packed, np.int64, n, 8)
        body = zlib.decompress(packed[8 + 8 * n:])
        self.depth, self.levels, at = n - 1, [], 0
        places = 4 * np.concatenate(([0], np.cumsum(sizes))) + int(sizes[:-1].sum())
        above = np.zeros(0, np.int64)
        for level, size in enumerate(sizes):
            most = np.frombuffer(body, "<i4", size, int(places[level])).astype(np.int64)
            most = above - most if level else most
            if level < self.depth:
                mask = np.frombuffer(body, np.uint8, size, at)
                at += size
                children = _CHILDREN[mask]
                first = np.concatenate(([0], np.cumsum(children)))
                above = np.repeat(most, children)
                self.levels.append((np.append(most, 0), np.append(mask, 0), first))
            else:
                self.levels.append((np.append(most, 0), None, None))

    def open(self, level: int, cells: np.ndarray, bits: np.ndarray, side: int) -> np.ndarray:
        """Of ranges (first axis) and rows (second): the cells below in the rows' halves and one half of the documents."""
        _, mask, first = self.levels[level]
        quarter = 2 * bits + side
        held = mask[cells]
        there = (held >> quarter) & 1 == 1
        nowhere = len(self.levels[level + 1][0]) - 1
        return np.where(there, first[cells] + _BEFORE[held, quarter], nowhere)


class Best:
    """The k best documents of an item so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge, self.edge_id = 0, 0  # what a document must exceed

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.k:
            self.edge, self.edge_id = int(self.scores[-1]), int(self.ids[-1])

    def may_enter(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (bounds > self.edge) | ((bounds == self.edge) & (ids < self.edge_id)) & (bounds > 0)


def search_grid(grid: Grid, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Add a block's documents to the best of an item; the number of ranges that were bounded. ids: of the columns."""
    todo = [(-1, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), np.full(1, np.iinfo(np.int64).max))]
    count = looked = 0
    while todo:
        _, _, level, ranges, cells, bounds = heapq.heappop(todo)
        width = grid.depth - level
        keep = best.may_enter(bounds, ids[ranges << width])
        if not keep.any():
            continue
        ranges, cells, bounds = ranges[keep], cells[keep], bounds[keep]
        if len(ranges) > STRIP:  # the best ranges now, the others wait at their own bound
            order = np.argsort(-bounds, kind="stable")
            later, order = order[STRIP:], order[:STRIP]
            count += 1
            heapq.heappush(todo, (-int(bounds[later[0]]), count, level, ranges[later], cells[later], bounds[later]))
            ranges, cells = ranges[order], cells[order]
        bits = (rows >> (width - 1)) & 1
        down = np.concatenate([grid.open(level, cells, bits, side) for side in (0, 1)])
        ranges = np.concatenate([2 * ranges, 2 * ranges + 1])
        bounds = grid.levels[level + 1][0][down] @ weights
        looked += len(ranges)
        filled = bounds > 0
        ranges, down, bounds = ranges[filled], down[filled], bounds[filled]
        if not len(ranges):
            continue
        if width == 1:
            keep = best.may_enter(bounds, ids[ranges])
            best.add(bounds[keep], ids[ranges[keep]])
        else:
            count += 1
            heapq.heappush(todo, (-int(bounds.max()), count, level + 1, ranges, down, bounds))
    return looked


# ---- the index --------------------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column("text"):
            n = len(terms_of(text.as_py()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "docs bigint, terms bigint").agg(
        F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


_INDEX = "terms binary, frequencies binary, ids binary, grid binary"


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of terms on documents, from the count of the term and the measure of the document's length."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _blocks(total_docs: int, total_terms: int, points: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> None:
            nonlocal known, ids, lengths, rows, tfs, held
            known, ids, lengths, rows, tfs, held = defaultdict(), [], [], [], [], 0
            known.default_factory = known.__len__

        def out() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            column = np.empty(len(ids), np.int64)
            column[order] = np.arange(len(ids))
            per_doc = np.array([len(r) for r in rows])
            row, tf = np.concatenate(rows), np.concatenate(tfs).astype(np.int64)
            frequency = np.bincount(row, minlength=len(known))
            by_frequency = np.argsort(-frequency, kind="stable")
            place = np.empty(len(known), np.int64)
            place[by_frequency] = np.arange(len(known))
            depth = max(1, (max(len(known), len(ids)) - 1).bit_length())
            m = np.repeat([50 + 50 * n * total_docs // total_terms for n in lengths], per_doc)
            packed = pack_levels(grid_levels(place[row], np.repeat(column, per_doc), impact(tf, m), depth))
            names = list(known)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (
                    zlib.compress(b" ".join([names[i] for i in by_frequency]), 1), frequency[by_frequency].astype("<i4").tobytes(),
                    np.array(ids, np.int64)[order].tobytes(), packed)], ["terms", "frequencies", "ids", "grid"])

        known, ids, lengths, rows, tfs, held = None, [], [], [], [], 0
        fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                tf = Counter(found)
                ids.append(_NO_ID if doc_id.as_py() is None else doc_id.as_py())
                lengths.append(len(found))
                rows.append(np.fromiter(map(known.__getitem__, tf), np.int64, len(tf)))
                tfs.append(np.fromiter(tf.values(), np.int32, len(tf)))
                held += len(tf)
                if held >= points or len(ids) >= most_docs:
                    yield out()
                    fresh()
        if ids:
            yield out()

    return run


def build(docs: DataFrame, total: tuple[int, int], points: int = BLOCK_POINTS, most_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of whole texts: a row per block. total: counts(docs)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _blocks(*total, points, most_docs), _INDEX)


# ---- search -----------------------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, term = [], []
        for i, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
            own = set(terms_of(text.as_py()))
            item += [i.as_py()] * len(own)
            term += own
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary())], ["item_id", "term"])


def _frequencies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = sent.value, Counter()
        for batch in batches:
            for terms, frequencies in zip(batch.column("terms"), batch.column("frequencies"), strict=True):
                counted = np.frombuffer(frequencies.as_py(), "<i4")
                for row, term in enumerate(zlib.decompress(terms.as_py()).split(b" ")):
                    if term in wanted:
                        total[term] += int(counted[row])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(total.values(), pa.int64())],
                                         ["term", "df"])

    return run


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value  # terms of each item, weight of each term
        best = {item: Best(k) for item in items}
        for batch in batches:
            for terms, ids, packed in zip(*[batch.column(c) for c in ("terms", "ids", "grid")], strict=True):
                place = {t: i for i, t in enumerate(zlib.decompress(terms.as_py()).split(b" ")) if t in weight}
                grid, columns = Grid(packed.as_py()), np.frombuffer(ids.as_py(), np.int64)
                for item, own in items.items():
                    here = [t for t in own if t in place]
                    if here:
                        search_grid(grid, columns, np.array([place[t] for t in here]), np.array([weight[t] for t in here]),
                                    best[item])
        found = [(item, len(b.ids)) for item, b in best.items() if len(b.ids)]
        if found:
            doc = np.concatenate([best[item].ids for item, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([item for item, n in found for _ in range(n)], pa.int64()), pa.array(doc, pa.int64(), mask=doc == _NO_ID),
                 pa.array(np.concatenate([best[item].scores for item, _ in found]), pa.int64())], ["item_id", "doc_id", "score"])

    return run


_FOUND = "item_id bigint, doc_id bigint, score bigint"


def search(index: DataFrame, total_docs: int, items: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = index.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_terms, "item_id bigint, term binary").distinct()
    asked = cut_lineage(asked, "asked")
    size = asked.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    parts = []
    for i in range(slices):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).collect()  # of at most about slice_bytes
        terms: dict = defaultdict(list)
        for r in own:
            terms[r.item_id].append(bytes(r.term))
        wanted = spark.sparkContext.broadcast({t for ts in terms.values() for t in ts})
        df = index.select("terms", "frequencies").mapInArrow(_frequencies(wanted), "term binary, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).collect()
        weight = {bytes(r.term): math.floor(1000 * math.log((2 * total_docs + 2) / (2 * r.df + 1))) for r in df}
        sent = spark.sparkContext.broadcast((dict(terms), {t: w for t, w in weight.items() if w > 0}))
        parts.append(index.select("terms", "ids", "grid").mapInArrow(_search(sent, k), _FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.spark_partition_id() % PARTS)
    some = ranked_per_key(found, ["item_id", "part"], order, k, "rank").drop("part", "rank")
    return ranked_per_key(some, ["item_id"], order, k, "rank").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index all documents and rank them for every item."""
    total = counts(docs)
    index = cut_lineage(build(docs, total), "lexical-index")
    return search(index, total[0], items, k)
