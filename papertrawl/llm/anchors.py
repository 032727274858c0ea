"""Substring dedup by difference-cover anchors.

A window of `length` words that starts in a smaller document too is a repeat, and its words go. Hashes are not taken
at every place: with a period v and a perfect difference set D modulo v, only windows of length - v + 1 words at
places i with i mod v in D are hashed. Two equal windows of `length` words, wherever they start, hold an aligned
pair of such anchors. Anchors found in more than one document are the candidates; every window around one is then
extended to its full length and judged by the smallest document it starts in.

Documents travel as compressed batches of some megabytes, written once, bucketed by batch. A task sends its batch's
distinct hashes to hash ranges and gets back one bit for each, so a passage of any number of copies is one entry per
batch, both in the shuffle and in the range's task; texts are not shuffled again. The two steps:
1. distinct anchors of each batch; the answer says which another batch has too;
2. distinct windows around shared anchors, with the smallest document of the batch; the answer says which start in
   a smaller document elsewhere.
Windows are compared by 80 hash bits.

Defined results: null and empty texts have no words and stay empty; documents without an id come after all others
and never against each other; rows of one doc_id are one document; windows do not cross documents; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.session import cut_lineage, scratch_path, ship_with_tasks

ship_with_tasks(__name__)

LENGTH = 13
#: Perfect difference sets: period to the places hashed. Every difference modulo the period occurs in the set.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text of a batch, of text per table bucket, and of text per hash range.
BATCH_BYTES, BUCKET_BYTES, RANGE_BYTES = 4 << 20, 16 << 20, 16 << 20
_NO_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def cover(length: int) -> tuple[int, tuple[int, ...], int]:
    """Period, places and anchor length for windows of so many words: the largest period up to half the window."""
    if length < 5:
        raise ValueError("windows of at least 5 words")
    period = max(v for v in COVERS if v <= (length + 1) // 2)
    return period, COVERS[period], length - period + 1


# ---- hashes -----------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a well-mixing 64-bit generator."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 19
_POWERS = np.multiply.accumulate(np.full(_CHUNK, _M1))  # M1 to the powers 1, 2, ...


def _powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= _CHUNK else np.multiply.accumulate(np.full(n, _M1))


def _inverse_powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, np.uint64(pow(int(_M1), -1, 1 << 64))))


_INVERSES = _inverse_powers(_CHUNK)


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer, in pieces of bounded size that end between words."""
    data, hashes, starts, at = np.frombuffer(buf, np.uint8), [], [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        part = data[at:end]
        blank = np.concatenate(([True], _BLANK[part], [True]))
        first = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        last = np.flatnonzero(~blank[1:-1] & blank[2:])
        if len(first):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _powers(len(part)), dtype=np.uint64)))
            inverse = _INVERSES if len(part) <= _CHUNK else _inverse_powers(len(part))
            hashes.append(_mix((sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
            starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def window_hashes(hashes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hash of each window of so many consecutive words."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += _mix(hashes[k:k + n] + np.uint64(salt)) * np.uint64(pow(int(_M3), k + 1, 1 << 64))
    return _mix(total)


class Batch:
    """Some documents: their ids and texts, words as hashes, and which window starts lie inside one document."""

    def __init__(self, blob: bytes):
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:8], "big")
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.sizes = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        self.buf = raw[8 + 16 * n:]
        self.edge = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.hashes, starts = word_hashes(self.buf)
        self.doc = np.searchsorted(self.edge, starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        #: documents with equal ids are one
        _, self.rank = np.unique(self.ids, return_inverse=True)

    @staticmethod
    def blob(ids: list[int], texts: list[bytes]) -> bytes:
        head = np.array([*ids, *map(len, texts)], np.int64).tobytes()
        return zstandard.compress(len(ids).to_bytes(8, "big") + head + b"".join(t + b"\n" for t in texts), 3)

    def text(self, k: int) -> bytes:
        return self.buf[self.edge[k]:self.edge[k] + self.sizes[k]]

    def inside(self, length: int) -> np.ndarray:
        """Of each window start: whether the window ends in the same document."""
        n = max(0, len(self.hashes) - length + 1)
        return self.doc[:n] == self.doc[length - 1:length - 1 + n]

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        period, places, size = cover(length)
        within = np.arange(len(self.hashes)) - self.first[self.doc]
        at = np.flatnonzero(self.inside(size) & np.isin(within[:max(0, len(within) - size + 1)] % period, places))
        return at, window_hashes(self.hashes, size, 1)[at]

    def candidates(self, length: int, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Places of the windows that hold a shared anchor."""
        size = cover(length)[2]
        n = max(0, len(self.hashes) - length + 1)
        mark = np.zeros(len(self.hashes) + 1, np.int64)
        hit = at[shared]
        np.add.at(mark, np.maximum(hit - (length - size), 0), 1)
        np.add.at(mark, hit + 1, -1)
        return np.flatnonzero((np.cumsum(mark)[:n] > 0) & self.inside(length))


def _distinct(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, smallest and largest rank of each, and the place of each input among them."""
    unique, inverse = np.unique(keys, return_inverse=True)
    low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), -1)
    np.minimum.at(low, inverse, ranks)
    np.maximum.at(high, inverse, ranks)
    return unique, low, high, inverse


# ---- steps over batches -----------------------------------------------------------------------------


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0

    def out() -> pa.RecordBatch:
        blob = Batch.blob(ids, texts)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([blob], pa.binary())], ["batch", "blob"])

    for row_batch in rows:
        keys = row_batch.column("doc_id")
        values = row_batch.column("text").cast(pa.large_binary())
        for i in range(row_batch.num_rows):
            text = values[i].as_py() or b""
            if texts and held + len(text) > BATCH_BYTES:
                yield out()
                ids, texts, held = [], [], 0
            key = keys[i].as_py()
            ids.append(_NO_ID if key is None else key)
            texts.append(text)
            held += len(text)
    if texts:
        yield out()


def _by_range(name: str, ranges: int, hashes: np.ndarray, *extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of a batch as one row per hash range; hashes ascending, so entries keep their order in a range."""
    where, order = _ranged(hashes, ranges)
    arrays = [a[order] for a in (hashes, *extra)]
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True]))) if len(where) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        payload = b"".join(x[a:b].tobytes() for x in arrays)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(where[a])], pa.int32()), pa.array([name]), pa.array([int(b - a)], pa.int64()),
             pa.array([payload], pa.binary())], ["range", "batch", "n", "payload"])


def _ranged(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of hashes in ascending order, and the places of the hashes in that order; one sort, however many ranges."""
    where = (hashes >> np.uint64(33)) % np.uint64(ranges)
    order = np.argsort(where, kind="stable")
    return where[order], order


_SENT = "range int, batch string, n long, payload binary"
_ANSWER = "range int, batch string, bits binary"


def _answers(hashes: np.ndarray, ranges: int, found: list | None) -> np.ndarray:
    """The bits that came back for a batch's entries, in their order; ranges without an answer said no."""
    bits = np.zeros(len(hashes), bool)
    where, order = _ranged(hashes, ranges)
    for one in found or []:
        low, high = np.searchsorted(where, np.array([one["range"], one["range"] + 1], np.uint64))
        at = order[low:high]
        bits[at] = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=len(at)).astype(bool)
    return bits


def _send_anchors(length: int, ranges: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row_batch in rows:
            for name, blob in zip(row_batch.column("batch"), row_batch.column("blob"), strict=True):
                _, hashes = Batch(blob.as_py()).anchors(length)
                yield from _by_range(name.as_py(), ranges, np.unique(hashes))
    return run


def _answer_anchors(part: pd.DataFrame) -> pd.DataFrame:
    """Of each entry: whether another batch sent it too."""
    part = part.sort_values("batch", ignore_index=True)
    hashes = np.concatenate([np.frombuffer(p, np.uint64) for p in part["payload"]])
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return _said(part, count[inverse] > 1)


def _said(part: pd.DataFrame, bits: np.ndarray) -> pd.DataFrame:
    pieces = np.split(bits, np.cumsum(part["n"].to_numpy())[:-1])
    keep = [k for k, p in enumerate(pieces) if p.any()]
    return pd.DataFrame({"range": part["range"].iloc[keep], "batch": part["batch"].iloc[keep],
                         "bits": [np.packbits(pieces[k]).tobytes() for k in keep]})


_WINDOW = np.dtype([("h", "<u8"), ("low", "<u2")])


def _windows(batch: Batch, length: int, ranges: int, found: list | None) -> tuple:
    """Candidate windows of a batch: places, distinct keys, smallest and place of each."""
    at, hashes = batch.anchors(length)
    unique, low, high, inverse = _distinct(hashes, batch.rank[batch.doc[at]])
    shared = (_answers(unique, ranges, found) | (low < high))[inverse] if len(at) else np.zeros(0, bool)
    places = batch.candidates(length, at, shared)
    keys = np.empty(len(places), _WINDOW)
    keys["h"] = window_hashes(batch.hashes, length, 2)[places]
    keys["low"] = (window_hashes(batch.hashes, length, 3)[places] & np.uint64(0xFFFF)).astype(np.uint16)
    order = np.lexsort((keys["low"], keys["h"]))
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    smallest = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(smallest, inverse, batch.rank[batch.doc[places]])
    return places, ordered[new], smallest, inverse


def _send_windows(length: int, ranges: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row_batch in rows:
            for row in row_batch.to_pylist():
                batch = Batch(row["blob"])
                _, keys, smallest, _ = _windows(batch, length, ranges, row["anchors"])
                ids = np.unique(batch.ids)
                yield from _by_range(row["batch"], ranges, keys["h"].astype(np.uint64), keys["low"], ids[smallest])
    return run


def _answer_windows(part: pd.DataFrame) -> pd.DataFrame:
    """Of each entry: whether its window starts in a smaller document of another batch."""
    part = part.sort_values("batch", ignore_index=True)
    h, low, ids = [], [], []
    for payload, n in zip(part["payload"], part["n"], strict=True):
        h.append(np.frombuffer(payload, np.uint64, n))
        low.append(np.frombuffer(payload, np.uint16, n, 8 * n))
        ids.append(np.frombuffer(payload, np.int64, n, 10 * n))
    h, low, ids = np.concatenate(h), np.concatenate(low), np.concatenate(ids)
    order = np.lexsort((ids, low, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])))
    least = ids[order][new][np.cumsum(new) - 1]
    bits = np.empty(len(ids), bool)
    bits[order] = ids[order] > least
    return _said(part, bits)


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _cut(length: int, ranges: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row_batch in rows:
            for row in row_batch.to_pylist():
                batch = Batch(row["blob"])
                places, keys, smallest, inverse = _windows(batch, length, ranges, row["anchors"])
                elsewhere = _answers(keys["h"].astype(np.uint64), ranges, row["windows"])
                repeat = elsewhere[inverse] | (batch.rank[batch.doc[places]] > smallest[inverse])
                mark = np.zeros(len(batch.hashes) + 1, np.int64)
                np.add.at(mark, places[repeat], 1)
                np.add.at(mark, places[repeat] + length, -1)
                gone = np.cumsum(mark)[:-1] > 0
                out = []
                for k in range(len(batch.ids)):
                    a, b = batch.first[k], batch.first[k + 1]
                    ws, cut = batch.text(k).split(), gone[a:b]
                    removed = int(cut.sum())
                    if removed:
                        ws = [ws[i] for i in np.flatnonzero(~cut)]
                    out.append((b - a, removed, b" ".join(ws)))
                n_words, n_removed, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.ids, mask=batch.ids == _NO_ID), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many buckets as Spark would shuffle to, so that answers come to the batches and not the other way round
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    ranges = max(12, math.ceil(size / RANGE_BYTES))
    batches = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                          ).mapInArrow(_batches, "batch string, blob binary")
    path, name = scratch_path(spark, "batches"), f"batches_{uuid.uuid4().hex}"
    (batches.write.bucketBy(buckets, "batch").sortBy("batch").option("path", path).saveAsTable(name))
    stored = spark.table(name)

    def told(sent: DataFrame, answer, column: str) -> DataFrame:
        said = cut_lineage(sent.groupBy("range").applyInPandas(answer, _ANSWER), column)  # bits: a small table
        return said.groupBy("batch").agg(F.collect_list(F.struct("range", "bits")).alias(column))

    anchors = told(stored.mapInArrow(_send_anchors(length, ranges), _SENT), _answer_anchors, "anchors")
    anchored = stored.join(anchors, "batch", "left")
    windows = told(anchored.mapInArrow(_send_windows(length, ranges), _SENT), _answer_windows, "windows")
    return anchored.join(windows, "batch", "left").select("batch", "blob", "anchors", "windows").mapInArrow(
        _cut(length, ranges), _RESULT)
