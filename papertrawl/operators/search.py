"""Filtered cosine top-k and prompts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.operators.ranking import number_rows, ranked_per_key
from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

# queries travel to the tasks in slices of at most this many bytes of vectors; in a search with restricted views a
# slice also has at most so many queries, which bounds the list of queries that may see a document
SLICE_BYTES, SLICE_VIEWERS = 32 * 1024 * 1024, 4096
# scores a task computes at once
BLOCK_SCORES = 1 << 22


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    usable = lengths > 0
    return matrix / np.where(usable, lengths, 1.0)[:, None], usable


class _Best:
    """The k best chunks of every query of a slice so far, by similarity and then id."""

    def __init__(self, queries: int, k: int):
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0)] * queries
        self.edge = np.full(queries, -np.inf)  # what a chunk must reach
        self.k = k

    def add(self, chunk_ids: np.ndarray, scores: np.ndarray) -> None:
        open_ = (scores >= self.edge[:, None]) & (scores > -np.inf)
        for q in np.flatnonzero(open_.any(axis=1)):
            near = np.flatnonzero(open_[q])
            ids, found = np.append(self.ids[q], chunk_ids[near]), np.append(self.scores[q], scores[q, near])
            top = np.lexsort((ids, -found))[:self.k]
            self.ids[q], self.scores[q] = ids[top], found[top]
            if len(top) == self.k:
                self.edge[q] = found[top[-1]]


def _best_of_task(sent, k: int, restricted: bool):
    """The k best chunks of every query among all batches of a task.

    When restricted, each chunk names the queries that may see it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        unit_queries, asked = _unit_rows(queries)
        best, step = _Best(len(ids), k), max(1, BLOCK_SCORES // max(1, len(ids)))

        def visible(rows: pa.RecordBatch) -> np.ndarray:
            """Which query may see which chunk."""
            lists = rows.column("qids")
            owners = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
            wanted = lists.flatten().to_numpy(zero_copy_only=False)
            slot = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            known = ids[slot] == wanted
            seen = np.zeros((len(ids), rows.num_rows), dtype=bool)
            seen[slot[known], owners[known]] = True
            return seen

        for batch in batches:
            valid = batch.filter(batch.column("embedding").is_valid())
            for at in range(0, valid.num_rows, step):
                rows = valid.slice(at, step)
                flat = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                unit, usable = _unit_rows(flat.reshape(rows.num_rows, -1))
                scores = unit_queries @ unit.T
                scores[:, ~usable] = -np.inf
                scores[~asked] = -np.inf
                if restricted:
                    scores[~visible(rows)] = -np.inf
                best.add(rows.column("chunk_id").to_numpy(zero_copy_only=False), scores)
        counts = [len(x) for x in best.ids]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()),
                 pa.array(np.concatenate(best.scores), pa.float64())], ["qid", "chunk_id", "similarity"])

    return run


def vector_topk(
    queries: DataFrame, chunks: DataFrame, k: int = fv.TOP_K, allowed: DataFrame | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(qid, place, chunk_id, similarity): exact k nearest chunks of every query by cosine.

    queries: qid bigint, vector. chunks: chunk_id bigint, embedding, and document_id when allowed is given.
    allowed: (qid, document_id), the documents each query may see. Zero vectors match nothing.

    Every task multiplies its batches with the query matrix, a bounded block of scores at a time, and forwards
    k rows per query once, so no table of pairs is made. The queries are cut into slices of bounded size, each
    sent as a broadcast of its own, one at a time in the driver's Python; many slices mean several passes over
    the chunks.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        return chunks.sparkSession.createDataFrame([], "qid bigint, chunk_id bigint, similarity double, place int")
    per_slice = max(1, slice_bytes // (8 * max(1, size["d"])))
    per_slice = per_slice if allowed is None else min(per_slice, SLICE_VIEWERS)
    slices = -(-size["n"] // per_slice)

    def in_slice(df: DataFrame, i: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i) if slices > 1 else df

    parts = []
    for i in range(slices):
        rows = sorted(in_slice(queries.select("qid", "vector"), i).collect(), key=lambda r: r["qid"])
        if not rows:
            continue
        vectors = chunks.select("chunk_id", "embedding")
        if allowed is not None:
            seen_by = in_slice(allowed, i).groupBy("document_id").agg(F.collect_set("qid").alias("qids"))
            vectors = chunks.join(seen_by, "document_id").select("chunk_id", "embedding", "qids")
        ids, matrix = np.array([r["qid"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64)
        sent = chunks.sparkSession.sparkContext.broadcast((ids, matrix))
        parts.append(vectors.mapInArrow(
            _best_of_task(sent, k, allowed is not None), "qid bigint, chunk_id bigint, similarity double"))
    return _top(reduce(DataFrame.unionByName, parts), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    return ranked_per_key(found, ["qid"], [F.desc("similarity"), F.asc("chunk_id")], k, "place")


def filtered_topk(
    queries: DataFrame, chunks: DataFrame, allowed: DataFrame, k: int = fv.TOP_K,
    least: float | None = fv.MIN_SIMILARITY,
) -> DataFrame:
    """Top k among each query's own documents, then only those above the least similarity (at most k rows)."""
    top = vector_topk(queries, chunks, k, allowed)
    top = top if least is None else top.filter(F.col("similarity") > least)
    return top.join(chunks.select("chunk_id", "document_id"), "chunk_id")


def chunk_sources(top: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What a reader is shown: file name, page and the first 400 characters."""
    page = F.col("page_number") if "page_number" in chunks.columns else F.lit(None).cast("int")
    texts = chunks.select("chunk_id", F.left("text", F.lit(fv.SOURCE_CHARS)).alias("chunk_text"),
                          F.coalesce(page, F.lit(1)).alias("page_number"))
    return top.join(texts, "chunk_id").join(documents.select("document_id", "filename"), "document_id")


def build_prompts(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Prompt per question from its at most k sources; the plain prompt when it has none."""
    shown = F.format_string("[Source %d — %s]\n%s", F.col("place"), F.col("filename"), F.col("chunk_text"))
    lines = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))
    contexts = sources.groupBy("qid").agg(
        F.array_join(F.transform(lines, lambda x: x["shown"]), "\n\n").alias("context")
    )
    with_sources = F.concat(
        F.lit(fv.PROMPT_HEAD), F.col("context"), F.lit("\n\nUSER QUESTION: "), F.col("question"), F.lit("\n\nANSWER:")
    )
    simple = F.concat(F.lit(fv.SIMPLE_PROMPT_HEAD), F.col("question"), F.lit("\n\nANSWER:"))
    return questions.join(contexts, "qid", "left").select("qid", F.coalesce(with_sources, simple).alias("prompt"))


# ---- chat history ---------------------------------------------------------------------------------


def session_titles(messages: DataFrame) -> DataFrame:
    """First 60 characters of each conversation's first user message."""
    text = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(text.alias("first")).select(
        "conv_id",
        F.coalesce(
            F.concat(F.left("first", F.lit(60)), F.when(F.length("first") > 60, "…").otherwise("")), F.lit("New chat")
        ).alias("title"),
    )


def message_sequence(messages: DataFrame) -> DataFrame:
    """Messages with their position in the conversation, however long it is."""
    return number_rows(messages, ["conv_id"], ["turn"], "position")


def recent_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    return ranked_per_key(sessions, ["user_id"], [F.desc("created_at"), F.asc("session_id")], n, "place")
