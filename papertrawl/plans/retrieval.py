"""Chunking, vector search and chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl.operators import chunks as K
from papertrawl.operators import models as M
from papertrawl.operators import ranking
from papertrawl.operators import search as S
from papertrawl.sources.tables import spread, table


def chunks(spark, sf):
    return K.chunk_documents(spread(table(spark, sf, "documents"))).select(
        "doc_id", "chunk_index", F.md5("text").alias("text_hash"), F.length("text").alias("chars"), "is_contained"
    )


def small_chunks(spark, sf):
    return K.chunk_documents(spread(table(spark, sf, "documents")), tokens=64, overlap=16).select(
        "doc_id", "chunk_index", "start", F.length("text").alias("chars")
    )


def chunk_stats(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return K.chunk_documents(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest")
    )


def chunk_index(spark, sf):
    index = K.build_index(spread(table(spark, sf, "documents")))
    return index.select(
        "doc_id", "chunk_index", F.size("embedding").alias("dims"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("length"),
    )


def model_embeddings(spark, sf):
    """Chunks embedded by a batch model that reads letters: the shares of e and n, to unit length."""
    index = K.build_index(spread(table(spark, sf, "documents")), scorer=M.as_scorer(M.letter_embedder(), "float"))
    return index.select("doc_id", "chunk_index", *[
        F.round(F.get("embedding", M.LETTERS.index(x)).cast("double"), 4).alias(x) for x in ("e", "n")])


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("document_id"), "embedding"
    )


def _centroids(vectors):
    """Mean vector per label: the questions asked of the vector table."""
    means = vectors.select("document_id", F.posexplode("embedding").alias("pos", "x")).groupBy("document_id", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("mean")
    )
    return means.groupBy(F.col("document_id").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("vector")
    )


def vector_topk(spark, sf):
    vectors = _vectors(spark, sf)
    return S.vector_topk(_centroids(vectors), vectors, 10).select(
        "qid", "place", "chunk_id", F.round("similarity", 6).alias("similarity")
    )


def vector_topk_filtered(spark, sf):
    """Each question searches its own label and the next one."""
    vectors = _vectors(spark, sf)
    questions = _centroids(vectors)
    allowed = questions.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("document_id"))
    return S.filtered_topk(questions, vectors, allowed, least=0.2).select(
        "qid", "place", "chunk_id", "document_id", F.round("similarity", 6).alias("similarity")
    )


def text_search(spark, sf):
    """Benchmark texts as questions over all document chunks, with hashed vectors."""
    docs = spread(table(spark, sf, "documents"))
    index = K.build_index(docs).select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"),
        "text", "embedding",
    )
    asked = K.hashed_embedding(table(spark, sf, "benchmark")).select(
        F.col("item_id").alias("qid"), F.col("embedding").alias("vector")
    )
    return S.vector_topk(asked, index)


def prompts(spark, sf):
    """Prompts from the sources that mention the question's own text; hashed vectors."""
    docs = spread(table(spark, sf, "documents"))
    index = K.build_index(docs).select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"),
        "text", "embedding",
    )
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    asked = K.hashed_embedding(questions, "question").select("qid", F.col("embedding").alias("vector"))
    names = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.col("source"), F.lit(".txt")).alias("filename"))
    top = S.vector_topk(asked, index).filter("similarity > 0.5").withColumn(
        "document_id", F.floor(F.col("chunk_id") / 1_000_000)
    )
    sources = S.chunk_sources(top, index.drop("document_id"), names)
    return S.build_prompts(questions, sources)


def cosine_prompts(spark, sf):
    """Prompts over the vector table: the sources are its rows, shown by number."""
    vectors = _vectors(spark, sf)
    questions = _centroids(vectors)
    top = S.vector_topk(questions, vectors)
    sources = top.select(
        "qid", "place", F.concat(F.lit("vec"), "chunk_id").alias("filename"), F.col("chunk_id").cast("string").alias("chunk_text")
    )
    asked = questions.select("qid", F.concat(F.lit("label "), "qid").alias("question"))
    return S.build_prompts(asked, sources)


def session_titles(spark, sf):
    return S.session_titles(table(spark, sf, "conversations"))


def message_sequence(spark, sf):
    return S.message_sequence(table(spark, sf, "conversations")).select("conv_id", "turn", "position", "role")


def recent_sessions(spark, sf):
    sessions = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("created_at")
    )
    return S.recent_sessions(sessions).select("user_id", "place", "session_id")


def similar_rows(spark, sf):
    """Similarity of every vector to its label's mean, computed in the row."""
    from papertrawl.functions.vectors import cosine_similarity

    vectors = _vectors(spark, sf)
    return vectors.join(_centroids(vectors), F.col("document_id") == F.col("qid")).select(
        "chunk_id", F.round(cosine_similarity("embedding", "vector"), 6).alias("similarity")
    )


QUERIES = {f.__name__: f for f in (
    chunks, small_chunks, chunk_stats, chunk_index, model_embeddings, vector_topk, vector_topk_filtered, text_search, prompts,
    cosine_prompts, session_titles, message_sequence, recent_sessions, similar_rows,
)}


def chunk_sql(size: int, back: int) -> str:
    blank = f"(off + {size} - strpos(reverse(text[off + 1:off + {size}]), ' '))"
    usable = f"strpos(reverse(text[off + 1:off + {size}]), ' ') > 0 AND {blank} - {back} > off"
    strip = r"regexp_replace(text[off + 1:stop], '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g')"
    return f"""RECURSIVE w AS (
      SELECT doc_id, text, length(text) AS n, 0 AS no, 0::BIGINT AS off,
        (SELECT CASE WHEN {size} < length(text) AND {usable} THEN {blank} ELSE {size} END FROM (SELECT 0 AS off)) AS stop, false AS inside
      FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, text, n, no + 1, off, CASE WHEN off + {size} < n AND {usable} THEN {blank} ELSE off + {size} END, n <= stop
      FROM (SELECT doc_id, text, n, no, stop - {back} AS off, stop FROM w) WHERE off < n),
    parts AS (SELECT doc_id, no, off, {strip} AS piece, inside FROM w),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS chunk_index FROM parts WHERE length(piece) > 0)"""


_BIG = chunk_sql(2048, 512)
_CENTROIDS = """v AS (SELECT vec_id AS chunk_id, label::BIGINT AS document_id, embedding::DOUBLE[] AS e FROM embeddings),
  q AS (SELECT document_id AS qid, list(mean ORDER BY pos) AS vector FROM (
    SELECT document_id, pos, avg(e[pos]) AS mean FROM v, range(1, 65) r(pos) GROUP BY ALL) GROUP BY ALL)"""
_SIM = "list_cosine_similarity(e, vector)"
ORACLES = {
    "chunk_index": f"""WITH {_BIG} SELECT doc_id, chunk_index, 256 AS dims,
        CASE WHEN regexp_matches(piece, '[\\pL\\pN_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM kept""",
    "model_embeddings": f"""WITH {_BIG}, low AS (SELECT doc_id, chunk_index, translate(piece, '{M.LETTERS.upper()}', '{M.LETTERS}') AS t FROM kept),
        c AS (SELECT doc_id, chunk_index, [{', '.join(f"strlen(t) - strlen(replace(t, '{x}', ''))" for x in M.LETTERS)}] AS n FROM low),
        l AS (SELECT *, greatest(sqrt(list_sum(list_transform(n, lambda x: x * x))), 1e-9) AS length FROM c)
      SELECT doc_id, chunk_index, round((n[5] / length)::FLOAT::DOUBLE, 4) AS e, round((n[14] / length)::FLOAT::DOUBLE, 4) AS n FROM l""",
    "chunks": f"WITH {_BIG} SELECT doc_id, chunk_index, md5(piece) AS text_hash, length(piece) AS chars, inside AS is_contained FROM kept",
    "small_chunks": f"WITH {chunk_sql(256, 64)} SELECT doc_id, chunk_index, off AS start, length(piece) AS chars FROM kept",
    "chunk_stats": f"WITH {_BIG} SELECT doc_id, count(*) AS chunks, max(length(piece)) AS longest FROM kept GROUP BY doc_id",
    "vector_topk": f"""WITH {_CENTROIDS} SELECT qid, place, chunk_id, round(s, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS place FROM (SELECT qid, chunk_id, {_SIM} AS s FROM q, v))
        WHERE place <= 10""",
    "vector_topk_filtered": f"""WITH {_CENTROIDS} SELECT qid, place, chunk_id, document_id, round(s, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS place FROM (
          SELECT qid, chunk_id, document_id, {_SIM} AS s FROM q JOIN v ON document_id = qid OR document_id = qid + 1))
        WHERE place <= 5 AND s > 0.2""",
    "cosine_prompts": f"""WITH {_CENTROIDS}, top AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS place
          FROM (SELECT qid, chunk_id, {_SIM} AS s FROM q, v))
        SELECT qid, 'You are an AI assistant specialised in analysing financial documents.' || chr(10) ||
          'Answer the user''s question based ONLY on the provided document context.' || chr(10) ||
          'If the answer is not in the context, say so clearly. Cite which source you used.' || chr(10) || chr(10) ||
          'DOCUMENT CONTEXT:' || chr(10) ||
          string_agg('[Source ' || place || ' — vec' || chunk_id || ']' || chr(10) || chunk_id, chr(10) || chr(10) ORDER BY place) ||
          chr(10) || chr(10) || 'USER QUESTION: label ' || qid || chr(10) || chr(10) || 'ANSWER:' AS prompt
        FROM top WHERE place <= 5 GROUP BY qid""",
    "session_titles": """SELECT conv_id, coalesce(left(t, 60) || CASE WHEN length(t) > 60 THEN '…' ELSE '' END, 'New chat') AS title
        FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)""",
    "message_sequence": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role FROM conversations",
    "recent_sessions": """SELECT user_id, place, event_id AS session_id FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 50""",
    "similar_rows": f"WITH {_CENTROIDS} SELECT chunk_id, round({_SIM}, 6) AS similarity FROM v JOIN q ON document_id = qid",
}
