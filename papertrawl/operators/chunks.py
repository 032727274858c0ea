"""Chunking of document texts and the chunk index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.functions.dom import bind

_SPAN = "struct<start:int,stop:int>"


def chunk_spans(text: Column, tokens: int = fv.CHUNK_TOKENS, overlap: int = fv.OVERLAP_TOKENS) -> Column:
    """Start and end of every window of a text, as an array.

    A window ends at its last blank. A blank so early that the next window would not advance is ignored and
    the window ends at full length, so every second window advances by nearly its length.
    """
    size, back = tokens * fv.CHARS_PER_TOKEN, overlap * fv.CHARS_PER_TOKEN
    if not 0 <= back < size:
        raise ValueError("the overlap must be shorter than the chunk")
    n = F.length(text)
    # two windows advance by at least size - overlap characters
    most = (2 * F.ceil(n / F.lit(size - back)) + 2).cast("int")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def window(at: Column) -> Column:
        """End of the window starting at a position."""
        full = at + size
        tail = F.reverse(F.substring(text, at + 1, F.lit(size)))
        blank = at + F.lit(size) - F.locate(" ", tail)
        usable = (F.locate(" ", tail) > 0) & (blank - back > at)
        return F.when((full < n) & usable, blank).otherwise(full)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        return F.when(at >= n, acc).otherwise(bind(window(at), lambda stop: F.struct(
            (stop - back).alias("at"),
            F.array_append(acc["spans"], F.struct(at.alias("start"), stop.alias("stop"))).alias("spans"),
        )))

    return F.aggregate(F.sequence(F.lit(1), F.when(n > 0, most).otherwise(F.lit(1))), begin, step)["spans"]


def chunk_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = fv.CHUNK_TOKENS,
    overlap: int = fv.OVERLAP_TOKENS, least: int = 1,
) -> DataFrame:
    """(key, chunk_index, text, start, is_contained): no shuffle, whole texts.

    Chunks of under `least` characters are left out: by default blank ones only, 21 for parity. is_contained marks a last chunk that lies completely inside the one before it.
    """
    spans = chunk_spans(F.col(text), tokens, overlap)
    parts = F.transform(F.col("_spans"), lambda s, i: F.struct(
        s["start"].alias("start"),
        T.strip(F.substring(F.col(text), s["start"] + 1, s["stop"] - s["start"])).alias("text"),
        ((i > 0) & (F.length(text) <= F.get(F.col("_spans"), i - 1)["stop"])).alias("is_contained"),
    ))
    kept = F.filter(parts, lambda p: F.length(p["text"]) >= least)
    return docs.select(key, text, spans.alias("_spans")).select(
        key, F.posexplode(kept).alias("chunk_index", "part")
    ).select(key, "chunk_index", "part.text", "part.start", "part.is_contained")


def _embedded(text: str, chars: int | None) -> Column:
    """The part of a text that is embedded: all of it, or its first characters (8000 for parity)."""
    return T.or_blank(text) if chars is None else F.left(T.or_blank(text), F.lit(chars))


def hashed_embedding(chunks: DataFrame, text: str = "text", dims: int = 256, chars: int | None = None) -> DataFrame:
    """Normalised hashed term counts: the embedding used without a model.

    Blank texts get the zero vector. All JVM-side.
    """
    cut = chunks.withColumn("_cut", _embedded(text, chars))
    words = RegexTokenizer(inputCol="_cut", outputCol="_words", pattern=fv.WORD + "+", gaps=False).transform(cut)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_cut", "_words", "_tf", "_unit")


def embed_chunks(chunks: DataFrame, scorer: Callable[..., Column] | None = None, chars: int | None = None) -> DataFrame:
    """Vectors from a model (a predict_batch_udf over text, loaded once per worker), else hashed terms."""
    if scorer is None:
        return hashed_embedding(chunks, chars=chars)
    return chunks.withColumn("embedding", scorer(_embedded("text", chars)))


def build_index(docs: DataFrame, key: str = "doc_id", scorer: Callable[..., Column] | None = None) -> DataFrame:
    return embed_chunks(chunk_documents(docs, key).filter(F.length("text") > 0), scorer)
