"""Uploaded files: acceptance, keys, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.session import cut_lineage


def extension(filename: T.ColumnOrName) -> Column:
    """Lower-case extension of at most ten letters and digits, else bin."""
    name = T.col(filename)
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when(F.contains(name, F.lit(".")) & ext.rlike(rf"^{fv.WORD.replace('_', '')}{{1,10}}$"), ext).otherwise("bin")


def storage_key(file_hash: T.ColumnOrName, filename: T.ColumnOrName) -> Column:
    return F.concat_ws(".", T.col(file_hash), extension(filename))


def plain_key(key: T.ColumnOrName, bucket: str = "uploads") -> Column:
    """Key without the old folder prefix."""
    return F.regexp_replace(T.col(key), f"^{bucket}/", "")


def safe_filename(filename: T.ColumnOrName) -> Column:
    name = T.strip(F.replace(T.or_blank(filename), F.lit(" "), F.lit("_")))
    return F.when(T.or_blank(filename) == "", "document").otherwise(name)


def safe_partition_name(name: T.ColumnOrName) -> Column:
    """At most 31 characters without the characters sheets and folders forbid."""
    cleaned = F.replace(F.regexp_replace(T.or_blank(name), r"[\\/*?:\[\]]", ""), F.lit("&"), F.lit("and"))
    short = F.left(T.squeeze(cleaned), F.lit(31))
    return F.when(short == "", "Sheet").otherwise(short)


def cache_key(platform: T.ColumnOrName, url: T.ColumnOrName) -> Column:
    return F.concat_ws(":", F.lit("scrape"), T.col(platform), F.left(F.sha2(T.col(url), 256), F.lit(16)))


def is_pdf(filename: T.ColumnOrName, head: T.ColumnOrName) -> Column:
    """By name or by the first bytes."""
    return F.lower(T.or_blank(filename)).endswith(".pdf") | T.or_blank(F.left(T.col(head).cast("string"), F.lit(4))).startswith("%PDF")


def rejection(mime: T.ColumnOrName, size: T.ColumnOrName, most: int = fv.MAX_OCR_BYTES, types=None) -> Column:
    """Why a file is refused; null when it is accepted."""
    known = T.col(mime).isin(types or fv.ACCEPTED_TYPES)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unsupported type").when(T.col(size) <= 0, "empty file")
        .when(T.col(size) > most, "too large")
    )


def screen_files(files: DataFrame, most: int = fv.MAX_OCR_BYTES, types=None) -> tuple[DataFrame, DataFrame]:
    """Accepted files with a valid mode, and the rejected ones with the reason."""
    checked = files.withColumn("reason", rejection("mime", "size", most, types))
    accepted = checked.filter(F.col("reason").isNull()).drop("reason").withColumn(
        "mode", F.when(F.col("mode").isin(fv.OCR_MODES), F.col("mode")).otherwise(fv.DEFAULT_MODE)
    )
    return accepted, checked.filter(F.col("reason").isNotNull())


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with content hash and storage key. Contents stay on the executors."""
    return spark.read.format("binaryFile").load(folder).select(
        "path", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("file_hash"),
        F.substring_index("path", "/", -1).alias("filename"), F.substring("content", 1, 4).alias("head"),
    ).withColumn("storage_key", storage_key("file_hash", "filename"))


def new_files(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """One file per storage key that is not stored yet.

    The choice among equal files is made on keys and paths only; contents are joined to the chosen paths.
    """
    chosen = uploads.groupBy("storage_key").agg(F.min("path").alias("path")).join(
        stored.select("storage_key"), "storage_key", "left_anti"
    )
    return uploads.join(chosen.select("path"), "path", "left_semi")


OBJECTS, REJECTS = "objects", "rejects"
_OBJECT = "storage_key string, file_hash string, filename string, size bigint, content binary, shelf string"
_REJECT = "path string, filename string, size bigint, reason string"


def ingest(spark: SparkSession, folder: str, store: str, most: int = fv.MAX_EXTRACTION_BYTES, glob: str | None = None
           ) -> tuple[DataFrame, DataFrame]:
    """Files of a folder into a store that holds each content once; refused files into a table of rejects.

    A file's key is its hash and extension. Keys that the store has, from this run or earlier ones, are not written
    again, so a run over the same files adds nothing. Files that are too large are refused by their length: their
    contents are never read. Spark lists no empty files. Returns all objects of the store and all rejects.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (files.option("pathGlobFilter", glob) if glob else files).load(folder)
    name = F.substring_index("path", "/", -1)
    size = F.col("length")
    refused = listed.filter(size > most).select("path", name.alias("filename"), size.alias("size"), F.lit("too large").alias("reason"))
    known = _stored(spark, f"{store}/{REJECTS}", _REJECT)
    refused.join(known.select("path", "size"), ["path", "size"], "left_anti").write.mode("append").parquet(f"{store}/{REJECTS}")

    accepted = listed.filter(size <= most)  # read only as far as this holds: the source prunes by length
    hashed = accepted.select("path", F.sha2("content", 256).alias("file_hash"), name.alias("filename"))
    keys = cut_lineage(hashed.withColumn("storage_key", storage_key("file_hash", "filename")), "upload-keys")
    objects = _stored(spark, f"{store}/{OBJECTS}", _OBJECT)
    fresh = keys.groupBy("storage_key").agg(F.min(F.struct("path", "file_hash", "filename")).alias("f")).join(
        objects.select("storage_key"), "storage_key", "left_anti").select("storage_key", "f.*")
    fresh = cut_lineage(fresh, "new-keys")  # settled before the store is written to
    shelf = F.substring("file_hash", 1, 2)
    accepted.select("path", size.alias("size"), "content").join(fresh, "path").select(
        "storage_key", "file_hash", "filename", "size", "content", shelf.alias("shelf")
    ).write.mode("append").partitionBy("shelf").parquet(f"{store}/{OBJECTS}")
    return _stored(spark, f"{store}/{OBJECTS}", _OBJECT), _stored(spark, f"{store}/{REJECTS}", _REJECT)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty before its first rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
