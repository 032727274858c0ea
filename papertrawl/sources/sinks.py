"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrawl.functions import text as T
from papertrawl.operators import invoices as I
from papertrawl.operators import lead_reports as R
from papertrawl.operators import ocr as O
from papertrawl.operators import products as P
from papertrawl.operators import statements as S
from papertrawl.sources.files import safe_partition_name

BUCKETS = 64


def write_products(products: DataFrame, path: str) -> None:
    """Append products with a title, one folder per job."""
    P.drop_untitled(products).write.mode("append").partitionBy("job_id").parquet(path)


#: Files a job's leads are written to, at most.
LEAD_FILES = 8


def write_leads(leads: DataFrame, path: str, jobs: DataFrame | None = None) -> None:
    """The leads of some jobs, one folder per job. A job run again replaces its own folder, and no other.

    jobs: the ids (column job_id) of all jobs that ran; one that has no leads now loses those it had. By default the
    jobs that have leads.
    """
    spark = leads.sparkSession
    dealt = leads.repartition("job_id", F.pmod(F.xxhash64(*leads.columns), F.lit(LEAD_FILES)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)
    if jobs is not None:
        empty = jobs.select("job_id").distinct().join(leads.select("job_id").distinct(), "job_id", "left_anti")
        for row in empty.toLocalIterator():  # one row a job without leads
            _delete(spark, f"{path.rstrip('/')}/job_id={row['job_id']}")


def write_lead_batch(leads: DataFrame, batch_id: int, path: str) -> None:
    """The body of a foreachBatch: a job's folder has one folder per batch, which a repeated batch replaces."""
    leads.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("job_id", "batch").parquet(path)


def replace_index_partition(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS,
                            documents: DataFrame | None = None) -> DataFrame:
    """Replace all chunks of the given documents, leaving other documents as they are.

    documents: the ids indexed again (column `key`), so that one without chunks loses its old ones; by default the
    documents that have chunks. buckets is a property of the stored index: choose it for its size, keep it for its
    life. Documents live in hash buckets. The buckets touched are read, stripped of the given documents, merged with
    the new chunks, staged, and swapped in by a dynamic partition overwrite, so a repeated run changes nothing.
    """
    from papertrawl.session import cut_lineage

    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = cut_lineage(chunks.withColumn("bucket", bucket), "index-new")
    again = fresh.select(key) if documents is None else documents.select(key).union(fresh.select(key))
    again = cut_lineage(again.distinct().withColumn("bucket", bucket), "index-documents")
    touched = again.select("bucket").distinct()  # at most `buckets` rows
    merged = fresh
    if _exists(spark, path):
        kept = (
            spark.read.schema(fresh.schema).parquet(path)
            .join(F.broadcast(touched), "bucket", "left_semi")
            .join(again.select(key), key, "left_anti")
        )
        merged = cut_lineage(fresh.unionByName(kept), "index-merged")
        # an overwrite by partition leaves a bucket alone that has no rows left, so it is emptied by name
        for row in touched.join(merged.select("bucket").distinct(), "bucket", "left_anti").collect():
            _delete(spark, f"{path.rstrip('/')}/bucket={row['bucket']}")
    merged.repartition("bucket", F.pmod(F.xxhash64(key, "chunk_index"), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)
    return spark.read.schema(fresh.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mark_indexed(documents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    indexed = chunks.select(key).distinct().withColumn("is_indexed", F.lit(True))
    return documents.join(indexed, key, "left").withColumn("is_indexed", F.coalesce("is_indexed", F.lit(False)))


def export_segments(leads: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder per segment, unlabelled segments included."""
    labelled = leads.withColumn("segment", safe_partition_name(F.coalesce(T.blank_to_null("category"), F.lit("other"))))
    labelled.write.mode("overwrite").format(form).option("header", True).partitionBy("segment").save(path)


def result_tables(kind: str, result: DataFrame) -> dict[str, DataFrame]:
    """Named report tables for a kind of result; unknown kinds become field and value rows."""
    kind = kind.lower()
    if "invoice" in kind:
        return {"invoice": I.normalize_invoices(result)}
    if "bank" in kind:
        tables = {"account_summary": S.summary_sheet(result)}
        return tables | ({"transactions": S.transaction_sheet(result)} if "transactions" in result.columns else {})
    if "ocr" in kind:
        return {"summary": O.metrics_summary(O.document_metrics(result)), "regions": O.region_report(result),
                "tokens": O.token_report(result), "full_text": O.page_full_text(result)}
    if "scrap" in kind:
        return {"products": P.product_report_rows(result), "summary": P.platform_summary(result),
                "price_analysis": P.price_analysis(result)}
    if "lead" in kind:
        return {"leads": R.lead_report_rows(result), "summary": R.segment_summary(result),
                "high_priority": R.high_priority(result)}
    return {"output": unpivot_result(result, [])}


def export_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table into its own folder; running it again replaces the folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).option("header", True).save(f"{path}/{name}")


def unpivot_result(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, field, value): one row per column."""
    values = [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(
        [F.col(c) for c in ids], values, "field", "value"
    )


def reexport(spark: SparkSession, stored: str, kind: str, path: str) -> None:
    """Export again from stored results."""
    export_tables(result_tables(kind, spark.read.parquet(stored)), path)


def download_leads(stored: DataFrame, job_id: str) -> DataFrame:
    """All rows of a job, best first."""
    order: list[Column] = [F.desc_nulls_last("confidence_score"), F.asc("created_at"), F.asc("id")]
    return R.lead_export(R.lead_view(stored.filter(F.col("job_id") == job_id))).orderBy(*order)
