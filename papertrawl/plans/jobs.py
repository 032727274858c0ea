"""Job ledger, file, export and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.operators import jobs as J
from papertrawl.operators import models as M
from papertrawl.operators import products as P
from papertrawl.operators import statements
from papertrawl.plans import leads as lead_plans
from papertrawl.plans import products as product_plans
from papertrawl.plans import statements as statement_plans
from papertrawl.plans.contacts import email_rows_sql, phone_rows_sql
from papertrawl.plans.leads import JOB_LIMITS
from papertrawl.plans.retrieval import chunk_sql
from papertrawl.session import cut_lineage, scratch_path
from papertrawl.sources import files, rendered, sinks
from papertrawl.sources.tables import table
from papertrawl.streaming import ledger as S


def _states(spark, sf):
    return J.latest_state(rendered.job_events(spark, sf))


def _jobs(spark, sf):
    """Jobs with owner and type."""
    k = F.col("job_id")
    kinds = F.lit(["ocr", "extraction_invoice", "lead_scrape"])
    return _states(spark, sf).select(
        "*", F.pmod(k, F.lit(5)).alias("user_id"), F.get(kinds, F.pmod(k, F.lit(3)).cast("int")).alias("job_type")
    )


def _seconds(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def job_latest_state(spark, sf):
    return _states(spark, sf).select("job_id", "status", "progress", _seconds("updated_at").alias("updated_at"), "events")


def last_n_events(spark, sf):
    return J.last_events(rendered.job_events(spark, sf)).select("job_id", "age", "event_id", "event")


def job_timeouts(spark, sf):
    return J.timeouts(rendered.job_events(spark, sf)).select("job_id", _seconds("timed_out_at").alias("timed_out_at"))


def replay_from_cursor(spark, sf):
    """Every job read from its middle event on."""
    events = rendered.job_events(spark, sf)
    cursors = events.groupBy("job_id").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("last_id"))
    return J.replay_after(events, cursors, _states(spark, sf))


def job_counts(spark, sf):
    return J.job_counts(_jobs(spark, sf), "user_id", "job_type", "status")


def job_history(spark, sf):
    return J.job_history(_jobs(spark, sf), 2, 20).select("job_id", _seconds("created_at").alias("created_at"), "status")


def owned_jobs(spark, sf):
    return J.owned_by(_jobs(spark, sf), 3, status="failed").select("job_id", "status", "progress")


def job_submissions(spark, sf):
    return J.assign_jobs(rendered.submissions(spark, sf)).select("submission_id", "user_id", "idempotency_key", "job_id")


def new_jobs(spark, sf):
    """Submissions of all sources but the first, given that the first source's jobs exist."""
    assigned = J.assign_jobs(rendered.submissions(spark, sf))
    known = assigned.filter(F.contains("filename", F.lit("src0 "))).select("user_id", "idempotency_key").distinct()
    return J.new_jobs(assigned, known).select("submission_id", "user_id", "idempotency_key")


def owned_documents(spark, sf):
    """Labelled documents and good labels of every source."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    joined = J.attach_owner(labels, docs, "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.sum("quality").cast("bigint").alias("good"))


def labelled_documents(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return J.without_orphans(docs, labels, "doc_id").select("doc_id", "n_chars")


def unlabelled_documents(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "n_chars")


def file_screening(spark, sf):
    accepted, rejected = files.screen_files(rendered.submissions(spark, sf), most=20_000)
    return accepted.select("submission_id", F.col("mode").alias("outcome")).unionByName(
        rejected.select("submission_id", F.col("reason").alias("outcome"))
    )


def file_keys(spark, sf):
    return rendered.submissions(spark, sf).select(
        "submission_id", files.storage_key("file_hash", "filename").alias("storage_key"),
        files.plain_key(F.concat(F.lit("uploads/"), "file_hash")).alias("plain_key"),
        files.safe_filename("filename").alias("safe_name"), files.cache_key(F.lit("amazon"), "filename").alias("cache_key"),
        files.is_pdf("filename", "head").alias("is_pdf"),
        files.safe_partition_name(F.concat(F.lit("A & B: "), "filename")).alias("sheet"),
    )


#: Neighbouring documents in one file, and the largest file taken, in ingested_files.
FILE_DOCS, FILE_BYTES = 20, 40_000


def ingested_files(spark, sf):
    """Twenty documents each as a file, every fifth file sent twice, taken into a store by two runs over them."""
    folder, store = scratch_path(spark, "uploads"), scratch_path(spark, "store")
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / FILE_DOCS).alias("file"), "doc_id", F.col("text").alias("value"))
    for copy, some in ((0, docs), (1, docs.filter("file % 5 = 0"))):
        some.repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id").write.partitionBy("file").text(f"{folder}/copy{copy}")
    files.ingest(spark, folder, store, FILE_BYTES, "*.txt")
    objects, rejects = files.ingest(spark, folder, store, FILE_BYTES, "*.txt")
    kept = objects.select("storage_key", "size", (F.sha2("content", 256) == F.col("file_hash")).alias("is_whole"), F.lit("stored").alias("outcome"))
    return kept.unionByName(rejects.select(F.lit(None).cast("string").alias("storage_key"), "size", F.lit(None).cast("boolean").alias("is_whole"),
                                           F.col("reason").alias("outcome")))


def unpivoted_suppliers(spark, sf):
    money = F.col("s_acctbal").cast("decimal(18,2)")  # one way to write a number
    return sinks.unpivot_result(table(spark, sf, "supplier").withColumn("s_acctbal", money), ["s_suppkey"])


def exported_segments(spark, sf):
    """Customers written as one folder per market segment, and read back."""
    path = scratch_path(spark, "segments")
    leads = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    sinks.export_segments(leads, path)
    return spark.read.parquet(path).groupBy("segment").agg(F.count(F.lit(1)).alias("leads"))


def stored_products(spark, sf):
    """Products written per job and read back."""
    path = scratch_path(spark, "products")
    products = P.extract_products(rendered.product_pages(spark, sf)).withColumn("job_id", F.concat(F.lit("job-"), "platform"))
    sinks.write_products(products, path)
    return spark.read.parquet(path).groupBy("job_id").agg(F.count(F.lit(1)).alias("products"))


def replaced_index(spark, sf):
    """Chunks of all documents and their vectors indexed; the English ones again with other chunks, those of src1 with none."""
    from papertrawl.operators.chunks import chunk_documents, embed_chunks

    path = scratch_path(spark, "index")
    docs = table(spark, sf, "documents")

    def rows(chunks):
        index = embed_chunks(chunks, M.as_scorer(M.letter_embedder(), "float"))
        return index.select("doc_id", "chunk_index", F.length("text").alias("chars"), "embedding")

    sinks.replace_index_partition(rows(chunk_documents(docs)), path, buckets=8)
    english = docs.filter("lang = 'en'")
    again = chunk_documents(english.filter("source <> 'src1'"), tokens=256, overlap=64)
    index = sinks.replace_index_partition(rows(again), path, buckets=8, documents=english)
    marked = sinks.mark_indexed(docs.select("doc_id"), index)
    shares = F.round(F.get("embedding", M.LETTERS.index("e")).cast("double"), 4).cast("decimal(18,4)")
    counts = index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"),
                                         F.sum(shares).cast("double").alias("e"))
    return marked.join(counts, "doc_id", "left").select("doc_id", "is_indexed", "chunks", "chars", "e")


def _reexported(spark, results, kind, name):
    """One table of the report that is exported again from stored results."""
    stored, report = scratch_path(spark, "results"), scratch_path(spark, "report")
    results.write.parquet(stored)
    sinks.reexport(spark, stored, kind, report)
    return spark.read.parquet(f"{report}/{name}")


def reexported_statements(spark, sf):
    """The transactions of a bank report, from stored results of statements."""
    results = statements.statement_results(statements.read_text(rendered.statement_text(spark, sf)))
    return _reexported(spark, results, "extraction_bank_statement", "transactions").drop("source_file")


def reexported_accounts(spark, sf):
    """The account summary of a bank report, from stored results of statements."""
    results = statements.statement_results(statements.read_text(rendered.statement_text(spark, sf)))
    return _reexported(spark, results, "extraction_bank_statement", "account_summary")


def reexported_prices(spark, sf):
    """The price table of a product report, from stored products."""
    return _reexported(spark, P.extract_products(rendered.product_pages(spark, sf)), "scraping", "price_analysis")


def reexported_orders(spark, sf):
    """Results of a kind that has no report of its own: a row per field."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return _reexported(spark, orders, "other", "output").groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def downloaded_leads(spark, sf):
    return sinks.download_leads(rendered.stored_products(spark, sf), "job-1").select("id", "company_name", "phone", "confidence_score")


# ---- streams --------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    kind = F.col("event_type")
    return S.read_stream(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "complete").when(kind == "error", "error").otherwise("progress").alias("event"),
        F.floor(F.pmod(F.col("value"), F.lit(100.0))).cast("int").alias("progress"),
    )


def stream_last_events(spark, sf):
    rows = S.run_to_table(S.last_events(_event_stream(spark, sf)), "last-events", "update")
    newest = rows.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["job_id", "batch"]).select("job_id", "age", "event_id", "event")


def stream_job_state(spark, sf):
    rows = S.run_to_table(S.job_states(_event_stream(spark, sf)), "job-state", "update")
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "updated_at"), "batch").alias("s"))
    return last.select("job_id", "s.status", "s.progress", _seconds("s.updated_at").alias("updated_at"))


def stream_throttle(spark, sf):
    """Events at least ten minutes apart per job (the table's events are minutes apart)."""
    rows = S.run_to_table(S.throttle(_event_stream(spark, sf), seconds=600), "throttle")
    return rows.select(F.col("key").cast("bigint").alias("job_id"), F.col("row_id").alias("event_id"))


def stream_first_fetches(spark, sf):
    """Fetches per event type and user, answered from the cache for an hour."""
    requests = S.read_stream(spark, sf, "events").select(
        F.concat_ws(":", "event_type", "user_id").alias("cache_key"), F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    rows = S.run_to_table(S.first_fetches(requests), "fetches")
    return rows.select("key", F.col("row_id").alias("request_id"))


def _arriving(spark, rows, parts: int, folder: str):
    """The rows (with a column arrival from 0) written part by part; each part is there for the next run to find."""
    rows = rows.withColumn("arrival", F.col("arrival").cast("int"))
    for i in range(parts):
        rows.filter(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(folder)
        yield S.read_folder(spark, folder, rows.drop("arrival").schema)


def _arrival(spark, sf, parts: int):
    """Events in so many parts by their number."""
    events = rendered.job_events(spark, sf)
    n = events.agg(F.max("event_id") + 1).first()[0]
    return events, F.floor(F.col("event_id") * parts / F.lit(n))


def stream_late_rows(spark, sf):
    """Events in four arrivals; every 97th comes with the last one, whatever its time. Late ones go to a table of their own."""
    events, arrival = _arrival(spark, sf, 4)
    events = events.withColumn("arrival", F.when(F.col("event_id") % 97 == 5, 3).otherwise(arrival))
    folder = scratch_path(spark, "split")
    for stream in _arriving(spark, events.select("event_id", "job_id", "ts", "arrival"), 4, scratch_path(spark, "arrivals")):
        in_time, late = S.split_late(stream, folder)
    return in_time.select("event_id", "batch", F.lit("in time").alias("outcome")).unionByName(
        late.select("event_id", "batch", F.lit("late").alias("outcome")))


def stream_lead_jobs(spark, sf):
    """Leads of three jobs in two arrivals, each job within its limit."""
    listings = rendered.lead_listings(spark, sf).withColumn("job_id", (F.col("task") + F.col("source_rank")) % 3)
    arrival = F.col("item") % 2
    leads = listings.select(
        F.col("job_id").cast("bigint").alias("job_id"), F.get(F.array(*[F.lit(n) for n in JOB_LIMITS]), F.col("job_id")).alias("max_leads"),
        "company_name", "city", "source_rank", "task", "item", F.timestamp_seconds(1_700_000_000 + 60 * arrival).alias("ts"),
        arrival.alias("arrival"))
    state, out = scratch_path(spark, "lead-jobs-state"), scratch_path(spark, "lead-jobs")
    for stream in _arriving(spark, leads, 2, scratch_path(spark, "arrivals")):
        rows = S.run_to_table(S.capped_leads(stream), "lead-jobs", "append", state, out)
    return rows.select("job_id", "dedup_key", "source_rank", "task", "item")


#: A reader of stream_replay gives up after so many seconds without an event.
PATIENCE = 43_200
#: No job lives longer, so a reader that has been told all is remembered so long.
JOB_LIFE = 60 * 86_400


def stream_replay(spark, sf):
    """Two readers of every job, one from the start and one from its middle event on, told in two runs."""
    events, arrival = _arrival(spark, sf, 2)
    middle = events.groupBy("job_id").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("m"))
    cursors = cut_lineage(middle.select("job_id", F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("reader"), at.cast("bigint").alias("last_id")) for i, at in enumerate((F.lit(-1), F.col("m")))]))), "cursors")
    state, out = scratch_path(spark, "replay-state"), scratch_path(spark, "replay")
    for stream in _arriving(spark, events.select("job_id", "event_id", "ts", "event", arrival.alias("arrival")), 2, scratch_path(spark, "arrivals")):
        rows = S.run_to_table(S.replay(stream, cursors, PATIENCE, keep=JOB_LIFE), "replay", "append", state, out)
    return S.connected(cursors, _states(spark, sf)).unionByName(rows.select("job_id", "reader", "event_id", "event"))


def stream_leads(spark, sf):
    """Distinct customers by name and market; one key may come from several customers."""
    leads = S.read_stream(spark, sf, "customer").select(
        F.concat(F.lit("Firm "), F.col("c_nationkey")).alias("company_name"), F.col("c_mktsegment").alias("city")
    )
    return S.run_to_table(S.distinct_leads(leads), "leads").select("dedup_key")


def stream_contacts(spark, sf):
    rows = S.run_to_table(S.ingest_contacts(S.read_stream(spark, sf, "documents")), "contacts")
    return rows.select("doc_id", "kind", "rank", "value")


QUERIES = {f.__name__: f for f in (
    job_latest_state, last_n_events, job_timeouts, replay_from_cursor, job_counts, job_history, owned_jobs,
    job_submissions, new_jobs, owned_documents, labelled_documents, unlabelled_documents, file_screening, file_keys, ingested_files, unpivoted_suppliers,
    reexported_statements, reexported_accounts, reexported_prices, reexported_orders, exported_segments, stored_products,
    replaced_index, downloaded_leads, stream_last_events, stream_job_state,
    stream_throttle, stream_first_fetches, stream_late_rows, stream_lead_jobs, stream_replay, stream_leads, stream_contacts,
)}

_EV = """ev AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS event,
      floor(value % 100)::INT AS progress FROM events),
  ends AS (SELECT job_id, ts AS end_ts, event_id AS end_id, event AS end_event FROM ev WHERE event <> 'progress'
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1),
  prog AS (SELECT job_id, progress FROM ev WHERE event = 'progress' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
  lastp AS (SELECT job_id, max(ts) AS last_ts FROM ev WHERE event = 'progress' GROUP BY job_id),
  agg AS (SELECT job_id, min(ts) AS created_at, max(ts) AS last_seen, count(*) AS events FROM ev GROUP BY job_id),
  states AS (SELECT a.job_id, CASE end_event WHEN 'complete' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
      CASE WHEN end_event = 'complete' THEN 100 ELSE coalesce(p.progress, 0) END AS progress, created_at, coalesce(end_ts, last_seen) AS updated_at, events,
      a.job_id % 5 AS user_id, ['ocr', 'extraction_invoice', 'lead_scrape'][a.job_id % 3 + 1] AS job_type
    FROM agg a LEFT JOIN ends e ON a.job_id = e.job_id LEFT JOIN prog p ON a.job_id = p.job_id)"""
_SEC = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_SUB = """sub AS (SELECT doc_id AS submission_id, doc_id % 7 AS user_id, sha256(text) AS file_hash, strlen(text) AS size,
      'Scan ' || source || ' ' || doc_id || ['.PDF', '.png', '.html', ''][doc_id % 4 + 1] AS filename,
      ['application/pdf', 'image/png', 'text/html', 'image/jpeg'][doc_id % 4 + 1] AS mime,
      ['fast', 'full', 'best'][doc_id % 3 + 1] AS mode, left(text, 4) AS head FROM documents),
  assigned AS (SELECT *, file_hash || ':' || mode AS idempotency_key, min(submission_id) OVER (PARTITION BY user_id, file_hash, mode) AS job_id FROM sub)"""
_LAST = f"""WITH {_EV} SELECT job_id, age, event_id, event FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS age FROM ev) WHERE age <= 100"""


def _spaced_sql(key: str, interval: str) -> str:
    """Greedy chain per key: each kept row is the first one at least the interval after the last kept one."""
    return f"""RECURSIVE e AS (SELECT {key} AS key, ts, event_id FROM events),
      r AS (SELECT key, min(ts) AS ts FROM e GROUP BY key
        UNION ALL SELECT r.key, (SELECT min(e.ts) FROM e WHERE e.key = r.key AND e.ts >= r.ts + INTERVAL {interval}) FROM r WHERE r.ts IS NOT NULL)
      SELECT r.key, (SELECT min(event_id) FROM e WHERE e.key = r.key AND e.ts = r.ts) AS row_id FROM r WHERE r.ts IS NOT NULL"""


_P, _E = phone_rows_sql("documents", "doc_id", "text"), email_rows_sql("documents", "doc_id", "text")
_TIMES = [f"(strlen(t) - strlen(replace(t, '{x}', '')))" for x in M.LETTERS]
_SHARE = f"round(({_TIMES[M.LETTERS.index('e')]} / greatest(sqrt({' + '.join(f'{n} * {n}' for n in _TIMES)}), 1e-9))::FLOAT::DOUBLE, 4)"


def _chunk_rows(tokens: int, overlap: int) -> str:
    return f"SELECT * FROM (WITH {chunk_sql(tokens * 4, overlap * 4)} SELECT doc_id, length(piece) AS n, {_SHARE} AS e FROM (SELECT *, translate(piece, '{M.LETTERS.upper()}', '{M.LETTERS}') AS t FROM kept)) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"


_TERMINAL = ", ".join(f"'{e}'" for e in fv.TERMINAL_EVENTS)

ORACLES = {
    "replaced_index": f"""WITH k AS (SELECT doc_id, n, e FROM ({_chunk_rows(512, 128)}) WHERE lang <> 'en'
        UNION ALL SELECT doc_id, n, e FROM ({_chunk_rows(256, 64)}) WHERE lang = 'en' AND source <> 'src1'),
        g AS (SELECT doc_id, count(*) AS chunks, sum(n)::BIGINT AS chars, sum(e::DECIMAL(18,4))::DOUBLE AS e FROM k GROUP BY doc_id)
      SELECT d.doc_id, g.doc_id IS NOT NULL AS is_indexed, chunks, chars, e FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "job_latest_state": f"WITH {_EV} SELECT job_id, status, progress, {_SEC.format('updated_at')} AS updated_at, events FROM states",
    "last_n_events": _LAST,
    "job_timeouts": f"""WITH {_EV}, late AS (SELECT job_id, ts, event_id FROM ev JOIN agg USING (job_id) WHERE event = 'progress' AND ts > created_at + INTERVAL 900 SECOND
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1)
      SELECT job_id, {_SEC.format('ts')} AS timed_out_at FROM late LEFT JOIN ends USING (job_id) WHERE end_ts IS NULL OR ts < end_ts OR (ts = end_ts AND event_id < end_id)""",
    "replay_from_cursor": f"""WITH {_EV}, cur AS (SELECT job_id, floor((min(event_id) + max(event_id)) / 2)::BIGINT AS last_id FROM ev GROUP BY job_id)
      SELECT job_id, NULL::BIGINT AS event_id, 'job_update' AS event, status FROM states
      UNION ALL SELECT job_id, event_id, event, NULL FROM (SELECT *, min(CASE WHEN event IN ({_TERMINAL}) THEN event_id END)
        OVER (PARTITION BY job_id) AS end_id FROM ev JOIN cur USING (job_id) WHERE event_id > last_id)
      WHERE end_id IS NULL OR event_id <= end_id""",
    "job_counts": f"WITH {_EV} SELECT user_id, job_type, status, count(*) AS jobs FROM states GROUP BY ALL",
    "job_history": f"WITH {_EV} SELECT job_id, {_SEC.format('created_at')} AS created_at, status FROM states ORDER BY states.created_at DESC, job_id LIMIT 20 OFFSET 20",
    "owned_jobs": f"WITH {_EV} SELECT job_id, status, progress FROM states WHERE user_id = 3 AND status = 'failed'",
    "job_submissions": f"WITH {_SUB} SELECT submission_id, user_id, idempotency_key, job_id FROM assigned",
    "new_jobs": f"""WITH {_SUB}, known AS (SELECT DISTINCT user_id, idempotency_key FROM assigned WHERE contains(filename, 'src0 '))
      SELECT submission_id, user_id, idempotency_key FROM assigned a WHERE submission_id = job_id
        AND NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = a.user_id AND k.idempotency_key = a.idempotency_key)""",
    "owned_documents": "SELECT source, count(*) AS labelled, sum(quality)::BIGINT AS good FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "labelled_documents": "SELECT doc_id, n_chars FROM documents SEMI JOIN labels USING (doc_id)",
    "unlabelled_documents": "SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)",
    "file_screening": f"""WITH {_SUB} SELECT submission_id, CASE WHEN mime = 'text/html' THEN 'unsupported type' WHEN size <= 0 THEN 'empty file'
        WHEN size > 20000 THEN 'too large' WHEN mode = 'best' THEN 'full' ELSE mode END AS outcome FROM sub""",
    "file_keys": f"""WITH {_SUB} SELECT submission_id, file_hash || '.' || ['pdf', 'png', 'html', 'bin'][submission_id % 4 + 1] AS storage_key,
        file_hash AS plain_key, replace(filename, ' ', '_') AS safe_name, 'scrape:amazon:' || left(sha256(filename), 16) AS cache_key,
        submission_id % 4 = 0 OR head = '%PDF' AS is_pdf, left('A and B ' || filename, 31) AS sheet FROM sub""",
    "unpivoted_suppliers": """SELECT s_suppkey, 's_name' AS field, s_name AS value FROM supplier
      UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::VARCHAR FROM supplier
      UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal::DECIMAL(18,2)::VARCHAR FROM supplier""",
    "exported_segments": "SELECT c_mktsegment AS segment, count(*) AS leads FROM customer GROUP BY ALL",
    "stored_products": """SELECT 'job-' || ['amazon','flipkart','amazon','flipkart','manual','flipkart','swiggy','zomato'][p_partkey % 8 + 1] AS job_id,
        count(*) AS products FROM part GROUP BY ALL""",
    "reexported_statements": statement_plans.ORACLES["transaction_sheet"],
    "reexported_accounts": statement_plans.ORACLES["statement_summary"],
    "reexported_prices": product_plans.ORACLES["price_analysis"],
    "reexported_orders": """SELECT field, value, count(*) AS rows FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) AS field,
        unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority]) AS value FROM orders) GROUP BY ALL""",
    "downloaded_leads": """SELECT c_custkey::VARCHAR AS id, c_name AS company_name, CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '8' END || lpad(c_custkey::VARCHAR, 9, '0') AS phone,
        least(round((c_custkey % 11) / 8.0, 3), 1.0)::DOUBLE AS confidence_score FROM customer""",
    "stream_last_events": _LAST,
    "stream_job_state": f"""WITH {_EV} SELECT job_id, progress, {_SEC.format('coalesce(end_ts, last_ts)')} AS updated_at,
        CASE WHEN end_ts IS NULL AND last_ts + INTERVAL {fv.JOB_TIMEOUT_SECONDS} SECOND < (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE
          THEN 'timeout' ELSE status END AS status
      FROM states LEFT JOIN ends USING (job_id) LEFT JOIN lastp USING (job_id)""",
    "stream_throttle": f"WITH {_spaced_sql('user_id', '600 SECOND')}".replace("SELECT r.key,", "SELECT r.key AS job_id,").replace("AS row_id", "AS event_id").replace("SELECT r.key AS job_id, (SELECT min(e.ts)", "SELECT r.key, (SELECT min(e.ts)"),
    "stream_first_fetches": f"WITH {_spaced_sql(chr(39).join(['event_type || ', ':', ' || user_id']), '3600 SECOND')}".replace("AS row_id", "AS request_id"),
    "stream_leads": r"""SELECT DISTINCT md5(left(regexp_replace(lower('Firm ' || c_nationkey), '[^\pL\pN_]+', '', 'g'), 40) || ':' || lower(c_mktsegment)) AS dedup_key FROM customer""",
    "stream_contacts": f"""SELECT doc_id, 'phone' AS kind, rank, phone AS value FROM ({_P}) UNION ALL SELECT doc_id, 'email', rank, email FROM ({_E})""",
}
ORACLES["stream_late_rows"] = """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 97 = 5 THEN 3 ELSE event_id * 4 // (SELECT max(event_id) + 1 FROM events) END AS batch FROM events),
    m AS (SELECT batch, max(ts) AS newest FROM e GROUP BY batch)
  SELECT event_id, batch::BIGINT AS batch, CASE WHEN ts < (SELECT max(newest) FROM m WHERE m.batch < e.batch) - INTERVAL 10 MINUTE THEN 'late' ELSE 'in time' END AS outcome FROM e"""
ORACLES["stream_lead_jobs"] = f"""WITH {lead_plans._BASE},
  first AS (SELECT *, (task + source_rank) % 3 AS job_id, item % 2 AS arrival FROM keyed
    QUALIFY row_number() OVER (PARTITION BY (task + source_rank) % 3, dedup_key ORDER BY item % 2, source_rank, task, item) = 1)
  SELECT job_id::BIGINT AS job_id, dedup_key, source_rank::BIGINT AS source_rank, task::BIGINT AS task, item FROM first
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY arrival, source_rank, task, item) <= [{', '.join(map(str, JOB_LIMITS))}][job_id + 1]"""
ORACLES["stream_replay"] = f"""WITH {_EV}, cur AS (SELECT job_id, r AS reader, CASE WHEN r = 0 THEN -1 ELSE m END AS last_id FROM range(2) a(r),
      (SELECT job_id, floor((min(event_id) + max(event_id)) / 2)::BIGINT AS m FROM ev GROUP BY job_id)),
  unread AS (SELECT ev.*, reader, coalesce(ts > lag(ts) OVER w + INTERVAL {PATIENCE} SECOND, false) AS gap,
      coalesce(lag(event IN ({_TERMINAL})) OVER w, false) AS over FROM ev JOIN cur USING (job_id) WHERE event_id > last_id
    WINDOW w AS (PARTITION BY job_id, reader ORDER BY event_id)),
  told AS (SELECT *, min(CASE WHEN gap OR over THEN event_id END) OVER (PARTITION BY job_id, reader) AS stop FROM unread),
  heard AS (SELECT * FROM told WHERE stop IS NULL OR event_id < stop),
  last AS (SELECT * FROM heard QUALIFY row_number() OVER (PARTITION BY job_id, reader ORDER BY event_id DESC) = 1)
  SELECT job_id, reader::BIGINT AS reader, NULL::BIGINT AS event_id, 'job_update:' || status AS event FROM cur JOIN states USING (job_id)
  UNION ALL SELECT job_id, reader, event_id, event FROM heard
  UNION ALL SELECT job_id, reader, event_id, 'timeout' FROM last WHERE event NOT IN ({_TERMINAL})
    AND (stop IS NOT NULL OR ts + INTERVAL {PATIENCE} SECOND < (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE)"""
ORACLES["ingested_files"] = f"""WITH f AS (SELECT doc_id // {FILE_DOCS} AS file, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1),
    c AS (SELECT sha256(t) || '.txt' AS storage_key, strlen(t)::BIGINT AS size, file FROM f UNION ALL SELECT sha256(t) || '.txt', strlen(t), file FROM f WHERE file % 5 = 0)
  SELECT DISTINCT storage_key, size, true AS is_whole, 'stored' AS outcome FROM c WHERE size <= {FILE_BYTES}
  UNION ALL SELECT NULL, size, NULL, 'too large' FROM c WHERE size > {FILE_BYTES}"""
