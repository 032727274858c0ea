"""Writing, ingesting and streaming."""

import pytest
from pyspark.sql import functions as F

from papertrawl.operators import jobs as J
from papertrawl.session import checkpoint_root, scratch_path
from papertrawl.sources import files, rendered, sinks
from papertrawl.sources.tables import table
from papertrawl.streaming import ledger as S


def test_replacing_documents_in_the_index_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")

    def rows(*docs):
        return spark.createDataFrame([(d, i, t) for d, ts in docs for i, t in enumerate(ts)], "doc_id bigint, chunk_index int, text string")

    sinks.replace_index_partition(rows((1, ["a", "b"]), (2, ["c"]), (3, ["d"])), path, buckets=2)
    for _ in range(2):
        index = sinks.replace_index_partition(rows((1, ["new"]), (4, ["e"])), path, buckets=2)
        assert sorted((r["doc_id"], r["text"]) for r in index.collect()) == [(1, "new"), (2, "c"), (3, "d"), (4, "e")]


def test_uploads_are_stored_once(spark, tmp_path):
    for name, content in (("a.PDF", b"%PDF one"), ("b.pdf", b"%PDF one"), ("c.weird-ext", b"two"), ("d", b"three")):
        (tmp_path / name).write_bytes(content)
    uploads = files.read_uploads(spark, str(tmp_path))
    keys = {r["filename"]: r["storage_key"] for r in uploads.select("filename", "storage_key").collect()}
    assert keys["a.PDF"] == keys["b.pdf"] and keys["a.PDF"].endswith(".pdf") and keys["c.weird-ext"].endswith(".bin") and keys["d"].endswith(".bin")
    stored = uploads.filter("filename = 'd'").select("storage_key")
    assert sorted(r["filename"] for r in files.new_files(uploads, stored).collect()) == ["a.PDF", "c.weird-ext"]
    pdf = uploads.select("filename", files.is_pdf(F.lit("x"), "head").alias("pdf")).collect()
    assert {r["filename"] for r in pdf if r["pdf"]} == {"a.PDF", "b.pdf"}


def test_a_store_takes_each_content_once_and_refuses_by_length(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    (folder / "more").mkdir(parents=True)
    for name, content in (("a.PDF", b"%PDF one"), ("more/b.pdf", b"%PDF one"), ("c.txt", b"%PDF one"), ("empty.pdf", b""), ("big.pdf", b"x" * 101), ("edge.pdf", b"y" * 100)):
        (folder / name).write_bytes(content)

    def held(rows):
        return sorted((r.storage_key.split(".")[-1], bytes(r.content)) for r in rows.collect())

    for _ in range(2):
        objects, rejects = files.ingest(spark, str(folder), store, most=100)
        assert held(objects) == [("pdf", b"%PDF one"), ("pdf", b"y" * 100), ("txt", b"%PDF one")]
        assert sorted((r.filename, r.reason) for r in rejects.collect()) == [("big.pdf", "too large")]
    (folder / "late.pdf").write_bytes(b"late")
    (folder / "again.pdf").write_bytes(b"y" * 100)
    objects, rejects = files.ingest(spark, str(folder), store, most=100)
    assert len(held(objects)) == 4 and rejects.count() == 1


def test_exports_replace_themselves(spark, sf, tmp_path):
    from papertrawl.operators import statements

    results = statements.statement_results(statements.read_text(rendered.statement_text(spark, sf)))
    for _ in range(2):
        sinks.export_tables(sinks.result_tables("extraction_bank_statement", results), str(tmp_path / "out"), "csv")
    summary = spark.read.option("header", True).csv(str(tmp_path / "out" / "account_summary"))
    assert summary.count() == 12 * results.count()
    results.write.parquet(str(tmp_path / "stored"))
    sinks.reexport(spark, str(tmp_path / "stored"), "bank", str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again" / "transactions")).count() == table(spark, sf, "orders").count()
    assert set(sinks.result_tables("other", results)) == {"output"}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(checkpoint_root(spark))


def _events(spark, sf, low, high):
    return table(spark, sf, "events").filter(F.col("event_id").between(low, high))


def _as_jobs(stream):
    kind = F.col("event_type")
    return stream.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "complete").when(kind == "error", "error").otherwise("progress").alias("event"),
        F.floor(F.pmod(F.col("value"), F.lit(100.0))).cast("int").alias("progress"),
    )


def test_stream_continues_from_its_checkpoint(spark, sf, tmp_path):
    """Two runs over arriving files end in the state of one batch over all rows."""
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for low, high, name in ((0, 399, "events-1.parquet"), (400, 999, "events-2.parquet")):
        _events(spark, sf, low, high).coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / name).glob("part-*.parquet"))
        (tmp_path / "in" / name).write_bytes(part.read_bytes())
        rows = S.run_to_table(S.last_events(_as_jobs(S.read_stream(spark, folder, "events")), 7), "t", "update", state, out)
    newest = rows.groupBy("job_id").agg(F.max("batch").alias("batch"))
    got = sorted(tuple(r) for r in rows.join(newest, ["job_id", "batch"]).select("job_id", "age", "event_id").collect())
    batch = J.last_events(rendered.job_events(spark, sf), 7).select("job_id", "age", "event_id")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_silent_jobs_time_out(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "click", 5.0), (2, "2024-01-01 00:00:01", 2, "click", 5.0),
            (3, "2024-01-01 00:05:00", 2, "purchase", 5.0), (4, "2024-01-01 03:00:00", 3, "click", 7.0)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double")
    path = tmp_path / "events.parquet"
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(str(tmp_path / "w"))
    path.write_bytes(next((tmp_path / "w").glob("part-*.parquet")).read_bytes())
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    got = S.run_to_table(S.job_states(_as_jobs(S.read_stream(spark, str(tmp_path), "events"))), "t", "update", state, out)
    seen = {(r["job_id"], r["status"]) for r in got.collect()}
    assert {(1, "processing"), (2, "success"), (3, "processing")} <= seen
    assert (2, "timeout") not in seen


def _events_file(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double")
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value",
              F.lit("{}").alias("props")).coalesce(1).write.parquet(str(folder / f"w-{name}"))
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"events-{name}.parquet").write_bytes(next((folder / f"w-{name}").glob("part-*.parquet")).read_bytes())


def test_time_outs_latch_and_settled_jobs_are_forgotten(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")

    def run(name, rows):
        _events_file(spark, tmp_path, name, rows)
        stream = _as_jobs(S.read_stream(spark, str(tmp_path / "in"), "events"))
        got = S.run_to_table(S.job_states(stream, keep=7200), "t", "update", state, out).collect()
        return {(r["batch"], r["job_id"], r["status"]) for r in got}

    first = run("1", [(1, "2024-01-01 00:00:00", 1, "click", 5.0), (2, "2024-01-01 01:30:00", 2, "purchase", 5.0)])
    assert {s for _, j, s in first if j == 1} == {"processing", "timeout"}
    # a job that timed out stays so while its state is kept, late for its own time but within the watermark
    second = run("2", [(3, "2024-01-01 01:25:00", 1, "click", 6.0), (4, "2024-01-01 09:00:00", 3, "click", 5.0)])
    assert {x for x in second - first if x[1] == 1} == set()
    # two hours after its last event its state is gone: the same job number is a new job
    third = run("3", [(5, "2024-01-01 09:05:00", 1, "click", 7.0)])
    assert {s for _, j, s in third - second if j == 1} == {"processing"}


@pytest.mark.parametrize("per, want", [([], ["a0", "a2"]), (["job_id"], ["a0", "a2", "b1"])])
def test_a_job_has_leads_of_its_own(spark, per, want):
    from papertrawl.operators import leads as L

    rows = [("a", 0, 0, 0, "Acme Works", "Pune"), ("b", 1, 0, 1, "ACME works", "Pune"), ("a", 0, 0, 2, "Bolt Ltd", "Pune"),
            ("a", 0, 0, 3, "Core Ltd", "Pune")]
    leads = spark.createDataFrame(rows, "job_id string, source_rank int, task int, item int, company_name string, city string")
    kept = L.cap_leads(L.dedup_leads(leads, per), 2, per)
    assert sorted(f"{r.job_id}{r.item}" for r in kept.collect()) == want


@pytest.mark.parametrize("seconds, want", [(2, [0, 2, 4]), (3, [0, 3])])
def test_throttle_spacing(spark, tmp_path, seconds, want):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "click", 5.0) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double")
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(str(tmp_path / "w"))
    (tmp_path / "events.parquet").write_bytes(next((tmp_path / "w").glob("part-*.parquet")).read_bytes())
    passed = S.run_to_table(S.throttle(_as_jobs(S.read_stream(spark, str(tmp_path), "events")), seconds=seconds), "t")
    assert sorted(r["row_id"] for r in passed.collect()) == want


def test_submissions(spark):
    rows = [(1, 7, "h1", "fast"), (2, 7, "h1", "fast"), (3, 8, "h1", "fast"), (4, 7, "h1", "full")]
    df = spark.createDataFrame(rows, "submission_id bigint, user_id bigint, file_hash string, mode string")
    assigned = J.assign_jobs(df)
    assert {r["submission_id"]: r["job_id"] for r in assigned.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    known = spark.createDataFrame([(8, "h1:fast")], "user_id bigint, idempotency_key string")
    assert sorted(r["submission_id"] for r in J.new_jobs(assigned, known).collect()) == [1, 4]


def test_native_suppression_and_progress(spark, sf):
    from papertrawl.session import observed

    requests = S.read_stream(spark, sf, "events").select(
        F.col("event_type").alias("cache_key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    kept = S.run_to_table(S.distinct_within(requests), "native")
    kinds = table(spark, sf, "events").select("event_type").distinct()
    assert sorted(r["cache_key"] for r in kept.collect()) == sorted(r[0] for r in kinds.collect())
    df, seen = observed(kinds, "kinds")
    assert df.count() == 5 and seen.get["rows"] == 5


def test_a_document_without_chunks_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    chunk = "doc_id long, chunk_index int, text string"
    sinks.replace_index_partition(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], chunk), path, buckets=3)
    again = spark.createDataFrame([(1,), (2,)], "doc_id long")
    index = sinks.replace_index_partition(spark.createDataFrame([(2, 0, "c2")], chunk), path, buckets=3, documents=again)
    assert [(r.doc_id, r.text) for r in index.collect()] == [(2, "c2")]


def test_replay_stops_at_the_event_that_ends_a_job(spark):
    from papertrawl.operators import jobs

    events = spark.createDataFrame([(1, 1, "progress"), (1, 2, "progress"), (1, 3, "complete"), (1, 4, "progress"), (2, 5, "progress")],
                                   "job_id long, event_id long, event string")
    cursors = spark.createDataFrame([(1, 1), (2, 0)], "job_id long, last_id long")
    states = spark.createDataFrame([(1, "done"), (2, "running")], "job_id long, status string")
    rows = jobs.replay_after(events, cursors, states).filter("event_id is not null").collect()
    assert sorted(r.event_id for r in rows) == [2, 3, 5]


T0 = 1_700_000_000


def _at(spark, rows):
    """(job, event number, seconds, event) as events."""
    return spark.createDataFrame([(j, e, s, k) for j, e, s, k in rows], "job_id bigint, event_id bigint, s bigint, event string").select(
        "job_id", "event_id", F.timestamp_seconds(F.col("s") + T0).alias("ts"), "event", F.lit(5).alias("progress"))


def _arrive(spark, folder, df):
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return S.read_folder(spark, str(folder), df.schema)


@pytest.mark.parametrize("job", ["throttle", "last_events", "first_fetches", "capped_leads", "replay"])
def test_forgotten_keys_leave_no_state_and_the_query_ends(spark, tmp_path, job):
    """Many keys in the first trigger; a row of one key a day later, and none of the many is still held."""
    cursors = spark.range(60).select(F.col("id").alias("job_id"), F.lit(0).cast("bigint").alias("reader"), F.lit(-1).cast("bigint").alias("last_id"))
    made = {
        "throttle": lambda s: S.throttle(s, seconds=60), "last_events": lambda s: S.last_events(s, 5, keep=60),
        "first_fetches": lambda s: S.first_fetches(s.select(F.col("job_id").alias("cache_key"), F.col("event_id").alias("request_id"), "ts"), 60),
        "capped_leads": lambda s: S.capped_leads(s.select(
            "job_id", F.lit(3).alias("max_leads"), F.col("event").alias("company_name"), F.lit("Pune").alias("city"), "ts",
            F.lit(0).alias("source_rank"), F.lit(0).alias("task"), F.col("event_id").alias("item")), keep=60),
        "replay": lambda s: S.replay(s, cursors, 60, keep=60),
    }[job]
    seen: list = []
    first = [(j, j, j, "progress") for j in range(50)]
    for rows in (first, [(7, 60, 90_000, "progress")], [(7, 61, 180_000, "progress")], [(7, 62, 270_000, "progress")]):
        stream = _arrive(spark, tmp_path / "in", _at(spark, rows))
        S.run_to_table(made(stream), job, "update" if job == "last_events" else "append", str(tmp_path / "state"), str(tmp_path / "out"), seen)
    assert max(seen) >= 50 and seen[-1] <= 4, seen


def test_late_rows_go_to_their_own_table_once(spark, tmp_path):
    folder = str(tmp_path / "split")
    for rows in ([(1, 1, 0, "progress"), (1, 2, 5000, "progress")], [(1, 3, 100, "progress"), (1, 4, 4500, "progress"), (1, 5, 9000, "complete")],
                 [(1, 6, 4500, "progress"), (1, 7, 8500, "progress")]):
        stream = _arrive(spark, tmp_path / "in", _at(spark, rows))
        in_time, late = S.split_late(stream, folder)
        in_time, late = S.split_late(stream, folder)  # nothing new: nothing changes
    assert sorted(r.event_id for r in in_time.collect()) == [1, 2, 4, 5, 7] and sorted(r.event_id for r in late.collect()) == [3, 6]
    # a job over the rows in time drops none of them
    told = S.run_to_table(S.throttle(S.read_folder(spark, f"{folder}/in_time", in_time.schema), seconds=0), "t")
    assert sorted(r.row_id for r in told.collect()) == [1, 2, 4, 5, 7]


def test_a_lead_limit_holds_across_triggers(spark, tmp_path):
    kind = "job_id long, max_leads int, company_name string, city string, s long, source_rank int, task int, item long"
    first = [(1, 3, "Acme Works", "Pune", 0, 1, 0, 0), (1, 3, "ACME works", "Pune", 0, 0, 0, 1), (2, 1, "Acme Works", "Pune", 0, 0, 0, 2)]
    second = [(1, 3, "Acme Works", "Pune", 9, 0, 0, 0), (1, 3, "Core Ltd", "Pune", 9, 0, 2, 0), (1, 3, "Bolt Ltd", "Pune", 9, 0, 1, 0),
              (1, 3, "Dock Ltd", "Pune", 9, 0, 3, 0), (2, 1, "Bolt Ltd", "Pune", 9, 0, 0, 0), (3, 5, "Acme Works", "Goa", 9, 0, 0, 0)]
    third = [(1, 3, "Early Ltd", "Pune", 9, 0, 0, 0), (3, 5, "Acme works", "goa", 9, 0, 0, 0)]
    for rows in (first, second, third):
        leads = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds(F.col("s") + T0)).drop("s")
        out = S.run_to_table(S.capped_leads(_arrive(spark, tmp_path / "in", leads)), "t", "append", str(tmp_path / "state"), str(tmp_path / "out"))
    assert sorted((r.job_id, r.source_rank, r.task, r["item"]) for r in out.collect()) == [
        (1, 0, 0, 1), (1, 0, 1, 0), (1, 0, 2, 0), (2, 0, 0, 2), (3, 0, 0, 0)]


def test_a_replay_stopped_and_resumed_equals_one_run(spark, tmp_path):
    rows = [(1, 0, 0, "progress"), (1, 3, 30, "progress"), (1, 6, 60, "complete"), (1, 8, 61, "progress"),
            (2, 1, 1, "progress"), (2, 4, 700, "progress"), (3, 2, 2, "progress"), (3, 5, 50, "error"), (4, 7, 100_000, "progress")]
    cursors = spark.createDataFrame([(1, 0, -1), (1, 1, 3), (2, 0, -1), (3, 0, 5), (4, 0, -1)], "job_id long, reader long, last_id long")
    told = []
    for name, parts in (("one", [rows]), ("two", [sorted(rows, key=lambda r: r[1])[:4], sorted(rows, key=lambda r: r[1])[4:]])):
        for part in parts:
            stream = _arrive(spark, tmp_path / name / "in", _at(spark, part))
            out = S.run_to_table(S.replay(stream, cursors, 300), "t", "append", str(tmp_path / name / "state"), str(tmp_path / name / "out"))
        told.append(sorted((r.job_id, r.reader, r.event_id, r.event) for r in out.collect()))
    assert told[0] == told[1] == [
        (1, 0, 0, "progress"), (1, 0, 3, "progress"), (1, 0, 6, "complete"), (1, 1, 6, "complete"),
        (2, 0, 1, "progress"), (2, 0, 1, "timeout"), (4, 0, 7, "progress")]


def test_streams_read_tables_that_are_folders_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "call 9876543210"), (2, "write to desk@firm.in")], "doc_id bigint, text string")
    rows.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    found = S.run_to_table(S.ingest_contacts(S.read_stream(spark, str(tmp_path), "documents")), "contacts")
    assert sorted((r["doc_id"], r["value"]) for r in found.collect()) == [(1, "9876543210"), (2, "desk@firm.in")]


def test_texts_of_short_rows_are_rendered_in_many_tasks(spark, sf):
    for pages in (rendered.listing_pages, rendered.heading_pages, rendered.contact_pages, rendered.product_pages):
        assert pages(spark, sf).select(F.spark_partition_id()).distinct().count() == 4
