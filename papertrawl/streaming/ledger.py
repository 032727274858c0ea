"""Streaming jobs: event states, buffers, throttling, cache windows, lead limits, replays, continuous ingestion.

State per key is a handful of values and ends with event time: every handler has one timer per key on the watermark,
after which the key is forgotten. A trigger's rows of one key reach its handler together; the size of a trigger is set
at the source (maxFilesPerTrigger, maxOffsetsPerTrigger). Handlers that depend on order keep only the sorted times of
those rows, or the best few; the others fold row by row and take the rows in any order. Rows behind the watermark never
reach a handler: split_late() sets them aside in a table of their own first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.operators.directory import contacts
from papertrawl.operators.leads import ARRIVAL
from papertrawl.session import scratch_path, ship_with_tasks, with_local_timers
from papertrawl.sources.tables import SCHEMAS

ship_with_tasks(__name__)

# plain values travel with the handlers; the module they come from need not be on the executors
TERMINAL = tuple(fv.TERMINAL_EVENTS)

#: How long the state of a settled job stays, and how far behind the newest row a row may come.
KEEP_SECONDS, DELAY = 86_400, "10 minutes"

EVENT = "job_id bigint, event_id bigint, ts timestamp, event string, progress int"


def read_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of one table as they arrive; a table is files in the folder, or a folder of files."""
    return (
        spark.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder.rstrip('/')}/{table}*.parquet")
    )


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Files of a folder as they arrive; all that are there when a run starts make one trigger."""
    return spark.readStream.schema(schema).parquet(folder)


def _times(pdf: pd.DataFrame) -> list:
    return [t.to_pydatetime() for t in pdf["ts"]]


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class Expiring(StatefulProcessor):
    """A handler with one timer per key, on event time."""

    handle: StatefulProcessorHandle

    def wake(self, since, seconds: float, timerValues) -> None:
        """The key's one timer, so many seconds after the given time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentWatermarkInMs()
        if now >= 0:
            self.handle.registerTimer(max(_millis(since) + int(seconds * 1000), now + 1))

    def close(self) -> None:
        pass


class LastEvents(Expiring):
    """Keeps the newest n events of a job, `keep` seconds past the last; emits the buffer after each trigger."""

    def __init__(self, n: int, keep: float) -> None:
        self.n, self.keep = n, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts timestamp, event_id bigint, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        heapq.heapify(newest)
        for pdf in rows:
            for row in zip(_times(pdf), pdf["event_id"].tolist(), pdf["event"]):
                (heapq.heappush if len(newest) < self.n else heapq.heappushpop)(newest, row)
        newest.sort(reverse=True)
        self.kept.put(newest)
        self.wake(newest[0][0], self.keep, timerValues)
        yield pd.DataFrame({
            "job_id": [key[0]] * len(newest), "age": range(1, len(newest) + 1),
            "event_id": [r[1] for r in newest], "event": [r[2] for r in newest],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())


class Spaced(Expiring):
    """Passes a row of a key when at least `gap` seconds have gone by since the last row it passed.

    A key is forgotten once the watermark is a gap past that row: rows still to come pass anyway.
    """

    def __init__(self, gap: float, id_column: str) -> None:
        self.gap, self.id_column = gap, id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([p[["ts", self.id_column]] for p in rows]).sort_values(["ts", self.id_column])
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for ts, row_id in zip(_times(arrived), arrived[self.id_column].tolist()):
            if last is None or (ts - last).total_seconds() >= self.gap:
                passed.append((ts, row_id))
                last = ts
        if passed:
            self.last.update((last,))
            self.wake(last, self.gap, timerValues)
        yield pd.DataFrame({
            "key": [str(key[0])] * len(passed), "row_id": [p[1] for p in passed], "ts": [p[0] for p in passed],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


class CappedLeads(Expiring):
    """A job's first leads per dedup key, up to its limit, in order of arrival across triggers.

    State is the keys kept so far: at most the limit. A job that is full, or silent for `keep` seconds, holds none: a
    full one only its number.
    """

    def __init__(self, order: list[str], keep: float) -> None:
        self.order, self.keep = order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "dedup_key string", "kept boolean")
        self.kept = handle.getValueState("kept", "leads bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()[0] if self.kept.exists() else 0
        limit, latest, firsts = 0, None, {}
        for pdf in rows:  # of each new key the first lead; only as many as there is room for
            limit, stamp = int(pdf["max_leads"].max()), pdf["ts"].max()
            latest = stamp if latest is None else max(latest, stamp)
            places = list(zip(*[pdf[c].tolist() for c in self.order], strict=True))
            for i in sorted(range(len(pdf)), key=places.__getitem__):
                k = pdf["dedup_key"].iat[i]
                if k in firsts and firsts[k] <= places[i] or kept >= limit or self.seen.containsKey((k,)):
                    continue
                firsts[k] = places[i]
            if len(firsts) > 2 * (limit - kept) > 0:
                firsts = dict(sorted(firsts.items(), key=lambda x: x[1])[:limit - kept])
        chosen = sorted(firsts.items(), key=lambda x: x[1])[:max(0, limit - kept)]
        kept += len(chosen)
        if kept >= limit:
            self.seen.clear()
        else:
            for k, _ in chosen:
                self.seen.updateValue((k,), (True,))
        self.kept.update((kept,))
        self.wake(latest, self.keep, timerValues)
        columns = {c: [place[i] for _, place in chosen] for i, c in enumerate(self.order)}
        yield pd.DataFrame({"job_id": [key[0]] * len(chosen), "dedup_key": pd.Series([k for k, _ in chosen], dtype=object), **columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.kept.clear()
        return iter(())


class Replay(Expiring):
    """What a reader of a job is told: later events in order, up to the one that ends the job, or a time-out.

    A reader gives up when the next event is more than `seconds` after the last it was told, or when the watermark says
    that nothing sooner can come; so what it is told does not depend on how events fall into triggers.
    """

    def __init__(self, seconds: float, keep: float) -> None:
        self.seconds, self.keep = seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "last_id bigint, ts timestamp, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_id, last_ts, ended = tuple(self.told.get()) if self.told.exists() else (-1, None, False)
        if ended:
            return
        unread = sorted((eid, ts, event) for pdf in rows for ts, eid, event in zip(_times(pdf), pdf["event_id"].tolist(), pdf["event"])
                        if eid > last_id)
        out = []
        for eid, ts, event in unread:
            if last_ts is not None and (ts - last_ts).total_seconds() > self.seconds:
                out.append((last_id, "timeout"))
                ended = True
                break
            out.append((eid, event))
            last_id, last_ts = eid, ts if last_ts is None else max(ts, last_ts)
            if event in TERMINAL:
                ended = True
                break
        if out:
            self.told.update((last_id, last_ts, ended))
            self.wake(last_ts, self.keep if ended else self.seconds, timerValues)
        yield pd.DataFrame({"job_id": [key[0]] * len(out), "reader": [key[1]] * len(out), "event_id": [e for e, _ in out],
                            "event": pd.Series([e for _, e in out], dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_id, last_ts, ended = tuple(self.told.get())
        if ended:
            self.told.clear()
            return
        self.told.update((last_id, last_ts, True))
        self.wake(last_ts, self.seconds + self.keep, timerValues)
        yield pd.DataFrame({"job_id": [key[0]], "reader": [key[1]], "event_id": [last_id], "event": ["timeout"]})


class JobState(Expiring):
    """Status of a job; the first terminal event or time-out latches it. Jobs silent for too long time out.

    A settled job's state is cleared `keep` seconds of event time after its last event.
    """

    def __init__(self, seconds: int, keep: int) -> None:
        self.seconds, self.keep = seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "seen", "last_ts timestamp, last_id bigint, progress int, end_ts timestamp, end_id bigint, end string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.seen.get()) if self.seen.exists() else (None, None, 0, None, None, None)
        if old[5] == "timeout":
            return
        last, progress, end = old[:2], old[2], old[3:]
        for pdf in rows:
            for ts, eid, event, pct in zip(_times(pdf), pdf["event_id"].tolist(), pdf["event"], pdf["progress"].tolist()):
                if event in TERMINAL:
                    if end[0] is None or (ts, eid) < end[:2]:
                        end = (ts, eid, event)
                elif last[0] is None or (ts, eid) > last:
                    last, progress = (ts, eid), pct
        self.seen.update((*last, progress, *end))
        self.wake(max(t for t in (last[0], end[0]) if t), self.keep if end[0] else self.seconds, timerValues)
        status = {"complete": "success", "error": "failed", None: "processing"}[end[2]]
        yield self._row(key, status, 100 if status == "success" else progress, end[0] or last[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = tuple(self.seen.get())
        if old[5]:  # settled long ago
            self.seen.clear()
            return
        self.seen.update((*old[:3], old[0], old[1], "timeout"))
        self.wake(old[0], self.keep, timerValues)
        yield self._row(key, "timeout", old[2], old[0])

    @staticmethod
    def _row(key, status, progress, ts) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [int(progress)], "updated_at": [ts]})


def last_events(events: DataFrame, n: int = fv.EVENTS_KEPT, delay: str = DELAY, keep: float = KEEP_SECONDS) -> DataFrame:
    """The buffer of a job's newest events; a job's buffer is forgotten `keep` seconds of event time after the last."""
    return events.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        LastEvents(n, keep), "job_id bigint, age int, event_id bigint, event string", "Update", "EventTime"
    )


def job_states(events: DataFrame, seconds: int = fv.JOB_TIMEOUT_SECONDS, delay: str = DELAY,
               keep: int = KEEP_SECONDS) -> DataFrame:
    """Status changes per job, with time-outs driven by event time."""
    return events.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        JobState(seconds, keep), "job_id bigint, status string, progress int, updated_at timestamp", "Update", "EventTime"
    )


def throttle(events: DataFrame, key: str = "job_id", row_id: str = "event_id", seconds: int = fv.THROTTLE_SECONDS,
             delay: str = DELAY) -> DataFrame:
    """At most one event per job every two seconds."""
    return events.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        Spaced(seconds, row_id), "key string, row_id bigint, ts timestamp", "Append", "EventTime"
    )


def first_fetches(requests: DataFrame, seconds: int = fv.CACHE_SECONDS, delay: str = DELAY) -> DataFrame:
    """Requests (cache_key, request_id, ts) that are not answered by a result fetched within the last hour."""
    return requests.withWatermark("ts", delay).groupBy("cache_key").transformWithStateInPandas(
        Spaced(seconds, "request_id"), "key string, row_id bigint, ts timestamp", "Append", "EventTime"
    )


def distinct_within(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The native form: a key is suppressed for at least the delay after it was last let through."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["cache_key"])


def distinct_leads(leads: DataFrame, per: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """First arrival per name and city, of every job if `per` names its columns.

    With a delay, leads carry `ts`, and a key is forgotten once the watermark is that far past it; without, it stays.
    """
    keyed, keys = leads.withColumn("dedup_key", C.dedup_key("company_name", "city")), [*per, "dedup_key"]
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if delay else keyed.dropDuplicates(keys)


def capped_leads(leads: DataFrame, delay: str = DELAY, keep: float = KEEP_SECONDS) -> DataFrame:
    """First arrival per job, name and city, and no more per job than its limit: job_id, dedup_key and its place.

    leads: job_id, max_leads, company_name, city, ts and the columns of ARRIVAL. Leads of one trigger count in the
    order of arrival, those of earlier triggers first. The handler reads a job's rows batch by batch and holds no
    more than twice as many as there is room for.
    """
    keyed = leads.withColumn("dedup_key", C.dedup_key("company_name", "city")).select(
        "job_id", "dedup_key", F.col("max_leads").cast("bigint").alias("max_leads"), "ts",
        *[F.col(c).cast("bigint").alias(c) for c in ARRIVAL])
    places = ", ".join(f"{c} bigint" for c in ARRIVAL)
    return keyed.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        CappedLeads(ARRIVAL, keep), f"job_id bigint, dedup_key string, {places}", "Append", "EventTime")


def replay(events: DataFrame, cursors: DataFrame, seconds: int = fv.JOB_TIMEOUT_SECONDS, delay: str = DELAY,
           keep: float = KEEP_SECONDS) -> DataFrame:
    """What every reader (job_id, reader, last_id) is told of the events to come: a join of the stream with the table
    of cursors, then one state per reader. A stopped run goes on where its checkpoint stands.
    """
    unread = events.withWatermark("ts", delay).join(cursors, "job_id").filter("event_id > last_id")
    return unread.select("job_id", "reader", "event_id", "ts", "event").groupBy("job_id", "reader").transformWithStateInPandas(
        Replay(seconds, keep), "job_id bigint, reader bigint, event_id bigint, event string", "Append", "EventTime")


def connected(cursors: DataFrame, states: DataFrame) -> DataFrame:
    """The state of its job that every reader is told first."""
    return cursors.join(states, "job_id").select(
        "job_id", "reader", F.lit(None).cast("bigint").alias("event_id"), F.concat(F.lit("job_update:"), "status").alias("event"))


def split_late(stream: DataFrame, folder: str, delay: str = DELAY, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows, as two tables below the folder: the first is what a job with state should stream.

    A row is late if its time is more than the delay behind the newest row of earlier triggers, which is the
    watermark a job over the first table has at most; so none of its rows is dropped there. Rows without a time are late.
    Each trigger writes folders of its own, which a repeated trigger overwrites, so every row is kept exactly once.
    """
    spark = stream.sparkSession
    kinds = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    marks = f"{folder}/marks"

    def save(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read three times
        try:
            held.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
            before = spark.read.schema("newest timestamp, batch bigint").parquet(marks).filter(F.col("batch") < batch_id)
            limit = before.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("limit"))
            judged = held.crossJoin(F.broadcast(limit)).withColumn(  # limit: one row
                "late", F.col(time).isNull() | F.coalesce(F.col(time) < F.col("limit"), F.lit(False))).drop("limit")
            for name, late in (("in_time", False), ("late", True)):
                judged.filter(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return tuple(spark.read.schema(kinds).parquet(f"{folder}/{name}") for name in ("in_time", "late"))


def ingest_contacts(documents: DataFrame) -> DataFrame:
    """Contacts of documents as they arrive; stateless."""
    return contacts(documents, "doc_id", "text")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, target: str | None = None,
                 seen: list | None = None) -> DataFrame:
    """Process everything available, then read what was written.

    A checkpoint and target given again continue where the last run stopped. seen: gets the number of state rows after
    every trigger.
    """
    spark = with_local_timers(stream.sparkSession)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    target = target or scratch_path(spark, f"{name}-out")

    def save(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if seen is not None:
        seen += [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
