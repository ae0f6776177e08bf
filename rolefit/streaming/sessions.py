"""Sessions as event tables and streams (section K)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from rolefit import refdata as R
from rolefit.sources.corpus import work_folder

ORDER = ("ts", "event_id")


# --- K2 ---------------------------------------------------------------------------------------------------------------
def session_status(events: DataFrame) -> DataFrame:
    """Latest status and time per session; on a stream, write it in update mode."""
    last = F.max_by(F.struct("status", "ts"), F.struct(*ORDER))
    return events.groupBy("session_id").agg(last.alias("s")).select(
        "session_id", F.col("s.status").alias("status"), F.col("s.ts").alias("ts"))


def run_status(stream: DataFrame) -> DataFrame:
    """Streaming form of session_status to its end. Each micro-batch in update mode is a folder of the sessions it changed, which a replay overwrites; of
    a session the row of the last batch counts."""
    out = work_folder(stream.sparkSession, "stream-status")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (session_status(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    changed = stream.sparkSession.read.parquet(out)
    return changed.groupBy("session_id").agg(F.max_by(F.struct("status", "ts"), "batch").alias("s")).select("session_id", "s.status", "s.ts")


def bad_transitions(events: DataFrame) -> DataFrame:
    """Events that optimise a session whose state then is neither analysed nor optimised.

    Failed events change no state. Sessions are cut into hours: the state is carried inside an hour first and then from
    hour to hour over one row each, so a very busy session is spread over tasks.
    """
    state = F.when(F.col("status") != "failed", F.col("status"))
    hourly = events.withColumn("hour", F.date_trunc("hour", "ts")).withColumn("state", state)
    inside = Window.partitionBy("session_id", "hour").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("session_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    closing = (hourly.groupBy("session_id", "hour").agg(F.max_by("state", F.when(state.isNotNull(), F.struct(*ORDER))).alias("closing"))
               .withColumn("carried", F.last("closing", ignorenulls=True).over(across)).drop("closing"))
    marked = hourly.withColumn("here", F.last("state", ignorenulls=True).over(inside)).filter("status = 'optimized'")
    before = F.coalesce("here", "carried")
    return (marked.join(closing, ["session_id", "hour"]).withColumn("state_before", before)
            .filter(~F.coalesce(F.col("state_before").isin("analyzed", "optimized"), F.lit(False)))
            .select("event_id", "session_id", "ts", "state_before"))


# --- K3 ---------------------------------------------------------------------------------------------------------------
def session_expiry(events: DataFrame) -> DataFrame:
    """(session_id, created, expired_at): the first hourly sweep at which a session is older than its life time.

    Age counts from creation, the first event of the session.
    """
    # whole hours since a fixed moment, so that the result does not depend on the time zone of the session
    origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    age_limit = F.timestamp_diff("SECOND", origin, F.col("created")) + R.SESSION_TTL_SECONDS
    hours = (F.floor(age_limit / R.SWEEP_SECONDS) + 1).cast("int")
    sweep = (origin + F.make_dt_interval(F.lit(0), hours)).cast(events.schema["ts"].dataType)
    return events.groupBy("session_id").agg(F.min("ts").alias("created")).select(
        "session_id", "created", sweep.alias("expired_at"))


def expired_at(events: DataFrame, now) -> DataFrame:
    """Sessions already older than the life time at a given moment."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    return (events.groupBy("session_id").agg(F.min("ts").alias("created"))
            .filter(age > F.lit(R.SESSION_TTL_SECONDS) * F.lit(1_000_000)))


EXPIRY_SCHEMA = StructType([StructField("session_id", LongType()), StructField("created", TimestampType())])


def expiry_processor(mark_seconds: int) -> StatefulProcessor:
    """A processor of groups of sessions that emits a session once the watermark has passed its creation by the life time, and never again.

    The state of a group is one packed table of (session, creation, expired), so a call costs one read and one write whatever the number of sessions in it, and
    one timer stands for the next of them that is due. An expired session leaves a mark for mark_seconds of event time, so that what comes for it later does not
    start it anew. Built inside a function so that it reaches the executors by value.
    """
    ttl_ms, mark_ms = R.SESSION_TTL_SECONDS * 1000, mark_seconds * 1000
    state_schema, row_schema = "sessions binary, due_ms long", EXPIRY_SCHEMA
    packed = [("session_id", "<i8"), ("created_ms", "<i8"), ("expired", "?"), ("unnamed", "?")]  # unnamed: events without a session are one

    class Expiry(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.sessions = handle.getValueState("sessions", state_schema)

        def read(self) -> tuple[np.ndarray, int | None]:
            if not self.sessions.exists():
                return np.empty(0, packed), None
            held, due = self.sessions.get()
            return np.frombuffer(bytes(held), packed), int(due)

        def keep(self, table: np.ndarray, due: int | None) -> None:
            """Store the table and let the timer stand for the first moment at which one of its sessions is due."""
            if due is not None:
                self.handle.deleteTimer(due)
            if not len(table):
                self.sessions.clear()
                return
            first = int((table["created_ms"] + ttl_ms + np.where(table["expired"], mark_ms, 0)).min())
            self.sessions.update((table.tobytes(), first))
            self.handle.registerTimer(first)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held, due = self.read()
            parts = [held]
            for batch in rows:
                first = batch[batch["ts"].notna()].groupby(["unnamed", "session_id"])["ts"].min()
                new = np.zeros(len(first), packed)
                for column in ("unnamed", "session_id"):
                    new[column] = first.index.get_level_values(column).to_numpy()
                new["created_ms"] = first.to_numpy().astype("datetime64[ms]").astype("i8")
                parts.append(new)
            every = np.concatenate(parts)
            # of a session the row that is known to be expired counts, else the earliest
            every = every[np.lexsort((every["created_ms"], ~every["expired"], every["session_id"], every["unnamed"]))]
            named = every[["session_id", "unnamed"]]
            self.keep(every[np.concatenate([[True], named[1:] != named[:-1]])] if len(every) else every, due)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            table, due = self.read()
            table, now = table.copy(), timerValues.getCurrentWatermarkInMs()
            out = table[~table["expired"] & (table["created_ms"] + ttl_ms <= now)]
            table["expired"] |= table["created_ms"] + ttl_ms <= now
            self.keep(table[~table["expired"] | (table["created_ms"] + ttl_ms + mark_ms > now)], due)
            ids = pd.arrays.IntegerArray(out["session_id"].astype("i8"), out["unnamed"].copy())
            yield pd.DataFrame({"session_id": ids, "created": pd.to_datetime(out["created_ms"], unit="ms")})

        def close(self) -> None:
            pass

    return Expiry(), row_schema


def stream_expiry(events: DataFrame, lateness: str = "1 hour", mark_seconds: int = R.EXPIRED_MARK_SECONDS, groups: int = 1024) -> DataFrame:
    """Streaming form of session_expiry; needs the RocksDB state store provider. Sessions are dealt into groups by hash: Python is called once per group and
    micro-batch, not once per session."""
    processor, schema = expiry_processor(mark_seconds)
    timed = events.select(F.pmod(F.xxhash64("session_id"), F.lit(groups)).alias("part"), F.coalesce("session_id", F.lit(0)).cast("long").alias("session_id"),
                          F.col("session_id").isNull().alias("unnamed"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return timed.groupBy("part").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


# --- K4 ---------------------------------------------------------------------------------------------------------------
def once_only(events: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The analyse events that need computing: the first of every session, unless the session is in the done table."""
    wanted = events.filter("status = 'analyzed'")
    if done is not None:
        wanted = wanted.join(done.select("session_id"), "session_id", "left_anti")
    first = F.min(F.struct(*ORDER))
    return wanted.groupBy("session_id").agg(first.alias("f")).select("session_id", "f.event_id", "f.ts")


def stream_once_only(events: DataFrame, memory: str = "24 hours") -> DataFrame:
    """Streaming form: within the watermark only the first analyse event of a session passes."""
    timed = events.filter("status = 'analyzed'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", memory)
    return timed.dropDuplicatesWithinWatermark(["session_id"])


def run_once_only(stream: DataFrame, done: str | None = None) -> DataFrame:
    """Streaming form of once_only without a horizon, run over what is there now: a table of done sessions, which every micro-batch is checked against and
    extends, so that a session that comes back after days is still known. Returns that table (session_id, event_id, ts).

    done is its folder, kept from run to run together with the checkpoint beside it; a new one by default. A replayed batch sees the batches before it only and
    overwrites its own part.
    """
    spark = stream.sparkSession
    done = done or work_folder(spark, "done-sessions")
    columns = stream.select("session_id", "event_id", "ts").schema
    with_batch = StructType([*columns.fields, StructField("batch", LongType())])
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{done}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = batch.sparkSession.read.schema(with_batch).parquet(done)
        once_only(batch, earlier.filter(F.col("batch") < batch_id)).write.mode("overwrite").parquet(f"{done}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{done}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(done).drop("batch")


# --- K1 ---------------------------------------------------------------------------------------------------------------
def stream_score(resume_stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving resumes with a batch job and append the result.

    Each micro-batch goes to its own folder and is overwritten when it is replayed, so a restart writes nothing twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the scoring job reads the batch several times
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return (resume_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a parquet table in the shared folder and read it back."""
    out = work_folder(stream.sparkSession, label)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
