"""Event-time streams over the events table, and the job state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which state may follow which. Fixed values.
TRANSITIONS = {
    "QUEUED": ("FETCHING", "FAILED"), "FETCHING": ("PREPROCESSING", "PARTIAL", "FAILED"), "PARTIAL": ("PREPROCESSING", "FAILED"), "PREPROCESSING": ("RECONSTRUCTING", "FAILED"),
    "RECONSTRUCTING": ("ANALYZING", "FAILED"), "ANALYZING": ("COMPLETED", "FAILED"), "COMPLETED": (), "FAILED": (),
}


def stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files at `path`, with ts as a timestamp."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) by event time; events later than the watermark are dropped from closed windows."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    by = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with no longer pause than `gap`."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    by = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def job_states(changes: DataFrame) -> DataFrame:
    """(job_id, state, n_illegal): each job's last legal state after its changes (job_id, seq, state) in order; a change that may not
    follow the state is ignored and counted."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    ordered = changes.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "state"))).alias("steps"))
    start = F.struct(F.lit("QUEUED").alias("state"), F.lit(0).alias("bad"), allowed.alias("next"))

    def step(s, x):
        ok = F.array_contains(F.element_at(s["next"], s["state"]), x["state"])
        return F.struct(F.when(ok, x["state"]).otherwise(s["state"]).alias("state"), F.when(ok, s["bad"]).otherwise(s["bad"] + 1).alias("bad"), s["next"].alias("next"))

    done = ordered.withColumn("r", F.aggregate("steps", start, step))
    return done.select("job_id", F.col("r.state").alias("state"), F.col("r.bad").cast("bigint").alias("n_illegal"))
