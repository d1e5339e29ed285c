"""Structured Streaming jobs over navigation events.

Every job is written once as a DataFrame function that works on a batch or a
streaming DataFrame; the ``run_*`` helpers run the streaming form from a file
source with ``trigger(availableNow=True)`` into a folder under the session's
``spark.checkpoint.dir`` (shared storage on a cluster) that holds its table and its
checkpoint: run again with the same folder, a job resumes where it stopped.

Event mapping of the driver's ``events`` table: error → blocked,
view → scanned, purchase → safe, click → redirect, signup → feedback; a page
view is (user_id, calendar day).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookline import constants as K
from hookline.operators import rules as R
from hookline.session import checkpoint_dir

EVENT_KINDS = {"error": "blocked", "view": "scanned", "purchase": "safe", "click": "redirect", "signup": "feedback"}
EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def with_kind(events: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for k, v in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    return events.withColumns({"kind": kind, "day": F.to_date("ts")})


# ------------------------------------------------------------- operators

def running_stats(events: DataFrame) -> DataFrame:
    """O2: blocked / scanned / safe counters per user."""
    e = with_kind(events)
    return e.groupBy("user_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("blocked", "scanned", "safe")]
    )


def report_counts(events: DataFrame) -> DataFrame:
    """Events per reported type."""
    return with_kind(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def feedback_records(events: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """O5 input: feedback events as (url, user_label, model_pred)."""
    e = with_kind(events).where(F.col("kind") == "feedback")
    e = attach_urls(e, pages, n_pages)
    classes = F.array(*[F.lit(c) for c in K.CLASSES])
    return e.select(
        "event_id", "ts", "url",
        F.element_at(classes, (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int")).alias("user_label"),
        F.when(F.pmod(F.col("event_id"), F.lit(5)) != 0,
               F.element_at(classes, (F.pmod(F.floor(F.col("event_id") / 4), F.lit(4)) + 1).cast("int"))).alias("model_pred"),
    )


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Running count of feedback, by user label (and agreement with the model)."""
    return feedback.groupBy("user_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("user_label") == F.col("model_pred"), 1)).alias("agrees"),
    )


def redirect_alerts(events: DataFrame) -> DataFrame:
    """O3 (batch): every redirect after the third within a page view raises an
    alert carrying its running count.

    The running count is a position inside the page view.  Rows are
    range-partitioned by (user, day, ts, event_id); a small table of
    (page view, partition) counts gives each partition its offset within the
    page view by running sum, and rows are numbered only inside their
    partition — a page view with a third of all events is split over tasks."""
    from hookline.session import materialize, parallelism

    e = with_kind(events).where(F.col("kind") == "redirect").select("user_id", "day", "event_id", "ts")
    r = materialize(
        e.repartitionByRange(parallelism(events.sparkSession), "user_id", "day", "ts", "event_id").withColumn(
            "pid", F.spark_partition_id()
        )
    )
    counts = r.groupBy("user_id", "day", "pid").agg(F.count(F.lit(1)).alias("pn"))
    offsets = counts.select(
        "user_id", "day", "pid",
        F.coalesce(
            F.sum("pn").over(Window.partitionBy("user_id", "day").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("off"),
    )
    w = Window.partitionBy("user_id", "day", "pid").orderBy("ts", "event_id")
    numbered = r.withColumn("_n", F.row_number().over(w)).join(offsets, ["user_id", "day", "pid"])
    return (
        numbered.withColumn("redirect_count", (F.col("off") + F.col("_n")).cast("int"))
        .where(F.col("redirect_count") > K.REDIRECT_ALERT_AFTER)
        .select("user_id", "day", "event_id", "ts", "redirect_count")
    )


def warning_dwell(events: DataFrame) -> DataFrame:
    """Time on the warning page — from a blocked event to the user's
    next event of the same page view, in milliseconds.

    Events are range-partitioned by (user, day, ts, event_id) and ``lead``
    runs inside each partition; the last event of a page view in a partition
    takes the first event of the page view's next partition from a small
    (page view, partition) table, so no page view is gathered into one task."""
    from hookline.session import materialize, parallelism

    e = with_kind(events).select("user_id", "day", "event_id", "ts", "kind")
    r = materialize(
        e.repartitionByRange(parallelism(events.sparkSession), "user_id", "day", "ts", "event_id").withColumn(
            "pid", F.spark_partition_id()
        )
    )
    firsts = r.groupBy("user_id", "day", "pid").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    nxt_part = firsts.select(
        "user_id", "day", "pid",
        F.lead(F.col("first.ts")).over(Window.partitionBy("user_id", "day").orderBy("pid")).alias("next_part_ts"),
    )
    w = Window.partitionBy("user_id", "day", "pid").orderBy("ts", "event_id")
    x = r.withColumn("next_ts", F.lead("ts").over(w)).where(F.col("kind") == "blocked")
    x = x.join(nxt_part, ["user_id", "day", "pid"], "left").withColumn(
        "next_ts", F.coalesce(F.col("next_ts"), F.col("next_part_ts"))
    )
    return x.where(F.col("next_ts").isNotNull()).select(
        "user_id", "day", "event_id",
        ((F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000)
        .cast("long").alias("dwell_ms"),
    )


def attach_urls(events: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """The URL of each event: page ``event_id % n_pages`` (stream-static join)."""
    p = pages.select(F.col("page_id").alias("_pid"), "url")
    return events.withColumn("_pid", F.pmod(F.col("event_id"), F.lit(n_pages))).join(p, "_pid").drop("_pid")


def navigation_decisions(events: DataFrame, pages: DataFrame, n_pages: int, threats: DataFrame) -> DataFrame:
    """O1 + O7: per navigation event: threat-list match, risk score and the
    decision (works on a stream: stream-static joins only)."""
    e = attach_urls(with_kind(events), pages, n_pages)
    e = e.withColumn("resource_type", F.when(F.col("kind") == "feedback", F.lit("xhr")).otherwise(F.lit("main_frame")))
    x = R.threat_match(e, threats, "url", "threat")
    x = x.withColumn("risk", R.quick_risk_score(F.col("url")))
    d = R.navigation_decision(F.col("resource_type"), F.col("known_threat"), F.col("risk"))
    return x.select(
        "event_id", "user_id", "url", "resource_type", "known_threat", F.round("risk", 9).alias("risk"),
        d["action"].alias("action"), d["reason"].alias("reason"),
    )


# ------------------------------------------------------------- stream runners

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table (a file or a folder of part files) as a file
    stream, one file per micro-batch.  (As a pattern, since a stream's plain path
    has to be a folder.)"""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job's table and checkpoint.  A job that is to resume
    after a restart passes the same folder again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def _run(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Append the rows of a stream to ``folder/out`` (exactly once) and return the table."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    q = q.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key's last micro-batch in a table partitioned by ``batch``."""
    last = table.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return table.join(last, [*keys, "batch"]).drop("batch")


def run_upsert(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream in update mode: each micro-batch writes the rows
    that changed (a repeated batch overwrites its own folder), and a reader takes
    the last row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _run(stream, folder, write, "update")
    spark = stream.sparkSession
    table = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]))
    return latest(table.parquet(f"{folder}/out"), keys)


def run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], schema: T.StructType) -> DataFrame:
    """Apply a batch function to every micro-batch and return the table of all results."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _run(stream, folder, write, "append")
    table = stream.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return table.parquet(f"{folder}/out").drop("batch")


PAGE_VIEW = ["user_id", "day"]


def run_page_views(stream: DataFrame, folder: str, keep: Callable[[DataFrame], DataFrame],
                   step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """O3, O6 as streams: results that depend on the order of a page view's events.

    Files may come late, so a micro-batch stores its own events, by day, and computes
    anew the page views that it touches, from the stored events of their days alone; the
    last result of a page view counts.  The order of the files doesn't matter, and no
    state lives in memory.  ``keep`` selects and prunes events, ``step`` is the batch
    operator."""
    spark = stream.sparkSession
    events = f"{folder}/events"

    def write(batch: DataFrame, number: int) -> None:
        rows = with_kind(keep(batch)).withColumn("on_day", F.col("day").cast("string")).drop("kind", "day")
        rows.write.mode("overwrite").partitionBy("on_day").parquet(f"{events}/batch={number}")
        stored = spark.read.schema(EVENT_SCHEMA + ", batch long, on_day string").parquet(events)
        now = with_kind(stored.where(F.col("batch") == number))
        days = [r.on_day for r in now.where("on_day IS NOT NULL").select("on_day").distinct().collect()]  # folder names
        # Later batches of a job that is run again are not there yet.
        seen = with_kind(stored.where((F.col("batch") <= number) & F.col("on_day").isin(days)))
        touched = seen.join(now.select(*PAGE_VIEW).distinct(), PAGE_VIEW, "left_semi").drop("batch", "kind", "day", "on_day")
        step(touched).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _run(stream, folder, write, "append")
    empty = step(spark.createDataFrame([], EVENT_SCHEMA)).schema
    table = spark.read.schema(T.StructType([*empty.fields, T.StructField("batch", T.LongType())]))
    return latest(table.parquet(f"{folder}/out"), PAGE_VIEW)


def only(kind: str | None) -> Callable[[DataFrame], DataFrame]:
    """Events of one kind (or all), with the columns of the table."""
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return lambda events: (with_kind(events).where(F.col("kind") == kind) if kind else events).select(*columns)
