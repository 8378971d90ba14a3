"""Asynchronous tasks: file streams of requests, a task table, an event log and a cache that outlives a batch.

Two streams feed one log: inline requests and normalized documents. A batch
writes what it makes into folders of its source and number, so a batch that is
run again replaces what it wrote before. The cache is a table of versions: batch
n reads what the batches before it left and writes version n, which holds the
keys it asked for, or every ``COMPACT`` batches all keys; it never reads its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import store
from docweft.operators.assemble import NORMALIZED, blocks_of
from docweft.operators.incremental import ACCEPTED, TERMINAL, failure_events, sequenced
from docweft.plans import engine
from docweft.schema import SchemaSpec
from docweft.sources.ingest import REQUEST, input_error, mode_error

EVENTS = "task_id string, event_type string, stage string, payload string, sequence int, created_at_ms bigint, source string, batch bigint"
TASKS = "task_id string, fields string, status string, message string, cached boolean, step int, updated_at_ms bigint, source string, batch bigint"
#: A version of the cache is whole every so many batches.
COMPACT = 20


def request_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_at_once).json(path)


def normalized_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Normalized documents with a task_id, a JSON line each."""
    return spark.readStream.schema("task_id string, mode string, " + NORMALIZED).option("maxFilesPerTrigger", files_at_once).json(path)


def cache_before(spark: SparkSession, out: str, source: str, number: int) -> DataFrame | None:
    """The cache as the batches before ``number`` left it; None if there were none."""
    try:
        versions = spark.read.schema(store.CACHE + ", whole boolean, version bigint").parquet(f"{out}/cache/{source}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    earlier = versions.where(F.col("version") < number)
    # folder names alone tell of both
    last = earlier.where("whole").agg(F.max("version")).first()[0]
    if last is None:
        return None
    return store.latest(earlier.where(F.col("version") >= last), "cache_key", ["version"]).drop("version", "whole")


def _keep_cache(after: DataFrame, asked: DataFrame, out: str, source: str, number: int, first: bool) -> None:
    whole = first or number % COMPACT == 0
    rows = after if whole else after.join(asked.select("cache_key").distinct(), "cache_key", "left_semi")
    # a batch that comes again finds the same earlier versions, so it writes the same kind into the same place
    rows.write.mode("overwrite").parquet(f"{out}/cache/{source}/version={number}/whole={str(whole).lower()}")


def _run(stream: DataFrame, out: str, source: str, prepare: Callable[[DataFrame], DataFrame], schema: SchemaSpec, config: engine.EngineConfig, normalized: bool):
    spark = stream.sparkSession

    def batch(requests: DataFrame, number: int) -> None:
        now = int(time.time() * 1000)
        rows = prepare(requests)
        refused = rows.where(F.col("__error").isNotNull())
        cache = cache_before(spark, out, source, number)
        done = engine.run_batch(rows.where(F.col("__error").isNull()).drop("__error", "mode"), schema, config, cache=cache, mode="async", normalized=normalized, now_ms=now)
        lost = refused.select("doc_id", F.col("__error").alias("error"))
        none = F.lit(None).cast("string")
        state = done.tasks.select("task_id", F.to_json("fields").alias("fields"), "status", "message", "cached").unionByName(
            lost.select(F.col("doc_id").alias("task_id"), none.alias("fields"), F.lit("failed").alias("status"), F.col("error").alias("message"), F.lit(False).alias("cached"))
        )
        queued = rows.select(F.col("doc_id").alias("task_id"), none.alias("fields"), F.lit("queued").alias("status"), F.lit(ACCEPTED).alias("message"), F.lit(False).alias("cached"), F.lit(0).alias("step"))
        tasks = queued.unionByName(state.withColumn("step", F.lit(1))).withColumn("updated_at_ms", F.lit(now).cast("bigint"))
        _keep_cache(done.cache, done.asked, out, source, number, cache is None)
        tasks.write.mode("overwrite").parquet(f"{out}/tasks/source={source}/batch={number}")
        events = done.events.unionByName(sequenced(failure_events(lost, "async", normalized)).withColumn("created_at_ms", F.lit(now).cast("bigint")))
        events.write.mode("overwrite").parquet(f"{out}/events/source={source}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint/{source}").trigger(availableNow=True).start()


def run_tasks(spark: SparkSession, inbox: str, out: str, schema: SchemaSpec, config: engine.EngineConfig = engine.EngineConfig(), files_at_once: int = 100):
    """A query that extracts every inline request below ``inbox``, for as long as files arrive, then ends."""

    def prepare(requests: DataFrame) -> DataFrame:
        refused = F.coalesce(mode_error(F.col("mode")), input_error(F.col("kind"), F.col("content"), F.col("url")))
        return requests.select(
            F.col("task_id").alias("doc_id"), "mode", F.col("kind").alias("source_type"), F.col("content").alias("text"), "url", "file_name", "mime_type", refused.alias("__error")
        )

    return _run(request_stream(spark, inbox, files_at_once), out, "inline", prepare, schema, config, False)


def run_normalized_tasks(spark: SparkSession, inbox: str, out: str, schema: SchemaSpec, config: engine.EngineConfig = engine.EngineConfig(), files_at_once: int = 100):
    """As :func:`run_tasks`, for normalized documents; the same tasks and events take both."""

    def prepare(documents: DataFrame) -> DataFrame:
        return documents.withColumnRenamed("task_id", "doc_id").withColumn("__error", mode_error(F.col("mode")))

    return _run(normalized_stream(spark, inbox, files_at_once), out, "normalized", prepare, schema, config, True)


def tasks(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each task."""
    rows = spark.read.schema(TASKS).parquet(f"{out}/tasks")
    return store.latest(rows, "task_id", ["updated_at_ms", "step", "batch", "source"])


def events(spark: SparkSession, out: str, live: bool = False) -> DataFrame:
    """All events so far, or with ``live`` the history and what follows as a stream."""
    reader = (spark.readStream if live else spark.read).schema(EVENTS)
    return reader.parquet(f"{out}/events")


def ended(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_type").isin(*TERMINAL)).select("task_id").distinct()


class UnknownTask(KeyError):
    """A task that no event tells of."""


def follow(spark: SparkSession, out: str, task_id: str, into: str, patience_s: float = 60.0, pause_s: float = 0.2) -> DataFrame:
    """A task's events, those so far and those to come, until its last one.

    History and tail are one stream over the log's files, each of which is read
    once, so no event is missed or repeated, whenever the reader begins; what it
    has passed on lies below ``into``, a folder for each batch. Raises UnknownTask
    at once if no event tells of the task, TimeoutError if its last event
    doesn't come within ``patience_s`` seconds.
    """
    if known(spark.createDataFrame([(task_id,)], "task_id string"), events(spark, out)).isEmpty():
        raise UnknownTask(task_id)
    finished = False

    def batch(log: DataFrame, number: int) -> None:
        nonlocal finished
        log.where(F.col("task_id") == task_id).drop("source", "batch").write.mode("overwrite").parquet(f"{into}/events/part={number}")
        finished = finished or not ended(spark.read.parquet(f"{into}/events/part={number}")).isEmpty()

    query = events(spark, out, live=True).writeStream.foreachBatch(batch).option("checkpointLocation", f"{into}/checkpoint").start()
    deadline = time.monotonic() + patience_s
    try:
        while not finished:
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > deadline:
                raise TimeoutError(f"task {task_id} goes on")
            query.awaitTermination(pause_s)
    finally:
        query.stop()
    return spark.read.parquet(f"{into}/events").drop("part").orderBy("sequence")


def block_count(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(blocks_of(F.col("pages"))).alias("blocks"))


def known(asked: DataFrame, log: DataFrame) -> DataFrame:
    """The asked task_id that have events."""
    return asked.join(log.select("task_id").distinct(), "task_id", "left_semi")
