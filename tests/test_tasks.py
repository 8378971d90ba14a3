"""Streams of requests and normalized documents: one log, a cache over batches, repeated batches, and a log that ends."""

import json
import threading
import time

import pytest

from docweft.operators import store
from docweft.schema import FieldSpec, SchemaSpec
from docweft.streaming import tasks

SCHEMA = SchemaSpec("s", "1", (FieldSpec("a"),))


def ask(inbox, name, *requests):
    inbox.mkdir(exist_ok=True)
    (inbox / name).write_text("\n".join(json.dumps(r) for r in requests))


def test_cache_over_batches_and_repeated_batches(spark, tmp_path, monkeypatch):
    """Four batches with every other version of the cache whole; then the last batch once more, as after a failure."""
    monkeypatch.setattr(tasks, "COMPACT", 2)
    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    said = lambda i, text: {"task_id": i, "mode": "async", "kind": "text", "content": text}
    batches = [[said("1", "a: x"), said("2", "a: y")], [said("3", "a: x")], [said("4", "a: z")], [said("5", "a: x"), said("6", "a: y"), said("7", " ")]]
    for k, rows in enumerate(batches):
        ask(inbox, f"{k}.json", *rows)
        tasks.run_tasks(spark, f"file://{inbox}", out, SCHEMA).awaitTermination()
    want = {"1": None, "2": None, "3": 1, "4": None, "5": 2, "6": 1, "7": "content is required"}

    def check():
        state = {r.task_id: r for r in tasks.tasks(spark, out).collect()}
        for task_id, hits in want.items():
            r = state[task_id]
            assert r.status == ("failed" if task_id == "7" else "succeeded") and r.cached == isinstance(hits, int)
            assert r.message == hits if hits is None or task_id == "7" else r.message.startswith(f"cache hit (hit_count={hits}, ")
        log = tasks.events(spark, out)
        assert {r.task_id: json.loads(r.payload)["hit_count"] for r in log.where("event_type = 'cache.hit'").collect()} == {"3": 1, "5": 2, "6": 1}
        for r in log.groupBy("task_id").agg({"sequence": "max", "*": "count"}).collect():
            assert r["max(sequence)"] == r["count(1)"]
        left = tasks.cache_before(spark, out, "inline", 99)
        assert sorted((json.loads(r.fields)[0]["value_json"], r.hit_count) for r in left.collect()) == [('"x"', 2), ('"y"', 1), ('"z"', 0)]

    check()
    # the driver is lost before it notes that the batch is done: the batch comes again, under its old number
    (tmp_path / "out/checkpoint/inline/commits/3").unlink()
    for crc in (tmp_path / "out/checkpoint/inline/commits").glob(".3*"):
        crc.unlink()
    tasks.run_tasks(spark, f"file://{inbox}", out, SCHEMA).awaitTermination()
    check()


def test_two_streams_one_log(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    ask(tmp_path / "in", "1.json", {"task_id": "i", "kind": "text", "content": "a: x"})
    page = {"page_no": 1, "blocks": [{"page_no": 1, "text": "a: y"}]}
    ask(tmp_path / "docs", "1.json", {"task_id": "n", "protocol_version": "1", "pages": [page]}, {"task_id": "bad", "pages": [page]}, {"task_id": "m", "mode": "now", "protocol_version": "1", "pages": [page]})
    tasks.run_tasks(spark, f"file://{tmp_path}/in", out, SCHEMA).awaitTermination()
    tasks.run_normalized_tasks(spark, f"file://{tmp_path}/docs", out, SCHEMA).awaitTermination()
    state = {r.task_id: (r.status, r.message, r.fields and json.loads(r.fields)[0]["value_json"]) for r in tasks.tasks(spark, out).collect()}
    assert state == {
        "i": ("succeeded", None, '"x"'), "n": ("succeeded", None, '"y"'), "bad": ("failed", "protocol_version or sdk_version is required", None), "m": ("failed", "mode must be sync or async", None),
    }
    first = {r.task_id: json.loads(r.payload) for r in tasks.events(spark, out).where("sequence = 1").collect()}
    assert first["i"] == {"mode": "async", "ingest_mode": "parsed"} and first["n"] == first["m"] == {"mode": "async", "ingest_mode": "normalized"}


def test_a_log_that_ends(spark, tmp_path):
    """A reader that begins when half of a task's events are there gets each once, in order, and stops at the last."""
    out = f"file://{tmp_path}/out"
    columns = "task_id string, event_type string, stage string, payload string, sequence int, created_at_ms bigint"

    def write(batch, *rows):
        spark.createDataFrame([(t, e, None, "{}", n, n) for t, n, e in rows], columns).write.mode("overwrite").parquet(f"{out}/events/source=inline/batch={batch}")

    write(0, ("t", 1, "task.accepted"), ("u", 1, "task.accepted"), ("u", 2, "failed"))
    write(1, ("t", 2, "stage.changed"))

    def later():
        time.sleep(2)
        write(2, ("t", 3, "result.snapshot"), ("v", 1, "completed"))
        time.sleep(1)
        write(3, ("t", 4, "completed"))
        write(4, ("w", 1, "task.accepted"))

    writer = threading.Thread(target=later)
    writer.start()
    got = tasks.follow(spark, out, "t", f"file://{tmp_path}/reader")
    writer.join()
    assert [(r.sequence, r.event_type) for r in got.collect()] == [(1, "task.accepted"), (2, "stage.changed"), (3, "result.snapshot"), (4, "completed")]
    done = tasks.follow(spark, out, "u", f"file://{tmp_path}/second")
    assert [r.event_type for r in done.collect()] == ["task.accepted", "failed"]
    with pytest.raises(tasks.UnknownTask):
        tasks.follow(spark, out, "x", f"file://{tmp_path}/third")
    with pytest.raises(TimeoutError):
        tasks.follow(spark, out, "w", f"file://{tmp_path}/fourth", patience_s=3)


def test_counts_of_a_hot_key(spark):
    """Half of all rows have one key; numbers are as if one window counted them, and no task gets them all."""
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key")).repartition(7)
    got = store.lookups(rows, "key", ["id"])
    assert got.where("key = 'hot'").agg(F.count("*"), F.count_distinct("hit_count"), F.max("hit_count")).first() == (50_000, 50_000, 49_999)
    assert got.where("key = 'hot' and hit_count <> id / 2").count() == 0 and got.where("key <> 'hot' and hit_count <> 0").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = store.lookups(rows, "key", ["id"]).where("key = 'hot'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1
