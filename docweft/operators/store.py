"""Task and cache tables as DataFrames: latest rows, cache keys, hits and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.shared import settle, spread_join


def cache_key(*parts: Column) -> Column:
    """A digest of what a request asks for. Nulls count."""
    named = F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def lookups(requests: DataFrame, key: str, order: list) -> DataFrame:
    """Requests with the number of lookups of their key before them (``hit_count``); 0 is a miss.

    Counted in two levels: rows are dealt out by ranges of key and order, so a
    key that very many rows share lies in as many parts as its rows need; rows
    are numbered inside a part, and the counts of a key's earlier parts are added.
    """
    placed = settle(requests.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.sum("__n").over(earlier)).where(F.col("__before") > 0).drop("__n")
    inside = Window.partitionBy(key, "__part").orderBy(*order)
    numbered = placed.withColumn("__own", F.row_number().over(inside)).join(offsets, [key, "__part"], "left")
    hits = (F.col("__own") - 1 + F.coalesce("__before", F.lit(0))).cast("int")
    return numbered.withColumn("hit_count", hits).drop("__own", "__before", "__part")


def split_by_cache(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests with the cached columns, and requests that the cache lacks."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: one pass with partial aggregation, no window over a hot key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r")).select(key, "__r.*")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(table.unionByName(changes), key, order)


def task_status(asked: DataFrame, tasks: DataFrame) -> DataFrame:
    """Status of each asked task_id; not_found for those unknown."""
    return asked.join(tasks, "task_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


CACHE = "cache_key string, fields string, raw_text string, created_at_ms bigint, last_accessed_at_ms bigint, hit_count bigint"


def probe(requests: DataFrame, cache: DataFrame | None, order: list) -> DataFrame:
    """``requests`` (doc_id, cache_key) with ``nth``, the lookups of the key before (those the cache counted too), and ``known``.

    The first request of an unknown key is the only miss; all others are hits of what it stores.
    """
    rows = lookups(requests, "cache_key", order)
    if cache is None:
        return rows.withColumns({"known": F.lit(False), "nth": F.col("hit_count").cast("bigint")}).drop("hit_count")
    stored = cache.select("cache_key", F.col("hit_count").alias("__hits"))
    rows = spread_join(rows, stored, ["cache_key"], order, how="left").withColumn("known", F.col("__hits").isNotNull())
    return rows.withColumn("nth", F.col("hit_count").cast("bigint") + F.when(F.col("known"), F.col("__hits") + 1).otherwise(0)).drop("hit_count", "__hits")


def updated_cache(cache: DataFrame | None, stored: DataFrame, probed: DataFrame, now_ms: int) -> DataFrame:
    """The cache after a batch: what it held, what misses stored, and the lookups of both counted."""
    new = stored.withColumns({"created_at_ms": F.lit(now_ms).cast("bigint"), "last_accessed_at_ms": F.lit(now_ms).cast("bigint"), "hit_count": F.lit(0).cast("bigint")})
    rows = new if cache is None else cache.unionByName(new)
    asked = probed.groupBy("cache_key").agg(F.max("nth").alias("__n"))
    hit = F.coalesce(F.col("__n") > F.col("hit_count"), F.lit(False))
    out = rows.join(asked, "cache_key", "left")
    return out.withColumns({"last_accessed_at_ms": F.when(hit, F.lit(now_ms)).otherwise(F.col("last_accessed_at_ms")), "hit_count": F.greatest("hit_count", "__n")}).drop("__n")
