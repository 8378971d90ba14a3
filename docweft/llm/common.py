"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.shared import fresh_dir, settle, shared_dir

__all__ = ["alone", "bind", "fresh_dir", "hot_keys", "hot_least", "marked", "salted_join", "settle", "shared_dir", "table", "text_or_empty", "unused", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder, for tables that are read by column."""
    where = fresh_dir(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: The table that the operator now at work has filled in this Python worker.
_FILLED: list[dict] = []


def alone(table: dict) -> None:
    """Empties the table that another operator has left in this Python worker, which serves one after another."""
    if not _FILLED or _FILLED[0] is not table:
        for other in _FILLED:
            other.clear()
        _FILLED[:] = [table]


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the variable of a one-element array stands for it."""
    return F.get(F.transform(F.array(value), use), 0)


#: A key is hot if it holds this share of the rows or more; there are at most as many hot keys.
HOT_SHARE = 1000
#: Fewer rows than this are never hot.
HOT_LEAST = 2000


def hot_least(rows: DataFrame) -> float:
    """The least number of rows of a hot key of ``rows``."""
    return max(HOT_LEAST, rows.count() / HOT_SHARE)


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of ``rows`` (settled rows, since they are read here and again later): ``HOT_SHARE`` at most."""
    counts = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return settle(counts.where(F.col("__n") >= hot_least(rows)).select(*keys))


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` on ``keys``, the rows of a hot key spread over ``salts`` parts by ``spread``.

    Only the hot keys are broadcast, ``HOT_SHARE`` rows at most, and only the
    rows of ``few`` that have a hot key are repeated.
    """
    mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(mark, keys, "left").withColumn("__salt", salt).drop("__hot")
    right = few.join(mark, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` lacks, in upper case and lower."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"__own{k}" for k in range(n + len(taken))) if name not in taken][:n]


#: Bits of :func:`marked`, in pieces of Spark's bitmap functions: 8 MB at most.
FILTER_BITS = 1 << 26


def marked(rows: DataFrame, key: Column, ids: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a column ``mark``, true for every row whose ``key`` (a long) is in ``ids`` (one column of longs) and for few others.

    A bitmap of fixed size is broadcast, so rows that are not looked for need no shuffle; a full bitmap costs room, not results.
    """
    piece, own, bits, byte, at, place = unused(rows, 6)
    bit_of = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    known = ids.toDF("id").where("id is not null").select(bit_of(F.col("id")).alias("at"))
    known = known.groupBy(F.bitmap_bucket_number("at").alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits))
    placed = rows.withColumn(place, F.when(key.isNotNull(), bit_of(key))).withColumns({at: F.bitmap_bit_position(place), own: F.bitmap_bucket_number(place)})
    held = placed.join(F.broadcast(known), F.col(own) == F.col(piece), "left")
    held = held.withColumn(byte, F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"))
    bit = F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1")
    return held.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(bit == 1, F.lit(False)).alias(mark))


def text_or_empty(name: str) -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
