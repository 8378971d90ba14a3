"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a folder
    of its own; any other session is refused, since its executors could not
    read what the driver's machine holds.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        where = context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='docweft-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (a reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over as many tasks as shuffles have, by ``keys`` if there are any: for much work on few bytes.

    Files are split and shuffles merged by bytes, which leaves such work to few
    tasks; a stated number of partitions is not merged.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each(array: Column | str) -> Column:
    """A row for each element of an array that is computed, and one with null if it is empty.

    Of a plain explode Spark infers that the array isn't empty, and asks so where the
    array's inputs are read: all that it is made of would be computed again, once for each use.
    """
    return F.explode_outer(array)


def fixed(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns are computed once, whatever is asked of them.

    A filter on a computed column is otherwise moved to where its inputs are read, and computes them there for itself.
    """
    return rows.select(each(F.array(F.struct(*rows.columns))).alias("__row")).select("__row.*")


#: A key is hot if it holds this share of the rows, and this many at least.
HOT_SHARE, HOT_LEAST = 1000, 2000


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner", parts: int = 64) -> DataFrame:
    """``rows`` joined with ``few``, which has each key once; rows of a hot key are dealt over ``parts`` tasks by ``spread``.

    The hot keys, ``HOT_SHARE`` at most, are found by a count beforehand and
    broadcast; of ``few`` only their rows are repeated. Null keys find nothing.
    """
    total = rows.count()
    if total < HOT_LEAST:  # no key can be hot
        return rows.join(few, keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(settle(counts.where(F.col("__n") >= max(HOT_LEAST, total / HOT_SHARE)).select(*keys)).withColumn("__hot", F.lit(True)))
    zero = F.lit(0).cast("long")
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(zero)
    every = F.when(F.col("__hot"), F.sequence(zero, F.lit(parts - 1).cast("long"))).otherwise(F.array(zero))
    left = rows.join(hot, keys, "left").withColumn("__part", part).drop("__hot")
    right = few.join(hot, keys, "left").withColumn("__part", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__part"], how).drop("__part")
