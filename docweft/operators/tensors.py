"""Outputs of span models: tensors of a batch cut into rows, joined with the windows they answer, and decoded into spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.shared import settle
from docweft.operators.aggregates import spans


def largest_output(outputs: DataFrame, key: str, position: str) -> DataFrame:
    """Of the tensors (values, shape) of a key the one of the most values; of equals the last by position."""
    best = F.max_by(F.struct("values", "shape"), F.struct(F.size("values"), position))
    return outputs.groupBy(key).agg(best.alias("__t")).select(key, "__t.values", "__t.shape")


def batch_shape(shape: Column) -> Column:
    """Batch size and length of a tensor of rows: of no, one or two sizes, or of three of which the last or the middle one is 1; null for others."""
    n, at = F.size(shape), lambda i: F.get(shape, i)
    both = lambda b, s: F.struct(b.cast("int").alias("batch"), s.cast("int").alias("length"))
    one = F.lit(1)
    return (
        F.when(n == 0, both(one, one))
        .when(n == 1, both(one, at(0)))
        .when((n == 2) | ((n == 3) & (at(2) == 1)), both(at(0), at(1)))
        .when((n == 3) & (at(1) == 1), both(at(0), at(2)))
    )


def shape_error(values: Column, shape: Column) -> Column:
    """Why a tensor can't be cut into rows; null if it can."""
    told = F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ", "), F.lit("]"))
    dims = batch_shape(shape)
    size = dims["batch"].cast("long") * dims["length"]
    return F.when(shape.isNull() | values.isNull(), "output was not returned").when(
        dims.isNull(), F.concat(F.lit("unsupported UIE output tensor rank `"), F.size(shape).cast("string"), F.lit("` with shape "), told)
    ).when(size != F.size(values), F.concat(F.lit("UIE output tensor shape "), told, F.lit(" expects "), size.cast("string"), F.lit(" values, got "), F.size(values).cast("string")))


def join_plans(outputs: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``plans`` (doc_id, plan_no from 0, ...) with the rows of their batch (start_probs, end_probs), and (doc_id, error).

    ``outputs`` has a row for each batch: doc_id, start_values, start_shape, end_values, end_shape. Row k of
    a batch answers plan k, so a batch of another size than there are plans is an error, as is a document without an output.
    """
    counted = plans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__plans"))
    rows = counted.join(outputs, "doc_id", "full")
    start, end = batch_shape(F.col("start_shape")), batch_shape(F.col("end_shape"))
    n = F.coalesce("__plans", F.lit(0))
    sizes = F.concat(*(x for name, v in (("start=", start["batch"]), (", end=", end["batch"]), (", plans=", n)) for x in (F.lit(name), v.cast("string"))))
    mismatch = F.when((start["batch"] != n) | (end["batch"] != n), F.concat(F.lit("UIE output batch size mismatch: "), sizes))
    error = F.coalesce(shape_error(F.col("start_values"), F.col("start_shape")), shape_error(F.col("end_values"), F.col("end_shape")), mismatch)
    judged = settle(rows.withColumns({"error": error, "__s": start["length"], "__e": end["length"]}))
    cut = lambda values, size: lambda k: F.slice(values, k * F.col(size) + 1, F.col(size))
    numbers = F.sequence(F.lit(0), F.col("__plans").cast("int") - 1)
    both = F.transform(numbers, lambda k: F.struct(k.alias("plan_no"), cut("start_values", "__s")(k).alias("start_probs"), cut("end_values", "__e")(k).alias("end_probs")))
    answered = judged.where("error is null").select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.*")
    return plans.join(answered, ["doc_id", "plan_no"]), judged.where("error is not null").select("doc_id", "error")


def decode_spans(answered: DataFrame, least: float = 0.5, reach: int = 32, top: int = 8) -> DataFrame:
    """doc_id, path, start_char, end_char, confidence of the ``top`` spans of each window.

    ``answered`` are plans with their rows: doc_id, plan_no, path, start_probs,
    end_probs and offsets, for each token the characters (start_char, end_char) it
    stands for, null for tokens of the prompt. A span ends behind where it begins.
    """
    tokens = F.filter(
        F.transform(
            "offsets", lambda o, i: F.struct(i.cast("int").alias("i"), o["start_char"].alias("a"), o["end_char"].alias("z"), F.get("start_probs", i).cast("double").alias("s"), F.get("end_probs", i).cast("double").alias("e"))
        ),
        lambda t: t["a"].isNotNull() & t["z"].isNotNull(),
    )
    rows = answered.select(F.struct("doc_id", "plan_no", "path").alias("window"), F.explode(tokens).alias("t")).select("window", "t.*")
    found = spans(rows, "window", "i", "s", "e", least, reach, top, chars=("a", "z"))
    return found.select("window.doc_id", "window.path", F.col("start_char"), F.col("end_char"), F.col("confidence").cast("float").alias("confidence"))
