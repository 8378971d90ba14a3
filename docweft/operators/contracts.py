"""JSON texts laid over one another, level by level, and model contracts resolved from what embeds, accompanies and configures a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.shared import settle

#: Levels of objects inside objects that are merged; what lies deeper is an error.
DEEPEST = 64


def _members(json: Column) -> Column:
    """The members of a JSON object, each as JSON text; null for anything else."""
    held = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    return F.when(json.startswith("{"), F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json"))))


def _last_objects(values: Column) -> Column:
    """Of values in the order in which they are laid over one another, those that count: the objects behind the last value that is none, or that value."""
    is_object = lambda v: v["json"].startswith("{")
    plain = F.array_max(F.transform(values, lambda v, i: F.when(is_object(v), F.lit(-1)).otherwise(i)))
    return F.when(plain == F.size(values) - 1, F.slice(values, -1, 1)).otherwise(F.slice(values, plain + 2, F.size(values)))


def deep_merge(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, json) of JSON texts (id, rank, json) laid over one another in the order of their ranks, and (id, error).

    Members of objects merge, and everything else is replaced by what is laid
    over it; a null value counts as a value, a null text as none. Members come out in the
    order of their keys. An id of which a text isn't JSON has an error instead.
    """
    told = settle(sources.where(F.col("json").isNotNull()).select("id", "rank", T.utrim(F.col("json")).alias("json"), F.try_parse_json("json").alias("v")))
    # an SQL null stands for what can't be parsed; a JSON null is a variant
    bad = told.where(F.col("v").isNull()).select("id", F.lit("malformed JSON").alias("error")).distinct()
    good = told.join(bad.select("id"), "id", "left_anti").select("id", "rank", F.array().cast("array<string>").alias("path"), F.to_json("v").alias("json"))
    good = good.withColumn("json", F.coalesce("json", F.lit("null")))
    levels, leaves = [], None
    rows = good
    while True:
        values = F.sort_array(F.collect_list(F.struct("rank", "json")))
        held = settle(rows.groupBy("id", "path").agg(values.alias("values")).select("id", "path", _last_objects(F.col("values")).alias("values")))
        is_object = F.get("values", 0)["json"].startswith("{")
        empty = is_object & F.forall("values", lambda v: F.size(_members(v["json"])) == 0)
        done = held.where(~is_object | empty).select("id", "path", F.when(empty, F.lit("{}")).otherwise(F.get("values", 0)["json"]).alias("json"))
        leaves = done if leaves is None else leaves.unionByName(done)
        inner = held.where(is_object & ~empty)
        if inner.isEmpty():
            break
        levels.append(len(levels))
        if len(levels) > DEEPEST:
            raise ValueError("objects lie too deep inside one another")
        members = inner.select("id", "path", F.explode("values").alias("v")).select("id", "path", "v.rank", F.explode(_members(F.col("v.json"))).alias("m"))
        rows = members.select("id", "rank", F.array_append("path", F.col("m.key")).alias("path"), "m.json")
    out = leaves
    for depth in reversed(levels):
        # members a level below this one are whole; they are put into the objects that hold them
        deeper = F.size("path") == depth + 1
        pair = F.struct(F.element_at("path", -1).alias("key"), "json")
        made = out.where(deeper).groupBy("id", F.slice("path", F.lit(1), F.lit(depth)).alias("path")).agg(F.sort_array(F.collect_list(pair)).alias("m"))
        text = F.array_join(F.transform("m", lambda m: F.concat(T.string_json(m["key"]), F.lit(":"), m["json"])), ",")
        out = out.where(~deeper).unionByName(made.select("id", "path", F.concat(F.lit("{"), text, F.lit("}")).alias("json")))
    return out.select("id", "json"), bad


CONTRACT = (
    "protocol_version string, runtime_contract string, decode_strategy string, input_text_name string, input_schema_name string, output_json_name string, tokenizer_path string, max_length bigint, "
    "inputs struct<input_ids:string,attention_mask:string,token_type_ids:string>, outputs struct<start_probs:string,end_probs:string>"
)
#: What a model's file embeds is laid over what accompanies it.
SIDECAR, EMBEDDED = 1, 2


def resolve_contracts(models: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts of models (id, input_text_name, input_schema_name, output_json_name: what is configured), and (id, error).

    ``sources`` (id, rank, json) are the models' specifications: SIDECAR and
    EMBEDDED. What neither tells is as configured; a model without any exchanges strings.
    """
    merged, bad = deep_merge(sources)
    spec = F.from_json("json", CONTRACT)
    rows = models.join(merged, "id", "left").withColumn("s", spec)
    s = F.col("s")
    kind = F.coalesce(s["runtime_contract"], F.lit("string_io"))
    none = F.col("json").isNull()
    tokenized = kind == "tokenized"
    error = (
        F.when(none, F.lit(None).cast("string"))
        .when(~F.col("json").startswith("{"), "failed to parse ONNX model spec")
        .when(F.coalesce(s["protocol_version"], F.lit("1")) != "1", F.concat(F.lit("unsupported ONNX model spec protocol_version `"), s["protocol_version"], F.lit("`, expected `1`")))
        .when(~kind.isin("string_io", "tokenized") | ~F.coalesce(s["decode_strategy"], F.lit("json_string_scalar")).isin("json_string_scalar", "uie_span"), "failed to parse ONNX model spec")
        .when(tokenized & s["tokenizer_path"].isNull(), "tokenized ONNX model spec requires `tokenizer_path`")
        .when(tokenized & ~F.coalesce(s["max_length"] > 0, F.lit(False)), "tokenized ONNX model spec requires `max_length > 0`")
        .when(tokenized & s["inputs"].isNull(), "tokenized ONNX model spec requires `inputs`")
        .when(tokenized & s["outputs"].isNull(), "tokenized ONNX model spec requires `outputs`")
    )
    judged = rows.join(bad.withColumnRenamed("error", "unread"), "id", "left").withColumn("error", F.coalesce("unread", error))
    names = [F.coalesce(s[n], F.col(n)).alias(n) for n in ("input_text_name", "input_schema_name", "output_json_name")]
    own = lambda n: F.when(tokenized, s[n]).alias(n)
    good = judged.where("error is null").select(
        "id", kind.alias("runtime_contract"), F.coalesce(s["decode_strategy"], F.lit("json_string_scalar")).alias("decode_strategy"), *names, own("tokenizer_path"), own("max_length"), own("inputs"), own("outputs")
    )
    return good, judged.where("error is not null").select("id", "error")
