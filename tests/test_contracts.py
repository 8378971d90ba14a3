"""JSON laid over JSON against a recursive merge, and contracts of models."""

import json
import random

from docweft.operators import contracts


def merge(base, overlay):
    if isinstance(base, dict) and isinstance(overlay, dict):
        return {k: merge(base[k], overlay[k]) if k in base and k in overlay else overlay.get(k, base.get(k)) if k in overlay else base[k] for k in base | overlay}
    return overlay


def some(rng, depth):
    if depth and rng.random() < 0.7:
        return {rng.choice(["a", "b", "c.d", "e'f", "", "ü\"x"]): some(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([None, True, 1, -2.5, "text", "{not an object}", "", [], [1, {"a": None}], {}])


def test_against_a_recursive_merge(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(150):
        texts = [some(rng, 4) for _ in range(rng.randint(1, 4))]
        ranks = rng.sample(range(9), len(texts))
        rows += [(i, r, " " + json.dumps(x, ensure_ascii=rng.random() < 0.5)) for r, x in zip(ranks, texts, strict=True)] + [(i, 10, None)]
        merged = None
        for k, (_, x) in enumerate(sorted(zip(ranks, texts, strict=True), key=lambda p: p[0])):
            merged = x if k == 0 else merge(merged, x)
        want[i] = merged
    rows += [(900, 1, "{"), (900, 2, "{}"), (901, 1, None)]
    good, bad = contracts.deep_merge(spark.createDataFrame(rows, "id long, rank int, json string"))
    got = {r.id: json.loads(r.json) for r in good.collect()}
    assert got == want and [tuple(r) for r in bad.collect()] == [(900, "malformed JSON")]
    good, bad = contracts.deep_merge(spark.createDataFrame([], "id long, rank int, json string"))
    assert good.count() == bad.count() == 0


def test_contracts(spark):
    models = spark.createDataFrame([(k, "text", "schema", "out") for k in range(9)], "id long, input_text_name string, input_schema_name string, output_json_name string")
    whole = {"runtime_contract": "tokenized", "tokenizer_path": "t.json", "max_length": 5, "inputs": {"input_ids": "i"}, "outputs": {"start_probs": "s", "end_probs": "e"}}
    sources = [
        (1, contracts.SIDECAR, json.dumps({"input_text_name": "side", "output_json_name": "side"})), (1, contracts.EMBEDDED, json.dumps({"input_text_name": "own", "protocol_version": "1"})),
        (2, contracts.SIDECAR, json.dumps(whole)), (2, contracts.EMBEDDED, json.dumps({"inputs": {"attention_mask": "m"}, "decode_strategy": "uie_span"})),
        (3, contracts.EMBEDDED, json.dumps({"protocol_version": "2"})), (4, contracts.EMBEDDED, json.dumps(whole | {"max_length": 0})), (5, contracts.EMBEDDED, "[1]"),
        (6, contracts.SIDECAR, "{"), (7, contracts.SIDECAR, json.dumps({"runtime_contract": "other"})), (8, contracts.SIDECAR, json.dumps({k: v for k, v in whole.items() if k != "outputs"})),
    ]
    good, bad = contracts.resolve_contracts(models, spark.createDataFrame(sources, "id long, rank int, json string"))
    got = {r.id: r for r in good.collect()}
    assert [(got[k].runtime_contract, got[k].input_text_name, got[k].output_json_name) for k in (0, 1, 2)] == [("string_io", "text", "out"), ("string_io", "own", "side"), ("tokenized", "text", "out")]
    assert (got[2].inputs.input_ids, got[2].inputs.attention_mask, got[2].outputs.end_probs, got[2].max_length, got[2].decode_strategy) == ("i", "m", "e", 5, "uie_span") and got[1].inputs is None
    assert {r.id: r.error for r in bad.collect()} == {
        3: "unsupported ONNX model spec protocol_version `2`, expected `1`", 4: "tokenized ONNX model spec requires `max_length > 0`", 5: "failed to parse ONNX model spec",
        6: "malformed JSON", 7: "failed to parse ONNX model spec", 8: "tokenized ONNX model spec requires `outputs`",
    }
