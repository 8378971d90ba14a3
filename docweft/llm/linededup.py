"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space (blank, tab to carriage return)
at its ends, A-Z in lower case; keys of fewer code points than ``least_chars``
don't count. The index holds, in the shared folder:

* ``postings``: which document holds which key, a row each;
* ``counts``: for each key the exact number of documents that hold it, and the largest of their ids;
* ``filters``: for each shard of the keys a cuckoo filter of those that ``least_docs`` documents or more hold.

``insert`` adds documents and ``delete`` takes documents out again; both write
a new layer and never change an older one, so a call that is repeated after a
failure replaces its own unfinished layer, and ``clean`` follows the documents
that are in the index: a line that was dropped comes back when the documents
that made it common are deleted.

``clean`` drops every line whose key is common from all documents but the one
of the largest id that holds it. Lines are dealt to the shards of their keys;
there the filter passes few of them, and these are looked up in the exact
counts. Keys that very many documents hold are few (``hot_keys``) and are
looked up before the deal, so no shard gets more than its share.

Defined results: null and empty texts are one empty line; rows without a
doc_id keep all lines and count for nothing; rows of one doc_id are one
document, each row keeping its own text; repeated rows are repeated in the
result; an empty table gives an empty result; no column but doc_id and the
text is looked at, and all columns are returned as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import HOT_LEAST, HOT_SHARE, bind, fresh_dir, unused
from docweft.llm.cuckoo import Cuckoo

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]
POSTINGS = "k1 long, k2 long, doc_id long"
COUNTS = "k1 long, k2 long, refs long, top long, layer int"
FILTERS = "shard long, cells binary, stash binary, layer int"
#: Postings that a shard has on average, and the least number of shards.
SHARD_ROWS, LEAST_SHARDS = 200_000, 1024


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is the faster of the two and the same where all characters are ASCII
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def digests(key: Column) -> list[Column]:
    """A key as 128 bits."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(13), key).alias("k2")]


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(shards).cast("long"))


def _update(key, changes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The filter of a shard after keys became common (up) or ceased to be."""
    first, second, up = changes["k1"].to_numpy(np.int64), changes["k2"].to_numpy(np.int64), changes["up"].to_numpy(bool)
    cells = Cuckoo.from_bytes(held["cells"].iloc[0], held["stash"].iloc[0]) if len(held) else Cuckoo.sized(int(up.sum()))
    cells.remove(first[~up], second[~up])
    cells.insert(first[up], second[up])
    table, stash = cells.to_bytes()
    return pd.DataFrame({"shard": [key[0]], "cells": [table], "stash": [stash]})


def _rebuild(key, keys: pd.DataFrame) -> pd.DataFrame:
    cells = Cuckoo.sized(len(keys))
    cells.insert(keys["k1"].to_numpy(np.int64), keys["k2"].to_numpy(np.int64))
    table, stash = cells.to_bytes()
    return pd.DataFrame({"shard": [key[0]], "cells": [table], "stash": [stash]})


def _look_up(key, lines: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The lines of a shard that go: those the filter passes, if the exact counts confirm them."""
    if key[0] < 0:
        return lines.loc[lines["doc_id"] != lines["hot_top"], ["doc_id", "text_hash", "at"]]
    filters = state[state["cells"].notna()]
    none = lines.iloc[:0][["doc_id", "text_hash", "at"]]
    if not len(lines) or not len(filters):
        return none
    cells = Cuckoo.from_bytes(filters["cells"].iloc[0], filters["stash"].iloc[0])
    passed = lines[cells.holds(lines["k1"].to_numpy(np.int64), lines["k2"].to_numpy(np.int64))]
    exact = state.loc[state["cells"].isna(), [*KEY, "top"]]
    found = passed.merge(exact, on=KEY)
    return found.loc[found["doc_id"] != found["top"], ["doc_id", "text_hash", "at"]]


class LineIndex:
    """The index of lines in a folder below the shared one."""

    def __init__(self, spark: SparkSession, path: str | None = None, least_chars: int = 20, least_docs: int = 3, shards: int | None = None):
        self.spark = spark
        self.path = path or fresh_dir(spark, "lines")
        self.least_chars, self.least_docs, self.shards = least_chars, least_docs, shards
        self.layer = 0

    @staticmethod
    def open(spark: SparkSession, path: str) -> LineIndex:
        """The index that a folder holds, as its last finished layer left it."""
        last = spark.read.schema("layer int, shards int, least_chars int, least_docs int").parquet(f"{path}/done").orderBy(F.desc("layer")).first()
        index = LineIndex(spark, path, last.least_chars, last.least_docs, last.shards)
        index.layer = last.layer
        return index

    # ---- what is stored ----

    def _write(self, name: str, rows: DataFrame, layer: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}-{layer}")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        """All layers of a table that are finished and hold rows of it."""
        paths = [f"{self.path}/{name}-{k}" for k in self.layers(name)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def layers(self, name: str) -> list[int]:
        kinds = {"postings": "insert", "gone": "delete"}
        if self.layer == 0:
            return []
        done = self.spark.read.schema("layer int, kind string").parquet(f"{self.path}/done")
        rows = done.where(F.col("layer") <= self.layer)
        if name in kinds:
            rows = rows.where(F.col("kind") == kinds[name])
        return sorted({r.layer for r in rows.collect()})

    def _finish(self, layer: int, kind: str) -> None:
        row = [(layer, self.shards, self.least_chars, self.least_docs, kind)]
        self.spark.createDataFrame(row, "layer int, shards int, least_chars int, least_docs int, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        self.layer = layer

    def _newest(self, name: str, schema: str, keys: list[str]) -> DataFrame | None:
        """The newest row of each key; one layer alone has no other."""
        rows = self._read(name, schema)
        if rows is None or self.layer == 1:
            return rows
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "layer").alias("__r")).select(*keys, "__r.*")

    def counts(self) -> DataFrame | None:
        """Each key with the number of documents that hold it and the largest of their ids."""
        return self._newest("counts", COUNTS, KEY)

    def filters(self) -> DataFrame | None:
        return self._newest("filters", FILTERS, ["shard"])

    def postings(self) -> DataFrame | None:
        """(key, doc_id) of the documents in the index: what was inserted after the document was last deleted."""
        kept = None
        gone = self.layers("gone")
        for k in self.layers("postings"):
            rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings-{k}")
            later = [f"{self.path}/gone-{g}" for g in gone if g > k]
            if later:
                rows = rows.join(self.spark.read.schema("doc_id long").parquet(*later).distinct(), "doc_id", "left_anti")
            kept = rows.select(*KEY, "doc_id") if kept is None else kept.unionByName(rows.select(*KEY, "doc_id"))
        return kept

    # ---- changes ----

    def _pairs(self, docs: DataFrame, text: str) -> DataFrame:
        lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(split_lines(F.col(text))).alias("line"))
        keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= self.least_chars)
        return keys.select(*digests(F.col("key")), "doc_id").distinct()

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Add documents; their ids must not be in the index (ValueError, and nothing changes)."""
        layer = self.layer + 1
        self._write("postings", self._pairs(docs, text), layer)
        new = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings-{layer}")
        before, held = self.counts(), self.postings()
        if held is not None and new.select("doc_id").distinct().join(held.select("doc_id").distinct(), "doc_id", "left_semi").limit(1).count():
            raise ValueError("a document is in the index already")
        if self.shards is None:
            self.shards = max(LEAST_SHARDS, new.count() // SHARD_ROWS)
        added = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("top"))
        if before is not None:
            old = before.select(*KEY, F.col("refs").alias("was"), F.col("top").alias("held"))
            added = added.join(old, KEY, "left").select(
                *KEY, (F.col("refs") + F.coalesce("was", F.lit(0))).alias("refs"), F.greatest("top", "held").alias("top"), F.coalesce("was", F.lit(0)).alias("was")
            )
        else:
            added = added.withColumn("was", F.lit(0).cast("long"))
        self._close(layer, added, "insert")
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (a column doc_id) out of the index; ids that it lacks change nothing."""
        layer = self.layer + 1
        self._write("gone", doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), layer)
        gone = self.spark.read.schema("doc_id long").parquet(f"{self.path}/gone-{layer}")
        before, held = self.counts(), self.postings()
        if before is not None:
            lost = held.join(gone, "doc_id", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("less"), F.max("doc_id").alias("last"))
            changed = before.join(lost, KEY).withColumns({"was": F.col("refs"), "refs": F.col("refs") - F.col("less")})
            orphans = changed.where("refs > 0 and top = last").select(*KEY)
            tops = held.join(gone, "doc_id", "left_anti").join(orphans, KEY, "left_semi").groupBy(*KEY).agg(F.max("doc_id").alias("next"))
            changed = changed.join(tops, KEY, "left").select(*KEY, "refs", F.when(F.col("top") == F.col("last"), F.col("next")).otherwise(F.col("top")).alias("top"), "was")
            self._close(layer, changed, "delete")
        return self

    def _close(self, layer: int, changed: DataFrame, kind: str) -> None:
        """Write the counts that changed and the filters of their shards, then call the layer done."""
        self._write("counts", changed.withColumn("layer", F.lit(layer)), layer)
        rows = self.spark.read.schema(COUNTS + ", was long").parquet(f"{self.path}/counts-{layer}")
        common, before = F.col("refs") >= self.least_docs, F.col("was") >= self.least_docs
        crossed = rows.where(common != before).select(_shard(self.shards).alias("shard"), *KEY, common.alias("up"))
        old = self.filters()
        held = (self.spark.createDataFrame([], FILTERS) if old is None else old).select("shard", "cells", "stash")
        new = crossed.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(
            lambda key, a, b: _update(key, a, b) if len(a) else b.iloc[:0], "shard long, cells binary, stash binary"
        )
        self._write("filters", new.withColumn("layer", F.lit(layer)), layer)
        self._finish(layer, kind)

    def rebuild(self) -> LineIndex:
        """Make the filters anew from the exact counts, each with room for twice its keys: after very many insertions."""
        layer = self.layer + 1
        common = self.counts().where(F.col("refs") >= self.least_docs).select(_shard(self.shards).alias("shard"), *KEY)
        new = common.groupBy("shard").applyInPandas(_rebuild, "shard long, cells binary, stash binary")
        self._write("filters", new.withColumn("layer", F.lit(layer)), layer)
        self._write("counts", self.spark.createDataFrame([], COUNTS + ", was long"), layer)
        self._finish(layer, "rebuild")
        return self

    # ---- use ----

    def dropped(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(doc_id, text_hash, positions) of the lines of ``docs`` that go, positions from 0 in order."""
        common = self.counts().where(F.col("refs") >= self.least_docs).select(*KEY, "refs", "top")
        # at most HOT_SHARE keys can have this share of all postings
        hot = F.broadcast(common.where(F.col("refs") >= self._hot_refs()).select(*KEY, F.col("top").alias("hot_top")))
        # the hash is made before the lines are, else each line would carry its whole text along
        texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), split_lines(F.col(text)).alias("lines"))
        lines = texts.select("doc_id", "text_hash", F.posexplode("lines").alias("at", "line"))
        keyed = lines.select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= self.least_chars)
        judged = keyed.select("doc_id", "text_hash", "at", *digests(F.col("key"))).join(hot, KEY, "left")
        shard = _shard(self.shards)
        none = F.lit(None).cast("binary")
        exact = common.select(shard.alias("shard"), *KEY, "top", none.alias("cells"), none.alias("stash"))
        zero = F.lit(0).cast("long")
        state = exact.unionByName(self.filters().select("shard", zero.alias("k1"), zero.alias("k2"), zero.alias("top"), "cells", "stash"))
        # lines of hot keys are settled already: they are dealt by themselves, to shards below zero, of which the state knows nothing
        spread = -1 - F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(self.shards))
        dealt = judged.select(F.when(F.col("hot_top").isNotNull(), spread).otherwise(shard).alias("shard"), "doc_id", "text_hash", "at", *KEY, F.coalesce("hot_top", zero).alias("hot_top"))
        found = dealt.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(_look_up, "doc_id long, text_hash long, at int")
        return found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("positions"))

    def _hot_refs(self) -> int:
        total = self.postings().count()
        return max(HOT_LEAST, total // HOT_SHARE)

    def clean(self, docs: DataFrame, text: str = "text", kept: str = "kept_text", lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
        """``docs`` with the text that stays, its number of lines before and the number of dropped ones; columns of these three names are replaced."""
        i, h, g = unused(docs, 3)
        gone = self.dropped(docs, text).toDF(i, h, g)
        held = docs.join(gone, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left").drop(i, h)
        parts = split_lines(F.col(text))
        removed = F.coalesce(g, F.array().cast("array<int>"))

        def rest(all_lines: Column, positions: Column) -> Column:
            """The lines that aren't dropped: a byte for each line tells, which is looked up at no cost however many lines there are."""
            begins = F.concat(F.array(F.lit(-1)), positions)
            marks = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), positions.alias("z")), lambda s: F.repeat(F.lit("0"), F.coalesce(s["z"] - s["a"] - 1, F.lit(0)))), "1")
            return bind(F.encode(marks, "UTF-8"), lambda m: F.filter(all_lines, lambda x, i: F.substring(m, i + 1, F.lit(1)) != F.lit(b"1")))

        return held.withColumns(
            {
                kept: F.when(F.size(removed) > 0, F.array_join(rest(parts, removed), "\n")).otherwise(F.coalesce(F.col(text), F.lit(""))),
                lines: F.size(parts).cast("long"),
                dropped: F.size(removed).cast("long"),
            }
        ).drop(g)


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, text: str = "text") -> DataFrame:
    """All documents put into a fresh index, then cleaned by it."""
    return LineIndex(docs.sparkSession, None, least_chars, least_docs).insert(docs, text).clean(docs, text)
