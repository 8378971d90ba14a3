"""Substring deduplication by sliding sentence spans.

Runs of several consecutive sentences are hashed; a run is the shortest span
from a sentence on, or up to a sentence, that has ``least_sentences`` sentences
and ``least_words`` words, so equal passages give equal runs wherever they
stand. Runs from both ends cover every sentence of a repeated passage, its short
last ones too, just as all spans of that size or more would.
Texts are hashed once and the runs kept as Parquet. Runs meet in one global
aggregation: the first occurrence of a hash (smallest id, then position) stays,
and every sentence that any other occurrence covers is removed.

Counting happens before the shuffle, so a passage that very many documents
share costs one row per task there; the same count tells the hot hashes. Only
hashes seen more than once are joined back; the runs of a hash with a thousandth
of all rows or more are spread over many tasks, each with its own copy of the
hash's first occurrence. Texts are shuffled only where a bitmap of fixed size
says that their id may lose sentences; a full bitmap costs room, not results.

Sentences end at ``.``, ``!`` or ``?`` before white space, and at line ends.
They are compared by their words, without regard to case.

Defined results: null and blank texts and texts with fewer sentences or words
than a run hold no run and stay as they are, like rows without an id. Rows of an
equal id are one document: their equal positions are one occurrence. Repeats
within a document count. An empty table gives an empty result. Further columns
are kept by :func:`remove_repeats`; no column name clashes, since helper columns
never stand beside those of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import hot_least, salted_join, settle, unused, written

_END = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that is not blank."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def runs(text: str, least_sentences: int, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """First sentence, sentence behind the last, and 128-bit hash of each run."""
    words = [text[a:b].lower().split() for a, b in sentences(text)]
    keys = [xxhash.xxh3_128_digest("\x1f".join(w).encode("utf-8", "surrogatepass")) for w in words]
    counts = [len(w) for w in words]
    n, ends = len(words), {}
    stop, total = 0, 0
    for start in range(n):
        while stop < n and (stop - start < least_sentences or total < least_words):
            total += counts[stop]
            stop += 1
        if stop - start < least_sentences or total < least_words:
            break
        ends[start] = stop
        yield start, stop, xxhash.xxh3_128_digest(b"".join(keys[start:stop]))
        total -= counts[start]
    start, total = 0, 0
    for stop in range(1, n + 1):
        total += counts[stop - 1]
        while stop - start > least_sentences and total - counts[start] >= least_words:
            total -= counts[start]
            start += 1
        if stop - start >= least_sentences and total >= least_words and ends.get(start) != stop:
            yield start, stop, xxhash.xxh3_128_digest(b"".join(keys[start:stop]))


RUNS = "doc_id long, text_hash long, start int, stop int, h1 long, h2 long"


def hash_runs(docs: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, hashes, starts, stops, h1, h2 = [], [], [], [], [], []
                for doc_id, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for start, stop, key in runs(text.as_py() or "", least_sentences, least_words):
                        ids.append(doc_id)
                        hashes.append(text_hash)
                        starts.append(start)
                        stops.append(stop)
                        h1.append(int.from_bytes(key[:8], "little", signed=True))
                        h2.append(int.from_bytes(key[8:], "little", signed=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                    names=["doc_id", "text_hash", "start", "stop", "h1", "h2"],
                )

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", "text").mapInArrow(run, RUNS)


def _keys(docs: DataFrame, apart: bool) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text, apart).alias("text_hash"), text.alias("text"))


def _text_hash(text: Column, apart: bool) -> Column:
    """What tells the texts of one id apart; nothing where every id has one text, so that it takes no room."""
    return F.xxhash64(text) if apart else F.lit(0).cast("long")


def repeated_ids(docs: DataFrame) -> tuple[bool, bool]:
    """Whether some id has different texts, and whether some id has several rows."""
    ids = _keys(docs, True).where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.count(F.lit(1)).alias("n"))
    told = ids.agg(F.bool_or(F.col("a") != F.col("b")).alias("apart"), F.bool_or(F.col("n") > 1).alias("again")).first()
    return bool(told.apart), bool(told.again)


def repeated_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, apart: bool = True, again: bool = True) -> DataFrame:
    """doc_id, text_hash, spans (first sentence, sentence behind the last) that repeat earlier ones, first_doc_ids.

    A document is an id with a text: where one id has several texts, each has spans of its own, ordered by id, then hash of the text;
    ``apart`` is false where the caller knows that no id has, ``again`` where no id has several rows: then every run is a place of its
    own, and hashes seen twice need no last place beside the first.
    """
    found = written(hash_runs(_keys(docs, apart), least_sentences, least_words), "runs")
    keys, of = ["h1", "h2"], ["doc_id", "text_hash", "start"] if apart else ["doc_id", "start"]
    runs = found if apart else found.drop("text_hash")
    place = F.struct(*of)
    last = [F.max(place).alias("last")] if again else []
    several = F.col("first") != F.col("last") if again else F.col("n") > 1
    seen = runs.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *last)
    is_hot = F.col("n") >= hot_least(found)
    firsts = settle(seen.where(several | is_hot).select(*keys, "first", several.alias("several"), is_hot.alias("hot")))
    later = salted_join(runs, firsts.where("several").select(*keys, "first"), keys, firsts.where("hot").select(*keys), of).where(place != F.col("first"))
    if not apart:
        later = later.withColumn("text_hash", F.lit(0).cast("long"))
    return later.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.collect_set("first.doc_id")).alias("first_doc_ids"),
    )


#: Bits that tell which ids may lose sentences, in pieces of Spark's bitmap functions: 8 MB at most.
FILTER_BITS = 1 << 26


def may_have(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among ``ids``: no row that has one is missing, few others stay."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1")
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__piece")).withColumns({"__byte": byte, "__at": F.bitmap_bit_position(at)})
    return held.where(bit == 1).select(*rows.columns)


def _cut(text: str | None, spans: list[dict]) -> tuple[str | None, int, int]:
    """Text without the covered sentences, number of sentences, number removed."""
    if text is None:
        return None, 0, 0
    places = sentences(text)
    gone = bytearray(len(places))
    for s in spans or ():
        for i in range(s["start"], min(s["stop"], len(places))):
            gone[i] = 1
    if not any(gone):
        return text, len(places), 0
    out = []
    for i, (a, _) in enumerate(places):
        if not gone[i]:
            out.append(text[a : places[i + 1][0] if i + 1 < len(places) else len(text)])
    return "".join(out).rstrip(), len(places), sum(gone)


CUT = "text string, n_sentences int, n_removed int"


def _cutter(text: Column, spans: Column) -> Column:
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [_cut(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)]
        return pa.array([{"text": t, "n_sentences": n, "n_removed": k} for t, n, k in rows], pa.struct([("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32())]))

    return cut(text, spans)


def affected(docs: DataFrame, least_sentences: int = 2, least_words: int = 20) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed, first_doc_ids of each document that loses sentences."""
    apart, again = repeated_ids(docs)
    spans = written(repeated_spans(docs, least_sentences, least_words, apart, again), "spans")
    return (
        may_have(_keys(docs, apart), spans.select("doc_id"))
        .join(spans, ["doc_id", "text_hash"])
        .select("doc_id", _cutter(F.col("text"), F.col("spans")).alias("cut"), "first_doc_ids")
        .select("doc_id", "cut.text", "cut.n_sentences", "cut.n_removed", "first_doc_ids")
    )


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 20) -> DataFrame:
    """``docs``, all columns kept, with the covered sentences removed from ``text``."""
    i, h, own = unused(docs, 3)
    apart, again = repeated_ids(docs)
    spans = repeated_spans(docs, least_sentences, least_words, apart, again).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(own))
    same = (F.col("doc_id").cast("long") == F.col(i)) & (_text_hash(F.col("text").cast("string"), apart) == F.col(h))
    joined = docs.join(spans, same, "left")
    cut = F.when(F.col(own).isNull(), F.col("text")).otherwise(_cutter(F.col("text"), F.col(own))["text"])
    return joined.withColumn("text", cut).drop(i, h, own)
