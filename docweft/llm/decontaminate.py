"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised
words inside a sentence) and units (behind a number) become typed
placeholders. Windows of ``width`` such tokens are templates. Document windows
that may occur in the benchmark (a Bloom filter of fixed size tells) are
hash-joined with the benchmark's windows. Along each placement of an item in a
document the values behind the placeholders are compared: a placement is
consistent if each value of the item always stands for one value of the
document. An item whose windows are covered to ``least_cover`` by consistent
placements is reported: ``verbatim`` if all values are equal, else
``reworded`` (a re-parameterised question).

A window with fewer than two plain words says too little as a template. It is
matched by its values instead: equal words at every place, numbers and names
too. So items of figures or names only are found where they stand verbatim.

Only the filter, ``FILTER_BITS`` bits however large the benchmark is, goes to
every task. Windows are matched by joins, so a full filter costs time, not
results. Pairs of a document and an item are first sought by few windows: an
item of which a fifth of the windows may be absent is probed by its rarest
fifth and one more, of which one at least must match (the prefix-filter rule).
A window that very many items share so makes no product of documents and items.
All windows are matched for the pairs that are left. Windows and items with a
thousandth of the rows or more are spread over many tasks.

Defined results: null and blank texts have no windows; rows without an id are
left out; a document or item with fewer than ``width`` tokens is one window;
repeated rows count once, and rows of an equal item id with different texts are
one item that holds the windows of all of them; empty tables give an empty
result; other columns are ignored or, in :func:`clean`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import alone, hot_keys, salted_join, settle, written

FILTER_BITS = 1 << 25
#: Words that a Python worker remembers.
WORDS = 150_000
#: Unit words.
UNITS = frozenset(
    """mm cm m km inch inches ft feet foot yard yards mile miles mg g kg lb lbs oz gram grams ounce ounces pound pounds
    ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days
    week weeks month months year years % percent cent cents dollar dollars euro euros degree degrees watt watts volt
    volts amp amps joule joules newton newtons mph kmh""".split()
)
_STRIP = ".,;:!?\"'()[]{}«»“”‘’…"
_NUMBER, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x) & ~15) for x in (b"\0number", b"\0name", b"\0unit"))
_IS_NUMBER, _IS_CAPITAL, _IS_UNIT, _ENDS = 1, 2, 4, 8
_PLACES = np.random.default_rng(20_240_107).integers(0, 2**62, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


class _Tokens(dict):
    """word -> hash of its plain form with its flags in the four low bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        core = word.strip(_STRIP)
        plain = core.lower()
        value = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) & ~15
        if any(c.isdecimal() for c in core):
            value |= _IS_NUMBER
        elif core[:1].isupper() and not core.isupper():
            value |= _IS_CAPITAL
        if plain in UNITS:
            value |= _IS_UNIT
        if word.rstrip("\"'()[]{}«»“”‘’")[-1:] in (".", "!", "?", ":"):
            value |= _ENDS
        self[word] = value
        return value


_TOKENS = _Tokens()


def canonical(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, template hashes, hashes of the plain forms, and whether each is a placeholder."""
    alone(_TOKENS)
    words: list[str] = []
    heads = []
    for line in text.split("\n"):
        heads.append(len(words))
        words += line.split()
    found = np.fromiter(map(_TOKENS.__getitem__, words), "u8", len(words))
    flags = (found & np.uint64(15)).astype("u1")
    begins = np.zeros(len(words) + 1, bool)
    begins[heads] = True
    begins = begins[:-1]
    begins[1:] |= (flags[:-1] & _ENDS) > 0
    number = (flags & _IS_NUMBER) > 0
    name = ((flags & _IS_CAPITAL) > 0) & ~begins
    unit = (flags & _IS_UNIT) > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    plain = found & ~np.uint64(15)
    codes = plain.copy()
    codes[name] = _NAME
    codes[unit] = _UNIT
    codes[number] = _NUMBER
    return words, codes, plain, number | name | unit


def _hashed(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(codes) - size + 1
    out = codes[:n] * _PLACES[0]
    for i in range(1, size):
        out += codes[i : i + n] * _PLACES[i]
    out = (out ^ (out >> np.uint64(31))) * _PLACES[seed + size % 16]
    return out ^ (out >> np.uint64(29))


def windows(codes: np.ndarray, plain: np.ndarray, slots: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Hashes of all windows, and their size: of templates, or of the values where plain words are too few."""
    size = min(width, len(codes))
    if not size:
        return np.zeros(0, "u8"), 0
    out = _hashed(codes, size, 32)
    if slots.any():
        before = np.concatenate([[0], np.cumsum(~slots)])
        bare = np.flatnonzero(before[size:] - before[:-size] < min(2, size))
        out[bare] = _hashed(plain, size, 48)[bare]
    return out, size


def maybe_known(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the window keys whose bit is set, which is looked up in the packed bitmap."""
    place = key >> np.uint64(39)
    return np.flatnonzero((bits[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1")) & np.uint8(1))


HITS = "id long, at int, key long, slots array<string>, size int"


def _windows_of(rows: DataFrame, lengths: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """Windows of rows (id, text): of ``lengths``, with a filter those only that it may know and that are not shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids, ats, keys, values, sizes = [], [], [], [], []
                for row_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words, codes, plain, slots = canonical(text.as_py() or "")
                    for length in lengths:
                        if bits is not None and len(codes) < length:
                            continue
                        key, size = windows(codes, plain, slots, length)
                        at = np.arange(len(key))
                        if bits is not None and len(key):
                            at = maybe_known(key, bits)
                            key = key[at]
                        for a, k in zip(at.tolist(), key.view("i8").tolist(), strict=True):
                            ids.append(row_id)
                            ats.append(a)
                            keys.append(k)
                            values.append([w.strip(_STRIP).lower() for w, s in zip(words[a : a + size], slots[a : a + size], strict=True) if s])
                            sizes.append(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.string())), pa.array(sizes, pa.int32())],
                    names=["id", "at", "key", "slots", "size"],
                )

    return rows.where("id is not null and text is not null").mapInArrow(run, HITS)


def build_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with those of the window keys set: at most a 64th as many rows reach the driver."""
    place = F.shiftrightunsigned("key", 39)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "i8")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view("u1")


def _rows(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least_cover: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, windows, matched, cover, kind for each item that a document holds."""
    items = settle(_windows_of(_rows(benchmark, item_col), [width]).distinct())
    bits = build_filter(items)
    # an item of fewer tokens than the width is one window of its own length; there are few lengths
    short = [r.size for r in items.where(F.col("size") < width).select("size").distinct().collect()]
    hits = written(_windows_of(_rows(docs, id_col), sorted({width, *short}), bits).distinct().select(F.col("id").alias("doc_id"), "at", "key", F.col("slots").alias("theirs")), "hits")
    totals = settle(items.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("at").alias("windows")))
    items = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "key", F.col("slots").alias("ours"))
    pairs = written(_probed(hits, items, totals, least_cover), "pairs")
    wanted = salted_join(pairs, items, ["item_id"], hot_keys(pairs, ["item_id"]), ["doc_id"])
    placed = hits.join(wanted, ["doc_id", "key"])
    pair = F.arrays_zip(F.col("ours").alias("a"), F.col("theirs").alias("b"))
    rows = placed.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", pair.alias("pairs"))
    ways = rows.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    one_to_one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    return (
        ways.where(one_to_one)
        .groupBy("doc_id", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"),
            F.every(F.forall("pairs", lambda p: p["a"] == p["b"])).alias("same"),
        )
        .join(totals, "item_id")
        .where(F.col("matched") >= F.lit(least_cover) * F.col("windows"))
        .select(
            "doc_id",
            "item_id",
            "windows",
            "matched",
            (F.col("matched") / F.col("windows")).alias("cover"),
            F.when(F.col("same"), "verbatim").otherwise("reworded").alias("kind"),
        )
    )


def _probed(hits: DataFrame, items: DataFrame, totals: DataFrame, least_cover: float) -> DataFrame:
    """doc_id, item_id of which one of the item's rarest windows matches: so many that an item of enough cover has one of them."""
    shared = items.groupBy("key").agg(F.count_distinct("item_id").alias("sharers"))
    places = items.join(shared, "key").groupBy("item_id", "item_at").agg(F.max("sharers").alias("sharers"), F.min("key").alias("least"))
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("sharers", "least", "item_at"))  # one item's windows
    enough = F.col("windows") - F.ceil(F.lit(least_cover) * F.col("windows")) + 1
    chosen = places.withColumn("rank", rarest).join(totals, "item_id").where(F.col("rank") <= enough).select("item_id", "item_at")
    probes = items.join(chosen, ["item_id", "item_at"]).select("item_id", "key").distinct()
    found = salted_join(hits.select("doc_id", "at", "key"), probes, ["key"], hot_keys(hits, ["key"]), ["doc_id", "at"])
    return found.select("doc_id", "item_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, least_cover: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item, all columns kept."""
    found = contaminated(docs, benchmark, width, least_cover).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["__held"], "left_anti")
