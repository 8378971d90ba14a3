"""Near-duplicate documents by b-bit MinHash.

1. A text is a set of word shingles, hashed to 64 bits. Documents of equal sets
   become one representative, the smallest id, before anything else; a large
   group of copies costs one row.
2. Each set has ``HASHES`` minima. Bands of ``ROWS`` minima give the candidate
   keys; of the minima themselves only the two lowest bits are kept, packed
   into ``LANES`` longs.
3. In a band's bucket every member is paired with the smallest one only, so
   candidates grow with the rows, not with the square of a bucket. Their
   similarity is estimated from the packed signatures by bit counts, corrected
   for chance agreement; clear misses go.
4. The pairs that are left are confirmed on their full shingle sets, and the
   links make components (alternating stars).
5. Texts that share a bucket without being linked to its smallest member may be
   linked to one another. Buckets that hold more than one component are looked
   at again, however unlike their smallest member is: every member outside of the
   bucket's largest component is compared with the whole bucket, in blocks of
   ``BLOCK`` by ``BLOCK`` sets. Only confirmed links come out. Pairs with an
   estimate under ``LOOSE``, ten standard deviations below 0.8, are passed over.

What remains probabilistic is what the banding is: two sets at the threshold of
0.8 share no band with a chance of about 3e-6.

Defined results: a null or blank text has the empty set, is linked with nothing
and is its own component; rows without an id are their own, with component null
and kept true; repeated rows are copies of each other and share id and
component; rows of an equal id and different texts are one document that is
linked with all that any of its texts is linked with; an empty table gives an empty result; other columns are ignored by
:func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import alone, hot_keys, marked, salted_join, settle, unused

LANES = 8
HASHES = 32 * LANES
ROWS, BANDS = 6, 42
#: Estimates have a standard deviation of about 0.031 at 0.8; pairs at 0.8 pass CLOSE but for one in a million.
CLOSE, LOOSE = 0.65, 0.5
BLOCK = 256
#: Edges that a task of the component rounds takes.
EDGES = 20_000
#: Hashes of words that a Python worker remembers.
WORDS = 150_000

_DRAW = np.random.default_rng(20_240_101)
_MULTIPLY = _DRAW.integers(0, 2**31, HASHES, dtype="u4") * np.uint32(2) + np.uint32(1)
_ADD = _DRAW.integers(0, 2**32, HASHES, dtype="u4")
_PLACES = _DRAW.integers(0, 2**62, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without space, tab, line feed, vertical tab, form feed and
    carriage return; A-Z count as a-z. Fewer words than ``width`` are one shingle.
    """
    alone(_HASHES)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], "u8")
    hashes = np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))
    n = len(words) - width + 1
    out = hashes[:n] * _PLACES[0]
    for i in range(1, width):
        out += hashes[i : i + n] * _PLACES[i]
    return np.unique(_mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The ``HASHES`` minima of a non-empty set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype("u4")
    best = np.full(HASHES, 2**32 - 1, "u4")
    for i in range(0, len(low), 512):
        part = low[i : i + 512, None] * _MULTIPLY
        part += _ADD
        np.minimum(best, part.min(axis=0), out=best)
    return best


def packed_low_bits(best: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a long."""
    bits = ((best ^ (best >> np.uint32(15))) & np.uint32(3)).astype("u8").reshape(LANES, 32)
    return np.bitwise_or.reduce(bits << (np.arange(32, dtype="u8") * np.uint64(2)), axis=1).view("i8")


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different in each band."""
    rows = best[: ROWS * BANDS].reshape(BANDS, ROWS).astype("u8")
    keys = np.arange(1, BANDS + 1, dtype="u8") * _PLACES[63]
    for i in range(ROWS):
        keys = _mix(keys + rows[:, i] * _PLACES[32 + i])
    return keys.view("i8")


LANE = [f"s{i}" for i in range(LANES)]
SKETCH = "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in LANE) + ", bands array<long>"


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, fingerprint of the set, packed signature and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                size, f1, f2, keys, ends = [], [], [], [], [0]
                lanes = np.zeros((part.num_rows, LANES), "i8")
                for i, text in enumerate(part.column(1)):
                    found = shingle_set(text.as_py(), width)
                    size.append(len(found))
                    high, low = divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 2**64)
                    f1.append(high - 2**63)
                    f2.append(low - 2**63)
                    if len(found):
                        best = minima(found)
                        lanes[i] = packed_low_bits(best)
                        keys.append(band_keys(best))
                    ends.append(len(keys) * BANDS)
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, "i8")))
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (size, f1, f2)), *(pa.array(lanes[:, j].copy()) for j in range(LANES)), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", *LANE, "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, SKETCH)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for the quarter that agrees by chance."""
    odd = F.lit(0x5555555555555555)
    miss = None
    for s in LANE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        miss = n if miss is None else miss + n
    return F.lit(1.0) - miss / F.lit(HASHES * 0.75)


SETS = "id long, shingles binary"


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the full set, as sorted unsigned 64-bit hashes, of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(x.as_py(), width).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, SETS)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8"), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.toDF("u", "a"), sets.toDF("v", "b")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id) of every node of ``links`` (u, v), by alternating stars."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def compact(df: DataFrame, rows: int) -> DataFrame:
        # A round shuffles several times; a map task for every EDGES rows keeps its files few.
        return df.coalesce(max(1, -(-rows // EDGES)))

    edges = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(edges)
    edges = compact(edges, before[0])
    while True:
        rows = before[0]
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = settle(compact(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        stars = (
            edges.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
        )
        edges = settle(compact(compact(stars, 2 * rows).distinct(), rows))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _block_links(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def read(table: pa.Table) -> tuple:
            sets = [np.frombuffer(s.as_buffer(), "u8") for s in table["shingles"]]
            lanes = np.stack([table[s].to_numpy() for s in LANE], axis=1).view("u8")
            return table["id"].to_numpy(), table["component"].to_numpy(), sets, lanes

        u, v = [], []
        ids, components, sets, lanes = read(right)
        for i, c, mine, own in zip(*read(left), strict=True):
            x = lanes ^ own
            miss = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype="i8")
            met = {c}
            for k in np.flatnonzero((miss <= (1 - LOOSE) * HASHES * 0.75) & (components != c)):
                if components[k] not in met and linked(mine, sets[k], percent):
                    met.add(components[k])
                    u.append(i)
                    v.append(ids[k])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def open_members(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (id, component, bucket) in buckets of several components, with their numbers of blocks."""
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    still_open = (
        sizes.groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        .where("all > most and all > 2")
        .select(
            "bucket",
            "main",
            F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("outer"),
        )
    )
    return members.join(still_open, "bucket")


def bucket_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that buckets still hold: ``members`` is what :func:`open_members` gives, ``sets`` has signatures too.

    In each bucket the members outside of the largest component are compared
    with all members, in blocks.
    """
    rows = members.join(sets, "id")
    number = F.xxhash64("id")
    held = ("id", "component", "shingles", *LANE)
    left = rows.where("component <> main").select(
        "bucket", F.pmod(number, F.col("outer")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m"), *held
    )
    right = rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"), F.pmod(number, F.col("blocks")).cast("int").alias("m"), *held
    )
    keys = ("bucket", "x", "m")
    right = right.toDF(*right.columns)  # both sides come from the same rows
    left = left.toDF(*left.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_links(percent), "u long, v long")


def _same_ids(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) between the representatives of the different texts of one id."""
    mark = F.struct("f1", "f2")
    several = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select("doc_id")
    texts = rows.join(several, "doc_id", "left_semi").select("doc_id", "f1", "f2").distinct().join(reps.select("f1", "f2", "id"), ["f1", "f2"])
    return texts.select(F.col("doc_id").alias("u"), F.col("id").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    rows = settle(sketch(docs, width, id_col, text_col))
    reps = settle(
        rows.where("doc_id is not null and n > 0")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), *(F.first(s).alias(s) for s in LANE), F.first("bands").alias("bands"))
    )
    keyed = reps.select("id", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(keyed.join(pivots, "key"))
    pairs = shared.where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    signed = reps.select("id", "n", F.struct(*LANE).alias("s"))
    fits = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    close = (
        pairs.join(signed.toDF("u", "nu", "a"), "u")
        .join(signed.toDF("v", "nv", "b"), "v")
        .where(fits & (estimate("a", "b") >= CLOSE))
        .select("u", "v")
        .distinct()
    )
    close = settle(close)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = settle(ids)
        maybe = marked(texts, F.col("id"), ids, "__maybe").where("__maybe").drop("__maybe")  # the other texts are not shuffled
        found = shingle_sets(maybe.join(ids, "id", "left_semi"), width).withColumn("__h", F.xxhash64("shingles"))
        return settle(found.dropDuplicates(["id", "__h"]).drop("__h"))  # an id may have several texts

    sets = sets_of(close.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    links = settle(confirm(close, sets, percent).union(_same_ids(rows, reps)))
    first = settle(components(links))
    members = shared.where("n > 2").join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("key").alias("bucket"))
    members = settle(open_members(members))
    late_ids = members.select("id").distinct()
    sets = sets.join(late_ids, "id", "left_semi").union(sets_of(late_ids.join(sets, "id", "left_anti")))
    late = settle(bucket_links(members, sets.join(reps.select("id", *LANE), "id"), percent))
    final = first
    if not late.isEmpty():
        joined = first.select(F.col("id").alias("u"), F.col("component").alias("v")).union(late)
        final = settle(components(joined))
    of_rep = reps.select("f1", "f2", F.col("id").alias("rep")).join(final.toDF("rep", "component"), "rep", "left")
    of_rep = of_rep.select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    # copies of one text share a fingerprint, however many there are
    own = rows.select("doc_id", "n", "f1", "f2")
    return (
        salted_join(own, of_rep, ["f1", "f2"], hot_keys(own, ["f1", "f2"]), ["doc_id"], how="left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates: of each component the row of the smallest id stays.

    All columns are kept. Of several rows of that id the one of the smallest text stays, null last.
    """
    found = settle(near_duplicates(docs, width, percent).where("doc_id is not null").select("doc_id", "kept"))
    i, maybe = unused(docs, 2)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(i)).distinct()
    again = found.where("kept").groupBy(F.col("doc_id").alias(i)).count().where("count > 1").select(i)
    same = F.col("doc_id").cast("long") == F.col(i)
    # most rows stay, as a bitmap tells; the others are looked up
    told = marked(docs, F.col("doc_id").cast("long"), gone.union(again), maybe)
    sure, looked_up = told.where(~F.col(maybe)).drop(maybe), told.where(maybe).drop(maybe)
    if again.isEmpty():
        return sure.union(looked_up.join(gone, same, "left_anti"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"), F.to_json(row))).alias("__row")
    once = looked_up.join(again, same, "left_semi").groupBy("doc_id").agg(least).select("__row.*")
    return sure.union(looked_up.join(gone.union(again), same, "left_anti")).unionByName(once)
