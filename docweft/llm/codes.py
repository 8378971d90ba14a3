"""Vector codes: vectors cut into parts, each part the index of its nearest codebook entry.

Components are scaled to integers, floor(scale * x), and all that is returned
is exact integer arithmetic. Distances of a block of parts to all entries are
screened by one float32 matrix product. Its rounding errors are bounded: of a
dot product of w terms by g * |x| * |c|, where g = (w + 4) * u / (1 - (w + 4) * u),
u = 2**-24, whatever the order of the sums (three more terms stand for the
rounding of both factors and of the length of c), and by 2 u for each sum of two such numbers.
Every entry whose interval reaches the best one's is computed again in int64;
of equal distances the smaller index wins.

Training sums parts per entry inside each task; only these sums, whose number
doesn't depend on the rows, meet.

Defined results: vectors that are null, empty, hold null or non-finite
components, or are of another length than the vector of the smallest vec_id
take no part, nor do any if that length isn't a multiple of the parts; scaled
components beyond +-2**26 count as +-2**26, so that no sum overflows; repeated
rows are repeated; rows without a vec_id are coded but come last when the first
entries are chosen; of rows with one vec_id the smaller vector comes first;
with fewer rows than entries the codebooks are that much shorter; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import hot_keys, salted_join, unused, written

UNIT = 2.0**-24
LIMIT = 2**26
#: Parts of vectors that are screened at once.
BLOCK = 8192


@dataclass(frozen=True)
class Codebooks:
    #: (parts, entries, width), whole numbers.
    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row of ``x``; whole numbers, exact."""
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    c = entries.astype(np.float32)
    lengths = (entries * entries).sum(1)
    width = x.shape[1]
    g = (width + 4) * UNIT / (1 - (width + 4) * UNIT)
    longest, square = float(np.sqrt(lengths.max())) * (1 + 1e-12), float(lengths.max())
    for at in range(0, len(x), BLOCK):
        block = x[at : at + BLOCK]
        norms = np.sqrt((block * block).sum(1).astype(np.float64)) * (1 + 1e-12)
        screened = lengths.astype(np.float32) - np.float32(2) * (block.astype(np.float32) @ c.T)
        reach = (2 * g + 4 * UNIT) * norms * longest + 4 * UNIT * square
        # the comparison itself is made in double precision, where these bounds are far above its rounding
        low = screened.min(1).astype(np.float64)
        rows, found = np.nonzero(screened <= (low + 2.001 * reach)[:, None])
        exact = block[rows] - entries[found]
        exact = (exact * exact).sum(1)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        best = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == best[rows])
        first = hits[np.flatnonzero(np.r_[True, rows[hits][1:] != rows[hits][:-1]])]
        index[at : at + BLOCK], distance[at : at + BLOCK] = found[first], exact[first]
    return index, distance


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, and their vectors."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    right = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(right)).flatten()
    flat = flat.cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan)).reshape(len(right), width)
    fine = np.isfinite(values).all(1)
    return right[fine], values[fine]


def _first_rows(vectors: DataFrame, id_col: str, column: str, entries: int) -> list:
    """The vectors of the smallest ids; as many as a codebook has entries, so their number is bounded."""
    good = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    order = [F.col(id_col).asc_nulls_last(), F.col(column)]
    rows = vectors.where(good).select(F.col(id_col), F.col(column))
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return []
    width = len(head[0][1])
    return [r[1] for r in rows.where(F.size(column) == width).orderBy(*order).limit(entries).collect()]


def train(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of ``rounds`` rounds over all vectors; None if no vector can be cut."""
    head = _first_rows(vectors, id_col, column, entries)
    if not head or len(head[0]) % parts:
        return None
    width = len(head[0])
    start = scaled(np.array(head), scale).reshape(len(head), parts, width // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    one = vectors.select(column)
    for _ in range(rounds):
        books = _round(one, books, scale)
    return Codebooks(books, scale)


def _round(one: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, width = books.shape
    cells = width + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, cells), np.int64)
        for batch in batches:
            _, values = usable(batch.column(0), parts * width)
            whole = scaled(values, scale).reshape(-1, parts, width)
            for p in range(parts):
                mine = np.ascontiguousarray(whole[:, p])
                index, _ = nearest(mine, books[p])
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.r_[True, index[order][1:] != index[order][:-1]]) if len(order) else np.empty(0, np.int64)
                if len(starts):
                    total[p, index[order][starts], :width] += np.add.reduceat(mine[order], starts)
                    total[p, :, width] += np.bincount(index, minlength=entries)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["cell", "total"])

    # parts * entries * (width + 1) rows, however many vectors there are
    got = one.mapInArrow(sums, "cell long, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(parts * entries * cells, object)
    for cell, value in got:
        total[cell] = int(value)
    total = total.reshape(parts, entries, cells)
    out = books.copy()
    for p in range(parts):
        for e in range(entries):
            if total[p, e, width]:
                out[p, e] = [s // total[p, e, width] for s in total[p, e, :width]]
    return out


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """``vectors`` that take part, with their code (two hexadecimal digits a part; as many as needed for larger codebooks) and squared error.

    All columns are kept; columns of these two names are replaced.
    """
    parts, entries, width = books.entries.shape
    digits = max(2, len(f"{entries - 1:x}"))
    others = [c for c in vectors.columns if c.lower() not in (code.lower(), error.lower())]
    source = unused(vectors, 1)[0]
    rows = vectors.select(*(F.col(c) for c in others), F.col(column).alias(source))
    kept = rows.drop(source)
    names = [*kept.columns, code, error]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{code}` string", f"`{error}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, values = usable(batch.column(batch.num_columns - 1), parts * width)
            whole = scaled(values, books.scale).reshape(-1, parts, width)
            codes, errors = np.zeros((len(which), parts), np.int64), np.zeros(len(which), np.int64)
            for p in range(parts):
                codes[:, p], off = nearest(np.ascontiguousarray(whole[:, p]), books.entries[p])
                errors += off
            written_out = ["".join(f"{x:0{digits}x}" for x in row) for row in codes.tolist()]
            own = [batch.column(i).take(pa.array(which)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(written_out, pa.string()), pa.array(errors)], names)

    return rows.mapInArrow(run, fields)


def decode(coded: DataFrame, books: Codebooks, code: str = "code", out: str = "approximation") -> DataFrame:
    """``coded`` with the scaled vector that each code stands for."""
    parts, entries, width = books.entries.shape
    digits = max(2, len(f"{entries - 1:x}"))
    rows = coded.select(*(c for c in coded.columns if c.lower() != out.lower()))
    at = rows.columns.index(code)
    names = [*rows.columns, out]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([[int(c[p * digits : (p + 1) * digits], 16) for p in range(parts)] for c in batch.column(at).to_pylist()], np.int64).reshape(-1, parts)
            values = np.concatenate([books.entries[p][found[:, p]] for p in range(parts)], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, parts * width, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    return rows.mapInArrow(run, fields)


def with_label_errors(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the errors of equal labels (nulls are one label) summed up.

    Sums are made before they are joined back, and labels that very many rows
    share are spread over tasks.
    """
    key, none, total, number = unused(coded, 4)
    rows = written(coded.withColumns({key: F.coalesce(F.col(label).cast("string"), F.lit("")), none: F.col(label).isNull()}), "codes")
    hot = hot_keys(rows, [key, none])
    sums = rows.groupBy(key, none).agg(F.sum(error).cast("long").alias(total))
    spread = rows.withColumn(number, F.monotonically_increasing_id())
    return salted_join(spread, sums, [key, none], hot, [number]).withColumn(out, F.col(total)).drop(key, none, total, number)


def compress(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of every vector that takes part, and the codebooks."""
    books = train(vectors, id_col, column, parts, entries, rounds, scale)
    rows = vectors.select(F.col(id_col), F.col(label), F.col(column))
    if books is None:
        none = rows.limit(0).select(id_col, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, None
    return with_label_errors(encode(rows, books, column).drop(column), label), books
