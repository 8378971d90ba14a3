"""WARC archives in which every record is compressed with a shared dictionary.

An archive is a skippable Zstandard frame that holds a dictionary, then one
Zstandard frame per record, each compressed with that dictionary. The
dictionary is trained on records of the archive itself. Readers load it from
the head of the file, so an archive stands alone, and any record can be read
from its offset.

Payloads that occur more than once are stored once: the record of the smallest
id is a response, the others are revisit records that name it.

Reading back streams every archive and checks each record's digest.

Writing is idempotent: a task writes each archive under a name of its attempt
and moves it to a name that depends only on the partition, so a task that is
repeated after a lost executor replaces its own files. Archives are written
through ``pyarrow.fs`` into the shared folder.

Defined results: a null payload is empty; a null id is written as ``-`` and
read back as null; it refers to the smallest id of its payload if there is
one. Rows of an equal id and payload are all of one type. Rows of an equal id
and different payloads are records of their own. An empty table gives no
archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import fresh_dir, settle

#: Fixed values of the formats: the skippable frame and the dictionary's own magic number.
SKIPPABLE = 0x184D2A5D
WARC_DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
BREAK = b"\r\n"
SAFE = "!#$%&'()*+,-./:;=?@[]_~"
#: Bytes given to the decompressor at once; only this much is copied back behind a record's end.
STEP = 65_536
#: Compressed bytes that a task reads back where there are more archives than twice the cores.
TASK_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. The id and address are written with URL escapes where they need them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'-' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{URN}{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return BREAK.join(x.encode() for x in lines) + BREAK + BREAK + block + BREAK + BREAK


def parse(data: bytes) -> dict:
    """A record's header fields and payload; of a revisit record, the length its HTTP head states."""
    head, _, rest = data.partition(BREAK + BREAK)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(BREAK + BREAK)
    stated = int(http.rpartition(b"Content-Length: ")[2])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != stated or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name: str) -> int | None:
        value = fields.get(name, "").strip("<>").removeprefix(URN)
        return int(value) if value not in ("", "-") else None

    return {
        "page_id": number("WARC-Record-ID"),
        "payload_bytes": stated,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "url": fields.get("WARC-Target-URI", ""),
        "payload": None if revisit else payload,
    }


def train(records: list[bytes], dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from evenly spaced records, ``sample_bytes`` of them at most; empty if they are too few."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[:131_072] for r in records[::step]]
    try:
        return zstandard.train_dictionary(dict_bytes, sample, k=200, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], dict_bytes: int = 32_768, sample_bytes: int = 1_000_000, level: int = 3) -> bytes:
    """The bytes of an archive: dictionary frame, then a frame for each record."""
    import zstandard

    words = train(records, dict_bytes, sample_bytes)
    out = [struct.pack("<II", SKIPPABLE, len(words)), words]
    shared = zstandard.ZstdCompressionDict(words) if words else None
    press = zstandard.ZstdCompressor(level=level, dict_data=shared)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one after another; one record and ``STEP`` bytes are held at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    words = source.read(size)
    shared = zstandard.ZstdCompressionDict(words) if words else None
    press = zstandard.ZstdDecompressor(dict_data=shared)
    rest = source.read(STEP)
    while rest:
        frame, out = press.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the last record is cut off")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(STEP)
        yield b"".join(out)
        rest = rest or source.read(STEP)


MANIFEST = "path string, records long, bytes long"


def write_archives(rows: DataFrame, where: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write ``rows`` (page_id, url, payload, refers_to, revisit) below ``where``; one row per archive.

    A task holds the records of one archive at a time, ``archive_bytes`` and one record at most.
    Only archives that the returned table names count; others are of attempts that didn't end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(where)
        made = 0

        def flush(records: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            # every attempt has names of its own: one that is stopped half-way leaves archives that the manifest doesn't name
            name = f"part-{task.partitionId():05d}-{made:04d}-{task.taskAttemptId()}"
            made += 1
            data = archive(records)
            with store.open_output_stream(f"{top}/{name}.warc.zst", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{where}/{name}.warc.zst"], "records": [len(records)], "bytes": [len(data)]})

        store.create_dir(top, recursive=True)
        records: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, payload, refers_to, revisit = (x.as_py() for x in row)
                records.append(record(page_id, url, payload.encode(), refers_to, revisit))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    columns = rows.select("page_id", "url", "payload", "refers_to", "revisit")
    return settle(columns.mapInArrow(run, MANIFEST))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_FULL = pa.schema([*_READ, ("url", pa.string()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives that ``manifest`` (path, bytes) names, in the order of a file.

    Archives are dealt to as many tasks as they allow, up to ``TASK_BYTES`` a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = _FULL if payloads else _READ
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    rows: list[dict] = []
                    for one in map(parse, read_archive(source)):
                        rows.append(one)
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    full = READ + ", url string, payload binary"
    archives, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(archives, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    return manifest.select("path").repartition(max(1, tasks)).mapInArrow(run, full if payloads else READ)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with payload, refers_to and revisit.

    Only digests of repeated payloads and their smallest ids are joined; Spark
    splits a digest that very many rows share.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    ).withColumn("key", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= least_bytes
    firsts = (
        rows.where(large).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return (
        rows.join(firsts, "key", "left")
        .withColumn("revisit", revisit)
        .select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), "revisit")
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read the records back."""
    where = fresh_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, least_bytes), where))
