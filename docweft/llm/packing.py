"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Documents are tokenised in Arrow batches and cut into pieces of at most
   ``capacity`` tokens; a piece is a few numbers and a checksum from here on.
   The pieces are settled in the shared folder, so nothing is tokenised twice.
2. Pieces are dealt by hash into leaves of about ``leaf_pieces`` and packed
   best-fit decreasing inside each leaf. Every bin that is nearly full is
   finished there.
3. A tree merges the rest: the underfull bins of ``fan_in`` nodes become items
   of one node and are packed best-fit again, level by level up to the root.

What a node hands up is bounded. Two bins that fit together are always merged
by best fit, so a node keeps at most one bin that is half full or less; each
merge above needs such a bin, so ``fan_in`` lightest bins per node are all that
can still be used. The others are finished as they are: no piece is dropped.

Defined results: a null text is the empty text (one piece holding the end
token); a null id is kept; repeated rows are packed as documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import alone, settle

#: Entries of one generation of a worker's lookup table (there are two).
ENTRIES = 400_000
_LOADED: dict[str, PartCache] = {}
#: Texts that are encoded whole: characters on which Python's white space differs from the
#: tokenizer's, and what may be the string of a special token.
_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: Words that are encoded whole: beyond Latin letters and plain digits the tokenizer's own tables decide.
_UNUSUAL = re.compile("[^\x00-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]")
#: Fixed value: the tokenizer's own pattern, spelled out for Latin letters in lower case and plain digits.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f\xc0-\xd6\xd8-\xde"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


#: What a tokenizer file must say for its texts to be split as ``_PARTS`` does.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def splits_as_parts(path: str) -> bool:
    """Whether the tokenizer of a file splits texts into the parts that :class:`PartCache` looks up."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    steps = (data.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = len(steps) == 2 and steps[0] == _SPLIT and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return data.get("normalizer") == _NORMALIZER and plain and data["model"].get("end_of_word_suffix") == "</w>"


class PartCache:
    """Token ids of texts as little-endian bytes, looked up part by part.

    The tokenizer brings a text to composed lower case and splits it by a
    pattern before anything else, so its ids are those of the parts in order.
    The file is compared with that at load; texts of any other tokenizer are
    encoded whole.
    Parts are looked up in two generations of bounded size. Only parts never
    seen are tokenised, many at a time: the mark of a word's end in the
    vocabulary tells them apart again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = splits_as_parts(path)
        self.entries = ENTRIES
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, entries: int = ENTRIES) -> PartCache:
        alone(_LOADED)
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        _LOADED[path].entries = entries
        return _LOADED[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        """Parts of a text; words that only the tokenizer can split are one part each, behind a blank."""
        if text.isascii():
            return _PARTS.findall(text.lower())
        if not _UNUSUAL.search(text):
            return _PARTS.findall(unicodedata.normalize("NFC", text).lower())
        out = []
        for word in text.split():
            out += [" " + word] if _UNUSUAL.search(word) else self._split(word)
        return out

    def _learn(self, parts: Iterable[str]) -> None:
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}
        absent = set(parts).difference(self.new)
        unseen = absent.difference(self.old)
        for part in absent.difference(unseen):
            self.new[part] = self.old[part]
        single = [p for p in unseen if p[0] == " "]
        plain = list(unseen.difference(single))
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(group):
                single += group
                continue
            packed, at = ids.tobytes(), 0
            for part, end in zip(group, ends.tolist(), strict=True):
                self.new[part] = packed[at:end]
                at = end
        self.new.update((part, self._whole(part)) for part in single)

    def _flush(self, waiting: list[list[str]], run: int = 50_000) -> Iterator[bytes]:
        if sum(map(len, waiting)) <= 2 * run:
            self._learn(itertools.chain.from_iterable(waiting))
            for parts in waiting:
                yield b"".join(map(self.new.__getitem__, parts))
            return
        for parts in waiting:  # a very long text: in runs, so that the table keeps its bound
            ids = []
            for i in range(0, len(parts), run):
                self._learn(parts[i : i + run])
                ids.append(b"".join(map(self.new.__getitem__, parts[i : i + run])))
            yield b"".join(ids)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; parts are looked up for some ten thousands at a time."""
        if not self.by_parts:
            yield from map(self._whole, texts)
            return
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            if odd := _ODD.search(text):
                yield from self._flush(waiting)
                yield self._whole(text)
            else:
                waiting.append(self._split(text))
                size += len(waiting[-1])
                if size > 50_000:
                    yield from self._flush(waiting)
            if odd or size > 50_000:
                waiting, size = [], 0
        yield from self._flush(waiting)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, entries: int = ENTRIES) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut every ``capacity`` tokens.

    ``entries`` bounds a worker's lookup table; no result depends on it.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = PartCache.of(tokenizer_path, entries)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode_all(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, packed best-fit decreasing.

    Open bins are kept in stacks by their free room, and a bitmap of the rooms
    in use finds the tightest stack that fits.
    """
    bins = np.empty(len(lengths), "i8")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    made = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


BINS = "node long, done boolean, filled long, sequence_id long, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = pa.schema([("node", pa.int64()), ("done", pa.bool_()), ("filled", pa.int64()), ("sequence_id", pa.int64()), ("pieces", pa.list_(_PIECE))])
#: Sequence ids are level, node and number in 4, 29 and 30 bits.
_NODE, _NUMBER = 29, 30


def _pack(node: int, level: int, items: pa.Array, lengths: np.ndarray, capacity: int, full: int, hand_up: int) -> pa.Table:
    """Bins of one node. ``items``: an array of lists of pieces."""
    bins = best_fit(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    filled = np.bincount(bins, weights=lengths).astype("i8") if len(bins) else np.zeros(0, "i8")
    taken = items.take(pa.array(order))
    sizes = np.bincount(bins, weights=pa.compute.list_value_length(items).to_numpy(zero_copy_only=False)).astype("i8")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten())
    done = filled >= full
    rest = np.flatnonzero(~done)
    done[rest[np.argsort(filled[rest], kind="stable")[hand_up:]]] = True
    first = (level << (_NODE + _NUMBER)) | (node << _NUMBER)
    return pa.Table.from_arrays(
        [pa.array(np.full(len(filled), node)), pa.array(done), pa.array(filled), pa.array(first + np.arange(len(filled))), lists], schema=_BIN
    )


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each bin, with the lengths before it summed up."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        lengths = np.asarray(flat.field("length")).astype(np.int64)
        upto = np.r_[0, np.cumsum(lengths)]
        first = np.r_[0, np.cumsum(sizes)][:-1]
        offsets = upto[:-1] - np.repeat(upto[first], sizes)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([*(flat.field(f.name) for f in _PIECE), ids, pa.array(offsets)], [*(f.name for f in _PIECE), "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048, leaf_pieces: int = 100_000, fan_in: int = 8, nearly_full: float = 0.98) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed by a tree of best-fit rounds."""
    full = int(capacity * nearly_full)
    leaves = max(1, -(-pieces.count() // leaf_pieces))

    def leaf(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        n = group.num_rows
        one = pa.StructArray.from_arrays([group[f.name].combine_chunks().cast(f.type) for f in _PIECE], fields=list(_PIECE))
        items = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), one)
        return _pack(key[0].as_py(), 0, items, group["length"].to_numpy(), capacity, full, fan_in)

    def merge(level: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([("filled", "descending"), ("sequence_id", "ascending")]).combine_chunks()
            items = group["pieces"].combine_chunks().cast(pa.list_(_PIECE))
            return _pack(key[0].as_py(), level, items, group["filled"].to_numpy(), capacity, full, fan_in)

        return run

    # the rows of ``pieces`` are settled, so their numbers are too; copies of a row go to different leaves
    number = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(leaves))
    bins = settle(pieces.withColumn("node", number).groupBy("node").applyInArrow(leaf, BINS))
    done = [bins.where("done")]
    level = 0
    while leaves > 1:
        level, leaves = level + 1, -(-leaves // fan_in)
        up = bins.where(~F.col("done")).withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        bins = settle(up.groupBy("node").applyInArrow(merge(level), BINS))
        done.append(bins.where("done"))
    done.append(bins.where(~F.col("done")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("sequence_id", "pieces").mapInArrow(_placed, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, entries: int = ENTRIES, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    return pack(settle(tokenise(docs, tokenizer_path, capacity, end_id, entries)), capacity, **options)
