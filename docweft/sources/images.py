"""Pixels of PNG and BMP images: decoded, brought to size and turned into tensors inside Arrow-fed tasks.

An image is one task's work at a time and has at most ``MAX_PIXELS``; what
leaves the task are bands of rows, so no row is larger than a band.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pixels of an image that is decoded; larger ones are error rows.
MAX_PIXELS = 64_000_000
#: The longer side of a page, the height and greatest width of a patch.
MAX_SIDE, PATCH_HEIGHT, PATCH_WIDTH = 1536, 48, 320
#: Rows of a band.
BAND = 32
#: Values of tensors that a task gathers before it passes rows on.
GATHERED = 1 << 20
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the passes of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(data: memoryview, rows: int, size: int, wide: int) -> np.ndarray:
    """Rows of bytes from rows that tell how they differ from what stands left and above."""
    out = np.zeros((rows, size), np.uint8)
    above = np.zeros(size, np.uint8)
    for y in range(rows):
        how = data[y * (size + 1)]
        row = np.frombuffer(data, np.uint8, size, y * (size + 1) + 1)
        if how == 0:
            out[y] = row
        elif how == 2:
            out[y] = row + above
        elif how == 1:
            padded = np.zeros(-(-size // wide) * wide, np.uint8)
            padded[:size] = row
            out[y] = np.add.accumulate(padded.reshape(-1, wide), axis=0, dtype=np.uint8).ravel()[:size]
        elif how in (3, 4):
            left, mine, over = [0] * wide, row.tolist(), above.tolist()
            corner, got = [0] * wide, []
            for i, x in enumerate(mine):
                a, b, c = left[i % wide], over[i], corner[i % wide]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                got.append((x + guess) & 255)
                left[i % wide], corner[i % wide] = got[-1], b
            out[y] = got
        else:
            raise ValueError("unknown filter of a row")
        above = out[y]
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples of rows of bytes, as they are for palettes and less than 8 bits, else in 8 bits."""
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        wide = rows.reshape(len(rows), width, channels, 2).astype(np.uint32)
        return ((wide[..., 0] * 256 + wide[..., 1] + 128) // 257).astype(np.uint8)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head, ended = 8, [], None, None, False
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if head is None or not ended:
        raise ValueError("cut off")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or depth < 8 and colour not in (0, 3):
        raise ValueError("unknown colour type")
    _check(width, height)
    channels = _CHANNELS[colour]
    raw = memoryview(zlib.decompress(b"".join(packed)))
    wide = max(1, channels * depth // 8)
    out = np.zeros((height, width, channels), np.uint8)
    place = 0
    for x, y, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        columns, rows = -(-(width - x) // dx), -(-(height - y) // dy)
        if columns <= 0 or rows <= 0:
            continue
        size = (columns * channels * depth + 7) // 8
        part = raw[place : place + rows * (size + 1)]
        if len(part) < rows * (size + 1):
            raise ValueError("cut off")
        out[y::dy, x::dx] = _samples(_unfiltered(part, rows, size, wide), columns, channels, depth)
        place += rows * (size + 1)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("no such colour in the palette")
        return palette[out[..., 0]]
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return np.repeat(out[..., :1], 3, axis=2) if channels < 3 else out[..., :3]


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, bits, packing = struct.unpack("<10xIIiiHHI", data[:34])
    down, height = height < 0, abs(height)
    _check(width, height)
    if size < 40 or packing != 0 or bits not in (8, 24, 32):
        raise ValueError("unsupported kind of BMP")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * height, start).reshape(height, step)[:, : width * bits // 8].reshape(height, width, bits // 8)
    if bits == 8:
        used = struct.unpack("<I", data[46:50])[0] or 256
        colours = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)
        rows = colours[rows[..., 0]]
    return (rows if down else rows[::-1])[..., 2::-1]


def _check(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ValueError("no pixels")
    if width * height > MAX_PIXELS:
        raise ValueError("too many pixels")


def decode(data: bytes) -> np.ndarray:
    """height x width x 3 of a PNG or BMP image, without transparency; ValueError for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"damaged image: {type(e).__name__}") from e
    raise ValueError("unsupported kind of image")


def limited(width: int, height: int, limit: int = MAX_SIDE) -> tuple[int, int]:
    """Width and height with the longer side cut to a limit, rounded half up, at least 1."""
    longest = max(width, height)
    if limit <= 0 or longest <= limit:
        return width, height
    scale = np.float32(limit) / np.float32(longest)
    side = lambda x: max(1, int(np.floor(np.float32(x) * scale + np.float32(0.5))))
    return side(width), side(height)


def _weights(size: int, new: int) -> np.ndarray:
    """How much each of ``size`` samples counts for each of ``new`` ones: a triangle as wide as a new sample, or an old one if that is wider."""
    ratio = size / new
    wide = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    low = np.clip(np.floor(centre - wide), 0, size - 1)
    high = np.clip(np.ceil(centre + wide), low + 1, size)
    at = np.arange(size)
    w = np.maximum(0.0, 1.0 - np.abs((at[None] - (centre[:, None] - 0.5)) / wide))
    w[(at[None] < low[:, None]) | (at[None] >= high[:, None])] = 0.0
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


#: Weights of small images, of which tables may hold very many of few sizes: at most 256 KB each.
_small_weights = lru_cache(64)(_weights)


def _weights_for(size: int, new: int) -> np.ndarray:
    return (_small_weights if size * new <= 1 << 16 else _weights)(size, new)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels brought to a size, first down and then across, rounded once."""
    if pixels.shape[:2] == (height, width):
        return pixels
    down = np.tensordot(_weights_for(pixels.shape[0], height), pixels.astype(np.float32), (1, 0))
    both = np.tensordot(_weights_for(pixels.shape[1], width), down, (1, 1)).transpose(1, 0, 2)
    return np.floor(np.clip(both, 0, 255) + np.float32(0.5)).astype(np.uint8)


def tensor(pixels: np.ndarray) -> np.ndarray:
    """channels x height x width, 0 to 1."""
    return np.ascontiguousarray(pixels.transpose(2, 0, 1)).astype(np.float32) / np.float32(255)


def crop(pixels: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x1, y1, x2, y2 = box
    if x2 <= x1 or y2 <= y1:
        raise ValueError("crop has no pixels")
    if x1 < 0 or y1 < 0 or x2 > pixels.shape[1] or y2 > pixels.shape[0]:
        raise ValueError("crop lies outside the image")
    return pixels[y1:y2, x1:x2]


def projected(box: tuple[float, float, float, float], scale: tuple[float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """A box of the original image in the resized one; ValueError if nothing of it is there."""
    f = np.float32
    x1, y1, x2, y2 = (f(v) / f(s) for v, s in zip(box, (*scale, *scale), strict=True))
    out = (int(np.clip(np.floor(x1), 0, width - 1)), int(np.clip(np.floor(y1), 0, height - 1)), int(np.clip(np.ceil(x2), 1, width)), int(np.clip(np.ceil(y2), 1, height)))
    if out[2] <= out[0] or out[3] <= out[1]:
        raise ValueError("box is empty")
    return out


TENSORS = "doc_id string, width int, height int, resized_width int, resized_height int, scale_x float, scale_y float, channel int, y int, rows int, values array<float>, error string"
_FIELDS = pa.schema(
    [("doc_id", pa.string()), *((n, pa.int32()) for n in ("width", "height", "resized_width", "resized_height")), ("scale_x", pa.float32()), ("scale_y", pa.float32()), *((n, pa.int32()) for n in ("channel", "y", "rows"))]
    + [("values", pa.list_(pa.float32())), ("error", pa.string())]
)


def _rows(rows: list[tuple], values: list[np.ndarray | None], fields: pa.Schema) -> pa.RecordBatch:
    """Rows (all columns but ``values``) as a batch; their values are laid end to end, those of a row without any are null."""
    columns = dict(zip((n for n in fields.names if n != "values"), zip(*rows, strict=True), strict=True))
    sizes = np.array([0, *(0 if v is None else v.size for v in values)], np.int64)
    offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.array([*(v is None for v in values), False]))
    flat = np.concatenate([np.empty(0, np.float32), *(v.ravel() for v in values if v is not None)])
    listed = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))
    return pa.record_batch([listed if f.name == "values" else pa.array(columns[f.name], f.type) for f in fields], schema=fields)


def page_tensors(images: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """Images (doc_id, content) as tensors: a row for each channel and band of ``BAND`` rows, or one with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray | None] = []
            gathered = 0
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pixels = decode(content.as_py() or b"")
                    height, width = pixels.shape[:2]
                    new = limited(width, height, max_side)
                    values = tensor(resize(pixels, *new))
                except ValueError as e:
                    rows.append((doc_id, *(None,) * 9, f"image: {e}"))
                    held.append(None)
                    continue
                head = (doc_id, width, height, *new, width / new[0], height / new[1])
                for channel in range(3):
                    for y in range(0, new[1], BAND):
                        band = values[channel, y : y + BAND]
                        rows.append((*head, channel, y, len(band), None))
                        held.append(band)
                        gathered += band.size
                        if gathered >= GATHERED:
                            yield _rows(rows, held, _FIELDS)
                            rows, held, gathered = [], [], 0
            if rows:
                yield _rows(rows, held, _FIELDS)

    return images.select("doc_id", "content").mapInArrow(run, TENSORS)


PATCHES = "doc_id string, patch_index int, box_index int, width int, height int, channels int, values array<float>, error string"
_PATCH = pa.schema([("doc_id", pa.string()), *((n, pa.int32()) for n in ("patch_index", "box_index", "width", "height", "channels")), ("values", pa.list_(pa.float32())), ("error", pa.string())])


def patch_tensors(images: DataFrame, max_side: int = MAX_SIDE, patch_height: int = PATCH_HEIGHT, patch_width: int = PATCH_WIDTH) -> DataFrame:
    """A tensor for each box of an image (doc_id, content, boxes in the pixels of the original), or a row with an error.

    Boxes of which nothing lies in the image have no patch, and patches are
    numbered without them; ``box_index`` is the place of the box.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content, boxes in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    pixels = decode(content.as_py() or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id.as_py(), "error": f"image: {e}"}], _PATCH)
                    continue
                height, width = pixels.shape[:2]
                new = limited(width, height, max_side)
                pixels = resize(pixels, *new)
                number = 0
                for k, b in enumerate(boxes.as_py() or []):
                    try:
                        own = crop(pixels, projected((b["x1"], b["y1"], b["x2"], b["y2"]), (width / new[0], height / new[1]), *new))
                    except ValueError:
                        continue
                    wide = np.float32(own.shape[1]) / np.float32(own.shape[0]) * np.float32(patch_height)
                    wide = int(np.clip(np.floor(wide + np.float32(0.5)), 1, patch_width))
                    row = {"doc_id": doc_id.as_py(), "patch_index": number, "box_index": k, "width": wide, "height": patch_height, "channels": 3, "values": tensor(resize(own, wide, patch_height)).ravel()}
                    yield pa.RecordBatch.from_pylist([row], _PATCH)
                    number += 1

    return images.select("doc_id", "content", "boxes").mapInArrow(run, PATCHES)
