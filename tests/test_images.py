"""Pixels: every kind of PNG and BMP, sizes beside a plain filter, patches, and what can't be decoded."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from docweft.sources import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples, colour, depth, filters=(0,), palette=None, interlaced=False):
    """An image of height x width x channels samples; rows take the filters in turn."""
    h, w, channels = samples.shape
    wide = max(1, channels * depth // 8)
    packed = b""
    for x, y, dx, dy in images._PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        bits = "".join if depth < 8 else None
        rows = []
        for row in part:
            if bits:
                text = "".join(f"{v:0{depth}b}" for v in row.ravel().tolist())
                text += "0" * (-len(text) % 8)
                rows.append(bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)))
            else:
                rows.append(b"".join(int(v).to_bytes(depth // 8, "big") for v in row.ravel()))
        above = bytes(len(rows[0]))
        for k, row in enumerate(rows):
            how = filters[k % len(filters)]
            out = bytearray()
            for i, v in enumerate(row):
                a, b, c = row[i - wide] if i >= wide else 0, above[i], above[i - wide] if i >= wide else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, paeth)[how]) & 255)
            packed += bytes([how]) + bytes(out)
            above = row
    data = zlib.compress(packed)
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[: len(data) // 2]) + chunk(b"IDAT", data[len(data) // 2 :]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, depth, channels", [(0, 1, 1), (0, 2, 1), (0, 4, 1), (0, 8, 1), (0, 16, 1), (2, 8, 3), (2, 16, 3), (3, 4, 1), (3, 8, 1), (4, 8, 2), (6, 8, 4), (6, 16, 4)])
def test_png(colour, depth, channels, interlaced):
    rng = np.random.default_rng(depth)
    for h, w in ((11, 13), (1, 1), (3, 2)):
        samples = rng.integers(0, 1 << depth if colour != 3 else 7, (h, w, channels))
        palette = bytes(rng.integers(0, 256, 21).tolist()) if colour == 3 else None
        got = images.decode(png(samples, colour, depth, (0, 1, 2, 3, 4), palette, interlaced))
        if colour == 3:
            want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[..., 0]]
        else:
            whole = np.round(samples * 255 / ((1 << depth) - 1)).astype(np.uint8)
            want = np.repeat(whole[..., :1], 3, 2) if channels < 3 else whole[..., :3]
        assert (got == want).all()


def bmp(pixels, bits, down=False):
    h, w, _ = pixels.shape
    rows = []
    for row in pixels if down else pixels[::-1]:
        line = b"".join(bytes([b, g, r]) + b"\0" * (bits // 8 - 3) for r, g, b in row.tolist())
        rows.append(line + b"\0" * (-len(line) % 4))
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, 0, 0, 0, 0, 0) + b"".join(rows)


def test_bmp_and_what_cannot_be_decoded():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 3, 3))
    for bits in (24, 32):
        for down in (False, True):
            assert (images.decode(bmp(pixels, bits, down)) == pixels).all()
    whole = png(pixels, 2, 8)
    for bad in (b"", b"GIF89a", whole[:60], whole[:-12], whole[:45] + b"x" + whole[46:], bmp(pixels, 24)[:70], b"BM", struct.pack("<2s8xIIiiHHI", b"BM", 54, 40, 70_000, 70_000, 1, 24, 0)):
        with pytest.raises(ValueError):
            images.decode(bad)


def plain(pixels, width, height):
    """The filter in plain loops: down, then across, in single precision's reach."""

    def line(values, new):
        size = len(values)
        ratio = size / new
        wide = max(ratio, 1.0)
        out = []
        for o in range(new):
            centre = (o + 0.5) * ratio
            low = min(max(math.floor(centre - wide), 0), size - 1)
            high = min(max(math.ceil(centre + wide), low + 1), size)
            w = [max(0.0, 1 - abs((i - (centre - 0.5)) / wide)) for i in range(low, high)]
            out.append(sum(x * values[i] for x, i in zip(w, range(low, high), strict=True)) / sum(w))
        return out

    h, w, c = pixels.shape
    tall = [[line([float(pixels[y, x, k]) for y in range(h)], height) for k in range(c)] for x in range(w)]
    return np.array([[line([tall[x][k][y] for x in range(w)], width) for k in range(c)] for y in range(height)]).transpose(0, 2, 1)


def test_resize_against_plain_loops():
    rng = random.Random(3)
    for _ in range(25):
        pixels = np.random.default_rng(rng.random().__hash__() % 1000).integers(0, 256, (rng.randint(1, 12), rng.randint(1, 12), 3))
        width, height = rng.randint(1, 15), rng.randint(1, 15)
        off = np.abs(images.resize(pixels.astype(np.uint8), width, height) - plain(pixels, width, height))
        assert off.max() <= 0.501
    assert images.limited(3000, 1000) == (1536, 512) and images.limited(2, 10_000) == (1, 1536) and images.limited(100, 50) == (100, 50)


def test_tensors_and_patches(spark):
    pixels = np.random.default_rng(2).integers(0, 256, (70, 40, 3)).astype(np.uint8)
    rows = spark.createDataFrame([("a", bytearray(png(pixels, 2, 8))), ("b", bytearray(b"none")), ("c", None)], "doc_id string, content binary")
    got = images.page_tensors(rows, 35).orderBy("doc_id", "channel", "y").collect()
    small = images.resize(pixels, 20, 35)
    assert [(r.channel, r.y, r.rows) for r in got if r.doc_id == "a"] == [(c, y, n) for c in range(3) for y, n in ((0, 32), (32, 3))]
    values = np.concatenate([r["values"] for r in got if r.doc_id == "a"]).reshape(3, 35, 20)
    assert np.array_equal(values.astype(np.float32), images.tensor(small)) and got[0].scale_x == 2.0
    assert [r.error for r in got if r.doc_id != "a"] == ["image: unsupported kind of image"] * 2
    boxes = [(0.0, 0.0, 20.0, 10.0), (90.0, 0.0, 95.0, 5.0), (30.0, 60.0, 400.0, 400.0), (6.0, 6.0, 6.0, 6.0)]
    asked = spark.createDataFrame([("a", bytearray(png(pixels, 2, 8)), boxes), ("b", bytearray(b"x"), boxes)], "doc_id string, content binary, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>")
    out = images.patch_tensors(asked, 35, 8, 20).orderBy("doc_id", "patch_index").collect()
    assert [(r.patch_index, r.box_index, r.width) for r in out if r.doc_id == "a"] == [(0, 0, 16), (1, 1, 3), (2, 2, 8)] and [r.error for r in out if r.doc_id == "b"] == ["image: unsupported kind of image"]
    assert np.array_equal(np.array(out[0]["values"], np.float32).reshape(3, 8, 16), images.tensor(images.resize(small[0:5, 0:10], 16, 8)))
