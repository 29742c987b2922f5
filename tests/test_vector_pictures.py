"""Bitmaps in metafiles: every depth and row order, both kinds of file, and damage."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import vector_pictures as V

COLOURS = [(1, 2, 3), (250, 0, 9), (7, 7, 7)]


def pixels(png):
    """The rows of a PNG as this module writes it."""
    assert png.startswith(V.PNG) and png[12:16] == b"IHDR"
    width, height = struct.unpack_from(">II", png, 16)
    n = struct.unpack_from(">I", png, 33)[0]
    data = zlib.decompress(png[41 : 41 + n])
    assert png[41 + n : 45 + n] == struct.pack(">I", zlib.crc32(png[37 : 41 + n]))
    step = 3 * width + 1
    return [[tuple(data[y * step + 1 + 3 * x :][:3]) for x in range(width)] for y in range(height)]


def dib(image, depth, down=False):
    width, height = len(image[0]), len(image)
    head = struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, depth, 0, 0, 0, 0, len(COLOURS) if depth <= 8 else 0, 0)
    palette = b"".join(bytes((b, g, r, 0)) for r, g, b in COLOURS) if depth <= 8 else b""
    rows = []
    for row in image:
        if depth >= 24:
            line = b"".join(bytes((b, g, r, 0)[: depth // 8]) for r, g, b in row)
        else:
            bits = "".join(format(COLOURS.index(p), f"0{depth}b") for p in row)
            line = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        rows.append(line.ljust(-(-len(line) // 4) * 4, b"\0"))
    return head + palette, b"".join(rows if down else rows[::-1])


def wmf(*records, placeable=True):
    head = V.PLACEABLE + struct.pack("<HhhhhHIH", 0, 0, 0, 2880, 1440, 1440, 0, 0) if placeable else b""
    body = b"".join(struct.pack("<IH", (6 + len(r)) // 2 + len(r) % 2, kind) + r + b"\0" * (len(r) % 2) for kind, r in records)
    return head + struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + body + struct.pack("<IH", 3, 0)


def emf(info, bits, kind=81):
    at = V.EMF_BITMAPS[kind]
    fixed = bytearray(at - 8) + struct.pack("<IIII", at + 16, len(info), at + 16 + len(info), len(bits))
    record = struct.pack("<II", kind, 8 + len(fixed) + len(info) + len(bits)) + fixed + info + bits
    head = struct.pack("<II", 1, 88) + struct.pack("<8i", 0, 0, 9, 9, 0, 0, 2540, 1270) + b" EMF" + bytes(44)
    return head + record + struct.pack("<II", 14, 8)


@pytest.mark.parametrize("depth", [1, 4, 8, 24, 32])
@pytest.mark.parametrize("down", [False, True])
def test_depths(depth, down):
    usable = COLOURS[:2] if depth == 1 else COLOURS
    image = [[usable[(3 * y + x) % len(usable)] for x in range(9)] for y in range(3)]
    info, bits = dib(image, depth, down)
    for kind, skip in V.WMF_BITMAPS.items():
        got = V.described(wmf((0x0103, b"12"), (kind, bytes(skip) + info + bits)))
        assert got[:4] == ("wmf", 144.0, 72.0, 1) and pixels(got[4]) == image
    for kind in V.EMF_BITMAPS:
        got = V.described(emf(info, bits, kind))
        assert got[:4] == ("emf", 72.0, 36.0, 1) and pixels(got[4]) == image


def test_the_largest_counts():
    small, large = ([[COLOURS[k]] * n] for k, n in ((0, 2), (1, 5)))
    records = [(0x0F43, bytes(22) + b"".join(dib(x, 24))) for x in (small, large, small)]
    got = V.described(wmf(*records, placeable=False))
    assert got[:4] == ("wmf", None, None, 3) and pixels(got[4]) == large
    assert V.described(wmf((0x0103, b"12")))[3:] == (0, None)
    assert V.described(b"no picture") == V.described(None) == V.described(b"") == (None, None, None, 0, None)


@given(st.binary(max_size=120), st.integers(0, 200), st.booleans())
@settings(max_examples=300, deadline=None)
def test_damage_never_raises(noise, at, is_emf):
    info, bits = dib([[COLOURS[0]] * 3], 8)
    whole = emf(info, bits) if is_emf else wmf((0x0F43, bytes(22) + info + bits))
    for data in (whole[:at] + noise + whole[at:], whole[:at], whole[:at] + noise, whole[:at] + bytes(b ^ 255 for b in whole[at : at + 4]) + whole[at + 4 :]):
        assert len(V.described(data)) == 5
