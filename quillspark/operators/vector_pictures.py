"""Windows metafiles: their size, and the bitmaps they hold as PNG.

The records are walked once, every read bounded by the input.  Many previews are one bitmap in a metafile: the largest one is
written as PNG, from its rows or, where it is a PNG already, as it is.  Pictures made by drawing records alone have none and stay as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructType

# Signatures, and where in a record the bitmap or the place of its parts stands, by record type.
PLACEABLE, EMF, PNG = b"\xd7\xcd\xc6\x9a", b"\x01\x00\x00\x00", b"\x89PNG\r\n\x1a\n"
WMF_BITMAPS = {0x0F43: 22, 0x0B41: 20, 0x0940: 16, 0x0D33: 18}
EMF_BITMAPS = {80: 48, 81: 48, 76: 84, 77: 84}
#: Pixels of a bitmap that is read.
MOST = 64 << 20


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width: int, height: int, rows: list[bytes]) -> bytes:
    data = zlib.compress(b"".join(b"\0" + r for r in rows), 6)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def bitmap(info: bytes, bits: bytes | None = None) -> tuple[int, bytes] | None:
    """Area and PNG of a device independent bitmap; ``bits`` where its rows stand apart."""
    size, width, height, _, depth, packed, _, _, _, used = struct.unpack_from("<IiiHHIIiiI", info)
    if size < 40 or width <= 0 or not height or width * abs(height) > MOST:
        return None
    colours = used or (1 << depth if depth <= 8 else 0)
    palette = info[size : size + 4 * colours] if depth <= 8 else b""
    bits = info[size + 4 * colours + (12 if packed == 3 and size == 40 else 0) :] if bits is None else bits
    if packed == 5 and bits.startswith(PNG):
        return width * abs(height), bits
    if depth not in (1, 4, 8, 24, 32) or packed not in (0, 3):
        return None
    stride = (width * depth + 31) // 32 * 4
    if len(bits) < stride * abs(height) or len(palette) < 4 * (colours if depth <= 8 else 0):
        return None
    rows = []
    for y in range(abs(height)):
        row = bits[y * stride : (y + 1) * stride]
        if depth >= 24:
            step = depth // 8
            out = bytearray(3 * width)
            for k in range(3):  # blue comes first
                out[k::3] = row[2 - k : width * step : step]
        else:
            per, mask = 8 // depth, (1 << depth) - 1
            index = [(row[x // per] >> (8 - depth * (x % per + 1))) & mask for x in range(width)]
            out = b"".join(palette[4 * i : 4 * i + 3][::-1] if i < colours else b"\0\0\0" for i in index)
        rows.append(bytes(out))
    return width * abs(height), png(width, abs(height), rows[::-1] if height > 0 else rows)


def _wmf(data: bytes, at: int) -> Iterator[tuple[int, bytes] | None]:
    at += 18
    while at + 6 <= len(data):
        words, kind = struct.unpack_from("<IH", data, at)
        end = at + 2 * words
        if words < 3 or end > len(data):
            return
        if kind in WMF_BITMAPS:
            yield bitmap(data[at + 6 + WMF_BITMAPS[kind] : end])
        at = end


def _emf(data: bytes) -> Iterator[tuple[int, bytes] | None]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or at + size > len(data):
            return
        record = data[at : at + size]
        if kind in EMF_BITMAPS and EMF_BITMAPS[kind] + 16 <= size:
            info, n_info, bits, n_bits = struct.unpack_from("<IIII", record, EMF_BITMAPS[kind])
            if n_info and n_bits:
                yield bitmap(record[info : info + n_info], record[bits : bits + n_bits])
        at += size


def described(data: bytes | None) -> tuple[str | None, float | None, float | None, int, bytes | None]:
    """``(kind, width, height, bitmaps, png)``: sizes in points where the file tells them; never fails."""
    data = data or b""
    kind, sides, found = None, (None, None), []
    try:
        if data.startswith(PLACEABLE):
            left, top, right, bottom, inch = struct.unpack_from("<hhhhH", data, 6)
            kind, sides = "wmf", tuple(abs(a) * 72 / inch for a in (right - left, bottom - top)) if inch else sides
            records = _wmf(data, 22)
        elif data.startswith(EMF) and data[40:44] == b" EMF":
            left, top, right, bottom = struct.unpack_from("<iiii", data, 24)
            kind, sides = "emf", tuple(abs(a) * 72 / 2540 for a in (right - left, bottom - top))
            records = _emf(data)
        elif data[:4] in (b"\x01\x00\x09\x00", b"\x02\x00\x09\x00"):
            kind, records = "wmf", _wmf(data, 0)
        else:
            records = iter(())
        for b in records:
            if b:
                found.append(b)
    except (struct.error, ValueError, OverflowError):
        pass
    return kind, *sides, len(found), max(found, key=lambda b: b[0])[1] if found else None


SCHEMA = StructType().add("kind", StringType()).add("width", DoubleType()).add("height", DoubleType()).add("bitmaps", IntegerType()).add("png", BinaryType())


@F.pandas_udf(SCHEMA)
def vector_picture(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([described(d) for d in data], columns=SCHEMA.names)


def pngs(parts: DataFrame) -> DataFrame:
    """``sha1, png`` of the vector pictures among ``parts(part, data)`` that hold a bitmap, equal ones once."""
    vectors = parts.where(F.col("part").rlike(r"(?i)\Aword/media/.*\.(wmf|emf)\z")).select(F.sha1("data").alias("sha1"), "data")
    made = vectors.groupBy("sha1").agg(F.first("data").alias("data")).select("sha1", vector_picture("data").alias("v"))
    return made.select("sha1", "v.png").where("png IS NOT NULL")
