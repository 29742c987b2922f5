"""Compound files (the container of embedded objects): streams by name, and MathML in raw bytes."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END = 0xFFFFFFFA  # from here on a sector number is a mark


class CompoundFile:
    """Directory and streams of a compound file; malformed chains end early instead of looping."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        big, small = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << big, 1 << small
        first_dir, self.cutoff, first_mini, first_difat = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < END]
        seen = set()
        while first_difat < END and first_difat not in seen:
            seen.add(first_difat)
            block = self._words(self._sector(first_difat))
            tables += [s for s in block[:-1] if s < END]
            first_difat = block[-1] if block else END
        self.fat = [w for s in tables for w in self._words(self._sector(s))]
        self.mini_fat = self._words(self._chain(first_mini))
        self.entries = list(self._directory(self._chain(first_dir)))
        self.mini = self._chain(self.entries[0][1]) if self.entries else b""

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    @staticmethod
    def _words(block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))

    def _chain(self, n: int, fat: list[int] | None = None) -> bytes:
        out, seen, table = [], set(), self.fat if fat is None else fat
        while n < END and n not in seen:
            seen.add(n)
            out.append(self._sector(n) if fat is None else self.mini[n * self.mini_size : (n + 1) * self.mini_size])
            n = table[n] if n < len(table) else END
        return b"".join(out)

    @staticmethod
    def _directory(block: bytes):
        for at in range(0, len(block) - 127, 128):
            length = struct.unpack_from("<H", block, at + 64)[0]
            name = block[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            yield name, struct.unpack_from("<I", block, at + 116)[0], struct.unpack_from("<I", block, at + 120)[0], block[at + 66]

    def stream(self, wanted) -> bytes | None:
        """The first stream whose name satisfies ``wanted``."""
        for name, start, length, kind in self.entries:
            if kind == 2 and wanted(name):
                return self._chain(start, None if length >= self.cutoff else self.mini_fat)[:length]
        return None


def equation_stream(data: bytes) -> bytes | None:
    return CompoundFile(data).stream(lambda n: "Equation Native" in n or n.replace(" ", "") == "EquationNative")


def _decoded(data: bytes) -> str:
    """UTF-8, or UTF-16 where the zero bytes of a tag say so.

    Of its two byte orders the one with more tags is right: where only ASCII stands both read the same, else the wrong one loses some.
    """
    found = []
    for encoding in ("utf-16-le", "utf-16-be"):
        at = data.find("<math".encode(encoding))
        if at >= 0:
            # as raw bytes before may be odd in number
            found.append(data[at % 2 :].decode(encoding, "ignore"))
    return max(found, key=lambda t: t.count("<") + t.count(">")) if found else data.decode("utf-8", "ignore")


def mathml(data: bytes | None) -> str | None:
    """MathML of a stream named so, else between the first ``<math`` and the last ``</math>`` of the raw bytes."""
    try:
        held = CompoundFile(data or b"").stream(lambda n: "mathml" in n.lower())
    except (ValueError, struct.error, IndexError):
        held = None
    text = _decoded(held or data or b"")
    start, end = text.find("<math"), text.rfind("</math>")
    if held:
        return text if start < 0 else text[start : end + 7] if end > start else text[start:]
    return text[start : end + 7] if 0 <= start < end else None
