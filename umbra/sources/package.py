"""Zip packages: entries that are not changed keep their order, method and compressed bytes."""

from __future__ import annotations

import struct
import zlib

_END, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"


class Package:
    """Entries of a package as its central directory lists them."""

    def __init__(self, data: bytes):
        end = data.rfind(_END)
        if end < 0:
            raise ValueError("not a package")
        count, _, at = struct.unpack("<HII", data[end + 10 : end + 20])
        self.data, self.tail, self.entries = data, data[end:], {}
        for _ in range(count):
            if data[at : at + 4] != _ENTRY:
                raise ValueError("broken directory")
            lengths = struct.unpack("<HHH", data[at + 28 : at + 34])
            size = 46 + sum(lengths)
            raw = data[at + 46 : at + 46 + lengths[0]]
            flags = struct.unpack("<H", data[at + 8 : at + 10])[0]
            self.entries[raw.decode("utf-8" if flags & 0x800 else "cp437")] = data[at : at + size]
            at += size
        self.start = struct.unpack("<I", data[end + 16 : end + 20])[0]

    @property
    def names(self) -> list[str]:
        return list(self.entries)

    def _place(self, entry: bytes) -> int:
        return struct.unpack("<I", entry[42:46])[0]

    def read(self, name: str) -> bytes:
        entry = self.entries[name]
        method, size, at = struct.unpack("<H", entry[10:12])[0], struct.unpack("<I", entry[20:24])[0], self._place(entry)
        at += 30 + sum(struct.unpack("<HH", self.data[at + 26 : at + 30]))
        held = self.data[at : at + size]
        return zlib.decompress(held, -15) if method == 8 else held

    def written(self, changed: dict[str, bytes], removed: set[str]) -> bytes:
        """The package with some parts changed and some removed."""
        bounds = sorted([*(self._place(e) for e in self.entries.values()), self.start])
        after = dict(zip(bounds, bounds[1:], strict=False))
        out, directory, at = [], [], 0
        for name, entry in self.entries.items():
            if name in removed:
                continue
            place = self._place(entry)
            if name in changed:
                value = changed[name]
                deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
                held = deflate.compress(value) + deflate.flush()
                raw = entry[46 : 46 + struct.unpack("<H", entry[28:30])[0]]
                sizes = struct.pack("<HH", struct.unpack("<H", entry[8:10])[0] & 0x800, 8) + entry[12:16] + struct.pack("<III", zlib.crc32(value), len(held), len(value))
                body = _LOCAL + entry[6:8] + sizes + struct.pack("<HH", len(raw), 0) + raw + held
                entry = entry[:8] + sizes + entry[28:]
            else:
                body = self.data[place : after[place]]
            directory.append(entry[:42] + struct.pack("<I", at) + entry[46:])
            out.append(body)
            at += len(body)
        listed = b"".join(directory)
        end = self.tail[:8] + struct.pack("<HHII", len(directory), len(directory), len(listed), at) + self.tail[20:]
        return b"".join([*out, listed, end])
