"""Compound files (MS-CFB): named streams in a file system of sectors."""

from __future__ import annotations

import struct

from ..errors import malformed

_END = 0xFFFFFFFA  # this and all above are marks, not sectors


class CompoundFile:
    def __init__(self, data: bytes) -> None:
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise malformed("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or mini_shift > shift:
            raise malformed("bad sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        _, directory, _, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<8I", data, 44)
        heads = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        per = self.size // 4
        while difat < _END and n_difat:
            sector = self._sectors(difat)
            heads += [s for s in sector[: per - 1] if s < _END]
            difat, n_difat = sector[per - 1], n_difat - 1
        self.fat = [x for s in heads for x in self._sectors(s)]
        self.mini_fat = self._ints(self._chain(mini_fat)) if mini_fat < _END else []
        self.entries: dict[str, tuple[int, int]] = {}
        listing = self._chain(directory)
        root = (_END, 0)
        for at in range(0, len(listing) - 127, 128):
            length, kind = struct.unpack_from("<HB", listing, at + 64)
            start, size = struct.unpack_from("<IQ", listing, at + 116)
            name = listing[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF if shift == 9 else size))
        self.mini = self._chain(root[0])[: root[1]] if root[0] < _END else b""

    def names(self) -> list[str]:
        return list(self.entries)

    def stream(self, name: str) -> bytes | None:
        found = next((v for k, v in self.entries.items() if k.lower() == name.lower()), None)
        if found is None:
            return None
        start, size = found
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < _END and start < len(self.mini_fat) and seen <= len(self.mini_fat):
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start, seen = self.mini_fat[start], seen + 1
        return b"".join(out)[:size]

    def _sectors(self, sector: int) -> list[int]:
        at = (sector + 1) * self.size
        return self._ints(self.data[at : at + self.size])

    @staticmethod
    def _ints(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def _chain(self, sector: int) -> bytes:
        out, seen = [], 0
        while sector < _END:
            if sector >= len(self.fat) or seen > len(self.fat) or (sector + 1) * self.size >= len(self.data):
                raise malformed("broken sector chain")
            out.append(self.data[(sector + 1) * self.size : (sector + 2) * self.size])
            sector, seen = self.fat[sector], seen + 1
        return b"".join(out)
