"""The standard security handler of PDF, for files that an empty user password opens.

Only streams are decrypted: no string outside of them bears text. Files with another handler, or with a password, are
``encrypted`` errors.
"""

from __future__ import annotations

import struct
from hashlib import md5, sha256, sha384, sha512

from ..errors import ConvertError

#: Fixed value of the PDF standard: what fills a password up to 32 bytes.
_FILL = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(data), 0, 0
    for at, c in enumerate(data):
        i = (i + 1) & 255
        a = box[i]
        j = (j + a) & 255
        b = box[i] = box[j]
        box[j] = a
        out[at] = c ^ box[(a + b) & 255]
    return bytes(out)


def _field() -> tuple[list[int], dict[int, int]]:
    """Powers of 3 in the field of AES, and their exponents."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x ^= (x << 1) ^ (0x11B if x & 128 else 0)
    return powers, {p: k for k, p in enumerate(powers)}


_POWERS, _EXPONENTS = _field()


def _product(a: int, b: int) -> int:
    return _POWERS[(_EXPONENTS[a] + _EXPONENTS[b]) % 255] if a and b else 0


def _substituted(x: int) -> int:
    inverse = _POWERS[-_EXPONENTS[x] % 255] if x else 0
    spread = 0
    for k in range(5):
        spread ^= inverse << k
    return (spread & 255) ^ (spread >> 8) ^ 0x63


_BOX = [_substituted(x) for x in range(256)]
_UNBOX = [0] * 256
for _x, _y in enumerate(_BOX):
    _UNBOX[_y] = _x


def _columns(box: list[int], factors: tuple[int, int, int, int]) -> list[list[int]]:
    """For each of a column's four bytes, its share of the column after substitution and mixing."""
    first = [sum(_product(s, f) << shift for f, shift in zip(factors, (24, 16, 8, 0), strict=True)) for s in box]
    return [[(w >> 8 * k | w << 32 - 8 * k) & 0xFFFFFFFF for w in first] for k in range(4)]


_FORWARD, _BACKWARD = _columns(_BOX, (2, 1, 1, 3)), _columns(_UNBOX, (14, 9, 13, 11))


class Aes:
    """AES with a key of 16 or 32 bytes, in cipher block chaining."""

    def __init__(self, key: bytes) -> None:
        words, n, round_constant = list(struct.unpack(f">{len(key) // 4}I", key)), len(key) // 4, 1
        while len(words) < 4 * (n + 7):
            w = words[-1]
            if len(words) % n == 0:
                w = self._boxed((w << 8 | w >> 24) & 0xFFFFFFFF) ^ round_constant << 24
                round_constant = _product(round_constant, 2)
            elif n > 6 and len(words) % n == 4:
                w = self._boxed(w)
            words.append(words[-n] ^ w)
        self.keys = [words[k : k + 4] for k in range(0, len(words), 4)]
        b = _BACKWARD
        unmixed = [[b[0][_BOX[w >> 24]] ^ b[1][_BOX[w >> 16 & 255]] ^ b[2][_BOX[w >> 8 & 255]] ^ b[3][_BOX[w & 255]] for w in k] for k in self.keys[1:-1]]
        self.back = [self.keys[-1], *unmixed[::-1], self.keys[0]]

    @staticmethod
    def _boxed(w: int) -> int:
        return _BOX[w >> 24] << 24 | _BOX[w >> 16 & 255] << 16 | _BOX[w >> 8 & 255] << 8 | _BOX[w & 255]

    @staticmethod
    def _block(s: list[int], keys: list[list[int]], tables: list[list[int]], box: list[int], step: int) -> list[int]:
        """One block; rows are shifted by ``step`` columns each."""
        ta, tb, tc, td = tables
        s = [x ^ k for x, k in zip(s, keys[0], strict=True)]
        turns = [(c, (c + step) % 4, (c + 2) % 4, (c - step) % 4) for c in range(4)]
        for key in keys[1:-1]:
            s = [ta[s[e] >> 24] ^ tb[s[f] >> 16 & 255] ^ tc[s[g] >> 8 & 255] ^ td[s[h] & 255] ^ k for (e, f, g, h), k in zip(turns, key, strict=True)]
        return [(box[s[e] >> 24] << 24 | box[s[f] >> 16 & 255] << 16 | box[s[g] >> 8 & 255] << 8 | box[s[h] & 255]) ^ k for (e, f, g, h), k in zip(turns, keys[-1], strict=True)]

    def encrypt(self, data: bytes, start: bytes) -> bytes:
        """Whole blocks, without padding."""
        last, out = struct.unpack(">4I", start), []
        for block in struct.iter_unpack(">4I", data):
            last = self._block([x ^ y for x, y in zip(block, last, strict=True)], self.keys, _FORWARD, _BOX, 1)
            out.append(struct.pack(">4I", *last))
        return b"".join(out)

    def decrypt(self, data: bytes, start: bytes) -> bytes:
        """Whole blocks, the padding left in place."""
        last, out = struct.unpack(">4I", start), []
        for block in struct.iter_unpack(">4I", data[: len(data) // 16 * 16]):
            out.append(struct.pack(">4I", *[x ^ y for x, y in zip(self._block(list(block), self.back, _BACKWARD, _UNBOX, -1), last, strict=True)]))
            last = block
        return b"".join(out)


def _hardened(salt: bytes) -> bytes:
    """The hash of revision 6 of an empty password."""
    key, rounds, made = sha256(salt).digest(), 0, b"\0"
    while rounds < 64 or made[-1] > rounds - 32:
        made = Aes(key[:16]).encrypt(key * 64, key[16:32])
        key = (sha256, sha384, sha512)[sum(made[:16]) % 3](made).digest()
        rounds += 1
    return key[:32]


class Security:
    """What decrypts the streams of a file; a ConvertError where the empty password does not open it."""

    def __init__(self, entries: dict, identity: bytes) -> None:
        try:
            self.version, revision = entries.get("V", 0), entries["R"]
            if entries.get("Filter") != "Standard" or self.version not in (1, 2, 4, 5):
                raise ValueError
            self.method = self._method(entries)
            self.key = self._modern(entries, revision) if self.version == 5 else self._classic(entries, revision, identity)
        except (KeyError, ValueError, TypeError, AttributeError, IndexError, struct.error):
            raise ConvertError("encrypted", "the document is password protected") from None

    def _method(self, entries: dict) -> str | None:
        if self.version < 4:
            return "V2"
        name = entries.get("StmF", "Identity")
        method = "None" if name == "Identity" else entries["CF"][name].get("CFM", "None")
        if method not in ("None", "V2", "AESV2", "AESV3"):
            raise ValueError
        return None if method == "None" else str(method)

    @staticmethod
    def _classic(entries: dict, revision: int, identity: bytes) -> bytes:
        size = 5 if revision == 2 else 16 if entries["V"] == 4 else int(entries.get("Length", 40)) // 8
        plain = b"\xff" * 4 if revision >= 4 and entries.get("EncryptMetadata") is False else b""
        key = md5(_FILL + entries["O"][:32] + struct.pack("<I", entries["P"] & 0xFFFFFFFF) + identity + plain).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            proof, shown = rc4(key, _FILL), entries["U"]
        else:
            proof, shown = md5(_FILL + identity).digest(), entries["U"][:16]
            for k in range(20):
                proof = rc4(bytes(c ^ k for c in key), proof)
        if proof != shown:
            raise ValueError
        return key

    @staticmethod
    def _modern(entries: dict, revision: int) -> bytes:
        digest = _hardened if revision >= 6 else lambda salt: sha256(salt).digest()
        user = entries["U"]
        if digest(user[32:40]) != user[:32]:
            raise ValueError
        return Aes(digest(user[40:48])).decrypt(entries["UE"][:32], bytes(16))

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        """The stream of an object, decrypted."""
        if self.method is None:
            return data
        key = self.key
        if self.method != "AESV3":
            own = struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2]
            key = md5(key + own + (b"sAlT" if self.method == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
        if self.method == "V2":
            return rc4(key, data)
        if len(data) < 32:
            return b""
        out = Aes(key).decrypt(data[16:], data[:16])
        return out[: -out[-1]] if 1 <= out[-1] <= 16 else out
