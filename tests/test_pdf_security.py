"""PDF files under the standard security handler: opened with an empty password, refused with another."""

import struct
from hashlib import md5, sha256

import pytest

from leafspark import convert
from leafspark.errors import ConvertError
from leafspark.readers import pdf_security as S

from . import fixtures as X

PAGE = [(30, 500, 12, "The gauge was moved in spring.")]
IDENTITY, OWNER, RIGHTS = bytes(range(16)), bytes(range(100, 132)), -1340


def test_ciphers():
    """Published vectors of AES and RC4."""
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, sealed in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = S.Aes(bytes(range(size)))
        assert aes.encrypt(plain, bytes(16)).hex() == sealed
        assert aes.decrypt(bytes.fromhex(sealed), bytes(16)) == plain
    chained = S.Aes(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"))
    first = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    sealed = chained.encrypt(first, bytes(range(16)))
    assert sealed.hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"
    assert chained.decrypt(sealed, bytes(range(16))) == first
    assert S.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def padded(stream):
    fill = 16 - len(stream) % 16
    return stream + bytes([fill]) * fill


def written(version, revision, password=b""):
    """The page in a file that ``password`` opens."""
    entries = f"/Filter/Standard/V {version}/R {revision}/P {RIGHTS}/O<{OWNER.hex()}>"
    if version == 5:
        check, salt, key = b"checksal", b"keysaltx", bytes(range(50, 82))
        digest = S._hardened if revision == 6 else lambda s: sha256(password + s).digest()
        user = (digest(check) if not password else bytes(32)) + check + salt
        entries += f"/U<{user.hex()}>/UE<{S.Aes(digest(salt)).encrypt(key, bytes(16)).hex()}>/CF<</Own<</CFM/AESV3>>>>/StmF/Own/StrF/Own"
        seal = lambda number, stream: IDENTITY + S.Aes(key).encrypt(padded(stream), IDENTITY)
    else:
        size = 5 if revision == 2 else 16
        fill = (password + S._FILL)[:32]
        key = md5(fill + OWNER + struct.pack("<i", RIGHTS) + IDENTITY).digest()
        for _ in range(50 * (revision > 2)):
            key = md5(key[:size]).digest()
        key = key[:size]
        user = S.rc4(key, S._FILL)
        if revision > 2:
            user = md5(S._FILL + IDENTITY).digest()
            for k in range(20):
                user = S.rc4(bytes(c ^ k for c in key), user)
            user += bytes(16)
        entries += f"/U<{user.hex()}>/Length {8 * size}"
        entries += "/CF<</StdCF<</CFM/AESV2>>>>/StmF/StdCF/StrF/StdCF" if version == 4 else ""

        def seal(number, stream):
            own = key + struct.pack("<I", number)[:3] + b"\0\0"
            if version < 4:
                return S.rc4(md5(own).digest()[: min(16, size + 5)], stream)
            return IDENTITY + S.Aes(md5(own + b"sAlT").digest()).encrypt(padded(stream), IDENTITY)

    trailer = f"/ID[<{IDENTITY.hex()}><{IDENTITY.hex()}>]/Encrypt<<{entries}>>"
    return X.typed(PAGE, seal=seal, trailer=trailer.encode())


HANDLERS = [(1, 2), (2, 3), (4, 4), (5, 5), (5, 6)]


@pytest.mark.parametrize(("version", "revision"), HANDLERS)
def test_empty_password(version, revision):
    data = written(version, revision)
    assert b"gauge" not in data
    assert convert.to_pages(data) == [(1, convert.to_pages(X.typed(PAGE))[0][1])]
    broken = data.replace(b"startxref", b"startnone")
    assert convert.to_markdown(broken) == convert.to_markdown(data)


@pytest.mark.parametrize(("version", "revision"), HANDLERS)
def test_password(version, revision):
    with pytest.raises(ConvertError) as e:
        convert.to_markdown(written(version, revision, b"secret"))
    assert e.value.code == "encrypted"


def test_broken_content():
    """A page that cannot be read to its end fails the document."""
    for tail in (b" << /Kind", b" [ (cut", b" << /Kind /A ET >> Tj"):
        with pytest.raises(ConvertError) as e:
            convert.to_markdown(X.typed(PAGE, seal=lambda number, stream, tail=tail: stream + tail))
        assert e.value.code == "malformed"
