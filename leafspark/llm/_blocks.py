"""Documents dealt into blocks, and packed messages between blocks and buckets of keys.

Operators that compare every word position of the corpus would shuffle a row per position. Instead the
documents are dealt once into blocks of a few MB of text by a hash of their id; a block packs what it has to say
about many keys into one binary message per bucket of keys, and a bucket answers with one message per
block. Keys are unique within a message, so a key that is frequent everywhere costs one entry per block.
The exchange of the documents is one node of the plan that Spark reuses for every visit to the blocks.

There is a message for every pair of block and bucket, and a bucket for eight blocks. Beyond 8192 blocks (48 GB
at 6 MB) blocks grow with the root of the corpus, and messages in proportion to it, up to blocks of eight times the
size (3 TB). From there messages get shorter as the corpus grows: at 100 TB, in blocks of 48 MB, one holds some
thirty entries, and what a row costs beside its entries is then a third of it. Rows of one id are in one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import n_blocks, shuffle_partitions

_LEAST = np.iinfo(np.int64).min


def deal(docs: DataFrame, id_col: str, text_col: str, target: int = 6 << 20) -> tuple[DataFrame, int]:
    """(doc, text, block) of every document, and the number of blocks."""
    k = n_blocks(docs, text_col, target)
    doc = F.col(id_col).cast("long")
    block = F.pmod(F.xxhash64(F.coalesce(doc, F.lit(0))), F.lit(k)).cast("int")
    return docs.select(doc.alias("doc"), F.col(text_col).cast("binary").alias("text"), block.alias("block")), k


def n_buckets(docs: DataFrame, blocks: int) -> int:
    """How many groups of keys: as many as shuffle partitions, and at least one for eight blocks."""
    return max(shuffle_partitions(docs), blocks // 8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit keys."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Block:
    """The documents of one block in order of id (null first), then of text, with their words end to end.

    ``starts``: of each document's words, and the end. ``ids``: null as the least integer. ``hashes``: of the
    words, made when asked for.
    """

    def __init__(self, docs: pa.Table, lower: bool = False) -> None:
        ids = docs.column("doc").to_pylist()
        texts = docs.column("text").to_pylist()
        keys = [_LEAST if i is None else i for i in ids]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] or b""))
        self.ids = np.array([keys[i] for i in order], np.int64)
        self.raw_ids = [ids[i] for i in order]
        self.words: list[bytes] = []
        starts = [0]
        for i in order:
            if text := texts[i]:
                self.words += (text.lower() if lower else text).split()
            starts.append(len(self.words))
        self.starts = np.array(starts, np.int64)
        self.n = len(self.words)
        self.block = docs.column("block")[0].as_py()
        self.of = np.repeat(np.arange(len(order)), np.diff(self.starts))

    def hashes(self) -> np.ndarray:
        own = dict.fromkeys(self.words)
        for w in own:
            own[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(own.__getitem__, self.words), np.uint64, self.n)

    def left(self) -> np.ndarray:
        """Words from each position to the end of its document."""
        return self.starts[1:][self.of] - np.arange(self.n)


def rolling(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the ``size`` values from each position; the last ones lack values and are not valid."""
    out = np.zeros(len(h), np.uint64)
    for k, c in enumerate(constants(size, seed)[: len(h)]):
        out[: len(h) - k] += h[k:] * c
    return mix(out)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the rank of each key among them."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], rank


def sorted_within(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """An order of (of, key): one sort of the document's number above the key's leading bits.

    Where two keys of a document differ only in the bits left out, the full comparison is made instead.
    """
    bits = max(1, int(of[-1]).bit_length()) if len(of) else 1
    short = (of.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits))
    order = np.argsort(short)
    s, k = short[order], keys[order]
    if ((s[1:] == s[:-1]) & (k[1:] != k[:-1])).any():
        return np.lexsort((keys, of))
    return order


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket below ``n`` by the upper half of a 64-bit key, so buckets rise with the key."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cells(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a sorted array, and the bounds of their entries."""
    found, first = np.unique(buckets, return_index=True)
    return found, np.append(first, len(buckets))


def message(block: int, buckets: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """One row per bucket: bucket, block and the packed entries of each array (all sorted by bucket)."""
    found, bounds = cells(buckets)
    packed = {
        name: pa.array([a[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())
        for name, a in arrays.items()
    }
    n = len(found)
    return pa.table(
        {"bucket": pa.array(found.astype(np.int32)), "block": pa.array(np.full(n, block, np.int32)), **packed}
    )


def unpack(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid and len(x.as_py()) else np.empty(0, kind) for x in column]


def joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)
