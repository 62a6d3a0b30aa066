"""Substring dedup with fixed-block anchors.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose sequence also starts earlier:
in a document of smaller id, or earlier in the same one. Windows are judged on the input.

Method: every document is cut into non-overlapping blocks of ``ANCHOR`` words; any window of
``2 * ANCHOR`` words holds a whole block, wherever it starts. The blocks of all documents are the index, and
the rolling window of ``ANCHOR`` words at every position of the corpus probes it. A window around no hit on
somebody else's block occurs once. Around the hits, the match is extended: each window of ``WINDOW`` words is
compared exactly, by a 96-bit hash of its words, with all others of the same content, and the earliest place
is found. Overlapping windows add up to the maximal exact repeats.

Plan: documents are dealt into blocks once (:mod:`._blocks`), and that exchange is reused. Probes travel as
4-byte fingerprints, unique within a block; candidates as 24 bytes. A passage or a whole text that a third of
all documents share is one entry per block of documents. Nothing is gathered but one block or one bucket.

Edge cases: null and empty texts have no words. Rows with one id are one document, in order of text, so an
exact repetition is removed as a later place. Null ids count as one document before all others. Texts shorter
than a window lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import Block, bucket_of, constants, deal, joined, message, mix, n_buckets, ranked, rolling, unpack

WINDOW, ANCHOR = 20, 10
_LOW = np.uint64(0xFFFFFFFF)


def _probes(b: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, anchor hashes, valid positions and their keys (bucket above a 32-bit fingerprint)."""
    h = b.hashes()
    anchors = rolling(h, ANCHOR, 1)
    valid = np.flatnonzero(b.left() >= ANCHOR)
    at = anchors[valid]
    return h, anchors, valid, (bucket_of(at, n) << np.uint64(32)) | (at & _LOW)


def _send(n: int):
    def probe(docs: pa.Table) -> pa.Table:
        b = Block(docs)
        _, _, valid, keys = _probes(b, n)
        aligned = (valid - b.starts[b.of[valid]]) % ANCHOR == 0
        found = np.unique(keys)
        refs = np.zeros(len(found), np.uint8)
        own, count = np.unique(keys[aligned], return_counts=True)
        refs[np.searchsorted(found, own)] = np.minimum(count, 2)
        return message(
            b.block, found >> np.uint64(32), prints=(found & _LOW).astype(np.uint32), refs=refs
        )

    return probe


def _look_up(rows: pa.Table) -> pa.Table:
    """For each probe of a bucket: how many index blocks it meets, up to 2."""
    prints, refs = unpack(rows.column("prints"), np.uint32), unpack(rows.column("refs"), np.uint8)
    held = joined([p[r > 0] for p, r in zip(prints, refs, strict=True)], np.uint32)
    index, where = np.unique(held, return_inverse=True)
    count = np.bincount(where, joined([r[r > 0] for r in refs], np.uint8), len(index))
    count = np.append(np.minimum(count, 2), 0).astype(np.uint8)
    index = np.append(index.astype(np.uint64), np.uint64(2**40))
    out = []
    for p in prints:
        at = np.searchsorted(index, p.astype(np.uint64))
        out.append(np.where(index[at] == p, count[at], 0).astype(np.uint8).tobytes())
    return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "met": pa.array(out, pa.binary())})


def _extend(n: int):
    def candidates(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = np.empty(0, np.uint64)
        if not docs.num_rows or not answers.num_rows:
            return _candidates(0, empty, empty, empty, empty, np.empty(0, bool), n)
        b = Block(docs)
        h, anchors, valid, keys = _probes(b, n)
        answers = answers.sort_by("bucket")
        met = joined(unpack(answers.column("met"), np.uint8), np.uint8)
        _, where = ranked(keys)
        aligned = (valid - b.starts[b.of[valid]]) % ANCHOR == 0
        hit = np.zeros(b.n + WINDOW, np.int32)
        hit[valid] = met[where].astype(np.int32) - aligned >= 1
        before = np.concatenate([[0], np.cumsum(hit)])
        start = np.flatnonzero(b.left() >= WINDOW)
        start = start[before[start + WINDOW - ANCHOR + 1] > before[start]]
        a = mix(anchors[start] * np.uint64(0xA24BAED4963EE407) + anchors[start + ANCHOR])
        c = np.zeros(len(start), np.uint64)
        for k, m in enumerate(constants(WINDOW, 2)):
            c += h[start + k] * m
        c = mix(c) & _LOW
        order = np.lexsort((start, c, a))
        a, c, start = a[order], c[order], start[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        return _candidates(b.block, a, c, b.ids[b.of[start]], start, first, n)

    return candidates


def _candidates(block, a, c, ids, start, first, n) -> pa.Table:
    """Messages with the first place of each content in the block, and with its later places there.

    Rows of one id are in one block, so ids alone order places of different blocks.
    """
    heads = message(
        block, bucket_of(a[first], n), key=a[first], check=c[first].astype(np.uint32),
        doc=ids[first].astype(np.int64), at=start[first].astype(np.int32),
    )
    again = ~first
    later = message(block, bucket_of(a[again], n), later=start[again].astype(np.int32))
    spots = {x: y for x, y in zip(later.column("bucket").to_pylist(), later.column("later"), strict=True)}
    return heads.append_column(
        "later", pa.array([spots[x].as_py() if x in spots else b"" for x in heads.column("bucket").to_pylist()], pa.binary())
    )


def _earliest(rows: pa.Table) -> pa.Table:
    """For each block: the places of its candidates that are not the earliest of their content."""
    keys, docs = unpack(rows.column("key"), np.uint64), unpack(rows.column("doc"), np.int64)
    checks = unpack(rows.column("check"), np.uint32)
    key, doc, check = joined(keys, np.uint64), joined(docs, np.int64), joined(checks, np.uint32)
    order = np.lexsort((doc, check, key))
    first = np.ones(len(order), bool)
    k, c = key[order], check[order]
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    repeated = np.empty(len(order), bool)
    repeated[order] = ~first
    out, at = [], 0
    places, later = unpack(rows.column("at"), np.int32), unpack(rows.column("later"), np.int32)
    for p, q in zip(places, later, strict=True):
        out.append(np.concatenate([p[repeated[at : at + len(p)]], q]).tobytes())
        at += len(p)
    return pa.table({"block": rows.column("block"), "places": pa.array(out, pa.binary())})


def _cut(docs: pa.Table, places: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    if docs.num_rows:
        b = Block(docs)
        start = joined(unpack(places.column("places"), np.int32), np.int32) if places.num_rows else np.empty(0, np.int32)
        edge = np.zeros(b.n + WINDOW + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WINDOW, -1)
        gone = np.cumsum(edge)[: b.n] > 0
        for i, own in enumerate(b.raw_ids):
            lo, hi = int(b.starts[i]), int(b.starts[i + 1])
            words, lost = b.words[lo:hi], gone[lo:hi]
            removed = int(lost.sum())
            if removed:
                words = [words[k] for k in np.flatnonzero(~lost)]
            rows.append((own, hi - lo, removed, b" ".join(words)))
    doc, n, removed, text = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table(
        {
            "doc": pa.array(doc, pa.int64()),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "text": pa.array(text, pa.binary()).cast(pa.string()),
        }
    )


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20
) -> DataFrame:
    """id, n_words, n_removed and the kept words, joined by one blank, of every document."""
    dealt, blocks = deal(docs, id_col, text_col, block_bytes)
    n = n_buckets(docs, blocks)
    by_block = dealt.groupBy("block")
    probes = by_block.applyInArrow(_send(n), "bucket int, block int, prints binary, refs binary")
    met = probes.groupBy("bucket").applyInArrow(_look_up, "bucket int, block int, met binary")
    found = by_block.cogroup(met.groupBy("block")).applyInArrow(
        _extend(n), "bucket int, block int, key binary, check binary, doc binary, at binary, later binary"
    )
    places = found.groupBy("bucket").applyInArrow(_earliest, "block int, places binary")
    kept = dealt.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(
        _cut, "doc bigint, n_words bigint, n_removed bigint, text string"
    )
    return kept.withColumnRenamed("doc", id_col)


def text_digest(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)
