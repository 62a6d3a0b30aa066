"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and read as its words joined by one blank and
closed by a line feed. Each byte is eight binary decisions, from the highest bit; a decision node (the bits
before it) in a context (the bytes before it) counts zeros and ones over the training texts. At every depth
from 0 to ``depth`` bytes the Krichevsky-Trofimov estimate of the node is mixed with the node one byte deeper,
with the weights that context-tree weighting gives after all training data: the estimate's own block
probability against the product of its children's weighted ones. The score is the log10 probability of the
text under the trained mixture, its code length being ``-score / log10(2)`` bits; ``bits_per_byte`` is that over the
bytes that are coded.

A unigram model over the same tokens (words, then one end) gives a base score beside it.

Training texts are those whose ``crc32(id as text) mod 5`` is not 1; all texts are scored.

Plan: documents are dealt into blocks once (:mod:`._blocks`). A block sends its distinct words with training
counts, and its distinct grams of ``depth + 1`` bytes likewise, to buckets of keys by hash. A bucket adds up its
words' counts, and sends its distinct grams with their sums to owners, by the last two context bytes, so that an
owner holds whole subtrees from depth 2 down. The nodes of depth 0 and 1, at most 256 * 255 whatever the corpus,
are summed up and handed to every owner. Owners send the log10 probability of each gram back to its bucket, and
buckets answer each block with counts and probabilities, which the block adds up by document. All counts grow
with the corpus and nothing of it is capped; what one task holds is a block, a bucket of keys, or the distinct
grams of an owner.

Edge cases: null and empty texts consist of the end alone. A null id trains (CRC of no bytes). Rows with
one id are scored one by one. Without any training text every decision has probability 1/2. Words are told
apart by 64-bit hashes. Probabilities travel as 32-bit floats.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import Block, bucket_of, deal, joined, message, n_buckets, ranked, unpack

DEPTH = 5
_CHUNK = 4 << 20
_SPREAD = 0x9E3779B97F4A7C15  # an odd multiplier: a bijection of 64-bit keys whose upper bits depend on all
_BACK = pow(_SPREAD, -1, 1 << 64)


def is_held_out(own: int | None) -> bool:
    return zlib.crc32(b"" if own is None else str(own).encode()) % 5 == 1


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving small arguments up."""
    y, out = np.array(x, np.float64), np.zeros(len(x))
    while (low := y < 9).any():
        out[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return out + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - z / 1680) * z) * z) / y


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _mixture(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a node's own estimate, and log of its weighted probability."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - math.log(2)


def chunks(b: Block, depth: int):
    """(first document, end, gram keys, documents' bounds in the keys) over about 4 MB of text at a time."""
    pad, at, docs = b"\n" * depth, 0, len(b.raw_ids)
    while at < docs:
        pieces, first, size = [], at, 0
        while at < docs and size < _CHUNK:
            pieces.append(pad + b" ".join(b.words[b.starts[at] : b.starts[at + 1]]) + b"\n")
            size += len(pieces[-1])
            at += 1
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join(pieces), np.uint8)
        keep = np.ones(len(x), bool)
        for k in range(depth):
            keep[ends - sizes + k] = False
        spots = np.flatnonzero(keep)
        keys = np.zeros(len(spots), np.uint64)
        for k in range(1, depth + 1):
            keys = (keys << np.uint64(8)) | x[spots - k]
        keys = (keys << np.uint64(8)) | x[spots]
        yield first, at, keys, np.concatenate([[0], np.cumsum(sizes - depth)])


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def _grams(b: Block, depth: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct grams and their counts in training texts."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for first, end, own, bounds in chunks(b, depth):
        learn = np.repeat(train[first:end], np.diff(bounds))
        found, n = np.unique(own[learn], return_counts=True)
        other = np.unique(own[~learn])
        keys += [found, other]
        counts += [n, np.zeros(len(other), np.int64)]
    return _merged(np.concatenate(keys), np.concatenate(counts))


def _tokens(b: Block) -> tuple[np.ndarray, int]:
    """Hashes of the words, and of the end."""
    return b.hashes(), xxhash.xxh3_64_intdigest(b"")


def _send(buckets: int, depth: int):
    def count(docs: pa.Table) -> pa.Table:
        b = Block(docs, lower=True)
        train = np.array([not is_held_out(i) for i in b.raw_ids], bool)
        words, end = _tokens(b)
        words = np.append(words, np.full(len(train), end, np.uint64))
        learn = np.concatenate([train[b.of], train]).astype(np.int64)
        words, seen = _merged(words, learn)
        grams, counts = _grams(b, depth, train)
        order = np.argsort(grams * np.uint64(_SPREAD))
        grams, counts = grams[order], counts[order]
        at_words, at_grams = (
            np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1, dtype=np.uint64)) for h in (words, grams * np.uint64(_SPREAD))
        )
        pack = lambda a, at: pa.array([a[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
        return pa.table(
            {
                "bucket": pa.array(np.arange(buckets, dtype=np.int32)),
                "block": pa.array(np.full(buckets, b.block, np.int32)),
                "words": pack(words, at_words),
                "seen": pack(seen.astype(np.uint32), at_words),
                "grams": pack(grams, at_grams),
                "n": pack(counts.astype(np.uint32), at_grams),
            }
        )

    return count


def _summed(rows: pa.Table, keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a bucket's messages, the sums of their counts, and the rank of each entry."""
    found, rank = ranked(joined(unpack(rows.column(keys), np.uint64), np.uint64))
    total = np.bincount(rank, joined(unpack(rows.column(counts), np.uint32), np.uint32), len(found))
    return found, total.astype(np.int64), rank


def _pass_on(owners: int, depth: int):
    def to_owners(rows: pa.Table) -> pa.Table:
        """A bucket's distinct grams with their counts in all training texts, to the owners of their subtrees."""
        grams, total, _ = _summed(rows, "grams", "n")
        pair = grams >> np.uint64(8 * (depth - 1))
        owner = bucket_of(pair * np.uint64(_SPREAD), owners)
        order = np.argsort(owner, kind="stable")
        made = message(0, owner[order], grams=grams[order], total=total[order])
        bucket = rows.column("bucket")[0].as_py()
        return made.rename_columns(["owner", "bucket", "grams", "total"]).set_column(1, "bucket", pa.array([bucket] * len(made), pa.int32()))

    return to_owners


def _owned(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """An owner's grams, which come from one bucket each, and their counts, in the order of the messages."""
    return joined(unpack(rows.column("grams"), np.uint64), np.uint64), joined(unpack(rows.column("total"), np.int64), np.int64)


def _bits(grams: np.ndarray):
    """(decision node, bit) of each of the eight decisions."""
    sym = grams & np.uint64(255)
    for k in range(8):
        yield (np.uint64(1) << np.uint64(k)) | (sym >> np.uint64(8 - k)), (sym >> np.uint64(7 - k)) & np.uint64(1)


def _tree(grams: np.ndarray, total: np.ndarray, depth: int) -> dict[int, tuple]:
    """By depth from ``depth`` to 2: nodes, zeros, ones, own weight, log weighted probability."""
    learnt = total > 0
    grams, total = grams[learnt], total[learnt]
    context = (grams >> np.uint64(8)) << np.uint64(8)
    parts = [(context | node, total * bit, total) for node, bit in _bits(grams)]
    nodes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    ones = np.bincount(where, np.concatenate([p[1] for p in parts]), len(nodes))
    zeros = np.bincount(where, np.concatenate([p[2] for p in parts]), len(nodes)) - ones
    log = log_kt(zeros, ones)
    levels = {depth: (nodes, zeros, ones, np.ones(len(nodes)), log)}
    for level in range(depth - 1, 1, -1):
        up = ((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255))
        nodes, where = np.unique(up, return_inverse=True)
        zeros, ones = np.bincount(where, zeros, len(nodes)), np.bincount(where, ones, len(nodes))
        weight, log = _mixture(log_kt(zeros, ones), np.bincount(where, log, len(nodes)))
        levels[level] = nodes, zeros, ones, weight, log
    return levels


def _grow(depth: int):
    def sums(rows: pa.Table) -> pa.Table:
        """What this owner adds to the nodes of depth 1: zeros, ones, log probability of the children."""
        nodes, zeros, ones, _, log = _tree(*_owned(rows), depth)[2]
        up = ((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255))
        found, where = np.unique(up, return_inverse=True)
        add = [np.bincount(where, x, len(found)) for x in (zeros, ones, log)]
        return pa.table(
            {"node": pa.array(found.astype(np.int32)), **{c: pa.array(a.astype(np.float64)) for c, a in zip(("zeros", "ones", "below"), add, strict=True)}}
        )

    return sums


def _top(rows: pa.Table) -> pa.Table:
    """The nodes of depth 1 and 0, packed into one row: node, weight and estimate of a one."""
    rows = rows.sort_by("node")
    node, zeros, ones, below = (np.asarray(rows.column(c)) for c in ("node", "zeros", "ones", "below"))
    weight, log = _mixture(log_kt(zeros, ones), below)
    out = {"node": node.astype(np.int32), "weight": weight, "one": (ones + 0.5) / (zeros + ones + 1)}
    root, where = np.unique(node & 255, return_inverse=True)
    zeros, ones, below = (np.bincount(where, x, len(root)) for x in (zeros, ones, log))
    weight, _ = _mixture(log_kt(zeros, ones), below)
    out |= {"root": root.astype(np.int32), "root_weight": weight, "root_one": (ones + 0.5) / (zeros + ones + 1)}
    return pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in out.items()})


def _mixed(p: np.ndarray, at: np.ndarray, nodes: np.ndarray, weight: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The probability of a one after the nodes ``at`` have their say; 1/2 where there is no such node."""
    if not len(nodes):
        return np.full(len(at), 0.5)
    spot = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
    return np.where(nodes[spot] == at, weight[spot] * one[spot] + (1 - weight[spot]) * p, 0.5)


def _weigh(depth: int):
    def weigh(rows: pa.Table, top: pa.Table) -> pa.Table:
        """log10 probability of the last byte of each of an owner's grams, by bucket."""
        if not rows.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "grams": pa.array([], pa.binary()), "log": pa.array([], pa.binary())})
        grams, total = _owned(rows)
        levels = _tree(grams, total, depth)
        packed = lambda c, kind: unpack(top.column(c), kind)[0] if top.num_rows else np.empty(0, kind)
        kinds = {"node": np.int32, "weight": np.float64, "one": np.float64}
        first = [packed(c, k) for c, k in kinds.items()]
        root = [packed(c, k) for c, k in zip(("root", "root_weight", "root_one"), kinds.values(), strict=True)]
        log, context = np.zeros(len(grams)), grams >> np.uint64(8)
        byte = (grams >> np.uint64(8 * depth)) << np.uint64(8)
        for node, bit in _bits(grams):
            p = np.full(len(grams), 0.5)
            for level in range(depth, 1, -1):
                nodes, zeros, ones, weight, _ = levels[level]
                at = ((context >> np.uint64(8 * (depth - level))) << np.uint64(8)) | node
                p = _mixed(p, at, nodes, weight, (ones + 0.5) / (zeros + ones + 1))
            p = _mixed(p, (byte | node).astype(np.int32), *first)
            p = _mixed(p, node.astype(np.int32), *root)
            log += np.log10(np.where(bit == 1, p, 1 - p))
        bounds = np.cumsum([0, *map(len, unpack(rows.column("grams"), np.uint64))])
        logs = [log[i:j].astype(np.float32).tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"bucket": rows.column("bucket"), "grams": rows.column("grams"), "log": pa.array(logs, pa.binary())})

    return weigh


def _answer(rows: pa.Table, logs: pa.Table) -> pa.Table:
    """For each block: corpus counts of its words and log10 probabilities of its grams, in the order it sent them."""
    kinds = {"block": pa.int32(), "bucket": pa.int32(), "count": pa.binary(), "log": pa.binary(), "tokens": pa.int64(), "vocabulary": pa.int64()}
    if not rows.num_rows:
        return pa.table({c: pa.array([], k) for c, k in kinds.items()})
    _, count, where = _summed(rows, "words", "seen")
    known = joined(unpack(logs.column("grams"), np.uint64), np.uint64)
    order = np.argsort(known)
    value = joined(unpack(logs.column("log"), np.float32), np.float32)[order]
    _, where_gram = ranked(joined(unpack(rows.column("grams"), np.uint64), np.uint64))
    split = lambda a, c: [a[i:j].tobytes() for i, j in zip(np.cumsum([0, *c]), np.cumsum(c), strict=False)]
    sizes = [[len(x) for x in unpack(rows.column(c), np.uint64)] for c in ("words", "grams")]
    n = rows.num_rows
    made = [rows.column("block"), rows.column("bucket"), split(count[where], sizes[0]), split(value[where_gram], sizes[1])]
    made += [[int(count.sum())] * n, [int((count > 0).sum())] * n]
    return pa.table({c: a if isinstance(a, pa.ChunkedArray) else pa.array(a, k) for (c, k), a in zip(kinds.items(), made, strict=True)})


def _add(depth: int):
    def scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c: [] for c in ("doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")}
        if docs.num_rows:
            b = Block(docs, lower=True)
            answers = answers.sort_by("bucket")
            n = sum(answers.column("tokens").to_pylist())
            v = sum(answers.column("vocabulary").to_pylist())
            words, end = _tokens(b)
            found = np.unique(np.append(words, np.uint64(end)))
            count = joined(unpack(answers.column("count"), np.int64), np.int64)
            count_end = count[np.searchsorted(found, np.uint64(end))]
            count = count[np.searchsorted(found, words)]
            del words, found
            sums = lambda a: np.diff(np.concatenate([[0], np.cumsum(a)])[b.starts])
            known = sums(count > 0) + (count_end > 0)
            logs = sums(np.log10(count + 0.5)) + math.log10(count_end + 0.5)
            tokens = np.diff(b.starts) + 1
            base = logs - tokens * math.log10(n + 0.5 * (v + 1))
            del count
            parts = [(first, last, *ranked(keys), bounds) for first, last, keys, bounds in chunks(b, depth)]
            grams = np.unique(np.concatenate([p[2] for p in parts]))
            log = np.empty(len(grams))
            log[np.argsort(grams * np.uint64(_SPREAD))] = joined(unpack(answers.column("log"), np.float32), np.float32)
            score, coded = np.empty(len(tokens)), np.empty(len(tokens))
            for first, last, own, rank, bounds in parts:
                value = log[np.searchsorted(grams, own)]
                score[first:last] = np.add.reduceat(value[rank], bounds[:-1])
                coded[first:last] = np.diff(bounds)
            rows = {
                "doc": b.raw_ids, "held_out": [is_held_out(i) for i in b.raw_ids], "n_tokens": tokens, "n_known": known,
                "train_tokens": np.full(len(tokens), n), "base_score": base, "score": score,
                "bits_per_byte": -score / math.log10(2) / coded,
            }
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array(a, k) for (c, a), k in zip(rows.items(), kinds, strict=True)})

    return scores


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = 10 << 20
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of every document.

    ``depth``: context bytes, 2 to 5.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth is 2 to 5")
    dealt, n = deal(docs, id_col, text_col, block_bytes)
    buckets = n_buckets(docs, n)
    owners = min(buckets, 4096)  # pairs of bytes have no more use for
    sent = dealt.groupBy("block").applyInArrow(
        _send(buckets, depth), "bucket int, block int, words binary, seen binary, grams binary, n binary"
    )
    by_bucket = sent.groupBy("bucket")
    owned = by_bucket.applyInArrow(_pass_on(owners, depth), "owner int, bucket int, grams binary, total binary")
    sums = owned.groupBy("owner").applyInArrow(_grow(depth), "node int, zeros double, ones double, below double")
    sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    kinds = "node binary, weight binary, one binary, root binary, root_weight binary, root_one binary"
    top = sums.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_top, kinds)
    top = top.select(F.explode(F.sequence(F.lit(0), F.lit(owners - 1))).alias("owner"), "*")
    logs = owned.groupBy("owner").cogroup(top.groupBy("owner")).applyInArrow(
        _weigh(depth), "bucket int, grams binary, log binary"
    )
    answers = sent.groupBy("bucket").cogroup(logs.groupBy("bucket")).applyInArrow(
        _answer, "block int, bucket int, count binary, log binary, tokens bigint, vocabulary bigint"
    )
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _add(depth),
        "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
    )
    return scored.withColumnRenamed("doc", id_col)
