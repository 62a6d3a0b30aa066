"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (a shorter item is one pattern). Patterns
of one length share a shift table over blocks of two words: a block that ends no pattern moves the search
on by as many words as it safely can, and a block that ends one selects its bucket of patterns. The bucket is
bisected by a hash of the whole window, and what is found is compared word for word.

Many places are searched side by side: documents are cut into ranges of ``_RANGE`` places, and every range has its
own cursor in an array of them, so each step of the search is a few array operations for all ranges.

The benchmark is cut into slices of at most ``slice_bytes`` of text (an item is not cut); each slice is collected,
compiled into arrays of word numbers, some twelve bytes for a byte of text, and shipped to the executors, so what is
broadcast has a fixed bound. Several slices mean several passes, whose results are merged per document. Documents are
never shuffled.

Edge cases: null and empty texts have no words and are never hit; items without words are ignored; repeated
rows are judged one by one; items with the same id count once; an empty benchmark hits nothing. Items
without an id are one item named null, last in ``items`` and, as in the query's SQL, counted in n_items but
left out of the digest's names. Input columns may have any names; one called ``out`` is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import Table
from ._common import alnum_words, fresh, with_results

WINDOW = 13
SLICE_BYTES = 8 << 20
_RANGE = 1024
_HASH_BITS = 40

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
    ]
)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... below each count, one after the other, and the indices of the counts."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - (np.cumsum(counts) - counts)[of], of


class Patterns:
    """Shift table and buckets for the patterns of one length: all windows of texts within ``words``.

    ``begins``, ``counts``, ``items``: first word, number of words and item of each text.
    """

    def __init__(self, words: np.ndarray, begins: np.ndarray, counts: np.ndarray, items: np.ndarray, length: int) -> None:
        self.words, self.length, self.block = words, length, min(2, length)
        self.furthest = length - self.block + 1
        # A block is nearest to a pattern's end where it ends one itself, or in the first pattern of its text.
        ends, text = _counted(counts - self.block + 1)
        keys, where = np.unique(self._blocks(words, begins[text] + ends + self.block), return_inverse=True)
        shift = np.full(len(keys), self.furthest, np.int32)
        np.minimum.at(shift, where, np.maximum(length - self.block - ends, 0).astype(np.int32))
        number = np.cumsum(shift == 0, dtype=np.int32) - 1
        at, text = _counted(counts - length + 1)
        bucket = number[where[ends + self.block >= length]]
        self.shift = Table(keys, np.where(shift == 0, length + number, shift))  # below ``length``, or the bucket's number
        starts, items = begins[text] + at, items[text]
        seed = 0
        while not self._group(starts, items, bucket, seed):
            seed += 1

    def _blocks(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = words[ends - 1].astype(np.uint64)
        return last if self.block == 1 else (words[ends - 2].astype(np.uint64) << np.uint64(32)) | last

    def _keys(self, words: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The bucket above a hash of the window."""
        own = np.zeros(len(starts), np.uint64)
        for k in range(self.length):
            own = own * self.factor + words[starts + k].astype(np.uint64) + np.uint64(1)
        own = (own ^ (own >> np.uint64(31))) * self.factor
        return (bucket.astype(np.uint64) << np.uint64(_HASH_BITS)) | (own >> np.uint64(64 - _HASH_BITS))

    def _same(self, words: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether the windows of ``words`` are, word for word, the patterns that begin at ``own``."""
        ok = np.ones(len(starts), bool)
        for k in range(self.length):
            ok &= words[starts + k] == self.words[own + k]
        return ok

    def _group(self, starts: np.ndarray, items: np.ndarray, bucket: np.ndarray, seed: int) -> bool:
        """Equal patterns next to each other, by key; False if two different ones share a key."""
        self.factor = np.random.default_rng(seed).integers(2**62, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = self._keys(self.words, starts, bucket)
        order = np.lexsort((items, keys))
        keys, starts, items = keys[order], starts[order], items[order]
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(new) - 1
        self.keys, self.first = keys[new], starts[new]
        if not self._same(self.words, starts, self.first[group]).all():
            return False
        once = new | np.append(True, items[1:] != items[:-1])
        self.items = items[once].astype(np.int32)
        self.bounds = np.append(np.flatnonzero(new[once]), once.sum())
        return True

    def find(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences in the texts that begin at ``starts`` of ``words``, and their patterns."""
        length, places, found = self.length, np.diff(starts) - self.length + 1, [(np.empty(0, np.int64),) * 2]
        part, text = _counted(-(-np.maximum(places, 0) // _RANGE))
        at = starts[text] + _RANGE * part + length
        until = np.minimum(at + _RANGE - 1, starts[1:][text])
        while len(at):
            value = self.shift.get(self._blocks(words, at))
            step = np.where(value < 0, self.furthest, np.where(value < length, value, 1))
            ends = np.flatnonzero(value >= length)
            if len(ends):
                begin = at[ends] - length
                keys = self._keys(words, begin, value[ends] - length)
                spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                ok = self.keys[spot] == keys
                begin, spot = begin[ok], spot[ok]
                ok = self._same(words, begin, self.first[spot])
                found.append((begin[ok], spot[ok]))
            at = at + step
            live = at <= until
            at, until = at[live], until[live]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(2))


class Benchmark:
    """The patterns of a slice of the benchmark, and the names of its items (null last)."""

    def __init__(self, rows: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        named: dict[str | None, int] = {}
        words, texts = array("i"), {}
        for name, text in rows:
            own = alnum_words(text)
            size = min(window, len(own))
            if size:
                item = named.setdefault(name, len(named))
                texts.setdefault(size, []).append((len(words), len(own), item))
                words.extend([self.number.setdefault(w, len(self.number)) for w in own])
        self.names = list(named)
        own = np.array(words, np.int32)
        self.patterns = [Patterns(own, *np.array(rows, np.int64).T, size) for size, rows in texts.items()]

    def search(self, texts: list[bytes | None]) -> list[tuple]:
        """(n_words, n_hit, item names, merged spans of hit words) of each text."""
        words, counts, unknown = array("i"), [], len(self.number)
        for text in texts:
            own = alnum_words(text)
            words.extend(map(self.number.get, own, repeat(unknown)))
            counts.append(len(own))
        words, starts = np.array(words, np.int32), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for p in self.patterns:
            begin, pattern = p.find(words, starts)
            doc = np.searchsorted(starts, begin, side="right") - 1
            for d, i in zip(doc.tolist(), (begin - starts[doc]).tolist(), strict=True):
                spans.setdefault(d, []).append((i, i + p.length))
            pairs = np.unique(np.stack([doc, pattern]), axis=1)
            for d, g in pairs.T.tolist():
                items.setdefault(d, set()).update(p.items[p.bounds[g] : p.bounds[g + 1]].tolist())
        out = []
        for d, n in enumerate(counts):
            merged = _merged(spans.get(d, ()))
            names = sorted((self.names[i] for i in items.get(d, ())), key=lambda x: (x is None, x))
            out.append((n, sum(b - a for a, b in merged), names, merged))
        return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out: str = "hits",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with the struct column ``out``: n_words, n_hit, items and spans of hit words."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(slices))
    spark = docs.sparkSession
    done = docs.select(*[c for c in docs.columns if c != out])
    parts = [out] if slices == 1 else [fresh(done, f"{out}_{k}") for k in range(slices)]
    for k, name in enumerate(parts):
        rows = ((r["item"], bytes(r["text"])) for r in items.where(part == k).collect())
        shared = spark.sparkContext.broadcast(Benchmark(rows, window))
        done = with_results(done, text_col, name, FIELDS, lambda shared=shared: shared.value.search)
    if slices == 1:
        return done
    merged = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"),
        _covered(reduce(F.concat, [F.col(p)["spans"] for p in parts])).alias("n_hit"),
        F.array_sort(F.array_distinct(F.concat(*[F.col(p)["items"] for p in parts]))).alias("items"),
        F.array_sort(F.concat(*[F.col(p)["spans"] for p in parts])).alias("spans"),
    )
    return done.withColumn(out, merged).drop(*parts)


def _covered(spans):
    """Words inside any of ``spans``, which may overlap."""

    def add(acc, s):
        fresh = F.greatest(s["end"] - F.greatest(s["start"], acc["until"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["until"], s["end"]).alias("until"))

    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("until")), add, lambda acc: acc["n"]
    )


def contaminated(out: str = "hits"):
    """The contamination rule: a twentieth of the words, and at least one, lie in benchmark windows."""
    return (F.col(out)["n_hit"] > 0) & (20 * F.col(out)["n_hit"] >= F.col(out)["n_words"])
