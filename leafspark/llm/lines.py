"""Line dedup by winnowing over line hashes.

A line is normalised by squeezing white space; lines without a word are skipped over and kept. A run of
``run`` consecutive lines of one document is *repeated* if the same lines also start earlier: in a document
of smaller id, or earlier in the same one. Every line inside a repeated run is deleted, judged on the input.

With ``long_words``, a run of fewer than ``run`` lines is repeated too if it has more words than that, so a
repeated passage of more than ``long_words`` words in whole lines is deleted however few lines it fills. The
query's SQL knows runs of ``run`` lines only, so this is off unless asked for; the pipeline asks for it.

Method: in every window of ``run`` lines (and of fewer lines, if long enough) the line of the smallest hash is
selected, so any shared run has a selected line at the same place in both copies (the winnowing guarantee). Only
selected positions are emitted, one row each: hash, document, line, and the hashes of the windows that select it,
which lie up to ``run - 1`` lines to either side. Positions are counted by hash with map-side combining; a hash found
at one place of the corpus cannot be in a shared run, and its position ends there. Positions of the others are
joined, and only around them the match is extended both ways: their windows are unpacked, the earliest place of
each content is found by a map-side minimum, and windows at later places go back to their documents. Overlapping
windows add up to the maximal repeated runs, whatever copy they came from.

Skew: a common line or passage is one key. Counts and minima are combined on the map side and written. In both
joins back, keys with more than their share of the rows (a fixed number of them, by the counts) are broadcast, and
only the rest is shuffled by key. No group is gathered.

Edge cases: null texts stay null and are never touched; empty texts stay. Repeated rows with one id are
ordered by a hash of the text; identical rows of one id count as the same document, so both stay or lose
the same lines. Without ``long_words``, documents shorter than ``run`` lines lose nothing. Lines are compared by
128-bit hashes. Input columns may have any names but n_lines and n_deleted, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, join_split, tidy, written

RUN = 3
LONG_WORDS = 50


def _lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the positions of those with a word."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(b" \t\x0b\x0c\r")]


def windows(text: bytes, run: int, long_words: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(start, lines, selected line, its hash, content key) of every window of ``run`` lines with words.

    With ``long_words`` also of every window of fewer lines that has more words.
    """
    lines, at = _lines(text)
    if len(at) < (1 if long_words is not None else run):
        return
    words = [lines[i].split() for i in at]
    full = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
    marks = [int.from_bytes(h[:8], "little", signed=True) for h in full]
    for size in range(1 if long_words is not None else run, run + 1):
        for k in range(len(at) - size + 1):
            if size == run or sum(map(len, words[k : k + size])) > long_words:
                mark = min(marks[k : k + size])
                yield k, size, marks.index(mark, k), mark, xxhash.xxh3_128_digest(b"".join(full[k : k + size]))


def positions(text: bytes, run: int, long_words: int | None = None) -> dict[int, tuple[int, list[dict]]]:
    """By selected line: its hash and the windows that select it (start, size, key of the content)."""
    out: dict[int, tuple[int, list[dict]]] = {}
    for start, size, line, mark, key in windows(text, run, long_words):
        out.setdefault(line, (mark, []))[1].append({"start": start, "size": size, "key": key})
    return out


_AROUND = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("key", pa.binary())]))


def _fingerprints(run: int, long_words: int | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc.as_py(), line, mark, around)
                for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True)
                if text.is_valid
                for line, (mark, around) in positions(text.as_py(), run, long_words).items()
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (batch.column(0).type, pa.int32(), pa.int64(), _AROUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "line", "mark", "around"])

    return of


def _cut(text: bytes, found: list[dict]) -> tuple[bytes, int, int]:
    """The text without the lines of the windows ``found``, lines deleted, lines with words."""
    lines, at = _lines(text)
    gone = {at[w["start"] + j] for w in found for j in range(w["size"])}
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone), len(at)


def repeated_windows(
    docs: DataFrame, key_col: str, text_col: str = "text", run: int = RUN, long_words: int | None = None
) -> DataFrame:
    """``doc`` (from ``key_col``), ``start`` and ``size`` of its windows whose lines also start earlier."""
    src = docs.select(F.col(key_col).alias("doc"), F.col(text_col).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    around = "array<struct<start: int, size: int, key: binary>>"
    rows = written(src.mapInArrow(tidy(_fingerprints(run, long_words)), f"doc {kind}, line int, mark bigint, around {around}"))
    near = join_split(rows, _shared(rows, "mark", F.struct("doc", "line")).drop("first"), "mark")
    near = written(near.select("doc", F.explode("around").alias("w")).select("doc", "w.start", "w.size", "w.key"))
    place = F.struct("doc", "start")
    later = join_split(near, _shared(near, "key", place), "key").where(place != F.col("first"))
    return later.select("doc", "start", "size")


def _shared(rows: DataFrame, key: str, place: Column) -> DataFrame:
    """The keys found at more than one place, the first of them, and the number of rows."""
    found = rows.groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    return written(found.where("first <> last").select(key, "first", "n"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    run: int = RUN,
    long_words: int | None = None,
) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text, and n_lines, n_deleted appended."""
    doc, spots = fresh(docs, "doc"), fresh(docs, "spots")
    tagged = docs.withColumn(doc, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag")))
    found = repeated_windows(tagged.select(doc, text_col), doc, text_col, run, long_words)
    found = written(found.groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("spots")))
    found = found.toDF(f"{doc}_of", spots)
    joined = tagged.join(found.hint("merge"), F.col(doc).eqNullSafe(F.col(f"{doc}_of")), "left")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_lines bigint, n_deleted bigint"
    at = columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            texts, lines, gone = [], [], []
            for text, own in zip(arrays[at].cast(pa.large_binary()), arrays.pop(), strict=True):
                new, cutting, total = (None, 0, 0) if not text.is_valid else _cut(text.as_py(), own.as_py() or [])
                texts.append(new)
                lines.append(total)
                gone.append(cutting)
            arrays[at] = pa.array(texts, pa.large_binary()).cast(arrays[at].type)
            arrays += [pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_lines", "n_deleted"])

    return joined.select(*columns, spots).mapInArrow(tidy(cut), schema)
