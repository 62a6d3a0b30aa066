"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same bytes.
SPACE = " \t\n\x0b\x0c\r"

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


_SLICE = 2 << 20


def trim() -> None:
    """Give memory that is no longer used back to the system: Python workers stay, idle, beside the next stages."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def tidy(batches_of: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """The function of batches; at a task's end, ``forget`` empties what the worker kept, and memory is given back.

    ``forget`` has to be a function of a module: what a closure holds is a copy of the driver's.
    """

    @wraps(batches_of)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches_of(batches)
        finally:
            if forget:
                forget()
            trim()

    return run


def tidy_group(table_of: Callable) -> Callable:
    """The function of a group, or of two groups, with memory given back after each call."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return table_of(group)
        finally:
            trim()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return table_of(left, right)
        finally:
            trim()

    return one if table_of.__code__.co_argcount == 1 else two


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return text.translate(ALNUM).split() if text else []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` or the context's own checkpoint folder; a temporary one only on a local
    master that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="leafspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/") + "/leafspark-" + spark.sparkContext.applicationId


_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int | None = None) -> None:
    """Delete this application's scratch tables; results that still read them must be stored first.

    With ``since``, a value of ``n_written``, only the tables that were written after it was taken.
    """
    if since is None:
        delete(spark, scratch_dir(spark))
        _tables.clear()
    while since is not None and len(_tables) > since:
        delete(spark, _tables.pop())


def n_written() -> int:
    return len(_tables)


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: A corpus of more than this many blocks gets larger ones, up to so many times as large.
_BLOCKS, _LARGER = 8192, 8


def n_blocks(df: DataFrame, text_col: str, target: int) -> int:
    """How many groups of documents to deal out, of about ``target`` bytes of text each.

    Beyond ``_BLOCKS`` blocks their size rises with the root of the corpus, up to ``_LARGER`` times, so that messages
    between blocks and buckets, one for each pair of them, grow no faster than the corpus.
    """
    total = text_bytes(df, text_col)
    target *= min(_LARGER, max(1.0, (total / (_BLOCKS * target)) ** 0.5))
    return max(shuffle_partitions(df), math.ceil(total / target))


def join_split(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` (written, one row a ``key``, with the rows of each key as ``n``) where both have it.

    Keys with more than an eighth of a partition's share of the rows, of which there can be no more than eight a
    partition, are broadcast, so a hot key's rows stay where they are; only the others are shuffled by key, at every size.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1, total // (8 * shuffle_partitions(rows)))
    heavy, light = F.broadcast(table.where(hot).drop("n")), table.where(~hot).drop("n")
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light.hint("merge"), key))


def slices(batch: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``size`` bytes of the texts in column ``at``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def with_results(
    df: DataFrame, text_col: str, out: str, fields: T.StructType, make: Callable[[], Callable[[list[bytes | None]], list[tuple]]]
) -> DataFrame:
    """Append the struct column ``out``, made from ``text_col`` in Arrow batches without a shuffle.

    ``make`` is called once per task and returns the function of a list of texts (UTF-8 bytes, or None for null).
    All other columns pass through unchanged; an input column named ``out`` is replaced.
    """
    df = df.select(*[c for c in df.columns if c != out])
    schema = T.StructType([*df.schema.fields, T.StructField(out, fields)])
    at, kind = df.columns.index(text_col), to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for rows in slices(batch, at, _SLICE):
                made = pa.array(of(rows.column(at).cast(pa.large_binary()).to_pylist()), type=kind)
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)


def with_result(
    df: DataFrame, text_col: str, out: str, fields: T.StructType, make: Callable[[], Callable[[bytes | None], tuple]]
) -> DataFrame:
    """As ``with_results``, from the function of one text."""

    def each():
        of = make()
        return lambda texts: [of(t) for t in texts]

    return with_results(df, text_col, out, fields, each)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame, out: str, keep: list[str]) -> DataFrame:
    """``keep`` columns followed by the fields of the struct column ``out``."""
    return df.select(*[F.col(c) for c in keep], f"{out}.*")
