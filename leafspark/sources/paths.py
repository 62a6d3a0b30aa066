"""Document sources: folders by Spark's binary file reader, and lists of paths with an error per path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import convert
from ..errors import ERROR, guarded


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, max_length: int | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files of a folder, in any store that Spark reads.

    ``glob`` and ``max_length`` are applied by the scan, before any content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found if max_length is None else found.where(F.col("length") <= max_length)


def read_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    """``df`` with content and read_error: a path that cannot be read is an ``io`` error in its row.

    The paths must be visible to every executor. Columns named content or read_error are replaced.
    """
    keep = [c for c in df.columns if c not in ("content", "read_error")]
    src = df.select(*keep)
    schema = T.StructType([*src.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", ERROR)])
    at, kind = keep.index(path_col), to_arrow_type(ERROR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                path = row.column(at)[0].as_py()
                data, error = guarded(convert.read_path, path or "")
                made = [pa.array([data], pa.binary()), pa.array([error], kind)]
                yield pa.RecordBatch.from_arrays([*row.columns, *made], names=schema.names)

    return src.mapInArrow(run, schema)
