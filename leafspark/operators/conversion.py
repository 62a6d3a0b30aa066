"""Conversion of a binary column, one pass over each document in Arrow batches.

``mapInArrow`` plans one Python node per conversion, so filters on the error or on the result never convert a
document twice. The content itself does not travel back. Filter by path, length or detected format before
converting: those filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import convert
from ..errors import ERROR, guarded
from ..formats import FORMATS, check_format
from ..model import to_json

PAGE = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("markdown", T.StringType())])


def mapped(
    df: DataFrame,
    content: str,
    format: str | None,
    format_col: str | None,
    path_col: str | None,
    fields: list[T.StructField],
    make: Callable[[bytes, str | None], list[tuple]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows ``make`` returns for each document, behind the columns kept from it.

    A format name that does not exist is a ValueError when given as a literal, an ``unsupported`` error in a
    column. With ``path_col`` the extension names formats that the content does not show.
    """
    format = check_format(format)
    keep = [c for c in df.columns if c != content] if keep is None else keep
    taken = {f.name for f in fields}
    keep = [c for c in keep if c not in taken]
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    arrow = to_arrow_schema(schema)
    null = F.lit(None).cast("string")
    src = df.select(
        F.struct(*keep).alias("keep") if keep else F.struct(F.lit(0)).alias("keep"),
        F.col(content).alias("content"),
        (F.col(format_col) if format_col else F.lit(format)).alias("format"),
        (F.col(path_col) if path_col else null).alias("path"),
    )
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows, spots = [], []
                for k in range(part.num_rows):
                    data = part.column(1)[k].as_py() or b""
                    name, path = part.column(2)[k].as_py() or None, part.column(3)[k].as_py()
                    if name and name not in FORMATS:
                        made = make(data, name, ("unsupported", f'unknown format "{name}"', None, None, None, None))
                    else:
                        made = make(data, name or (convert.path_format(data, path) if path else None), None)
                    rows += made
                    spots += [k] * len(made)
                kept = part.column(0).take(pa.array(spots, pa.int32())).flatten()[:width]
                own = zip(*rows, strict=True) if rows else [()] * len(fields)
                made = [pa.array(list(c), arrow.field(width + i).type) for i, c in enumerate(own)]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return src.mapInArrow(run, schema)


def _one(convert_one: Callable):
    def make(data: bytes, name: str | None, wrong):
        value, error = (None, wrong) if wrong else guarded(convert_one, data, name)
        found = name or guarded(convert.resolve, data, None)[0]
        return [(found, value, error)]

    return make


def markdown(df: DataFrame, content: str = "content", format: str | None = None, format_col: str | None = None, path_col: str | None = None) -> DataFrame:
    """``df`` without its content, with format, markdown and error; exactly one of the last two is null."""
    fields = [T.StructField("format", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("error", ERROR)]
    return mapped(df, content, format, format_col, path_col, fields, _one(convert.to_markdown))


def documents(df: DataFrame, content: str = "content", format: str | None = None, format_col: str | None = None, path_col: str | None = None) -> DataFrame:
    """``df`` without its content, with format, document (canonical JSON) and error."""
    fields = [T.StructField("format", T.StringType()), T.StructField("document", T.StringType()), T.StructField("error", ERROR)]
    return mapped(df, content, format, format_col, path_col, fields, _one(lambda *a: to_json(convert.to_document(*a))))


def pages(df: DataFrame, content: str = "content", format: str | None = None, format_col: str | None = None, path_col: str | None = None) -> DataFrame:
    """A row for every page with number and markdown; a document that fails has one row with its error."""
    fields = [*PAGE.fields, T.StructField("error", ERROR)]

    def make(data: bytes, name: str | None, wrong):
        found, error = (None, wrong) if wrong else guarded(convert.to_pages, data, name)
        return [(None, None, error)] if error else [(n, text, None) for n, text in found]

    return mapped(df, content, format, format_col, path_col, fields, make)
