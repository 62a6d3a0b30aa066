"""SQL names for the conversions: scalar functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udf, udtf

from .. import convert
from ..errors import ERROR, guarded
from ..formats import EXTENSIONS, FORMATS, format_from_bytes
from ..model import to_json
from ..operators.conversion import PAGE
from ..operators.nodes import TABLES, rows_of

_TEXT = T.StringType()


def _result(value: str) -> T.StructType:
    return T.StructType([T.StructField(value, _TEXT), T.StructField("error", ERROR)])


def _named(name):
    """(format, None), or (None, error row) for a name that does not exist."""
    if name and name not in FORMATS:
        return None, ("unsupported", f'unknown format "{name}"', None, None, None, None)
    return name or None, None


@udf(_result("markdown"), useArrow=True)
def _to_markdown(content, name):
    own, wrong = _named(name)
    return (None, wrong) if wrong else guarded(convert.to_markdown, bytes(content or b""), own)


@udf(_result("document"), useArrow=True)
def _to_document(content, name):
    own, wrong = _named(name)
    return (None, wrong) if wrong else guarded(lambda *a: to_json(convert.to_document(*a)), bytes(content or b""), own)


@udf(_TEXT, useArrow=True)
def _from_bytes(content):
    return format_from_bytes(bytes(content)) if content is not None else None


@udtf(returnType=T.StructType([*PAGE.fields, T.StructField("error", ERROR)]), useArrow=True)
class _PdfPages:
    def eval(self, content, name):
        own, wrong = _named(name)
        found, wrong = (None, wrong) if wrong else guarded(convert.to_pages, bytes(content or b""), own)
        if wrong:
            yield None, None, wrong
        for number, text in found or ():
            yield number, text, None


def _nodes(table: str):
    class Nodes:
        def eval(self, content, name):
            own, wrong = _named(name)
            found, wrong = (None, wrong) if wrong else guarded(convert.to_document, bytes(content or b""), own)
            yield from rows_of(found, table) if found else ()

    return udtf(Nodes, returnType=TABLES[table], useArrow=True)


def register(spark: SparkSession) -> None:
    """Register to_markdown, to_document, format_from_bytes, format_from_extension, pdf_pages and the node tables."""
    spark.udf.register("to_markdown", _to_markdown.asNondeterministic())
    spark.udf.register("to_document", _to_document.asNondeterministic())
    spark.udf.register("format_from_bytes", _from_bytes)
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in EXTENSIONS.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION format_from_extension(extension STRING) RETURNS STRING "
        f"RETURN try_element_at(map({pairs}), lower(ltrim('.', extension)))"
    )
    spark.udtf.register("pdf_pages", _PdfPages)
    for table in TABLES:
        spark.udtf.register(f"document_{table}", _nodes(table))
