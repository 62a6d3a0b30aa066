"""Conversion errors: data in a column, never a failed task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The error codes.
CODES = ("unsupported", "needsOcr", "malformed", "encrypted", "resourceLimit", "missingPart", "io")

ERROR = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("pages", T.ArrayType(T.IntegerType())),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("limit", T.StringType()),
    ]
)


class ConvertError(Exception):
    """Why a document could not be converted; extras accompany the codes they belong to."""

    def __init__(self, code: str, message: str = "", *, pages=None, page_count=None, part=None, limit=None) -> None:
        super().__init__(message or code)
        self.code, self.message = code, message
        self.pages, self.page_count, self.part, self.limit = pages, page_count, part, limit

    def __reduce__(self):
        return _rebuilt, (self.row(),)

    def row(self) -> tuple:
        return self.code, self.message, self.pages, self.page_count, self.part, self.limit


def _rebuilt(row: tuple) -> ConvertError:
    code, message, pages, page_count, part, limit = row
    return ConvertError(code, message, pages=pages, page_count=page_count, part=part, limit=limit)


def malformed(message: str, part: str | None = None) -> ConvertError:
    return ConvertError("malformed", message, part=part)


def unsupported(message: str) -> ConvertError:
    return ConvertError("unsupported", message)


def guarded(make, *args):
    """(value, None) or (None, error row); anything unforeseen is a malformed document."""
    try:
        return make(*args), None
    except ConvertError as e:
        return None, e.row()
    except (Exception, RecursionError) as e:
        return None, malformed(f"internal error during conversion: {type(e).__name__}: {e}"[:500]).row()


def error_text(error: Column) -> Column:
    """The message, or the code where there is none; ``convert error`` without an error."""
    text = F.coalesce(F.nullif(error["message"], F.lit("")), error["code"])
    return F.coalesce(text, F.lit("convert error"))


def is_error(error: Column, code: str = "") -> Column:
    """Whether ``error`` has this code; an empty code matches any error."""
    return error.isNotNull() if not code else F.coalesce(error["code"] == code, F.lit(False))
