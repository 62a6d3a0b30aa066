"""Detection and text functions as Catalyst expressions; Python only for OLE and ZIP contents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats import EXTENSIONS, OLE_HEAD, PDF_HEAD, RTF_HEAD, ZIP_HEAD, format_from_bytes


def format_from_extension(extension: Column) -> Column:
    """Format of an extension, with or without dots before it; null for unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    bare = F.lower(F.regexp_replace(F.substring_index(extension, "\0", 1), "^\\.+", ""))
    return F.try_element_at(names, bare)


def format_from_path(path: Column) -> Column:
    """Format of a path's extension; a name that only begins with a dot has none."""
    name = F.regexp_extract(F.substring_index(path, "\0", 1), "([^/]+)/*$", 1)
    return format_from_extension(F.nullif(F.regexp_extract(name, "^.+\\.([^.]*)$", 1), F.lit("")))


def signature_format(content: Column) -> Column:
    """Format by the signatures that need no parsing: PDF and RTF."""
    head = F.substring(content, 1, 1024)
    bare = lambda part: F.regexp_replace(F.decode(part, "ISO-8859-1"), "^[ \\t\\r\\n]+", "")
    # White space before the signature may be of any length; only contents that begin with much are read on.
    text = F.when(F.length(bare(F.substring(content, 1, 64))) >= 5, bare(F.substring(content, 1, 64))).otherwise(bare(content))
    return F.when(F.contains(head, F.lit(PDF_HEAD)), "pdf").when(F.startswith(text, F.lit(RTF_HEAD.decode())), "rtf")


@F.pandas_udf(T.StringType())
def _package_format(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else format_from_bytes(bytes(c)))


def container_format(content: Column) -> Column:
    """Format of OLE and ZIP contents; only those are sent to Python."""
    packed = F.startswith(content, F.lit(ZIP_HEAD)) | F.startswith(content, F.lit(OLE_HEAD))
    return _package_format(F.when(packed, content))


def detect(content: Column, path: Column | None = None) -> Column:
    """Format from the content, else from the path's extension where a path is given."""
    found = [signature_format(content), container_format(content)]
    return F.coalesce(*found, *([format_from_path(path)] if path is not None else []))


def base64_text(data: Column) -> Column:
    """Base64 in the standard alphabet, padded and without line breaks."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def join_pages(number: Column, markdown: Column) -> Column:
    """Aggregate: the Markdown of a document's pages that are not empty, in order, one line break between."""
    kept = F.collect_list(F.when(markdown != "", F.struct(number.alias("n"), markdown.alias("m"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: p["m"]), "\n")


def plain_lines(markdown: Column) -> Column:
    """Array of the text lines: without table rules, emphasis and pipes, white space squeezed."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~F.startswith(x, F.lit("|---")))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "\\*\\*|\\||\\s+", " "), " +", " ")))
    return F.filter(bare, lambda x: x != "")
