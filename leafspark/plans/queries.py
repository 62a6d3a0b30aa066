"""Queries over documents made from the driver's tables, and their DuckDB SQL.

Payloads are built from whole tables and whole texts. A text's lines are its parts between line breaks, with
white space squeezed, that are not empty; document number ``doc_id`` of a generated format has the first line as
a heading and the others as paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base64_text, detect, format_from_extension, format_from_path, join_pages, plain_lines
from ..operators import covered_origins, dangling_assets, documents, markdown, node_table, pages
from . import payloads


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(text: Column) -> Column:
    squeezed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\x00-\\x20]+", " ")))
    return F.filter(squeezed, lambda x: x != "")


def _made(spark: SparkSession, sf_dir: str, write: Callable[[list[str]], bytes]) -> DataFrame:
    """doc_id and content: the lines of every text, if it has any, written as a document."""
    make = F.pandas_udf(lambda s: s.map(lambda lines: write(list(lines))), "binary")
    docs = _read(spark, sf_dir, "documents").select("doc_id", _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return docs.select("doc_id", make("lines").alias("content"))


def _table(made: DataFrame, table: str, where: str) -> DataFrame:
    """The rows of a node table, and a row of nulls for each document that failed, so that none goes unseen."""
    return node_table(made, table, errors=True).where(f"error is not null or ({where})")


def _csv(*columns: str) -> Column:
    """A CSV document of a whole group: a header, then its rows in order of the first column."""
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(columns[0]), row.alias("line"))))
    text = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n"))
    return text.cast("binary").alias("content")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(_csv("n_nationkey", "n_name"))


def csv_markdown_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(_nations(spark, sf_dir), format="csv").select("region", "format", "markdown")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(_csv("p_partkey", "p_name", "p_brand", "p_type"))
    cells = node_table(parts, "cells", format="csv")
    return cells.select("size", "row", "col", "slot_kind", "is_header", "text")


def csv_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = node_table(_nations(spark, sf_dir), "blocks", format="csv").where("container = 'body'")
    return blocks.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("kind").alias("kind"), F.max("header_rows").alias("header_rows")
    )


_HEADS = ["%PDF-1.7\n", "{\\rtf1 ", "", "  {\\rtf1", "name,qty\n"]


def _behind(spark: SparkSession, sf_dir: str, head: Column) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text behind one of five beginnings."""
    heads = F.array(*[F.lit(h) for h in _HEADS])
    head = F.element_at(heads, (F.pmod(F.col("doc_id"), F.lit(len(_HEADS))) + 1).cast("int"))
    return _behind(spark, sf_dir, head)


def format_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(spark, sf_dir).select("doc_id", detect(F.col("content")).alias("format"))


_EXTENSIONS = ["doc", "docx", "docm", "ppt", "pps", "pot", "pptx", "pptm", "ppsx", "ppsm", "xls", "xlsx", "xlsm", "xlsb", "odt", "ods", "odp", "rtf", "epub", "csv", "pdf", "html", "unknown", ""]


def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extension, with none to two dots before it, in both cases, once per nation."""
    dots = F.explode(F.array(F.lit(""), F.lit("."), F.lit("..")))
    names = _read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _EXTENSIONS))).alias("name"))
    names = names.select("n_nationkey", F.explode(F.array("name", F.upper("name"))).alias("name"))
    names = names.withColumn("dots", dots)
    names = names.select("n_nationkey", F.concat("dots", "name").alias("extension"))
    found = names.withColumn("format", format_from_extension(F.col("extension")))
    return found.groupBy("extension", "format").agg(F.count(F.lit(1)).alias("n"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.pmod(F.col("page_id"), F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    return _read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/file."), end).alias("path"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", format_from_path(F.col("path")).alias("format"))


def format_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the content shows counts before what the path says."""
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(2)) == 0, ".csv").otherwise(".pdf"))
    return _headed(spark, sf_dir).select("doc_id", detect(F.col("content"), path).alias("format"))


def unnamed_csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a signature do not convert unless a format is named."""
    docs = _read(spark, sf_dir, "documents").select("source", F.col("text").cast("binary").alias("content"))
    made = markdown(docs).select("source", F.coalesce("error.code", F.lit("none")).alias("code"), F.col("markdown").isNull().alias("empty"))
    return made.groupBy("source", "code", "empty").agg(F.count(F.lit(1)).alias("n"))


def document_unsupported_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text behind a PDF's beginning, which has no document model."""
    found = documents(_behind(spark, sf_dir, F.lit(_HEADS[0])))
    said = F.contains(F.lower("error.message"), F.lit("markdown"))
    return found.select("doc_id", "format", F.col("error.code").alias("code"), said.alias("says_markdown"), F.col("document").isNull().alias("empty"))


def error_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts named as one of six formats that they are not, or as CSV, which they always are."""
    names = ["docx", "pdf", "rtf", "doc", "epub", "csv", "word"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col("doc_id"), F.lit(len(names))) + 1).cast("int"))
    docs = _read(spark, sf_dir, "documents").select(name.alias("name"), F.concat(F.lit("x"), "text").cast("binary").alias("content"))
    made = documents(docs, format_col="name")
    return made.groupBy("name", F.coalesce("error.code", F.lit("none")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def pages_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's lines as pages, and the pages joined again without the empty ones."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "markdown"))
    return docs.groupBy("doc_id").agg(
        join_pages(F.col("number"), F.col("markdown")).alias("markdown"), F.count(F.lit(1)).alias("n_pages")
    )


def plain_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = markdown(_nations(spark, sf_dir), format="csv")
    return made.select("region", F.posexplode(plain_lines(F.regexp_replace("markdown", "\\| ---", "|---"))).alias("position", "line"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document's inline runs, in order."""
    runs = _table(_made(spark, sf_dir, payloads.docx), "inlines", "kind = 'text'")
    parts = F.array_sort(F.collect_list(F.struct("path", "text")))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def asset_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", base64_text(F.col("text").cast("binary")).alias("data"))


def _pdf_payload(lines: list[str]) -> bytes:
    return payloads.pdf([lines[:1], [], lines[1:]])


def pdf_pages_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs of three pages: the first line, nothing, the other lines."""
    return pages(_made(spark, sf_dir, _pdf_payload)).select(
        "doc_id", "number", (F.col("markdown") == "").alias("blank"), F.sha2(F.col("markdown").cast("binary"), 256).alias("sha256")
    )


def _blocks(write: Callable[[list[str]], bytes]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = _table(_made(spark, sf_dir, write), "blocks", "container = 'body'")
        return blocks.select("doc_id", "ordinal", "kind", "level", "text")

    return query


def _sheet(lines: list[str]) -> bytes:
    return payloads.xlsx({"lines": [[k, x] for k, x in enumerate(lines)]})


def _ods_sheet(lines: list[str]) -> bytes:
    return payloads.ods({"lines": [[str(k), x] for k, x in enumerate(lines)]})


def _cells(write: Callable[[list[str]], bytes]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = _table(_made(spark, sf_dir, write), "cells", "true")
        return cells.select("doc_id", "row", "col", "is_header", "text")

    return query


def _slides(write: Callable[[list[list[str]]], bytes]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = _table(_made(spark, sf_dir, lambda lines: write([[x] for x in lines])), "blocks", "true")
        return blocks.select("doc_id", "ordinal", "kind", "level", "text")

    return query


def _with_images(lines: list[str]) -> bytes:
    """A picture per line; the pictures of odd lines are missing from the package."""
    body = "".join(payloads.docx_image(f"i{k}", x) for k, x in enumerate(lines))
    relations = [(f"i{k}", "image", f"media/p{k}.png") for k in range(len(lines))]
    media = {f"word/media/p{k}.png": payloads.PNG for k in range(0, len(lines), 2)}
    return payloads.docx_body(body, media, relations)


def image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = _table(_made(spark, sf_dir, _with_images), "assets", "true")
    return assets.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_assets"), F.sum("n_bytes").alias("n_bytes"), F.min("media_type").alias("media_type")
    )


def refs_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references by document: all, unavailable ones, and those whose asset is not there.

    The assets are those of an earlier version of each document, without its last line.
    """
    images = _table(_made(spark, sf_dir, _with_images), "inlines", "kind = 'image'")
    assets = _table(_made(spark, sf_dir, lambda lines: _with_images(lines[:-1])), "assets", "true")
    lost = dangling_assets(images, assets).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lost"))
    counts = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_kind") == "unavailable").alias("unavailable"))
    return counts.join(lost, "doc_id", "left").select("doc_id", "n", "unavailable", F.coalesce("lost", F.lit(0).cast("long")).alias("n_dangling"))


def pdf_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same PDFs as one Markdown text each; those without any line have nothing to extract."""
    made = markdown(_made(spark, sf_dir, _pdf_payload))
    return made.select("doc_id", "format", F.sha2(F.col("markdown").cast("binary"), 256).alias("sha256"), F.col("error.code").alias("code"), F.col("error.message").alias("message"))


def pdf_needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs of three pages, the second and the third of which only show an image."""
    found = pages(_made(spark, sf_dir, lambda lines: payloads.pdf([[*lines, "."], [], []], images=(2, 3))))
    return found.select("doc_id", "number", "markdown", F.col("error.code").alias("code"), F.array_join("error.pages", ",").alias("pages"), F.col("error.page_count").alias("page_count"))


def docx_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _table(_made(spark, sf_dir, payloads.docx_listed), "blocks", "true")
    return blocks.select("doc_id", "container", "path", "kind", "list_marker", "list_start", "text")


def docx_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_made(spark, sf_dir, payloads.docx_listed), "list_items", "true").select("doc_id", "list_id", "ordinal", "marker_label")


def docx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(_made(spark, sf_dir, payloads.docx_referring), "inlines", "kind = 'link'")
    return links.select("doc_id", "path", "target_kind", "target_value")


def docx_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes by document: the blocks in them with their text."""
    blocks = _table(_made(spark, sf_dir, payloads.docx_referring), "blocks", "container = 'note'")
    return blocks.select("doc_id", "path", "kind", "text")


def docx_note_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note references by document, joined with their notes."""
    made = _made(spark, sf_dir, payloads.docx_referring)
    refs = _table(made, "inlines", "kind = 'note_ref'").select("doc_id", "note_id")
    notes = _table(made, "notes", "true").select("doc_id", "note_id", F.col("kind").alias("note"))
    return refs.join(notes, ["doc_id", "note_id"], "left").groupBy("doc_id", "note").agg(F.count(F.lit(1)).alias("n"))


def docx_covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = covered_origins(_table(_made(spark, sf_dir, payloads.docx_merged), "cells", "true"))
    return cells.select("doc_id", "row", "col", "origin_row", "origin_col", "origin_text", "origin_col_span", "origin_row_span")


def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the canonical JSON of every document."""
    made = documents(_made(spark, sf_dir, payloads.docx))
    schema = "blocks array<struct<kind: string, level: int, content: array<struct<kind: string, text: string>>>>, notes array<string>, assets array<string>"
    doc = F.from_json("document", schema)
    made = made.select("doc_id", F.col("error").isNotNull().alias("failed"), doc.alias("d"))
    texts = F.transform("d.blocks", lambda b: F.array_join(b["content"]["text"], ""))
    return made.select("doc_id", "failed", F.size("d.blocks").alias("n_blocks"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("sha256"), (F.size("d.notes") + F.size("d.assets")).alias("n_rest"))


_PACKAGES = ["docx", "pptx", "xlsx", "odt", "ods", "odp", "epub"]


def package_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written as each of the ZIP formats, and the format that its bytes show."""
    writers = {"docx": payloads.docx, "pptx": lambda x: payloads.pptx([[y] for y in x]), "xlsx": _sheet, "odt": payloads.odt, "ods": _ods_sheet, "odp": lambda x: payloads.odp([[y] for y in x]), "epub": payloads.epub}
    made = [_made(spark, sf_dir, writers[k]).select("doc_id", F.lit(k).alias("written"), detect(F.col("content")).alias("format")) for k in _PACKAGES]
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out.groupBy("written", "format").agg(F.count(F.lit(1)).alias("n"))


def _broken(name: str) -> list[tuple[str, bytes]]:
    """(format, content) of four documents that fail for different reasons."""
    locked = '<m:manifest xmlns:m="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><m:file-entry m:full-path="content.xml"><m:encryption-data/></m:file-entry></m:manifest>'
    return [
        ("pdf", payloads.pdf([[name], []], images=(2,))),
        ("docx", payloads.pack({"[Content_Types].xml": " "})),
        ("odt", payloads.odf("odt", "", locked)),
        ("docx", payloads.docx_body("", {"word/styles.xml": b" " * ((64 << 20) + 1)})),
    ]


def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes with extras, for four documents of every region."""
    make = F.pandas_udf(lambda s: s.map(lambda name: [{"format": f, "content": c} for f, c in _broken(name)]), "array<struct<format: string, content: binary>>")
    docs = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.posexplode(make("r_name")).alias("case", "d"))
    made = markdown(docs.select("region", "case", F.col("d.format").alias("named"), F.col("d.content").alias("content")), format_col="named")
    return made.select("region", "case", F.col("error.code").alias("code"), F.array_join("error.pages", ",").alias("pages"), F.col("error.page_count").alias("page_count"), F.col("error.part").alias("part_name"), F.col("error.limit").alias("limit_name"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each kind, and the tables' sizes, over every nation's documents."""
    blocks = node_table(_nations(spark, sf_dir), "cells", format="csv")
    return blocks.groupBy("region").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def markdown_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one CSV per ship date, converted to Markdown: rows and digest."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    items = _read(spark, sf_dir, "lineitem").groupBy(day.alias("day")).agg(_csv("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))
    made = markdown(items, format="csv")
    return made.select("day", F.size(F.split("markdown", "\n")).alias("n_lines"), F.sha2(F.col("markdown").cast("binary"), 256).alias("sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_markdown_nation": csv_markdown_nation,
    "csv_cells": csv_cells,
    "csv_header_rows": csv_header_rows,
    "csv_markdown_lineitem": markdown_bytes,
    "table_sizes": outline,
    "format_from_bytes": format_from_bytes,
    "format_from_extension": extensions,
    "format_from_path": paths,
    "format_precedence": format_precedence,
    "unnamed_csv_errors": unnamed_csv_errors,
    "document_unsupported_pdf": document_unsupported_pdf,
    "error_code_counts": error_code_counts,
    "pages_join": pages_join,
    "plain_lines": plain_table_lines,
    "plain_text": plain_text,
    "asset_base64": asset_base64,
    "pdf_pages_generated": pdf_pages_generated,
    "pdf_markdown": pdf_markdown,
    "pdf_needs_ocr": pdf_needs_ocr,
    "docx_lists": docx_lists,
    "docx_list_items": docx_list_items,
    "docx_links": docx_links,
    "docx_notes": docx_notes,
    "docx_note_refs": docx_note_refs,
    "docx_covered_cells": docx_covered_cells,
    "document_json": document_json,
    "package_formats": package_formats,
    "error_details": error_details,
    "docx_blocks": _blocks(payloads.docx),
    "odt_blocks": _blocks(payloads.odt),
    "rtf_blocks": _blocks(payloads.rtf),
    "epub_blocks": _blocks(payloads.epub),
    "xlsx_cells": _cells(_sheet),
    "ods_cells": _cells(_ods_sheet),
    "pptx_blocks": _slides(payloads.pptx),
    "odp_blocks": _slides(payloads.odp),
    "image_assets": image_assets,
    "refs_dangling": refs_dangling,
}

_LINES = r"""list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\x00-\x20]+', ' ', 'g'))), lambda x: x <> '')"""
_MADE = f"made AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL AND len({_LINES}) > 0)"
_ALL = f"WITH every AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_LINES} END AS ls FROM documents)"
_REST = "array_to_string(ls[2:], chr(10) || chr(10))"
_EACH = f"WITH {_MADE}, l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM made)"


def _table_sql(table: str, key: str, name: str, columns: str) -> str:
    """Markdown of one CSV per key."""
    cells = columns.split(", ")
    row = " || ' | ' || ".join(cells)
    head = " | ".join(cells)
    rule = " | ".join(["---"] * len(cells))
    return f"SELECT {key} AS {name}, '| {head} |' || chr(10) || '| {rule} |' || chr(10) || string_agg('| ' || {row} || ' |', chr(10) ORDER BY {cells[0]}, {row}) AS markdown FROM {table} GROUP BY {key}"


_NATION = _table_sql("nation", "n_regionkey", "region", "n_nationkey, n_name")
_HEAD_SQL = "CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 3 THEN 'rtf' END"
_BLOCKS_SQL = _EACH + " SELECT doc_id, CAST(k AS INTEGER) AS ordinal, CASE k WHEN 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(CASE k WHEN 0 THEN 1 END AS INTEGER) AS level, line AS text FROM l"
_CELLS_SQL = _EACH + """ SELECT doc_id, CAST(k AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, k = 0 AS is_header, CASE c WHEN 0 THEN CAST(k AS VARCHAR) ELSE line END AS text FROM l, range(2) AS r(c)"""
_SLIDES_SQL = _EACH + " SELECT doc_id, CAST(k AS INTEGER) AS ordinal, 'heading' AS kind, CAST(2 AS INTEGER) AS level, line AS text FROM l"
_KNOWN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in {
    "doc": "doc", "docx": "docx", "docm": "docx", "ppt": "ppt", "pps": "ppt", "pot": "ppt", "pptx": "pptx", "pptm": "pptx", "ppsx": "pptx", "ppsm": "pptx",
    "xls": "xlsx", "xlsx": "xlsx", "xlsm": "xlsx", "xlsb": "xlsx", "odt": "odt", "ods": "ods", "odp": "odp", "rtf": "rtf", "epub": "epub", "csv": "csv", "pdf": "pdf",
}.items()) + "}"
_LIST = "[" + ", ".join(f"'{e}'" for e in _EXTENSIONS) + "]"

ORACLES: dict[str, str] = {
    "csv_markdown_nation": f"SELECT region, 'csv' AS format, markdown FROM ({_NATION})",
    "csv_cells": """
        WITH p AS (SELECT p_size AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r, [CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type] AS v FROM part
          UNION ALL SELECT DISTINCT p_size, 0, ['p_partkey', 'p_name', 'p_brand', 'p_type'] FROM part)
        SELECT size, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, 'origin' AS slot_kind, r = 0 AS is_header, v[c + 1] AS text FROM p, range(4) AS x(c)""",
    "csv_header_rows": "SELECT n_regionkey AS region, CAST(1 AS BIGINT) AS n_blocks, 'table' AS kind, CAST(1 AS INTEGER) AS header_rows FROM nation GROUP BY 1",
    "csv_markdown_lineitem": "WITH m AS ("
    + _table_sql("lineitem", "strftime(l_shipdate, '%Y-%m-%d')", "day", "l_orderkey, l_linenumber, l_returnflag, l_linestatus")
    + ") SELECT day, CAST(len(string_split(markdown, chr(10))) AS INTEGER) AS n_lines, sha256(markdown) AS sha256 FROM m",
    "table_sizes": "SELECT n_regionkey AS region, CAST(count(*) + 1 AS INTEGER) AS n_rows, CAST(2 AS INTEGER) AS n_cols FROM nation GROUP BY 1",
    "format_from_bytes": f"SELECT doc_id, {_HEAD_SQL} AS format FROM documents",
    "format_from_extension": f"""
        WITH e AS (SELECT n_nationkey, unnest({_LIST}) AS name FROM nation), b AS (SELECT n_nationkey, unnest([name, upper(name)]) AS name FROM e),
        d AS (SELECT unnest(['', '.', '..']) || name AS extension FROM b)
        SELECT extension, {_KNOWN}[lower(ltrim(extension, '.'))] AS format, count(*) AS n FROM d GROUP BY ALL""",
    "format_from_path": f"""
        WITH p AS (SELECT page_id, {_LIST}[CAST(page_id % {len(_EXTENSIONS)} AS INTEGER) + 1] AS e, url || '/file.' || {_LIST}[CAST(page_id % {len(_EXTENSIONS)} AS INTEGER) + 1] AS path FROM pages)
        SELECT page_id, path, {_KNOWN}[e] AS format FROM p""",
    "format_precedence": f"SELECT doc_id, coalesce({_HEAD_SQL}, CASE doc_id % 2 WHEN 0 THEN 'csv' ELSE 'pdf' END) AS format FROM documents",
    "unnamed_csv_errors": "SELECT source, 'unsupported' AS code, true AS empty, count(*) AS n FROM documents GROUP BY source",
    "document_unsupported_pdf": "SELECT doc_id, 'pdf' AS format, 'unsupported' AS code, true AS says_markdown, true AS empty FROM documents",
    "error_code_counts": """
        WITH n AS (SELECT ['docx', 'pdf', 'rtf', 'doc', 'epub', 'csv', 'word'][CAST(doc_id % 7 AS INTEGER) + 1] AS name FROM documents)
        SELECT name, CASE name WHEN 'pdf' THEN 'unsupported' WHEN 'word' THEN 'unsupported' WHEN 'csv' THEN 'none' ELSE 'malformed' END AS code, count(*) AS n FROM n GROUP BY name""",
    "pages_join": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS m, generate_subscripts(ls, 1) AS k FROM d)
        SELECT doc_id, coalesce(string_agg(m, chr(10) ORDER BY k) FILTER (m <> ''), '') AS markdown, count(*) AS n_pages FROM l GROUP BY doc_id""",
    "plain_lines": """
        WITH l AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position, n_nationkey || ' ' || n_name AS line FROM nation
          UNION ALL SELECT DISTINCT n_regionkey, 0, 'n_nationkey n_name' FROM nation)
        SELECT region, CAST(position AS INTEGER) AS position, line FROM l""",
    "plain_text": _EACH + " SELECT doc_id, string_agg(line, '' ORDER BY k) AS text FROM l GROUP BY doc_id",
    "asset_base64": "SELECT doc_id, to_base64(encode(text)) AS data FROM documents",
    "pdf_pages_generated": _ALL + f"""
        SELECT doc_id, CAST(p AS INTEGER) AS number, p = 2 OR (p = 3 AND len(ls) = 1) AS blank, sha256(CASE p WHEN 1 THEN ls[1] WHEN 2 THEN '' ELSE {_REST} END) AS sha256
        FROM every, range(1, 4) AS r(p) WHERE len(ls) > 0 UNION ALL SELECT doc_id, NULL, NULL, NULL FROM every WHERE len(ls) = 0""",
    "pdf_markdown": _ALL + f"""
        SELECT doc_id, 'pdf' AS format, CASE WHEN len(ls) > 0 THEN sha256(ls[1] || CASE WHEN len(ls) > 1 THEN chr(10) || {_REST} ELSE '' END) END AS sha256,
          CASE WHEN len(ls) = 0 THEN 'unsupported' END AS code, CASE WHEN len(ls) = 0 THEN 'PDF has no extractable text (TextBased, 3 pages)' END AS message FROM every""",
    "pdf_needs_ocr": "SELECT doc_id, CAST(NULL AS INTEGER) AS number, CAST(NULL AS VARCHAR) AS markdown, 'needsOcr' AS code, '2,3' AS pages, CAST(3 AS INTEGER) AS page_count FROM documents",
    "docx_lists": _EACH + """
        SELECT doc_id, 'body' AS container, '000000' AS path, 'list' AS kind, 'decimal' AS list_marker, CAST(3 AS BIGINT) AS list_start, CAST(NULL AS VARCHAR) AS text FROM made
        UNION ALL SELECT doc_id, 'list_item', '000000.' || lpad(CAST(k AS VARCHAR), 6, '0') || '.000000', 'paragraph', NULL, NULL, line FROM l""",
    "docx_list_items": _EACH + " SELECT doc_id, CAST(0 AS INTEGER) AS list_id, CAST(k AS INTEGER) AS ordinal, CAST(NULL AS VARCHAR) AS marker_label FROM l",
    "docx_links": _EACH + " SELECT doc_id, lpad(CAST(k AS VARCHAR), 6, '0') || '.000000' AS path, 'external' AS target_kind, 'https://example.org/' || k AS target_value FROM l",
    "docx_notes": _EACH + " SELECT doc_id, 'n' || lpad(CAST(k AS VARCHAR), 6, '0') || '.000000' AS path, 'paragraph' AS kind, line AS text FROM l",
    "docx_note_refs": _EACH + " SELECT doc_id, 'footnote' AS note, count(*) AS n FROM l GROUP BY doc_id",
    "docx_covered_cells": _EACH + """
        , c AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS n, first_value(line) OVER (PARTITION BY doc_id ORDER BY k) AS head FROM l)
        SELECT doc_id, CAST(k AS INTEGER) AS "row", CAST(CASE k WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS col, CAST(CASE k WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS origin_row,
          CAST(0 AS INTEGER) AS origin_col, CASE k WHEN 0 THEN head ELSE 'side' END AS origin_text, CAST(CASE k WHEN 0 THEN 2 ELSE 1 END AS INTEGER) AS origin_col_span,
          CAST(CASE k WHEN 0 THEN 1 ELSE n - 1 END AS INTEGER) AS origin_row_span FROM c WHERE k <> 1""",
    "document_json": _ALL + " SELECT doc_id, false AS failed, CAST(len(ls) AS INTEGER) AS n_blocks, sha256(array_to_string(ls, chr(10))) AS sha256, CAST(0 AS INTEGER) AS n_rest FROM every",
    "package_formats": "SELECT k AS written, k AS format, (SELECT count(*) FROM documents) AS n FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in _PACKAGES) + "]) AS k)",
    "error_details": """
        SELECT r_regionkey AS region, CAST(c AS INTEGER) AS "case", ['needsOcr', 'missingPart', 'encrypted', 'resourceLimit'][c + 1] AS code, CASE c WHEN 0 THEN '2' END AS pages,
          CAST(CASE c WHEN 0 THEN 2 END AS INTEGER) AS page_count, CASE c WHEN 1 THEN 'word/document.xml' END AS part_name, CASE c WHEN 3 THEN 'max_entry_bytes' END AS limit_name
        FROM region, range(4) AS r(c)""",
    "docx_blocks": _BLOCKS_SQL,
    "odt_blocks": _BLOCKS_SQL,
    "rtf_blocks": _BLOCKS_SQL,
    "epub_blocks": _BLOCKS_SQL,
    "xlsx_cells": _CELLS_SQL,
    "ods_cells": _CELLS_SQL,
    "pptx_blocks": _SLIDES_SQL,
    "odp_blocks": _SLIDES_SQL,
    "image_assets": _EACH + f" SELECT doc_id, count(*) AS n_assets, CAST({len(payloads.PNG)} * count(*) AS BIGINT) AS n_bytes, 'image/png' AS media_type FROM l WHERE k % 2 = 0 GROUP BY doc_id",
    "refs_dangling": _EACH + " SELECT doc_id, count(*) AS n, count(*) FILTER (k % 2 = 1) AS unavailable, CAST(count(*) % 2 AS BIGINT) AS n_dangling FROM l GROUP BY doc_id",
}
