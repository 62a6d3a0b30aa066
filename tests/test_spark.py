import json
import os

import pytest
from pyspark.sql import functions as F

from leafspark import functions, model, operators, sources, streaming
from leafspark.errors import error_text, is_error
from leafspark.plans import payloads as P

from . import fixtures as X

CASES = [
    (1, "a.docx", X.RICH, None), (2, "b.csv", X.SHEET, None), (3, "c.bin", X.SHEET, None), (4, "d.pdf", X.SURVEY, None),
    (5, "e.pdf", X.MIXED_PDF, None), (6, "f.odt", X.ENCRYPTED_ODT, "odt"), (7, "g.x", b"junk", "docx"), (8, "h.x", b"junk", "word"), (9, "i.x", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, "doc_id long, path string, content binary, named string").cache()


def test_markdown(docs):
    made = operators.markdown(docs, format_col="named", path_col="path")
    assert made.columns == ["doc_id", "path", "named", "format", "markdown", "error"]
    rows = {r["doc_id"]: r for r in made.collect()}
    codes = {k: r["error"] and r["error"]["code"] for k, r in rows.items()}
    assert codes == {1: None, 2: None, 3: "unsupported", 4: None, 5: "needsOcr", 6: "encrypted", 7: "malformed", 8: "unsupported", 9: "unsupported"}
    assert all((r["markdown"] is None) != (r["error"] is None) for r in rows.values())
    assert (rows[5]["error"]["pages"], rows[5]["error"]["page_count"]) == ([2], 2)
    assert rows[2]["format"] == "csv" and rows[3]["format"] is None
    plan = made.where("error is null").select("markdown")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    with pytest.raises(ValueError, match="expected one of"):
        operators.markdown(docs, format="word")


def test_error_columns(docs):
    made = operators.markdown(docs, format_col="named", path_col="path")
    kept = made.select("doc_id", is_error(F.col("error"), "encrypted").alias("enc"), is_error(F.col("error")).alias("any"), error_text(F.col("error")).alias("text"))
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert [k for k, r in rows.items() if r["enc"]] == [6] and not rows[1]["any"] and rows[7]["any"]
    assert rows[1]["text"] == "convert error" and "password" in rows[6]["text"]


def test_pages(docs):
    rows = operators.pages(docs.where("doc_id in (1, 4, 5)")).select("doc_id", "number", "error.code").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, None, "unsupported"), (4, 1, None), (4, 2, None), (5, None, "needsOcr")], key=str)


def test_documents_are_canonical(docs):
    (row,) = operators.documents(docs.where("doc_id = 1")).collect()
    doc = json.loads(row["document"])
    assert list(doc) == ["blocks", "notes", "assets"] and model.to_json(doc) == row["document"]
    assert "null" not in row["document"]


def test_node_tables(docs):
    own = docs.where("doc_id in (1, 2, 7)")
    tables = {t: operators.node_table(own, t, path_col="path").collect() for t in operators.TABLES}
    assert {r["doc_id"] for r in tables["blocks"]} == {1, 2}
    ids = [r["node_id"] for t in ("blocks", "inlines") for r in tables[t] if r["doc_id"] == 1]
    assert len(ids) == len(set(ids))
    for t in ("blocks", "inlines"):
        parents = {(r["doc_id"], r["node_id"]) for r in tables["blocks"]} | {(r["doc_id"], r["node_id"]) for r in tables["inlines"]}
        assert all(r["parent_id"] is None or (r["doc_id"], r["parent_id"]) in parents for r in tables[t])
    assert {r["kind"] for r in tables["blocks"]} <= set(model.BLOCK_KINDS) and {r["kind"] for r in tables["inlines"]} <= set(model.INLINE_KINDS)
    (asset,) = tables["assets"]
    assert bytes(asset["data"]) == P.PNG and asset["n_bytes"] == len(P.PNG)
    cells = {(r["row"], r["col"]): r["text"] for r in tables["cells"] if r["doc_id"] == 1}
    assert cells == {(0, 0): "Quarter", (0, 1): "Widgets", (1, 0): "Q1", (1, 1): "3|4"}


def test_references(spark, docs):
    own = docs.where("doc_id = 1")
    inlines, assets = operators.node_table(own, "inlines"), operators.node_table(own, "assets")
    assert operators.dangling_assets(inlines, assets).count() == 0
    assert operators.dangling_assets(inlines, assets.where("false")).count() == 1
    assert operators.dangling_notes(inlines, operators.node_table(own, "notes")).count() == 0
    grid = model.grid_of([[([model.paragraph([model.text("x")])], 2, 1)], [([], 1, 1), ([], 1, 1)]])
    assert grid[0][1] == model.covered(0, 0)
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, "origin", 2, 1, None, None, "x"), (1, 0, 0, 1, "covered", None, None, 0, 0, None)],
        "doc_id long, table_id int, row int, col int, slot_kind string, col_span int, row_span int, origin_row int, origin_col int, text string",
    )
    assert operators.covered_origins(cells).first()["origin_text"] == "x"


def test_detection_columns(docs):
    rows = docs.select("doc_id", functions.detect(F.col("content")).alias("f"), functions.detect(F.col("content"), F.col("path")).alias("g")).collect()
    assert {r["doc_id"]: r["f"] for r in rows} == {1: "docx", 2: None, 3: None, 4: "pdf", 5: "pdf", 6: "odt", 7: None, 8: None, 9: None}
    assert {r["doc_id"]: r["g"] for r in rows}[2] == "csv"


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "a"), (3, "c"), (2, "")], "n int, m string")
    assert df.agg(functions.join_pages(F.col("n"), F.col("m")).alias("x")).first()["x"] == "a\nc"
    df = spark.createDataFrame([("|a|**b  c**|\n|---|---|\n\n| d |",)], "m string")
    assert df.select(functions.plain_lines(F.col("m"))).first()[0] == ["a b c", "d"]
    data = bytes(range(256))
    df = spark.createDataFrame([(data,)], "b binary")
    made = df.select(functions.base64_text(F.col("b")).alias("t")).first()["t"]
    assert "\r" not in made and __import__("base64").b64decode(made) == data


def test_sql_functions(spark, docs):
    functions.register(spark)
    docs.createOrReplaceTempView("docs")
    one = spark.sql("SELECT to_markdown(content, 'csv').markdown AS m FROM docs WHERE doc_id = 2").first()["m"]
    assert one.startswith("| Kind | Value | Note |")
    rows = spark.sql("SELECT doc_id, p.number, p.error.code FROM docs, LATERAL pdf_pages(content, NULL) p WHERE doc_id IN (4, 5)").collect()
    assert sorted(map(tuple, rows), key=str) == [(4, 1, None), (4, 2, None), (5, None, "needsOcr")]
    assert spark.sql("SELECT count(*) AS n FROM docs, LATERAL document_cells(content, NULL) WHERE doc_id = 1").first()["n"] == 4
    assert spark.sql("SELECT format_from_extension('..XLSB') AS f, format_from_extension('html') AS g").first() == ("xlsx", None)
    assert spark.sql("SELECT to_document(content, 'word').error.code AS c FROM docs WHERE doc_id = 1").first()["c"] == "unsupported"


def test_sources_and_sinks(spark, docs, tmp_path):
    for own, name, data, _ in CASES[:5]:
        (tmp_path / name).write_bytes(data)
    files = sources.read_files(spark, str(tmp_path), glob="*.pdf", max_length=10**6)
    assert operators.pages(files).where("number is not null").count() == 2
    pruned = sources.read_files(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in pruned
    paths = spark.createDataFrame([(str(tmp_path / "a.docx"),), (str(tmp_path / "none.doc"),), (None,)], "path string")
    rows = sources.read_paths(paths).select("path", F.length("content").alias("n"), "read_error.code").collect()
    assert [r["code"] for r in rows] == [None, "io", "io"] and rows[0]["n"] == len(X.RICH)
    out = tmp_path / "out"
    sources.write_assets(operators.node_table(docs.where("doc_id = 1"), "assets"), str(out))
    assert (out / "1" / "asset-0.png").read_bytes() == P.PNG


def test_stream(spark, tmp_path):
    for k, data in enumerate((X.SURVEY, X.SHEET)):
        (tmp_path / f"in{k}.pdf").write_bytes(data)
    os.rename(tmp_path / "in1.pdf", tmp_path / "in1.csv")
    folder = tmp_path / "out"
    query = streaming.convert_stream(streaming.read_stream(spark, str(tmp_path / "in*")), str(folder), str(tmp_path / "c"), available_now=True)
    query.awaitTermination(120)
    rows = spark.read.parquet(str(folder)).select("format", F.col("error").isNull().alias("ok")).collect()
    assert sorted(map(tuple, rows)) == [("csv", True), ("pdf", True)]
