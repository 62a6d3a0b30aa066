"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept and returns their columns; the last adds the pieces.

Null and empty texts fail the quality rules and go in the first stage. Given to a later one, they stay there as they
are: nothing is cut from them, they are nobody's copy, hold no benchmark passage, and have null or no pieces. Null ids
are kept; columns beside those of ``documents`` pass through. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import decontam, lines, ngram_join, quality, sentencepiece_scan
from leafspark.llm._common import delete, n_written, release, scratch_dir, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's rate reject go."""
    return quality.keep_good(docs, strict=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines, and shorter ones of many words, are cut out of the texts; ``n_chars`` follows."""
    cut = lines.dedup_lines(docs, long_words=lines.LONG_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that of the smallest id, a null id after all others.

    Rows are linked by a number of their own, as ids may be null or repeated.
    """
    rows = written(docs.withColumn("_node", F.monotonically_increasing_id()))
    classes = ngram_join.link_classes(rows.select("_node", "text"), "_node").select("_node", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("tag"), "_node")
    firsts = rows.select("_node", order.alias("order")).join(classes, "_node")
    firsts = firsts.groupBy("component_id").agg(F.min("order").alias("order")).select("order._node")
    return rows.join(firsts, "_node", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="_hits")
    return found.where(~decontam.contaminated("_hits")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    decoded = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, out="ids"), out="_decoded")
    return decoded.select(
        *docs.columns,
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        (F.col("_decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the near-duplicate classes' closure over the whole table nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, since = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}", n_written()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since)
        if before:
            delete(spark, before)
        before = path
    return docs
