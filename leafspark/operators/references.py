"""Joins over the node tables: references and what they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling_assets(inlines: DataFrame, assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Image inlines whose asset does not exist."""
    used = inlines.where("kind = 'image' and source_asset_id is not null")
    return used.join(assets.select(key, F.col("asset_id").alias("source_asset_id")), [key, "source_asset_id"], "left_anti")


def dangling_notes(inlines: DataFrame, notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Note references whose note does not exist."""
    return inlines.where("kind = 'note_ref'").join(notes.select(key, "note_id"), [key, "note_id"], "left_anti")


def covered_origins(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Covered slots with the text and spans of the cell that covers them."""
    origin = cells.where("slot_kind = 'origin'").select(
        key, "table_id", F.col("row").alias("origin_row"), F.col("col").alias("origin_col"), F.col("text").alias("origin_text"),
        F.col("col_span").alias("origin_col_span"), F.col("row_span").alias("origin_row_span"),
    )
    covered = cells.where("slot_kind = 'covered'").drop("text", "col_span", "row_span")
    return covered.join(origin, [key, "table_id", "origin_row", "origin_col"])
