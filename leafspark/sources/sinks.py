"""Sinks: embedded assets as files. Markdown and node tables go through Spark's own writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asset_files(assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name and data of every asset; the name is ``asset-<id>`` with the extension of its part."""
    extension = F.regexp_extract("origin_part", "(\\.[^./]+)$", 1)
    return assets.select(key, F.concat(F.lit("asset-"), F.col("asset_id").cast("string"), extension).alias("name"), "data")


def write_assets(assets: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write every asset to ``<folder>/<key>/<name>``; ``folder`` is a path or URI that all executors can write.

    Files are written whole and overwritten, so a task that runs again leaves the same files.
    """

    def run(rows: Iterator) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for row in rows:
            own = re.sub(r"[^\w.-]", "_", str(row[key]))
            store.create_dir(f"{root}/{own}", recursive=True)
            with store.open_output_stream(f"{root}/{own}/{row['name']}") as out:
                out.write(bytes(row["data"]))

    asset_files(assets, key).foreachPartition(run)
