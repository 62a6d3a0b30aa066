"""Sharding by Karmarkar-Karp differencing.

Equal texts form one indivisible group. Every group starts as a partial partition with one used slot, and the two
partial partitions of the largest spread are combined again and again, the fullest slot of one with the emptiest
of the other, until one partition is left.

Differencing runs in levels, the same way at every size: groups are dealt by hash into buckets of about ``units``,
each bucket is differenced in a task of its own into one partial partition, and these are differenced in their turn,
``units`` at a time, until one is left. Up to ``units`` groups there is one bucket, which is the plain method. A
partial partition is one row of ``n_shards`` sums; the driver sees ``units`` of them at most, in the last level.

Slots are numbered in two levels, within chunks of a shard and by chunk offsets, so no shard has to fit in a task.
Groups of many copies are joined with their rows by broadcast (see ``join_split``), the others by shuffle.

Edge cases: a null text counts as empty (16 bytes, CRC 0, the group of the empty text). Repeated rows keep
their own slots. Ties are broken by the digest of the text. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_split, written

OVERHEAD = 16


def combine(parts: np.ndarray) -> np.ndarray:
    """For each partial partition (a row of sums by slot) the slots of the one partition that its slots end in.

    Of equal spreads the earlier row comes first, and rows before what is made of rows.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums: list = [*np.take_along_axis(parts, order, 1)]
    made: list[tuple] = []  # by step: the nodes combined, and the slots of each, by the slots of the result
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        by = np.argsort(-both, kind="stable")
        made.append((a, b, by, k - 1 - by))
        sums[a] = sums[b] = None
        sums.append(both[by])
        heapq.heappush(heap, (int(both[by[-1]] - both[by[0]]), len(sums) - 1))
    ends: list = [None] * len(sums)
    if n:
        ends[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, of_a, of_b = made[i]
        for node, of in ((a, of_a), (b, of_b)):
            ends[node] = np.empty(k, np.int64)
            ends[node][of] = ends[n + i]
        ends[n + i] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = ends[i]
    return out


def difference(sizes: list[tuple[str, int]], k: int) -> dict[str, int]:
    """Shard of each named size, by the largest differencing method for ``k`` shards."""
    sizes = sorted(sizes, key=lambda x: (-x[1], x[0]))
    parts = np.zeros((len(sizes), k), np.int64)
    parts[:, 0] = [s for _, s in sizes]
    return dict(zip([name for name, _ in sizes], combine(parts)[:, 0].tolist(), strict=True)) if sizes else {}


def _levels(groups: DataFrame, k: int, units: int) -> DataFrame:
    """``digest``, ``n`` and ``place`` of every group (digest, bytes, n)."""
    buckets = max(1, -(-groups.count() // units))

    def leaves(rows: pa.Table) -> pa.Table:
        placed = difference(list(zip(rows["digest"].to_pylist(), rows["bytes"].to_pylist(), strict=True)), k)
        place = pa.array([placed[d] for d in rows["digest"].to_pylist()], pa.int32())
        return rows.append_column("place", place)

    def inner(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        ends = combine(np.array(rows["sums"].to_pylist(), np.int64).reshape(len(rows), k))
        return pa.table({"bucket": rows["bucket"], "upper": rows["upper"], "ends": pa.array(ends.tolist(), pa.list_(pa.int32()))})

    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    placed = groups.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(
        leaves, "digest string, bytes bigint, n bigint, bucket bigint, place int"
    )
    placed = written(placed)
    while buckets > 1:
        by_slot = placed.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes"))
        held = F.map_from_entries(F.collect_list(F.struct("place", "bytes")))
        sums = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("held")[i.cast("int")], F.lit(0)))
        parts = by_slot.groupBy("bucket").agg(held.alias("held")).select("bucket", sums.alias("sums"))
        parts = parts.withColumn("upper", F.expr(f"bucket div {units}"))
        ends = written(parts.groupBy("upper").applyInArrow(inner, "bucket bigint, upper bigint, ends array<int>"))
        joined = placed.join(F.broadcast(ends) if buckets <= units else ends, "bucket")
        place = F.element_at("ends", F.col("place") + 1)
        placed = written(joined.select("digest", "bytes", "n", F.col("upper").alias("bucket"), place.alias("place")))
        buckets = -(-buckets // units)
    return placed.select("digest", "n", "place")


def shard(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", units: int = 4_000
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every document.

    ``units``: groups, or partial partitions, that one task differences.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
        )
    )
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    dealt = join_split(rows, _levels(groups, n_shards, units), "digest").withColumnRenamed("place", "shard")
    chunks = max(1, -(-rows.count() // 20_000))
    dealt = written(dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "digest"), F.lit(chunks))))
    counts = dealt.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "chunk").orderBy("id", "digest")
    numbered = dealt.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["shard", "chunk"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"),
    )
