"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles of lower-cased words (the whole sequence if it is
shorter). Two documents link if 100 * intersection >= 75 * union; the result is each document's class, the
connected component over all links.

Method: shingles have one global order, rare ones first. If two sets reach the threshold, then for every l
they share at least l of their first ``n - ceil(0.75 n) + l`` shingles. A document picks its own l by the
estimated cost of its candidates, the sum of its prefix shingles' document counts over l; a pair is a
candidate only if it shares as many shingles in both prefixes as the smaller of the two l, and is then
verified on the whole sets.

Plan: documents are dealt into blocks once; shingle counts travel as packed 4-byte fingerprints and come back
as one byte each, so a document learns how many of its shingles anybody else has. One that shares fewer than
0.75 n of them can have no link, and most documents end there. Equal sets are one class before anything is
joined. Then, instead of all pairs within a posting list:

1. every document gets a *hub*: among the representatives of its posting lists the one that most documents
   chose in a first round, where they chose the representative they share most prefix shingles with.
   Documents are verified against their choices of both rounds, one or two pairs a document, which merges
   large groups of near copies into few classes.
2. what is left are pairs in different classes. Documents of different hubs are joined on their prefixes, where a
   posting list holds more than one class. Two documents of one hub either share no more shingles than the smaller
   overlap of theirs with the hub, and are joined on the hub where that allows a link (on prefixes such a pair would
   come once for every shingle of the hub that both have); or they share some outside the hub's set, at least as many
   as the hub leaves them to find, and are joined on the prefixes that this number gives to their sets outside the
   hub. All pairs found are verified on the whole sets and merged. This is the exact rest: every pair
   that could still change the result is looked at, and no posting list is paired with itself within a class. A
   list of more than ``_LIST`` documents is split over several tasks, by its measured length.

Document counts travel as one byte, exact up to 64 and rounded down to steps of a twelfth beyond, up to 10^9, so the
cost of a frequent shingle is known as that.

Edge cases: null and empty texts (and texts without words) have the empty set, link with nothing and are
their own class. Rows with one id are one node of the graph; each keeps its own n_shingles. Null ids are kept
as one node below all others, returned as null. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import _LEAST, Block, bucket_of, constants, deal, joined, message, mix, n_buckets, ranked, rolling, sorted_within, unpack
from ._common import tidy, tidy_group, written

SIZE, PERCENT, DEEPEST = 5, 75, 8
_LOW = np.uint64(0xFFFFFFFF)
_LIST = 500
#: What a byte says about a count.
_COUNTS = np.unique(np.concatenate([np.arange(65), 64 * 2 ** (np.arange(1, 192) / 8)]).astype(np.int64))


def _coded(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_COUNTS, counts, side="right") - 1).astype(np.uint8)


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles, sorted by document and hash."""
    h = b.hashes()
    at = np.flatnonzero(b.left() >= SIZE)
    keys, of = rolling(h, SIZE, 3)[at], b.of[at]
    size = np.diff(b.starts)
    short = np.flatnonzero((size > 0) & (size < SIZE))
    whole = np.zeros(len(short), np.uint64)
    for k, c in enumerate(constants(SIZE, 4)):
        some = size[short] > k
        whole[some] += (h[b.starts[short[some]] + k] + np.uint64(1)) * c
    keys = np.concatenate([keys, mix(whole + size[short].astype(np.uint64))])
    of = np.concatenate([of, short])
    grouped = np.argsort(of, kind="stable") if len(short) else slice(None)
    keys, of = keys[grouped], of[grouped]
    order = sorted_within(of, keys)
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return of[new], keys[new]


def _digests(of: np.ndarray, keys: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and two 64-bit hashes of each document's set."""
    n = np.bincount(of, minlength=docs)
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    out = []
    for scrambled in (mix(keys + np.uint64(11)), mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))):
        total = np.zeros(docs, np.uint64)
        if len(some):
            total[some] = np.add.reduceat(scrambled, starts)
        out.append(total)
    return n, *out


def _heads(n: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Whether a document is the first of the block with its set."""
    order = np.lexsort((np.arange(len(n)), d2, d1, n))
    first = np.ones(len(n), bool)
    first[1:] = (np.diff(n[order]) != 0) | (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    heads = np.empty(len(n), bool)
    heads[order] = first
    return heads


def _send(buckets: int):
    def count(docs: pa.Table) -> pa.Table:
        b = Block(docs, lower=True)
        of, keys = shingles(b)
        heads = _heads(*_digests(of, keys, len(b.ids)))
        own, n = np.unique(_packed(keys[heads[of]], buckets), return_counts=True)
        return message(
            b.block, own >> np.uint64(32), prints=(own & _LOW).astype(np.uint32), n=_coded(n)
        )

    return count


def _packed(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (bucket_of(keys, buckets) << np.uint64(32)) | (keys & _LOW)


def _count(rows: pa.Table) -> pa.Table:
    """For each shingle of a bucket: in how many sets it is."""
    prints, counts = unpack(rows.column("prints"), np.uint32), unpack(rows.column("n"), np.uint8)
    _, where = np.unique(joined(prints, np.uint32), return_inverse=True)
    total = _coded(np.bincount(where, _COUNTS[joined(counts, np.uint8)]))[where]
    bounds = np.cumsum([0, *map(len, prints)])
    out = [total[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
    return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "n": pa.array(out, pa.binary())})


def need(n):
    """The least overlap with any set that reaches the threshold."""
    return -(-PERCENT * n // 100)


def _choose(buckets: int):
    """Every document's set size and, where it may have links, its set in the global order."""

    def candidates(docs: pa.Table, counts: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            b = Block(docs, lower=True)
            of, keys = shingles(b)
            size, d1, d2 = _digests(of, keys, len(b.ids))
            own, rank = ranked(_packed(keys, buckets))
            df = joined(unpack(counts.sort_by("bucket").column("n"), np.uint8), np.uint8)[rank] if len(own) else rank
            shared = np.bincount(of[df > 1], minlength=len(b.ids))
            bounds = np.concatenate([[0], np.cumsum(size)])
            for i, own_id in enumerate(b.ids):
                n = int(size[i])
                digest = d1[i].tobytes() + d2[i].tobytes() if n else None
                tokens = counts_of = None
                if n and shared[i] >= need(n):
                    mine, known = keys[bounds[i] : bounds[i + 1]], df[bounds[i] : bounds[i + 1]]
                    order = np.argsort(known, kind="stable")
                    tokens, counts_of = mine[order].tobytes(), known[order].tobytes()
                rows.append((int(own_id), n, digest, tokens, counts_of))
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("doc", "n", "digest", "tokens", "counts"), columns, kinds, strict=True)})

    return candidates


def _depth(df: np.ndarray, n: int) -> int:
    """The number of shared prefix shingles to ask for, by the estimated cost of the candidates."""
    least = n - need(n)
    most = min(DEEPEST, n - least)
    cost = np.cumsum(np.where(df > 1, df, 0))[least : least + most] / np.arange(1, most + 1)
    return int(np.argmin(cost + 2 * np.arange(most))) + 1


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle that somebody else may have: shingle, level, doc, n, depth, centrality."""
    for batch in batches:
        parts: list[tuple] = [(np.empty(0, np.int64),) * 6]
        rows = zip(*[batch.column(c).to_pylist() for c in ("doc", "n", "tokens", "counts")], strict=True)
        for doc, n, tokens, counts in rows:
            keys, df = np.frombuffer(tokens, np.int64), np.frombuffer(counts, np.uint8)
            depth, least = _depth(_COUNTS[df], n), n - need(n)
            use = np.flatnonzero(df[: least + depth] > 1)
            level = np.maximum(use - least + 1, 1)
            central = int(1000 * df.mean())
            parts.append((keys[use], level, *[np.full(len(use), x) for x in (doc, n, depth, central)]))
        for k in range(0, len(parts), 512):
            chunk = parts[k : k + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[i] for p in chunk]).astype(np.int64)) for i in range(6)],
                names=["token", "level", "doc", "n", "depth", "central"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, the sizes of both sets and of the overlap, and the prefix of a's shingles outside b.

    A partner of a shares need(na) shingles, of which no more than the overlap lie in b.
    """
    for batch in batches:
        sizes, outside = [], []
        for x, y, counts in zip(*[batch.column(c) for c in ("a_tokens", "b_tokens", "a_counts")], strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            common = np.isin(x, y, assume_unique=True)
            both = int(common.sum())
            sizes.append((len(x), len(y), both))
            rest = x[~common & (np.frombuffer(counts.as_buffer(), np.uint8) > 1)]
            outside.append(rest[: max(0, len(rest) - max(1, need(len(x)) - both) + 1)].tolist())
        na, nb, both = (pa.array([s[i] for s in sizes], pa.int64()) for i in range(3))
        made = [batch.column("a"), batch.column("b"), na, nb, both, pa.array(outside, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, names=["a", "b", "na", "nb", "both", "outside"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of their sets (doc, tokens, counts) and of the overlap, and a prefix outside b."""
    a = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("a_tokens"), F.col("counts").alias("a_counts"))
    b = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("b_tokens"))
    kinds = "a bigint, b bigint, na bigint, nb bigint, both bigint, outside array<bigint>"
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(tidy(_compared), kinds)


#: Whether compared pairs link.
_LINKED = f"100 * both >= {PERCENT} * (na + nb - both)"


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of every document on an edge (a, b) but the smallest of its component.

    Rounds of the alternating large-star and small-star operations, which never add edges: each node hands
    its larger neighbours, then its smaller ones, over to its smallest. Each round is written.
    """
    low, high = F.least("a", "b").alias("m"), F.greatest("a", "b").alias("v")
    pairs = written(edges.where("a <> b").select(high, low).distinct())
    while True:
        both = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(pairs.select("m", "v"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("v"), "m").distinct())
        least = large.groupBy("v").agg(F.min("m").alias("lo"))
        rest = large.join(least, "v").where("m <> lo").select(F.col("m").alias("v"), F.col("lo").alias("m"))
        pairs = written(least.select("v", F.col("lo").alias("m")).union(rest).distinct())
        # Stars: every node hangs on one other, and nothing hangs on a node that hangs itself.
        twice = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        deep = pairs.join(pairs.select(F.col("v").alias("m")).distinct(), "m", "left_semi")
        if not twice.take(1) and not deep.take(1):
            return pairs.select(F.col("v").alias("doc"), F.col("m").alias("component"))


def _relabel(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` (doc, class) after merging the classes that ``edges`` (a, b) connect."""
    of = lambda c: classes.select(F.col("doc").alias(c), F.col("class").alias(f"{c}_class"))
    links = edges.join(of("a"), "a").join(of("b"), "b").where("a_class <> b_class")
    links = written(links.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct())
    if not links.take(1):
        return classes
    merged = components(links)
    joined_ = classes.join(merged.withColumnRenamed("doc", "class"), "class", "left")
    return written(joined_.select("doc", F.coalesce("component", "class").alias("class")))


def link_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20
) -> DataFrame:
    """id, n_shingles and component_id of every document."""
    dealt, blocks = deal(docs, id_col, text_col, block_bytes)
    k = n_buckets(docs, blocks)
    sent = dealt.groupBy("block").applyInArrow(tidy_group(_send(k)), "bucket int, block int, prints binary, n binary")
    counts = sent.groupBy("bucket").applyInArrow(tidy_group(_count), "bucket int, block int, n binary")
    sets = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        tidy_group(_choose(k)), "doc bigint, n bigint, digest binary, tokens binary, counts binary"
    )
    sets = written(sets)
    named = sets.where("digest is not null").select("doc", "n", "digest")
    heads = written(named.groupBy("digest", "n").agg(F.min("doc").alias("head")))
    copies = named.distinct().join(heads, ["digest", "n"]).select("doc", "head")
    own = sets.where("tokens is not null").dropDuplicates(["doc", "digest", "n"])
    own = own.join(heads.withColumnRenamed("head", "doc"), ["doc", "digest", "n"], "left_semi")
    own = written(own.select("doc", "n", "tokens", "counts"))
    posted = written(own.mapInArrow(tidy(_postings), "token bigint, level bigint, doc bigint, n bigint, depth bigint, central bigint"))
    classes = heads.select(F.col("head").alias("doc"), F.col("head").alias("class")).distinct()
    # One id may have several texts: they are one node, so the classes of their sets are one.
    several = copies.groupBy("doc").agg(F.min("head").alias("a"), F.max("head").alias("last")).where("a <> last")
    several = copies.join(several, "doc").where("head <> a").select("a", F.col("head").alias("b"))
    classes = _relabel(classes, written(several))
    first = _choice(posted.withColumn("weight", F.lit(0).cast("long")), by_shared=True)
    chosen = first.groupBy("hub").agg(F.count(F.lit(1)).alias("weight")).withColumnRenamed("hub", "doc")
    weighed = posted.join(chosen, "doc", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    hubs = written(_choice(weighed, by_shared=False))
    asked = first.union(hubs).where("doc <> hub").distinct().select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    facts = written(compare(asked, own))
    classes = _relabel(classes, facts.where(_LINKED))
    near = facts.join(hubs, (F.col("a") == F.col("doc")) & (F.col("b") == F.col("hub")))
    near = near.select("doc", F.col("na").alias("n"), "hub", F.col("both").alias("overlap"), F.col("nb").alias("hub_n"), "outside")
    alone = own.select("doc", "n").join(hubs.where("doc = hub"), "doc")
    alone = alone.select("doc", "n", "hub", F.col("n").alias("overlap"), F.col("n").alias("hub_n"), F.array().cast("array<bigint>").alias("outside"))
    members = written(near.union(alone).join(classes, "doc"))
    pairs = _across_hubs(posted, members).union(_outside_hubs(members)).union(_within_hubs(members, classes))
    pairs = written(pairs.distinct())
    if pairs.take(1):
        classes = _relabel(classes, compare(pairs, own).where(_LINKED))
    of_copy = copies.join(classes.withColumnRenamed("doc", "head"), "head", "left")
    of_copy = of_copy.groupBy("doc").agg(F.min(F.coalesce("class", "head")).alias("class"))
    out = sets.select("doc", "n").join(of_copy, "doc", "left")
    name = lambda c: F.when(c != F.lit(_LEAST), c)
    return out.select(
        name(F.col("doc")).alias(id_col),
        F.col("n").alias("n_shingles"),
        name(F.coalesce("class", "doc")).alias("component_id"),
    )


def _choice(posted: DataFrame, by_shared: bool) -> DataFrame:
    """(doc, hub): of the representatives of a document's posting lists the heaviest, or the one met most often.

    A list's representative is its heaviest document, then the one whose shingles are the most common.
    """
    order = F.struct("weight", "central", (-F.col("doc")).alias("back"))
    heads = posted.groupBy("token").agg(F.max(order).alias("head"))
    met = posted.select("token", "doc").join(heads, "token").groupBy("doc", "head").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.struct("shared", "head") if by_shared else F.struct("head.weight", "shared", "head")
    return met.groupBy("doc").agg(F.max(rank).alias("best")).select("doc", (-F.col("best.head.back")).alias("hub"))


def _sides(rows: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the groups of ``key`` that hold more than one class, twice, for a join with ``part`` on ``key``.

    Their other columns have a_ and b_ before their names. A long group is split: each row of one side is in a part of
    its own, and each of the other in all of them.
    """
    groups = rows.groupBy(*key).agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("m"))
    groups = written(groups.where("lo <> hi").select(*key, F.expr(f"(m + {_LIST - 1}) div {_LIST}").alias("parts")))
    rows = written(rows.join(groups, key))
    a, b = (rows.select(*key, "parts", *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("a_doc"), "parts")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return a, b


#: Different classes, and sizes that allow a link.
_APART = f"a_class <> b_class and 100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n)"


def _across_hubs(posted: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of different hubs that share enough of their prefixes."""
    rows = posted.select("token", "level", "doc", "depth").join(members.select("doc", "n", "hub", "class"), "doc")
    a, b = _sides(written(rows), ["token"], ["level", "doc", "n", "depth", "hub", "class"])
    ask = F.least("a_depth", "b_depth")
    met = a.join(b, ["token", "part"]).where(F.expr(f"a_doc < b_doc and a_hub <> b_hub and {_APART}") & (F.greatest("a_level", "b_level") <= ask))
    met = met.groupBy("a_doc", "b_doc").agg(F.count(F.lit(1)).alias("shared"), F.min(ask).alias("ask"))
    return met.where("shared >= ask").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))


def _outside_hubs(members: DataFrame) -> DataFrame:
    """Pairs of one hub that share a shingle of their prefixes outside the hub."""
    rows = members.select("hub", "doc", "n", "class", F.explode("outside").alias("token"))
    a, b = _sides(written(rows), ["hub", "token"], ["doc", "n", "class"])
    met = a.join(b, ["hub", "token", "part"]).where(f"a_doc < b_doc and {_APART}")
    return met.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))


def _within_hubs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of one hub whose overlaps with it allow a link.

    One of the two is not in the hub's class, and then the other has to be smaller than the hub.
    """
    of_hub = classes.select(F.col("doc").alias("hub"), F.col("class").alias("hub_class"))
    a, b = _sides(written(members.drop("outside").join(of_hub, "hub")), ["hub"], ["doc", "n", "overlap", "class", "hub_n", "hub_class"])
    met = a.where("a_class <> a_hub_class").join(b.where("b_n < b_hub_n"), ["hub", "part"])
    met = met.where(f"{_APART} and {100 + PERCENT} * least(a_overlap, b_overlap) >= {PERCENT} * (a_n + b_n)")
    return met.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))
