"""The corpus pipeline against the brute-force versions of its stages, one after the other."""

import pytest

import corpus_pipeline
from leafspark.llm import sentencepiece_scan as sp

from .common import corpus, unique
from .test_corpus import brute_classes, brute_lines
from .test_rowwise import brute_hits, brute_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in unique(corpus(4, 120))]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    items = [(1, texts[3]), (2, "never seen"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def brute_good(rows):
    """Ids of the documents that the first stage keeps."""
    judged, hosts = [], {}
    for own, text, _, host, _ in rows:
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = sum(bool(x.strip(" \t\x0b\x0c\r")) for x in (text or "").split("\n"))
        base = n < 20 or 100 * repeat > 30 * n
        pairs = [(100 * symbols, 10 * chars), (100 * dup, 30 * lines), (2 * n, chars), (chars, 14 * n)]
        soft = any(a > b for a, b in pairs)
        judged.append((own, host, base, soft, max(a / max(b, 1) for a, b in pairs)))
        count = hosts.setdefault(host, [0, 0])
        count[0] += 1
        count[1] += base or soft
    rates = [1_000_000 * f // n for n, f in hosts.values()]
    mean = sum(rates) / (1e6 * len(rates))
    var = max(sum(r * r for r in rates) / (1e12 * len(rates)) - mean * mean, 0.0)
    strength = mean * (1 - mean) / var - 1 if var > 0 else 0.0
    a, b = max(mean * strength, 0.0), max((1 - mean) * strength, 0.0)
    rate = {h: (f + a) / (n + a + b) for h, (n, f) in hosts.items()}
    worse = lambda h, s: rate[h] >= 0.5 or s >= 3.0 or s * (rate[h] / mean if mean else 1.0) >= 1.25
    return {own for own, host, base, soft, s in judged if not (base or (soft and worse(host, s)))}


def test_pipeline(spark, folder):
    path, rows, items = folder
    theirs = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    good = brute_good(rows)
    want = [(i, t) for i, t, *_ in rows if i in good]
    want = [(i, t) for i, t, *_ in brute_lines(want)]
    classes = brute_classes(want)
    want = [(i, t) for i, t in want if classes[i][1] == i]
    hits = {i: brute_hits(t, items) for i, t in want}
    want = [(i, t) for i, t in want if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])]
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want) and 0 < len(want) < len(good)
    for r in got:
        assert r["ids"] == theirs.encode(r["text"]) and r["round_trip"] and r["n_chars"] == len(r["text"]) and r["n_pieces"] == len(r["ids"])


def test_near_duplicates_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{name}{i}" for i in range(40)) for name in ("a", "b", "c"))
    near = one.replace("a39", "changed")
    rows = [(None, one), (7, one), (5, near), (3, two), (3, two), (4, two), (None, three), (None, three), (None, "alone " + two[:60]), (9, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    want = [(5, near), (3, two), (None, three), (None, "alone " + two[:60]), (9, ""), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("n_words", docs_extra())
    for clash in ("k_0", "host", "_text", "doc", "spots", "row", "n_lines", "kept"):
        docs = docs.withColumn(clash, docs_extra())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert all(stage(spark, docs.where("false"), path).count() == 0 for _, stage in corpus_pipeline.STAGES)


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")
