"""License scan, decontamination, quality rules, SentencePiece: row by row operators."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from leafspark.llm import decontam, licenses, quality
from leafspark.llm import sentencepiece_scan as sp
from leafspark.llm._common import alnum_words

from .common import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words():
    assert alnum_words("A-b_C é9\x7f".encode()) == [b"a", b"b", b"c", "é9".encode()]
    assert alnum_words(None) == alnum_words(b"") == []


TEXTS = {
    1: "Released under the MIT License.", 2: "licensed under the APACHE License, version 2.0", 3: "CC BY-NC", 4: None, 5: "", 6: "the mit",
    7: "under the mit license under the mit license", 8: licenses.TEMPLATES["isc"].replace("<<beginOptional>>", "").replace("<<endOptional>>", ""),
    9: "This work is licensed under the GNU General Public License, version 3.", 10: "Licensed under Creative CC BY NC",
    11: "x " * 5000 + "Licensed under a Creative Commons CC BY-NC 4.0", 12: licenses.TEMPLATES["isc"].split("provided")[0],
}


def test_licenses(spark):
    df = spark.createDataFrame([(k, v, "x", 7) for k, v in TEXTS.items()], "doc_id long, text string, license string, n_words int")
    made = licenses.scan_licenses(df)
    assert made.columns == ["doc_id", "text", "n_words", "license"]
    rows = {r["doc_id"]: r["license"] for r in made.collect()}
    assert [rows[k]["labels"] for k in (1, 2, 3, 4, 5, 6)] == [["mit", "mit-notice"], ["apache-2", "apache-2-header"], ["cc-by-nc"], [], [], []]
    assert (rows[7]["n_base"], rows[7]["first_word"], rows[7]["last_word"]) == (2, 0, 4)
    assert rows[4]["first_word"] is None and rows[4]["score"] == 0 and rows[4]["n_words"] == 0
    assert rows[8]["labels"] == ["isc"] and rows[8]["score"] == 1 and rows[12]["labels"] == []
    assert "gpl" in rows[9]["labels"] and rows[10]["labels"] == ["cc-by-nc"] and rows[10]["score"] == 0.5
    assert "cc-by-nc-notice" in rows[11]["labels"]
    for label, t in licenses.TEMPLATES.items():
        pattern = re.compile(licenses.as_regex(t))
        for k, text in TEXTS.items():
            line = " " + " ".join(w.decode() for w in alnum_words((text or "").encode())) + " "
            assert bool(pattern.search(line)) == (label in rows[k]["labels"]), (label, k)


def test_optional_regions_nest():
    mark = "start <<beginOptional>>one <<beginOptional>>two<<endOptional>> three<<endOptional>> end"
    accepts = lambda line: licenses.Automaton("x", mark).accept(alnum_words(line), 0) >= 0
    pattern = re.compile(licenses.as_regex(mark))
    for words in ("start end", "start one three end", "start one two three end", "start two end", "start one end", "start three end", "start one two end"):
        want = words in ("start end", "start one three end", "start one two three end")
        assert accepts(words.encode()) == want and bool(pattern.search(f" {words} ")) == want, words
    for broken in ("a <<beginOptional>>b", "a b<<endOptional>>", "a <<other>>", "<<var;max=2>> a"):
        with pytest.raises(ValueError):
            licenses.parse(broken)


def test_license_empty(empty):
    assert licenses.scan_licenses(empty).count() == 0


def brute_hits(text, items):
    words, hit, found = alnum_words((text or "").encode()), set(), set()
    for own, t in items:
        w = alnum_words((t or "").encode())
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(own))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, empty):
    texts = [r[1] for r in corpus() if r[1]]
    items = [(1, texts[20]), (2, " ".join(texts[30].split()[3:16])), (3, "alpha beta"), (4, None), (5, ""), (6, "pi"), (6, "zeta eta theta"), (7, "never seen words at all " * 4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter((r[0], *map(repr, brute_hits(r[1], items))) for r in corpus())
    for size in (16 << 20, 60):
        made = decontam.decontaminate(docs, bench, slice_bytes=size).select("doc_id", "hits.*", decontam.contaminated().alias("c"))
        rows = made.collect()
        assert collections.Counter((r["doc_id"], repr(r["n_words"]), repr(r["n_hit"]), repr(r["items"])) for r in rows) == want
        assert all(r["c"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in rows)
    assert decontam.decontaminate(docs, bench.where("false")).where("hits.n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0


def test_items_without_an_id_are_found(spark):
    passages = [" ".join(f"{name}{i}" for i in range(13)) for name in "abc"]
    items = [(None, passages[0]), (None, passages[1]), (4, passages[2]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [passages[0], " ".join(passages), passages[2], "none of them"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (16 << 20, 60):
        made = decontam.decontaminate(df, bench, slice_bytes=size).select("doc_id", "hits.*", decontam.contaminated().alias("c"))
        got = {r["doc_id"]: (r["n_hit"], r["items"], r["c"]) for r in made.collect()}
        assert got == {0: (13, [None], True), 1: (39, ["4", None], True), 2: (13, ["4"], True), 3: (0, [], False)}


def test_patterns_against_brute_force():
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n)).encode()
    items = [(str(i % 5), line(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(9)] + [("x", line(30)), ("y", line(14))]
    texts = [line(rng.randrange(60)) for _ in range(40)] + [None, b"", items[9][1], line(2500)]
    for window in (2, 5, 13):
        found = decontam.Benchmark(items, window).search(texts)
        for text, (n, hit, names, spans) in zip(texts, found, strict=True):
            words, want, own = alnum_words(text), set(), set()
            for name, t in items:
                w = alnum_words(t)
                size = min(window, len(w))
                grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
                at = [j for j in range(len(words) - size + 1) if tuple(words[j : j + size]) in grams]
                own |= {name} if at else set()
                want |= {j + k for j in at for k in range(size)}
            assert (n, hit, names) == (len(words), len(want), sorted(own))
            assert {k for a, b in spans for k in range(a, b)} == want


def test_benchmark_slices_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6)], "doc_id long, text string, hits_0 int, hits_1 int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["b c", "zz", "d", "x y z"])], "item_id long, text string")
    made = decontam.decontaminate(df, bench, slice_bytes=3)
    row = made.first()
    assert made.columns == [*df.columns, "hits"] and (row["hits_0"], row["hits_1"], row["hits"]["n_hit"], row["hits"]["items"]) == (5, 6, 3, ["0", "2"])


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, empty):
    rows = quality.judge(docs, ["doc_id"]).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = collections.Counter((r["doc_id"], *(r[f] for f in fields)) for r in rows)
    assert got == collections.Counter((r[0], *brute_quality(r[1])) for r in corpus())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and (r["kept"] or r["base_failed"] or r["soft_failed"])
    assert quality.judge(empty, ["doc_id"]).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r["doc_id"]) for r in rows if r["kept"])


def test_bad_host_loses_only_failing_documents(spark):
    clean, noisy = "plain words in a row that say enough to be kept here by the rule for sure and more of them than it asks", "$$ ##& %% word && $ # other words || that *** follow <<>> here and there %%% with no end in sight at all"
    rows = [(i, noisy + f" {i}", "bad") for i in range(30)] + [(100, clean, "bad"), (101, noisy, "good")] + [(200 + i, clean + f" {i}", "good") for i in range(60)]
    rows += [(1000 + 10 * h + k, clean + f" {h} {k}", f"h{h}") for h in range(20) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, ["doc_id"]).collect()}
    assert not any(kept[i] for i in range(30)) and kept[100] and kept[101] and all(kept[200 + i] for i in range(60))


def test_ordinary_host_rates_decide_soft_failures(spark):
    clean = "plain words in a row that say enough to be kept here by the rule for sure and more of them than it asks "
    mild, severe = clean + "#" * 12, clean + "#" * 60
    rows = [(1000 * h + i, clean + f"{h} {i}", f"h{h}") for h in range(10) for i in range(40)]
    rows += [(100 + i, severe + f" {i}", "h0") for i in range(20)] + [(1100, mild, "h1"), (200, mild, "h0"), (2200, severe, "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    judged = {r["doc_id"]: r for r in quality.judge(df, ["doc_id"]).collect()}
    assert not any(r["host_bad"] for r in judged.values())
    assert judged[200]["soft_failed"] and judged[1100]["soft_failed"]
    kept = {r["doc_id"] for r in quality.keep_good(df, strict=True).collect()}
    assert kept == {r[0] for r in rows} - {*range(100, 120), 200, 2200}


library = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    try:
        return sp.load(sp.MODEL)
    except OSError:
        pytest.skip("no public tokenizer files")


def unigram(data):
    """The same vocabulary as a unigram model with weights by rank."""
    import math

    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -math.log(i + 10)
    return proto.SerializeToString()


def samples():
    rng = random.Random(3)
    texts = [r[1] or "" for r in corpus()][:40]
    signs = "  ▁ \n\ta e t h -=*/#é日😀\x00.1"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(300)]
    return texts + ["a" * 50, " " * 33, "  two  blanks  ", "<s> </s> <unk>"]


def chunked(scanner, text, size):
    s, side, parts = scanner.normal(text), scanner.model.longest, []
    for at in range(0, len(s), size):
        lo, end = max(0, at - side - 1), min(len(s), at + size)
        parts.append((s[lo : end + side + 1], at - lo, end - lo))
    states = sp.borders([scanner.matrix(*p) for p in parts]) if parts else []
    return [i for p, a, b in zip(parts, states, states[1:], strict=False) for i in scanner.trace(*p, a, b)]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_the_librarys(model, kind):
    data = model if kind == "bpe" else unigram(model)
    scanner, theirs = sp.Scanner(sp.Model(data)), library.SentencePieceProcessor(model_proto=data)
    weight = lambda ids: sum(scanner.weight(theirs.id_to_piece(i)) for i in ids)

    def same(a, b):  # unigram paths of equal weight are equally right
        return a == b or (kind == "unigram" and abs(weight(a) - weight(b)) < 1e-3 * abs(weight(b)))

    for text in samples():
        want = theirs.encode(text)
        packed = scanner.encode(text.encode())
        assert same([int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)], want), text
        for size in (1, 5, 37):
            if len(text) < 600:
                assert same(chunked(scanner, text, size), want), (text, size)


def test_product_is_associative(model):
    scanner = sp.Scanner(sp.Model(model))
    s = scanner.normal("unbrokentextwithoutblanks" * 8)
    cuts = [(max(0, k - 17), k) for k in range(0, len(s), 20)]
    m = [scanner.matrix(s[lo : k + 20 + 17], k - lo, min(k + 20, len(s)) - lo) for lo, k in cuts]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = sp.product(left, x)
    for x in m[-2::-1]:
        right = sp.product(x, right)
    assert left == right


def test_encode_and_decode(docs, empty, model):
    theirs = library.SentencePieceProcessor(model_proto=model)
    made = sp.decode(sp.encode(docs, chunk=200))
    assert made.columns == [*docs.columns, "ids", "decoded"]
    rows = made.collect()
    assert collections.Counter(repr((r["doc_id"], r["text"])) for r in rows) == collections.Counter(repr((r[0], r[1])) for r in corpus())
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
        else:
            assert r["ids"] == theirs.encode(r["text"]) and r["decoded"] == r["text"]
    assert sp.encode(empty).count() == 0
    assert docs.where(F.length("text") > 200).count() > 5


def test_long_unbroken_text_takes_little_memory(model):
    import tracemalloc

    scanner, theirs = sp.Scanner(sp.Model(model)), library.SentencePieceProcessor(model_proto=model)
    rng = random.Random(9)
    text = "".join(rng.choice("aeiourstln") for _ in range(30_000))
    tracemalloc.start()
    packed = scanner.encode(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)] == theirs.encode(text)
    assert peak < 40 << 20


def test_many_texts_with_a_small_memo(model, monkeypatch):
    monkeypatch.setattr(sp, "_MEMO_BYTES", 2000)
    scanner, theirs = sp.Scanner(sp.Model(model)), library.SentencePieceProcessor(model_proto=model)
    texts = [t.encode() for t in samples()] + [None]
    for k in range(0, len(texts), 25):
        some = texts[k : k + 25]
        for text, packed in zip(some, scanner.encode_all(some), strict=True):
            assert packed is None if text is None else memoryview(packed).cast("i").tolist() == theirs.encode(text.decode())


def test_columns_named_like_the_operators_own(spark, model):
    rows = [(1, "words and " * 80, "a", "b", 5), (2, "few words", "c", "d", 6), (3, None, "e", "f", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, ids string, k int")
    made = sp.decode(sp.encode(df, chunk=200))
    assert made.columns == ["doc_id", "text", "row", "k", "ids", "decoded"]
    assert sorted((r["doc_id"], r["row"], r["k"], r["decoded"]) for r in made.collect()) == [(r[0], r[2], r[4], r[1]) for r in rows]
