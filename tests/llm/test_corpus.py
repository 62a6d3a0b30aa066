"""Operators over the whole corpus, against brute force: scoring, line and substring dedup, sharding, joins, chat."""

import collections
import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafspark.llm import chat, context_tree, lines, ngram_join, sharding, substrings

from .common import SCHEMA, corpus, ordered, unique


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_substrings(rows):
    seen, out = set(), []
    before = {}
    for own, text in ((r[0], r[1]) for r in ordered(rows)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        out.append((own, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    del before
    return collections.Counter(map(repr, out))


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_substrings(docs, empty, block_bytes):
    made = substrings.dedup_substrings(docs, block_bytes=block_bytes)
    assert made.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert collections.Counter(repr(tuple(r)) for r in made.collect()) == brute_substrings(corpus())
    assert substrings.dedup_substrings(empty).count() == 0


def test_substrings_on_short_alphabets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(60)] + [(99, "a " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(repr(tuple(r)) for r in substrings.dedup_substrings(df).collect()) == brute_substrings(rows)


def brute_lines(rows, run=3):
    first, out = {}, []
    per = []
    for own, text in rows:
        parts = (text or "").split("\n")
        at = [i for i, x in enumerate(parts) if x.encode().split()]
        norm = [b" ".join(parts[i].encode().split()) for i in at]
        per.append((own, text, parts, at, norm))
        for k in range(len(at) - run + 1):
            key, place = tuple(norm[k : k + run]), (own, k)
            first[key] = min(first.get(key, place), place)
    for own, text, parts, at, norm in per:
        gone = {at[k + j] for k in range(len(at) - run + 1) if first[tuple(norm[k : k + run])] != (own, k) for j in range(run)}
        out.append((own, None if text is None else "\n".join(x for i, x in enumerate(parts) if i not in gone), len(at), len(gone)))
    return out


def test_lines(spark, docs, empty):
    rows = [(r[0], r[1]) for r in unique(corpus())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_lines string, key int").repartition(3)
    made = lines.dedup_lines(df)
    assert made.columns == ["doc_id", "text", "key", "n_lines", "n_deleted"]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in made.where("text is not null").collect())
    assert got == sorted(x for x in brute_lines(rows) if x[1] is not None)
    assert any(x[3] for x in got) and made.where("text is null").select("n_lines", "n_deleted").first() == (0, 0)
    assert lines.dedup_lines(docs).count() == len(corpus()) and lines.dedup_lines(empty).count() == 0
    copies = lines.dedup_lines(docs).groupBy("doc_id", "text").count().where("count > 1 and doc_id is not null")
    clashing = docs.selectExpr("doc_id", "text", "lang as doc", "source as _doc", "block as _starts", "hits as spots")
    assert lines.dedup_lines(clashing).columns == [*clashing.columns, "n_lines", "n_deleted"] and lines.dedup_lines(clashing).count() == len(corpus())
    assert copies.count() == 1  # the identical rows of one id keep the same lines


def test_long_passages_of_few_lines(spark):
    rng = random.Random(2)
    line = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(k))
    one, two, exact = line(51), line(26) + "\n" + line(25), line(50)
    rows = [(1, one), (2, "own words\n" + one + "\nmore"), (3, one), (4, two), (5, "x\n\n" + two.replace(" ", "  ") + "\ny"), (6, exact), (7, exact)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in lines.dedup_lines(df, long_words=50).collect()}
    assert cut == {1: (one, 0), 2: ("own words\nmore", 1), 3: ("", 1), 4: (two, 0), 5: ("x\n\ny", 2), 6: (exact, 0), 7: (exact, 0)}
    assert all(r["n_deleted"] == 0 for r in lines.dedup_lines(df).collect())


def brute_classes(rows):
    sets, parent = {}, {}
    for own, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        sets[own], parent[own] = grams, own

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed):
    """Chains and clouds of near copies around few originals, on a vocabulary small enough for chance hits."""
    rng = random.Random(seed)
    rows = []
    for f in range(6):
        base = [rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 25)):
            own = list(base)
            for _ in range(rng.randrange(8)):
                own[rng.randrange(len(own))] = rng.choice(["new1", "new2", f"w{rng.randrange(9)}"])
            if rng.random() < 0.3:
                own = own[rng.randrange(12) :]
            if rng.random() < 0.2:
                base = own
            rows.append(own)
    rows += [[], ["one"], ["ONE"], ["a", "b"], ["a", "b", "c"]]
    rng.shuffle(rows)
    return [(i * 7 % 1009, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes(spark, seed):
    rows = families(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_classes(df, block_bytes=3000).collect()}
    assert got == brute_classes(rows)


def test_classes_of_awkward_rows(docs, empty):
    want = brute_classes([(r[0], r[1]) for r in unique(corpus())])
    rows = ngram_join.link_classes(docs).collect()
    assert len(rows) == len(corpus()) and {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {k: v[1] for k, v in want.items()}
    assert ngram_join.link_classes(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["doc"]: r["component"] for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_scores(rows, depth):
    steps = lambda b: ((b[p - depth : p], v, bit) for p in range(depth, len(b)) for v, bit in bits(b[p]))

    def bits(byte):
        v = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield v, bit
            v = 2 * v + bit

    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    line = lambda w: b"\n" * depth + b" ".join(w) + b"\n"
    n, count = collections.defaultdict(lambda: [0, 0]), collections.Counter()
    held = lambda own: own is not None and zlib.crc32(str(own).encode()) % 5 == 1
    for own, words in texts:
        if not held(own):
            count.update([*words, None])
            for context, v, bit in steps(line(words)):
                for k in range(depth + 1):
                    n[context[depth - k :], v][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below, weight = collections.Counter(), {}
    for key in sorted(n, key=lambda k: -len(k[0])):
        own = kt(*n[key])
        if len(key[0]) == depth:
            weight[key], log = 1.0, own
        else:
            weight[key] = 1 / (1 + math.exp(min(700, below[key] - own)))
            m = max(own, below[key])
            log = m + math.log(math.exp(own - m) + math.exp(below[key] - m)) - math.log(2)
        if key[0]:
            below[key[0][1:], key[1]] += log
    total, out = sum(count.values()), []
    for own, words in texts:
        score = 0.0
        for context, v, bit in steps(line(words)):
            p = 0.5
            for k in range(depth, -1, -1):
                key = context[depth - k :], v
                p = weight[key] * (n[key][1] + 0.5) / (sum(n[key]) + 1) + (1 - weight[key]) * p if key in n else 0.5
            score += math.log10(p if bit else 1 - p)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in [*words, None])
        out.append((own, held(own), len(words) + 1, sum(count[w] > 0 for w in [*words, None]), total, base, score))
    return out


@pytest.mark.parametrize("depth", [2, 5])
def test_scores(docs, empty, depth):
    made = context_tree.score(docs, depth=depth)
    assert made.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    key = lambda r: (repr(r[0]), r[2], round(r[5], 4))
    got, want = sorted((tuple(r) for r in made.collect()), key=key), sorted(brute_scores(corpus(), depth), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    texts = {repr(r[0]) + str(len((r[1] or "").split()) + 1): len(" ".join((r[1] or "").split()).encode()) + 1 for r in corpus()}
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)
        if "\x1c" not in repr(g[0]):
            assert g[7] == pytest.approx(-g[6] / math.log10(2) / texts[repr(g[0]) + str(g[2])], rel=1e-9)
    assert context_tree.score(empty).count() == 0


def test_scores_without_training_texts(spark):
    held = next(i for i in range(99) if context_tree.is_held_out(i))
    row = context_tree.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["score"] == pytest.approx(-3 * 8 * math.log10(2), rel=1e-6)


def test_probabilities_sum_to_one():
    import numpy as np
    import pyarrow as pa

    depth, text = 3, b"\n\n\nabra cadabra abra\n"
    grams = collections.Counter(text[i : i + depth + 1] for i in range(len(text) - depth))
    for context in (b"bra", b"\n\n\n", b"xbr", b"zzz"):
        asked = {context + bytes([v]): 0 for v in range(256)} | grams
        keys = np.array(sorted(int.from_bytes(g, "big") for g in asked), np.uint64)
        total = np.array([asked[int(k).to_bytes(depth + 1, "big")] for k in keys], np.int64)
        rows = pa.table({"bucket": [0], "grams": [keys.tobytes()], "total": [total.tobytes()]})
        sums = context_tree._grow(depth)(rows)
        log = np.frombuffer(context_tree._weigh(depth)(rows, context_tree._top(sums))["log"][0].as_py(), np.float32)
        own = [float(p) for k, p in zip(keys, log, strict=True) if int(k).to_bytes(depth + 1, "big")[:depth] == context]
        assert len(own) == 256 and sum(10**p for p in own) == pytest.approx(1, rel=1e-5), context


def test_difference():
    assert sharding.difference([], 3) == {}
    assert sorted(collections.Counter(sharding.difference([("a", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4)], 2).values()).values()) == [2, 3]
    rng = random.Random(2)
    sizes = [(str(i), rng.randrange(1, 5000)) for i in range(3000)]
    placed = sharding.difference(sizes, 40)
    load = collections.Counter()
    for name, size in sizes:
        load[placed[name]] += size
    assert len(placed) == 3000 and max(load.values()) - min(load.values()) <= 5


def test_shards(spark, docs, empty):
    rows = sharding.shard(docs, 4).collect()
    texts = collections.Counter((repr(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert collections.Counter((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == texts
    place = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        place[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in place.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, 4).count() == 0
    bundled = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")).unionAll(
        spark.range(1000, 3000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")))
    )
    load = [r["b"] for r in sharding.shard(bundled, 4, units=200).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 4 and max(load) - min(load) < 0.02 * sum(load)


def replay(sizes, k):
    """Differencing on plain lists: partial partitions as lists of (sum, names), the widest two combined each time."""
    parts = [[(size, [name])] + [(0, [])] * (k - 1) for name, size in sorted(sizes, key=lambda x: (-x[1], x[0]))]
    parts = [(slots, i) for i, slots in enumerate(parts)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0][-1][0] - p[0][0][0], p[1]))
        (a, _), (b, _), *parts = parts
        slots = [(x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1])]
        parts.append((sorted(slots, key=lambda s: -s[0]), made))
        made += 1
    return {name: i for i, (_, names) in enumerate(parts[0][0]) for name in names} if parts else {}


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_difference_against_a_replay(k):
    rng = random.Random(k)
    for n in (0, 1, 2, 5, 40, 120):
        sizes = [(f"{i:03}", rng.randrange(1, 9 if n == 40 else 4000)) for i in range(n)]
        assert sharding.difference(sizes, k) == replay(sizes, k)


def test_shards_in_levels(spark):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    rows = rows.unionAll(spark.range(1000, 1400).select("id", F.lit("copies of one text")))
    for units in (10, 100, 5000):  # three levels, two, and the plain method
        made = sharding.shard(rows, 5, units=units).collect()
        load, place = collections.Counter(), collections.defaultdict(set)
        for r in made:
            load[r["shard"]] += r["size"]
            place[r["text_crc32"]].add(r["shard"])
        assert len(made) == 1300 and all(len(p) == 1 for p in place.values()) and len(place) == 901
        copies = next(r["shard"] for r in made if r["doc_id"] >= 1000)
        del load[copies]  # the copies alone are more than a fifth of all bytes
        assert len(load) == 4 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()), units


CALLS = json.dumps({"tool_calls": [{"id": "b", "name": "add", "arguments": {"y": 2.0, "x": 1}, "depends_on": ["a"]}, {"id": "a", "name": "add", "arguments": "{\"x\": 1}"}]})
TALK = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", ""), (1, 5, "assistant", "late"),
    (2, 0, "assistant", CALLS), (2, 1, "tool", '{"tool_call_id": "a", "content": [1, 2.50]}'), (2, 2, "tool", '{"tool_call_id": "zz"}'),
    (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "add", "depends_on": ["q"]}, {"id": "q", "name": "none", "depends_on": ["p"]}]})),
    (4, 0, "user", "twice"), (4, 0, "user", "twice"), (4, 0, "user", "again"), (4, 1, "assistant", None), (None, 0, "user", "x"), (5, None, None, "{broken"), (6, 0, "user", "é\n\"q\""),
]


def test_chat(spark):
    schemas = chat.SCHEMAS | {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "number"}}}}
    df = spark.createDataFrame([(*r, "clash") for r in TALK], "conv_id long, turn long, role string, text string, status string")
    rows = chat.format_chat(df, schemas).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv_id"], r["turn"], r["call_id"]].append(r)
    one = lambda *key: by[key][0]
    assert (one(1, 1, "turn-1")["status"], one(1, 1, "turn-1")["linked_turn"], one(1, 2, "turn-1")["linked_turn"]) == ("linked", 2, 1)
    assert not one(1, 3, "turn-3")["valid"] and one(1, 3, "turn-3")["status"] == "unanswered" and one(1, 5, "turn-4")["status"] == "orphan"
    assert one(2, 0, "b")["valid"] and one(2, 0, "b")["level"] == 1 and one(2, 0, "a")["level"] == 0 and one(2, 0, "a")["error"] == "$.y: missing"
    assert one(2, 0, "b")["json"] == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","role":"assistant"}'
    assert one(2, 1, "a")["json"] == '{"content":[1,2.5],"role":"tool","tool_call_id":"a"}' and one(2, 2, "zz")["status"] == "orphan"
    assert {r["status"] for k in ("p", "q") for r in by[3, 0, k]} == {"cycle"} and one(3, 0, "q")["error"] == "$: unknown function"
    assert sorted(r["status"] for r in by[4, 0, "turn-0"]) == ["duplicate", "duplicate", "linked"]
    assert one(5, None, None)["kind"] == "message" and one(6, 0, "turn-0")["json"] == '{"arguments":{"text":"é\\n\\"q\\""},"id":"turn-0","name":"reply","role":"user"}'
    assert chat.format_chat(df.where("false")).count() == 0


def brute_order(calls, needs):
    """By call: (order_turn, level), by following the dependencies of each down; None on or behind a cycle."""

    def place(c, path):
        if c in path:
            return None
        before = [place(n, path | {c}) for n in needs[c]]
        if None in before:
            return None
        return max([calls[c], *[b[0] for b in before]]), max([b[1] + 1 for b in before], default=0)

    return {c: place(c, frozenset()) for c in calls}


@pytest.mark.parametrize("most", [100_000, 0])
def test_links_order_and_cycles_against_brute_force(spark, most, monkeypatch):
    rng = random.Random(7)
    rows, want = [], {}
    for conv in range(12):
        calls, needs, answered = {}, {}, {}
        names = [f"c{k}" for k in range(rng.randrange(1, 9))]
        for turn, name in enumerate(names):
            back = names if conv % 3 == 0 else names[:turn]  # every third conversation may have cycles
            needs[name] = {n for n in back if n != name and rng.random() < 0.3}
            calls[name] = 2 * turn
            entry = {"id": name, "name": "reply", "arguments": {"text": "x"}, "depends_on": sorted(needs[name]) + ["nobody"]}
            rows.append((conv, 2 * turn, "assistant", json.dumps({"tool_calls": [entry]})))
            if rng.random() < 0.6:
                answered[name] = 2 * turn + 1 + 20 * rng.randrange(2)
                rows.append((conv, answered[name], "tool", json.dumps({"tool_call_id": name, "content": turn})))
        for name, found in brute_order(calls, needs).items():
            status = "cycle" if found is None else "linked" if name in answered else "unanswered"
            want[conv, calls[name], name] = (status, answered.get(name), found and found[0], found and found[1])
            if name in answered:
                late = answered[name] if found is None else max(answered[name], found[0])
                want[conv, answered[name], name] = ("cycle" if found is None else "linked", calls[name], late, found and found[1] + 1)
    monkeypatch.setattr(chat.levels, "__defaults__", (most,))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = {(r["conv_id"], r["turn"], r["call_id"]): r for r in chat.format_chat(df).collect()}
    got = {k: (r["status"], r["linked_turn"], r["order_turn"], r["level"]) for k, r in made.items()}
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
    assert all(got[k][2] == want[k][2] for k in got if want[k][2] is not None and want[k][0] != "cycle")


def test_schemas():
    assert chat.faults(True, {"type": "integer"}) and not chat.faults(True, {"type": "boolean"})
    assert chat.faults([1, "a"], {"type": "array", "items": {"type": "number"}}) == ["$[1]: not number"]
    assert chat.faults({"a": 1}, {"additionalProperties": False}) == ["$.a: unknown"]
    assert chat.faults(5, {"maximum": 4, "enum": [1]}) == ["$: not in enum", "$: maximum"]
    assert chat.canonical({"b": 1.0, "a": [None, True, 1e300]}) == '{"a":[null,true,1e+300],"b":1}'
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))
