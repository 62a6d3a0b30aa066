"""Quality rules with host verdicts, on DataFrame functions alone.

Every document is measured and tried against a few rules. Failures are counted by host, the host's
failure rate is shrunk towards all hosts with a beta prior fitted to them (method of moments), and the
verdict on the host goes back to its documents: a document that fails a soft rule goes only if its host's
shrunk rate is high too. Documents that fail no rule always stay.

``kept`` is that verdict, at the fixed ``host_rate``, as the query's SQL states it. Hosts of ordinary rates
never reach it, so ``rejected`` also lets the rate decide how far a document may exceed a soft limit: its
severity (value over limit, the worst of the soft rules) times the host's shrunk rate over the mean rate must
stay under ``slack``, and severity alone under ``severe`` on any host. The pipeline goes by ``rejected``.

Plan: one scan measures the texts row by row (no shuffle); the measures are written once with the columns to
keep, and aggregated by host with map-side sums. The host table is written too. Up to ``MOST_HOSTS`` hosts, which
are counted first, it is broadcast, so the verdict comes to the rows where they are, and neither rows nor texts
move; beyond that the two written tables are sort-merge joined, where adaptive execution can split a hot host
because nothing but the two exchanges is in the join's stage.

Edge cases: a null or empty text has no words and fails the base rule. A null host is a host of its own.
Columns to keep may have any names.
Repeated rows are judged one by one. An empty table gives an empty result. Windows of words are compared
by 64-bit hash within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, written

_WINDOW = 8
#: Most hosts that are broadcast, some 100 bytes each.
MOST_HOSTS = 200_000


@dataclass(frozen=True)
class Rules:
    """Limits of the rules, as percentages or counts."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    min_mean_word: int = 2
    max_mean_word: int = 14
    host_rate: float = 0.5
    slack: float = 1.25
    severe: float = 3.0


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the same text."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - _WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(_WINDOW)]))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
            return F.array_sort(
                F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])
            )

        def add(acc: Column, i: Column) -> Column:
            fresh = i + _WINDOW - F.greatest(i, acc["until"])
            return F.struct((acc["n"] + fresh).alias("n"), (i + _WINDOW).alias("until"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
        return F.aggregate(_let(ordered, twins), start, add, lambda acc: acc["n"])

    counted = _let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda h: _let(
            windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))
        ),
    )
    return F.when(F.size(words) <= _WINDOW, 0).otherwise(counted)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    squeeze = lambda c: F.translate(c, SPACE, "")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: squeeze(x) != "")
    counted = docs.select(
        *[F.col(c) for c in docs.columns if c != text_col],
        words.alias("_w"),
        lines.alias("_l"),
        F.length(squeeze(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    return counted.select(
        *[F.col(c) for c in counted.columns if c not in ("_w", "_l")],
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, rules: Rules) -> tuple[DataFrame, int]:
    """One row per host (``host``, ``no_host``): whether the shrunk rate reaches ``rules.host_rate``, and its ratio
    to the mean rate; and the number of hosts.

    The prior has the mean and variance of the hosts' rates, both summed as integers in parts per
    million, so the result does not depend on the order of summing.
    """
    hosts = written(
        measured.groupBy("host", "no_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    )
    ppm = F.expr("(1000000 * f) div n")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(ppm).alias("s"), F.sum(ppm * ppm).alias("q")).first()
    k, s, q = sums["k"], sums["s"] or 0, sums["q"] or 0
    mean = s / (1e6 * k) if k else 0.0
    var = max(q / (1e12 * k) - mean * mean, 0.0) if k else 0.0
    strength = mean * (1 - mean) / var - 1 if var > 0 else 0.0
    a, b = max(mean * strength, 0.0), max((1 - mean) * strength, 0.0)
    rate = (F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    ratio = rate / F.lit(mean) if mean else F.lit(1.0)
    return hosts.select("host", "no_host", (rate >= rules.host_rate).alias("host_bad"), ratio.alias("host_ratio")), k


def _judged(docs: DataFrame, keep: list[str], text_col: str, host_col: str, rules: Rules) -> DataFrame:
    """As ``judge``, with the columns to keep named ``k_0`` and so on, apart from the operator's own."""
    rows = measure(
        docs.select(
            *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
            F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
            F.col(host_col).isNull().alias("no_host"),
            F.col(text_col).alias("_text"),
        ),
        "_text",
    )
    n = F.col("n_words")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * n)
    soft = (
        (100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"))
        | (F.col("word_chars") < rules.min_mean_word * n)
        | (F.col("word_chars") > rules.max_mean_word * n)
    )
    over = lambda a, b: a.cast("double") / F.greatest(b, F.lit(1))
    severity = F.greatest(
        over(100 * F.col("n_symbols"), rules.max_symbol_pct * F.col("word_chars")),
        over(100 * F.col("n_dup_lines"), rules.max_dup_line_pct * F.col("n_lines")),
        over(rules.min_mean_word * n, F.col("word_chars")),
        over(F.col("word_chars"), rules.max_mean_word * n),
    )
    rows = rows.withColumns({"base_failed": base, "soft_failed": soft})
    rows = written(rows.withColumn("failed", F.col("base_failed") | F.col("soft_failed")))
    hosts, n_hosts = host_verdicts(rows, rules)
    judged = rows.join(F.broadcast(hosts) if n_hosts <= MOST_HOSTS else hosts, ["host", "no_host"])
    by_host = F.col("host_bad") | (severity >= rules.severe) | (severity * F.col("host_ratio") >= rules.slack)
    return judged.select(
        *[f"k_{i}" for i in range(len(keep))],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "soft_failed", "host_bad",
        (~F.col("base_failed") & ~(F.col("soft_failed") & F.col("host_bad"))).alias("kept"),
        (F.col("base_failed") | (F.col("soft_failed") & by_host)).alias("rejected"),
    )


def judge(
    docs: DataFrame, keep: list[str], text_col: str = "text", host_col: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """``keep`` columns of every document with its measures, base_failed, soft_failed, host_bad, kept and rejected."""
    made = _judged(docs, keep, text_col, host_col, rules)
    return made.toDF(*keep, *made.columns[len(keep) :])


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", strict: bool = False, rules: Rules = Rules()
) -> DataFrame:
    """The documents that are kept, or with ``strict`` those not rejected, with all their columns.

    The verdict is carried with the row, so repeated ids and rows are judged one by one and nothing is joined by id.
    """
    made = _judged(docs, docs.columns, text_col, host_col, rules)
    good = made.where(~F.col("rejected") if strict else F.col("kept"))
    return good.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(docs.columns)])
