"""Host-level quality rules with shrunken failure rates (operator 6).

Every document is tested by simple rules on its whole text.  Failures are
summed per host (``source``), each host's failure rate of each rule is shrunk
to the corpus by a beta prior fitted to the hosts' rates (method of
moments), and a host is judged bad by its posterior: for some rule even the
lower end of the rate, ``DEVIATIONS`` standard deviations below its mean,
exceeds both ``TIMES`` the corpus rate and ``LEAST``, or exceeds ``LIMIT``.
So a host far above the others goes though most of its documents pass, one
with few documents needs more failures, and no host goes where failures are
rare.  The host verdict is joined back to its documents: a document stays if
it passes the base rules and its host is not bad.

Only DataFrame functions run.  Word windows never leave their row; the host
sums combine before the shuffle; eight numbers (mean and variance per rule)
reach the driver.

Defined results
    * null text has no words, so it fails the base rules;
    * a null host is a host of its own; repeated rows count as often as they
      occur and each get a row;
    * with one host, or equal rates on all hosts, the prior is as strong as
      ``STRONGEST`` documents;
    * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged, text_or_empty

GAPS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: rule name -> failing condition on the feature columns
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeats")
LIMIT = 0.5
LEAST = 0.2
TIMES = 3.0
DEVIATIONS = 3.0
STRONGEST = 1e6


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each whole text."""
    text = F.col("t")
    words = F.array_remove(F.split(F.translate(text, GAPS[1:], " " * (len(GAPS) - 1)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, GAPS) != "")
    step = docs.select("doc_id", "source", text_or_empty("text").alias("t")).select(
        "doc_id",
        "source",
        F.length(_without(text, GAPS)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
    )
    window = F.transform(
        F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - (WINDOW - 1))),
        lambda x, i: F.xxhash64(x, *(F.get("w", i + k) for k in range(1, WINDOW))),
    )
    step = step.select(
        "doc_id",
        "source",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("w").cast("bigint").alias("n_words"),
        window.alias("g"),
    )
    # only texts with a repeated window go on to find where
    placed = F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed)).drop("g")
    equal = lambda x, y: x["h"] == y["h"]
    repeated = F.filter(
        "s", lambda x, i: F.coalesce(equal(x, F.get("s", i - 1)), F.lit(False)) | F.coalesce(equal(x, F.get("s", i + 1)), F.lit(False))
    )
    step = step.withColumn("p", F.array_sort(F.transform(repeated, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"].cast("bigint"),
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("p")


def host_verdicts(
    tested: DataFrame, limit: float = LIMIT, least: float = LEAST, times: float = TIMES, deviations: float = DEVIATIONS
) -> DataFrame:
    """source, host_rate (largest shrunken rate) and host_bad; ``tested``: source and fail_<rule>."""
    hosts = tested.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"fail_{r}").cast("bigint")).alias(f"k_{r}") for r in RULES)
    )
    hosts = staged(hosts, "hosts")
    moments = hosts.agg(
        *(F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"m_{r}") for r in RULES),
        *(F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES),
    ).first()
    rates, bad = [], F.lit(False)
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        strength = STRONGEST if v <= 1e-12 else min(STRONGEST, max(0.0, m * (1 - m) / v - 1))
        weight = F.col("n") + F.lit(strength)
        rate = (F.col(f"k_{r}") + F.lit(m * strength)) / weight
        lower = rate - F.lit(deviations) * F.sqrt(rate * (F.lit(1.0) - rate) / (weight + F.lit(1.0)))
        rates.append(rate)
        bad = bad | (lower > min(limit, max(least, times * m)))
    return hosts.select("source", F.greatest(*rates).alias("host_rate"), bad.alias("host_bad"))


def judge(docs: DataFrame, **bounds: float) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate, host_bad."""
    tested = staged(features(docs).withColumns({f"fail_{r}": F.expr(rule) for r, rule in RULES.items()}), "rule-failures")
    hosts = host_verdicts(tested, **bounds).withColumnRenamed("source", "host")
    base = F.col(f"fail_{BASE[0]}") | F.col(f"fail_{BASE[1]}")
    return tested.join(hosts, F.col("source").eqNullSafe(F.col("host"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.col("host_bad")).alias("kept"), F.round("host_rate", 6).alias("host_rate"), "host_bad",
    )
