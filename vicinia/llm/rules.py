"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes for good (1), votes for bad (-1) or abstains (0), by two
thresholds on one measure. Nobody knows which rule is right. Documents are taken to
be good, or bad with one of the rules' faults in the main: faults differ, and a bad
document shows few of them. Expectation maximisation over the counts of vote
patterns estimates, from all documents, how often each rule casts each vote on the
documents of each class, and how large the classes are. A rule that hardly ever
votes against a good document carries weight when it does, though others see
nothing wrong; one that often does carries little. A document stays if the
posterior probability that it is good is at least ``keep_from``.

Defined results: a null or empty text has no words, all measures are 0 and the
base rule fails it; the ratios of a text without words count as 0; repeated rows
each get their own equal result; over an empty table the estimates keep their
starting values and the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .mixing import word_array

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Good up to ``good``, bad beyond ``bad``, or the other way round where ``good > bad``."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.measure)
        if self.good <= self.bad:
            good, bad = value <= self.good, value > self.bad
        else:
            good, bad = value >= self.good, value < self.bad
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.01, 0.1),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.15, 0.35),
    Rule("lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.4),
    Rule("short_words", "word_chars / greatest(n_words, 1)", 4.0, 2.5),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 8.0, 12.0),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", 0.1, 0.3),
    Rule("stops", "n_stops / greatest(n_words, 1)", 0.3, 0.8),
    Rule("sentences", "n_stops / greatest(n_words, 1)", 0.03, 0.005),
)
VOTES = (-1, 0, 1)
#: How often good documents get each vote, those with a rule's fault from that rule, and from others.
START_GOOD, START_FAULT, START_OTHER = (0.001, 0.199, 0.8), (0.9, 0.05, 0.05), (0.2, 0.2, 0.6)
GOOD_SHARE = 0.8
#: Made-up documents of each class that vote as at the start: they keep unused votes where they are.
PRIOR = 2.0
ROUNDS, CLOSE_ENOUGH = 15, 1e-3


def measures(documents: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts per document.

    Repeated windows are found by sorting the document's own window hashes; no
    window leaves its row.
    """
    kept = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    blank = F.array().cast("array<bigint>")
    rows = documents.select(F.col(row_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", word_array(F.col("_text")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    rows = rows.select(
        row_id,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        kept(f"[^{SYMBOLS}]+").alias("n_symbols"),
        kept("[^A-Z]+").alias("n_capitals"),
        kept("[^.!?]+").alias("n_stops"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("n_words") >= 3,
            F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window),
        ).otherwise(blank).alias("_windows"),
    )
    # Most documents repeat nothing and need no sorting.
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = lambda x, i: (
        F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
    )
    rows = rows.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"])))
    # Windows of three words starting p apart share what overlaps.
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, x: total + x,
    )
    return rows.select(
        row_id, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", "n_capitals", "n_stops",
    )


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Estimates:
    """Shares of the classes (good first, then one for each rule's fault), and their votes by class, rule and vote."""

    shares: tuple[float, ...]
    rates: tuple[tuple[tuple[float, ...], ...], ...]


def start() -> Estimates:
    n = len(RULES)
    faults = [tuple(START_FAULT if j == k else START_OTHER for j in range(n)) for k in range(n)]
    return Estimates((GOOD_SHARE, *[(1 - GOOD_SHARE) / n] * n), ((START_GOOD,) * n, *faults))


def log_scores(estimates: Estimates) -> list[Column]:
    """The logarithm of each class's share and of the votes' probability in it, good first."""
    scores = []
    for share, rates in zip(estimates.shares, estimates.rates, strict=True):
        score = F.lit(math.log(share))
        for rule, own in zip(RULES, rates, strict=True):
            against, none, support = (F.lit(math.log(rate)) for rate in own)
            vote = F.col(f"vote_{rule.name}")
            score = score + F.when(vote < 0, against).when(vote > 0, support).otherwise(none)
        scores.append(score)
    return scores


def posterior(scores: list[str], number: int) -> Column:
    """The probability of one class, from columns of the logarithms of all."""
    rest = F.lit(0.0)
    for name in scores:
        rest = rest + F.exp(F.col(name) - F.col(scores[number]))
    return F.lit(1.0) / rest


def with_posteriors(rows: DataFrame, estimates: Estimates) -> tuple[DataFrame, list[str]]:
    """``rows`` with a column of the logarithm for each class, and the names of these."""
    names = [f"_log_{k}" for k in range(len(estimates.shares))]
    return rows.withColumns(dict(zip(names, log_scores(estimates), strict=True))), names


def estimate(patterns: DataFrame) -> Estimates:
    """Shares and votes of the classes from vote patterns and their counts ``n``.

    There are at most 3 ** rules patterns, however many documents.
    """
    found = start()
    votes = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"vote_{r.name}").alias("vote")) for k, r in enumerate(RULES)])
    for _ in range(ROUNDS):
        rows, names = with_posteriors(patterns, found)
        chances = F.array(*[posterior(names, k) for k in range(len(names))])
        rows = rows.select("n", votes.alias("votes"), F.posexplode(chances).alias("class", "p"))
        rows = rows.select("class", (F.col("n") * F.col("p")).alias("mass"), F.explode("votes").alias("v"))
        # One row for each class, rule and vote.
        sums = rows.groupBy("class", "v.rule", "v.vote").agg(F.sum("mass").alias("mass")).collect()
        mass = {(r["class"], r["rule"], r["vote"]): r["mass"] for r in sums}
        sizes = [sum(mass.get((c, 0, v), 0.0) for v in VOTES) for c in range(len(found.shares))]
        if not sum(sizes):
            break
        begin = start()
        rates = tuple(
            tuple(
                tuple(
                    (mass.get((c, k, v), 0.0) + PRIOR * before) / (sizes[c] + PRIOR)
                    for v, before in zip(VOTES, begin.rates[c][k], strict=True)
                )
                for k in range(len(RULES))
            )
            for c in range(len(sizes))
        )
        total = sum(sizes) + PRIOR
        shares = tuple((size + PRIOR * before) / total for size, before in zip(sizes, begin.shares, strict=True))
        moved = max(abs(a - b) for a, b in zip(shares, found.shares, strict=True))
        found = Estimates(shares, rates)
        if moved < CLOSE_ENOUGH:
            break
    return found


def judge(documents: DataFrame, row_id: str = "doc_id", text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """Counts, votes, ``quality`` (posterior probability), ``base_failed`` and ``kept`` per document."""
    rows = measures(documents, row_id, text)
    votes = [rule.vote().alias(f"vote_{rule.name}") for rule in RULES]
    rows = cut(rows.select("*", *votes))
    names = [f"vote_{rule.name}" for rule in RULES]
    patterns = cut(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    rows, scores = with_posteriors(rows, estimate(patterns))
    rows = rows.withColumn("quality", posterior(scores, 0)).withColumn("base_failed", base_failed()).drop(*scores)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
