"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes good, bad or abstains on a text's statistics. Expectation-maximisation over the
counts of vote patterns estimates every rule's accuracy and the share of good texts without
labels; a text's posterior probability of being good then decides, not the number of failed rules.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import BLANK_CLASS, let, materialise

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def _repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that the text holds twice or more.

    Sorted window hashes give the repeated ones as equal neighbours. Their positions come from a
    look-up if they are few, else from sorting hashes with positions; both give the same. Sorted
    positions give the union of the three-word spans. Two windows of one text are told apart by
    64 bits (chance of an error in a text of 20,000 words: 1e-11).
    """
    no_hashes, no_places = F.array().cast("array<bigint>"), F.array().cast("array<int>")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        made = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n >= 3, made).otherwise(no_hashes)

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False)))

    def by_sort(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        is_twin = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: is_twin(s, k - 1, x) | is_twin(s, k + 1, x)), lambda x: x["i"])))

    def by_look_up(g: Column, twins: Column) -> Column:
        return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(twins, x), i)), lambda i: i.isNotNull())

    def places(g: Column, twins: Column) -> Column:
        return F.when(F.size(twins) == 0, no_places).when(F.size(twins) <= 16, by_look_up(g, twins)).otherwise(by_sort(g))

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    positions = let(let(words, hashes), lambda g: let(let(F.sort_array(g), repeated), lambda twins: places(g, twins)))
    return let(positions, covered)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every whole text; a null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(lines).cast("long").alias("n_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """SQL conditions over STATS; neither true (or null): the rule abstains."""

    name: str
    good: str
    bad: str


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("length", "false", "n_words < 30"),
    Rule("symbols", "n_symbols * 100 <= 3 * n_words", "n_symbols * 100 > 25 * n_words"),
    Rule("letters", "n_letters * 100 >= 90 * word_chars", "n_letters * 100 < 80 * word_chars"),
    Rule("lines", "false", "n_dup_lines * 100 > 30 * n_lines"),
    Rule("repeats", "false", "n_repeat_words * 100 > 30 * n_words"),
    Rule("word_length", "false", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    accuracies: tuple[float, ...]

    def log_odds(self, votes: Sequence[int]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, self.accuracies, strict=True))


def fit_label_model(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 40) -> LabelModel:
    """EM for one accuracy a rule and the prior, from (votes, count) of each distinct pattern.

    Votes are 1, -1 or 0 (abstains, which says nothing). Accuracies stay within 0.55 and 0.98,
    so that rules can't swap the meaning of good and bad; the prior stays within 0.05 and 0.95.
    """
    model, total = LabelModel(0.8, (0.8,) * n_rules), sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [1 / (1 + math.exp(-model.log_odds(v))) for v, _ in patterns]
        accuracies = []
        for r in range(n_rules):
            voted = sum(n for v, n in patterns if v[r])
            right = sum(n * (g if v[r] > 0 else 1 - g) for (v, n), g in zip(patterns, good, strict=True) if v[r])
            accuracies.append(min(0.98, max(0.55, (right + 8) / (voted + 10))))
        prior = sum(n * g for (_, n), g in zip(patterns, good, strict=True)) / total
        model = LabelModel(min(0.95, max(0.05, prior)), tuple(accuracies))
    return model


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, min_posterior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    A null or empty text has no words and fails the base rules (fewer than 50 words, or more
    than half of the words in repeated windows). The model is fitted on the patterns of all
    rows: at most 3 to the number of rules, whatever the input, reach the driver. Repeated rows
    are judged each by itself and alike; an empty table gives an empty result; other columns
    are ignored.
    """
    if len(rules) > 8:
        raise ValueError("eight rules at most, so that the table of patterns stays small")
    votes = [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"v{k}") for k, r in enumerate(rules)]
    voted = materialise(text_stats(docs, id_col, text_col).select("*", *votes), "quality-stats")
    names = [f"v{k}" for k in range(len(rules))]
    patterns = sorted((tuple(row[n] for n in names), row["count"]) for row in voted.groupBy(*names).count().collect())
    model = fit_label_model(patterns, len(rules))
    log_odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for n, a in zip(names, model.accuracies, strict=True):
        log_odds = log_odds + F.col(n) * F.lit(math.log(a / (1 - a)))
    posterior = 1 / (1 + F.exp(-log_odds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & (posterior >= min_posterior)).alias("kept"), posterior.alias("posterior"))
