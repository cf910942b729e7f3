"""Quality rules: a learned decision list over text statistics.

The statistics are DataFrame expressions. Sequential covering learns rules for
low quality one after the other from labelled statistics: a conjunction of
thresholds is grown greedily by information gain on one part of the labels,
pruned on the rest, kept while it is precise there, and what it covers is
taken away before the next rule. The list is emitted as one ordered ``when``
chain, so scoring stays inside the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fence

#: Labelled rows that the list is fitted on at most, by order of a hash of their ids.
MAX_LABELLED = 6000
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the text statistics to documents.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
    3-word windows that the text has twice or more), base_failed and the shares
    in FEATURES. A null text has no words, so all counts are 0. Columns of
    these names are replaced. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM `__text`)")
    out = docs.withColumn("__text", text).withColumn("__trimmed", trimmed)
    out = out.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", f"[{SPACE}]+")))
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    # Hashes of 64 bits stand for the windows; two that differ inside one text collide with odds of about n^2 in 2^65.
    out = out.withColumn("__windows", F.expr("transform(slice(__words, 1, greatest(size(__words) - 2, 0)), (w, i) -> xxhash64(w, get(__words, i + 1), get(__words, i + 2)))"))
    out = out.withColumn("__sorted", F.expr("IF(size(array_distinct(__windows)) < size(__windows), sort_array(transform(__windows, (h, i) -> struct(h, i))), array())"))
    out = out.withColumn("__twice", F.expr("array_sort(transform(filter(transform(__sorted, (x, k) -> struct(x.i AS i, coalesce(get(__sorted, k - 1).h = x.h, false) OR coalesce(get(__sorted, k + 1).h = x.h, false) AS twice)), x -> x.twice), x -> x.i))"))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr("aggregate(__twice, struct(0L AS n, -3 AS last), (acc, p) -> struct(acc.n + least(3, p - acc.last) AS n, p AS last), acc -> acc.n)"),
        "__n_lines": F.size("__lines"),
    })
    out = out.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "__n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
    })
    out = fence(out, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES[1:]])
    return out.drop("__text", "__trimmed", "__words", "__lines", "__windows", "__sorted", "__twice", "__n_lines")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in self.tests)


def _thresholds(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    values = sorted({r[feature] for r in rows})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    step = max(1, len(cuts) // most)
    return cuts[step // 2 :: step]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict], features: tuple[str, ...], max_tests: int) -> list[Test]:
    tests: list[Test] = []
    while len(tests) < max_tests:
        bad, good = _counts(rows)
        if not bad or not good:
            break
        before, best = math.log2(bad / (bad + good)), (1e-9, None, rows)
        for feature in features:
            for threshold in _thresholds(rows, feature):
                for above in (True, False):
                    test = Test(feature, above, threshold)
                    inside = [r for r in rows if test.holds(r)]
                    p, n = _counts(inside)
                    if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                        best = (gain, test, inside)
        if best[1] is None:
            break
        tests.append(best[1])
        rows = best[2]
    return tests


def _worth(tests: list[Test], rows: list[dict]) -> tuple[float, int, int]:
    p, n = _counts([r for r in rows if all(t.holds(r) for t in tests)])
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn_list(rows: list[dict], features: tuple[str, ...] = FEATURES, min_precision: float = 0.9, min_covered: int = 4, max_rules: int = 12, max_tests: int = 3) -> list[Rule]:
    """Ordered rules for rows whose "bad" is 1. Every third row prunes and judges, the rest grow.

    With no labelled rows, or none of one class, the list is empty.
    """
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < max_rules and (tests := _grow(grow, features, max_tests)):
        worth = _worth(tests, prune)
        while len(tests) > 1 and (shorter := _worth(tests[:-1], prune))[0] >= worth[0]:
            tests, worth = tests[:-1], shorter
        _, p, n = worth
        if p + n < min_covered or p < min_precision * (p + n):
            break
        rule = Rule(tuple(tests), p / (p + n), p + n)
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a document, null if none does."""
    chain = None
    for k, rule in enumerate(rules):
        chain = F.when(rule.column(), k) if chain is None else chain.when(rule.column(), k)
    return F.lit(None).cast("int") if chain is None else chain.otherwise(F.lit(None).cast("int"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[dict]:
    """Statistics of at most max_rows labelled documents; a document with several labels counts as the worst."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__quality"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    found = with_statistics(texts.join(F.broadcast(picked), "__id")).select("__id", "__quality", *FEATURES)
    rows = [{f: float(r[f]) for f in FEATURES} | {"id": r["__id"], "bad": int(r["__quality"] == 0)} for r in found.collect()]
    return sorted(rows, key=lambda r: (hash_order(r["id"]), r["id"], *(r[f] for f in FEATURES)))


def hash_order(value: int) -> int:
    return (value * 0x9E3779B97F4A7C15 ^ (value >> 7)) & 0xFFFFFFFF


def apply_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents with their statistics, rule (number of the rule that rejects it, or null) and kept.

    kept is false where the base test fails or a learned rule holds. Null texts
    have no words and fail the base test; null ids, repeated rows and further
    columns pass through. An empty documents table gives an empty one; without
    labels, or with labels of one kind, there are no rules. No shuffle of the documents; the labelled sample is
    bounded by max_labelled, collected as numbers.
    """
    rules = learn_list(labelled_statistics(docs, labels, max_labelled))
    out = with_statistics(docs).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
