"""Quality rules: document statistics as Spark expressions, and decision lists that are learned from labelled ones.

``statistics`` counts within a row, so that texts are never shuffled.  ``learn`` is sequential covering: a rule is grown on one part of
the labelled documents, a condition at a time, by information gain; it is cut back to the prefix that does best on the other part; the
documents that it covers go, and the next rule is grown on the rest.  ``verdict`` turns the list into one conditional
expression.  Everything is DataFrame functions; the driver only sees histograms of a fixed number of thresholds.

Cases: null texts count as empty and have zero for every statistic.  Ratios over nothing are 0.  A document labelled twice counts once with
its larger label.  Without labels of both classes there is no rule and the verdict is to keep.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, labelled, materialize

FEATURES = ("symbol_ratio", "upper_ratio", "mark_ratio", "mean_word", "distinct_ratio", "repeat_ratio", "dup_line_ratio")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, which an inner lambda would otherwise compute for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words that lie in a window of ``width`` words which occurs twice or more in the text.

    Windows are told apart by 64-bit hashes.  Sorting (hash, position) puts equal windows side by side: no step compares all with all.
    """

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["at"], x["at"] + width - 1)))))

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, 0).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def statistics(documents: DataFrame) -> DataFrame:
    """``documents`` with the base counts, ``base_failed`` and the ratios in ``FEATURES``."""
    text = F.coalesce("text", F.lit(""))
    kept = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    # words and lines are columns of their own first: each is split once
    split = documents.withColumns({"_words": F.array_remove(F.split(text, f"[{SPACES}]+"), ""), "_lines": lines})
    counted = split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": kept("#*$%&|<>"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "_distinct": F.size(F.array_distinct("_words")),
        "_n_lines": F.size("_lines"),
        "_upper": kept("\\p{Lu}"),
        "_marks": kept("!?|"),
    }).drop("_words", "_lines")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "upper_ratio": ratio("_upper", "word_chars"),
        "mark_ratio": ratio("_marks", "n_words"),
        "mean_word": ratio("word_chars", "n_words"),
        "distinct_ratio": ratio("_distinct", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "_n_lines"),
    }).drop("_distinct", "_n_lines", "_upper", "_marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Condition, ...]


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def learn(stats: DataFrame, y: str = "y", key: str = "doc_id", target: int = 0, thresholds: int = 24, most_conditions: int = 3, most_rules: int = 8, least_cover: int = 5, least_precision: float = 0.8) -> list[Rule]:
    """Rules for the class ``target`` from labelled statistics, in order.

    Documents are first summed by the bucket that each feature has between the thresholds; every step is then a histogram of those
    sums, at most features x thresholds rows.  ``most_conditions`` of a rule and ``most_rules`` bound the list; a document that no rule covers is kept.
    """
    shares = [(i + 0.5) / thresholds for i in range(thresholds)]
    cuts_row = stats.agg(*[F.percentile_approx(f, shares, 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    if not any(cuts.values()):
        return []
    bucket = lambda f: reduce(lambda a, b: a + b, [(F.col(f) >= t).cast("int") for t in cuts[f]], F.lit(0)).alias(f)
    cells = stats.select(*[bucket(f) for f in FEATURES], (F.col(y) == target).alias("hit"), (F.pmod(F.xxhash64(key, F.lit(5)), F.lit(3)) == 0).alias("held"))
    # no more cells than labelled documents, whose number is bounded: in one partition a histogram needs no shuffle
    cells = materialize(cells.groupBy("hit", "held", *FEATURES).count(), "rule-cells").coalesce(1)
    inside = lambda c: F.col(c.feature) > cuts[c.feature].index(c.threshold) if c.at_least else F.col(c.feature) <= cuts[c.feature].index(c.threshold)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = cells.filter(_both([~_both([inside(c) for c in r]) for r in rules]))
        grown: list[tuple[Condition, float]] = []
        while len(grown) < most_conditions:
            best = _best_condition(left.filter(_both([inside(c) for c, _ in grown])), cuts, least_cover)
            if best is None:
                break
            grown.append(best[:2])
            if best[2]:
                break
        if not grown:
            break
        keep = max(range(len(grown)), key=lambda i: (grown[i][1], -i))
        if grown[keep][1] < least_precision:
            break
        rules.append(tuple(c for c, _ in grown[: keep + 1]))
    return rules


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], least_cover: int) -> tuple[Condition, float, bool] | None:
    """The condition with the highest gain on the growing part; its precision on the pruning part; whether it is pure."""
    part = lambda hit, held: F.sum(F.when((F.col("hit") == hit) & (F.col("held") == held), F.col("count")).otherwise(0))
    each = rows.select("hit", "held", "count", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"))
    sums = each.groupBy("x.f", "x.b").agg(part(True, False).alias("p"), part(False, False).alias("n"), part(True, True).alias("hp"), part(False, True).alias("hn")).collect()
    by = {f: {r["b"]: tuple(r)[2:] for r in sums if r["f"] == f} for f in FEATURES}
    total = [sum(v[i] for v in by[FEATURES[0]].values()) for i in range(4)]
    if not total[0] or not total[1]:
        return None
    before, best = math.log2(total[0] / (total[0] + total[1])), None
    for f in FEATURES:
        low = [0, 0, 0, 0]
        for i, t in enumerate(cuts[f]):
            low = [a + b for a, b in zip(low, by[f].get(i, (0, 0, 0, 0)), strict=True)]
            for at_least, (p, n, hp, hn) in ((False, low), (True, [a - b for a, b in zip(total, low, strict=True)])):
                if p >= least_cover:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, at_least, t), (hp + 1) / (hp + hn + 2), not n and not hn)
    return best and best[1:]


def learn_from_labels(documents: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 10_000) -> list[Rule]:
    """``learn`` on about ``bound`` labelled documents of each class at most."""
    sample = labelled(documents, labels, label, F.lit(False), bound)
    return learn(materialize(statistics(sample).select("doc_id", "y", *FEATURES), "rule-statistics"))


def verdict(rules: list[Rule]) -> Column:
    """Keep unless a rule of the ordered list drops."""
    out = None
    for rule in rules:
        covered = _both([c.column() for c in rule])
        out = F.when(covered, False) if out is None else out.when(covered, False)
    return F.lit(True) if out is None else out.otherwise(True)
