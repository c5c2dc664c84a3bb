"""Text statistics as expressions, and decision lists of thresholds learned from labelled statistics.

A list is learned by sequential covering: a rule grows by the threshold that gains
most, is pruned on rows it has not seen, and what it covers is taken out before
the next rule.  The result is an ordered conditional expression.  All of it is
DataFrame operations; the driver sees counts per threshold only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import written
from .words import SEPARATORS, beside, unpacked, word_array

SYMBOLS = "#*$%&|<>"
#: Ratios that rules may use, from the statistics below.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "word_length", "distinct_ratio")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ``FEATURES``.

    Whole texts, one row at a time, without a shuffle.  Words in repeated windows of
    three are found by sorting the windows' 64-bit hashes with their positions, so a
    long text costs n log n; texts whose windows all differ skip that.  NULL and empty
    texts have zeros everywhere.  Input columns of these names (in any case) are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    kept = ["row"]
    rows = beside(docs, text).select(*kept, F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(_without(line, SEPARATORS)) > 0)
    rows = rows.select(*kept, "_text", word_array(F.col("_text")).alias("_words"), lines.alias("_lines"))
    windows = F.when(F.size("_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*kept, "_text", F.size("_words").cast("long").alias("n_words"),
                       F.size(F.array_distinct("_words")).alias("_different"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.size("_lines").alias("_n_lines"), windows.alias("_windows"))
    ranked = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                    F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_ranked", ranked).drop("_windows")

    def repeated(x: Column, j: Column) -> Column:
        same = (F.get("_ranked", j - 1)["h"] == x["h"]) | (F.get("_ranked", j + 1)["h"] == x["h"])
        return F.when(F.coalesce(same, F.lit(False)), x["i"])

    rows = rows.withColumn("_starts", F.array_sort(F.array_compact(F.transform("_ranked", repeated)))).drop("_ranked")
    # A start covers three words, or fewer up to the next start.
    cover = F.aggregate(F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3)))),
                        F.lit(0), lambda total, n: total + n)
    length = F.length("_text")
    rows = rows.select(
        *kept, "n_words", F.length(_without(F.col("_text"), SEPARATORS)).cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"), "n_dup_lines",
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_text", F.lit("\\p{Lu}")).alias("_upper"),
        (length - F.length(_without(F.col("_text"), "0123456789"))).alias("_digits"),
        (length - F.length(_without(F.col("_text"), ".,;:!?"))).alias("_marks"), "_different", "_n_lines")

    def ratio(part: str, whole: str) -> Column:
        return (F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("double")

    ratios = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "_n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
              "upper_ratio": ("_upper", "word_chars"), "digit_ratio": ("_digits", "word_chars"), "mark_ratio": ("_marks", "word_chars"),
              "word_length": ("word_chars", "n_words"), "distinct_ratio": ("_different", "n_words")}
    return unpacked(rows, docs, {n: F.col(n) for n in made[:5]} | {n: ratio(*parts) for n, parts in ratios.items()})


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects a text, all others keep it."""

    rules: tuple[tuple[Condition, ...], ...]

    def expression(self) -> Column:
        """True to keep."""
        out = None
        for rule in self.rules:
            holds = _all(rule)
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) + "\nkeep"


def _all(rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.expression()
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """Bad and good rows that every threshold condition covers; one row per feature and bin comes back."""
    def bin_of(f: str) -> Column:
        value = F.col(f)
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: value > c))

    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in cuts]))
    found = rows.select("bad", bins.alias("b")).groupBy("b.feature", "b.bin").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    out = {}
    for f, values in cuts.items():
        own = [(0, 0)] * (len(values) + 1)
        for r in found:
            if r["feature"] == f:
                own[r["bin"]] = (r["bad"], r["good"])
        for k, c in enumerate(values):  # bin n: above n thresholds
            out[Condition(f, True, c)] = tuple(map(sum, zip(*own[k + 1:], strict=True)))
            out[Condition(f, False, c)] = tuple(map(sum, zip(*own[:k + 1], strict=True)))
    return out


def learn_rules(statistics: DataFrame, *, label: str = "label", steps: int = 24, most_rules: int = 8, most_conditions: int = 3,
                least_precision: float = 0.9, least_rows: int = 3) -> DecisionList:
    """Learn when to reject from rows with the ``FEATURES`` and a label (0 is bad); NULL labels are left out.

    Thresholds are ``steps`` quantiles of each feature among bad and among all rows.  Two thirds
    of the rows (by hash) grow rules, one third prunes and accepts them: a rule has to be right on
    ``least_precision`` of what it covers there.  An empty table or one class gives an empty list.
    """
    rows = statistics.where(F.col(label).isNotNull()).select(*FEATURES, (F.col(label) <= 0).cast("int").alias("bad"))
    rows = written(rows.withColumn("_prune", F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0), "statistics")
    quantiles = [i / steps for i in range(steps + 1)]
    spread = rows.agg(*[F.percentile_approx(F.when(F.col("bad") >= only, F.col(f)), quantiles, 1000).alias(f"{f}:{only}")
                        for f in FEATURES for only in (0, 1)]).first()
    cuts = {f: sorted({float(c) for only in (0, 1) for c in (spread[f"{f}:{only}"] or [])}) for f in FEATURES}
    cuts = {f: c for f, c in cuts.items() if len(c) > 1}
    rules: list[tuple[Condition, ...]] = []
    left, pruning = rows.where(~F.col("_prune")), rows.where("_prune")
    while cuts and len(rules) < most_rules:
        rule: list[Condition] = []
        covered = left
        bad, good = covered.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0))).first()
        while len(rule) < most_conditions and good and bad >= least_rows:
            start = math.log2(bad / (bad + good))
            best, gain = None, 0.0
            for condition, (b, g) in _counts(covered, cuts).items():
                if b >= least_rows and b + g < bad + good and (own := b * (math.log2(b / (b + g)) - start)) > gain + 1e-9:
                    best, gain, after = condition, own, (b, g)
            if best is None:
                break
            rule.append(best)
            covered, (bad, good) = covered.where(best.expression()), after
        if not rule:
            break
        rule, precision, support = _pruned(rule, pruning)
        if precision < least_precision or not support:
            break
        rules.append(tuple(rule))
        taken = ~_all(rule)
        left, pruning = left.where(taken), pruning.where(taken)
    return DecisionList(tuple(rules))


def _pruned(rule: list[Condition], rows: DataFrame) -> tuple[list[Condition], float, int]:
    """The beginning of a rule that is right most often on unseen rows, with its precision and bad rows there."""
    sums = []
    for n in range(1, len(rule) + 1):
        holds = _all(rule[:n]).cast("int")
        sums += [F.coalesce(F.sum(holds * F.col("bad")), F.lit(0)), F.coalesce(F.sum(holds * (1 - F.col("bad"))), F.lit(0))]
    found = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    worth = [((found[2 * n] - found[2 * n + 1]) / max(1, found[2 * n] + found[2 * n + 1]), n) for n in range(len(rule))]
    best = max(worth, key=lambda w: (w[0], -w[1]))[1]
    bad, good = found[2 * best], found[2 * best + 1]
    return rule[:best + 1], bad / max(1, bad + good), bad
