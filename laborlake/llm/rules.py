"""Quality rules learned as a decision list: sequential covering over statistics of labelled texts, in columns only.

``measure`` gives each text its statistics. ``learn`` grows one rule after another on two thirds of the labelled rows:
a rule is a conjunction of thresholds, each chosen for the best gain among all features, thresholds and directions, all
counted in one aggregation per step. A grown rule is cut back to the prefix that does best on the other third, taken
if enough of what it covers there is bad, and its rows are taken out before the next rule grows. ``verdict`` turns the
list into one ordered conditional expression.

What reaches the driver are counts per feature and threshold (features x thresholds rows), whatever the input's size.

Defined results: a null or empty text has no words, all statistics 0; shares of nothing are 0; repeated rows count as
often as they stand there; without labelled rows of both kinds the list is empty and nothing is rejected by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm import columns
from laborlake.sources.staging import staged

#: Words in a window whose repetition counts.
WINDOW = 8
FEATURES = (
    "n_words", "mean_word", "symbol_share", "upper_share", "bang_share", "digit_share", "dup_line_share", "repeat_share",
    "distinct_share", "line_words",
)
#: Thresholds tried per feature: that many quantiles of the labelled rows.
THRESHOLDS = 20


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeated_words(starts: Column) -> Column:
    """Words covered by windows at ``starts`` (ascending)."""
    first = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    grown = F.aggregate(
        starts,
        first,
        lambda a, p: F.struct((a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"), p.alias("last")),
    )
    return grown["total"]


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the features of ``FEATURES``.

    Windows are compared by a 64-bit hash of their words, within one text only.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(columns.WORD))
    rows = docs.select(*keep, text.alias("_text"), columns.words(text).alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep,
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count("_text", F.lit("[!?]")).alias("_bangs"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_digits"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_distinct_lines"),
        F.size(F.array_distinct("_words")).alias("_distinct_words"),
        windows.alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    in_order = F.when(
        repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_order", in_order).drop("_windows")
    found = F.filter(
        "_order", lambda x, i: (F.get("_order", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("_order", i + 1)["h"].eqNullSafe(x["h"]))
    )
    starts = F.when(F.size("_order") > 0, F.sort_array(F.transform(found, lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("n_repeat_words", _repeated_words(starts))
    words, chars = F.col("n_words"), F.col("word_chars")
    return rows.select(
        *keep,
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        (F.col("_n_lines") - F.col("_distinct_lines")).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        _share(chars, words).alias("mean_word"),
        _share(F.col("n_symbols"), chars).alias("symbol_share"),
        _share(F.col("_upper"), chars).alias("upper_share"),
        _share(F.col("_bangs"), chars).alias("bang_share"),
        _share(F.col("_digits"), chars).alias("digit_share"),
        _share(F.col("_n_lines") - F.col("_distinct_lines"), F.col("_n_lines")).alias("dup_line_share"),
        _share(F.col("n_repeat_words"), words).alias("repeat_share"),
        _share(F.col("_distinct_words"), words).alias("distinct_share"),
        _share(words, F.col("_n_lines")).alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """Rows for which all conditions hold are bad; ``precision`` is their share among such rows of the pruning third."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return all_of(self.conditions)


def all_of(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of ``cuts`` the value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(feature).cast("double") > t))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL's gain of a condition that leaves ``bad`` and ``good`` of the rows before it."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition with the best gain on ``rows`` (bins, bad), and its rows of either kind."""
    counts = (
        rows.select("bad", F.posexplode("bins").alias("f", "bin"))
        .groupBy("f", "bin")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
        .collect()
    )
    best, found = 0.0, (None, 0, 0)
    for f, name in enumerate(FEATURES):
        own = {r["bin"]: (r["bad"], r["n"] - r["bad"]) for r in counts if r["f"] == f}
        all_bad, all_good = (sum(v[k] for v in own.values()) for k in (0, 1))
        if not all_bad:
            continue
        low_bad = low_good = 0
        for b, cut in enumerate(cuts[name]):
            bad, good = own.get(b, (0, 0))
            low_bad, low_good = low_bad + bad, low_good + good
            for above, (x, y) in ((False, (low_bad, low_good)), (True, (all_bad - low_bad, all_good - low_good))):
                gain = _gain(x, y, all_bad, all_good)
                if gain > best * (1 + 1e-12):
                    best, found = gain, (Condition(name, above, cut), x, y)
    return found


def learn(
    labelled: DataFrame, *, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_covered: int = 5
) -> list[Rule]:
    """The ordered rules for rows with label 0, from measured rows with a column ``label`` and a column ``doc_id``."""
    points = [(k + 0.5) / THRESHOLDS for k in range(THRESHOLDS)]
    quantiles = labelled.agg(
        *[F.percentile_approx(F.when(F.col("label") == v, F.col(c).cast("double")), points, 1000).alias(f"{c}{v}") for c in FEATURES for v in (0, 1)]
    ).first()
    if quantiles[f"{FEATURES[0]}0"] is None or quantiles[f"{FEATURES[0]}1"] is None:
        return []
    cuts = {c: sorted({*quantiles[f"{c}0"], *quantiles[f"{c}1"]}) for c in FEATURES}
    bins = [_bin(c, cuts[c]) for c in FEATURES]
    rows = staged(
        labelled.select(
            *FEATURES, (F.col("label") == 0).cast("int").alias("bad"), F.array(*bins).alias("bins"),
            (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        ),
        "rule-rows",
    )
    rules: list[Rule] = []
    open_rows = F.lit(True)
    while len(rules) < most_rules:
        conditions: list[Condition] = []
        grow = rows.where(~F.col("prune") & open_rows)
        while len(conditions) < most_conditions:
            best, _, good = _best_condition(grow.where(all_of(conditions)), cuts)
            if best is None:
                break
            conditions.append(best)
            if not good:
                break
        if not conditions:
            break
        prefixes = [all_of(conditions[: k + 1]) for k in range(len(conditions))]
        held = rows.where(F.col("prune") & open_rows).agg(
            *[F.count(F.when(p, 1)).alias(f"n{k}") for k, p in enumerate(prefixes)],
            *[F.count(F.when(p & (F.col("bad") == 1), 1)).alias(f"b{k}") for k, p in enumerate(prefixes)],
        ).first()
        worth = [(2 * held[f"b{k}"] - held[f"n{k}"]) / held[f"n{k}"] if held[f"n{k}"] else -1.0 for k in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        n, bad = held[f"n{k}"], held[f"b{k}"]
        if n < least_covered or bad < least_precision * n:
            break
        rules.append(Rule(tuple(conditions[: k + 1]), bad / n, n))
        open_rows = open_rows & ~rules[-1].column()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(k))
    return out


def judge(docs: DataFrame, labels: DataFrame, *, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Statistics of every row of ``docs`` with base_failed, rule (the first that rejects) and kept.

    Rules are learned from labels of rows outside the held-out fifth. Texts are measured once and the statistics written.
    """
    stats = staged(measure(docs), "rule-stats")
    learned = columns.labelled(stats.where(columns.fold(F.col("doc_id"), 5) != 0), labels, "quality")
    rule = verdict(learn(learned))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("rule", rule)
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
