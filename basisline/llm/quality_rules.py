"""Quality rules with risk-controlled thresholds.

Fixed base rules reject very short and very repetitive texts. Further rules compare ratios with cutoffs that labelled
holdout documents certify. The rules tighten together along one fixed sequence of settings; a setting rejects a document if
any ratio is over that rule's cutoff. Every stratum (language) walks the sequence from the loosest setting on and keeps the
last one before the first for which the exact (Clopper-Pearson) upper bound on its own false rejection rate of good
documents exceeds the allowed risk. Walking in a fixed order and stopping at the first failure needs no correction within a
stratum; over strata the error level is divided by rank: the r-th largest stratum (by labelled good documents) tests at
error / (r (r + 1)), and these shares sum to at most the error for any number of strata, so a further stratum takes nothing
from the larger ones. A stratum with too few labels to certify the loosest setting (`needed` says how many that are)
rejects nothing beyond the base rules: no stratum borrows the cutoffs of another.

Edge cases: null and empty texts have no words and fail the base rules; null languages form a stratum; without labels the
base rules alone decide; an empty table gives an empty result; repeated rows are judged alike; extra columns are kept by
`keep_good` and ignored by `judge`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import BLANKS, bind, stored, table

#: Rule name -> its cutoff in each setting, from the loosest to the strictest; a ratio over it rejects.
RULES = {
    "symbol_ratio": (0.50, 0.40, 0.30, 0.25, 0.20, 0.16, 0.13, 0.10, 0.08, 0.06, 0.05, 0.04),
    "upper_ratio": (0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20),
    "exclaim_ratio": (1.50, 1.00, 0.70, 0.50, 0.40, 0.30, 0.25, 0.20, 0.175, 0.15, 0.125, 0.10),
    "dup_line_ratio": (0.90, 0.80, 0.70, 0.60, 0.55, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20),
    "repeat_word_ratio": (0.50, 0.45, 0.40, 0.375, 0.35, 0.325, 0.30, 0.25, 0.225, 0.20, 0.15, 0.10),
}
N_SETTINGS = 12


@dataclass(frozen=True)
class RiskBudget:
    """At most `max_false_rejection` of each stratum's good documents may go beyond the base rules; with confidence
    1 - `error` this holds in all strata at once."""

    max_false_rejection: float = 0.02
    error: float = 0.05


def measured(docs: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """Add the base counts and rule ratios of each whole text; every step stays inside its row."""
    text = F.coalesce(text, F.lit(""))
    w = bind(docs, keep, text_=text, words=F.array_remove(F.split(text, BLANKS), ""))
    lines = F.filter(F.split(F.col("text_"), "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    w = bind(
        w,
        keep,
        n_words=F.size("words"),
        word_chars=F.length(F.array_join("words", "")),
        n_symbols=F.regexp_count("text_", F.lit(r"[#*$%&|<>]")),
        n_upper=F.regexp_count("text_", F.lit("[A-Z]")),
        n_exclaim=F.regexp_count("text_", F.lit("!")),
        lines=lines,
        wh=F.transform("words", lambda x: F.xxhash64(x)),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim"]
    grams = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), lambda i: F.xxhash64(F.col("wh")[i], F.col("wh")[i + 1], F.col("wh")[i + 2]))).otherwise(F.lit([]).cast("array<bigint>"))
    w = bind(w, [*keep, *counts], n_lines=F.size("lines"), n_dup_lines=F.size("lines") - F.size(F.array_distinct("lines")), h=grams)
    counts += ["n_lines", "n_dup_lines"]
    w = bind(w, [*keep, *counts, "h"], s=F.sort_array("h"))
    w = bind(w, [*keep, *counts, "h"], d=F.array_distinct(F.filter("s", lambda x, k: (k > 0) & (x == F.col("s")[F.greatest(k - 1, F.lit(0))]))))
    # Few repeated windows: look each window up in them. Many: sort the windows with their places. Both are exact.
    places = F.sequence(F.lit(0), F.size("h") - 1)
    w = bind(
        w,
        [*keep, *counts, "h", "d"],
        z=F.when(F.size("d") > 48, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    near = lambda e, k: ((k > 0) & (e.x == F.col("z")[F.greatest(k - 1, F.lit(0))].x)) | ((k < F.size("z") - 1) & (e.x == F.col("z")[F.least(k + 1, F.size("z") - 1)].x))
    w = bind(
        w,
        [*keep, *counts],
        p=F.when(F.size("d") == 0, F.lit([]).cast("array<int>"))
        .when(F.size("d") > 48, F.sort_array(F.transform(F.filter("z", near), lambda e: e.i)))
        .otherwise(F.filter(places, lambda i: F.array_contains("d", F.col("h")[i]))),
    )
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.when(k < F.size("p") - 1, F.least(F.lit(3), F.col("p")[F.least(k + 1, F.size("p") - 1)] - x)).otherwise(3)), F.lit(0), lambda a, x: a + x
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    w = bind(w, [*keep, *counts], n_repeat_words=covered)
    w = w.select(
        *keep,
        *[F.col(c).cast("long").alias(c) for c in (*counts, "n_repeat_words")],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_exclaim", "n_words").alias("exclaim_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )
    return w.withColumn("setting", first_rejecting())


def first_rejecting() -> Column:
    """The loosest setting that rejects the document, N_SETTINGS if none does. Settings only tighten, so all later ones do."""
    by_rule = []
    for rule, cuts in RULES.items():
        place = F.lit(N_SETTINGS)
        for i in range(N_SETTINGS - 1, -1, -1):
            place = F.when(F.col(rule) > cuts[i], i).otherwise(place)
        by_rule.append(place)
    return F.least(*by_rule)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if n == 0 or p <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def certified(k: int, n: int, risk: float, error: float) -> bool:
    """Is the Clopper-Pearson upper bound for k false rejections of n within `risk`, at level `error`?"""
    return n > 0 and k < n and binomial_tail(k, n, risk) <= error


def needed(risk: float, error: float) -> int:
    """The fewest labelled good documents that certify anything at this level: those of no false rejection at all."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def last_certified(rejected: list[int], n: int, risk: float, error: float) -> int:
    """Of settings that falsely reject `rejected[j]` of n good documents: the last one certified before the first that is
    not, -1 if none is."""
    return next((j - 1 for j, k in enumerate(rejected) if not certified(k, n, risk, error)), len(rejected) - 1)


def learn_settings(metrics: DataFrame, labels: DataFrame, budget: RiskBudget, stratum: str = "lang", key: str = "doc_id") -> dict[str, int]:
    """The certified setting of each stratum that has one. Only a histogram of settings reaches the driver, and only of
    strata large enough to be certified at rank one: at most N_SETTINGS + 1 rows for every `needed` labelled documents."""
    good = labels.where(F.col("quality") == 1).select(F.col(key).alias("__k")).distinct()
    held = metrics.where(~F.col("base_failed")).join(good, F.col(key) == F.col("__k"), "left_semi")
    by = held.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("setting") <= j, 1)).alias(f"k{j}") for j in range(N_SETTINGS)])
    rows = by.where(F.col("n") >= needed(budget.max_false_rejection, budget.error / 2)).collect()
    out = {}
    for r, row in enumerate(sorted(rows, key=lambda x: (-x["n"], x["s"])), 1):
        j = last_certified([row[f"k{j}"] for j in range(N_SETTINGS)], row["n"], budget.max_false_rejection, budget.error / (r * (r + 1)))
        if j >= 0:
            out[row["s"]] = j
    return out


def over_cutoff(settings: dict[str, int], stratum: Column) -> Column:
    """True where a ratio is over its cutoff in the stratum's certified setting."""
    s = F.coalesce(stratum, F.lit(""))
    verdict = F.lit(False)
    for name, j in sorted(settings.items()):
        verdict = verdict | ((s == name) & (F.col("setting") <= j))
    return verdict


def judge(docs: DataFrame, labels: DataFrame, budget: RiskBudget | None = None) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed and kept."""
    narrow = docs.select("doc_id", "lang", "text")
    metrics = stored(measured(narrow, ["doc_id", "lang"], F.col("text")), "quality-metrics")
    settings = learn_settings(metrics, labels, budget or RiskBudget())
    return metrics.withColumn("kept", ~F.col("base_failed") & ~over_cutoff(settings, F.col("lang")))


def keep_good(docs: DataFrame, labels: DataFrame, budget: RiskBudget | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns unchanged."""
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id"), F.col("lang"), F.col("text"))
    metrics = stored(measured(packed, ["__row", "doc_id", "lang"], F.col("text")), "quality-rows")
    settings = learn_settings(metrics, labels, budget or RiskBudget())
    return metrics.where(~F.col("base_failed") & ~over_cutoff(settings, F.col("lang"))).select("__row.*")


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
