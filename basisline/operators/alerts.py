"""Alerts: rules matched against new rows, without repeats of what is still open.

Rows are turned to one line per metric. The thresholds of a metric and direction are cut into slices at quantiles; a line
takes every slice that its value passes as a whole and compares only within the one it falls in (which is all it takes of the
rules of equality), so the pairs that are looked at are the hits and a slice of rules a line, not every rule of the metric.
Counts and sums of a rule's hits need no pairs at all: `hit_totals` reads them from running sums over the sorted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions.text import using
from basisline.operators.sizes import small_or_shuffled
from basisline.storage import stored

METRICS = ("basis", "basis_change", "cash_price_bu", "cash_price_mt", "cash_price_bu_change", "cash_price_mt_change")
STATUSES = ("new", "open", "pending", "acknowledged", "resolved")
OPEN = ("new", "open", "pending")
FEW_RULES = 500_000  # rules that may be broadcast, if their bytes allow it too
SLICE_RULES = 64  # rules of a slice
SLICES = 4096  # slices of a metric and direction at most
CHUNK = 32  # bounds of slices that one step of the search passes
SLICE_POINTS = 20_000  # distinct values and thresholds of a slice of running sums


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """False for unknown operators and missing values."""
    op = F.trim(operator)
    found = F.when(op == ">", value > threshold).when(op == "<", value < threshold).when(op == ">=", value >= threshold).when(op == "<=", value <= threshold).when(op == "=", value == threshold)
    return F.coalesce(found, F.lit(False))


def holds(value: Column, needle: Column) -> Column:
    """Does the text hold the needle, ignoring case? An empty needle always fits, an empty text never."""
    wanted = F.lower(F.trim(F.coalesce(needle, F.lit(""))))
    return (wanted == "") | F.coalesce(F.contains(F.lower(F.trim(value)), wanted), F.lit(False))


def in_months(months: Column, *fields: Column) -> Column:
    """Is any month token part of the row's periods? No tokens: always; a row without periods: never."""
    tokens = F.filter(F.transform(F.coalesce(months, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    row = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return (F.size(tokens) == 0) | ((F.trim(row) != "") & F.exists(tokens, lambda t: F.contains(row, t)))


FILTER_TEXTS = {"location": "location", "commodity_name": "commodity_name", "source_name": "source_name", "region": "source_name"}  # of a search, and the column it reads
FILTER_IDS = ("location_id", "company_id")


def with_folded(rows: DataFrame) -> DataFrame:
    """Rows with `folded`: the texts that saved searches read, trimmed and in lower case once a row instead of once a pair."""
    return rows.withColumn("folded", F.struct(*[F.lower(F.trim(c)).alias(c) for c in dict.fromkeys(FILTER_TEXTS.values())]))


def with_wanted(rules: DataFrame, filters: str = "filters") -> DataFrame:
    """Rules with `wanted`: what their saved searches (maps) ask for, trimmed and in lower case, '' for nothing."""
    get = lambda k: F.coalesce(F.trim(F.col(filters)[k]), F.lit(""))
    return rules.withColumn("wanted", F.struct(*[F.lower(get(k)).alias(k) for k in FILTER_TEXTS], *[get(k).alias(k) for k in FILTER_IDS]))


def wanted_here() -> Column:
    """Does a row with `folded` fit a rule's `wanted`? Texts by part, ids by equality."""
    out = F.lit(True)
    for k, column in FILTER_TEXTS.items():
        out = out & ((F.col(f"wanted.{k}") == "") | F.coalesce(F.contains(F.col(f"folded.{column}"), F.col(f"wanted.{k}")), F.lit(False)))
    for k in FILTER_IDS:
        out = out & ((F.col(f"wanted.{k}") == "") | F.coalesce(F.col(k) == F.col(f"wanted.{k}"), F.lit(False)))
    return out


def saved_filter(filters: Column, row: DataFrame) -> Column:
    """Row form of a saved search (map of filters): texts by part, ids by equality; a missing search fits everything."""
    get = lambda k: F.coalesce(F.trim(filters[k]), F.lit(""))
    out = holds(row["location"], get("location")) & holds(row["commodity_name"], get("commodity_name")) & holds(row["source_name"], get("source_name")) & holds(row["source_name"], get("region"))
    for k in ("location_id", "company_id"):
        out = out & ((get(k) == "") | F.coalesce(row[k] == get(k), F.lit(False)))
    return out


def rule_totals(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: active rules and open alerts."""
    active = rules.agg(F.count_if(F.col("is_active")).alias("active_rules"))
    return active.join(alerts.agg(F.count_if(F.col("status").isin(*OPEN)).alias("open_alerts")), F.lit(True))  # two single rows


def by_metric(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One line per row and metric that has a value."""
    there = [m for m in metrics if m in rows.columns]
    lines = F.explode(F.filter(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in there]), lambda x: x.value.isNotNull() & ~F.isnan(x.value)))
    return rows.withColumn("__m", lines).select(*rows.columns, F.col("__m.metric").alias("metric"), F.col("__m.value").alias("value"))


def _way(operator: Column) -> Column:
    """Direction of a comparison: values above, below or equal to the threshold hit; null for unknown operators."""
    op = F.trim(operator)
    return F.when(op.isin(">", ">="), "up").when(op.isin("<", "<="), "down").when(op == "=", "same")


def _slice_of(value: Column, bounds: Column, coarse: Column) -> Column:
    """How many of the sorted bounds lie under the value: whole chunks first, then within one."""
    under = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    return using(under(coarse), lambda n: n * CHUNK + under(F.slice(bounds, n * CHUNK + 1, F.lit(CHUNK))))


def slices(rules: DataFrame) -> DataFrame:
    """metric, way, bounds and coarse (every CHUNK-th bound) for the rules: cuts at quantiles of their thresholds."""
    n = min(SLICES, -(-rules.count() // SLICE_RULES))
    cuts = [i / n for i in range(1, n)]
    bounds = F.array_distinct(F.percentile_approx("threshold", cuts, 10 * n)) if cuts else F.array().cast("array<double>")
    found = rules.groupBy("metric", "way").agg(F.count(F.lit(1)).alias("n_rules"), bounds.alias("bounds"))
    whole = F.filter("bounds", lambda b, i: i % CHUNK == CHUNK - 1)
    return found.select("metric", "way", "bounds", whole.alias("coarse"))


def sliced_pairs(lines: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """Line and rule of every slice a line takes; `compared` marks those of the slice that its value falls in.

    lines: metric and value; rules: metric, way and threshold (double), with a way each.
    """
    cuts = F.broadcast(slices(rules))  # a row for each metric and direction, of at most SLICES bounds
    named = rules.join(cuts, ["metric", "way"]).withColumn("slice", _slice_of(F.col("threshold"), F.col("bounds"), F.col("coarse"))).drop("bounds", "coarse")
    place = lines.join(cuts, "metric").withColumn("__p", _slice_of(F.col("value"), F.col("bounds"), F.col("coarse")))
    taken = F.when(F.col("way") == "up", F.sequence(F.lit(0), F.col("__p"))).when(F.col("way") == "same", F.array("__p")).otherwise(F.sequence(F.col("__p"), F.size("bounds")))
    taken = place.withColumn("slice", F.explode(taken)).withColumn("compared", F.col("slice") == F.col("__p")).drop("bounds", "coarse", "__p")
    return taken.join(small_or_shuffled(named, few), ["metric", "way", "slice"])


def _sound(rules: DataFrame) -> DataFrame:
    """Rules that can hit, with their metric, threshold (double) and way."""
    named = rules.withColumns({"metric": F.lower(F.trim("rule_type")), "threshold": F.col("threshold").cast("double"), "way": _way(F.col("comparison_operator"))})
    return named.where(F.col("way").isNotNull() & F.col("threshold").isNotNull() & ~F.isnan("threshold"))


def triggered(rows: DataFrame, rules: DataFrame, condition: Column | None = None, few: int = FEW_RULES) -> DataFrame:
    """Rule and row of every hit. `rules` has rule_id, rule_type, comparison_operator and threshold; `condition` may use
    columns of both sides. Rules with an unknown operator or a threshold that is no number never hit."""
    lines, named = by_metric(rows), _sound(rules)
    hits = sliced_pairs(lines, named, few).where(~F.col("compared") | compare(F.col("value"), F.col("comparison_operator"), F.col("threshold"))).drop("compared", "slice", "way")
    return hits if condition is None else hits.where(condition)


def hit_totals(rows: DataFrame, rules: DataFrame, summed: str) -> DataFrame:
    """Rules that hit, with `hits` and `total` (the hits' sum of the whole-number column `summed`), as grouping `triggered`
    would give them, without its pairs.

    Rows and thresholds become points: the distinct values of a metric, with the rows on them. Points are cut into slices at
    quantiles; sums of the slices before and running sums within one give what lies below a threshold, and the metric's
    total what lies above. The work follows rows and rules, not the hits.
    """
    lines = by_metric(rows.select(summed, *[m for m in METRICS if m in rows.columns])).select("metric", "value", F.lit(1).cast("long").alias("n"), F.coalesce(F.col(summed).cast("long"), F.lit(0)).alias("s"), F.col(summed).isNotNull().cast("long").alias("known"))
    named, zero = _sound(rules), F.lit(0).cast("long")
    sums = ("n", "s", "known")
    marks = named.select("metric", F.col("threshold").alias("value"), *[zero.alias(c) for c in sums])
    points = stored(lines.unionByName(marks).groupBy("metric", "value").agg(*[F.sum(c).alias(c) for c in sums]), "rule-points")
    parts = max(1, min(SLICES, -(-points.count() // SLICE_POINTS)))
    cuts = [i / parts for i in range(1, parts)]
    bounds = F.array_distinct(F.percentile_approx("value", cuts, 10 * parts)) if cuts else F.array().cast("array<double>")
    found = points.groupBy("metric").agg(bounds.alias("bounds"))
    found = found.withColumn("coarse", F.filter("bounds", lambda b, i: i % CHUNK == CHUNK - 1))  # a row a metric
    points = points.join(F.broadcast(found), "metric").withColumn("slice", _slice_of(F.col("value"), F.col("bounds"), F.col("coarse"))).drop("bounds", "coarse")
    of_slice = points.groupBy("metric", "slice").agg(*[F.sum(c).alias(c) for c in sums])  # a row a slice
    before = W.partitionBy("metric").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    of_slice = of_slice.select("metric", "slice", *[F.coalesce(F.sum(c).over(before), zero).alias(f"__before_{c}") for c in sums], *[F.sum(c).over(W.partitionBy("metric")).alias(f"__all_{c}") for c in sums])
    here = W.partitionBy("metric", "slice").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = points.withColumns({f"__upto_{c}": F.sum(c).over(here) for c in sums}).join(F.broadcast(of_slice), ["metric", "slice"])
    upto = upto.select("metric", F.col("value").alias("threshold"), *[F.struct((F.col(f"__before_{c}") + F.col(f"__upto_{c}")).alias("upto"), F.col(c).alias("on"), F.col(f"__all_{c}").alias("all")).alias(c) for c in sums])
    op = F.trim("comparison_operator")
    of = lambda c: F.when(op == ">", c["all"] - c["upto"]).when(op == ">=", c["all"] - c["upto"] + c["on"]).when(op == "<", c["upto"] - c["on"]).when(op == "<=", c["upto"]).otherwise(c["on"])
    out = named.join(upto, ["metric", "threshold"]).withColumns({"hits": of(F.col("n")), "total": of(F.col("s")), "__known": of(F.col("known"))})
    return out.where("hits > 0").select(*rules.columns, "hits", F.when(F.col("__known") > 0, F.col("total")).alias("total"))


def message(rule: str, kind: str, operator: str, threshold: str, value: str, *place: Column) -> Column:
    """Text of an alert; it holds the value, so a new value is a new alert."""
    words = [F.lit("Rule "), F.col(rule).cast("string"), F.lit(" triggered: "), F.col(kind), F.lit(" "), F.col(operator), F.lit(" "), F.col(threshold).cast("string"), F.lit(" (actual="), F.col(value).cast("string"), F.lit(") at ")]
    return F.concat(*words, F.concat_ws(" / ", *[F.coalesce(p, F.lit("n/a")) for p in place]))


def without_open(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Candidates (rule_id, message) that no open alert repeats."""
    still = alerts.where(F.col("status").isin(*OPEN)).select("rule_id", "message").distinct()
    return candidates.join(still, ["rule_id", "message"], "left_anti")


def rule_activity(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules with their last alert and number of open ones; one pass over the alerts."""
    seen = alerts.groupBy("rule_id").agg(F.max("triggered_at").alias("last_triggered_at"), F.count_if(F.col("status").isin(*OPEN)).alias("open_alerts"))
    return rules.join(seen, "rule_id", "left").withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))


def with_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with the latest valid status change (alert_id, status, at) of each; unknown statuses are ignored."""
    last = changes.where(F.col("status").isin(*STATUSES)).groupBy("alert_id").agg(F.max_by("status", F.struct("at", "status")).alias("__new"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
