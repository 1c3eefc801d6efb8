"""Rules met by slices of thresholds: the same hits as every pair, and few pairs looked at."""

import itertools
import math
import operator
import random

from pyspark.sql import functions as F

from basisline.operators import alerts

OPS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "=": operator.eq}
RULES = "rule_id int, rule_type string, comparison_operator string, threshold double"


def test_slices_give_every_hit_once(spark, monkeypatch):
    rng = random.Random(2)
    rules = [(i, rng.choice(["basis", " Basis", "cash_price_bu"]), rng.choice([*OPS, " > ", "!=", None]), rng.choice([float(rng.randrange(40)), rng.uniform(0, 40), 7.0, 7.0, None, float("nan")])) for i in range(900)]
    rows = [(i, rng.choice([float(rng.randrange(41)), 7.0, None, float("nan")]), rng.uniform(-1, 42)) for i in range(300)]
    want = []
    for (r, kind, op, t), (k, basis, cash) in itertools.product(rules, rows):
        v = basis if kind.strip().lower() == "basis" else cash
        if op is not None and op.strip() in OPS and t is not None and not math.isnan(t) and v is not None and not math.isnan(v) and OPS[op.strip()](v, t):
            want.append((r, k))
    monkeypatch.setattr(alerts, "SLICE_RULES", 5)
    monkeypatch.setattr(alerts, "CHUNK", 4)
    for few in (10_000, 0):
        got = alerts.triggered(spark.createDataFrame(rows, "id int, basis double, cash_price_bu double"), spark.createDataFrame(rules, RULES), few=few)
        assert sorted((x.rule_id, x.id) for x in got.collect()) == sorted(want)
    none = spark.createDataFrame([], RULES)
    assert alerts.triggered(spark.createDataFrame(rows, "id int, basis double, cash_price_bu double"), none).count() == 0


def test_pairs_looked_at_are_near_the_hits(spark):
    rules = spark.range(10_000).select(F.col("id").cast("int").alias("rule_id"), F.lit("basis").alias("metric"), F.lit("up").alias("way"), (F.col("id") / 10).alias("threshold"))
    lines = spark.range(500).select(F.lit("basis").alias("metric"), (F.col("id") / 100).alias("value"))
    pairs = alerts.sliced_pairs(lines, rules).withColumn("hit", F.col("value") > F.col("threshold"))
    compared, taken, hits = pairs.agg(F.count_if("compared"), F.count(F.lit(1)), F.count_if("hit")).first()
    assert hits == sum(math.ceil(i / 100 * 10) for i in range(500)) and taken - compared <= hits
    assert compared <= 500 * 2 * alerts.SLICE_RULES < 500 * 10_000 / 50
    assert pairs.where("not compared and not hit").isEmpty()


def test_saved_searches_folded_once(spark):
    rows = spark.createDataFrame([(1, " Brinston Corn", "CORN", "Agricharts", "c1", None), (2, None, "Corn", "Agricharts", "c1", "l")], "id int, location string, commodity_name string, source_name string, company_id string, location_id string")
    wants = [{"location": " BRINSTON "}, {"region": "chart", "company_id": "c1"}, {"location_id": "l"}, None, {"commodity_name": ""}, {"company_id": "C1"}]
    rules = spark.createDataFrame([(i, w) for i, w in enumerate(wants)], "rule_id int, filters map<string,string>")
    pairs = alerts.with_folded(rows).join(F.broadcast(alerts.with_wanted(rules)), F.lit(True))
    got = pairs.select("rule_id", "id", alerts.wanted_here().alias("fits"), alerts.saved_filter(F.col("filters"), pairs).alias("plain")).collect()
    assert all(r.fits == (r.plain is None or r.plain) for r in got)
    assert sorted((r.rule_id, r.id) for r in got if r.fits) == [(0, 1), (1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2)]


def test_totals_of_hits_without_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rules = [(i, rng.choice(["basis", " Basis", "cash_price_bu", "unknown"]), rng.choice([*OPS, " > ", "!=", None]), rng.choice([float(rng.randrange(40)), -0.0, 7.0, 7.0, None, float("nan"), float("inf"), -1.0])) for i in range(600)]
    rows = [(rng.choice([i, None]), rng.choice([float(rng.randrange(41)), 0.0, -0.0, 7.0, None, float("nan"), float("inf")]), rng.uniform(-1, 42)) for i in range(400)]
    monkeypatch.setattr(alerts, "SLICE_POINTS", 9)
    monkeypatch.setattr(alerts, "CHUNK", 4)
    rows, rules = spark.createDataFrame(rows, "id int, basis double, cash_price_bu double"), spark.createDataFrame(rules, RULES)
    want = alerts.triggered(rows, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("id").alias("total"))
    got = alerts.hit_totals(rows, rules, "id").select("rule_id", "hits", "total")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 100
    assert alerts.hit_totals(rows, rules.limit(0), "id").isEmpty() and alerts.hit_totals(rows.limit(0), rules, "id").isEmpty()


def test_many_rules_look_at_no_pairs(spark):
    n = 200_000  # 4e10 hits, which no join can list
    rules = spark.range(n).select(F.col("id").cast("int").alias("rule_id"), F.lit("basis").alias("rule_type"), F.lit(">=").alias("comparison_operator"), F.lit(-1.0).alias("threshold"))
    rows = spark.range(n).select("id", (F.col("id") % 1000).cast("double").alias("basis"))
    assert alerts.hit_totals(rows, rules, "id").agg(F.count(F.lit(1)), F.min("hits"), F.min("total"), F.max("total")).first() == (n, n, n * (n - 1) // 2, n * (n - 1) // 2)
