"""Every query against its oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from basisline.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(pd.Timestamp(v))


def rows(df):
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_carry_on_weekdays_equals_a_replay(spark, sf):
    df = QUERIES["basis_carry_weekdays"](spark, sf).toPandas().set_index("id")
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values(["ts", "event_id"])
    day = 24 * 3600
    by_key: dict = {}
    for r in e.itertuples():
        k, basis, at = (r.user_id, r.event_type), float(math.floor(r.value / 10)), r.ts
        state = by_key.setdefault(k, {"work": None, "day": None, "last": None})
        prior = state["last"] if state["day"] == at.date() and state["last"] is not None else state["work"]
        moved = None if prior is None else basis - prior[0]
        if moved:
            change, since = moved, at
        elif moved == 0 and prior[2] is not None and (at - prior[2]).total_seconds() <= day:
            change, since = prior[1], prior[2]
        else:
            change, since = 0.0, None
        state["last"], state["day"] = (basis, change, since), at.date()
        if at.weekday() < 5:
            state["work"] = state["last"]
        got = df.loc[r.event_id]
        assert got["change"] == change and (pd.isna(got["changed_at"]) if since is None else got["changed_at"] == since)
