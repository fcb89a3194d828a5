"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import delivery

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(delivery.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(delivery.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plain(name: str) -> list[dict]:
    return pd.read_parquet(f"{FOLDER}/{name}.parquet").to_dict("records")


def test_linked_components_equal_brute_force(spark):
    cells: dict = {}
    for o in plain("orders"):
        cells.setdefault(int(o["o_totalprice"] // 10), []).append(o["o_custkey"])
    least = {o["o_custkey"]: o["o_custkey"] for o in plain("orders")}
    for group in cells.values():
        found = {least[c] for c in group}
        least = {c: min(found) if v in found else v for c, v in least.items()}
    got = {r.node: r.component for r in entry.queries()["linked_components"](spark, FOLDER).collect()}
    assert got == least and 1 < len(set(least.values())) < len(least)


def test_strict_local_times_equal_the_zone_table(spark):
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    zone, wanted = ZoneInfo("America/New_York"), {}
    for o in plain("orders"):
        wall = o["o_orderdate"].to_pydatetime() + timedelta(hours=o["o_orderkey"] % 4, minutes=30)
        instants = {wall.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = [t for t in instants if t.astimezone(zone).replace(tzinfo=None) == wall]
        wanted[o["o_orderkey"]] = (real[0].strftime("%Y-%m-%d %H:%M") if len(real) == 1 else None, len(real))
    got = {r.o_orderkey: (r.utc, r.candidates) for r in entry.queries()["strict_local_times"](spark, FOLDER).collect()}
    assert got == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
