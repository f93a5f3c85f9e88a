"""Every registered query against its SQL at the smallest scale."""

import math
from datetime import date

import duckdb
import pandas as pd
import pytest

from lattica import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return bool(x)
    if isinstance(x, str):
        return x
    return round(float(x), 4) + 0.0 if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted([tuple(map(cell, r)) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query(spark, sf, oracle, name):
    got, want = normal(core.QUERIES[name](spark, sf).toPandas()), normal(oracle.execute(core.ORACLE_SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:3]


def test_irr(spark, sf):
    row = core.QUERIES["irr_xirr"](spark, sf).first()
    assert -1 < row.irr < 2 and row.xirr is not None


def test_irr_over_all_orders(spark, sf):
    """Bisection over the monthly totals of the whole table."""
    totals, outlay = {}, 0.0
    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderdate", "o_totalprice").collect():
        month = str(r.o_orderdate)[:7]
        totals[month] = totals.get(month, 0.0) + r.o_totalprice
        outlay -= 0.8 * r.o_totalprice
    first = [int(x) for x in min(totals).split("-")]
    begin = date(first[0] - (first[1] == 1), (first[1] - 2) % 12 + 1, 1)
    flows = [(begin, outlay)] + [(date(int(m[:4]), int(m[5:]), 1), v) for m, v in sorted(totals.items())]

    def root(f):
        low, high = -0.9, 2.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > 0 else (low, mid)
        return low

    worth = lambda r: sum(v / (1 + r) ** ((d - begin).days / 365) for d, v in flows)
    row = core.QUERIES["irr_xirr"](spark, sf).first()
    assert abs(row.irr - root(lambda r: sum(v / (1 + r) ** i for i, (_, v) in enumerate(flows)))) < 6e-5  # four places are given
    assert abs(row.xirr - root(worth)) < 6e-5 and abs(row.xnpv - worth(0.1)) < 1e-6 * abs(outlay)



def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
