"""Every query that has SQL gives the SQL's rows, on the smallest test tables."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest

from quillspark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, con, name):
    found = con.execute(plans.SQL[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    df = plans.QUERIES[name](spark, SF)
    assert sorted(df.columns) == [found.description[i][0] for i in order]
    got = sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).where("provider is null").count() == 1


def test_prices_as_written_are_no_change(spark, tmp_path):
    """Calls that were written with the price they have: whether a price has changed is a matter of a double's last bit."""
    rows = []
    for k in range(0, 100, 5):  # no cached tokens: 800 k millionths
        rows.append((10 * k + 1, datetime(2024, 1, 2) + timedelta(seconds=k), 1, "purchase", round(k * 0.08, 2), f'{{"k": {k}}}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(plans.SQL["recost"])
    names = [x[0] for x in found.description]
    want = found.fetchall()
    assert [tuple(r) for r in plans.QUERIES["recost"](spark, str(tmp_path)).select(names).collect()] == want and 0 < want[0][names.index("changed")] < 20
