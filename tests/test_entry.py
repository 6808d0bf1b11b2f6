"""Every query that has SQL agrees with DuckDB on the smallest tables (the quick ones here; the rest by the driver)."""

import math

import duckdb
import pytest

from cellscape import registry

SF = "/root/testdata/sf0.001"
QUICK = [n for n in registry.ORACLE_SQL if n.split("_")[0] in {"G1", "G3", "P10", "P17", "P20", "P24", "P26", "A2", "A17", "J2", "U6", "W4", "Q", "F7", "L1", "R8"}]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == expected
