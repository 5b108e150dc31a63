"""Every query that has an oracle gives the oracle's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from glyphlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents orders pages conversations events labels embeddings benchmark".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            x = float(x)
            return f"{x:.6g}" if not math.isnan(x) else "nan"
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, got_names = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLES[name])
    want, want_names = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert got_names == want_names
    assert got == want
