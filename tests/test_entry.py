"""The registered queries against DuckDB on the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from tagwright import queries as own

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["assign_levenshtein_k1_indel", "count_long", "sample_qc", "pair_stats", "unmatched_top", "audit_safety", "quality_gate", "matrix_spearman", "panel_risk", "offset_select"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = own.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(own.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == Counter(tuple(_norm(r[i]) for i in at) for r in res.fetchall())


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(own.queries()) <= set(q)
