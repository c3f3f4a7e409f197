"""The registry, and every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from benchtide.plans import catalog

TESTDATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
@pytest.mark.parametrize("name", ["w1_fixed_threshold", "p22_zip_records", "j2_cross_combination", "g1_grouped_values", "p4_entries", "p19_path_enumeration", "w2_relative_difference", "w3_change_localisation", "w4_cool_down", "w5_deviation", "j6_descendants", "m4_ephemeral", "j11_reconcile", "t1_continuous_ingest", "t10_online_deviation"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    want, got = con.execute(catalog.ORACLES[name]).df(), catalog.QUERIES[name](spark, TESTDATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
