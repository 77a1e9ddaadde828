"""A sample of the registered queries against their SQL; all of them with QUERNSTONE_ALL=1."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, rows
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "k04_bm25_search", "k07_facets", "v02_knn_exact", "u02_weighted_fusion", "u08_search", "t07_fold_children_into_articles", "t17_clean_extraction", "t22_build_chunks",
    "g06_merge_policy", "g15_apply_modifications", "p01_traverse", "p04_shortest_path", "a12_citation_chains", "q07_extract_filters", "c06_assemble_prompt_context", "w01_prune_window",
    "s09_upsert_chunks", "f07_contains_scan",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("QUERNSTONE_ALL") else SAMPLE)
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    rel = con.sql(ORACLES[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert len(entry.entry(spark).schema.fields) == 5
