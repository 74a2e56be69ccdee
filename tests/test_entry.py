"""The driver's contract, and SQL parity of a few queries at the smallest scale."""

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query", "name", "score", "coverage", "match_containment"]


@pytest.mark.parametrize("name", ["sketch_sizes", "search_containment", "gather_rounds3", "read_top_label", "annotate_counts", "coverage_per_strain", "genome_coverage", "gram_fold", "collapse_components", "fence", "assign_observed", "assign_reassigned", "refine_rhs", "planted_nnls", "planted_species", "parse_spec", "catalog_props", "catalog_releases", "gather_full", "class_hits_genome", "stored_bank_search", "mapping_lines", "assign_imputed_sparse"])
def test_parity(spark, con, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))
