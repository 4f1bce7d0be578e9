import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from registry import oracles, queries

SF = "/root/testdata/sf0.001"
# one query of each kind; check.py compares all of them
SAMPLE = ["parse_lines", "window_features", "unusual_patterns", "split_nested", "tfidf_seq_anomalies", "sequence_risk", "lof", "read_first_rows"]
# trained results
NO_SQL = {
    "autoencoder", "order_classifier", "seq_classifier", "model_comparison", "row_model_comparison",
    "stacking", "iforest", "pca_recon", "rff_ocsvm", "detect_all", "lof_rows",
    "lof_forest_recall",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(queries.queries()) - set(oracles.oracle_sql()) == NO_SQL
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, SF)
    res = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"sequence_index", "risk_score", "risk_level"} <= set(rows[0].asDict())
