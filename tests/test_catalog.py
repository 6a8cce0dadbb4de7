import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUICK = ["er_normalize_name", "er_block_name_core", "er_cap_candidates", "er_expected_f05", "er_segments", "er_feat_contradiction", "er_validate"]


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{DATA}/part.parquet'")
    got = rows_of(entry.queries()[name](spark, DATA).toPandas())
    assert got == rows_of(con.execute(entry.oracle_sql()[name]).fetchdf()) and got


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_draws_the_default_replicates(spark):
    from kinlink.operators import metrics
    from kinlink.plans import catalog

    want = catalog.rounded(metrics.bootstrap_ci(catalog.anchor_counts(spark, DATA), n_boot=1000)).first()
    assert entry.queries()["er_bootstrap_ci"](spark, DATA).first() == want
