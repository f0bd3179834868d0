"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lacuna.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["panel_profile", "temporal_block", "gap_run_slots", "robust_priors", "reconstruction_report", "events_advanced", "metric_grouping_sets", "donor_pairs", "centred_window", "submission_violations", "climatology_loyo", "anomaly_points_baseline", "same_date_excl_self", "fold_all_modes", "composed_prediction", "coverage_out_of_fold", "quality_report", "requested_run_slots", "run_templates", "matched_templates", "fields_meeting", "fields_in_box", "sites_in_fields", "robust_scaler", "doy_profile", "synthetic_cases", "year_audit", "year_audit_alignment", "expert_mixture", "column_importance", "pruned_weights", "saved_priors", "asked_warnings", "panel_violations", "run_diagnostics"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    found = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names))) for r in found.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_queries_without_sql_can_be_planned(spark):
    """Those with SQL are compared with it; features_delivered is left to its blocks' tests, as it takes a minute."""
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"features_delivered", "source_guesses", "source_experts"}):
        names = Q.QUERIES[name](spark, SF).columns
        assert len(set(names)) == len(names) and not [c for c in names if "." in c], name


def test_source_guesses_beat_the_most_frequent_source(spark):
    rows = [(r.source, r.source_guess) for r in Q.QUERIES["source_guesses"](spark, SF).collect()]
    most = max(sum(s == x for s, _ in rows) for x in {s for s, _ in rows})
    assert len(rows) > 500 and {g for _, g in rows} <= {"s2", "landsat", "modis"}
    assert sum(s == g for s, g in rows) >= most - 0.05 * len(rows)


def test_no_join_forms_all_pairs(spark):
    for name in ("asof_neighbors_k4", "seasonal_gaussian", "climatology_loyo", "events_advanced", "robust_priors"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_panel_is_derived_once(spark):
    for name in ("reconstruction_report", "metric_grouping_sets", "bootstrap_rmse", "climatology_loyo", "events_advanced", "features_core"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 2, name


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.source for r in rows} == {"s2", "landsat", "modis"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
