import pytest

from compare import connect, difference
from conftest import SMALL

CHECKED = ["flagship_method_ranking", "a1_wide_curves", "a10_tabular_prep", "a11_stratified_split", "b6_gap_horizon", "b8_curve_minimum", "b10_lower_envelope",
           "b11_interpolation", "c5_richardson_r2", "c8_nearest_family", "d3_log_linear", "d8_exponential_rational", "d11_shanks", "d14_pade", "d15_levin", "d17_neville", "d20_stability_weighted", "d22_order_ladders",
           "e7_fixed_reference_skill", "g7_previous_value", "k6_auc", "k10_cluster_bootstrap", "k11_p_values", "l10_leave_one_family_out", "n1_keyed_diff", "s6_live_event_forecasts",
           "f1_error_panel", "f5_pooled_table", "g1_assign_ranks", "h12_head_to_head", "i4_candidate_rules", "i5_selectors", "k7_rejection_rules",
           "j6_selector_errors", "l5_selection_cells", "w1_cascade_by_mode"]


@pytest.fixture(scope="module")
def engine():
    return connect(SMALL)


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as entry
    return entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query(registry):
    queries, sql = registry
    assert set(sql) <= set(queries) and set(CHECKED) <= set(sql) and len(queries) >= 180


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, engine, registry, name):
    queries, sql = registry
    message, _ = difference(queries[name](spark, SMALL), engine, sql[name])
    assert message == ""


def test_results_do_not_depend_on_shuffle_partitions(spark):
    from tailcast.plans import study as ST
    from tailcast.operators.forecast import forecast
    w = ST.step_windows(spark, ST.curves(spark, SMALL, "se"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = forecast(ST.step_windows(spark, ST.curves(spark, SMALL, "se")), ("rational_fit", "levin_t2", "linear")).collect()
            got.append(sorted((r.curve_id, r.depth, r.n_f, r.method, r.estimate_raw) for r in rows))
        assert got[0] == got[1] and len(got[0]) == w.count() * 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() == 21 and "rank" in df.columns
