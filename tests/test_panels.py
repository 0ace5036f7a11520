import pytest

from tailcast.functions import quantiles
from pyspark.sql import functions as F

from tailcast.operators import panels as P
from tailcast.operators import rules as RU

SCHEMA = "g string, error double, valid int, catastrophic int, E_last double"
ROWS = [("a", 1.0, 1, 0, 1.5), ("a", 2.0, 1, 0, 1.5), ("a", 3.0, 1, 0, 1.5), ("a", 10.0, 1, 1, 1.0),
        ("a", None, 0, 1, 1.0), ("a", None, 0, 1, None), ("b", None, 0, 1, 1.0), ("c", 0.5, 1, 0, 0.5), ("d", 0.1, 1, 0, None)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_error_panel(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "GROUP_ROWS", most)
    out = {r.g: r for r in P.error_panel(spark.createDataFrame(ROWS, SCHEMA), ["g"]).collect()}
    a = out["a"]
    assert (a.n_total, a.n_valid) == (6, 4)
    assert a.valid_rate == pytest.approx(4 / 6) and a.cat_rate == pytest.approx(0.5)
    assert (a.mean_error, a.med_error, a.q25_error, a.q75_error) == (4.0, 2.5, 1.75, 4.75)
    assert a.p90_error == pytest.approx(7.9) and a.win_rate_vs_last == pytest.approx(1 / 6)
    b = out["b"]
    assert b.n_valid == 0 and b.mean_error is None and b.med_error is None and b.win_rate_vs_last == 0
    assert out["c"].sd_error is None and out["c"].win_rate_vs_last == 0      # a tie is not a win
    assert out["d"].win_rate_vs_last == 0                                    # nor is a missing reference


def test_rule_panel(spark):
    cells = spark.createDataFrame([("A", 0.2), ("B", 0.9), ("C", None)], "cell string, richardson_r2 double")
    flags = RU.threshold_rule(cells, "richardson_r2", "<", 0.5).select("cell", F.lit(0).alias("rule"), F.lit("alt").alias("alternative"), "fired")
    recs = []
    for m, errs in (("richardson_1", {"A": (1.0, 2.0), "B": (0.5, 0.5), "C": (9.0, 9.0)}), ("alt", {"A": (0.5, None), "B": (1.0, 1.0), "C": (0.1, 0.1)})):
        for c, pair in errs.items():
            recs += [(c, i, m, e, int(e is not None), int(e is None), 1.0) for i, e in enumerate(pair)]
    records = spark.createDataFrame(recs, "cell string, run int, method string, error double, valid int, catastrophic int, E_last double")
    r = RU.rule_panels(flags, records, keys=("cell",), run="run", by=("rule", "alternative")).first()
    assert (r.n_cells_total, r.n_cells_fired, r.fire_rate) == (2, 1, 0.5)
    assert r.alt_valid_rate == 0.5 and r.lower_error_frac_records == 0.5 and r.lower_error_frac_cells == 1
    assert r.median_rel_change == pytest.approx((0.5 - 1.5) / 1.5)
    assert r.nf_r1_med_error == 0.5 and r.nf_alt_med_error == 1.0
    with pytest.raises(ValueError):
        RU.threshold_rule(cells, "richardson_r2", "<=", 0.5)


def test_pooled_keeps_capped_only_method(spark):
    cols = "method string, target_g double, family string, capped int, valid_rate double, cat_rate double, med_error double, med_improve double, med_skill double, " + \
        ", ".join(f"{c} double" for c in (*P.SKILL_MEDIANS, *P.WIN_RATES))
    row = lambda m, f, c, v: (m, 0.5, f, c, v, 0.0, 0.1, 1.0, 1.0, *[1.0] * 8)          # noqa: E731
    out = {r.method: r for r in P.pooled_table(spark.createDataFrame([row("a", "x", 0, 0.9), row("a", "y", 0, 1.0), row("b", "x", 1, 1.0)], cols)).collect()}
    assert out["a"].n_cells == 2 and out["a"].valid_rate == 0.95 and out["a"].n_families == 2
    assert out["b"].n_cells == 0 and out["b"].med_error is None and out["b"].n_capped_excluded == 1


def test_packed_cells_equal_cells_of_records(spark, monkeypatch):
    """Cells from packed estimates are those of the records: invalid and missing estimates, exact and missing references, equal rows, a missing truth."""
    import random
    from tailcast.operators.methods import method_table
    from tailcast.plans import study as ST
    rnd = random.Random(5)
    methods = [m for m in ST.STUDY_METHODS][:11]
    est = lambda: rnd.choice([None, rnd.random(), 0.25, 600.0, float("inf"), -0.6, rnd.random() / 100])
    rows = [(f"c{i}", rnd.choice("ab"), 0, 30, 0.0, rnd.choice([0.5, 0.1]), rnd.choice([0, 1]), rnd.choice([40, 50, 61]), rnd.choice([None, 0.5, 0.4]), rnd.choice([None, 0.25, 0.25, rnd.random()]),
             rnd.choice([None, 0.25, rnd.random()]), 0.25 if i % 3 else rnd.random(), rnd.random(), rnd.choice([0.25, 700.0]), 1.0, [est() for _ in methods]) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:3], "curve_id string, family string, is_holdout int, depth int, noise double, target_g double, capped int, n_f int, achieved_g double, "
                               "true_val double, L_hat double, last_v double, mean_v double, min_v double, max_v double, ests array<double>")
    dim = method_table(spark)
    records = ST.scored(spark, df, methods)
    want = P.cell_table(records)
    got = P.packed_cell_table(df, methods, dim, lambda: records)
    assert got.dtypes == want.dtypes
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: (r.method, r.family, r.target_g)
    a, b = ({key(r): r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for c in got.columns:
            assert a[k][c] == b[k][c] or a[k][c] == pytest.approx(b[k][c], rel=1e-9), (k, c)
    monkeypatch.setattr(P, "CELL_ROWS", 3)                    # larger cells take the way without a bound
    assert {key(r) for r in P.packed_cell_table(df, methods, dim, lambda: records).collect()} == a.keys()


def test_choices_meet_records_in_place(spark):
    """A left join of choices and records, with repeated choices and records and one choice without a record; the choices go to the records."""
    choices = spark.createDataFrame([("A", "x", "s1"), ("A", "x", "s2"), ("B", "y", "s1"), ("C", "x", "s1"), ("A", "x", "s2")], "cell string, method string, selector string")
    records = spark.createDataFrame([("A", "x", 1, 0.1), ("A", "x", 1, 0.1), ("A", "y", 2, 0.2), ("B", "y", 3, None)], "cell string, method string, run int, error double")
    from tailcast.operators import pairing as H
    got, want = H.chosen_records(choices, records, ["cell"]), choices.join(records, ["cell", "method"], "left")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 1


def test_rule_panels_never_copy_records(spark, monkeypatch):
    """Few routed cells go to the records, many meet them by shuffling; a small file of packed records is no small table."""
    cells = spark.createDataFrame([("A", 0.2), ("B", 0.9)], "cell string, richardson_r2 double")
    flags = RU.threshold_rule(cells, "richardson_r2", "<", 0.5).select("cell", F.lit(0).alias("rule"), F.lit("alt").alias("alternative"), "fired")
    records = spark.createDataFrame([(c, i, m, 0.1 * i, 1, 0, 1.0) for c in "AB" for i in range(4) for m in ("richardson_1", "alt", "other")],
                                    "cell string, run int, method string, error double, valid int, catastrophic int, E_last double")
    plans, kept = [], RU.settled
    monkeypatch.setattr(RU, "settled", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    found = []
    for most in (RU.FEW_SIDES, 0):
        monkeypatch.setattr(RU, "FEW_SIDES", most)
        found.append(RU.rule_panels(flags, records, keys=("cell",), run="run", by=("rule", "alternative")).collect())
    assert found[0] == found[1] and "BuildRight" in plans[0] and "SortMergeJoin" in plans[2]
