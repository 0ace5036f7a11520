import pytest

from tailcast.functions import quantiles

from tailcast.operators import ensembles as EN
from tailcast.operators import selection as L

CELL = ("family", "is_holdout", "depth", "noise", "target_g")


def records(spark, table):
    rows = []
    for m, errs in table.items():
        for i, e in enumerate(errs):
            rows.append(("f", 0, 90, 0.0, 0.5, f"r{i}", m, e, int(e is not None), int(e is None)))
    return spark.createDataFrame(rows, "family string, is_holdout int, depth int, noise double, target_g double, curve_id string, method string, error double, valid int, catastrophic int")


def run(spark, table, pools, min_valid=0.9):
    recs = records(spark, table)
    cells = recs.select(*CELL).distinct()
    p = L.pool_table(spark, pools)
    return {(r.pool, r.design): r for r in L.selection_cells(recs, cells, p, min_valid).collect()}


# registry order: richardson_1 < single_exp_fit < rational_fit (the default) < shanks_1
ONE = {"richardson_1": (1.0, None, 2.0), "single_exp_fit": (1.0, 0.5, None), "rational_fit": (3.0, 0.7, 0.1), "shanks_1": (5.0, 5.0, 2.0 + 3.0), "last_value": (2.0, 2.0, 2.0)}


def test_one_pilot(spark):
    got = run(spark, ONE, {"all": ["richardson_1", "single_exp_fit", "rational_fit", "shanks_1"], "one": ["richardson_1"]})
    r = got["all", "one_pilot"]
    assert (r.n_runs, r.n_trials, r.n_no_choice) == (3, 6, 0)
    assert r.chosen_valid_rate == pytest.approx(4 / 6) and r.win_vs_default == pytest.approx(1 / 6)
    assert r.default_chosen == pytest.approx(2 / 6) and r.win_vs_last == pytest.approx(2 / 6)
    assert sorted([r.med_error_chosen]) == [pytest.approx(1.5)] and r.med_error_default == pytest.approx(0.7)
    assert r.top_chosen == "richardson_1" and r.top_chosen_share == pytest.approx(2 / 6) and r.n_distinct_chosen == 3
    one = got["one", "one_pilot"]
    assert one.n_no_choice == 2 and one.chosen_valid_rate == pytest.approx(2 / 6)
    assert one.cat_rate_chosen == pytest.approx(4 / 6)


MANY = {"single_exp_fit": (0.1, 0.2, 0.3, None), "rational_fit": (1.0, 1.0, 1.0, 1.0), "shanks_1": (0.5, 0.6, 0.7, 0.8), "last_value": (2.0,) * 4}


@pytest.mark.parametrize("most", [100_000, 0])
def test_many_pilots(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "GROUP_ROWS", most)
    pools = {"all": ["single_exp_fit", "rational_fit", "shanks_1"]}
    r = run(spark, MANY, pools)["all", "many_pilots"]
    assert r.chosen_valid_rate == pytest.approx(0.75) and r.win_vs_default == pytest.approx(0.75) and r.med_error_chosen == pytest.approx(0.6)
    assert r.top_chosen == "shanks_1" and r.n_distinct_chosen == 2
    low = run(spark, MANY, pools, 0.5)["all", "many_pilots"]
    assert low.top_chosen == "single_exp_fit" and low.n_distinct_chosen == 1


def test_trials_match_explicit_pairs(spark):
    import random
    rnd = random.Random(3)
    names = ["richardson_1", "single_exp_fit", "rational_fit", "shanks_1", "levin_t2"]
    table = {m: tuple(None if rnd.random() < 0.25 else round(rnd.random(), 2) for _ in range(9)) for m in names}
    table["last_value"] = tuple(round(rnd.random(), 2) for _ in range(9))
    from tailcast.settings import REGISTRY_INDEX
    got = run(spark, table, {"p": names})["p", "one_pilot"]

    def pick(i):
        ok = [(table[m][i], REGISTRY_INDEX[m], m) for m in names if table[m][i] is not None]
        return min(ok)[2] if ok else None
    pairs = [(pick(p), f) for p in range(9) for f in range(9) if p != f]
    errs = [None if m is None else table[m][f] for m, f in pairs]
    d, last = table["rational_fit"], table["last_value"]
    assert got.n_trials == 72
    assert got.chosen_valid_rate == pytest.approx(sum(e is not None for e in errs) / 72)
    assert got.win_vs_default == pytest.approx(sum(e is not None and (d[f] is None or e < d[f]) for e, (_, f) in zip(errs, pairs)) / 72)
    assert got.win_vs_last == pytest.approx(sum(e is not None and e < last[f] for e, (_, f) in zip(errs, pairs)) / 72)
    vals = sorted(e for e in errs if e is not None)
    mid = (vals[(len(vals) - 1) // 2] + vals[len(vals) // 2]) / 2
    assert got.med_error_chosen == pytest.approx(mid)
    assert got.cat_rate_chosen == pytest.approx(sum(e is None for e in errs) / 72)


def test_flags_are_checked(spark):
    bad = records(spark, ONE).withColumn("catastrophic", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    with pytest.raises(ValueError):
        L.check_flags(bad)


def test_excluded_set(spark):
    rows = [("low", 0, 0.899, 0, 0), ("edge", 0, 0.900, 0, 0), ("mix_out", 0, 0.898, 0, 0), ("mix_out", 0, 0.900, 0, 0), ("mix_in", 0, 0.880, 0, 0), ("mix_in", 0, 0.920, 0, 0),
            ("trivial", 1, 0.1, 0, 0), ("capped", 0, 0.1, 1, 0), ("capped", 0, 1.0, 0, 0), ("hold", 0, 0.1, 0, 1), ("hold", 0, 1.0, 0, 0)]
    df = spark.createDataFrame([(m, t, v, 0.0, 0.1, c, h, 0) for m, t, v, c, h in rows],
                               "method string, is_trivial int, valid_rate double, cat_rate double, med_error double, capped int, is_holdout int, is_oracle int")
    got = {r.method: r.dangerous for r in EN.derive_excluded(df).collect()}
    assert got == {"low": 1, "edge": 0, "mix_out": 1, "mix_in": 0, "trivial": 0, "capped": 0, "hold": 0}


@pytest.mark.parametrize("within", [[], ["g"]])
def test_medians_without_a_fold_equal_direct_ones(spark, within):
    import random

    import numpy as np
    rnd = random.Random(7)
    rows = [(rnd.choice("xy"), rnd.choice(["a", "b", "c", "d"]), rnd.choice(["m1", "m2", "m3"]), rnd.choice([float("inf"), round(rnd.random(), 1), rnd.random()])) for _ in range(400)]
    rows += [("x", "only", "m4", 1.0), ("y", "a", "m5", 2.0)]
    df = spark.createDataFrame(rows, "g string, fold string, method string, s double")
    got = {tuple(r[k] for k in (*within, "method", "fold")): r.score for r in L.medians_without(df, [*within, "method"], "fold", "s").collect()}
    at = {"g": 0, "fold": 1, "method": 2}
    groups = {tuple(r[at[k]] for k in within) for r in rows}
    want = {}
    for g in groups:
        mine = [r for r in rows if tuple(r[at[k]] for k in within) == g]
        for method in {r[2] for r in mine}:
            for fold in {r[1] for r in mine}:
                rest = sorted(r[3] for r in mine if r[2] == method and r[1] != fold)
                if rest:
                    a, b = rest[(len(rest) - 1) // 2], rest[len(rest) // 2]
                    want[(*g, method, fold)] = a if a == b else a + (b - a) / 2
    assert got == want


def test_both_choices_in_one_grouping(spark):
    import random
    rnd = random.Random(3)
    names = ["richardson_1", "rational_fit", "shanks_1"]
    rows = [("p", "f", 0, 30, 0.0, 0.5, f"r{i}", m, None if rnd.random() < 0.3 else round(rnd.random(), 2), 0, k) for i in range(12) for k, m in enumerate(names)]
    rows += [("q", *r[1:]) for r in rows if r[7] != "shanks_1"]
    df = spark.createDataFrame(rows, "pool string, family string, is_holdout int, depth int, noise double, target_g double, curve_id string, method string, err double, cat int, registry_index int").persist()
    runs = L.cell_runs(df.select(*L.CELL, "curve_id").distinct())
    key = lambda r: (r.pool, r.curve_id)
    own, final = ({key(r): r.chosen for r in x.collect()} for x in (L.choose_one_pilot(df), L.choose_many_pilots(df, runs, 0.5)))
    got = L.choose_both(df, runs, 0.5).collect()
    assert {key(r): (r.own, r.final) for r in got} == {k: (own[k], final[k]) for k in own} and len(got) == 24


def test_selectors_of_packed_rows_equal_those_of_records(spark):
    """Ensembles and oracles of a row of arrays are those of its records, with invalid estimates, missing spreads and truths, an excluded method; rows that share a group too."""
    import random

    from pyspark.sql import functions as F

    from tailcast.operators import diagnostics as D
    from tailcast.plans import study as ST
    rnd = random.Random(6)
    methods = [m for m in ST.DIAG_METHODS if m in EN.SMALL_POOL or m in EN.TRIVIALS or m in ("linear", "neville_2")]
    est = lambda: rnd.choice([None, rnd.random(), 0.25, 600.0, rnd.random()])
    rows = [("f", 0, f"c{i}", 30, 0.0, 0.5, i % 2, 40, 0.5, rnd.choice([None, 0.25, rnd.random()]), 0.2, 0.25, rnd.random(), 0.2, 1.0, [None if i == 7 else est() for _ in methods],
             [rnd.choice([None, 0.0, 0.3, 2.0 * rnd.random()]) for _ in methods], [0.0 for _ in methods]) for i in range(60)]
    df = spark.createDataFrame(rows, "family string, is_holdout int, curve_id string, depth int, noise double, target_g double, capped int, n_f int, achieved_g double, "
                               "true_val double, L_hat double, last_v double, mean_v double, min_v double, max_v double, ests array<double>, perturb_iqr array<double>, shift_iqr array<double>")
    feats = spark.createDataFrame([("f", 30, 0.0, -0.05, 0.9)], "family string, depth int, noise double, log_log_slope double, richardson_r2 double")
    bad = spark.createDataFrame([("linear", 1), ("pade_22", 0)], "method string, dangerous int")
    pool = [m for m in methods if m not in EN.TRIVIALS]
    for table in (df, df.unionByName(df.limit(5).withColumn("ests", F.reverse("ests")))):
        records = ST.scored(spark, table, methods, D.SPREADS)
        want = EN.selector_errors(records, feats, pool, bad)
        got = EN.packed_selector_errors(table, methods, feats, pool, bad, lambda: records)
        assert got.columns == want.columns and ("Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()) == (table is not df)
        a, b = ({r.curve_id: r for r in x.collect()} for x in (got, want))
        assert a.keys() == b.keys()
        for k in a:
            for c in got.columns:
                assert a[k][c] == b[k][c] or a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-12), (k, c, a[k][c], b[k][c])
