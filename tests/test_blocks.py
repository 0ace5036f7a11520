"""Methods on blocks against their Column form, and the size of the plan."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailcast.functions import blocks, fits
from tailcast.operators import diagnostics as D
from tailcast.operators import ladders
from tailcast.operators.curves import summarise
from tailcast.operators.forecast import _with_shifts, forecast
from tailcast.operators.methods import levels, shifted_members
from tailcast.plans import study as ST


def _windows(spark):
    """Long, short, flat, rising, wild and partly equal windows."""
    series = {"decay": [1.0 / n + 0.01 for n in range(1, 31)], "wave": [0.5 + (-0.7) ** n for n in range(1, 21)],
              "flat": [0.3] * 12, "rise": [0.1 * n for n in range(1, 15)], "steps": [0.5, 0.5, 0.4, 0.4, 0.4, 0.3, 0.31, 0.3, 0.3],
              "geometric": [0.9 ** n for n in range(1, 41)], "zero": [0.2, 0.1, 0.0, 0.0, 0.1, 0.0]}
    series |= {f"short{k}": [1.0 / n for n in range(1, k + 1)] for k in range(1, 9)}
    rows = [(name, [float(n) for n in range(1, len(v) + 1)], v, [(len(v) + 1 + i * 10, 0.2) for i in range(1 + len(name) % 3)]) for name, v in series.items()]
    w = spark.createDataFrame(rows, "curve_id string, xs array<double>, ys array<double>, targets array<struct<n_f:int,true_val:double>>")
    return summarise(w).withColumns({"L_hat": F.col("min_v") * 0.9, "L_true": F.lit(0.0), "assumed_mode": F.lit("winmin")})


def test_blocks_give_what_columns_give(spark):
    w = _windows(spark).persist()
    ranked = levels(ST.STUDY_METHODS)
    keys = ["curve_id", "n_f", "method"]
    new = forecast(w, ST.STUDY_METHODS).select(*keys, F.col("estimate_raw").alias("a"))
    old = _with_shifts(w, ST.STUDY_METHODS, ranked, shifted_members(ranked), ()).select(*keys, F.col("estimate_raw").alias("b"))
    rows = new.join(old, keys, "full").collect()
    assert len(rows) == new.count() == old.count()
    for r in rows:
        nothing = [v is None or v != v for v in (r.a, r.b)]
        assert nothing[0] == nothing[1], r
        assert nothing[0] or r.a == r.b or r.a == pytest.approx(r.b, rel=1e-9, abs=1e-9), r


def test_plan_does_not_grow_with_the_methods(spark):
    w = _windows(spark)
    plan = forecast(w, ST.DIAG_METHODS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan.split("ArrowEvalPython")[0]


def test_ladders_give_registered_methods_without_lambdas(spark):
    w = _windows(spark).persist()
    found = ladders.ladder_estimates(w)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[0]
    names = F.create_map(*[F.lit(v) for (name, k), m in ladders.REGISTERED.items() for v in (f"{name}:{k}", m)])
    a = found.select("curve_id", "n_f", names[F.col("method")].alias("method"), F.col("estimate_raw").alias("a")).filter("method IS NOT NULL")
    b = forecast(w, sorted(ladders.REGISTERED.values())).select("curve_id", "n_f", "method", F.col("estimate_raw").alias("b"))
    rows = a.join(b, ["curve_id", "n_f", "method"], "full").collect()
    assert len(rows) == b.count() and all(r.a == r.b for r in rows)


def test_spreads_stay_in_the_window_row(spark, monkeypatch):
    """Both diagnostics give what grouping all copies gives, without a shuffle; equal targets of a window are one group."""
    again = F.concat("targets", F.filter("targets", lambda t: t["n_f"] % 2 == 0))
    w = _windows(spark).withColumns({"depth": F.size("ys"), "noise": F.lit(0.005), "targets": again}).withColumn(
        "ys", F.when(F.col("curve_id") == "rise", F.transform("ys", lambda v: F.when(v != 0.5, v))).otherwise(F.col("ys"))).persist()
    methods = ST.DIAG_METHODS
    calls = (lambda: D.perturb_iqr(w, methods), lambda: D.perturb_iqr(w, methods, fewest=3), lambda: D.shift_iqr(w, methods), lambda: D.shift_iqr(w, methods, unstable=float("inf")))
    new = [c() for c in calls]
    for df in new:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and plan.count("ArrowEvalPython") == 1
    monkeypatch.setattr(D, "_in_blocks", lambda methods: False)
    for df, call in zip(new, calls):
        a, b = ({tuple(r[:-1]): r[-1] for r in x.collect()} for x in (df, call()))
        assert len(a) == df.count() and a.keys() == b.keys()
        assert all(a[k] == b[k] or a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a), [(k, a[k], b[k]) for k in a if a[k] != b[k]][:5]


def test_spreads_are_not_collected_for_a_broadcast(spark, tmp_path):
    """A small file of windows becomes many spreads: none of them may pass through the driver."""
    keys = ("curve_id", "depth", "noise", "n_f", "method")
    _windows(spark).withColumns({"depth": F.size("ys"), "noise": F.lit(0.005)}).coalesce(1).write.parquet(f"{tmp_path}/w")
    w = spark.read.parquet(f"{tmp_path}/w")
    records = forecast(w, ST.DIAG_METHODS).select(*keys, "estimate_raw")
    records.coalesce(1).write.parquet(f"{tmp_path}/r")
    got = D.with_spreads(spark.read.parquet(f"{tmp_path}/r"), w, ST.DIAG_METHODS, keys)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r[:-1]): r[-1] for r in D.shift_iqr(w, ST.DIAG_METHODS).collect()}
    rows = got.collect()
    assert len(rows) == records.count() and all(r.shift_iqr == want.get(tuple(r[k] for k in keys)) for r in rows)


def test_windows_of_equal_steps_share_the_basis_of_grid_fits(monkeypatch):
    """A block of windows over the same steps computes the first grid once, and every row is what it is when fitted alone."""
    rng = np.random.default_rng(3)
    x = np.tile(np.arange(1.0, 31.0), (40, 1))
    x[30:] += np.cumsum(rng.integers(1, 4, (10, 30)), axis=1)
    y = 0.1 + rng.random((40, 1)) / np.sqrt(x) + 0.01 * rng.standard_normal(x.shape)
    y[3], y[4] = np.nan, 0.25
    limits, made, basis = rng.random(40) * 0.1, [], fits._basis
    monkeypatch.setattr(fits, "_basis", lambda kind, x, p: made.append(len(p)) or basis(kind, x, p))
    for kind in fits.ONE_TERM:
        for more in ((), (limits, (0.0, 5.0))):
            made.clear()
            together = fits.fit_one_term(kind, x, y, *more)
            assert made[0] == 11 and max(made) <= 40
            alone = [fits.fit_one_term(kind, x[i:i + 1], y[i:i + 1], *(more and (limits[i:i + 1], more[1]))) for i in range(40)]
            assert np.array_equal(together, np.concatenate(alone), equal_nan=True)


def test_the_whole_window_is_not_computed_again_for_its_shifts(spark, monkeypatch):
    sizes, block = [], blocks.block
    monkeypatch.setattr(blocks, "block", lambda names, x, y, limit, t: sizes.append(y.shape[1]) or block(names, x, y, limit, t))
    series = [[1.0 / n + 0.01 for n in range(1, 13)], [0.5 + (-0.7) ** n for n in range(1, 13)]]
    xs, limit, targets = pa.array([[float(n) for n in range(1, 13)]] * 2), pa.array([0.0, 0.0]), pa.array([[20], [30]])
    names, moved = ["linear", "richardson_1", "shanks_1"], ["shanks_1", "richardson_1"]
    got = blocks.estimates(names, moved, (0, 0, 0, 1, 2)).func(xs, pa.array(series), limit, targets).to_pylist()
    assert sorted(sizes) == [10, 11, 12]
    for y, t, row in zip(series, (20, 30), got):
        x = np.arange(1.0, 13.0)
        cut = [block(moved, x[None, s:], np.array([y])[:, s:], np.zeros(1), np.array([[float(t)]]))[0, 0] for s in (0, 0, 0, 1, 2)]
        assert row[3:] == [float(v) for v in blocks.spread(np.stack(cut, axis=-1))]


def test_estimates_and_spreads_meet_without_a_join(spark):
    """Packed rows hold, per window and target, what joining both spreads to the records gives; nothing is shuffled on the way."""
    from tailcast.operators.forecast import packed, unpacked
    keys = ("curve_id", "depth", "noise", "n_f", "method")
    again = F.concat("targets", F.filter("targets", lambda t: t["n_f"] % 2 == 0))
    w = _windows(spark).withColumns({"depth": F.size("ys"), "noise": F.lit(0.005), "targets": again}).persist()
    rows = D.packed_with_spreads(w, ST.DIAG_METHODS, keys)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == packed(w, ST.DIAG_METHODS).count()
    got = unpacked(rows, ST.DIAG_METHODS, D.SPREADS).select(*keys, "estimate_raw", *D.SPREADS).collect()
    want = D.with_spreads(forecast(w, ST.DIAG_METHODS), w, ST.DIAG_METHODS, keys).select(*keys, "estimate_raw", *D.SPREADS).collect()
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order) and any(r.shift_iqr for r in got)


def test_features_of_blocks_equal_the_columns(spark):
    """All features of a window, also of short ones, flat ones and ones at zero; no value passes through a lambda but the fit's."""
    from tailcast.operators import features as FE
    from tailcast.settings import FEATURES
    w = _windows(spark)
    for n in (1, 2, 3, 4, 6, None):
        part = w if n is None else summarise(w.withColumns({c: F.slice(c, 1, n) for c in ("xs", "ys")}))
        new, old = FE.features(part), FE.column_features(part)
        assert new.columns == old.columns and "lambdafunction" not in new.select(*FEATURES)._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[0]
        a, b = ({r.curve_id: [r[f] for f in FEATURES] for r in x.collect()} for x in (new, old))
        assert a.keys() == b.keys()
        for k in a:
            assert [v is None for v in a[k]] == [v is None for v in b[k]], (n, k, a[k], b[k])
            assert all(x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a[k], b[k])), (n, k, a[k], b[k])


def test_sums_of_terms_are_fitted_once_for_all_modes(spark, monkeypatch):
    """The table of estimates has one row per window and target, and every mode gets the records that fitting its windows gives."""
    from tailcast.operators import sweeps
    from tailcast.plans import queries_selection as QS
    from tailcast.plans.catalog import QUERIES
    w = _windows(spark).withColumns({"family": F.lit("f"), "is_holdout": F.lit(0), "depth": F.size("ys"), "noise": F.lit(0.0), "targets": F.transform("targets", lambda t: F.struct(
        F.lit(0.5).alias("target_g"), t["n_f"].alias("n_f"), F.lit(0.5).alias("achieved_g"), F.lit(0).alias("capped"), t["true_val"].alias("true_val")))}).persist()
    seen = []
    monkeypatch.setattr(QS, "_mode_base", lambda s, sf: w)
    monkeypatch.setattr(QS, "settled", lambda df, name: seen.append(df.persist()) or seen[-1])
    got = QUERIES["w2_multi_term_consumers"](spark, "")
    want = sweeps.consumer_table(ST.records_of(spark, sweeps.across_modes(w, QS.MODES), ST.MULTI_TERM_METHODS)).select(got.columns)
    key = lambda r: tuple(map(str, r[:5]))
    a, b = ({key(r): r[5:] for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    assert seen[0].count() == w.select(F.explode("targets")).count()
