import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.functions import fits, varpro
from tailcast.operators import curves as C
from tailcast.operators import diagnostics as D
from tailcast.operators import ladders as LD
from tailcast.operators.forecast import forecast, with_step_targets
from tailcast.operators.methods import REGISTRY, levels, lookup, register_composite, register_method
from tailcast.settings import ENSEMBLE_MEMBERS, METHODS, SHANKS_WYNN

CURVES = {
    "geometric": (lambda n: 0.01 + 0.8 * 0.92 ** n, 10), "harmonic": (lambda n: 0.01 + 1 / (n + 1), 5),
    "log_slow": (lambda n: 0.01 + 0.8 / math.log(n + math.e), 2), "alternating": (lambda n: 0.01 + 0.6 * (-0.85) ** n, 20),
}


def windows(spark, fns=None, depth=90, last=400, noise=(0.0,), mode="zero"):
    rows = [(k, k, 0, i, n, float(f(n))) for i, (k, (f, *_)) in enumerate((fns or CURVES).items()) for n in range(1, last + 1)]
    c = spark.createDataFrame(rows, "curve_id string, family string, is_holdout int, run bigint, step int, value double")
    packed = C.prefixes(c, depth).join(C.step_targets(c, (200, 400)), "curve_id")
    return with_step_targets(C.cut_windows(packed, (depth,), noise=noise, mode=mode, true_limit=F.lit(0.01)))


def test_each_analytic_curve_is_solved(spark):
    w = windows(spark)
    est = forecast(w, tuple(m for m in REGISTRY if m != "constant_oracle" and m != "constant_assumed")).collect()
    for name, (fn, factor) in CURVES.items():
        last = abs(fn(90) - 0.01)
        best = min(abs(r.estimate_raw - 0.01) for r in est if r.curve_id == name and r.n_f == 400 and r.estimate_raw is not None)
        best_at = min(abs(r.estimate_raw - r.true_val) for r in est if r.curve_id == name and r.n_f == 400 and r.estimate_raw is not None)
        assert last / max(min(best, best_at), 1e-15) >= factor, name


def test_registry_covers_every_window_method():
    assert list(REGISTRY) == [m for m, _, _ in METHODS]
    assert lookup("median_ensemble").members == ENSEMBLE_MEMBERS


def test_one_term_fits_recover_parameters():
    x = np.tile(np.arange(31.0, 91.0), (3, 1))
    truth = [("power", 0.7, lambda p: 0.05 + 0.9 * x[0] ** -p), ("exponential", 0.03, lambda p: 0.05 + 0.9 * np.exp(-p * x[0])),
             ("rational", 0.2, lambda p: 0.05 + 0.9 / (1 + p * x[0]))]
    for kind, p, f in truth:
        got = fits.fit_one_term(kind, x[:1], f(p)[None, :])[0]
        assert got[0] == pytest.approx(p, rel=2e-3) and got[1] == pytest.approx(0.05, abs=2e-3) and got[3] < 1e-9


@pytest.mark.parametrize("y", [lambda x: 3.0 + 0 * x, lambda x: -1.0 + 0 * x, lambda x: 0.2 + 0.001 * x, lambda x: 40 / x, lambda x: 1.9 + 9 / x])
def test_box_solution_matches_a_dense_search(y):
    x = np.arange(31.0, 91.0)
    phi, v = 1 / x, y(x)
    n, mp, my = len(x), phi.mean(), v.mean()
    sse, lim, c = fits._boxed(np.array([[mp]]), np.array([[my]]), np.array([[((phi - mp) ** 2).sum()]]),
                              np.array([[((phi - mp) * (v - my)).sum()]]), np.array([[((v - my) ** 2).sum()]]), n, (0.0, 2.0), (-5.0, 5.0))
    grid = min(((v - a - b * phi) ** 2).sum() for a in np.linspace(0, 2, 201) for b in np.linspace(-5, 5, 201))
    assert 0 <= lim[0, 0] <= 2 and -5 <= c[0, 0] <= 5 and ((v - lim[0, 0] - c[0, 0] * phi) ** 2).sum() <= grid + 1e-9


@pytest.mark.parametrize("order", [(1, 1), (2, 2), (3, 4), (4, 5)])
def test_pade_against_dense_least_squares(order):
    p, q = order
    rng = np.random.default_rng(1)
    x = np.arange(31.0, 91.0)
    y = 0.1 + 1 / x + 1e-3 * rng.standard_normal(60)
    xn = (x - x[0]) / (x[-1] - x[0])
    a = np.column_stack([xn ** j for j in range(p + 1)] + [-(xn ** j) * y for j in range(1, q + 1)])
    k = p + q + 1
    want = np.linalg.lstsq(np.vstack([a, 1e-8 * np.eye(k)]), np.concatenate([y, np.zeros(k)]), rcond=None)[0]
    got = fits.fit_pade(order, x[None], y[None])[0]
    assert np.allclose(a @ got, a @ want, atol=1e-6)


def best_in_box(a, y, low, high):
    """Exact box-constrained least squares by trying every set of active bounds."""
    best, found = np.inf, None
    for state in itertools.product((0, 1, 2), repeat=a.shape[1]):
        free = [j for j, s in enumerate(state) if s == 0]
        z = np.array([{0: 0.0, 1: low[j], 2: high[j]}[s] for j, s in enumerate(state)], float)
        if free:
            part = np.linalg.lstsq(a[:, free], y - a @ z, rcond=None)[0]
            if any(v < low[j] - 1e-9 or v > high[j] + 1e-9 for v, j in zip(part, free)):
                continue
            z[free] = part
        sse = ((y - a @ z) ** 2).sum()
        if sse < best:
            best, found = sse, z
    return found, best


def test_active_set_finds_the_optimum_of_every_box_problem():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(2, 5))
        a, y = rng.standard_normal((int(rng.integers(k + 1, 30)), k)), None
        y = rng.standard_normal(len(a)) * 3
        low, high = -rng.random(k), rng.random(k)
        z, _, sse = varpro.solve_boxed(a[None], y[None], low, high)
        assert np.all(z[0] >= low) and np.all(z[0] <= high)
        assert sse[0] == pytest.approx(best_in_box(a, y, low, high)[1], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("kind,truth", [("power2", (0.5, 1.5, 0.05, 0.8, 0.4)), ("exponential2", (0.02, 0.1, 0.05, 0.8, 0.3)), ("power2", (0.3, 2.0, 0.0, 1.0, -2.0))])
def test_multi_term_fits_recover_parameters(kind, truth):
    x = np.arange(31.0, 91.0)
    model = fits.many_term_model(kind)
    k = model.terms
    y = model.columns(x[None], np.log(np.array([truth[:k]])))[0] @ np.array(truth[k:])
    got = fits.fit_many_terms(kind, x[None], y[None])[0]
    assert got == pytest.approx(truth, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind", ["power2", "power3", "exponential2"])
def test_multi_term_fits_are_as_good_as_a_dense_search(kind):
    """Noisy curves: no point of a dense grid of the nonlinear parameters, each solved exactly in the box, is better."""
    rng = np.random.default_rng(4)
    x = np.arange(31.0, 91.0)
    ys = np.stack([0.1 + 2 / x + 1e-3 * rng.standard_normal(60), 0.3 * np.exp(-x / 40) + 1e-3 * rng.standard_normal(60), 0.5 - 0.001 * x, np.full(60, 0.2)])
    model = fits.many_term_model(kind)
    got = fits.fit_many_terms(kind, np.tile(x, (4, 1)), ys)
    sse = model.at(np.tile(x, (4, 1)), ys, np.log(got[:, :model.terms]))[3]
    side = np.linspace(model.lo, model.hi, {2: 25, 3: 10}[model.terms])
    for u in itertools.combinations(side, model.terms):
        dense = model.at(np.tile(x, (4, 1)), ys, np.tile(u, (4, 1)))[3]
        assert np.all(sse <= dense * (1 + 1e-6) + 1e-12)
    assert np.all(got[:, model.terms] >= model.low[0]) and np.all(np.diff(got[:, :model.terms], axis=1) >= 0)


def naive_epsilon(s, k):
    s = s[-(2 * k + 1):]
    prev, cur = [0.0] * len(s), list(s)
    for _ in range(2 * k):
        nxt = [prev[j + 1] + 1 / (cur[j + 1] - cur[j]) for j in range(len(cur) - 1)]
        prev, cur = cur, nxt
    return cur[0]


def test_ladders_agree_with_methods_and_naive_recursions(spark):
    w = windows(spark, {"harmonic": CURVES["harmonic"], "log_slow": CURVES["log_slow"]})
    lad = {(r.curve_id, r.ladder, r.order, r.n_f): r.estimate_raw for r in LD.ladder_estimates(w, {"wynn_eps": range(1, 5), "shanks": range(1, 4), "neville": range(1, 4)}).collect()}
    reg = {(r.curve_id, r.method, r.n_f): r.estimate_raw for r in forecast(w, ("wynn_eps_2", "shanks_3", "neville_3")).collect()}
    for c in ("harmonic", "log_slow"):
        s = [CURVES[c][0](n) for n in range(31, 91)]
        for k in (1, 2, 3, 4):
            assert lad[c, "wynn_eps", k, 200] == pytest.approx(naive_epsilon(s, k), rel=1e-9)
        assert lad[c, "wynn_eps", 2, 200] == reg[c, "wynn_eps_2", 200] and lad[c, "shanks", 3, 200] == reg[c, "shanks_3", 200]
        assert lad[c, "neville", 3, 400] == reg[c, "neville_3", 400]
        xs, ys = 1 / np.arange(87.0, 91.0), np.array(s[-4:])
        want = sum(ys[i] * np.prod([(1 / 400 - xs[j]) / (xs[i] - xs[j]) for j in range(4) if j != i]) for i in range(4))
        assert lad[c, "neville", 3, 400] == pytest.approx(want, rel=1e-6)


def test_trivial_predictors(spark):
    w = spark.createDataFrame([("c", [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], 0.25, 0.125)], "curve_id string, xs array<double>, ys array<double>, L_hat double, L_true double")
    w = C.summarise(w).withColumn("targets", F.array(F.struct(F.lit(9).alias("n_f"), F.lit(0.0).alias("true_val"))))
    got = {r.method: r.estimate_raw for r in forecast(w, ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value")).collect()}
    assert got == {"constant_assumed": 0.25, "constant_oracle": 0.125, "window_mean": 2.5, "window_min": 1.0, "last_value": 4.0}
    blind = forecast(w.withColumn("L_true", F.lit(None).cast("double")), ("constant_oracle",)).first()
    assert blind.estimate_raw is None


def test_only_the_oracle_reads_the_true_limit(spark):
    w = windows(spark, mode="winmin")
    moved = w.withColumn("L_true", F.lit(77.0))
    ms = tuple(m for m in REGISTRY if m != "constant_oracle")
    a = {(r.curve_id, r.n_f, r.method): r.estimate_raw for r in forecast(w, ms).collect()}
    b = {(r.curve_id, r.n_f, r.method): r.estimate_raw for r in forecast(moved, ms).collect()}
    assert a == b


def test_draws_do_not_depend_on_methods_or_partitions(spark):
    w = windows(spark, noise=(0.005,))
    a = D.perturb_iqr(w, ("linear", "levin_t2"))
    b = D.perturb_iqr(w.repartition(7), ("levin_t2",))
    want = {(r.curve_id, r.n_f): r.perturb_iqr for r in a.filter("method = 'levin_t2'").collect()}
    assert want == {(r.curve_id, r.n_f): r.perturb_iqr for r in b.collect()} and any(v for v in want.values())


def test_shift_iqr_counts_the_unshifted_window_three_times(spark):
    w = windows(spark, {"harmonic": CURVES["harmonic"]})
    got = D.shift_iqr(w, ("richardson_a05",)).first().shift_iqr
    est = []
    for s in (0, 0, 0, 1, 2):
        x = np.arange(31.0 + s, 91.0)
        y = 0.01 + 1 / (x + 1)
        b, a = np.polyfit(1 / np.sqrt(x), y, 1)
        est.append(a + b / np.sqrt(200))
    vals = D.shift_iqr(w, ("richardson_a05",)).filter("n_f = 200").first().shift_iqr
    assert vals == pytest.approx(np.subtract(*np.percentile(est, [75, 25])), rel=1e-6) and got is not None


def test_composites_equal_their_definition(spark):
    """Members on the whole window and on windows that start one and two steps later, by hand."""
    w = windows(spark, noise=(0.0, 0.01), mode="winmin")
    members = tuple(dict.fromkeys(ENSEMBLE_MEMBERS + SHANKS_WYNN))
    est = {s: {(r.curve_id, r.noise, r.method, r.n_f): r.estimate_raw for r in forecast(C.shifted(w, (s,)).drop("shift"), members).collect()} for s in (0, 1, 2)}
    got = forecast(w, ("stability_weighted", "last_value", "median_ensemble", "best_shanks_wynn")).collect()
    ok = lambda v: v is not None and math.isfinite(v) and -0.5 <= v <= 500

    def facts(r, names):
        out = []
        for m in names:
            v = [est[s][r.curve_id, r.noise, m, r.n_f] for s in (0, 0, 0, 1, 2)]
            valid = [x for x in v if ok(x)]
            if ok(v[0]):
                q = np.percentile(valid, [75, 25])
                out.append((q[0] - q[1] if len(valid) >= 2 else math.inf, v[0]))
        return out

    assert len(got) == 4 * 2 * 2 * 4
    for r in got:
        pool, steady = facts(r, ENSEMBLE_MEMBERS), facts(r, SHANKS_WYNN)
        if r.method == "median_ensemble":
            assert r.estimate_raw == pytest.approx(np.median([v for _, v in pool]), rel=1e-9) if len(pool) >= 3 else r.estimate_raw is None
        if r.method == "stability_weighted":
            wt = [1 / (q + 1e-6) for q, _ in pool]
            assert r.estimate_raw == pytest.approx(np.dot(wt, [v for _, v in pool]) / sum(wt), rel=1e-6) if len(pool) >= 2 else r.estimate_raw is None
        if r.method == "best_shanks_wynn":
            assert r.estimate_raw == pytest.approx(min(steady, key=lambda p: p[0])[1] if steady else r.last_v, rel=1e-6)


def test_composites_of_composites(spark):
    register_composite("mean_of_two", "user", "trajectory", ("median_ensemble", "last_value"), lambda found: (found[0]["v"] + found[1]["v"]) / 2)
    register_composite("again", "user", "trajectory", ("mean_of_two", "window_min"), lambda found: found[0]["v"] * 10 + F.coalesce(found[1]["spread"], F.lit(0.0)))
    assert [[m.name for m in layer] for layer in levels(["again"])][-2:] == [["mean_of_two"], ["again"]]
    got = {(r.curve_id, r.n_f, r.method): r.estimate_raw for r in forecast(windows(spark), ("again", "median_ensemble", "last_value")).collect()}
    for c, n in {k[:2] for k in got}:
        assert got[c, n, "again"] == pytest.approx(5 * (got[c, n, "median_ensemble"] + got[c, n, "last_value"]))
    with pytest.raises(KeyError):
        register_composite("lost", "user", "limit", ("no such method",), lambda found: found[0]["v"])
    with pytest.raises(ValueError):
        register_composite("loop", "user", "limit", ("loop",), lambda found: found[0]["v"])


def test_user_method(spark):
    register_method("half_last", "custom", "limit", lambda p, t: p, parameters=lambda: F.col("last_v") / 2)
    r = forecast(windows(spark, {"harmonic": CURVES["harmonic"]}), ("half_last",)).first()
    assert r.estimate_raw == pytest.approx((0.01 + 1 / 91) / 2)
    with pytest.raises(ValueError):
        register_method("linear", "x", "limit", lambda p, t: p)


def test_gap_horizon_is_the_first_crossing(spark):
    rows = [("c", "f", 0, 1, n, v) for n, v in enumerate([1.0, 0.8, 0.6, 0.45, 0.5, 0.3, 0.2], 1)]
    c = spark.createDataFrame(rows, "curve_id string, family string, is_holdout int, run bigint, step int, value double")
    got = {r.target_g: r for r in C.gap_horizons(c, [2], [0.6, 0.01]).collect()}
    assert got[0.6].n_f == 4 and got[0.6].capped == 0 and got[0.6].achieved_g == pytest.approx(0.45 / 0.8)
    assert got[0.01].n_f == 7 and got[0.01].capped == 1
    flat = C.gap_horizons(c.withColumn("value", F.lit(0.0)), [2], [0.5]).first()
    assert flat.degenerate and flat.n_f == 3 and flat.achieved_g is None and flat.capped == 0
