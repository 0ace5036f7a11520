import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailcast.functions import quantiles, special
from tailcast.functions.quantiles import grouped, order_statistics, spread_quantiles
from tailcast.operators import classify as M
from tailcast.operators import curves as CV
from tailcast.operators import features as FE
from tailcast.operators import pairing as H
from tailcast.operators import ranking as R
from tailcast.operators import stats as K
from tailcast.sources import sinks, tables
from tailcast.streaming import live


def test_spread_quantiles_equal_numpy(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(501)] + [("b", float(rnd.randint(0, 3))) for _ in range(400)] + \
        [("c", math.inf)] * 3 + [("c", 1.0)] * 4 + [("d", None)] * 3 + [(None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q25": 0.25, "med": 0.5, "p90": 0.9}
    got = {r.k: r for r in spread_quantiles(df, ["k"], "v", probs).collect()}
    for k in ("a", "b"):
        v = [x for kk, x in rows if kk == k]
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)
    assert got["c"].med == 1.0 and math.isinf(got["c"].p90) and "d" not in got and got[None].med == 3.0
    w = df.filter("k = 'b'").withColumn("w", (F.col("v") + 1).cast("int"))
    rep = np.repeat([x for kk, x in rows if kk == "b"], [int(x) + 1 for kk, x in rows if kk == "b"])
    for most in (100_000, 0):
        monkeypatch.setattr(quantiles, "GROUP_ROWS", most)
        r = grouped(w, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.7)}, weight="w").first()
        assert r.m == pytest.approx(np.percentile(rep, 70))
        both = grouped(df.withColumn("u", -F.col("v")), ["k"], [], {"a": ("v", 0.25), "b": ("u", 0.75), "c": ("v", 0.9)})
        assert {x.k: (x.a, x.b) for x in both.collect()}["b"] == (np.percentile([x for k, x in rows if k == "b"], 25), -np.percentile([x for k, x in rows if k == "b"], 25))
        assert {x.k for x in both.collect()} == {"a", "b", "c", "d", None}
        whole = grouped(df, [], [], {"m": ("v", 0.5)}).first()
        assert whole.m == pytest.approx(np.percentile([x for _, x in rows if x is not None], 50))


def test_one_hot_bucket_is_divided_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GROUP_ROWS", 100)
    rnd = random.Random(8)
    close = [1.0 + rnd.random() * 1e-6 for _ in range(10_000)]
    df = spark.createDataFrame([("hot", v) for v in close] + [("cold", float(i)) for i in range(50)], "k string, v double")
    got = {r.k: r for r in grouped(df, ["k"], [F.max("v").alias("top")], {"q1": ("v", 0.1), "q9": ("v", 0.9)}).collect()}
    assert got["hot"].q1 == pytest.approx(np.percentile(close, 10), abs=1e-15) and got["hot"].q9 == pytest.approx(np.percentile(close, 90), abs=1e-15)
    assert got["cold"].q1 == pytest.approx(4.9) and got["cold"].top == 49.0


def test_order_statistics(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3, 3)], "k string, v double")
    for most in (100_000, 0):
        monkeypatch.setattr(quantiles, "GROUP_ROWS", most)
        r = order_statistics(df, ["k"], "v", {"lo": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "off": lambda n: n}).first()
        assert (r.n, r.lo, r.mid, r.off) == (6, 1.0, 3.0, None)


def test_prefix_sums_match_one_window(spark):
    rnd = random.Random(1)
    rows = [(k, t, rnd.randint(1, 9)) for k in "ab" for t in range(57)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r.k, r.t): (r.s, r.n) for r in tables.prefix_sums(df, ["k"], F.floor(F.col("t") / 10), ["t"], ["v"], ["s"], "n").collect()}
    for k in "ab":
        acc = 0
        for i, (_, t, v) in enumerate([r for r in rows if r[0] == k]):
            acc += v
            assert got[k, t] == (acc, i + 1)


def test_average_rank_and_spearman(spark):
    rnd = random.Random(2)
    x = [rnd.randint(0, 6) for _ in range(60)]
    y = [a + rnd.randint(0, 5) for a in x]
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("g", None, 1.0), ("flat", 1.0, 1.0)] + [("flat", 1.0, float(i)) for i in range(12)], "g string, x double, y double")

    def rank(v):
        s = sorted(v)
        return np.array([s.index(a) + (s.count(a) + 1) / 2 for a in v])
    ranks = {r.x: r.r for r in R.average_rank(df.filter("g = 'g' AND x IS NOT NULL"), ["g"], "x", "r").collect()}
    assert all(ranks[float(a)] == b for a, b in zip(x, rank(x)))
    got = {r.g: r for r in K.spearman(df, ["g"], "x", "y").collect()}
    assert got["g"].spearman_r == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["g"].n == 60
    assert got["flat"].spearman_r is None                     # a constant has no rank correlation


@pytest.mark.parametrize("heavy", [10_000, 5])
def test_spearman_with_totals_moves_a_pair_twice(spark, monkeypatch, heavy):
    """Groups and their total from one ranking each way, with ties, a value that fills a bucket, zeros of both signs, infinities and missing values."""
    monkeypatch.setattr(K, "HEAVY", heavy)
    rnd = random.Random(11)
    rows = [(m, d, rnd.choice([0.0, -0.0, 0.0, rnd.random(), round(rnd.random(), 1), float("inf"), -rnd.random(), None]), rnd.choice([rnd.random(), 0.25, 1e-9 * rnd.random()]))
            for m in ("a", "b", None) for d in ("p", "s") for _ in range(120)]
    df = spark.createDataFrame(rows, "method string, d string, x double, y double")
    got = {(r.method, r.d): (r.spearman_r, r.n) for r in K.spearman(df, ["method", "d"], "x", "y", 5, total="method").collect()}

    def rank(v):
        s = sorted(v)
        return np.array([s.index(a) + (s.count(a) + 1) / 2 for a in v])
    assert set(got) == {(m, d) for m in ("a", "b", "ALL") for d in "ps"}
    for (m, d), (rho, n) in got.items():
        pick = [(r[2], r[3]) for r in rows if r[1] == d and r[2] is not None and m in ("ALL", r[0])]
        assert n == len(pick) and rho == pytest.approx(np.corrcoef(rank([p[0] for p in pick]), rank([p[1] for p in pick]))[0, 1], abs=1e-12)
    rows = df.select(F.when(F.col("d") == "p", 1).otherwise(2).cast("long").alias("_g"), F.lit(1).cast("long").alias("_o"), "x", "y").na.drop()
    plan = K._ranked(rows, rows, "x", ["y"], True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_p") == 1


def test_auc(spark):
    rnd = random.Random(4)
    rows = [(float(rnd.randint(0, 8)), rnd.random() < 0.4) for _ in range(50)]
    f, s = [v for v, b in rows if b], [v for v, b in rows if not b]
    want = sum((a > b) + 0.5 * (a == b) for a in f for b in s) / (len(f) * len(s))
    got = K.auc_fail_vs_success(spark.createDataFrame([("x", v, b) for v, b in rows], "g string, v double, b boolean"), ["g"], "v", "b").first()
    assert got.auc == pytest.approx(want) and got.n_fail == len(f)


def test_assign_ranks(spark):
    rows = [("b", 0.5, 0.2, 1.0, 0), ("a", 0.5, 0.2, 1.0, 0), ("low", 0.5, 0.1, 0.89, 0), ("oracle", 0.5, 0.0, 1.0, 1), ("inf", 0.5, math.inf, 1.0, 0), ("none", 0.5, None, 1.0, 0), ("c", 0.5, 0.3, 0.9, 0)]
    df = spark.createDataFrame(rows, "method string, target_g double, med_error double, valid_rate double, is_oracle int")
    got = {r.method: r["rank"] for r in R.assign_ranks(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "low": None, "oracle": None, "inf": None, "none": None}
    assert [r.method for r in R.unranked_block(R.assign_ranks(df)).collect()] == ["low"]


def test_log_of_exact_zero_error_is_kept(spark):
    rows = [("f", 0, 1, 0.0, 0.5, 0, "richardson_1", 0.0, 1, 0.0)]
    df = spark.createDataFrame(rows, "family string, is_holdout int, depth int, noise double, target_g double, capped int, method string, error double, valid int, E_last double")
    r = K.richardson_targets(df).first()
    assert r.log_med_error_R == -math.inf and r.R_R_med == 1.0 and r.n_zero_denominator == 1


def test_nearest_family(spark):
    cols = ", ".join(f"{f} double" for f in FE.FEATURES)
    cent = spark.createDataFrame([("a", *[0.0] * 6), ("b", *[1.0] * 6), ("c", *[1.0] * 6)], "family string, " + cols)
    cells = spark.createDataFrame([(1, *[0.9] * 6), (2, 0.1, None, 0.1, 0.1, 0.1, 0.1), (3, *[None] * 6)], "cell int, " + cols)
    assert {r.cell: r.nearest for r in FE.nearest_family(cells, cent).collect()} == {1: "b", 2: "a", 3: "unknown"}


def test_grouped_folds_do_not_leak(spark):
    rows = [(f, d, n, *[float(i)] * 6) for i, f in enumerate("xyz") for d in (30, 60, 90) for n in (0.0, 0.1)]
    t = spark.createDataFrame(rows, "family string, depth int, noise double, " + ", ".join(f"{f} double" for f in FE.FEATURES))
    for p, g in (("grouped_by_depth", "depth"), ("grouped_by_noise", "noise")):
        assert M.folds(t, p).groupBy(g).agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    strat = M.folds(t, "stratified_5fold").groupBy("family", "fold").count().collect()
    assert max(r["count"] for r in strat) - min(r["count"] for r in strat) <= 1
    assert M.predictions(t.filter("depth = 30"), "grouped_by_depth") is None and "cannot" in M.fold_note(1, "x")


def test_wide_curves_and_sinks(spark, tmp_path):
    p = str(tmp_path / "wide")
    spark.createDataFrame([(1, 0.5, 0.25), (2, 0.1, None)], "round int, a double, b double").coalesce(1).write.option("header", True).csv(p)
    got = sorted((r.curve_id, r.step, r.value) for r in tables.read_wide_curves(spark, p).collect())
    assert got == [("a", 1, 0.5), ("a", 2, 0.1), ("b", 1, 0.25)]
    with pytest.raises(ValueError):
        tables.read_wide_curves(spark, p, "step")
    t = spark.createDataFrame([("m", 0, 1, 0.5, 0.1, 0.2, 3, 1)], "method string, is_trivial int, eligible int, valid_rate double, cat_rate double, med_error double, n_cells bigint, dangerous int")
    path = sinks.write_excluded(t, str(tmp_path / "x"))
    assert sinks.load_excluded(spark, path).first().method == "m"
    with pytest.raises(FileNotFoundError):
        sinks.load_excluded(spark, str(tmp_path / "missing"))
    assert sinks.load_excluded(spark, str(tmp_path / "missing"), required=False).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text('{"schema": "excluded-set/0", "table": []}')
    with pytest.raises(ValueError):
        sinks.load_excluded(spark, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        sinks.write_excluded(t.withColumn("is_trivial", F.lit(1)), str(tmp_path / "y"))


def stream_rows(parts):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    return [[(c, n, 1.0 / n, t0 + dt.timedelta(seconds=n)) for c in curves for n in steps] for curves, steps in parts]


def run_stream(spark, src, root):
    points = spark.readStream.schema(live.POINTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    live.start(points, root, (10, 50), 20).awaitTermination(120)


def test_stream_ends_where_the_table_does_and_survives_a_restart(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    # late and repeated points, a curve that stays behind, and a second run that goes on from the checkpoint
    parts = stream_rows([("ab", range(1, 41)), ("a", range(35, 81)), ("b", (40, 41, 39, 38)), ("c", range(1, 6))])
    for i, rows in enumerate(parts[:2]):
        spark.createDataFrame(rows, live.POINTS).coalesce(1).write.parquet(f"{src}/p{i}")
    run_stream(spark, src, root)
    first = spark.read.parquet(f"{root}/forecasts").count()
    for i, rows in enumerate(parts[2:], 2):
        spark.createDataFrame(rows, live.POINTS).coalesce(1).write.parquet(f"{src}/p{i}")
    run_stream(spark, src, root)
    every = spark.read.parquet(f"{root}/forecasts")
    assert {r.curve_id for r in every.filter("seen = 1").collect()} == {"a", "b", "c"}
    assert every.filter("curve_id = 'a'").select("seen").distinct().count() == 2 and every.count() > first      # untouched curves give no rows
    whole = spark.createDataFrame([r for rows in parts for r in rows], live.POINTS)
    table = live.tails(whole, 20)
    assert {r.curve_id: list(r.steps) for r in table.collect()} == {"a": list(range(61, 81)), "b": list(range(22, 42)), "c": [1, 2, 3, 4, 5]}
    want = {(r.curve_id, r.n_f, r.method): r.estimate for r in live.live_forecasts(table, (10, 50)).collect()}
    got = {(r.curve_id, r.depth + r.ahead, r.method): r.estimate for r in live.latest(spark, root).collect()}
    assert set(got) == set(want) and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_tail_merge_keeps_the_last_steps():
    steps, vals = live.merge([1, 2, 3], [1.0, 0.5, 0.3], [3, 5, 2], [0.2, 0.1, 0.9], 3)
    assert (steps, vals) == ([2, 3, 5], [0.9, 0.3, 0.1])


# ---- distribution functions --------------------------------------------------------
def simpson(f, top, n=20_000):
    x = np.linspace(0, top, n + 1)
    w = np.where(np.arange(n + 1) % 2 == 1, 4, 2)
    w[0] = w[-1] = 1
    return float(top / n / 3 * (w * f(x)).sum())


def test_normal_and_t_tails(spark):
    z = [0.0, 1e-6, 0.3, 1.0, 1.96, 3.0, 3.6, 5.0, 8.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(special.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(v / math.sqrt(2)) for v in z], rel=1e-11, abs=1e-300)
    cases = [(t, df) for t in (0.0, 0.1, 0.7, 1.5, 2.5, 6.0) for df in (1, 2, 3, 8, 30, 200, 5000, 100_000)]
    rows = spark.createDataFrame(cases, "t double, df bigint").select("t", "df", special.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in rows:
        c = math.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi)
        want = 1 - 2 * simpson(lambda u: c * (1 + u * u / r.df) ** (-(r.df + 1) / 2), r.t) if r.t else 1.0
        assert r.p == pytest.approx(want, abs=1e-9)
    assert rows[8].p == pytest.approx(1 - 2 / math.pi * math.atan(0.1), rel=1e-12)      # one degree of freedom


def test_rank_sum_p_value(spark):
    rnd = random.Random(2)
    rows = [(k, round(rnd.gauss(0.4 * f, 1), d), f) for k, d in (("fine", 6), ("ties", 0)) for f in (0, 1) for _ in range(60)] + [("one", 1.0, 1), ("flat", 2.0, 0), ("flat", 2.0, 1)]
    got = {r.k: r for r in K.auc_fail_vs_success(spark.createDataFrame(rows, "k string, v double, f int"), ["k"], "v", "f").collect()}
    for k in ("fine", "ties"):
        a, b = ([v for kk, v, f in rows if kk == k and f == side] for side in (1, 0))
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        n, ties = len(a) + len(b), sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
        assert got[k].auc == pytest.approx(u / (len(a) * len(b)))
        assert got[k].p_value == pytest.approx(math.erfc(max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / sd / math.sqrt(2)), rel=1e-10)
    assert got["one"].p_value is None and got["flat"].p_value is None


def test_bootstrap_by_matrix_rows_and_hand(spark, monkeypatch):
    import hashlib
    rnd = random.Random(6)
    cells = [(g, f, rnd.random(), 1, rnd.randint(0, 1), None if rnd.random() < 0.1 else round(rnd.gauss(0, 1), 3)) for g in (0.5, 0.1) for f in "abcde" for _ in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(cells, "target_g double, family string, win double, n int, lower int, diff double")
    draws = 120
    got = {}
    for most in (20_000, 0):
        monkeypatch.setattr(K, "PACKED_CELLS", most)
        got[most] = sorted(map(tuple, K.cluster_bootstrap(df, df.select("family").distinct(), draws).collect()))
    assert [pytest.approx(r) for r in got[0]] == got[20_000]
    for r in got[20_000]:
        mine = [c for c in cells if c[0] == r[0]]
        stats = []
        for b in range(draws):
            taken = [sorted("abcde")[int(hashlib.md5(f"{b}|{s}".encode()).hexdigest()[:8], 16) % 5] for s in range(1, 6)]
            rows = [c for f in taken for c in mine if c[1] == f]
            stats.append((sum(c[2] for c in rows) / len(rows), sum(c[4] for c in rows) / len(rows), np.median([c[5] for c in rows if c[5] is not None])))
        want = [x for i in range(3) for x in np.nanpercentile([s[i] for s in stats], [2.5, 97.5])]
        assert r[5:] == pytest.approx(want)


# ---- blocks of long curves, metric index, keyed diff -----------------------------------
@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_neighbours_across_blocks(spark, block):
    rnd = random.Random(1)
    rows = [(c, s, rnd.random()) for c in "ab" for s in sorted(rnd.sample(range(1, 60), 25))] + [("one", 5, 1.0)]
    got = CV.with_neighbours(spark.createDataFrame(rows, "curve_id string, step int, value double"), 2, 1, block).collect()
    for r in got:
        mine = [(s, v) for c, s, v in rows if c == r.curve_id]
        i = mine.index((r.step, r.value))
        assert [tuple(x) for x in r.before] == mine[max(0, i - 2):i][::-1] and [tuple(x) for x in r.after] == mine[i + 1:i + 2]


def test_a_long_curve_is_never_one_window(spark):
    """Ten million steps in a hundred blocks: right at the borders, and no window is partitioned by the curve alone."""
    n = 10_000_000
    c = spark.range(1, n + 1).select(F.lit("long").alias("curve_id"), F.col("id").cast("int").alias("step"), (F.col("id") % 1000).cast("double").alias("value"))
    d = CV.with_neighbours(c, 1, 0)
    checked = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.get("before", F.lit(0))["step"] == F.col("step") - 1, 1)).alias("joined"),
                    F.sum(F.when(F.size("before") == 0, 1)).alias("first")).first()
    assert (checked.n, checked.joined, checked["first"]) == (n, n - 1, 1)


def test_interpolation_across_blocks(spark):
    rows = [("a", s, float(s * s)) for s in (1, 2, 5, 9, 30, 31)] + [("b", 4, 2.0)]
    df = spark.createDataFrame(rows, "curve_id string, step int, value double")
    grid = (0.5, 1.0, 3.5, 9.0, 20.0, 31.0, 31.5, 4.0)
    got = {(r.curve_id, r.x): r.value for r in CV.interpolate(df, grid, 3).collect()}
    xs, ys = [r[1] for r in rows if r[0] == "a"], [r[2] for r in rows if r[0] == "a"]
    for x in grid:
        assert got["a", x] == pytest.approx(0.0 if x > 31 else float(np.interp(x, xs, ys)))
    assert got["b", 4.0] == 2.0 and got["b", 3.5] == 2.0 and got["b", 9.0] == 0.0 and len(got) == 2 * len(grid)


@pytest.mark.parametrize("pivots,most", [(4, 100_000), (16, 0)])
def test_metric_index_equals_all_distances(spark, monkeypatch, pivots, most):
    monkeypatch.setattr(FE, "PIVOTS", pivots)
    monkeypatch.setattr(FE, "INDEX_ROWS", most)
    rng = np.random.default_rng(3)
    cents = [(f"f{i:03d}", *map(float, rng.normal(size=6).round(1))) for i in range(120)]
    cells = [(i, *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=6).round(1)]) for i in range(150)] + [(999, *[None] * 6)]
    cols = ", ".join(f"{f} double" for f in FE.FEATURES)
    got = {r.cell: r for r in FE.nearest_family(spark.createDataFrame(cells, "cell int, " + cols), spark.createDataFrame(cents, "family string, " + cols)).collect()}
    for cell, *x in cells[:-1]:
        d = min((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, c[1:]) if a is not None)), c[0]) for c in cents)
        assert got[cell].nearest == d[1] and got[cell].distance == pytest.approx(d[0])
    assert got[999].nearest == "unknown" and len(got) == len(cells)


def test_keyed_diff_descends_only_where_sides_differ(spark, monkeypatch):
    base = [(i if i % 50 else None, f"k{i}", float(i), i % 3) for i in range(1, 3000)]
    other = [(a, k, v + (1 if k in ("k7", "k50") else 0), None if k == "k8" else c) for a, k, v, c in base if k not in ("k9", "k10")] + [(1, "new", 1.0, 1)]
    schema = "a int, k string, v double, c int"
    left, right = spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)
    got = H.compare_tables(left, right, ["a", "k"], ["v", "c"]).first().asDict()
    assert got == {"n_both": 2997, "only_left": 2, "only_right": 1, "diff_v": 2, "diff_c": 1}
    *_, open_, equal, by = H.differing_ranges(left, right, ["a", "k"], ["v", "c"])
    assert open_.count() <= 6 and equal > 2900 and len(by) == H.LEVELS
    rows = {r.column: r for r in H.keyed_diff(left, right, ["a", "k"], ["v", "c"]).collect()}
    assert (rows["v"].n_differ, rows["v"].first_key, rows["v"].left_value, rows["v"].right_value) == (2, "-|k50", "50.0", "51.0")
    assert (rows["c"].n_differ, rows["c"].first_key, rows["c"].right_value) == (1, "8|k8", None)
    assert [r.k for r in H.mismatch_sample(left, right, ["a", "k"], ["v", "c"]).collect()] == ["k50", "k7", "k8"]
    assert H.compare_tables(left, left, ["a", "k"], ["v", "c"]).first().asDict() == {"n_both": 2999, "only_left": 0, "only_right": 0, "diff_v": 0, "diff_c": 0}
    monkeypatch.setattr(H, "KNOWN_RANGES", 0)
    assert H.compare_tables(left, right, ["a", "k"], ["v", "c"]).first().asDict() == got


def test_large_groups_settle_small_tables_first(spark, tmp_path, monkeypatch):
    """Few groups of many rows: sizes and wanted buckets are small tables by the time the rows meet them, and the picked rows are few."""
    from tailcast.functions import quantiles as Q
    spark.range(200_000).selectExpr("cast(id % 2 as string) as g", "rand(1) as v", "rand(2) as u").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    want = {r.g: (r.a, r.b) for r in Q.grouped(df, ["g"], [], {"a": ("v", 0.5), "b": ("u", 0.25)}).collect()}
    kept, settled = {}, Q.settled
    monkeypatch.setattr(Q, "GROUP_ROWS", 1000)
    monkeypatch.setattr(Q, "settled", lambda df, name: kept.setdefault(name, settled(df, name)))
    got = Q.grouped(df, ["g"], [], {"a": ("v", 0.5), "b": ("u", 0.25)})
    assert {r.g: (r.a, r.b) for r in got.collect()} == want
    rows = {name: table.count() for name, table in kept.items()}
    assert rows["groups"] == 2 and rows["buckets"] <= 8 and rows["picked"] < 40_000
