import math

import pytest
from pyspark.sql import functions as F

from tailcast.operators import curves as C
from tailcast.operators import scoring as S


def scored(spark, estimates, truth, last, mean=0.5, low=0.4, top=1.0, hat=0.3):
    rows = [(i, f"m{i}", e, truth, last, mean, low, top, hat) for i, e in enumerate(estimates)]
    df = spark.createDataFrame(rows, "i int, method string, estimate_raw double, true_val double, last_v double, mean_v double, min_v double, max_v double, L_hat double")
    return [r for r in S.score(df).orderBy("i").collect()]


def test_record_scoring(spark):
    truth, e_last = 0.41, 0.30
    est = [truth + 5 * e_last, truth + 5 * e_last * (1 + 1e-6), None, 501.0, truth, truth - 0.5 * e_last, 2.0 + 1e-9, -1e-9]
    r = scored(spark, est, truth, truth + e_last)
    assert [x.valid for x in r] == [1, 1, 0, 0, 1, 1, 1, 1]
    assert [x.catastrophic for x in r][:6] == [0, 1, 1, 1, 0, 0]
    assert r[0].improve_ratio == pytest.approx(0.2) and r[0].skill_vs_last == pytest.approx(5)
    assert r[2].improve_ratio is None and r[2].win_vs_last == 0 and r[3].error is None
    assert r[4].improve_ratio == 1 and r[4].skill_vs_last == 0 and r[4].win_vs_last == 1
    assert r[5].improve_ratio == pytest.approx(2) and r[5].skill_vs_last == pytest.approx(0.5) and r[5].win_vs_last == 1
    assert r[6].valid_strict == 0 and r[7].valid_strict == 0


def test_flat_curve(spark):
    r = scored(spark, [0.31, 0.3], 0.3, 0.3, 0.3, 0.3, 0.3, 0.3)
    assert r[0].E_last == 0 and r[0].catastrophic == 0 and r[0].improve_ratio == 0 and math.isinf(r[0].skill_vs_last)
    assert r[1].improve_ratio == 1 and r[1].skill_vs_last == 1 and r[1].win_vs_last == 0


def test_skill_definition(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.2, 0.2), (0.0, 0.0), (0.1, 0.0), (None, 0.2), (0.1, None)], "e double, r double")
    got = [x.s for x in df.select(S.skill(F.col("e"), F.col("r")).alias("s")).collect()]
    assert got[0] == 0.5 and got[1] == 1 and got[2] == 1 and math.isinf(got[3]) and got[4] is None and got[5] is None


def test_oracle_never_a_reference(spark):
    df = spark.createDataFrame([("constant_assumed", 0.4), ("last_value", 0.2), ("window_mean", 0.3), ("window_min", 0.25), ("constant_oracle", 0.0)], "method string, error double")
    assert df.agg(S.best_reference().alias("b")).first().b == "last_value"


def test_assumed_limits(spark):
    df = spark.createDataFrame([(0.20, 0.1), (-0.1, 0.1)], "m double, t double")
    got = df.select(*[C.assumed_limit(m, F.col("m"), F.col("t")).alias(m) for m in ("zero", "half", "oracle", "double", "winmin")]).collect()
    assert [round(v, 12) for v in got[0]] == [0, 0.05, 0.1, 0.2, 0.18] and got[1].winmin == 0
    with pytest.raises(ValueError):
        C.assumed_limit("half", F.col("m"))
    with pytest.raises(ValueError):
        C.assumed_limit("nearby", F.col("m"))
