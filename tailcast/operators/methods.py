"""The method dimension and the registry of forecast expressions."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions import fits, sequence
from tailcast.functions.arrays import back, deltas, finite, let, sorted_quantile, tail, total
from tailcast.settings import (ACCELERATORS, CLASSICAL_FAMILIES, ENSEMBLE_MEMBERS, FAMILY_OF, MAX_VALID, METHODS, MIN_VALID, ORACLES,
                               REGISTRY_INDEX, SHANKS_WYNN, TRIVIALS, TYPE_OF, WIN_SHIFTS)


@dataclass(frozen=True)
class Method:
    """``parameters``: expression on the window that is computed once per window
    (NULL when there is nothing to fit).  ``estimate``: expression of (parameters,
    target); methods of type ``limit`` ignore the target.

    A composite has ``members`` instead, other methods by name, and ``combine``: an expression of
    an array with one struct per member, in their order: ``v``, its estimate (NULL if invalid), and
    ``spread``, the interquartile range of its valid estimates over window-start shifts
    (NULL unless ``spreads`` asks for it, infinite with fewer than two)."""
    name: str
    family: str
    kind: str
    parameters: Callable[[], Column] | None = None
    estimate: Callable[[Column, Column], Column] | None = None
    members: tuple[str, ...] = ()
    combine: Callable[[Column], Column] | None = None
    spreads: bool = False


def XS() -> Column:
    return F.col("xs")


def YS() -> Column:
    return F.col("ys")


def _power_fixed(alpha):
    return (lambda: fits.power_line(YS(), XS(), alpha),
            lambda p, t: p["intercept"] + p["slope"] * fits.inverse_power(t.cast("double"), alpha))


def _geometric():
    """Ratio of consecutive negative differences among the last ten values and
    the last difference; the mean log ratio telescopes."""
    d = deltas(tail(YS(), 10))
    neg = F.filter(d, lambda v: v < 0)
    ratio = F.when((F.size(YS()) >= 4) & (F.size(neg) >= 2), F.exp(
        (F.ln(-back(neg, 1)) - F.ln(-F.get(neg, F.lit(0)))) / (F.size(neg) - 1)))
    return F.struct(ratio.alias("r"), back(d, 1).alias("d"), back(YS(), 1).alias("last"), back(XS(), 1).alias("x"))


def _geometric_at(p, t):
    steps = t.cast("double") - p["x"]
    tail_sum = p["d"] * p["r"] * (F.lit(1.0) - F.pow(p["r"], steps)) / (F.lit(1.0) - p["r"])
    return F.when((p["r"] > 0) & (p["r"] < 1), F.when(steps <= 0, p["last"]).otherwise(p["last"] + tail_sum))


def _trajectory_methods():
    out = {
        "linear": (lambda: fits.line(YS(), XS()), lambda p, t: p["intercept"] + p["slope"] * t.cast("double")),
        "log_linear": (lambda: fits.log_line(YS(), XS(), F.col("L_hat")),
                       lambda p, t: F.col("L_hat") + F.exp(
                           p["intercept"] + p["slope"] * F.ln(F.greatest(t.cast("double"), F.lit(1.0))))),
        "geom_avg_diff": (_geometric, _geometric_at),
        "richardson_a05": _power_fixed(0.5),
        "richardson_a10": _power_fixed(1.0),
        "richardson_a20": _power_fixed(2.0),
        "log_fit": (lambda: fits.log_decay(YS(), XS()),
                    lambda p, t: p["limit"] + p["amp"] / F.ln(t.cast("double") + F.exp(F.lit(1.0)))),
    }
    for name, kind in (("richardson_1", "power"), ("single_exp_fit", "exponential"), ("rational_fit", "rational")):
        out[name] = (lambda kind=kind: fits.one_term_parameters(kind)(XS(), YS()),
                     lambda p, t, kind=kind: fits.at_one_term(kind, p, t))
    for name, kind in (("richardson_2", "power2"), ("richardson_3", "power3"), ("double_exp_fit", "exponential2")):
        out[name] = (lambda kind=kind: fits.many_term_parameters(kind)(XS(), YS()),
                     lambda p, t, kind=kind: fits.at_many_terms(kind, p, t))
    for name in [m for m in FAMILY_OF if FAMILY_OF[m] == "pade"]:
        order = (int(name[-2]), int(name[-1]))
        out[name] = (lambda order=order: fits.pade_parameters(order)(XS(), YS()),
                     lambda p, t, order=order: fits.at_pade(order, p, XS(), t))
    for d in (2, 3, 4):
        out[f"neville_{d}"] = (None, lambda p, t, d=d: sequence.neville(YS(), XS(), d, t))
    return out


def _limit_methods():
    out = {
        "constant_assumed": lambda: F.col("L_hat"),
        "constant_oracle": lambda: F.col("L_true"),
        "window_mean": lambda: F.col("mean_v"),
        "window_min": lambda: F.col("min_v"),
        "last_value": lambda: F.col("last_v"),
    }
    for k in (1, 2, 3, 4):
        out[f"shanks_{k}"] = lambda k=k: sequence.shanks(YS(), k)
    for k in (1, 2, 3):
        out[f"wynn_eps_{k}"] = lambda k=k: sequence.wynn_epsilon(YS(), k)
        out[f"wynn_rho_{k}"] = lambda k=k: sequence.wynn_rho(YS(), XS(), k)
        out[f"anderson_{k}"] = lambda k=k: sequence.anderson(YS(), k)
    for v in "tuv":
        for k in (1, 2):
            out[f"levin_{v}{k}"] = lambda k=k, v=v: sequence.levin(YS(), XS(), k, v)
    for k in (1, 2):
        out[f"brezinski_theta{k}"] = lambda k=k: sequence.brezinski(YS(), k)
    return out


SPREAD_FLOOR = 1e-6            # added to a spread before it is inverted


def valid_or_null(v: Column) -> Column:
    return F.when(finite(v) & v.between(MIN_VALID, MAX_VALID), v)


def shift_spread(shifted: dict[int, Column]) -> Column:
    """Interquartile range of the valid estimates over the shifts; shifts below 0 leave the window as it
    is, so they repeat shift 0."""
    every = F.filter(F.array(*[shifted[max(0, s)] for s in WIN_SHIFTS]), lambda v: v.isNotNull())
    return let(F.array_sort(every), lambda a: F.when(F.size(a) >= 2, sorted_quantile(a, 0.75) - sorted_quantile(a, 0.25)).otherwise(F.lit(float("inf"))))


def _median_of_three(found: Column) -> Column:
    values = F.array_sort(F.transform(F.filter(found, lambda m: m["v"].isNotNull()), lambda m: m["v"]))
    return let(values, lambda a: F.when(F.size(a) >= 3, sorted_quantile(a, 0.5)))


def _by_stability(found: Column) -> Column:
    def mean(some):
        weight = lambda m: F.lit(1.0) / (m["spread"] + SPREAD_FLOOR)
        return F.when(F.size(some) >= 2, F.try_divide(total(F.transform(some, lambda m: weight(m) * m["v"])), total(F.transform(some, weight))))
    return let(F.filter(found, lambda m: m["v"].isNotNull()), mean)


def _steadiest(found: Column) -> Column:
    """The member of the smallest spread, the first of equal ones; the last value if no member is valid."""
    ordered = F.transform(found, lambda m, i: F.struct(m["spread"].alias("spread"), i.alias("i"), m["v"].alias("v")))
    steady = F.filter(ordered, lambda m: m["v"].isNotNull() & (m["spread"] < float("inf")))
    return F.coalesce(F.array_min(steady)["v"], F.col("last_v"))


COMPOSITES = {
    "median_ensemble": (ENSEMBLE_MEMBERS, _median_of_three, False),
    "stability_weighted": (ENSEMBLE_MEMBERS, _by_stability, True),
    "best_shanks_wynn": (SHANKS_WYNN, _steadiest, True),
}


def _build() -> dict[str, Method]:
    reg = {}
    for name, (par, est) in _trajectory_methods().items():
        reg[name] = Method(name, FAMILY_OF[name], TYPE_OF[name], par, est)
    for name, par in _limit_methods().items():
        reg[name] = Method(name, FAMILY_OF[name], TYPE_OF[name], par, lambda p, t: p)
    for name, (members, combine, spreads) in COMPOSITES.items():
        reg[name] = Method(name, FAMILY_OF[name], TYPE_OF[name], members=members, combine=combine, spreads=spreads)
    return dict(sorted(reg.items(), key=lambda kv: REGISTRY_INDEX[kv[0]]))


REGISTRY: dict[str, Method] = _build()
_user: dict[str, Method] = {}


def register_method(name: str, family: str, kind: str, estimate, parameters=None) -> Method:
    """Register a forecast expression.  ``parameters()`` is a Column on the window
    (``xs``, ``ys``, ``L_hat``, ...); ``estimate(parameters, target)`` a Column.
    An Arrow or pandas function wrapped as a Column expression works as well."""
    if kind not in ("trajectory", "limit"):
        raise ValueError(f"kind must be 'trajectory' or 'limit', got {kind!r}")
    if name in REGISTRY_INDEX:
        raise ValueError(f"{name!r} is a built-in method")
    _user[name] = Method(name, family, kind, parameters, estimate)
    return _user[name]


def register_composite(name: str, family: str, kind: str, members, combine, spreads: bool = False) -> Method:
    """Register a method over other methods.  ``combine`` takes an array of (v, spread) structs, one per member in order.
    Members may be composites themselves; each must be known already, so no cycle can arise."""
    if kind not in ("trajectory", "limit"):
        raise ValueError(f"kind must be 'trajectory' or 'limit', got {kind!r}")
    if name in REGISTRY_INDEX:
        raise ValueError(f"{name!r} is a built-in method")
    if not members or name in members:
        raise ValueError("a composite needs members other than itself")
    for m in members:
        lookup(m)
    _user[name] = Method(name, family, kind, members=tuple(members), combine=combine, spreads=spreads)
    return _user[name]


def levels(methods) -> list[list[Method]]:
    """The methods and all that they depend on, in levels: plain ones first, then composites of earlier levels only."""
    level: dict[str, int] = {}

    def place(name):
        if name not in level:
            m = lookup(name)
            level[name] = 1 + max((place(x) for x in m.members), default=-1)
        return level[name]

    for name in methods:
        place(name)
    return [[lookup(n) for n, at in level.items() if at == i] for i in range(max(level.values(), default=-1) + 1)]


def shifted_members(ranked: list[list[Method]]) -> list[str]:
    """Methods whose estimates on shifted windows some composite needs, and all that those depend on."""
    wanted = [m for layer in ranked for s in layer if s.spreads for m in s.members]
    return [m.name for layer in levels(wanted) for m in layer] if wanted else []


def lookup(name: str) -> Method:
    method = _user.get(name) or REGISTRY.get(name)
    if method is None:
        raise KeyError(f"no window expression for method {name!r}")
    return method


_expressions: dict[tuple, tuple] = {}


def expressions(method: Method) -> tuple[Column | None, Column]:
    """(parameters, estimate) of a plain method, for a row that has the parameters as ``_p_<name>`` and the target
    as ``t.n_f``.  They are built once per application: the same expressions serve every plan."""
    key = (SparkContext._active_spark_context.applicationId, method.name, id(method))
    if key not in _expressions:
        held = method.parameters is not None
        _expressions[key] = (method.parameters() if held else None, method.estimate(F.col(f"_p_{method.name}") if held else None, F.col("t.n_f")).cast("double"))
    return _expressions[key]


def method_table(spark: SparkSession) -> DataFrame:
    """One row per registered method; fewer than a hundred rows, so always safe
    to broadcast."""
    rows = [(n, f, TYPE_OF[n], int(n in TRIVIALS), int(n in ORACLES), i)
            for i, (n, f, _) in enumerate(METHODS)]
    rows += [(m.name, m.family, m.kind, 0, 0, len(METHODS) + i) for i, m in enumerate(_user.values())]
    return spark.createDataFrame(rows, "method string, method_family string, method_type string, "
                                       "is_trivial int, is_oracle int, registry_index int")


def classical_methods() -> list[str]:
    names = [m for m in ACCELERATORS if FAMILY_OF[m] in CLASSICAL_FAMILIES and TYPE_OF[m] == "limit"]
    return sorted(names, key=lambda m: (CLASSICAL_FAMILIES.index(FAMILY_OF[m]), m))


def roster_by_family(spark: SparkSession, methods=None) -> DataFrame:
    """Family: number of methods, common type or 'mixed', members in registry order."""
    t = method_table(spark)
    if methods is not None:
        t = t.filter(F.col("method").isin(*methods))
    return t.groupBy("method_family").agg(
        F.count(F.lit(1)).alias("n_methods"),
        F.when(F.count_distinct("method_type") == 1, F.min("method_type")).otherwise("mixed").alias("method_type"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("registry_index", "method"))),
                                     lambda s: s["method"])).alias("members"))
