"""DuckDB side of the study: the same curves, windows, forecasts and records,
written independently in SQL.  Each function returns an ordered mapping of CTE
name -> SQL; ``with_ctes`` joins them in front of a final SELECT.

DuckDB reads 1.0 as a decimal, so double constants are written 1e0.
"""
from __future__ import annotations

PADE = {f"pade_{p}{q}": (p, q) for p, q in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4), (4, 4), (4, 5))}
MEMBERS = ("richardson_1", "shanks_1", "shanks_2", "shanks_3", "wynn_eps_1", "wynn_eps_2", "pade_12", "pade_13")
SHANKS_WYNN = ("shanks_1", "shanks_2", "shanks_3", "wynn_eps_1", "wynn_eps_2", "wynn_eps_3")
COMPOSITES = ("median_ensemble", "stability_weighted", "best_shanks_wynn")
TRIVIAL = ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value")
SEQUENCES = ("shanks_1", "shanks_2", "shanks_3", "shanks_4", "wynn_eps_1", "wynn_eps_2", "wynn_eps_3", "wynn_rho_1", "wynn_rho_2", "wynn_rho_3",
             "levin_t1", "levin_t2", "levin_u1", "levin_u2", "levin_v1", "levin_v2", "brezinski_theta1", "brezinski_theta2", "anderson_1", "anderson_2", "anderson_3")
LINES = ("linear", "log_linear", "geom_avg_diff", "richardson_a05", "richardson_a10", "richardson_a20", "log_fit")
GRID_FITS = {"richardson_1": ("power", "pf"), "single_exp_fit": ("exponential", "ef"), "rational_fit": ("rational", "rf")}
# every registered method but the fits of several terms, in registry order
DEFAULT_METHODS = ("linear", "log_linear", "geom_avg_diff", "richardson_1", "richardson_a05", "richardson_a10", "richardson_a20", "single_exp_fit", "rational_fit", "log_fit",
                   *SEQUENCES[:10], *PADE, *SEQUENCES[10:18], "neville_2", "neville_3", "neville_4", *SEQUENCES[18:], *COMPOSITES, *TRIVIAL)
PLAIN_METHODS = tuple(m for m in DEFAULT_METHODS if m not in COMPOSITES)


def with_ctes(ctes: dict[str, str], final: str) -> str:
    parts = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items())
    own = final.lstrip()
    if own.startswith("WITH "):             # a final statement may bring its own CTEs
        return f"WITH {parts},\n{own[5:]}"
    return f"WITH {parts}\n{final}"


def curve_ctes(kind: str = "se") -> dict[str, str]:
    value = {"mean": "rq / (5e1 * rn)",
             "se": "sqrt(greatest(rq2 / rn - (rq / rn) * (rq / rn), 0e0)) / (5e1 * sqrt(rn::DOUBLE))"}[kind]
    first = 2 if kind == "se" else 1
    return {
        "days": """SELECT l_suppkey AS run, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q,
            sum(l_quantity * l_quantity) AS q2, count(*) AS n
            FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_quantity IS NOT NULL
            GROUP BY 1, 2""",
        "running": """SELECT run, sum(q) OVER w AS rq, sum(q2) OVER w AS rq2, (sum(n) OVER w)::DOUBLE AS rn,
            CAST(row_number() OVER w AS INTEGER) AS step FROM days
            WINDOW w AS (PARTITION BY run ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "fam": """SELECT s_suppkey AS run, r_name AS family, CASE WHEN r_name = 'MIDDLE EAST' THEN 1 ELSE 0 END AS is_holdout
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "curve": f"""SELECT 's' || running.run AS curve_id, family, is_holdout, running.run, step, {value} AS value
            FROM running JOIN fam USING (run) WHERE step >= {first}""",
    }


def _values(name: str, items) -> str:
    return f"(VALUES {', '.join(f'({i})' for i in items)}) AS {name}"


def window_ctes(depths, noise=(0.0,), window_len: int = 60, mode: str = "winmin", limit: str = "NULL::DOUBLE",
                modes=None, lens=None) -> dict[str, str]:
    """wins: one row per (curve, depth, noise[, mode, window_len])."""
    noise_rows = _values("nz(noise)", [f"{s!r}::DOUBLE" for s in noise])
    depth_rows = _values("dp(depth)", depths)
    lens = lens or [window_len]
    len_rows = _values("wl(window_len)", lens)
    mode_rows = _values("md(assumed_mode)", [f"'{m}'" for m in (modes or [mode])])
    return {
        "pts": f"""SELECT curve_id, family, is_holdout, run, depth, noise, window_len, step::DOUBLE AS x,
            CASE WHEN noise = 0 THEN value ELSE value * (1e0 + noise * (2e0 * (('0x' || substr(md5(curve_id || '|' ||
              CAST(round(noise * 1e6) AS BIGINT) || '|' || step), 1, 8))::BIGINT)::DOUBLE / 4294967296e0 - 1e0)) END AS y
            FROM curve JOIN {depth_rows} ON step BETWEEN depth - {max(lens)} + 1 AND depth
            CROSS JOIN {noise_rows} JOIN {len_rows} ON step >= depth - window_len + 1
            WHERE curve_id IN (SELECT curve_id FROM curve c2 GROUP BY curve_id HAVING max(step) >= {max(depths)})""",
        "wins": f"""SELECT *, CASE assumed_mode WHEN 'zero' THEN 0e0 WHEN 'winmin' THEN greatest(0e0, 0.9::DOUBLE * min_v)
              WHEN 'half' THEN 0.5::DOUBLE * L_true WHEN 'oracle' THEN L_true WHEN 'double' THEN 2e0 * L_true END AS L_hat
            FROM (SELECT curve_id, family, is_holdout, run, depth, noise, window_len, list(x ORDER BY x) AS xs,
              list(y ORDER BY x) AS ys, min(y) AS min_v, max(y) AS max_v, avg(y) AS mean_v, max_by(y, x) AS last_v,
              {limit} AS L_true FROM pts GROUP BY ALL) CROSS JOIN {mode_rows}""",
    }


KEYS = "curve_id, depth, noise, window_len, assumed_mode"
ON = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in KEYS.split(","))


def _boxed(lb, cb) -> str:
    """Best {sse, lim, c} from moments n, mp, my, spp, spy, syy."""
    def sse(lim, c):
        return f"(syy - 2e0 * ({c}) * spy + ({c}) * ({c}) * spp + n * pow(my - ({lim}) - ({c}) * mp, 2))"

    def clip(v, box):
        return f"least(greatest({v}, {box[0]}::DOUBLE), {box[1]}::DOUBLE)"

    raw = "(spp + n * mp * mp)"
    cand = []
    for lim in lb:
        c = clip(f"(spy + n * mp * (my - {lim}::DOUBLE)) / {raw}", cb)
        cand.append((f"{lim}::DOUBLE", c))
    for c in cb:
        cand.append((clip(f"my - {c}::DOUBLE * mp", lb), f"{c}::DOUBLE"))
    free, lim0 = "(spy / spp)", "(my - spy / spp * mp)"
    edges = ", ".join(f"{{'sse': {sse(lim, c)}, 'lim': {lim}, 'c': {c}}}" for lim, c in cand)
    return (f"CASE WHEN spp > 0 AND {free} BETWEEN {cb[0]} AND {cb[1]} AND {lim0} BETWEEN {lb[0]} AND {lb[1]} "
            f"THEN {{'sse': {sse(lim0, free)}, 'lim': {lim0}, 'c': {free}}} ELSE list_min([{edges}]) END")


BASIS = {"power": "pow(greatest(x, 1e0), -p)", "exponential": "exp(-p * x)", "rational": "1e0 / (1e0 + p * x)"}
RANGE = {"power": (0.05, 4.0), "exponential": (1e-4, 5.0), "rational": (1e-5, 10.0)}
BOXES = {"power": ((0.0, 2.0), (-5.0, 5.0)), "exponential": ((0.0, 1.0), (0.0, 2.0)), "rational": ((0.0, 1.0), (0.0, 2.0))}


def grid_ctes(points: str, prefix: str, kinds=("power", "exponential", "rational"), keys: str = KEYS,
              boxes=None) -> dict[str, str]:
    """Four passes of a 32-value grid per model; result table {prefix}fit(keys, kind, p, lim, c, sse)."""
    out = {}
    for kind in kinds:
        lo, hi = RANGE[kind]
        box = (boxes or BOXES)[kind]
        src = f"(SELECT DISTINCT {keys}, {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi FROM {points})"
        for i in range(4):
            name = f"{prefix}{kind}{i}"
            out[name] = f"""SELECT {keys}, arg_min({{'p': p, 'lim': b.lim, 'c': b.c, 'sse': b.sse}}, {{'s': b.sse, 'k': k}}) AS w,
                  any_value(lo) * pow(any_value(hi) / any_value(lo), greatest(arg_min(k, {{'s': b.sse, 'k': k}}) - 1, 0) / 31e0) AS lo,
                  any_value(lo) * pow(any_value(hi) / any_value(lo), least(arg_min(k, {{'s': b.sse, 'k': k}}) + 1, 31) / 31e0) AS hi
                FROM (SELECT {keys}, k, p, lo, hi, {_boxed(*box)} AS b FROM (
                  SELECT {keys}, k, p, any_value(lo) AS lo, any_value(hi) AS hi, count(*)::DOUBLE AS n, avg(phi) AS mp, avg(y) AS my,
                    regr_sxx(y, phi) AS spp, regr_sxy(y, phi) AS spy, regr_syy(y, phi) AS syy
                  FROM (SELECT {keys}, k, lo, hi, y, p, {BASIS[kind]} AS phi FROM (
                    SELECT q.*, g.k, s.lo, s.hi, s.lo * pow(s.hi / s.lo, g.k / 31e0) AS p
                    FROM {points} q JOIN {src} s USING ({keys}) CROSS JOIN range(32) g(k)))
                  GROUP BY {keys}, k, p))
                GROUP BY {keys}"""
            src = name
    out[f"{prefix}fit"] = " UNION ALL ".join(
        f"SELECT {keys}, '{kind}' AS kind, w.p AS p, w.lim AS lim, w.c AS c, w.sse AS sse FROM {prefix}{kind}3" for kind in kinds)
    return out


def _guard(num, den, tol="1e-14"):
    return f"(CASE WHEN abs({den}) >= {tol} THEN ({num}) / ({den}) END)"


def sequence_ctes(wins: str = "wins", all_orders: bool = False) -> dict[str, str]:
    """seq: limit estimates from the tail of each window."""
    def d(j, off=0):        # difference number j of the last values s0 .. s(need-1)
        return f"(s{off + j + 1} - s{off + j})"

    def tails(need):
        return {f"s{j}": f"ys[len(ys) - {need - j - 1}]" for j in range(need)}

    def sub(expr, need):
        for j in reversed(range(need)):
            expr = expr.replace(f"s{j}", f"y{need - 1 - j}").replace(f"x{j}_", f"u{need - 1 - j}")
        return expr

    def levin(order, variant):
        need = order + (3 if variant == "v" else 2)
        from math import comb
        coefs = []
        for j in range(order + 1):
            beta = "1e0" if order == 1 else f"(1e0 * (x0_ + {j + 1}e0))"
            if variant == "t":
                w = d(j)
            elif variant == "u":
                w = f"((x{j}_ + 1e0) * {d(j)})"
            else:
                w = _guard(f"{d(j)} * {d(j + 1)}", f"({d(j + 1)} - {d(j)})")
            coefs.append(_guard(f"{(-1) ** j * comb(order, j)}e0 * {beta}", w))
        num = "0e0 + " + " + ".join(f"{c} * s{j}" for j, c in enumerate(coefs))
        den = "(0e0 + " + " + ".join(coefs) + ")"
        return sub(_guard(num, den), need)

    def anderson(order):
        need = order + 2
        dd = [f"({d(j + 1)} - {d(j)})" for j in range(order)]
        norm = "(1e-8 + " + " + ".join(f"{e} * {e}" for e in dd) + ")"
        scale = f"((-{d(order)}) / {norm})"
        return sub(f"(s{order + 1} + " + " + ".join(f"{scale} * {e} * {d(j + 1)}" for j, e in enumerate(dd)) + ")", need)

    aitken = ("list_filter(list_transform(range(1, len({s}) - 1), lambda i: CASE WHEN abs({s}[i+2] - 2e0 * {s}[i+1] + {s}[i]) >= 1e-14 "
              "THEN ({s}[i+2] * {s}[i] - {s}[i+1] * {s}[i+1]) / ({s}[i+2] - 2e0 * {s}[i+1] + {s}[i]) END), "
              "lambda v: v IS NOT NULL AND isfinite(v))")
    names = ", ".join(f"ys[len(ys) - {j}] AS y{j}, xs[len(xs) - {j}] AS u{j}" for j in range(6))

    def theta(a, b, c):
        return f"({b} - " + _guard(f"({b} - {a}) * ({b} - {a})", f"({c} - 2e0 * {b} + {a})") + ")"

    def eps(prev, a, b):
        return f"({prev} + " + _guard("1e0", f"({b} - {a})") + ")"

    more = (f", {levin(2, 'u')} AS levin_u2, {levin(2, 'v')} AS levin_v2, {anderson(3)} AS anderson_3, "
            f"{theta('y2', 'y1', 'y0')} AS brezinski_theta1") if all_orders else ""
    return {
        "tl": f"SELECT *, {names}, {aitken.format(s='ys')} AS a1 FROM {wins}",
        "tl2": f"SELECT *, {aitken.format(s='a1')} AS a2, "
               f"{eps('0e0', 'y4', 'y3')} AS e10, {eps('0e0', 'y3', 'y2')} AS e11, {eps('0e0', 'y2', 'y1')} AS e12, {eps('0e0', 'y1', 'y0')} AS e13, "
               f"0e0 + {_guard('u1 - u2', '(y1 - y2)')} AS r10, 0e0 + {_guard('u0 - u1', '(y0 - y1)')} AS r11, "
               f"{theta('y4', 'y3', 'y2')} AS b0, {theta('y3', 'y2', 'y1')} AS b1, {theta('y2', 'y1', 'y0')} AS b2 FROM tl",
        "tl3": f"SELECT *, {eps('y3', 'e10', 'e11')} AS e20, {eps('y2', 'e11', 'e12')} AS e21, {eps('y1', 'e12', 'e13')} AS e22 FROM tl2",
        "tl4": f"SELECT *, {eps('e11', 'e20', 'e21')} AS e30, {eps('e12', 'e21', 'e22')} AS e31 FROM tl3",
        "seq": f"""SELECT *, a1[len(a1)] AS shanks_1, a2[len(a2)] AS shanks_2, {eps('e21', 'e30', 'e31')} AS wynn_eps_2,
            y1 + {_guard('u0 - u2', '(r11 - r10)')} AS wynn_rho_1, {levin(1, 't')} AS levin_t1, {levin(2, 't')} AS levin_t2,
            {levin(1, 'u')} AS levin_u1, {levin(1, 'v')} AS levin_v1, {theta('b0', 'b1', 'b2')} AS brezinski_theta2,
            {anderson(1)} AS anderson_1, {anderson(2)} AS anderson_2{more},
            L_hat AS constant_assumed, L_true AS constant_oracle, mean_v AS window_mean, min_v AS window_min, last_v AS last_value
            FROM tl4""",
    }


def line_ctes(points: str = "wpts") -> dict[str, str]:
    """Linear models of every window (one pass over the window points)."""
    phi = "1e0 / ln(x + exp(1e0))"
    return {
        "wpts": f"SELECT {KEYS}, L_hat, min_v, unnest(xs) AS x, unnest(ys) AS y FROM wins",
        "lines": f"""SELECT {KEYS}, regr_slope(y, x) AS lb, regr_intercept(y, x) AS la,
            CASE WHEN any_value(min_v) > any_value(L_hat) THEN regr_slope(CASE WHEN y > L_hat THEN ln(y - L_hat) END, ln(greatest(x, 1e0))) END AS gb,
            regr_intercept(CASE WHEN y > L_hat THEN ln(y - L_hat) END, ln(greatest(x, 1e0))) AS ga,
            regr_slope(y, 1e0 / sqrt(greatest(x, 1e0))) AS hb, regr_intercept(y, 1e0 / sqrt(greatest(x, 1e0))) AS ha,
            regr_slope(y, 1e0 / greatest(x, 1e0)) AS ob, regr_intercept(y, 1e0 / greatest(x, 1e0)) AS oa,
            regr_slope(y, 1e0 / (greatest(x, 1e0) * greatest(x, 1e0))) AS tb, regr_intercept(y, 1e0 / (greatest(x, 1e0) * greatest(x, 1e0))) AS ta,
            count(*)::DOUBLE AS n, avg({phi}) AS mp, avg(y) AS my, regr_sxx(y, {phi}) AS spp, regr_sxy(y, {phi}) AS spy, regr_syy(y, {phi}) AS syy
            FROM wpts GROUP BY {KEYS}""",
        "lines2": f"SELECT *, {_boxed((0.0, 1.0), (0.0, 5.0))} AS lg FROM lines",
        "geo": f"""SELECT {KEYS}, d[len(d)] AS dlast, ylast, xlast, CASE WHEN len(ng) >= 2 THEN
              exp((ln(-ng[len(ng)]) - ln(-ng[1])) / (len(ng) - 1)) END AS r FROM (
              SELECT *, list_filter(d, lambda v: v < 0) AS ng FROM (
                SELECT {KEYS}, ys[len(ys)] AS ylast, xs[len(xs)] AS xlast,
                  list_transform(range(greatest(len(ys) - 9, 1)::BIGINT, len(ys)::BIGINT), lambda i: ys[i+1] - ys[i]) AS d FROM wins))""",
    }


def pade_ctes(orders) -> dict[str, str]:
    """pcoef: coefficients of each rational model, by Gram-Schmidt on its columns with the ridge rows appended,
    one column per step of a recursion, then back substitution."""
    def columns(p, q):
        k = p + q + 1
        tail = lambda i: "[" + ", ".join("1e-8::DOUBLE" if j == i else "0e0" for j in range(k)) + "]"
        power = lambda j: f"list_transform(xn, lambda v: pow(v, {j}::DOUBLE))"
        mixed = lambda j: f"list_transform(range(1, len(ys) + 1), lambda i: -pow(xn[i], {j}::DOUBLE) * ys[i])"
        cols = [f"list_concat({power(j)}, {tail(j)})" for j in range(p + 1)] + [f"list_concat({mixed(j)}, {tail(p + j)})" for j in range(1, q + 1)]
        return "[" + ", ".join(cols) + "]", f"list_concat(ys, [{', '.join(['0e0'] * k)}])", k
    each = []
    for name, (p, q) in orders.items():
        cols, b, k = columns(p, q)
        each.append(f"SELECT {KEYS}, '{name}' AS pname, {k} AS k, {cols} AS cols, {b} AS b FROM pdx WHERE len(ys) >= {k + 2}")
    return {
        "pdx": f"SELECT {KEYS}, ys, list_transform(xs, lambda v: (v - xs[1]) / (xs[len(xs)] - xs[1])) AS xn FROM wins",
        "pdc": " UNION ALL ".join(each),
        "pgs": f"""WITH RECURSIVE g AS (
            SELECT {KEYS}, pname, k, 0 AS j, cols, b, []::DOUBLE[][] AS rr, []::DOUBLE[] AS zz FROM pdc
            UNION ALL
            SELECT {KEYS}, pname, k, j + 1, list_transform(range(1, len(rest) + 1), lambda l: list_transform(range(1, len(q) + 1), lambda i: rest[l][i] - rl[l] * q[i])),
              list_transform(range(1, len(q) + 1), lambda i: b[i] - z * q[i]), list_append(rr, list_prepend(r, rl)), list_append(zz, z)
            FROM (SELECT *, list_transform(rest, lambda c: list_dot_product(q, c)) AS rl, list_dot_product(q, b) AS z FROM (
              SELECT *, cols[2:] AS rest, list_transform(cols[1], lambda v: v / r) AS q FROM (SELECT *, sqrt(list_dot_product(cols[1], cols[1])) AS r FROM g WHERE j < k))))
            SELECT {KEYS}, pname, k, rr, zz FROM g WHERE j = k""",
        "pcoef": f"""WITH RECURSIVE s AS (
            SELECT {KEYS}, pname, k, rr, zz, k AS j, []::DOUBLE[] AS c FROM pgs
            UNION ALL
            SELECT {KEYS}, pname, k, rr, zz, j - 1, list_prepend((zz[j] - CASE WHEN len(c) > 0 THEN list_dot_product(rr[j][2:], c) ELSE 0e0 END) / rr[j][1], c) FROM s WHERE j > 0)
            SELECT {KEYS}, pname, c FROM s WHERE j = 0""",
        "pwide": f"SELECT {KEYS}, " + ", ".join(f"any_value(c) FILTER (WHERE pname = '{n}') AS c_{n}" for n in orders) + f" FROM pcoef GROUP BY {KEYS}",
    }


def _pade_at(name: str, order) -> str:
    p, q = order
    z = "((n_f::DOUBLE - xa) / (xb - xa))"
    num = f"c_{name}[{p + 1}]"
    for j in range(p - 1, -1, -1):
        num = f"({num} * zt + c_{name}[{j + 1}])"
    den = "0e0"
    for j in range(q, 0, -1):
        den = f"(({den} + c_{name}[{p + 1 + j}]) * zt)"
    return _guard(num, f"({den} + 1e0)").replace("zt", z)


def estimate_ctes(methods=DEFAULT_METHODS, grid=True) -> dict[str, str]:
    """est: one row per (window, target, method).  Needs wins and
    tgt(curve_id, depth, n_f, true_val, ...)."""
    composites = [m for m in methods if m in COMPOSITES]
    members = [m for m in MEMBERS + SHANKS_WYNN if composites and m not in methods]
    plain = [m for m in methods if m not in COMPOSITES] + list(dict.fromkeys(members))
    from oracles import orders as O
    out = {**line_ctes(), **O.limit_ctes(plain)}
    kinds = [GRID_FITS[m] for m in GRID_FITS if m in plain] if grid else []
    if kinds:
        out.update(grid_ctes("wpts", "g_", tuple(k for k, _ in kinds)))
    pades = {m: PADE[m] for m in plain if m in PADE}
    if pades:
        out.update(pade_ctes(pades))
    t = "n_f::DOUBLE"
    cols = {
        "linear": f"la + lb * {t}",
        "log_linear": f"L_hat + exp(ga + gb * ln(greatest({t}, 1e0)))",
        "geom_avg_diff": f"CASE WHEN r > 0 AND r < 1 THEN ylast + dlast * r * (1e0 - pow(r, {t} - xlast)) / (1e0 - r) END",
        "richardson_1": f"pf.lim + pf.c * pow(greatest({t}, 1e0), -pf.p)",
        "richardson_a05": f"ha + hb / sqrt({t})", "richardson_a10": f"oa + ob / {t}", "richardson_a20": f"ta + tb / ({t} * {t})",
        "single_exp_fit": f"ef.lim + ef.c * exp(-ef.p * {t})",
        "rational_fit": f"rf.lim + rf.c / (1e0 + rf.p * {t})",
        "log_fit": f"lg.lim + lg.c / ln({t} + exp(1e0))",
        **{m: _pade_at(m, o) for m, o in pades.items()},
        **{f"neville_{d}": O.neville_at(d) for d in (2, 3, 4)},
    }
    chosen = ", ".join(f"({cols.get(m, f'lms.{m}')})::DOUBLE AS {m}" for m in plain)
    fits = "".join(f" JOIN (SELECT * FROM g_fit WHERE kind = '{k}') {a} USING ({KEYS})" for k, a in kinds)
    if pades:
        fits += f" JOIN (SELECT {KEYS}, xs[1] AS xa, xs[len(xs)] AS xb FROM wins) USING ({KEYS}) LEFT JOIN pwide USING ({KEYS})"
    out["wide"] = f"""SELECT lms.curve_id, lms.family, lms.is_holdout, lms.run, lms.depth, lms.noise, lms.window_len, lms.assumed_mode,
        lms.L_true, lms.L_hat, lms.last_v AS lastv, lms.mean_v, lms.min_v, lms.max_v, tgt.* EXCLUDE (curve_id, depth), {chosen}
        FROM lms JOIN lines2 USING ({KEYS}) JOIN geo USING ({KEYS}) {fits}
        JOIN tgt ON tgt.curve_id = lms.curve_id AND tgt.depth = lms.depth"""
    source = "wide"
    if composites:
        out.update(composite_ctes(composites))
        source = "mixed"
    out["est"] = f"SELECT * FROM {source} UNPIVOT INCLUDE NULLS (estimate_raw FOR method IN ({', '.join(methods)}))"
    if members:
        out["est"] = f"SELECT * FROM (SELECT * EXCLUDE ({', '.join(dict.fromkeys(members))}) FROM {source}) UNPIVOT INCLUDE NULLS (estimate_raw FOR method IN ({', '.join(methods)}))"
    return out


def composite_ctes(composites) -> dict[str, str]:
    """mixed: the wide table with the methods over other methods.  Shifted windows ride in the window_len key as
    ten times the length plus the shift."""
    from oracles import variants as V
    ok = lambda v: f"CASE WHEN {_valid(v)} THEN {v} END"
    valid = lambda names, tab: "list_filter([" + ", ".join(ok(f"{tab}.{m}") for m in names) + "], lambda v: v IS NOT NULL)"
    pool = valid(MEMBERS, "w")
    out, cols, source = {}, {"median_ensemble": f"CASE WHEN len({pool}) >= 3 THEN list_median({pool}) END"}, "wide w"
    moved = [m for c, ms in (("stability_weighted", MEMBERS), ("best_shanks_wynn", SHANKS_WYNN)) if c in composites for m in ms]
    moved = list(dict.fromkeys(moved))
    if moved:
        base = {"wins": f"""SELECT curve_id, family, is_holdout, run, depth, noise, window_len * 10 + sh AS window_len, assumed_mode, L_true, L_hat, xs, ys, list_min(ys) AS min_v, list_max(ys) AS max_v,
                  list_avg(ys) AS mean_v, ys[len(ys)] AS last_v FROM (SELECT * EXCLUDE (xs, ys, min_v, max_v, mean_v, last_v), xs[1 + sh:] AS xs, ys[1 + sh:] AS ys FROM wins CROSS JOIN (VALUES (1), (2)) t(sh) WHERE len(ys) - sh >= 3)""",
                "tgt": "SELECT * FROM tgt", **estimate_ctes(tuple(moved))}
        del base["est"]
        out.update(V._isolated(base, "x_"))
        out["x_wins"], out["x_tgt"] = base["wins"], "SELECT * FROM tgt"
        same = "w.curve_id = {a}.curve_id AND w.depth = {a}.depth AND w.noise = {a}.noise AND w.assumed_mode = {a}.assumed_mode AND w.n_f = {a}.n_f AND w.tkey = {a}.tkey AND {a}.window_len = w.window_len * 10 + {s}"
        out["tk"] = "SELECT *, row_number() OVER (PARTITION BY curve_id, depth, noise, assumed_mode, window_len, n_f ORDER BY true_val) AS tkey FROM wide"
        out["x_tk"] = "SELECT *, row_number() OVER (PARTITION BY curve_id, depth, noise, assumed_mode, window_len, n_f ORDER BY true_val) AS tkey FROM x_wide"
        source = f"tk w LEFT JOIN x_tk a ON {same.format(a='a', s=1)} LEFT JOIN x_tk b ON {same.format(a='b', s=2)}"

        def spread(m):
            v = ok(f"w.{m}")
            every = f"list_filter([{v}, {v}, {v}, {ok(f'a.{m}')}, {ok(f'b.{m}')}], lambda v: v IS NOT NULL)"
            return f"CASE WHEN len({every}) >= 2 THEN list_aggregate({every}, 'quantile_cont', 0.75) - list_aggregate({every}, 'quantile_cont', 0.25) END"
        if "stability_weighted" in composites:
            pairs = "list_filter([" + ", ".join(f"{{'v': {ok(f'w.{m}')}, 'q': {spread(m)}}}" for m in MEMBERS) + "], lambda p: p.v IS NOT NULL)"
            total = f"list_sum(list_transform({pairs}, lambda p: 1e0 / (p.q + 1e-6)))"
            cols["stability_weighted"] = f"CASE WHEN len({pool}) >= 2 THEN list_sum(list_transform({pairs}, lambda p: p.v / (p.q + 1e-6))) / {total} END"
        if "best_shanks_wynn" in composites:
            pairs = "list_filter([" + ", ".join(f"{{'q': {spread(m)}, 'i': {i}, 'v': {ok(f'w.{m}')}}}" for i, m in enumerate(SHANKS_WYNN)) + "], lambda p: p.v IS NOT NULL AND p.q IS NOT NULL)"
            cols["best_shanks_wynn"] = f"coalesce(list_min({pairs}).v, w.lastv)"
    out["mixed"] = f"SELECT w.*{' EXCLUDE (tkey)' if moved else ''}, {', '.join(f'({cols[c]})::DOUBLE AS {c}' for c in composites)} FROM {source}"
    return out


def dimension_cte() -> str:
    from tailcast.settings import METHODS, ORACLES, TRIVIALS
    rows = ", ".join(f"('{n}', '{f}', '{t}', {int(n in TRIVIALS)}, {int(n in ORACLES)}, {i})"
                     for i, (n, f, t) in enumerate(METHODS))
    return ("SELECT * FROM (VALUES " + rows + ") AS m(method, method_family, method_type, is_trivial, is_oracle, registry_index)")


def _valid(v):
    return f"({v} IS NOT NULL AND isfinite({v}) AND {v} BETWEEN -0.5 AND 500)"


def _skill(e, r):
    return (f"CASE WHEN {e} IS NULL OR {r} IS NULL THEN NULL WHEN {r} <= 1e-12 THEN CASE WHEN {e} <= 1e-12 THEN 1e0 "
            f"ELSE 'inf'::DOUBLE END ELSE {e} / {r} END")


def record_ctes(est: str = "est", name: str = "rec") -> dict[str, str]:
    refs = {"assumed": "L_hat", "last": "lastv", "wmean": "mean_v", "wmin": "min_v"}
    errs = ", ".join(f"CASE WHEN {_valid(c)} THEN round(abs({c} - true_val) * 1e12) / 1e12 END AS e_{tag}" for tag, c in refs.items())
    vs = ", ".join(f"{_skill('error', f'e_{tag}')} AS skill_vs_{tag}, CASE WHEN error < e_{tag} THEN 1 ELSE 0 END AS win_vs_{tag}"
                   for tag in refs)
    return {
        "dim": dimension_cte(),
        f"{name}0": f"""SELECT *, CASE WHEN {_valid('estimate_raw')} THEN 1 ELSE 0 END AS valid,
            CASE WHEN estimate_raw IS NOT NULL AND isfinite(estimate_raw) AND estimate_raw BETWEEN 0 AND 2e0 * max_v THEN 1 ELSE 0 END AS valid_strict,
            CASE WHEN {_valid('estimate_raw')} THEN round(abs(estimate_raw - true_val) * 1e12) / 1e12 END AS error,
            round(abs(lastv - true_val) * 1e12) / 1e12 AS curr_err, {errs} FROM {est}""",
        name: f"""SELECT r.*, CASE WHEN valid = 1 THEN estimate_raw END AS estimate, e_last AS E_last_, lastv AS curr_val,
            least(e_assumed, e_last, e_wmean, e_wmin) AS ref_error, {_skill('error', 'least(e_assumed, e_last, e_wmean, e_wmin)')} AS skill,
            CASE WHEN error IS NULL OR (curr_err > 1e-12 AND error > 5 * curr_err) THEN 1 ELSE 0 END AS catastrophic,
            CASE WHEN error > 1e-12 THEN curr_err / error WHEN error IS NOT NULL THEN 1e0 END AS improve_ratio,
            {vs}, method_family, method_type, is_trivial, is_oracle, registry_index
            FROM {name}0 r LEFT JOIN dim USING (method)""",
    }


def horizon_ctes(depths, fractions, cap: int = 2**31 - 1) -> dict[str, str]:
    return {
        "hz0": f"""SELECT a.curve_id, a.family, a.step AS depth, a.value AS gap_obs, g AS target_g
            FROM curve a JOIN {_values('dp(depth)', depths)} ON a.step = depth CROSS JOIN {_values('gg(g)', [f'{f!r}::DOUBLE' for f in fractions])}""",
        "hz1": f"""SELECT h.curve_id, h.family, h.depth, h.target_g, h.gap_obs, h.gap_obs <= 0 AS degenerate,
            min(c.step) FILTER (WHERE c.step > h.depth AND c.value <= h.target_g * h.gap_obs) AS hit, max(c.step) AS last_step
            FROM hz0 h JOIN curve c ON c.curve_id = h.curve_id AND c.step <= {cap} GROUP BY ALL HAVING max(c.step) > h.depth""",
        "hz": """SELECT z.*, c.value AS true_val, c.value AS gap_f, CASE WHEN NOT degenerate THEN c.value / gap_obs END AS achieved_g
            FROM (SELECT curve_id, family, depth, target_g, gap_obs, degenerate,
              CASE WHEN degenerate THEN depth + 1 ELSE coalesce(hit, last_step) END AS n_f,
              CASE WHEN degenerate THEN 0 WHEN hit IS NULL THEN 1 ELSE 0 END AS capped FROM hz1) z
            LEFT JOIN curve c ON c.curve_id = z.curve_id AND c.step = z.n_f""",
        "tgt": "SELECT curve_id, depth, target_g, n_f, achieved_g, capped, true_val FROM hz",
    }


def step_target_ctes(depths, targets) -> dict[str, str]:
    return {"tgt": f"""SELECT c.curve_id, depth, c.step AS n_f, c.value AS true_val FROM curve c
        JOIN {_values('tg(target)', targets)} ON c.step = target JOIN {_values('dp(depth)', depths)} ON depth < target"""}


def minima_cte() -> dict[str, str]:
    return {"minima": """SELECT curve_id, family, is_holdout, run, max(step) AS n_rounds, arg_min(step, {'v': value, 's': step}) AS argmin_round,
        min(value) AS min_value, max_by(value, step) AS value_at_round, max(step) AS at_round,
        CASE WHEN abs(min(value)) > 1e-12 THEN (max_by(value, step) - min(value)) / min(value) END AS rise_from_min
        FROM curve GROUP BY curve_id, family, is_holdout, run"""}


def gap_study(methods=DEFAULT_METHODS, depths=(30, 60, 90), fractions=(0.7, 0.5, 0.1), noise=(0.0, 0.005)) -> dict[str, str]:
    return {**curve_ctes("se"), **horizon_ctes(depths, fractions), **window_ctes(depths, noise, limit="0e0"),
            **estimate_ctes(methods), **record_ctes()}


def step_study(methods=DEFAULT_METHODS, depths=(30, 60, 90, 120, 150), targets=(200, 300, 400)) -> dict[str, str]:
    return {**curve_ctes("mean"), **step_target_ctes(depths, targets), **window_ctes(depths), **minima_cte(),
            **estimate_ctes(methods), **record_ctes(name="srec_"),
            "srec": """SELECT s.*, m.argmin_round, m.rise_from_min, CASE WHEN s.n_f > m.argmin_round THEN 1 ELSE 0 END AS post_min_target
                FROM srec_ s JOIN minima m USING (curve_id)"""}
