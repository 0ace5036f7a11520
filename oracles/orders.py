"""Every registered order of the transformation families, level by level."""
from __future__ import annotations

from oracles import prelude as P


def order_ctes(polynomial: bool = True) -> dict[str, str]:
    """ord: limit estimates of all orders; nev: the polynomial family per target."""
    out = P.sequence_ctes(all_orders=True)
    aitken = ("list_filter(list_transform(range(1, len({s}) - 1), lambda i: CASE WHEN abs({s}[i+2] - 2e0 * {s}[i+1] + {s}[i]) >= 1e-14 "
              "THEN ({s}[i+2] * {s}[i] - {s}[i+1] * {s}[i+1]) / ({s}[i+2] - 2e0 * {s}[i+1] + {s}[i]) END), lambda v: v IS NOT NULL AND isfinite(v))")
    out["od0"] = f"SELECT *, ys[len(ys) - 6] AS y6, xs[len(xs) - 6] AS u6, {aitken.format(s='a2')} AS a3 FROM seq"
    cols = [f"{aitken.format(s='a3')} AS a4"]
    prev_name = "od0"
    for level in range(1, 7):
        for k in (1, 2, 3):
            if level > 2 * k:
                continue
            for kind in "er":
                def cur(j, lv, kind=kind, k=k):
                    return f"y{2 * k - j}" if lv == 0 else f"{kind}{k}_{lv}_{j}"
                for j in range(2 * k + 1 - level):
                    before = "0e0" if level == 1 else cur(j + 1, level - 2)
                    num = "1e0" if kind == "e" else f"u{2 * k - j - level} - u{2 * k - j}"
                    cols.append(f"{before} + {P._guard(num, f'({cur(j + 1, level - 1)} - {cur(j, level - 1)})')} AS {kind}{k}_{level}_{j}")
        out[f"od{level}"] = f"SELECT *, {', '.join(cols)} FROM {prev_name}"
        prev_name, cols = f"od{level}", []
    out["ord"] = f"""SELECT * EXCLUDE (shanks_1, shanks_2, wynn_eps_2, wynn_rho_1), {', '.join(f'a{k}[len(a{k})] AS shanks_{k}' for k in (1, 2, 3, 4))},
        {', '.join(f'e{k}_{2 * k}_0 AS wynn_eps_{k}, r{k}_{2 * k}_0 AS wynn_rho_{k}' for k in (1, 2, 3))} FROM {prev_name}"""
    if not polynomial:
        return out
    prev_name = "nv0"
    out["nv0"] = "SELECT o.*, tgt.n_f, tgt.target_g FROM ord o JOIN tgt USING (curve_id, depth)"
    xf = "(1e0 / greatest(n_f::DOUBLE, 1e0))"
    for level in range(1, 5):
        cols = []
        for d in (2, 3, 4):
            if level > d:
                continue

            def xi(j, d=d):
                return f"(1e0 / greatest(u{d - j}, 1e0))"

            def cur(j, d=d, level=level):
                return f"y{d - j}" if level == 1 else f"v{d}_{level - 1}_{j}"
            for i in range(d + 1 - level):
                cols.append(P._guard(f"({xf} - {xi(i)}) * {cur(i + 1)} - ({xf} - {xi(i + level)}) * {cur(i)}", f"({xi(i + level)} - {xi(i)})", "1e-15") + f" AS v{d}_{level}_{i}")
        out[f"nv{level}"] = f"SELECT *, {', '.join(cols)} FROM {prev_name}"
        prev_name = f"nv{level}"
    out["nev"] = f"SELECT *, v2_2_0 AS neville_2, v3_3_0 AS neville_3, v4_4_0 AS neville_4 FROM {prev_name}"
    return out


def neville_at(d: int) -> str:
    """Polynomial in 1/step through the last d + 1 points, at the target."""
    xf = "(1e0 / greatest(n_f::DOUBLE, 1e0))"
    xi = [f"(1e0 / greatest(u{d - j}, 1e0))" for j in range(d + 1)]
    cur = [f"y{d - j}" for j in range(d + 1)]
    for level in range(1, d + 1):
        cur = [P._guard(f"({xf} - {xi[i]}) * {cur[i + 1]} - ({xf} - {xi[i + level]}) * {cur[i]}", f"({xi[i + level]} - {xi[i]})", "1e-15") for i in range(len(cur) - 1)]
    return cur[0]


def limit_ctes(methods) -> dict[str, str]:
    """lms: the limit estimates that ``methods`` need, from the shortest chain that has them."""
    few = {"shanks_1", "shanks_2", "wynn_eps_2", "wynn_rho_1", "levin_t1", "levin_t2", "levin_u1", "levin_v1", "brezinski_theta2", "anderson_1", "anderson_2"}
    if set(methods) & set(P.SEQUENCES) <= few:
        return {**P.sequence_ctes(), "lms": "SELECT *, ys[len(ys) - 6] AS y6, xs[len(xs) - 6] AS u6 FROM seq"}
    return {**order_ctes(polynomial=False), "lms": "SELECT * FROM ord"}


def select(methods) -> str:
    from oracles.tails import R
    names = ", ".join(methods)
    est = R("CASE WHEN isfinite(estimate) THEN estimate END")
    return (f"SELECT curve_id, depth, noise, target_g, method, {est} AS estimate FROM (SELECT curve_id, depth, noise, target_g, {', '.join(f'{m}::DOUBLE AS {m}' for m in methods)} FROM nev) "
            f"UNPIVOT INCLUDE NULLS (estimate FOR method IN ({names}))")


# ---- ladders: every order, from triangular tables that are built level by level -----------------
LADDERS = {"shanks": 10, "wynn_eps": 8, "wynn_rho": 7, "levin_t": 8, "levin_u": 8, "levin_v": 8, "brezinski": 6, "anderson": 6, "neville": 8}


def _levels(ladder: str, start: str, step: str, most: int, source: str = "wins", more: str = "", every: int = 1) -> str:
    """Columns of a table by recursion; ``step`` maps lists prev and cur of level lv to the next column."""
    keys = P.KEYS + more
    return f"""WITH RECURSIVE t AS (SELECT {keys}, xs, 0 AS lv, list_transform({start}, lambda v: v * 0e0) AS prev, {start} AS cur FROM {source}
        UNION ALL SELECT {keys}, xs, lv + 1, cur, {step} FROM t WHERE lv < {most * every})
        SELECT {keys}, '{ladder}' AS ladder, (lv // {every})::INTEGER AS ord, cur[len(cur)] AS v FROM t WHERE lv > 0 AND lv % {every} = 0"""


def _tail(col: str, need: int) -> str:
    return f"{col}[greatest(len({col}) - {need - 1}, 1):]"


def _levin_rows(variant: str, order: int) -> str:
    from math import comb
    need = order + (3 if variant == "v" else 2)
    s, x = (lambda j: f"y{need - 1 - j}"), (lambda j: f"u{need - 1 - j}")
    d = lambda j: f"({s(j + 1)} - {s(j)})"
    weight = {"t": d, "u": lambda j: f"(({x(j)} + 1e0) * {d(j)})", "v": lambda j: P._guard(f"{d(j)} * {d(j + 1)}", f"({d(j + 1)} - {d(j)})")}[variant]
    coefs = []
    for j in range(order + 1):
        beta = "1e0"
        for _ in range(order - 1):
            beta = f"({beta} * ({x(0)} + {j + 1}e0))"
        coefs.append(f"{P._guard(f'{(-1) ** j * comb(order, j)}e0 * {beta}', weight(j))} AS c{j}")
    num = "0e0 + " + " + ".join(f"c{j} * {s(j)}" for j in range(order + 1))
    den = "0e0 + " + " + ".join(f"c{j}" for j in range(order + 1))
    return f"""SELECT {P.KEYS}, 'levin_{variant}' AS ladder, {order} AS ord, CASE WHEN n >= {need} AND abs(den) >= 1e-14 THEN num / den END AS v
        FROM (SELECT *, {num} AS num, {den} AS den FROM (SELECT *, {', '.join(coefs)} FROM ltail))"""


def _anderson_rows(order: int) -> str:
    need = order + 2
    s = lambda j: f"y{need - 1 - j}"
    f = lambda j: f"({s(j + 1)} - {s(j)})"
    dd = [f"({f(j + 1)} - {f(j)})" for j in range(order)]
    norm = "(1e-8 + " + " + ".join(f"{e} * {e}" for e in dd) + ")"
    v = f"({s(order + 1)} + " + " + ".join(f"((-{f(order)}) / {norm}) * {e} * {f(j + 1)}" for j, e in enumerate(dd)) + ")"
    return f"SELECT {P.KEYS}, 'anderson' AS ladder, {order} AS ord, CASE WHEN n >= {need} THEN {v} END AS v FROM ltail"


def ladder_ctes() -> dict[str, str]:
    """lrec: records of every order of every transformation family."""
    g = P._guard
    names = ", ".join(f"ys[len(ys) - {j}] AS y{j}, xs[len(xs) - {j}] AS u{j}" for j in range(12))
    x17, x15, xi9 = _tail("xs", 17), _tail("xs", 15), f"list_transform({_tail('xs', 9)}, lambda v: 1e0 / greatest(v, 1e0))"
    aitken = ("list_filter(list_transform(range(1, len(cur) - 1), lambda i: CASE WHEN abs(cur[i+2] - 2e0 * cur[i+1] + cur[i]) >= 1e-14 "
              "THEN (cur[i+2] * cur[i] - cur[i+1] * cur[i+1]) / (cur[i+2] - 2e0 * cur[i+1] + cur[i]) END), lambda v: v IS NOT NULL AND isfinite(v))")
    rho = g("xt[j + lv + 1] - xt[j]", "(cur[j+1] - cur[j])")
    theta = g("(cur[j+1] - cur[j]) * (cur[j+1] - cur[j])", "(cur[j+2] - 2e0 * cur[j+1] + cur[j])")
    xf = "(1e0 / greatest(n_f::DOUBLE, 1e0))"
    nev = g(f"({xf} - xi[j]) * cur[j+1] - ({xf} - xi[j + lv + 1]) * cur[j]", "(xi[j + lv + 1] - xi[j])", "1e-15")
    limits = [f"SELECT * FROM l_{n}" for n in ("shanks", "eps", "rho", "brez")] + [_levin_rows(v, k) for v in "tuv" for k in range(1, 9)] + [_anderson_rows(k) for k in range(1, 7)]
    base = "curve_id, family, is_holdout, run, depth, noise, window_len, assumed_mode, L_true, L_hat, last_v AS lastv, mean_v, min_v, max_v"
    b = ", ".join("w." + c.strip() for c in base.split(","))
    return {
        "ltail": f"SELECT {P.KEYS}, len(ys) AS n, {names} FROM wins",
        "l_shanks": _levels("shanks", "ys", aitken, 10),
        "l_eps": _levels("wynn_eps", _tail("ys", 17), f"list_transform(range(1, len(cur)), lambda j: prev[j+1] + {g('1e0', '(cur[j+1] - cur[j])')})", 8, every=2),
        "l_rho": _levels("wynn_rho", _tail("ys", 15), f"list_transform(range(1, len(cur)), lambda j: prev[j+1] + {rho})", 7, every=2).replace("xs, 0 AS lv", f"{x15} AS xt, 0 AS lv").replace("xs, lv + 1", "xt, lv + 1"),
        "l_brez": _levels("brezinski", _tail("ys", 13), f"list_transform(range(1, len(cur) - 1), lambda j: cur[j+1] - {theta})", 6),
        "l_nev": _levels("neville", _tail("ys", 9), f"list_transform(range(1, len(cur)), lambda j: {nev})", 8, "(SELECT w.*, tgt.n_f, tgt.target_g FROM wins w JOIN tgt USING (curve_id, depth))", ", n_f, target_g")
        .replace("xs, 0 AS lv", f"{xi9} AS xi, 0 AS lv").replace("xs, lv + 1", "xi, lv + 1"),
        "l_lim": " UNION ALL ".join(limits),
        "lest": f"""SELECT {b}, tgt.* EXCLUDE (curve_id, depth), ladder, ord::INTEGER AS "order", ladder || ':' || ord AS method, v::DOUBLE AS estimate_raw
            FROM wins w JOIN l_lim USING ({P.KEYS}) JOIN tgt ON tgt.curve_id = w.curve_id AND tgt.depth = w.depth
            UNION ALL SELECT {b}, tgt.* EXCLUDE (curve_id, depth), ladder, ord::INTEGER, ladder || ':' || ord, v::DOUBLE
            FROM wins w JOIN l_nev USING ({P.KEYS}) JOIN tgt ON tgt.curve_id = w.curve_id AND tgt.depth = w.depth AND tgt.n_f = l_nev.n_f AND tgt.target_g = l_nev.target_g""",
        **P.record_ctes("lest", "lrec"),
    }
