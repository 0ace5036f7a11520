"""Fixed values of the forecasting study.

Everything here is data: constants, method names, rule thresholds.  The code
that uses them lives in ``operators`` and ``functions``.
"""

# ---- fixed values: numerical settings ---------------------------------------
WINDOW_LEN = 60
RIDGE = 1e-8
MIN_VALID = -0.5
MAX_VALID = 500.0
DENOM_TOL = 1e-14
CAT_MULT = 5.0
SKILL_EPS = 1e-12
RANK_MIN_VALID = 0.9
RATIO_EPS = 1e-12
WIN_SHIFTS = (-2, -1, 0, 1, 2)
PERTURB_TRIALS = 5
PERTURB_SCALE = 0.02
ENSEMBLE_EPS = 0.01

ASSUMED_MODES = ("zero", "half", "oracle", "double", "winmin")
ORACLE_MODES = ("half", "oracle", "double")
TERCILE_EDGES = (0.005, 0.0232, 0.1077, 0.5)
PANEL_QUANTILES = (0.25, 0.5, 0.75, 0.9)

# ---- fixed values: registry (order is the tie-break of every choice) --------
# name, family, type (T = evaluated at the target step, L = limit of the curve)
METHODS = (
    ("linear", "baseline", "trajectory"),
    ("log_linear", "baseline", "trajectory"),
    ("geom_avg_diff", "baseline", "trajectory"),
    ("richardson_1", "richardson", "trajectory"),
    ("richardson_2", "richardson", "trajectory"),
    ("richardson_3", "richardson", "trajectory"),
    ("richardson_a05", "richardson", "trajectory"),
    ("richardson_a10", "richardson", "trajectory"),
    ("richardson_a20", "richardson", "trajectory"),
    ("single_exp_fit", "parametric", "trajectory"),
    ("double_exp_fit", "parametric", "trajectory"),
    ("rational_fit", "parametric", "trajectory"),
    ("log_fit", "parametric", "trajectory"),
    ("shanks_1", "shanks", "limit"),
    ("shanks_2", "shanks", "limit"),
    ("shanks_3", "shanks", "limit"),
    ("shanks_4", "shanks", "limit"),
    ("wynn_eps_1", "wynn_eps", "limit"),
    ("wynn_eps_2", "wynn_eps", "limit"),
    ("wynn_eps_3", "wynn_eps", "limit"),
    ("wynn_rho_1", "wynn_rho", "limit"),
    ("wynn_rho_2", "wynn_rho", "limit"),
    ("wynn_rho_3", "wynn_rho", "limit"),
    ("pade_11", "pade", "trajectory"),
    ("pade_12", "pade", "trajectory"),
    ("pade_13", "pade", "trajectory"),
    ("pade_21", "pade", "trajectory"),
    ("pade_22", "pade", "trajectory"),
    ("pade_23", "pade", "trajectory"),
    ("pade_31", "pade", "trajectory"),
    ("pade_32", "pade", "trajectory"),
    ("pade_33", "pade", "trajectory"),
    ("pade_34", "pade", "trajectory"),
    ("pade_44", "pade", "trajectory"),
    ("pade_45", "pade", "trajectory"),
    ("levin_t1", "levin", "limit"),
    ("levin_t2", "levin", "limit"),
    ("levin_u1", "levin", "limit"),
    ("levin_u2", "levin", "limit"),
    ("levin_v1", "levin", "limit"),
    ("levin_v2", "levin", "limit"),
    ("brezinski_theta1", "brezinski", "limit"),
    ("brezinski_theta2", "brezinski", "limit"),
    ("neville_2", "neville", "trajectory"),
    ("neville_3", "neville", "trajectory"),
    ("neville_4", "neville", "trajectory"),
    ("anderson_1", "anderson", "limit"),
    ("anderson_2", "anderson", "limit"),
    ("anderson_3", "anderson", "limit"),
    ("median_ensemble", "ensemble", "trajectory"),
    ("stability_weighted", "ensemble", "trajectory"),
    ("best_shanks_wynn", "ensemble", "limit"),
    ("constant_assumed", "trivial", "limit"),
    ("constant_oracle", "trivial", "limit"),
    ("window_mean", "trivial", "limit"),
    ("window_min", "trivial", "limit"),
    ("last_value", "trivial", "limit"),
)
TRIVIALS = ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value")
ORACLES = ("constant_oracle",)
# deployable reference predictors, in tie order, with their column tags
REFERENCES = (("constant_assumed", "assumed"), ("last_value", "last"),
              ("window_mean", "wmean"), ("window_min", "wmin"))
ENSEMBLE_MEMBERS = ("richardson_1", "shanks_1", "shanks_2", "shanks_3",
                    "wynn_eps_1", "wynn_eps_2", "pade_12", "pade_13")
SHANKS_WYNN = ("shanks_1", "shanks_2", "shanks_3", "wynn_eps_1", "wynn_eps_2", "wynn_eps_3")
SMALL_POOL = ("last_value", "richardson_1", "richardson_a10", "single_exp_fit", "rational_fit",
              "pade_22", "log_linear", "levin_t2", "anderson_1")
CLASSICAL_FAMILIES = ("shanks", "wynn_eps", "wynn_rho", "levin", "brezinski", "anderson")
DEFAULT_METHOD = "rational_fit"
CONSERVATIVE_METHOD = "single_exp_fit"
LEAD_TOP_CORE, LEAD_TOP_HOLD, LEAD_TOP_WIN = 10, 5, 3

# ---- fixed values: window features and routing rules ------------------------
FEATURES = ("log_log_slope", "curvature_idx", "oscillation_idx",
            "noise_var", "richardson_r2", "diff_ratio_cv")
CANDIDATE_RULES = (
    ("richardson_r2", "<", 0.50, "pade_22"),
    ("richardson_r2", "<", 0.50, "rational_fit"),
    ("richardson_r2", "<", 0.50, "levin_t2"),
    ("richardson_r2", "<", 0.70, "rational_fit"),
    ("richardson_r2", "<", 0.70, "log_linear"),
    ("richardson_r2", "<", 0.85, "rational_fit"),
    ("log_log_slope", ">", -0.10, "pade_22"),
    ("log_log_slope", ">", -0.10, "rational_fit"),
    ("log_log_slope", ">", -0.30, "rational_fit"),
    ("oscillation_idx", ">", 0.05, "log_linear"),
    ("oscillation_idx", ">", 0.10, "log_linear"),
    ("oscillation_idx", ">", 0.20, "log_linear"),
    ("oscillation_idx", ">", 0.05, "levin_t2"),
    ("curvature_idx", ">", 0.10, "rational_fit"),
    ("curvature_idx", ">", 0.20, "pade_22"),
    ("diff_ratio_cv", "<", 0.01, "levin_t2"),
    ("diff_ratio_cv", "<", 0.05, "pade_22"),
    ("noise_var", ">", 1e-5, "richardson_a10"),
    ("noise_var", ">", 1e-4, "single_exp_fit"),
)
REJECT_THRESHOLDS = (0.001, 0.002, 0.005, 0.010, 0.020, 0.050, 0.100, 0.200, 0.500, 1.000)
SCREEN_THRESHOLDS = (None, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02)     # None = no screen

REGISTRY_INDEX = {name: i for i, (name, _, _) in enumerate(METHODS)}
FAMILY_OF = {name: fam for name, fam, _ in METHODS}
TYPE_OF = {name: kind for name, _, kind in METHODS}
ACCELERATORS = tuple(m for m, _, _ in METHODS if m not in TRIVIALS)
REFERENCE_METHODS = tuple(m for m, _ in REFERENCES)
