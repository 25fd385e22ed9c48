"""Weights, models, scoring (M), evaluation (E), interpretation (I), tuning (U), hooks (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.ingest import scratch
from truegauge.catalog.registry import PAIRS_CTE, query, r, rnd, rounded, rs
from truegauge.catalog.relations import ROLES, roles
from truegauge.operators import evaluate, interpret, models, tuning
from truegauge.operators.aggregates import sign_balance
from truegauge.operators.boosting import Loss, fit_boosted
from truegauge.operators.ordered import ewma, with_ordinal
from truegauge.operators.lookup import attach
from truegauge.plans import calibrate, report
from truegauge.session import materialise
from truegauge.sources import sinks
from truegauge.spec import ModelParams

FEATURES = ("online", "qty", "disc", "lines")
ORDER = ("o_orderdate", "o_orderkey")
QUICK = ModelParams(damping=0.5, pos_boost=1.2, alpha_smoothing=0.7, learning_rate=0.1, max_iter=8, max_depth=3)
#: The published method's rounds, depth and learning rate.
WHOLE = ModelParams(damping=0.5, pos_boost=1.2)
PAIR_ROLES = calibrate.TrainingRoles("truth", "online", "delta", FEATURES, ORDER)


def pair_rows(t):
    """Pairs with train/test role per group, written once because fits read them repeatedly."""
    return materialise(roles(t).withColumn("lines", F.col("lines").cast("double")), "pairs")


@query(
    "M4_direction_weights",
    f"""WITH {PAIRS_CTE}, c AS (SELECT grp, count(*) FILTER (delta > 0) AS p, count(*) FILTER (delta < 0) AS q FROM pairs GROUP BY 1)
      SELECT o_orderkey, {r('CASE WHEN delta > 0 THEN 0.4::DOUBLE + 0.6::DOUBLE * ((p + q) / (2.0 * p)) * 1.5::DOUBLE WHEN delta < 0 THEN 0.4::DOUBLE + 0.6::DOUBLE * ((p + q) / (2.0 * q)) ELSE 1 END')} AS weight
      FROM pairs JOIN c USING (grp)""",
)
def direction_weights(t):
    return rounded(models.direction_weights(t.pairs, "delta", 0.6, 1.5, ["grp"]).select("o_orderkey", "weight"))


@query("M5_boosted_absolute")
def boosted_absolute(t):
    _, scored = calibrate.train_and_score(pair_rows(t), PAIR_ROLES, QUICK)
    return evaluate.compare_models(scored.where("role = 'test'"), "truth", {"online": "online", "boosted": "corrected"})


@query("M6_boosted_squared")
def boosted_squared(t):
    _, scored = calibrate.train_and_score(pair_rows(t), PAIR_ROLES, WHOLE, "boosted_squared")
    return evaluate.compare_models(scored.where("role = 'test'"), "truth", {"online": "online", "boosted": "corrected"})


@query("M7_boosted_quantile")
def boosted_quantile(t):
    rows = pair_rows(t)
    model = models.fit_staged(rows.where("role = 'train'"), FEATURES, "delta", "quantile", 0.7, rounds=4, step=0.5, depth=3)
    scored = model.transform(rows.where("role = 'test'"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("delta") <= F.col("predicted_delta")).cast("double")).alias("covered"))


@query("M7_boosted_huber")
def boosted_huber(t):
    rows = pair_rows(t)
    model = models.fit_staged(rows.where("role = 'train'"), FEATURES, "delta", "huber", rounds=3, step=0.5, depth=3)
    scored = model.transform(rows.where("role = 'test'")).withColumn("corrected", F.col("online") + F.col("predicted_delta"))
    return evaluate.compare_models(scored, "truth", {"online": "online", "huber_trees": "corrected"})


def falling(t):
    """Test rows and a model whose delta may only fall with the online reading."""
    rows = pair_rows(t)
    return rows.where("role = 'test'"), models.ResidualCorrection(FEATURES, "delta", QUICK, monotone={"online": -1}).fit(rows.where("role = 'train'"))


@query("M8_monotone_scores")
def monotone_scores(t):
    rows, model = falling(t)
    return model.transform(rows.select("o_orderkey", *FEATURES)).select("o_orderkey", "online", "predicted_delta")


@query("M8_monotone_probe", ROLES + " SELECT count(*) AS n_rows, 40 * count(*) AS n_steps, 0::BIGINT AS n_rises FROM o WHERE role = 'test'")
def monotone_probe(t):
    """Every test row scored at 41 online readings from below the smallest to beyond the largest: not one step up."""
    rows, model = falling(t)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct(i.alias("step"), (F.lit(-20000.0) + i * 15000.0).alias("online"))))
    probe = rows.select("o_orderkey", "qty", "disc", "lines", grid.alias("g")).select("o_orderkey", "qty", "disc", "lines", "g.*")
    curve = model.transform(probe).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("step", "predicted_delta"))).alias("c"))
    steps = F.zip_with(F.slice("c", 1, 40), F.slice("c", 2, 40), lambda a, b: (b["predicted_delta"] > a["predicted_delta"] + 1e-9).cast("long"))
    return curve.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(steps)).cast("long").alias("n_steps"), F.sum(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_rises")
    )


@query(
    "M8_monotone_rearrangement",
    f"""WITH {PAIRS_CTE}, e AS (SELECT min(online) AS lo, max(online) AS hi FROM pairs)
      SELECT o_orderkey, {r('0.5::DOUBLE * (lo + hi - online) + 10 * qty', 4)} AS predicted_delta FROM pairs, e""",
)
def monotone_rearrangement(t):
    """A rising line made to fall: the rearranged curve is its mirror image over the grid."""

    def rising(df):
        return df.withColumn("predicted_delta", 0.5 * F.col("online") + 10 * F.col("qty"))

    out = models.monotone_scores(t.pairs.select("o_orderkey", "online", "qty"), rising, "online", ["o_orderkey"], 8)
    return rounded(out.select("o_orderkey", "predicted_delta"), 4)


@query("M9_direct_model")
def direct_model(t):
    scored = calibrate.train_direct(pair_rows(t), PAIR_ROLES, QUICK)
    return evaluate.compare_models(scored.where("role = 'test'"), "truth", {"online": "online", "direct": "corrected"})


BASE = ROLES + ", base AS (SELECT grp, avg(delta) FILTER (role = 'train') AS m, median(delta) FILTER (role = 'train') AS md FROM o GROUP BY 1), bl AS (SELECT o.*, online + m AS pred_mean, online + md AS pred_median FROM o JOIN base USING (grp))"


def baselines(t):
    return models.delta_baselines(roles(t), "delta", "online", "role", ["grp"])


@query("M10_delta_baselines", BASE + f" SELECT o_orderkey, role, {r('pred_mean', 4)} AS pred_mean, {r('pred_median', 7)} AS pred_median FROM bl")
def delta_baselines(t):
    return rounded(baselines(t).select("o_orderkey", "role", "pred_mean", "pred_median"), 4, pred_median=7)


RIDGE = """WITH {cte}, s AS (SELECT {by} count(*) AS n, avg(delta) AS my, avg(qty) AS m1, avg(disc) AS m2,
  covar_pop(qty, qty) * count(*) + {a} AS a11, covar_pop(qty, disc) * count(*) AS a12, covar_pop(disc, disc) * count(*) + {a} AS a22,
  covar_pop(qty, delta) * count(*) AS b1, covar_pop(disc, delta) * count(*) AS b2 FROM pairs {g}),
  c AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS c1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS c2 FROM s)
  SELECT {by} n, {out} FROM c"""
RIDGE_OUT = rs(3, intercept="my - c1 * m1 - c2 * m2", qty="c1", disc="c2")


def flat(coef, by=()):
    return rounded(coef.select(*by, "n", "intercept", F.col("coef")[0].alias("qty"), F.col("coef")[1].alias("disc")), 3)


@query("M11_ridge", RIDGE.format(cte=PAIRS_CTE, by="", g="", a="1.0", out=RIDGE_OUT))
def ridge(t):
    return flat(models.fit_linear(t.pairs, ["qty", "disc"], "delta", alpha=1.0))


@query("M12_huber")
def huber(t):
    _, scored = calibrate.train_and_score(pair_rows(t), PAIR_ROLES, QUICK, "huber")
    return evaluate.compare_models(scored.where("role = 'test'"), "truth", {"online": "online", "huber": "corrected"})


@query("M13_grouped_linear", RIDGE.format(cte=PAIRS_CTE, by="grp,", g="GROUP BY grp", a="0.0", out=RIDGE_OUT))
def grouped_linear(t):
    return flat(models.fit_linear(t.pairs, ["qty", "disc"], "delta", ["grp"]), ["grp"])


@query("M14_grouped_boosted")
def grouped_boosted(t):
    """A model per order status, all in one fit, one of them with parameters of its own."""
    rows = pair_rows(t)
    settings = t.spark.createDataFrame([("P", 4, 0.2, 0.8)], "o_orderstatus string, max_iter int, learning_rate double, damping double")
    model = models.ResidualCorrection(FEATURES, "delta", QUICK, by=["o_orderstatus"], settings=settings).fit(rows.where("role = 'train'"))
    scored = model.transform(rows.where("role = 'test'")).withColumn("corrected", F.col("online") + F.col("predicted_delta"))
    return evaluate.compare_models(scored, "truth", {"online": "online", "boosted": "corrected"}, ["o_orderstatus"])


STUMP_BINS = 16
STUMPS = f"""WITH {PAIRS_CTE}, x AS (SELECT grp, delta, avg(delta) OVER (PARTITION BY grp) - delta AS g, unnest([0, 1, 2]) AS f, unnest([online, qty, disc]) AS v FROM pairs),
  s AS (SELECT grp, f, list_sort(list(v)) AS l, count(*) AS n FROM x GROUP BY 1, 2),
  e AS (SELECT DISTINCT grp, f, l[ceil(k / {STUMP_BINS}.0::DOUBLE * n)::BIGINT] AS threshold FROM s, range(1, {STUMP_BINS}) AS ks(k)),
  h AS (SELECT grp, f, threshold, sum(g) FILTER (v <= threshold) AS gl, count(*) FILTER (v <= threshold) AS nl, sum(g) FILTER (v > threshold) AS gr, count(*) FILTER (v > threshold) AS nr, sum(g) AS ga, count(*) AS na
    FROM x JOIN e USING (grp, f) GROUP BY ALL),
  gains AS (SELECT *, gl * gl / nl + gr * gr / nr - ga * ga / na AS gain FROM h WHERE nl >= 20 AND nr >= 20),
  best AS (SELECT *, round(gain / max(gain) OVER (PARTITION BY grp), 12) AS rank FROM gains)
  SELECT grp, f AS feature, {r('threshold')} AS threshold, {r('-gl / nl', 3)} AS value_left, {r('-gr / nr', 3)} AS value_right, nl AS n_left, nr AS n_right FROM best
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC, f, threshold) = 1"""


@query("M6_M14_first_level", STUMPS)
def first_level(t):
    """One round of one level for all groups: the split, both leaves and their rows."""
    model = fit_boosted(t.pairs, ["online", "qty", "disc"], "delta", ["grp"], Loss("squared"), ModelParams(learning_rate=1.0, max_iter=1, max_depth=1), bins=STUMP_BINS)
    root, left, right = (F.get("tree", F.lit(k)) for k in range(3))
    return rounded(
        model.trees.select(
            "grp", root["feature"].alias("feature"), root["threshold"].alias("threshold"), left["value"].alias("value_left"), right["value"].alias("value_right"),
            left["cover"].cast("long").alias("n_left"), right["cover"].cast("long").alias("n_right"),
        ), 3, threshold=6,
    )


@query("M15_M16_S9_batch_scoring")
def batch_scoring(t):
    path = scratch(t, "model")
    rows = pair_rows(t)
    feats = calibrate.TrainingRoles("truth", "online", "delta", (*FEATURES, "o_orderpriority_encoded"), ORDER, ("o_orderstatus",))
    calibrate.train_and_save(rows.where("role = 'train'"), feats, QUICK, "o_orderpriority", path, "huber")
    new = rows.where("role = 'test'").drop("truth", "delta")
    out = calibrate.score_batch(new, path, warm_start=True, save_state=True)
    return out.select("o_orderkey", "o_orderstatus", "online", "smoothed_delta", "corrected")


@query(
    "S9_versions",
    """SELECT version::BIGINT AS version, n_states, parts FROM (VALUES (1, (SELECT count(DISTINCT o_orderstatus) FROM orders), 4), (2, (SELECT count(DISTINCT o_orderstatus) FROM orders), 4),
      (3, (SELECT count(DISTINCT o_orderstatus) FROM orders), 4)) AS v(version, n_states, parts)""",
)
def stored_versions(t):
    """Two scored batches after training: three versions, each readable, each with one state row per group."""
    path = scratch(t, "model")
    rows = pair_rows(t)
    feats = calibrate.TrainingRoles("truth", "online", "delta", (*FEATURES, "o_orderpriority_encoded"), ORDER, ("o_orderstatus",))
    calibrate.train_and_save(rows.where("role = 'train'"), feats, ModelParams(max_iter=1, max_depth=2), "o_orderpriority", path, monotone={"online": -1})
    new = rows.where("role = 'test'").drop("truth", "delta")
    for k in range(2):
        calibrate.score_batch(new.where(F.pmod("o_orderkey", F.lit(2)) == k), path, warm_start=True, save_state=True)
    out = None
    for v in sinks.versions(t.spark, path):
        stored = sinks.load_artefact(t.spark, path, v)
        part = stored.state.agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("n_states"), F.lit(len(stored.places)).alias("parts"))
        out = part if out is None else out.unionByName(part)
    return out


@query("M17_soft_sensor")
def soft_sensor(t):
    df = t.lineitem.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), "l_returnflag",
        F.col("l_extendedprice").cast("string").alias("realtime"), F.col("l_quantity").cast("string").alias("tin"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("string").alias("near_lab"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).cast("string").alias("lab"),
    )
    return calibrate.soft_sensor(df, "id", "realtime", "tin", {"near line": "near_lab", "laboratory": "lab"}, "l_returnflag")


# --- evaluation ---------------------------------------------------------------------------------------

MODELS = {"online": "online", "mean": "pred_mean", "median": "pred_median"}
LONG_MODELS = "l AS (" + " UNION ALL ".join(f"SELECT grp, role, truth, online, '{n}' AS model, {c} AS p FROM bl" for n, c in MODELS.items()) + ")"
QUALITY = rs(6, r2="1 - sum(pow(truth - p, 2)) / (var_pop(truth) * count(*))", mape="100 * avg(abs((truth - p) / nullif(truth, 0)))") + ", " + rs(4, rmse="sqrt(avg(pow(truth - p, 2)))", mae="avg(abs(truth - p))")


@query("E1_E2_error_metrics", f"{BASE}, {LONG_MODELS} SELECT grp, model, count(*) AS n, {QUALITY} FROM l WHERE model = 'online' GROUP BY 1, 2")
def error_metrics(t):
    return rounded(evaluate.compare_models(t.pairs, "truth", {"online": "online"}, ["grp"]), 6, rmse=4, mae=4)


@query("E4_model_comparison", f"{BASE}, {LONG_MODELS} SELECT model, count(*) AS n, {QUALITY} FROM l WHERE role = 'test' GROUP BY 1")
def model_comparison(t):
    return rounded(evaluate.compare_models(baselines(t).where("role = 'test'"), "truth", MODELS), 6, rmse=4, mae=4)


BIDIR = f"""bd AS (SELECT grp, model, count(*) FILTER (truth > online) AS n_low, {r('avg(abs(truth - p)) FILTER (truth > online)', 4)} AS mae_low,
  count(*) FILTER (truth < online) AS n_high, {r('avg(abs(truth - p)) FILTER (truth < online)', 4)} AS mae_high FROM l WHERE role = 'test' GROUP BY 1, 2)"""


@query("E5_bidirectional_mae", f"{BASE}, {LONG_MODELS}, {BIDIR} SELECT * FROM bd")
def bidirectional_mae(t):
    return rounded(evaluate.bidirectional_table(baselines(t).where("role = 'test'"), "truth", "online", MODELS, ["grp"]), 4)


@query(
    "E6_improvement_flags",
    f"""{BASE}, {LONG_MODELS}, {BIDIR} SELECT m.grp, m.mae_low < o.mae_low AND m.mae_high < o.mae_high AS both_improved, {r('abs(m.mae_low - m.mae_high)', 4)} AS balance_gap
      FROM bd m JOIN bd o ON o.grp = m.grp AND o.model = 'online' WHERE m.model = 'mean'""",
)
def improvement_flags(t):
    table = rounded(evaluate.bidirectional_table(baselines(t).where("role = 'test'"), "truth", "online", MODELS, ["grp"]), 4)
    side = table.groupBy("grp").agg(
        *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in ("mean", "online") for c in ("mae_low", "mae_high")]
    )
    out = evaluate.improvement_flags(side, "mean_mae_low", "mean_mae_high", "online_mae_low", "online_mae_high")
    return rounded(out.select("grp", "both_improved", "balance_gap"), 4)


def _metric_sql():
    items = {}
    for tag in ("train", "test"):
        for name, p in (("online", "online"), ("model", "pred_mean")):
            w = f"FILTER (role = '{tag}')"
            items[f"r2_{name}_{tag}"] = f"1 - sum(pow(truth - {p}, 2)) {w} / (var_pop(truth) {w} * count(*) {w})"
            items[f"rmse_{name}_{tag}"] = f"sqrt(avg(pow(truth - {p}, 2)) {w})"
            items[f"mae_{name}_{tag}"] = f"avg(abs(truth - {p})) {w}"
    for name, p in (("online", "online"), ("model", "pred_mean")):
        items[f"bias_{name}_test"] = f"avg(truth - {p}) FILTER (role = 'test')"
        for side, s in (("pos", ">"), ("neg", "<")):
            items[f"{side}_mae_{name}_test"] = f"avg(abs(truth - {p})) FILTER (role = 'test' AND truth - {p} {s} 0)"
    inner = ", ".join(f"{e} AS {n}" for n, e in items.items())
    derived = {f"{m}_gain_train": f"{m}_model_train - {m}_online_train" for m in ("r2", "rmse", "mae")}
    derived |= {
        "r2_gain_test": "r2_model_test - r2_online_test", "rmse_gain_pct_test": "(rmse_online_test - rmse_model_test) / rmse_online_test * 100",
        "mae_gain_test": "mae_model_test - mae_online_test", "bias_gain_test": "bias_model_test - bias_online_test",
        "pos_mae_gain_test": "pos_mae_model_test - pos_mae_online_test", "neg_mae_gain_test": "neg_mae_model_test - neg_mae_online_test",
        "overfit_r2": "r2_model_train - r2_model_test", "overfit_mae": "mae_model_train - mae_model_test",
        "overfit_rmse": "rmse_model_train - rmse_model_test", "mae_ratio": "mae_model_test / (mae_model_train + 1e-8)",
        "rmse_ratio": "rmse_model_test / (rmse_model_train + 1e-8)",
    }
    return f"""{BASE}, a AS (SELECT grp, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
      count(*) FILTER (role = 'test' AND truth > online) AS pos_count_test, count(*) FILTER (role = 'test' AND truth < online) AS neg_count_test, {inner} FROM bl GROUP BY 1)
      SELECT grp, n_train, n_test, pos_count_test, neg_count_test, false AS expanding_window, {rs(4, **{n: n for n in items}, **derived)} FROM a"""


@query("E3_E8_full_metric_row", _metric_sql())
def full_metric_row(t):
    return rounded(evaluate.metric_row(baselines(t), "truth", "online", "pred_mean", by=["grp"]), 4)


@query(
    "E7_residual_detail",
    BASE + f""", d AS (SELECT o_orderkey, grp, truth, online, pred_mean AS predicted, truth - online AS raw_residual, truth - pred_mean AS residual FROM bl),
      s AS (SELECT grp, avg(residual) AS m, stddev_samp(residual) AS sd FROM d GROUP BY 1)
      SELECT o_orderkey, grp, {rs(4, predicted='predicted', residual='residual', abs_residual='abs(residual)')}, {rs(6, truth='truth', online='online', raw_residual='raw_residual')},
      abs(residual - m) > 3 * sd AS is_outlier FROM d JOIN s USING (grp)""",
)
def residual_detail(t):
    return rounded(evaluate.residual_detail(baselines(t), ["o_orderkey"], "truth", "online", "pred_mean", ["grp"]), 4, truth=6, online=6, raw_residual=6)


@query(
    "E9_wide_reports",
    f"""{BASE}, {LONG_MODELS.replace('SELECT grp, role', 'SELECT o_orderstatus AS s, grp, role')}, q AS (SELECT s, model, {QUALITY} FROM l WHERE role = 'test' GROUP BY 1, 2)
      SELECT model, """ + ", ".join(f"max({m}) FILTER (s = '{s}') AS \"{s}_{m}\"" for s in "FOP" for m in ("r2", "rmse", "mae")) + " FROM q GROUP BY 1",
)
def wide_reports(t):
    table = evaluate.compare_models(baselines(t).where("role = 'test'"), "truth", MODELS, ["o_orderstatus"])
    return report.models_wide(rounded(table, 6, rmse=4, mae=4), "o_orderstatus", "model", ["r2", "rmse", "mae"], ["F", "O", "P"])


@query(
    "E9_metrics_by_surface",
    f"""WITH {PAIRS_CTE}, m AS (SELECT o_orderstatus AS s, {rs(4, mae='avg(abs(delta))', bias='avg(delta)')} FROM pairs GROUP BY 1)
      SELECT metric, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM (UNPIVOT m ON mae, bias INTO NAME metric VALUE v) GROUP BY 1""",
)
def metrics_by_surface(t):
    m = t.pairs.groupBy("o_orderstatus").agg(rnd(F.avg(F.abs("delta")), 4).alias("mae"), rnd(F.avg("delta"), 4).alias("bias"))
    return report.metrics_by_surface(m, "o_orderstatus", ["F", "O", "P"])


@query(
    "E11_run_comparison",
    f"""WITH {PAIRS_CTE}, a AS (SELECT grp, {r('avg(abs(delta))', 4)} AS mae FROM pairs GROUP BY 1), b AS (SELECT grp, {r('median(abs(delta))', 4)} AS mae FROM pairs WHERE o_orderstatus <> 'P' GROUP BY 1)
      SELECT grp, a.mae AS mae_online, coalesce(b.mae, -1.0::DOUBLE) AS mae_tuned FROM a LEFT JOIN b USING (grp)""",
)
def run_comparison(t):
    from truegauge.operators.quantiles import exact_quantiles

    online = t.pairs.groupBy("grp").agg(rnd(F.avg(F.abs("delta")), 4).cast("string").alias("mae"))
    tuned = exact_quantiles(t.pairs.select("grp", F.abs("delta").alias("e")), "e", {"mae": 0.5}, ["grp"])
    tuned = tuned.withColumn("mae", F.when(F.col("grp").startswith("P"), F.lit(" — ")).otherwise(rnd("mae", 4).cast("string")))
    out = evaluate.compare_runs({"online": online, "tuned": tuned}, ["grp"], ["mae"])
    return out.withColumn("mae_tuned", F.coalesce("mae_tuned", F.lit(-1.0)))


@query("M3_expanding_evaluation")
def expanding_evaluation(t):
    return calibrate.expanding_evaluation(materialise(t.pairs.drop("o_custkey"), "pairs"), PAIR_ROLES, QUICK)


@query("H10_residual_explainability")
def residual_explainability(t):
    return calibrate.explainability(t.pairs.select(*FEATURES, "delta", *ORDER), FEATURES, "delta", ORDER, ModelParams(max_iter=150))


# --- interpretation -------------------------------------------------------------------------------------

LINE = {"online": -0.9, "qty": 1200.0, "disc": -50000.0}


def line(df):
    """A transparent model, so that exact values are known in SQL too."""
    return df.withColumn("predicted_delta", sum((F.lit(w) * F.col(c) for c, w in LINE.items()), F.lit(1000.0)))


@query("I1_permutation_importance")
def permutation_importance(t):
    return interpret.permutation_importance(t.pairs, line, list(LINE), "delta", "o_orderkey", repeats=3)


@query(
    "I2_linear_shapley",
    f"WITH {PAIRS_CTE}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in LINE) + " FROM pairs) "
    + " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS feature, {r(c)} AS x, {r(f'{w}::DOUBLE * ({c} - m_{c})', 4)} AS phi FROM pairs, m" for c, w in LINE.items()),
)
def linear_shapley(t):
    return rounded(interpret.linear_shapley(t.pairs, LINE, "o_orderkey"), 6, phi=4)


def tree_model(t):
    rows = pair_rows(t)
    return rows, models.ResidualCorrection(FEATURES, "delta", QUICK).fit(rows.where("role = 'train'"))


@query("I2_I4_shapley_values")
def shapley_values(t):
    """Value and contribution of every feature in every row, exact for the trees."""
    rows, model = tree_model(t)
    return interpret.tree_shapley(rows, model.pipeline, "o_orderkey")


@query("I2_tree_shapley_sums", f"WITH {PAIRS_CTE} SELECT o_orderkey, 4::BIGINT AS n_features, 0.0::DOUBLE AS gap FROM pairs")
def tree_shapley_sums(t):
    """Contributions add up to the prediction less the mean prediction of the training rows, in every row."""
    rows, model = tree_model(t)
    train = model.transform(rows.where("role = 'train'")).agg(F.avg("predicted_delta").alias("mean"))
    phi = interpret.tree_shapley(rows, model.pipeline, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_features"), F.sum("phi").alias("phi"))
    both = attach(model.transform(rows), train).join(phi, "o_orderkey")
    return both.select("o_orderkey", "n_features", rnd(F.col("predicted_delta") - F.col("mean") - F.col("phi"), 4).alias("gap"))


@query(
    "I3_shapley_ranking",
    f"WITH {PAIRS_CTE}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in LINE) + " FROM pairs) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg(abs({w}::DOUBLE * ({c} - m_{c})))', 4)} AS mean_abs_phi FROM pairs, m" for c, w in LINE.items())
    + ") ORDER BY mean_abs_phi DESC LIMIT 2",
)
def shapley_ranking(t):
    return rounded(interpret.shapley_ranking(interpret.linear_shapley(t.pairs, LINE, "o_orderkey"), 2), 4)


@query(
    "I5_partial_dependence",
    f"""WITH {PAIRS_CTE}, e AS (SELECT quantile_cont(qty, 0.05) AS lo, quantile_cont(qty, 0.95) AS hi FROM pairs),
      g AS (SELECT p::INTEGER AS point, lo + (hi - lo) * p / 19.0::DOUBLE AS value FROM range(20) AS ps(p), e)
      SELECT point, {r('any_value(value)')} AS value, {r('avg(1000 - 0.9::DOUBLE * online + 1200 * value - 50000 * disc)', 4)} AS average FROM g, pairs GROUP BY 1""",
)
def partial_dependence(t):
    return rounded(interpret.partial_dependence(t.pairs, line, "qty", points=20), 6, average=4)


@query(
    "I5_individual_curves",
    f"""WITH {PAIRS_CTE}, e AS (SELECT quantile_cont(qty, 0.05) AS lo, quantile_cont(qty, 0.95) AS hi FROM pairs),
      g AS (SELECT p::INTEGER AS point, lo + (hi - lo) * p / 4.0::DOUBLE AS value FROM range(5) AS ps(p), e)
      SELECT o_orderkey, point, {rs(4, value='value', predicted_delta='1000 - 0.9::DOUBLE * online + 1200 * value - 50000 * disc')} FROM g, pairs""",
)
def individual_curves(t):
    return rounded(interpret.partial_dependence(t.pairs, line, "qty", key="o_orderkey", points=5), 4)


# --- tuning ---------------------------------------------------------------------------------------------


def fit_weighted_mean(train, damping, boost):
    """Weighted mean delta per group: the smallest model the weights act on."""
    weighted = models.direction_weights(train, "delta", damping, boost)
    table = materialise(
        weighted.groupBy("grp").agg((F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("predicted_delta")), "means"
    )
    return lambda df: attach(df, table, ["grp"])


GRID = tuning.parameter_grid(damping=[0.4, 0.8], pos_boost=[1.0, 1.5], alpha_smoothing=[0.8, 1.0])


def grid_results(t):
    rows = pair_rows(t).select("grp", "delta", "truth", "online", *ORDER, "role")
    axes = {k: list(dict.fromkeys(g[k] for g in GRID)) for k in GRID[0]}
    return tuning.evaluate_grid(
        rows.where("role = 'train'"), rows.where("role = 'test'"), fit_weighted_mean, axes["damping"], axes["pos_boost"], axes["alpha_smoothing"],
        "truth", "online", ORDER,
    )


GRID_SQL = ROLES + """, tr AS (SELECT * FROM o WHERE role = 'train'), cn AS (SELECT count(*) FILTER (delta > 0) AS p, count(*) FILTER (delta < 0) AS q FROM tr),
  dm AS (SELECT unnest([0.4, 0.8])::DOUBLE AS damping), bs AS (SELECT unnest([1.0, 1.5])::DOUBLE AS pos_boost), al AS (SELECT unnest([0.8, 1.0])::DOUBLE AS alpha_smoothing),
  w AS (SELECT tr.grp, damping, pos_boost, delta, CASE WHEN delta > 0 THEN 1 - damping + damping * ((p + q) / (2.0 * p)) * pos_boost WHEN delta < 0 THEN 1 - damping + damping * ((p + q) / (2.0 * q)) ELSE 1 END AS w FROM tr, cn, dm, bs),
  mn AS (SELECT grp, damping, pos_boost, sum(w * delta) / sum(w) AS pd FROM w GROUP BY 1, 2, 3),
  te AS (SELECT grp, truth, online, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM o WHERE role = 'test'),
  sc AS (SELECT te.*, damping, pos_boost, pd FROM te JOIN mn USING (grp)),
  sm AS (SELECT a.i, a.damping, a.pos_boost, alpha_smoothing, any_value(a.truth) AS truth, any_value(a.online) AS online,
    sum(b.pd * pow(1 - alpha_smoothing, a.i - b.i)) / sum(pow(1 - alpha_smoothing, a.i - b.i)) AS s
    FROM sc a JOIN sc b ON b.damping = a.damping AND b.pos_boost = a.pos_boost AND b.i BETWEEN a.i - 24 AND a.i, al GROUP BY 1, 2, 3, 4),
  pr AS (SELECT *, online + s AS p FROM sm)"""


def _grid_cols():
    out = []
    for tag, cond in (("total", "true"), ("pos", "truth > online"), ("neg", "truth < online")):
        w = f"FILTER ({cond})"
        out.append(rs(4, **{f"mae_{tag}": f"avg(abs(truth - p)) {w}", f"rmse_{tag}": f"sqrt(avg(pow(truth - p, 2)) {w})", f"r2_{tag}": f"1 - sum(pow(truth - p, 2)) {w} / (var_pop(truth) {w} * count(*) {w})"}))
    return ", ".join(out)


@query(
    "U1_U2_grid_evaluation",
    GRID_SQL + f""" SELECT damping, pos_boost, alpha_smoothing, {_grid_cols()},
      avg(abs(truth - p)) FILTER (truth > online) < avg(abs(truth - online)) FILTER (truth > online) AND avg(abs(truth - p)) FILTER (truth < online) < avg(abs(truth - online)) FILTER (truth < online) AS both_improved,
      {r('abs(avg(abs(truth - p)) FILTER (truth > online) - avg(abs(truth - p)) FILTER (truth < online))', 4)} AS balance_gap FROM pr GROUP BY 1, 2, 3""",
)
def grid_evaluation(t):
    return rounded(grid_results(t), 4)


@query(
    "U6_sensitivity_matrix",
    GRID_SQL + f""", m AS (SELECT damping, pos_boost, alpha_smoothing, {r('avg(abs(truth - p))', 4)} AS mae FROM pr GROUP BY 1, 2, 3)
      SELECT alpha_smoothing, damping, max(mae) FILTER (pos_boost = 1.0) AS "1.0", max(mae) FILTER (pos_boost = 1.5) AS "1.5" FROM m GROUP BY 1, 2""",
)
def sensitivity_matrix(t):
    return tuning.sensitivity_matrix(rounded(grid_results(t), 4), "mae_total", [1.0, 1.5])


#: Trials of the published method over all rows together and over each group, and the rows a group needs.
TRIALS_TOGETHER, TRIALS, LEAST_SAMPLES = 50, 40, 200


def boosted_objective(parts):
    """Test RMSE and worst-direction MAE of one boosted fit on one group's rows, which carry their ordinals (``_i``)."""

    def run(group, surface, params):
        _, scored = calibrate.train_and_score(parts[group], PAIR_ROLES, params, idx="_i")
        m = evaluate.metric_row(scored, "truth", "online", "corrected").first()
        return m["rmse_model_test"], max(m["pos_mae_model_test"] or 0.0, m["neg_mae_model_test"] or 0.0)

    return run


@query("U3_U7_random_search")
def random_search(t):
    """Trials over the whole search space, for all rows together and for every status with enough of them."""
    rows = pair_rows(t)
    counts = rows.where(F.col("o_orderstatus").isNotNull()).groupBy("o_orderstatus").count().where(F.col("count") >= LEAST_SAMPLES)
    groups = sorted(r["o_orderstatus"] for r in counts.collect())
    parts = {"ALL_DATA": rows} | {g: rows.where(F.col("o_orderstatus") == g) for g in groups}
    objective = boosted_objective({g: materialise(with_ordinal(part, ORDER, ["role"], "_i"), "part") for g, part in parts.items()})
    # A trial's fit keeps one core busy.
    at_once = max(4, t.spark.sparkContext.defaultParallelism)
    together = tuning.search(t.spark, [("ALL_DATA", "Top")], objective, tuning.random_candidates(TRIALS_TOGETHER), at_once)
    return together.unionByName(tuning.search(t.spark, [(g, "Top") for g in groups], objective, tuning.random_candidates(TRIALS), at_once))


@query(
    "U4_pareto_front",
    """SELECT p_brand, p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
      AND b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))""",
)
def pareto_front(t):
    return tuning.pareto_front(t.part.select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", ["p_brand"])


TRIAL_SQL = "SELECT o_custkey::VARCHAR AS tag, o_orderkey AS trial, o_totalprice AS worst_mae, round(o_totalprice / 700000, 9) AS damping FROM orders"


@query(
    "U5_best_parameters",
    f"""WITH t AS ({TRIAL_SQL}), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY tag ORDER BY worst_mae, trial) = 1)
      SELECT tag, round(damping, 4) AS damping FROM b UNION ALL SELECT c_custkey::VARCHAR, -1.0::DOUBLE FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT tag FROM b)""",
)
def best_parameters(t):
    trials = t.orders.select(
        F.col("o_custkey").cast("string").alias("tag"), F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("worst_mae"),
        F.round(F.col("o_totalprice") / 700000, 9).alias("damping"),
    )
    old = t.customer.select(F.col("c_custkey").cast("string").alias("tag"), F.lit(-1.0).alias("damping"))
    return tuning.upsert_overrides(old, tuning.best_parameters(trials))


# --- hooks ------------------------------------------------------------------------------------------------


@query("X1_feature_factory", f"WITH {PAIRS_CTE} SELECT o_orderkey, {r('online / (qty + 1e-5)')} AS price_per_unit FROM pairs")
def feature_factory(t):
    def factory(df):
        return df.withColumn("price_per_unit", F.col("online") / (F.col("qty") + F.lit(1e-5)))

    return rounded(t.pairs.transform(factory).select("o_orderkey", "price_per_unit"))


@query("X2_X3_native_label_and_unique", "SELECT 'Top' || l_tax::VARCHAR || '_Bot' || l_discount::VARCHAR AS label, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def native_label_and_unique(t):
    from truegauge.functions.scalar import setpoint_label
    from truegauge.operators.merge import aggregate

    return t.lineitem.groupBy(setpoint_label("l_tax", "l_discount").alias("label")).agg(aggregate("join_unique", "l_returnflag", ()).alias("flags"))


@query("X4_pluggable_model")
def pluggable_model(t):
    from pyspark.ml.regression import LinearRegression

    def custom(params):
        return LinearRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="predicted_delta", regParam=params.damping)

    rows = pair_rows(t)
    model = models.ResidualCorrection(FEATURES, "delta", QUICK, custom).fit(rows.where("role = 'train'"))
    scored = model.transform(rows.where("role = 'test'"))
    return sign_balance(scored.withColumn("residual", F.col("delta") - F.col("predicted_delta")), "residual", ["grp"])


@query(
    "X4_pluggable_closed_form",
    ROLES + """, f AS (SELECT regr_slope(delta, qty) AS b, regr_intercept(delta, qty) AS a FROM o WHERE role = 'train')
      SELECT grp, count(*) AS total, count(*) FILTER (delta > a + b * qty) AS pos, count(*) FILTER (delta < a + b * qty) AS neg FROM o, f WHERE role = 'test' GROUP BY 1""",
)
def pluggable_closed_form(t):
    """A learner handed in from outside, with a fit that SQL knows too."""
    from pyspark.ml.regression import LinearRegression

    def least_squares(params):
        return LinearRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="predicted_delta", tol=1e-12)

    rows = pair_rows(t)
    model = models.ResidualCorrection(["qty"], "delta", ModelParams(), least_squares).fit(rows.where("role = 'train'"))
    scored = model.transform(rows.where("role = 'test'")).withColumn("residual", F.col("delta") - F.col("predicted_delta"))
    return sign_balance(scored, "residual", ["grp"]).select("grp", "total", "pos", "neg")


@query("W4_ewma_no_smoothing", "SELECT event_id, value AS smoothed FROM events")
def ewma_no_smoothing(t):
    return ewma(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"], 1.0).select("event_id", "smoothed")
