"""Feature derivation (P) and quality rules (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.registry import (
    COIL_SPEC, COILS_CTE, DERIVED_CTE, LONG_CTE, PAIRS_CTE, query, r, rnd, rounded, rs, sql_time, text_time,
)
from truegauge.functions import scalar
from truegauge.operators import features, quality
from truegauge.operators.aggregates import sign_balance
from truegauge.spec import CleaningRules

RULES = CleaningRules()


def derived(t, training=False):
    return features.derive(t.coils, COIL_SPEC, training)


@query("P1_row_sum", f"WITH {DERIVED_CTE} SELECT coil_id, {rs(4, top_current_sum='top_current_sum', bot_current_sum='bot_current_sum')} FROM derived")
def row_sum(t):
    return rounded(derived(t).select("coil_id", "top_current_sum", "bot_current_sum"), 4)


@query("P1_row_sum_min_count", f"WITH {COILS_CTE} SELECT coil_id, {r('CASE WHEN i2 IS NOT NULL OR i4 IS NOT NULL OR i6 IS NOT NULL THEN coalesce(i2,0)+coalesce(i4,0)+coalesce(i6,0) END', 4)} AS s FROM coils")
def row_sum_min_count(t):
    return rounded(t.coils.select("coil_id", scalar.row_sum(["i2", "i4", "i6"], min_count=1).alias("s")), 4)


@query(
    "P2_guarded_ratio",
    f"WITH {DERIVED_CTE} SELECT coil_id, {rs(9, top_current_per_speed='top_current_per_speed', top_factor='top_factor', bot_factor='bot_factor')} FROM derived",
)
def guarded_ratio(t):
    return rounded(derived(t).select("coil_id", "top_current_per_speed", "top_factor", "bot_factor"), 9)


@query(
    "P3_epsilon_ratio",
    f"WITH {DERIVED_CTE} SELECT coil_id, {rs(9, top_current_per_speed='top_current_sum / (sp + 1e-5)')} FROM derived",
)
def epsilon_ratio(t):
    return rounded(derived(t, training=True).select("coil_id", "top_current_per_speed"), 9)


@query(
    "P4_P5_delta_and_deviation",
    f"WITH {DERIVED_CTE} SELECT coil_id, {rs(12, top_delta='top_delta', bot_delta='bot_delta', top_deviation='top_deviation', bot_deviation='bot_deviation')} FROM derived",
)
def delta_and_deviation(t):
    return rounded(derived(t).select("coil_id", "top_delta", "bot_delta", "top_deviation", "bot_deviation"), 12)


@query(
    "P6_centred_delta",
    f"WITH {DERIVED_CTE} SELECT coil_id, {rs(6, top='top_delta - (SELECT avg(top_delta) FROM derived)', bot='bot_delta - (SELECT avg(bot_delta) FROM derived)')} FROM derived",
)
def centred_delta(t):
    df = features.centre(derived(t), ["top_delta", "bot_delta"])
    return rounded(df.select("coil_id", F.col("top_delta_centred").alias("top"), F.col("bot_delta_centred").alias("bot")))


FREQ = """freq AS (SELECT grade, count(*) / (SELECT count(grade) FROM coils)::DOUBLE AS f FROM coils WHERE grade IS NOT NULL GROUP BY 1)"""


@query("P7_frequency_encoding", f"WITH {COILS_CTE}, {FREQ} SELECT coil_id, coils.grade, {r('coalesce(f, 0)')} AS grade_encoded FROM coils LEFT JOIN freq USING (grade)")
def frequency_encoding(t):
    coils = t.coils
    out = features.encode_frequency(coils, "grade", features.frequency_table(coils, "grade"), "grade_encoded")
    return rounded(out.select("coil_id", "grade", "grade_encoded"))


@query(
    "P8_stored_frequency_map",
    f"""WITH {COILS_CTE}, freq AS (SELECT grade, count(*) / (SELECT count(grade) FROM coils WHERE top_set = 2.8)::DOUBLE AS f
      FROM coils WHERE grade IS NOT NULL AND top_set = 2.8 GROUP BY 1)
      SELECT coil_id, {r('coalesce(f, 0)')} AS grade_encoded FROM coils LEFT JOIN freq ON coils.grade = freq.grade""",
)
def stored_frequency_map(t):
    from truegauge.session import materialise

    stored = materialise(features.frequency_table(t.coils.where("top_set = 2.8"), "grade"), "frequencies")
    return rounded(features.encode_frequency(t.coils, "grade", stored, "grade_encoded").select("coil_id", "grade_encoded"))


@query(
    "P9_P10_group_labels",
    f"""WITH {COILS_CTE} SELECT 'Top' || top_set::VARCHAR || '_Bot' || bot_set::VARCHAR AS label,
      CASE WHEN top_set IS NULL OR bot_set IS NULL THEN 'Unknown' ELSE 'Top_' || top_set::VARCHAR || '_Bot_' || bot_set::VARCHAR END AS safe_label,
      count(*) AS n FROM coils GROUP BY 1, 2""",
)
def group_labels(t):
    return t.coils.groupBy(
        scalar.setpoint_label("top_set", "bot_set").alias("label"),
        scalar.setpoint_label_or_unknown("top_set", "bot_set").alias("safe_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P11_resolved_delta", f"WITH {PAIRS_CTE} SELECT o_orderkey, {r('truth - online')} AS d1, {r('truth - qty * 1000')} AS d2, delta AS d3 FROM pairs")
def resolved_delta(t):
    p = t.pairs.withColumn("pred", F.col("qty") * 1000.0)
    return p.select(
        "o_orderkey",
        rnd(scalar.resolve_delta(p.columns, None, "truth", "absent", "online")).alias("d1"),
        rnd(scalar.resolve_delta(p.columns, "absent", "truth", "pred", "online")).alias("d2"),
        scalar.resolve_delta(p.columns, "delta", "truth", "pred", "online").alias("d3"),
    )


@query("P12_unit_conversion", f"WITH {COILS_CTE} SELECT coil_id, {r('width / 1000.0', 10)} AS width_m FROM coils")
def unit_conversion(t):
    return rounded(derived(t).select("coil_id", "width_m"), 10)


def long(t):
    return features.surfaces_long(
        derived(t), COIL_SPEC, ["coil_id", "produce_time", "grade", "speed", "setpoint_group"], ["online", "truth", "delta", "deviation"]
    )


@query("P13_surface_unpivot", f"WITH {LONG_CTE} SELECT surface, coil_id, setpoint_group, {rs(12, online='online', truth='truth', delta='delta')} FROM long")
def surface_unpivot(t):
    return rounded(long(t).select("surface", "coil_id", "setpoint_group", "online", "truth", "delta"), 12)


@query("P14_role_inference", f"SELECT 'l_shipdate' AS time_column, 'l_discount' AS discount_column, count(*) AS n, {sql_time('max(l_shipdate)')} AS latest FROM lineitem")
def role_inference(t):
    found = scalar.infer_time_column(t.lineitem, ["Produce Time", "l_comment", "l_shipdate"])
    disc = scalar.infer_by_substring(t.lineitem.columns, "l_", "DISC")
    return t.lineitem.agg(
        F.lit(found).alias("time_column"), F.lit(disc).alias("discount_column"), F.count(F.lit(1)).alias("n"), F.max(found).alias("latest")
    ).withColumn("latest", text_time("latest"))


@query(
    "P15_A13_feature_kinds",
    "SELECT feature, n AS distinct_values, CASE WHEN feature = 'l_returnflag' OR n <= 15 THEN 'categorical' ELSE 'numeric' END AS kind FROM (UNPIVOT (SELECT "
    + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"))
    + " FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE n)",
)
def feature_kinds(t):
    return scalar.infer_feature_kinds(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"])


@query("Q1_required_columns", f"WITH {COILS_CTE} SELECT coil_id, grade FROM coils WHERE top_truth IS NOT NULL AND grade IS NOT NULL")
def required_columns(t):
    return t.coils.na.drop("any", subset=["top_truth", "grade"]).select("coil_id", "grade")


REQUIRED = [
    "top_current_sum", "bot_current_sum", "top_factor", "bot_factor", "speed", "width", "thickness",
    "top_avg", "bot_avg", "top_truth", "bot_truth", "top_delta", "bot_delta",
]
RULE_SQL = {
    "missing required value": "(" + " OR ".join(f"{c} IS NULL" for c in REQUIRED) + ")",
    "speed at or below minimum": "coalesce(speed <= 20, false)",
    "Top gauge dead": "(coalesce(top_min <= 0, false) OR coalesce(top_avg <= 0, false))",
    "Bot gauge dead": "(coalesce(bot_min <= 0, false) OR coalesce(bot_avg <= 0, false))",
    "Top gauge unstable": "(coalesce(top_max - top_min > 0.5::DOUBLE, false) OR coalesce((top_max - top_min) / (top_avg + 1e-5) > 0.4::DOUBLE, false))",
    "Bot gauge unstable": "(coalesce(bot_max - bot_min > 0.5::DOUBLE, false) OR coalesce((bot_max - bot_min) / (bot_avg + 1e-5) > 0.4::DOUBLE, false))",
}
EARLY = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_SQL.items()) + ")"
FLAGGED_CTE = DERIVED_CTE + f""", early AS (SELECT *, {EARLY} AS reason FROM derived),
ok AS (SELECT * FROM early WHERE reason = ''),
med AS (SELECT median(top_delta) AS tm, median(bot_delta) AS bm FROM ok),
lim AS (SELECT tm, bm, 3.0 * 1.4826022185056018 * median(abs(top_delta - tm)) AS tl, 3.0 * 1.4826022185056018 * median(abs(bot_delta - bm)) AS bl FROM ok, med GROUP BY tm, bm),
flagged AS (SELECT * EXCLUDE (reason), CASE WHEN reason <> '' THEN reason ELSE concat_ws('; ',
    CASE WHEN abs(top_delta - tm) > tl THEN 'Top residual outlier' END, CASE WHEN abs(bot_delta - bm) > bl THEN 'Bot residual outlier' END) END AS filter_reason
  FROM early, lim)"""


def flagged(t):
    return quality.flag_rows(derived(t), COIL_SPEC, RULES, REQUIRED, {"Top": "top_delta", "Bot": "bot_delta"})


@query(
    "Q2_to_Q5_row_rules",
    f"WITH {DERIVED_CTE} SELECT coil_id, " + ", ".join(f'{c} AS "{n}"' for n, c in RULE_SQL.items()) + " FROM derived",
)
def row_rules(t):
    rules = quality.row_rules(COIL_SPEC, RULES, REQUIRED)
    return derived(t).select("coil_id", *[c.alias(n) for n, c in rules.items()])


@query("Q6_Q8_flagged_rows", f"WITH {FLAGGED_CTE} SELECT coil_id, filter_reason FROM flagged")
def flagged_rows(t):
    return flagged(t).select("coil_id", "filter_reason")


@query(
    "Q6_mad_limits",
    f"WITH {FLAGGED_CTE} SELECT {rs(6, centre='tm', limit='tl')} FROM lim".replace(" AS limit", ' AS "limit"'),
)
def mad_limits(t):
    ok = derived(t).withColumn("fr", quality.reasons(quality.row_rules(COIL_SPEC, RULES, REQUIRED))).where("fr = ''")
    return rounded(quality.mad_limits(ok, "top_delta", RULES))


@query(
    "Q7_sigma_rule",
    f"""WITH {DERIVED_CTE}, s AS (SELECT avg(top_delta) AS m, stddev_samp(top_delta) AS sd FROM derived WHERE speed IS NOT NULL AND top_factor IS NOT NULL)
      SELECT coil_id, coalesce(speed > 80 AND abs(top_delta - m) > 1.5::DOUBLE * sd, false) AS outlier FROM derived, s""",
)
def sigma_rule(t):
    return quality.sigma_rule(derived(t), "top_delta", "speed", CleaningRules(sigma_factor=1.5), "outlier", ["speed", "top_factor"]).select("coil_id", "outlier")


@query(
    "Q9_cleaning_summary",
    f"""WITH {FLAGGED_CTE} SELECT count(*) AS total, count(*) FILTER (filter_reason <> '') AS rejected,
      {r("100.0 * count(*) FILTER (filter_reason <> '') / count(*)")} AS rejected_pct, count(*) FILTER (filter_reason = '') AS kept FROM flagged""",
)
def cleaning_summary(t):
    return rounded(quality.cleaning_summary(flagged(t)))


@query(
    "Q9_reason_counts",
    f"WITH {FLAGGED_CTE} SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(filter_reason, '; ')) AS reason FROM flagged WHERE filter_reason <> '') GROUP BY 1",
)
def reason_counts(t):
    return quality.reason_counts(flagged(t))


@query(
    "Q10_residual_outliers",
    f"""WITH {PAIRS_CTE}, s AS (SELECT grp, avg(delta) AS m, stddev_samp(delta) AS sd FROM pairs GROUP BY 1)
      SELECT o_orderkey, coalesce(abs(delta - m) > 2.0::DOUBLE * sd, false) AS is_outlier FROM pairs JOIN s USING (grp)""",
)
def residual_outliers(t):
    return quality.residual_outliers(t.pairs, "delta", ["grp"], 2.0).select("o_orderkey", "is_outlier")


@query(
    "Q11_sign_split",
    f"WITH {DERIVED_CTE} SELECT coalesce(top_delta > 0, false) AS low_reading, count(*) AS n, {r('avg(speed)')} AS speed FROM derived GROUP BY 1",
)
def sign_split(t):
    return derived(t).groupBy(quality.holds(F.col("top_delta") > 0).alias("low_reading")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("speed")).alias("speed")
    )


# The gate keeps groups above the mean group size, whatever the data volume.
@query(
    "Q12_E10_group_status",
    f"""WITH {PAIRS_CTE}, g AS (SELECT grp, count(*) AS samples FROM pairs GROUP BY 1)
      SELECT grp, samples, CASE WHEN samples >= 1000 THEN 'modelled' ELSE 'skipped' END AS status FROM g""",
)
def group_status(t):
    return quality.group_status(t.pairs, ["grp"], 1000)


@query(
    "Q12_size_gate",
    f"WITH {PAIRS_CTE} SELECT o_orderkey, grp FROM pairs WHERE grp IN (SELECT grp FROM pairs GROUP BY 1 HAVING count(*) >= 1000)",
)
def size_gate(t):
    return quality.keep_groups(t.pairs, ["grp"], 1000).select("o_orderkey", "grp")


@query("Q13_whitelist", f"WITH {PAIRS_CTE} SELECT grp, count(*) AS n FROM pairs WHERE grp IN ('F_1-URGENT', 'O_5-LOW') GROUP BY 1")
def whitelist(t):
    return t.pairs.where(F.col("grp").isin("F_1-URGENT", "O_5-LOW")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


DIRTY = "CASE event_type WHEN 'error' THEN '—' WHEN 'view' THEN ' / ' WHEN 'login' THEN 'n/a' ELSE value::VARCHAR END"


@query(
    "Q14_Q15_dirty_numbers",
    f"""SELECT event_type, count(*) AS n, count(x) AS numeric, {r('coalesce(sum(x), 0)', 4)} AS total FROM (
      SELECT event_type, try_cast(CASE WHEN trim({DIRTY}) NOT IN ('—','–','-','－','/','nan','NaN','None','') THEN trim({DIRTY}) END AS DOUBLE) AS x FROM events) GROUP BY 1""",
)
def dirty_numbers(t):
    e = t.events.select(
        "event_type",
        F.when(F.col("event_type") == "error", "—").when(F.col("event_type") == "view", " / ").when(F.col("event_type") == "login", "n/a")
        .otherwise(F.col("value").cast("string")).alias("raw"),
    )
    return e.withColumn("x", scalar.number("raw")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("numeric"), rnd(F.coalesce(F.sum("x"), F.lit(0.0)), 4).alias("total")
    )


def _iqr_sql(c):
    return f"SELECT '{c}' AS feature, {c}::DOUBLE AS x FROM derived"


@query(
    "Q16_quality_profile",
    f"WITH {DERIVED_CTE}, l AS (" + " UNION ALL ".join(_iqr_sql(c) for c in ("speed", "top_delta", "i7", "top_factor"))
    + f"""), q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY 1)
      SELECT feature, count(*) AS rows, {r('count(*) FILTER (x IS NULL) / count(*)')} AS missing_rate,
      {r('count(*) FILTER (q3 > q1 AND (x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1))) / count(*)')} AS outlier_rate
      FROM l JOIN q USING (feature) GROUP BY 1""",
)
def quality_profile(t):
    return rounded(quality.missing_and_outlier_rates(derived(t), ["speed", "top_delta", "i7", "top_factor"]))


@query(
    "flagship_group_sign_balance",
    f"""WITH {LONG_CTE.replace('derived AS (', 'derived AS (', 1)}, early AS (SELECT coil_id, {EARLY} AS reason, top_delta, bot_delta FROM derived),
      ok AS (SELECT * FROM early WHERE reason = ''), med AS (SELECT median(top_delta) AS tm, median(bot_delta) AS bm FROM ok),
      lim AS (SELECT tm, bm, 3.0 * 1.4826022185056018 * median(abs(top_delta - tm)) AS tl, 3.0 * 1.4826022185056018 * median(abs(bot_delta - bm)) AS bl FROM ok, med GROUP BY tm, bm),
      good AS (SELECT coil_id FROM ok, lim WHERE NOT abs(top_delta - tm) > tl AND NOT abs(bot_delta - bm) > bl)
      SELECT surface, setpoint_group, count(*) AS total, count(*) FILTER (delta > 0) AS pos, count(*) FILTER (delta < 0) AS neg,
      {r('100.0 * count(*) FILTER (delta > 0) / count(*)')} AS pos_pct, {r('100.0 * count(*) FILTER (delta < 0) / count(*)')} AS neg_pct,
      {r('avg(delta)')} AS mean FROM long WHERE coil_id IN (SELECT coil_id FROM good) GROUP BY 1, 2""",
)
def flagship(t):
    clean = flagged(t).where("filter_reason = ''")
    sides = features.surfaces_long(clean, COIL_SPEC, ["setpoint_group"], ["delta"])
    return rounded(sign_balance(sides, "delta", ["surface", "setpoint_group"]))
