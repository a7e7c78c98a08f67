"""Registered queries over the office table: statistics, profile, classifiers, companies, peers, filters and reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, entities, filters, peers, profile, reports, search, stats
from ..sources.tables import shared_folder
from . import linking
from .context import LEGAL, ROLES, sql

W, U = "average_wage_yen", "daily_user_capacity_ratio"
BAND_ORDER = [x[1] for x in profile.WAGE_BANDS]


def r6(df, *columns):
    """Rounded to the digits in which engines agree on sums of fractions."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _stats(t):
    return r6(stats.numeric_stats(t.office, W, digits=None), "mean", "median", "q1", "q3", "p90", "iqr", "upper_fence", "lower_fence", "upper_extreme", "lower_extreme")


def _min_max(t):
    return r6(stats.numeric_stats_min_max(t.office, W, ("municipality",)), "p10", "mean", "median", "p90")


STAFF = ("average_wage_yen", "dir_key_staff_fte_per_capacity")
ROLE_COLUMNS = {"service manager": ("dir_service_manager_actual", "dir_service_manager_fte"), "life support": ("dir_life_support_actual", "dir_life_support_fte")}
FEATURES = {"transport": "dir_transport_available", "meals": "dir_meal_support_addon"}
_Q4 = "('high wage x high use', 0), ('high wage x low use', 1), ('low wage x high use', 2), ('low wage x low use', 3)"
_FENCE = "greatest(q1 - {} * (q3 - q1), 0)"
_RISK_IN = lambda: (F.col("ratio_to_overall_mean"), F.col(U), F.col("home_use_user_ratio_decimal"), F.col("work_model") == classify.LIGHT, F.col("available_capacity"))
_METRICS = ("average_wage_yen", "average_daily_users", "capacity", U, "home_use_user_ratio_decimal")
_UNPIVOT = " UNION ALL ".join(f"SELECT office_no, municipality, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM e" for m in _METRICS)
_SCORED = "SELECT office_no, round({}, 6) AS score FROM e WHERE {} ORDER BY score DESC NULLS LAST, ordinal LIMIT {}"
_R = "coalesce(ratio_to_municipality_mean, ratio_to_overall_mean)"
_PRESET_SQL = " UNION ALL ".join(f"SELECT '{n}' AS preset, count(*) AS count FROM e WHERE {w}" for n, w in (
    ("all", "true"), ("one city", "municipality = 'NATION_3'"), ("high flag", "wage_outlier_flag = 'high'"), ("high wage, low use", "market_position_quadrant = 'high wage x low use'"),
    ("fix first", "market_position_quadrant = 'low wage x low use' AND shortage_risk"), ("high wage, high use", "market_position_quadrant = 'high wage x high use'"), ("shortage", "shortage_risk"), ("unanswered", "response_status = 'unanswered'")))
_SEARCH = "contains(lower(concat_ws(' ', office_no, municipality, area, corporation_name, representative_name, representative_raw, office_name, corporation_type_label, remarks, dir_primary_activity_type, work_model, dir_office_address_city, dir_office_address_line, dir_office_number, address)), '{}')"
_GROUPED = "SELECT work_model AS label, count(average_wage_yen) AS count, median(average_wage_yen) AS median FROM e GROUP BY 1 HAVING count(average_wage_yen) >= 5 ORDER BY median DESC NULLS LAST, label LIMIT {}"
_TIER = "CASE WHEN w IS NULL THEN NULL " + " ".join(f"WHEN w >= {lo} THEN {{{i}}}" for i, (lo, _) in reversed(list(enumerate(classify.TIERS)))) + " ELSE {0} END"
_tier = lambda values: _TIER.format(*values).replace("w IS", "average_wage_yen IS").replace("WHEN w >=", "WHEN average_wage_yen >=")
_UNIT = _tier([u for _, u in classify.TIERS])
_NUMBER = _tier(range(1, 10))
_POINT = f"floor(capacity * CAST(0.01 AS DOUBLE) * ({_UNIT}) * 22 + 0.5)"



def _searched(t, *queries):
    out = [t.full.filter(filters.search_text(q, filters.searched(t.full))).select(F.lit(q.strip().lower()).alias("query"), "office_no") for q in queries]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


SEARCHES = ("GROUP 12 ", " note 1", "Ward3 Street", "d77", "p", "no such office")


def _indexed(t):
    """The same by an index of three-character pieces."""
    path = f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}"
    search.write_index(t.full, "office_no", path)
    every = [search.search_indexed(t.full, "office_no", path, q).select(F.lit(q.strip().lower()).alias("query"), "office_no") for q in SEARCHES]
    return reduce(lambda a, b: a.unionByName(b), every)


def _export(t):
    links = linking._linked(t).select("ordinal", "homepage_url", "profile_url")
    every = r6(t.full.join(links, "ordinal"), "ratio_to_overall_mean", "ratio_to_municipality_mean", "ratio_to_capacity_band_mean", U, "home_use_user_ratio_pct")
    return reports.export_filtered_table(filters.filter_records(every, {"flag": "high"}), every, "area", "primary_activity_type", "company_key")


_URL_OF = "'https://search.example.com/?q=' || url_encode('\"' || office_name || '\" ' || fl.area{})"

QUERIES = {
    # distribution statistics
    "numeric_stats": (_stats, sql("SELECT n AS count, m AS mean, med AS median, q1, q3, (SELECT round(quantile_cont(average_wage_yen, 0.9), 6) FROM office) AS p90, q3 - q1 AS iqr, q3 + 1.5 * (q3 - q1) AS upper_fence, " + f"CAST({_FENCE.format(1.5)} AS DOUBLE) AS lower_fence, q3 + 3.0 * (q3 - q1) AS upper_extreme, CAST({_FENCE.format(3.0)} AS DOUBLE) AS lower_extreme FROM s", "s").replace("m AS mean", "round(m, 6) AS mean")),
    "numeric_stats_min_max": (_min_max, sql("SELECT municipality, count(average_wage_yen) AS count, min(average_wage_yen) AS min, round(quantile_cont(average_wage_yen, 0.1), 6) AS p10, round(avg(average_wage_yen), 6) AS mean, median(average_wage_yen) AS median, round(quantile_cont(average_wage_yen, 0.9), 6) AS p90, max(average_wage_yen) AS max FROM office GROUP BY 1", "office")),
    "stddev_sample": (lambda t: r6(stats.stddev_sample(t.office, W, ("corporation_type_label",)), "stddev"), sql("SELECT corporation_type_label, count(average_wage_yen) AS count, round(stddev_samp(average_wage_yen), 6) AS stddev FROM office GROUP BY 1", "office")),
    "outlier_flags": (lambda t: stats.outlier_flags(t.office, W).select("office_no", W, "outlier_flag", "outlier_severity"), sql("SELECT office_no, average_wage_yen, wage_outlier_flag AS outlier_flag, wage_outlier_severity AS outlier_severity FROM e", "e")),
    "quadrant_vs_median": (lambda t: stats.quadrant_vs_median(t.office, W, "average_daily_users").select("office_no", "quadrant"), sql("SELECT office_no, CASE WHEN average_wage_yen IS NULL OR average_daily_users IS NULL THEN NULL ELSE (CASE WHEN average_wage_yen >= med THEN 'high' ELSE 'low' END) || ' x ' || (CASE WHEN average_daily_users >= (SELECT median(average_daily_users) FROM office) THEN 'high' ELSE 'low' END) END AS quadrant FROM office, s", "s")),
    "outlier_watchlist": (lambda t: stats.outlier_watchlist(stats.outlier_flags(t.office, W), W).select("office_no", W, "outlier_flag", "outlier_severity"), sql("SELECT office_no, average_wage_yen, wage_outlier_flag AS outlier_flag, wage_outlier_severity AS outlier_severity FROM e WHERE wage_outlier_flag IS NOT NULL ORDER BY wage_outlier_flag <> 'high', average_wage_yen DESC, ordinal LIMIT 24", "e")),
    "quadrant_counts_zero_filled": (lambda t: stats.zero_filled_counts(t.e, "market_position_quadrant", (*profile.MARKET_QUADRANTS, "no such")), sql(f"SELECT CAST(p AS INT) AS position, l AS label, (SELECT count(*) FROM e WHERE market_position_quadrant = l) AS count FROM (VALUES {_Q4}, ('no such', 4)) v(l, p)", "e")),
    "role_summary": (lambda t: r6(stats.role_summary(t.merged, ROLE_COLUMNS), "average_actual", "average_fte"), sql(" UNION ALL ".join(f"SELECT '{r}' AS role, count({c}_fte) AS office_count, round(avg({c}_actual), 6) AS average_actual, round(avg({c}_fte), 6) AS average_fte, count(*) FILTER ({c}_fte > 0) AS nonzero_office_count FROM merged" for r, c in (("service manager", "service_manager"), ("life support", "life_support"))), "merged")),
    "feature_effects": (lambda t: r6(stats.feature_effects(t.merged, FEATURES, *STAFF), "true_average_wage", "false_average_wage", "true_average_staffing"), sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER ({c}) AS true_count, count(*) FILTER (NOT {c}) AS false_count, round(avg(average_wage_yen) FILTER ({c}), 6) AS true_average_wage, round(avg(average_wage_yen) FILTER (NOT {c}), 6) AS false_average_wage, round(avg(k) FILTER ({c}), 6) AS true_average_staffing FROM merged" for f, c in (("transport", "transport_available"), ("meals", "meal_support_addon"))), "merged")),
    "staffing_watchlists": (lambda t: stats.staffing_watchlists(t.staffed.filter("dir_match_status = 'matched'"), "staffing_quadrant", *STAFF).select("list", "place", "office_no"), sql("""SELECT * FROM (SELECT 'lean_high_wage' AS list, CAST(row_number() OVER (ORDER BY coalesce(average_wage_yen, 0) DESC, CASE WHEN coalesce(k, 0) = 0 THEN 999 ELSE k END, ordinal) AS INT) AS place, office_no FROM staffed WHERE status = 'matched' AND quadrant = 'high wage x thin staff'
UNION ALL SELECT 'heavy_low_wage', CAST(row_number() OVER (ORDER BY CASE WHEN coalesce(average_wage_yen, 0) = 0 THEN 999999 ELSE average_wage_yen END, coalesce(k, 0) DESC, ordinal) AS INT), office_no FROM staffed WHERE status = 'matched' AND quadrant = 'low wage x ample staff') x WHERE place <= 12""", "staffed")),
    "staffing_report": (lambda t: t.staffed.select("office_no", "staffing_outlier_flag", "staffing_outlier_severity", "staffing_quadrant"), sql("SELECT office_no, flag AS staffing_outlier_flag, severity AS staffing_outlier_severity, quadrant AS staffing_quadrant FROM staffed", "staffed")),
    # derived columns and profile
    "column_missing_counts": (lambda t: profile.column_missing_counts(t.office.select(W, "corporation_number", "primary_activity_type", "home_use_user_ratio_decimal", "office_no")), sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM office" for c in (W, "corporation_number", "primary_activity_type", "home_use_user_ratio_decimal", "office_no")), "office")),
    "dataset_overview": (lambda t: profile.dataset_overview(t.e, "office_no", "response_status", "corporation_type_label", "municipality", "home_use_active", "wage_outlier_flag"), sql("""SELECT 'total' AS block, l AS label, v AS value FROM (SELECT count(*) AS n, count(DISTINCT municipality) AS a, count(office_no) - count(DISTINCT office_no) AS d, count(*) FILTER (home_use_active) AS h, count(*) FILTER (wage_outlier_flag = 'high') AS hi, count(*) FILTER (wage_outlier_flag = 'low') AS lo FROM e) x,
LATERAL (VALUES ('rows', n), ('areas', a), ('duplicate_keys', d), ('with_feature', h), ('high', hi), ('low', lo)) y(l, v)
UNION ALL SELECT 'status', coalesce(response_status, 'unknown'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'type', coalesce(corporation_type_label, 'unknown'), count(*) FROM e GROUP BY 2""", "e")),
    "reference_means": (lambda t: r6(t.e.select("office_no", "ratio_to_overall_mean", "ratio_to_municipality_mean", "ratio_to_type_mean", "ratio_to_capacity_band_mean", "difference_to_overall_mean"), "ratio_to_overall_mean", "ratio_to_municipality_mean", "ratio_to_type_mean", "ratio_to_capacity_band_mean", "difference_to_overall_mean"), sql("SELECT office_no, round(ratio_to_overall_mean, 6) AS ratio_to_overall_mean, round(ratio_to_municipality_mean, 6) AS ratio_to_municipality_mean, round(ratio_to_type_mean, 6) AS ratio_to_type_mean, round(ratio_to_capacity_band_mean, 6) AS ratio_to_capacity_band_mean, round(difference_to_overall_mean, 6) AS difference_to_overall_mean FROM e", "e")),
    "zscore_percentile": (lambda t: r6(profile.zscore_percentile(t.office, W), "z_score", "percentile").select("office_no", "z_score", "percentile"), sql("SELECT office_no, round(z_score, 6) AS z_score, CASE WHEN average_wage_yen IS NOT NULL THEN round((rank() OVER (PARTITION BY average_wage_yen IS NULL ORDER BY average_wage_yen) - 1) / (SELECT n::DOUBLE FROM s), 6) END AS percentile FROM e", "e")),
    "bands": (lambda t: profile.bands(profile.utilisation_columns(t.office)).select("office_no", "wage_band_label", "capacity_band_label", "utilisation_band_label"), sql("SELECT office_no, wage_band_label, capacity_band_label, CASE WHEN daily_user_capacity_ratio IS NULL THEN NULL WHEN daily_user_capacity_ratio < 0.6 THEN 'under 60%' WHEN daily_user_capacity_ratio < 0.8 THEN '60-80%' WHEN daily_user_capacity_ratio < 1 THEN '80-100%' ELSE '100% and more' END AS utilisation_band_label FROM e", "e")),
    "market_quadrant": (lambda t: profile.market_quadrant(profile.utilisation_columns(t.office)).select("office_no", "market_position_quadrant"), sql("SELECT office_no, market_position_quadrant FROM e", "e")),
    "utilisation_columns": (lambda t: profile.utilisation_columns(t.office).select("office_no", U, "wage_per_daily_user", "wage_per_capacity"), sql("SELECT office_no, average_daily_users / capacity AS daily_user_capacity_ratio, CASE WHEN average_daily_users > 0 THEN average_wage_yen / average_daily_users END AS wage_per_daily_user, average_wage_yen / capacity AS wage_per_capacity FROM office", "office")),
    # classifiers
    "work_model_label": (lambda t: t.office.select("office_no", classify.work_model_label(F.col("primary_activity_type"), rules=classify.TEST_WORK_MODELS, other="other", none="none").alias("work_model")), sql("SELECT office_no, work_model FROM e", "e")),
    "area_label": (lambda t: t.directory.select("office_number", classify.area_label(F.col("office_address_city"), F.col("office_address_line"), F.lit("unknown"), "(ward[0-9]+)", "^NATION_", "3 city", "3 city (no ward)").alias("area")), sql("SELECT office_number, coalesce(nullif(regexp_extract(coalesce(office_address_city, '') || coalesce(office_address_line, ''), '(ward[0-9]+)', 1), ''), CASE WHEN office_address_city = 'NATION_3 city' THEN '3 city (no ward)' ELSE regexp_replace(office_address_city, '^NATION_', '') END, 'unknown') AS area FROM directory", "directory")),
    "available_capacity": (lambda t: t.office.select("office_no", classify.available_capacity(F.col("capacity"), F.lit(1.0), F.col("average_daily_users")).alias("available_capacity")), sql("SELECT office_no, available_capacity FROM e", "e")),
    "shortage_risk": (lambda t: t.e.select("office_no", classify.shortage_risk(*_RISK_IN()).alias("shortage_risk")), sql("SELECT office_no, shortage_risk FROM e", "e")),
    "shortage_signals": (lambda t: classify.signal_counts(t.e, "signals"), sql("SELECT signal, count(*) AS count FROM (SELECT unnest(list_filter([CASE WHEN lo THEN 'low wage' END, CASE WHEN thin THEN 'low use' END, CASE WHEN hh THEN 'high home use' END, CASE WHEN lite THEN 'light work' END, CASE WHEN many THEN 'many free places' END], lambda x: x IS NOT NULL)) AS signal FROM e) GROUP BY 1", "e")),
    "price_tier": (lambda t: t.office.select("office_no", *[c.alias(n) for c, n in zip(classify.price_tier(F.col(W)), ("tier", "unit"), strict=True)]), sql(f"SELECT office_no, CAST({_NUMBER} AS INT) AS tier, CAST({_UNIT} AS INT) AS unit FROM office", "office")),
    "revenue_per_point": (lambda t: t.office.select("office_no", classify.revenue_per_point(F.col("capacity"), F.col(W)).alias("revenue")), sql(f"SELECT office_no, CAST({_POINT} AS BIGINT) AS revenue FROM office", "office")),
    "action_notes": (lambda t: t.e.select("office_no", F.array_join(classify.action_notes(F.col(U), F.col("shortage_risk"), F.col("wage_outlier_flag"), F.col("is_new_office")), "|").alias("notes"), F.array_join(classify.badges(F.col("wage_outlier_flag"), F.col("response_status"), F.col("is_new_office"), F.col("shortage_risk")), "|").alias("badges")), sql("SELECT office_no, coalesce(nullif(concat_ws('|', CASE WHEN daily_user_capacity_ratio < 0.6 THEN 'raise use' END, CASE WHEN shortage_risk THEN 'find work' END, CASE WHEN wage_outlier_flag = 'high' THEN 'share practice' END, CASE WHEN is_new_office THEN 'follow start' END), ''), 'observe') AS notes, coalesce(nullif(concat_ws('|', 'wage ' || wage_outlier_flag, CASE WHEN response_status <> 'answered' THEN response_status END, CASE WHEN is_new_office THEN 'new' END, CASE WHEN shortage_risk THEN 'shortage' END), ''), 'normal') AS badges FROM e", "e")),
    "label_values": (lambda t: classify.label_values(t.office, "response_status", {"answered": "has answered", "annotated": "with notes"}, "status_label").select("office_no", "status_label"), sql("SELECT office_no, CASE response_status WHEN 'answered' THEN 'has answered' WHEN 'annotated' THEN 'with notes' ELSE response_status END AS status_label FROM office", "office")),
    # companies and representatives
    "company_identity": (lambda t: t.e.select("office_no", "company_key"), sql("SELECT office_no, company_key FROM c", "c")),
    "company_label": (lambda t: entities.company_label(t.e, "company_key", "corporation_name", F.col("corporation_name").startswith("group "), "corporation_number"), sql("SELECT company_key, corporation_name AS label FROM c WHERE corporation_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY 100 * (starts_with(corporation_name, 'group '))::INT + 20 * (corporation_number IS NOT NULL)::INT + length(corporation_name) DESC, corporation_name DESC) = 1", "c")),
    "company_profile": (lambda t: r6(entities.company_profile(t.e, "company_key", "municipality", W, U, "corporation_type_label"), "mean_wage", "mean_use"), sql("""SELECT a.*, main_type FROM (SELECT company_key, count(*) AS office_count, count(DISTINCT municipality) AS area_count, round(avg(average_wage_yen), 6) AS mean_wage, round(avg(daily_user_capacity_ratio), 6) AS mean_use, CASE WHEN count(average_wage_yen) >= 2 THEN max(average_wage_yen) - min(average_wage_yen) END AS wage_spread FROM c GROUP BY 1) a
JOIN (SELECT company_key, corporation_type_label AS main_type FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, corporation_type_label) = 1) k USING (company_key)""", "c")),
    "company_scale_buckets": (lambda t: entities.company_scale_buckets(t.e, "company_key"), sql("SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4 and more' END AS bucket, count(*) AS companies FROM (SELECT count(*) AS n FROM c GROUP BY company_key) x GROUP BY 1", "c")),
    "company_visible_offices": (lambda t: entities.company_visible_offices(t.e, "company_key", F.coalesce(F.col("wage_outlier_flag") == "high", F.lit(False)), F.col("municipality") == "NATION_3"), sql("SELECT company_key, count(*) AS office_count, count(*) FILTER (wage_outlier_flag = 'high') AS visible_count, count(*) FILTER (municipality = 'NATION_3') AS focus_count FROM c GROUP BY 1", "c")),
    "company_office_sort": (lambda t: t.e.filter(F.col("company_key") == "number:N12").orderBy(*entities.company_office_sort(t.e, W)).select("office_no", W, "municipality"), sql("SELECT office_no, average_wage_yen, municipality FROM c WHERE company_key = 'number:N12' ORDER BY average_wage_yen DESC NULLS LAST, municipality, office_name, office_no", "c")),
    "company_office_sort_all": (lambda t: t.e.select("company_key", "office_no", W, "municipality", F.row_number().over(Window.partitionBy("company_key").orderBy(*entities.company_office_sort(t.e, W))).alias("position")), sql("SELECT company_key, office_no, average_wage_yen, municipality, CAST(row_number() OVER (PARTITION BY company_key ORDER BY average_wage_yen DESC NULLS LAST, municipality, office_name, office_no) AS INT) AS position FROM c", "c")),
    "representative_groups": (lambda t: r6(entities.representative_groups(t.e, "rep_key", "company_key", W, 2), "mean_wage"), sql("SELECT rep_key, count(DISTINCT company_key) AS company_count, count(*) AS office_count, count(DISTINCT municipality) AS area_count, round(avg(average_wage_yen), 6) AS mean_wage FROM c GROUP BY 1 HAVING count(DISTINCT company_key) >= 2", "c")),
    "representative_companies": (lambda t: r6(entities.representative_companies(t.e, "rep_key", "company_key", W, "corporation_name", F.col("corporation_name").startswith("group "), "corporation_number", "representative_raw"), "mean_wage"), sql("""SELECT rep_key, company_key, office_count, round(mean_wage, 6) AS mean_wage, company_name, company_number, representative_name, CAST(row_number() OVER (PARTITION BY rep_key ORDER BY office_count DESC, mean_wage DESC NULLS LAST, company_name, company_key) AS INT) AS place FROM
(SELECT rep_key, company_key, count(*) AS office_count, avg(average_wage_yen) AS mean_wage FROM c GROUP BY 1, 2) g JOIN (SELECT rep_key, company_key, corporation_name AS company_name, corporation_number AS company_number, representative_raw AS representative_name FROM c
QUALIFY row_number() OVER (PARTITION BY rep_key, company_key ORDER BY 100 * starts_with(corporation_name, 'group ')::INT + 20 * (corporation_number IS NOT NULL)::INT + length(corporation_name) DESC, corporation_name DESC, corporation_number DESC NULLS LAST, representative_raw DESC) = 1) p USING (rep_key, company_key)""", "c")),
    # peers
    "peer_rank": (lambda t: r6(peers.peer_ranks(t.e, {"act": "primary_activity_type", "cap": "capacity_band_label"}, W), "act_median", "act_mean", "cap_median", "cap_mean").select("office_no", *[f"{p}_{x}" for p in ("act", "cap") for x in ("count", "rank", "median", "mean")]), sql("SELECT office_no, " + ", ".join(f"CASE WHEN count(average_wage_yen) OVER {w} >= 3 AND {g} IS NOT NULL THEN {x} END AS {p}_{n}" for p, g in (("act", "primary_activity_type"), ("cap", "capacity_band_label")) for w in (f"(PARTITION BY {g})",) for n, x in (("count", f"count(average_wage_yen) OVER {w}"), ("rank", f"CASE WHEN average_wage_yen IS NOT NULL THEN rank() OVER (PARTITION BY {g} ORDER BY average_wage_yen DESC NULLS LAST) END"), ("median", f"median(average_wage_yen) OVER {w}"), ("mean", f"round(avg(average_wage_yen) OVER {w}, 6)"))) + " FROM e", "e")),
    "percentile_rank_strict": (lambda t: peers.percentile_rank_strict(t.office, W).select("office_no", "percentile_rank"), sql("SELECT office_no, CASE WHEN average_wage_yen IS NOT NULL THEN CAST(floor(CAST(100 AS DOUBLE) * (rank() OVER (PARTITION BY average_wage_yen IS NULL ORDER BY average_wage_yen) - 1) / (SELECT n FROM s) + 0.5) AS BIGINT) END AS percentile_rank FROM office", "s")),
    "competition_profile": (lambda t: r6(peers.competition_profile(t.e, "area", "primary_activity_type", W, U), "area_mean_use").select("office_no", "area_count", "same_activity_count", "area_median_wage", "area_mean_use", "area_rank", "area_count_median"), sql("""SELECT office_no, area_count, same_activity_count, area_median_wage, area_mean_use, area_rank, (SELECT median(n) FROM (SELECT count(*) AS n FROM e GROUP BY area) x) AS area_count_median
FROM (SELECT office_no, area, primary_activity_type, count(*) OVER (PARTITION BY area, primary_activity_type) AS same_activity_count FROM e) o JOIN (SELECT area, count(*) AS area_count, median(average_wage_yen) AS area_median_wage, round(avg(daily_user_capacity_ratio), 6) AS area_mean_use, CAST(row_number() OVER (ORDER BY count(*) DESC, min(ordinal)) AS INT) AS area_rank FROM e GROUP BY 1) a USING (area)""", "e")),
    "capacity_profile": (lambda t: r6(peers.capacity_profile(t.e, "capacity_band_label", "municipality", "average_daily_users", U, 20), "peer_median_use").select("office_no", "peer_scope", "peer_count", "peer_median_users", "peer_median_use"), sql("""SELECT office_no, CASE WHEN ln >= 20 THEN 'local' ELSE 'all' END AS peer_scope, CASE WHEN ln >= 20 THEN ln ELSE en END AS peer_count, CASE WHEN ln >= 20 THEN lu ELSE eu END AS peer_median_users, round(CASE WHEN ln >= 20 THEN lr ELSE er END, 6) AS peer_median_use FROM (
SELECT office_no, count(*) OVER l AS ln, count(*) OVER g AS en, median(average_daily_users) OVER l AS lu, median(average_daily_users) OVER g AS eu, median(daily_user_capacity_ratio) OVER l AS lr, median(daily_user_capacity_ratio) OVER g AS er FROM e WINDOW l AS (PARTITION BY capacity_band_label, municipality), g AS (PARTITION BY capacity_band_label)) x""", "e")),
    "activity_profile": (lambda t: r6(peers.activity_profile(t.e, "primary_activity_type", W, U), "activity_mean_use").select("office_no", "activity_count", "activity_median_wage", "activity_mean_use", "activity_rank"), sql("SELECT office_no, CASE WHEN t THEN count(*) OVER w END AS activity_count, CASE WHEN t THEN median(average_wage_yen) OVER w END AS activity_median_wage, CASE WHEN t THEN round(avg(daily_user_capacity_ratio) OVER w, 6) END AS activity_mean_use, CASE WHEN t AND average_wage_yen IS NOT NULL THEN rank() OVER (PARTITION BY primary_activity_type ORDER BY average_wage_yen DESC NULLS LAST) END AS activity_rank FROM (SELECT *, primary_activity_type IS NOT NULL AS t FROM e) x WINDOW w AS (PARTITION BY primary_activity_type)", "e")),
    "home_use_profile": (lambda t: r6(peers.home_use_profile(t.e, "home_use_active", W, U), "home_mean_wage", "other_mean_wage", "home_mean_use", "other_mean_use", "top_wage_home_share"), sql("SELECT round(avg(average_wage_yen) FILTER (home_use_active), 6) AS home_mean_wage, round(avg(average_wage_yen) FILTER (NOT home_use_active), 6) AS other_mean_wage, round(avg(daily_user_capacity_ratio) FILTER (home_use_active), 6) AS home_mean_use, round(avg(daily_user_capacity_ratio) FILTER (NOT home_use_active), 6) AS other_mean_use, round(avg(home_use_active::INT) FILTER (average_wage_yen >= (SELECT quantile_cont(average_wage_yen, 0.8) FROM e)), 6) AS top_wage_home_share FROM e", "e")),
    "metric_comparison": (lambda t: r6(peers.metric_comparison(t.e, "office_no", _METRICS, F.col("municipality") == "NATION_3"), "value", "mean_difference", "mean_ratio", "median_difference", "median_ratio"), sql(f"""SELECT office_no, v.metric, round(value, 6) AS value, round(value - m, 6) AS mean_difference, round(CASE WHEN m <> 0 THEN value / m END, 6) AS mean_ratio, round(value - d, 6) AS median_difference, round(CASE WHEN d <> 0 THEN value / d END, 6) AS median_ratio FROM (SELECT v.*, CASE WHEN v.municipality = 'NATION_3' THEN im ELSE am END AS m, CASE WHEN v.municipality = 'NATION_3' THEN idn ELSE ad END AS d FROM v JOIN
(SELECT metric, avg(value) AS am, median(value) AS ad, avg(value) FILTER (municipality = 'NATION_3') AS im, median(value) FILTER (municipality = 'NATION_3') AS idn FROM v GROUP BY 1) g USING (metric)) v""", "e").replace("\nSELECT office_no, v.metric", f",\nv AS ({_UNPIVOT})\nSELECT office_no, v.metric", 1)),
    # filters
    "filter_records": (lambda t: filters.filter_records(t.e, {"capacity_band": "11-20", "flag": "none", "risk": "none", "home_use": False, "response_status": "answered"}).select("office_no"), sql("SELECT office_no FROM e WHERE capacity_band_label = '11-20' AND coalesce(wage_outlier_flag, 'none') = 'none' AND NOT shortage_risk AND NOT home_use_active AND response_status = 'answered'", "e")),
    "search_text": (lambda t: _searched(t, "GROUP 12 ", " note 1", "Ward3 Street", "d77").select("query", "office_no"), sql(" UNION ALL ".join(f"SELECT '{q}' AS query, office_no FROM fl WHERE {_SEARCH.format(q)}" for q in ("group 12", "note 1", "ward3 street", "d77")), "full")),
    "search_indexed": (_indexed, sql(" UNION ALL ".join(f"SELECT '{q}' AS query, office_no FROM fl WHERE {_SEARCH.format(q)}" for q in (x.strip().lower() for x in SEARCHES)), "full")),
    "filter_presets": (lambda t: filters.preset_counts(t.e), sql(_PRESET_SQL, "e")),
    "sort_records": (lambda t: filters.page_rows(t.e, filters.sort_keys(t.e, "wage_outlier_flag", True), 1).select("office_no", "wage_outlier_flag"), sql("SELECT office_no, wage_outlier_flag FROM e ORDER BY CASE wage_outlier_flag WHEN 'high' THEN 3 WHEN 'low' THEN 2 END DESC NULLS LAST, ordinal LIMIT 50", "e")),
    "page_rows": (lambda t: filters.page_rows(t.e, filters.sort_keys(t.e, W), 3).select("office_no", W), sql("SELECT office_no, average_wage_yen FROM e ORDER BY average_wage_yen NULLS LAST, ordinal LIMIT 50 OFFSET 100", "e")),
    "distinct_values": (lambda t: filters.distinct_values(t.e, "primary_activity_type"), sql("SELECT DISTINCT primary_activity_type AS value FROM e WHERE primary_activity_type IS NOT NULL", "e")),
    # series and lists
    "top_counts": (lambda t: reports.top_counts(t.e, "municipality", 10), sql("SELECT municipality AS label, count(*) AS count FROM e GROUP BY 1 ORDER BY count(*) DESC, min(ordinal) LIMIT 10", "e")),
    "top_group_mean": (lambda t: r6(reports.top_group_mean(t.e, "municipality"), "mean"), sql("SELECT municipality AS label, count(average_wage_yen) AS count, round(avg(average_wage_yen), 6) AS mean FROM e GROUP BY 1 HAVING count(average_wage_yen) >= 5 ORDER BY avg(average_wage_yen) DESC, label LIMIT 8", "e")),
    "group_stats": (lambda t: r6(reports.group_stats(t.e, "work_model", least=5), "mean"), sql("SELECT work_model AS label, count(average_wage_yen) AS count, round(avg(average_wage_yen), 6) AS mean, median(average_wage_yen) AS median, min(average_wage_yen) AS min, max(average_wage_yen) AS max FROM e GROUP BY 1 HAVING count(average_wage_yen) >= 5", "e")),
    "ordered_counts": (lambda t: reports.ordered_counts(t.e, "wage_band_label", BAND_ORDER), sql("SELECT CAST(list_position(" + str(BAND_ORDER) + ", wage_band_label) - 1 AS INT) AS position, wage_band_label AS label, count(*) AS count FROM e WHERE wage_band_label IS NOT NULL GROUP BY 2", "e")),
    "ordered_group_mean": (lambda t: r6(reports.ordered_group_mean(t.e, "wage_band_label", BAND_ORDER), "mean"), sql("SELECT CAST(list_position(" + str(BAND_ORDER) + ", wage_band_label) - 1 AS INT) AS position, wage_band_label AS label, round(avg(daily_user_capacity_ratio), 6) AS mean FROM e WHERE wage_band_label IS NOT NULL GROUP BY 2 HAVING avg(daily_user_capacity_ratio) IS NOT NULL", "e")),
    "outlier_breakdown": (lambda t: reports.outlier_breakdown(t.e), sql("SELECT wage_outlier_flag AS label, count(*) AS count FROM e WHERE wage_outlier_flag IS NOT NULL GROUP BY 1", "e")),
    "two_group_means": (lambda t: r6(reports.two_group_means(t.e, "home_use_active"), "mean"), sql('SELECT home_use_active AS "group", round(avg(average_wage_yen), 6) AS mean FROM e GROUP BY 1', "e")),
    "scatter_points": (lambda t: r6(reports.scatter_points(t.e, "office_no", U, W), "px", "py"), sql("SELECT office_no, round((daily_user_capacity_ratio - min(daily_user_capacity_ratio) OVER ()) / (max(daily_user_capacity_ratio) OVER () - min(daily_user_capacity_ratio) OVER ()) * 100, 6) AS px, round((average_wage_yen - min(average_wage_yen) OVER ()) / (max(average_wage_yen) OVER () - min(average_wage_yen) OVER ()) * 100, 6) AS py FROM (SELECT * FROM e WHERE daily_user_capacity_ratio IS NOT NULL AND average_wage_yen IS NOT NULL) x", "e")),
    "summary_cards": (lambda t: r6(reports.summary_cards(t.e, "company_key"), "mean_wage", "sd_wage", "mean_use", "mean_users", "home_rate", "mean_home_ratio", "p10_wage", "p25_wage", "median_wage", "p75_wage", "p90_wage"), sql(f"""SELECT count(*) AS offices, round(avg(average_wage_yen), 6) AS mean_wage, round(stddev_samp(average_wage_yen), 6) AS sd_wage, round(avg(daily_user_capacity_ratio), 6) AS mean_use, round(avg(average_daily_users), 6) AS mean_users, count(*) FILTER (home_use_active) AS home_count, round(avg(home_use_active::INT), 6) AS home_rate, round(avg(home_use_user_ratio_decimal), 6) AS mean_home_ratio, count(*) FILTER (shortage_risk) AS risk_count,
{", ".join(f"round(quantile_cont(average_wage_yen, {q}), 6) AS {n}_wage" for n, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))},
(SELECT count(*) FROM (SELECT company_key FROM c GROUP BY 1 HAVING count(*) >= 2) x) AS multi_office_companies, (SELECT label FROM ({_GROUPED.format(1)}) y) AS best_work_model FROM c""", "c")),
    "insight_summary": (lambda t: r6(reports.insight_summary(t.e), "value"), sql(f"""SELECT 'wage' AS block, 'median' AS metric, median(average_wage_yen) AS value FROM e UNION ALL SELECT 'wage', 'mean', round(avg(average_wage_yen), 6) FROM e
UNION ALL SELECT 'use', 'offices', count(*) FROM e WHERE daily_user_capacity_ratio < 0.7 UNION ALL SELECT 'use', 'revenue_per_point', floor(avg(coalesce({_POINT}, 0)) + 0.5) FROM e WHERE daily_user_capacity_ratio < 0.7
UNION ALL SELECT 'performers', office_no, average_wage_yen FROM (SELECT * FROM e WHERE wage_outlier_flag = 'high' AND primary_activity_type IS NOT NULL ORDER BY average_wage_yen DESC, ordinal LIMIT 3) x
UNION ALL SELECT 'work models', label, median FROM ({_GROUPED.format(2)}) y UNION ALL SELECT 'home use', CASE WHEN home_use_active THEN 'with' ELSE 'without' END, round(avg(average_wage_yen), 6) FROM e GROUP BY 2""", "e")),
    "market_summary": (lambda t: r6(reports.market_summary(t.e, "area", "company_key"), "value"), sql(f"""SELECT 'competition' AS block, label AS metric, CAST(n AS DOUBLE) AS value FROM (SELECT area AS label, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, min(ordinal) LIMIT 3) x
UNION ALL SELECT 'opportunity', area, w FROM (SELECT area, count(*) AS n, median(average_wage_yen) AS w, avg(daily_user_capacity_ratio) AS u FROM c GROUP BY 1) a, s WHERE a.n >= 3 AND a.n <= (SELECT median(n) FROM (SELECT count(*) AS n FROM c GROUP BY area) z) AND w >= med AND u >= uavg QUALIFY row_number() OVER (ORDER BY w + 10000 * u DESC, area) = 1
UNION ALL SELECT 'capacity', 'mean_free', round(avg(available_capacity), 6) FROM c UNION ALL SELECT 'capacity', 'five_free', count(*) FILTER (available_capacity >= 5) FROM c
UNION ALL SELECT 'work models', label, median FROM ({_GROUPED.format(3)}) y
UNION ALL SELECT 'shortage', m, v FROM (SELECT count(*) AS a, count(*) FILTER (lite) AS b, count(*) FILTER (hh) AS d, sum(coalesce(available_capacity, 0)) AS f FROM c WHERE shortage_risk) z, LATERAL (VALUES ('offices', CAST(a AS DOUBLE)), ('light', b), ('home', d), ('free', f)) t(m, v)
UNION ALL SELECT 'home use', m, round(v, 6) FROM (SELECT avg(average_wage_yen) FILTER (home_use_active) AS a, avg(daily_user_capacity_ratio) FILTER (home_use_active) AS b, avg(average_wage_yen) FILTER (NOT home_use_active) AS d, avg(daily_user_capacity_ratio) FILTER (NOT home_use_active) AS f FROM c) z, LATERAL (VALUES ('with_wage', a), ('with_use', b), ('without_wage', d), ('without_use', f)) t(m, v)
UNION ALL SELECT 'companies', m, round(v, 6) FROM (SELECT count(*) FILTER (n >= 2) AS a, max(n) AS b, avg(sp) FILTER (n >= 2) AS d FROM (SELECT count(*) AS n, CASE WHEN count(average_wage_yen) >= 2 THEN max(average_wage_yen) - min(average_wage_yen) END AS sp FROM c GROUP BY company_key) k) z, LATERAL (VALUES ('multi_office', CAST(a AS DOUBLE)), ('largest', b), ('mean_spread', d)) t(m, v)""", "c")),
    "top_performers": (lambda t: reports.top_performers(t.e, 10).select("office_no", W, "primary_activity_type"), sql("SELECT office_no, average_wage_yen, primary_activity_type FROM e WHERE wage_outlier_flag = 'high' AND primary_activity_type IS NOT NULL ORDER BY average_wage_yen DESC, ordinal LIMIT 10", "e")),
    "growth_candidates": (lambda t: r6(reports.growth_candidates(t.e).select("office_no", "score"), "score"), sql(_SCORED.format(f"70 * {_R} + 25 * (1 - daily_user_capacity_ratio)", f"{_R} >= 1.1 AND daily_user_capacity_ratio < 0.8", 6), "e")),
    "fix_candidates": (lambda t: r6(reports.fix_candidates(t.e).select("office_no", "score"), "score"), sql(_SCORED.format(f"80 * greatest(1 - {_R}, 0) + 35 * greatest(0.7 - daily_user_capacity_ratio, 0) + 2 * greatest(coalesce(available_capacity, 0) - 3, 0) + CASE WHEN lite THEN 10 ELSE 0 END + CASE WHEN hh THEN 8 ELSE 0 END", f"{_R} < 0.9 AND daily_user_capacity_ratio < 0.75 AND shortage_risk", 6), "e")),
    "strong_candidates": (lambda t: r6(reports.strong_candidates(t.e).select("office_no", "score"), "score"), sql(_SCORED.format(f"70 * {_R} + 35 * daily_user_capacity_ratio", f"{_R} >= 1.1 AND daily_user_capacity_ratio >= 0.85", 6), "e")),
    "anomaly_list": (lambda t: r6(reports.anomaly_list(t.e).select("office_no", "score"), "score"), sql(_SCORED.format("5 * abs(coalesce(z_score, 0)) + 2 * coalesce(ratio_to_overall_mean, 0) + CASE WHEN daily_user_capacity_ratio > 1.5 THEN 35 ELSE 0 END", "wage_outlier_flag IS NOT NULL OR daily_user_capacity_ratio > 1.5", 12), "e")),
    "sum_computed": (lambda t: reports.sum_computed(t.e, F.col("available_capacity")), sql("SELECT sum(coalesce(available_capacity, 0)) AS total FROM e", "e")),
    "share_of": (lambda t: r6(reports.share_of(t.e, F.col(U) > 1), "share"), sql("SELECT round(avg(coalesce(daily_user_capacity_ratio > 1, false)::INT), 6) AS share FROM e", "e")),
    "export_filtered_table": (_export, linking._with(f"""SELECT office_no AS "No.", municipality, corporation_type_label AS "company type", fl.corporation_number AS "company number", corporation_name AS company, representative_name AS representative, representative_role AS role, office_name AS office, fl.area,
average_wage_yen AS "mean wage", round(ratio_to_overall_mean, 6) AS "to overall mean", round(ratio_to_municipality_mean, 6) AS "to municipality mean", round(ratio_to_capacity_band_mean, 6) AS "to capacity band mean", round(daily_user_capacity_ratio, 6) AS use, available_capacity AS "free places",
CASE WHEN home_use_active THEN 'yes' ELSE 'no' END AS "home use", round(home_use_user_ratio_pct, 6) AS "home share", wage_outlier_flag AS "wage level", CASE WHEN shortage_risk THEN 'yes' ELSE 'no' END AS "possible shortage", work_model AS "work model", an AS "offices in area", tn AS "offices with the activity in area",
cn AS "offices of company", dir_primary_activity_type AS "main activity", dir_office_number AS "directory number", dir_office_url AS "directory page", l.homepage_url AS homepage, l.profile_url AS profile, {_URL_OF.format("")} AS search, {_URL_OF.format(" || ' profile'")} AS "profile search", remarks
FROM (SELECT *, count(*) OVER (PARTITION BY area) AS an, count(*) OVER (PARTITION BY area, primary_activity_type) AS tn, count(*) OVER (PARTITION BY company_key) AS cn FROM fl) fl JOIN (SELECT ordinal, homepage_url, profile_url FROM linked) l USING (ordinal) WHERE wage_outlier_flag = 'high'""", linking._LINKED, "merged", "full")),
}
