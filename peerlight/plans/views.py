"""``office`` and ``directory`` as views over the star schema: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "orders", "lineitem", "part", "nation", "region")

#: ``{x}`` is the table x.
OFFICE = """
SELECT CAST(c_custkey AS STRING) AS office_no, c_custkey AS ordinal, n_name AS municipality, r_name AS prefecture,
  c_mktsegment AS corporation_type_label,
  p_name || ' ' || p_brand || ' works ' || CAST(c_custkey % 97 AS STRING) AS office_name,
  CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE 'N' || CAST(c_custkey % 400 AS STRING) END AS corporation_number,
  CASE WHEN c_custkey % 16 = 7 THEN 'solo ' || CAST(c_custkey AS STRING) ELSE 'group ' || CAST(c_custkey % 400 AS STRING) END AS corporation_name,
  CAST(5 + c_custkey % 41 AS DOUBLE) AS capacity,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(least_price / 2) AS DOUBLE) END AS average_wage_yen,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(CAST(1.8 AS DOUBLE) * n_orders) AS DOUBLE) END AS average_daily_users,
  CASE WHEN c_acctbal < 0 THEN 'unanswered' ELSE 'answered' END AS response_status,
  p_type_top AS primary_activity_type,
  c_custkey % 5 < 2 AS home_use_active,
  CASE WHEN c_custkey % 5 < 2 THEN CAST(c_custkey % 10 AS DOUBLE) / 20 END AS home_use_user_ratio_decimal,
  c_custkey % 23 = 0 AS is_new_office,
  'chair ' || 'person ' || CAST(c_custkey % 300 AS STRING) AS representative_raw
FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
  LEFT JOIN {part} p ON p_partkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_totalprice) AS least_price FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT k, p_type_top FROM (
      SELECT o_custkey AS k, p_type AS p_type_top, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_type) AS place
      FROM {lineitem} l JOIN {orders} lo ON l_orderkey = o_orderkey JOIN {part} lp ON l_partkey = p_partkey GROUP BY o_custkey, p_type) x
    WHERE place = 1) t ON t.k = c_custkey
"""

DIRECTORY = """
SELECT 'D' || CAST(ordinal AS STRING) AS office_number, ordinal + 1000000 * copy AS ordinal,
  CASE ordinal % 7 WHEN 0 THEN office_name WHEN 1 THEN upper(replace(office_name, ' ', ' - ')) WHEN 2 THEN office_name || ' center'
    WHEN 3 THEN replace(replace(office_name, 'Brand', 'Brnd'), ' works ', ' worksoffice ') WHEN 4 THEN 'unit ' || right(office_name, 4)
    WHEN 5 THEN 'center ' || office_name || 'x' ELSE split_part(office_name, ' ', 1) || ' office' END AS office_name,
  CASE WHEN ordinal % 5 = 0 THEN NULL ELSE corporation_number END AS corporation_number,
  CASE WHEN ordinal % 9 = 4 THEN 'other ' || CAST(ordinal % 13 AS STRING) ELSE 'group ' || CAST(ordinal % 400 AS STRING) END AS corporation_name,
  capacity + CASE ordinal % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 7 END + copy AS office_capacity,
  CASE WHEN ordinal % 11 = 0 THEN NULL ELSE municipality || ' city' END AS office_address_city,
  CASE WHEN ordinal % 4 = 0 THEN 'ward' || CAST(ordinal % 6 AS STRING) || ' street' END AS office_address_line,
  CASE WHEN ordinal % 3 = 0 THEN NULL WHEN ordinal % 3 = 1 THEN 'https://Www.Site' || CAST(ordinal % 90 AS STRING) || '.example.com/Top/?q=1#x'
    ELSE 'https://social.example.com/user' || CAST(ordinal AS STRING) || '/posts' END AS office_url,
  primary_activity_type, average_wage_yen + ordinal % 1000 AS average_wage_monthly_yen,
  CASE WHEN ordinal % 13 = 0 THEN 'error' ELSE 'ok' END AS fetch_status,
  CASE WHEN ordinal % 6 = 0 THEN NULL ELSE ordinal % 6 < 3 END AS transport_available,
  CASE WHEN ordinal % 10 = 0 THEN NULL ELSE ordinal % 10 < 4 END AS meal_support_addon,
  CASE WHEN ordinal % 17 = 0 THEN NULL ELSE CAST(ordinal % 4 AS DOUBLE) END AS service_manager_actual,
  CASE WHEN ordinal % 19 = 0 THEN NULL ELSE CAST(ordinal % 3 AS DOUBLE) END AS service_manager_fte,
  CAST(ordinal % 8 AS DOUBLE) AS life_support_actual, CASE WHEN ordinal % 7 = 3 THEN NULL ELSE CAST(ordinal % 5 AS DOUBLE) END AS life_support_fte,
  CASE WHEN ordinal % 16 = 1 THEN NULL ELSE CAST((ordinal * 7) % 64 AS DOUBLE) / 64 END AS key_staff_fte_per_capacity
FROM (SELECT *, 0 AS copy FROM {office} o1 WHERE ordinal % 10 <> 9 UNION ALL SELECT *, 1 AS copy FROM {office} o2 WHERE ordinal % 50 = 0) d
"""


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}


def office(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OFFICE, **base_tables(spark, sf_dir))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRECTORY, office=office(spark, sf_dir))


def for_duckdb(text: str) -> str:
    for t in (*BASE, "office"):
        text = text.replace("{" + t + "}", t)
    return text


OFFICE_CTE = f"office AS ({for_duckdb(OFFICE)})"
DIRECTORY_CTE = f"directory AS ({for_duckdb(DIRECTORY)})"
