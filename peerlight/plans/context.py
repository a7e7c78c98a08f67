"""Tables that the registered queries start from, and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, classify, entities, linkage, profile, stats
from ..sources.tables import checkpointed, discard
from . import views

#: Relaxed tokens, role words and legal words of the test views.
TOKENS = ("works", "center", "office")
ROLES = ("chair", "head")
LEGAL = ("group ",)
SOCIAL_HOSTS = ("social.example.com",)

_written: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Derived tables are made anew by the next query, and what has been written of them is deleted."""
    discard(*_written.values())
    _written.clear()


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files: what has been derived holds as long as these stay."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    system, found, left = folder.getFileSystem(spark._jsc.hadoopConfiguration()), [], [folder]
    while left:
        for f in system.listStatus(left.pop()):
            left += [f.getPath()] if f.isDirectory() else []
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class Tables:
    """Views over one directory of tables.  Those that several queries share are derived once per application and state of the files, and kept in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.state = spark, sf_dir, _state(spark, sf_dir)

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.state, name)
        if key not in _written:
            _written[key] = checkpointed(make())
        return _written[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def office(self) -> DataFrame:
        return self._once("office", lambda: views.office(self.spark, self.sf_dir))

    @cached_property
    def raw_directory(self) -> DataFrame:
        return self._once("directory", lambda: self.spark.sql(views.DIRECTORY, office=self.office))

    @cached_property
    def directory(self) -> DataFrame:
        """Without the second rows of a number."""
        return self._once("deduped", lambda: linkage.dedupe_first_wins(self.raw_directory, "office_number", "ordinal"))

    @cached_property
    def e(self) -> DataFrame:
        """Enriched offices, with company and representative keys."""
        return self._once("enriched", lambda: self._enriched())

    def _enriched(self) -> DataFrame:
        out = profile.enriched(self.office).withColumn("area", classify.area_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("municipality")))
        key = T.company_key(F.col("corporation_name"), nfkc=False)
        out = out.withColumns({"name_key": key, "base_key": T.company_base_key(key, LEGAL), "rep_key": T.representative(F.col("representative_raw"), ROLES, nfkc=False)["name_key"]})
        return entities.company_identity(out, "corporation_number", "name_key", "base_key", "rep_key", "office_no")

    @cached_property
    def records(self) -> DataFrame:
        return self._once("records", lambda: linkage.prepared_records(self.office, TOKENS, nfkc=False))

    @cached_property
    def listed(self) -> DataFrame:
        return self._once("listed", lambda: linkage.prepared_directory(self.directory, TOKENS, nfkc=False))

    @cached_property
    def candidates(self) -> DataFrame:
        """All candidate pairs, made anew where they are read: they grow with the square of a block."""
        return linkage.paired(linkage.candidate_pairs(self.records, self.listed), self.records, self.listed)

    @cached_property
    def narrowed(self) -> DataFrame:
        """The candidates inside their area, made anew where they are read."""
        return blocking.narrowed(self.records, self.listed)

    @cached_property
    def proposals(self) -> DataFrame:
        made = lambda: linkage.proposed(self.records, self.listed)
        return self._once("proposals", lambda: made().select(*linkage.PROPOSAL).unionByName(linkage.link_overrides(self.overrides, self.records, self.listed).select(*linkage.PROPOSAL)))

    @cached_property
    def overrides(self) -> DataFrame:
        """Two rows for each of some records: the second wins."""
        o = self.office.filter("ordinal % 97 = 0")
        one = lambda shift: o.select(F.col("office_no").alias("record_office_no"), F.concat(F.lit("D"), (F.col("ordinal") + shift).cast("string")).alias("directory_office_number"), F.lit(shift).alias("ordinal"))
        return one(1).unionByName(one(2))

    @cached_property
    def chosen(self) -> DataFrame:
        return self._once("chosen", lambda: linkage.link_assign_one_to_one(linkage.link_ambiguity_filter(self.proposals)))

    @cached_property
    def simple(self) -> DataFrame:
        """Chosen pairs that SQL can reproduce: each office with the directory row of its number, where the names are equal."""
        d = self.directory.select(F.col("ordinal").alias("dir"), F.concat(F.lit("D"), F.col("ordinal").cast("string")).alias("_n"), F.col("office_name").alias("_m"))
        o = self.office.select(F.col("ordinal").alias("rec"), F.concat(F.lit("D"), "office_no").alias("_k"), "office_name")
        return o.join(d, F.col("_k") == F.col("_n")).filter("office_name = _m").select("rec", "dir", F.lit("high").alias("confidence"), F.lit("number_and_name").alias("method"), F.lit(100.0).alias("score"))

    @cached_property
    def merged(self) -> DataFrame:
        return self._once("merged", lambda: linkage.link_merge_fields(self.office, self.directory, self.simple))

    @cached_property
    def linked(self) -> DataFrame:
        """Offices with the fields of the directory rows that the whole linkage has chosen."""
        return self._once("linked", lambda: linkage.link_merge_fields(self.office, self.directory, self.chosen))

    @cached_property
    def full(self) -> DataFrame:
        """Enriched offices with the fields of their directory rows and of their representatives."""
        return self._once("full", lambda: self._full())

    def _full(self) -> DataFrame:
        fields = [c for c in self.merged.columns if c.startswith("dir_")]
        person = T.representative(F.col("representative_raw"), ROLES, nfkc=False)
        return self.e.join(self.merged.select("ordinal", *fields), "ordinal").withColumns({
            "representative_name": person["name"], "representative_role": person["role"], "home_use_user_ratio_pct": 100 * F.col("home_use_user_ratio_decimal"),
            "remarks": F.when(F.col("ordinal") % 12 == 0, F.concat(F.lit("Note "), "office_no")), "address": F.nullif(F.concat_ws(" ", "dir_office_address_city", "dir_office_address_line"), F.lit("")),
        })

    @cached_property
    def staffed(self) -> DataFrame:
        return self._once("staffed", lambda: stats.staffing_report(self.merged, "average_wage_yen", "dir_key_staff_fte_per_capacity", F.col("dir_match_status") == "matched", F.col("dir_fetch_status") == "ok"))

    @cached_property
    def links(self) -> DataFrame:
        from ..operators import pages

        return self._once("links", lambda: pages.page_links(self.table("pages")))


_RATIO = "average_daily_users / capacity"
_CTES = {
    "office": views.OFFICE_CTE,
    "raw_directory": f"raw_directory AS ({views.for_duckdb(views.DIRECTORY)})",
    "directory": "directory AS (SELECT * FROM raw_directory QUALIFY row_number() OVER (PARTITION BY office_number ORDER BY ordinal) = 1)",
    "s": f"""s AS (SELECT avg(average_wage_yen) AS m, stddev_samp(average_wage_yen) AS sd, quantile_cont(average_wage_yen, 0.25) AS q1, median(average_wage_yen) AS med, quantile_cont(average_wage_yen, 0.75) AS q3,
  count(average_wage_yen) AS n, median({_RATIO}) AS um, avg({_RATIO}) AS uavg FROM office)""",
    "b": f"""b AS (SELECT *, {_RATIO} AS daily_user_capacity_ratio,
  CASE WHEN average_wage_yen IS NULL THEN NULL WHEN average_wage_yen < 10000 THEN 'under 10k' WHEN average_wage_yen < 15000 THEN '10k-15k' WHEN average_wage_yen < 20000 THEN '15k-20k' WHEN average_wage_yen < 30000 THEN '20k-30k' WHEN average_wage_yen < 50000 THEN '30k-50k' ELSE '50k and more' END AS wage_band_label,
  CASE WHEN capacity < 11 THEN 'up to 10' WHEN capacity < 21 THEN '11-20' WHEN capacity < 31 THEN '21-30' WHEN capacity < 41 THEN '31-40' ELSE '41 and more' END AS capacity_band_label,
  CASE WHEN regexp_matches(lower(primary_activity_type), '(brushed|polished)') THEN 'light' WHEN regexp_matches(lower(primary_activity_type), '(steel|copper)') THEN 'metal' WHEN regexp_matches(lower(primary_activity_type), '(small|economy)') THEN 'small'
    WHEN primary_activity_type IS NULL THEN 'none' WHEN contains(lower(primary_activity_type), 'other') THEN 'other' ELSE primary_activity_type END AS work_model,
  CASE WHEN average_daily_users IS NOT NULL THEN greatest(capacity - average_daily_users, 0) END AS available_capacity, municipality AS area,
  replace(corporation_name, ' ', '') AS name_key, replace('person ' || CAST(ordinal % 300 AS STRING), ' ', '') AS rep_key FROM office)""",
    "e0": """e0 AS (SELECT b.*, average_wage_yen / m AS ratio_to_overall_mean, average_wage_yen - m AS difference_to_overall_mean, average_wage_yen / avg(average_wage_yen) OVER (PARTITION BY municipality) AS ratio_to_municipality_mean,
  average_wage_yen / avg(average_wage_yen) OVER (PARTITION BY corporation_type_label) AS ratio_to_type_mean, average_wage_yen / avg(average_wage_yen) OVER (PARTITION BY capacity_band_label) AS ratio_to_capacity_band_mean,
  (average_wage_yen - m) / sd AS z_score,
  CASE WHEN average_wage_yen > q3 + 1.5 * (q3 - q1) THEN 'high' WHEN average_wage_yen <= greatest(q1 - 3.0 * (q3 - q1), 0) OR average_wage_yen < greatest(q1 - 1.5 * (q3 - q1), 0) THEN 'low' END AS wage_outlier_flag,
  CASE WHEN average_wage_yen >= q3 + 3.0 * (q3 - q1) OR average_wage_yen <= greatest(q1 - 3.0 * (q3 - q1), 0) THEN 'extreme' WHEN average_wage_yen > q3 + 1.5 * (q3 - q1) OR average_wage_yen < greatest(q1 - 1.5 * (q3 - q1), 0) THEN 'moderate' END AS wage_outlier_severity,
  CASE WHEN average_wage_yen IS NULL OR daily_user_capacity_ratio IS NULL THEN NULL WHEN average_wage_yen >= med THEN CASE WHEN daily_user_capacity_ratio >= um THEN 'high wage x high use' ELSE 'high wage x low use' END
    ELSE CASE WHEN daily_user_capacity_ratio >= um THEN 'low wage x high use' ELSE 'low wage x low use' END END AS market_position_quadrant FROM b, s)""",
    "e1": """e1 AS (SELECT *, coalesce(ratio_to_overall_mean < 0.9, false) AS lo, coalesce(daily_user_capacity_ratio < 0.7, false) AS thin, coalesce(daily_user_capacity_ratio < 0.6, false) AS vthin,
  coalesce(home_use_user_ratio_decimal >= 0.3, false) AS hh, work_model = 'light' AS lite, coalesce(available_capacity >= 5, false) AS many FROM e0)""",
    "e": """e AS (SELECT *, (lo AND thin) OR (lo AND hh AND lite) OR (lo AND many AND (thin OR lite)) OR (vthin AND many) AS shortage_risk FROM e1)""",
    "c": """n1 AS (SELECT name_key, min(corporation_number) AS x FROM b WHERE corporation_number IS NOT NULL GROUP BY 1 HAVING count(DISTINCT corporation_number) = 1),
p1 AS (SELECT rep_key, regexp_replace(name_key, '^group ', '') AS base_key, min(corporation_number) AS y FROM b WHERE corporation_number IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT corporation_number) = 1),
w1 AS (SELECT b.*, y FROM b LEFT JOIN p1 ON b.rep_key = p1.rep_key AND b.name_key = p1.base_key),
n2 AS (SELECT name_key, min(coalesce(corporation_number, y)) AS x FROM w1 WHERE coalesce(corporation_number, y) IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(corporation_number, y)) = 1),
c AS (SELECT e.*, coalesce('number:' || coalesce(e.corporation_number, n2.x, w1.y), 'name:' || e.name_key) AS company_key FROM e JOIN w1 ON e.ordinal = w1.ordinal LEFT JOIN n2 ON e.name_key = n2.name_key)""",
    "simple": "simple AS (SELECT o.ordinal AS rec, d.ordinal AS dir, 'high' AS confidence, 'number_and_name' AS method, CAST(100 AS DOUBLE) AS score FROM office o JOIN directory d ON 'D' || o.office_no = d.office_number AND o.office_name = d.office_name AND d.ordinal < 1000000)",
    "merged": """merged AS (SELECT o.*, CASE WHEN s0.dir IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status, d.office_number, d.office_capacity - o.capacity AS capacity_gap, d.average_wage_monthly_yen - o.average_wage_yen AS wage_gap,
  CASE WHEN o.average_daily_users > 0 THEN d.life_support_fte / o.average_daily_users END AS per_user, d.fetch_status, d.key_staff_fte_per_capacity AS k, d.transport_available, d.meal_support_addon, d.service_manager_actual, d.service_manager_fte, d.life_support_actual, d.life_support_fte, d.office_url,
  d.corporation_number AS dir_number
  FROM office o LEFT JOIN simple s0 ON s0.rec = o.ordinal LEFT JOIN directory d ON d.ordinal = s0.dir)""",
    "full": """fl AS (SELECT c.*, replace(representative_raw, 'chair ', '') AS representative_name, 'chair' AS representative_role, 100 * home_use_user_ratio_decimal AS home_use_user_ratio_pct, CASE WHEN c.ordinal % 12 = 0 THEN 'Note ' || office_no END AS remarks,
  nullif(concat_ws(' ', d.office_address_city, d.office_address_line), '') AS address, CASE WHEN s0.dir IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS dir_match_status, s0.confidence AS dir_match_confidence, d.fetch_status AS dir_fetch_status, d.office_number AS dir_office_number, d.office_url AS dir_office_url,
  d.office_address_city AS dir_office_address_city, d.office_address_line AS dir_office_address_line, d.office_capacity AS dir_office_capacity, d.primary_activity_type AS dir_primary_activity_type, d.transport_available AS dir_transport_available, d.meal_support_addon AS dir_meal_support_addon,
  d.key_staff_fte_per_capacity AS dir_key_staff_fte_per_capacity, d.average_wage_monthly_yen AS dir_average_wage_monthly_yen, d.average_wage_monthly_yen - c.average_wage_yen AS dir_average_wage_gap, d.service_manager_fte AS dir_service_manager_fte
  FROM c LEFT JOIN simple s0 ON s0.rec = c.ordinal LEFT JOIN directory d ON d.ordinal = s0.dir)""",
    "staffed": """ss AS (SELECT quantile_cont(k, 0.25) AS k1, quantile_cont(k, 0.75) AS k3, median(k) AS km, median(average_wage_yen) AS wm FROM merged WHERE status = 'matched' AND fetch_status = 'ok'),
staffed AS (SELECT merged.*, CASE WHEN k >= k3 + 3 * (k3 - k1) OR k > k3 + 1.5 * (k3 - k1) THEN 'high' WHEN k <= greatest(k1 - 3 * (k3 - k1), 0) OR k < greatest(k1 - 1.5 * (k3 - k1), 0) THEN 'low' END AS flag,
  CASE WHEN k >= k3 + 3 * (k3 - k1) OR k <= greatest(k1 - 3 * (k3 - k1), 0) THEN 'extreme' WHEN k > k3 + 1.5 * (k3 - k1) OR k < greatest(k1 - 1.5 * (k3 - k1), 0) THEN 'moderate' END AS severity,
  CASE WHEN average_wage_yen IS NULL OR k IS NULL THEN NULL WHEN average_wage_yen >= wm THEN CASE WHEN k >= km THEN 'high wage x ample staff' ELSE 'high wage x thin staff' END ELSE CASE WHEN k >= km THEN 'low wage x ample staff' ELSE 'low wage x thin staff' END END AS quadrant
  FROM merged, ss)""",
}
_CLEAN = "regexp_replace(lower(coalesce({}, '')), '[\\p{{P}}\\p{{S}}\\s]', '', 'g')"
_RELAX = "replace(replace(replace({}, 'works', ''), 'center', ''), 'office', '')"
_strict = lambda c: _CLEAN.format(c)
_CTES |= {
    "r": f"r AS (SELECT ordinal AS rec, office_no, corporation_number AS rec_number, {_strict('corporation_name')} AS rec_company, municipality AS rec_area, capacity AS rec_capacity, {_strict('office_name')} AS rec_strict, {_RELAX.format(_strict('office_name'))} AS rec_relaxed FROM office)",
    "d": f"""d AS (SELECT *, count(*) OVER (PARTITION BY dir_strict) AS n_strict, count(*) OVER (PARTITION BY dir_relaxed) AS n_relaxed FROM
  (SELECT ordinal AS dir, office_number, corporation_number AS dir_number, {_strict('corporation_name')} AS dir_company, office_address_city AS dir_city, office_capacity AS dir_capacity, {_strict('office_name')} AS dir_strict, {_RELAX.format(_strict('office_name'))} AS dir_relaxed FROM directory) x)""",
    "u": """u0 AS (SELECT rec, dir, true AS a, false AS b FROM r JOIN d ON rec_number = dir_number UNION ALL SELECT rec, dir, false, true FROM r JOIN d ON rec_company = dir_company AND rec_company <> ''),
u AS (SELECT rec, dir, bool_or(a) AS same_number, bool_or(b) AS same_company FROM u0 GROUP BY 1, 2)""",
    "f": """f1 AS (SELECT rec, dir FROM r JOIN d ON rec_strict = dir_strict AND n_strict = 1 AND rec_strict <> '' WHERE rec NOT IN (SELECT rec FROM u)),
f2 AS (SELECT rec, dir FROM r JOIN d ON rec_relaxed = dir_relaxed AND n_relaxed = 1 AND rec_relaxed <> '' WHERE rec NOT IN (SELECT rec FROM u) AND rec NOT IN (SELECT rec FROM f1)),
f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2)""",
    "p": """p0 AS (SELECT rec, dir FROM u UNION ALL SELECT rec, dir FROM f),
p AS (SELECT p0.rec, p0.dir, r.*EXCLUDE(rec), d.*EXCLUDE(dir), coalesce(rec_number = dir_number, false) AS num, rec_company = dir_company AND rec_company <> '' AS nam,
  (SELECT count(*) FROM d d2 WHERE d2.dir_number = rec_number) AS cands, coalesce(dir_city, '') = '' OR contains(dir_city, rec_area) AS agrees FROM p0 JOIN r ON r.rec = p0.rec JOIN d ON d.dir = p0.dir)""",
    "q": "q AS (SELECT *, max(agrees::INT) OVER (PARTITION BY rec) AS any_agrees FROM p QUALIFY agrees OR any_agrees = 0)",
}
NEEDS = {
    "raw_directory": ["office"], "directory": ["raw_directory"], "s": ["office"], "b": ["office"], "e0": ["b", "s"], "e1": ["e0"], "e": ["e1"], "c": ["e"], "simple": ["directory"], "merged": ["simple"], "full": ["c", "simple"], "staffed": ["merged"],
    "r": ["office"], "d": ["directory"], "u": ["r", "d"], "f": ["u"], "p": ["f"], "q": ["p"],
}


def sql(body: str, *ctes: str) -> str:
    """``body`` with the named views in front, and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    return ("WITH " + ",\n".join(_CTES[n] for n in order) + "\n" if order else "") + body
