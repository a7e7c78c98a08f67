"""Row classifiers.  Rule tables are parameters; their defaults are at the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword rules for kinds of work, in order; the tier table (from, unit); the factors of the revenue estimate.
WORK_MODELS = (
    ("軽作業中心", "(内職|軽作業|袋詰|梱包|検品|シール|箱折|封入|セット|組立|仕分|ピッキング)"),
    ("PC・クリエイティブ", "(データ入力|web|hp|sns|デザイン|動画|ライティング|ec|印刷|チラシ|ブログ|名刺|パンフレット|pc)"),
    ("飲食・食品", "(弁当|飲食|カフェ|調理|菓子|パン|喫茶|盛付|仕込み|プリン|食品)"),
    ("農業・園芸", "(農業|農作業|栽培|園芸|水耕|畑|野菜|多肉植物)"),
    ("ものづくり", "(製造|加工|製作|アクセサリー|ハンドメイド|縫製|木工|クラフト|ものづくり)"),
    ("サービス・役務", "(清掃|洗濯|ポスティング|役務|接客|販売|受託|施設外|請負)"),
)
TIERS = ((0, 567), (5000, 590), (10000, 612), (15000, 646), (20000, 671), (25000, 703), (30000, 736), (35000, 757), (45000, 764))
DAYS, POINT = 22, 0.01

#: Rules and light label for the English part types of the test tables.
TEST_WORK_MODELS = (("light", "(brushed|polished)"), ("metal", "(steel|copper)"), ("small", "(small|economy)"))
LIGHT = "light"


def work_model_label(activity: Column, detail: Column | None = None, rules=WORK_MODELS, other: str = "その他", none: str = "主活動未取得") -> Column:
    """First rule whose pattern occurs in type and detail (lower case; apply NFKC before), else other, else the type, else none."""
    text = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", activity, *([detail] if detail is not None else [])), "(?U)\\s+", " ")))
    out = F.when(text == "", none)
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), label)
    plain = F.trim(F.regexp_replace(activity, "(?U)\\s+", " "))
    return out.when(F.contains(text, F.lit(other)), other).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit(none)))


def area_label(city: Column, line: Column, municipality: Column, ward: str = "大阪市([^\\s0-9]+?区)", prefix: str = "^大阪府", ward_city: str = "大阪市", ward_unknown: str = "大阪市（区未取得）") -> Column:
    """Ward out of the address, else the city without prefecture, else the municipality."""
    address = F.concat_ws("", city, line)
    found = F.nullif(F.regexp_extract(address, ward, 1), F.lit(""))
    plain = F.trim(F.regexp_replace(F.nullif(city, F.lit("")), prefix, ""))
    named = lambda c: F.when(c == ward_city, ward_unknown).otherwise(c)
    return F.coalesce(found, named(plain), named(municipality))


def available_capacity(capacity: Column, directory_capacity: Column, users: Column) -> Column:
    """Free places, at least 0; null if unknown."""
    free = F.coalesce(capacity, directory_capacity) - users
    return F.when(free.isNotNull(), F.greatest(free, F.lit(0.0)))


def _conditions(wage_ratio: Column, use: Column, home: Column, light: Column, free: Column) -> dict[str, Column]:
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {"low wage": sure(wage_ratio < 0.9), "low use": sure(use < 0.7), "very low use": sure(use < 0.6), "high home use": sure(home >= 0.3), "light work": sure(light), "many free places": sure(free >= 5)}


def shortage_risk(wage_ratio: Column, use: Column, home: Column, light: Column, free: Column) -> Column:
    c = _conditions(wage_ratio, use, home, light, free)
    low, thin, lite, many = c["low wage"], c["low use"], c["light work"], c["many free places"]
    return (low & thin) | (low & c["high home use"] & lite) | (low & many & (thin | lite)) | (c["very low use"] & many)


SIGNALS = ("low wage", "low use", "high home use", "light work", "many free places")


def shortage_signals(wage_ratio: Column, use: Column, home: Column, light: Column, free: Column) -> Column:
    c = _conditions(wage_ratio, use, home, light, free)
    return F.array_compact(F.array(*[F.when(c[s], F.lit(s)) for s in SIGNALS]))


def signal_counts(df: DataFrame, signals: str) -> DataFrame:
    return df.select(F.explode(signals).alias("signal")).groupBy("signal").agg(F.count("*").alias("count"))


def price_tier(wage: Column, tiers=TIERS) -> tuple[Column, Column]:
    """(number, unit) of the half-open range that holds the wage; the first below all ranges; null without a wage."""
    number, unit = F.when(wage.isNull(), None), F.when(wage.isNull(), None)
    for i in range(len(tiers) - 1, 0, -1):
        number, unit = number.when(wage >= tiers[i][0], i + 1), unit.when(wage >= tiers[i][0], tiers[i][1])
    return number.otherwise(1), unit.otherwise(tiers[0][1])


def revenue_per_point(capacity: Column, wage: Column, tiers=TIERS) -> Column:
    """Monthly revenue of one point of utilisation, rounded half up."""
    return F.floor(capacity * F.lit(POINT) * price_tier(wage, tiers)[1] * F.lit(DAYS) + 0.5)


def action_notes(use: Column, risk: Column, flag: Column, new: Column, most: int = 6) -> Column:
    """Ordered notes of a row, the default where no rule holds."""
    notes = F.array_compact(F.array(
        F.when(use < 0.6, F.lit("raise use")), F.when(risk, F.lit("find work")), F.when(flag == "high", F.lit("share practice")), F.when(new, F.lit("follow start"))))
    return F.slice(F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("observe"))), 1, most)


def badges(flag: Column, status: Column, new: Column, risk: Column) -> Column:
    found = F.array_compact(F.array(F.concat(F.lit("wage "), flag), F.when(status != "answered", status), F.when(new, F.lit("new")), F.when(risk, F.lit("shortage"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("normal")))


def label_values(df: DataFrame, column: str, labels: dict[str, str], out: str) -> DataFrame:
    """Coded values as words, others as they are.  The dictionary is a handful of rows, whence the broadcast."""
    words = df.sparkSession.createDataFrame(list(labels.items()), "_code string, _word string")
    return df.join(F.broadcast(words), F.col(column) == F.col("_code"), "left").withColumn(out, F.coalesce("_word", column)).drop("_code", "_word")


def classified(df: DataFrame, rules=TEST_WORK_MODELS, light: str = LIGHT) -> DataFrame:
    """An office table with utilisation and mean ratios, extended by the classifiers' columns."""
    out = df.withColumns({
        "work_model": work_model_label(F.col("primary_activity_type"), rules=rules, other="other", none="none"),
        "available_capacity": available_capacity(F.col("capacity"), F.lit(None).cast("double"), F.col("average_daily_users")),
    })
    inputs = (F.col("ratio_to_overall_mean"), F.col("daily_user_capacity_ratio"), F.col("home_use_user_ratio_decimal"), F.col("work_model") == light, F.col("available_capacity"))
    return out.withColumns({"shortage_risk": shortage_risk(*inputs), "signals": shortage_signals(*inputs)})
