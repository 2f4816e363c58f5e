"""Back-casting model of missing price history: deflation, season, hash noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions.numeric import final_price, unit_noise
from pricelattice.functions.text import first_rule, price_label

DEFAULT_RATE = 0.30
# Ordered season rules (keywords, cheap months); the first rule with a keyword in the title wins.
SEASON_RULES: list[tuple[list[str], list[int]]] = [
    (["domates"], [7, 8, 9, 10]),
    (["salatalık", "hıyar"], [6, 7, 8]),
    (["patlıcan"], [6, 7, 8, 9]),
    (["kabak"], [6, 7, 8, 9]),
    (["biber", "dolmalık", "sivri"], [7, 8, 9, 10]),
    (["bamya"], [7, 8]),
    (["mısır"], [8, 9]),
    (["bezelye"], [4, 5, 6]),
    (["bakla"], [4, 5]),
    (["enginar"], [3, 4, 5]),
    (["ıspanak", "ispanak"], [1, 2, 3, 11, 12]),
    (["lahana"], [1, 2, 11, 12]),
    (["brokoli", "karnabahar"], [1, 2, 3, 10, 11, 12]),
    (["havuç"], [1, 2, 3, 4, 10, 11, 12]),
    (["pırasa"], [1, 2, 3, 12]),
    (["balkabağı", "bal kabağı"], [1, 2, 10, 11, 12]),
    (["kereviz"], [1, 2, 3, 11, 12]),
    (["portakal"], [1, 2, 3, 12]),
    (["mandalina"], [1, 2, 11, 12]),
    (["greyfurt"], [1, 10, 11, 12]),
    (["limon"], [3, 12]),
    (["nar"], [1, 2, 12]),
    (["çilek"], [4, 5, 6]),
    (["kiraz"], [6, 7]),
    (["kayısı"], [6, 7, 8]),
    (["şeftali"], [6, 7, 8]),
    (["erik"], [5, 6, 7, 8]),
    (["karpuz"], [7, 8, 9]),
    (["kavun"], [7, 8, 9]),
    (["üzüm"], [7, 8, 9]),
    (["vişne"], [7, 8]),
    (["incir"], [8, 9, 10]),
    (["elma"], [1, 2, 3, 10, 11, 12]),
    (["armut"], [1, 2, 10, 11, 12]),
    (["ayva"], [1, 2, 11, 12]),
    (["kestane"], [1, 2, 10, 11]),
    (["muz"], [3, 4, 5, 6, 7, 8, 9, 10, 11, 12]),
]
# Month multipliers where no rule matches.
SEASON_DEFAULT = {1: 1.20, 2: 1.15, 3: 1.05, 4: 0.95, 5: 0.90, 6: 0.85, 7: 0.82, 8: 0.83, 9: 0.88, 10: 0.95, 11: 1.08, 12: 1.18}
# Wholesale price index by year, 2016 = 1.
WHOLESALE_INDEX = {2016: 1.0, 2017: 1.2054, 2018: 1.4018, 2019: 1.7232, 2020: 1.7679, 2021: 2.0982, 2022: 4.3750, 2023: 7.6786, 2024: 12.500, 2025: 17.411, 2026: 26.339}


def season_curve(cheap: list[int]) -> list[float]:
    """0.80 in cheap months, 1.00 beside one (the year is a ring), else 1.25."""
    ring = lambda m: (m - 1) % 12 + 1
    return [0.80 if m in cheap else 1.00 if {ring(m - 1), ring(m + 1)} & set(cheap) else 1.25 for m in range(1, 13)]


def season_months(title: Column) -> Column:
    """The twelve multipliers of a title by the ordered rules, as an array: the rules are gone through once a row."""
    rule = first_rule(F.lower(title), [(w, i) for i, (w, _) in enumerate(SEASON_RULES)], -1)
    curves = F.array(*[F.array(*[F.lit(v) for v in season_curve(c)]) for _, c in SEASON_RULES])
    default = F.array(*[F.lit(SEASON_DEFAULT[m]) for m in range(1, 13)])
    return F.when(rule < 0, default).otherwise(F.get(curves, rule))


def season_multiplier(title: Column, month: Column) -> Column:
    """Month multiplier of a title."""
    return F.get(season_months(title), month - 1)


def deflation_dim(spark: SparkSession, base, targets: list, rates: dict[int, float]) -> DataFrame:
    """(target_date, factor) for the few dates of a back-cast; one row per date, computed once on the driver from calendar arithmetic.

    Day by day from the target, factor grows by rate(year) / 365 (DEFAULT_RATE for years without a rate). After more than 400 days,
    if over 30 days remain, the rest compounds yearly at the mean rate of the years left. The factor is 1 from the base date on.
    """
    return spark.createDataFrame([(t, deflation_factor(base, t, rates)) for t in targets], "target_date date, factor double")


def deflation_factor(base, target, rates: dict[int, float]) -> float:
    from datetime import timedelta

    if target >= base:
        return 1.0
    grow, day = 1.0, target
    # Whole years at once: within one calendar year every day grows by the same daily rate.
    walked = 0
    while day < base:
        left = (base - day).days
        if walked > 400 and left > 30:
            years = left / 365
            span = [rates.get(y, DEFAULT_RATE) for y in range(day.year, day.year + int(years) + 1)]
            grow *= (1 + sum(span) / len(span)) ** years
            break
        run = min(left, (day.replace(month=12, day=31) - day).days + 1)
        if walked <= 400:
            run = min(run, 401 - walked)
        grow *= (1 + rates.get(day.year, DEFAULT_RATE) / 365) ** run
        day, walked = day + timedelta(days=run), walked + run
    return 1 / grow


def yearly_rates(series: DataFrame) -> DataFrame:
    """Mean yearly rate (percent / 100) of a macro series (date text of any layout, value)."""
    from pricelattice.functions.dates import any_date

    d = any_date(F.col("date"))
    return series.filter(d.isNotNull()).groupBy(F.year(d).alias("year")).agg((F.avg("value") / 100).alias("rate"))


def backcast(base: DataFrame, dates: DataFrame, base_month: int, noise: bool = True) -> DataFrame:
    """Base rows at each target date: price x deflation x season ratio x noise (where asked for).

    `dates` (target_date, factor) is a dimension of at most a few thousand rows, checked before it is broadcast. All days of a month
    take the factor of its earliest requested day. Rows without a price pass through unchanged.
    """
    month = F.trunc("target_date", "month")
    per_month = dates.groupBy(month.alias("_m")).agg(F.min_by("factor", "target_date").alias("_f"))
    dim = dates.select("target_date", month.alias("_m")).join(per_month, "_m")
    if dates.limit(20_001).count() > 20_000:
        raise ValueError("more than 20000 target dates: split the run")
    # A title's twelve multipliers against the base month's are found before its row meets the dates.
    months = base.withColumn("_s", season_months(F.col("title")))
    ratios = months.withColumn("_s", F.transform("_s", lambda x: x / F.get(F.col("_s"), F.lit(base_month - 1))))
    out = ratios.crossJoin(F.broadcast(dim))
    factor = F.col("_f") * F.get(F.col("_s"), F.month("target_date") - 1)
    if noise:
        factor = factor * unit_noise(F.col("id"), F.col("depotId"), F.col("target_date"))
    price = final_price(F.col("price") * factor)
    cols = {"price": price, "unitPriceValue": price, "unitPrice": price_label(price), "indexTime": F.date_format("target_date", "dd.MM.yyyy '08:00'")}
    for name, c in cols.items():
        out = out.withColumn(f"_new_{name}", c)
    for name in cols:
        new = F.col(f"_new_{name}")
        out = out.withColumn(name, F.when(F.col("_new_price").isNotNull(), new).otherwise(F.col(name) if name in base.columns else F.lit(None)))
    return out.withColumn("_synthetic", F.lit(True)).drop(*[f"_new_{n}" for n in cols], "_m", "_f", "_s")
