"""Wholesale price history from a base year: price index, place, harvest season, noise. The retail model's rules have no part in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.numeric import final_price, unit_noise
from pricelattice.functions.text import first_rule
from pricelattice.operators.pricing import WHOLESALE_INDEX

# Factors by month that are known of a product group; months between lie on straight lines, around the year.
ANCHORS: list[tuple[list[str], dict[int, float]]] = [
    (["domates", "patlıcan", "biber"], {7: 0.65, 1: 1.30}),
    (["karpuz", "kavun"], {7: 0.58, 1: 1.50, 2: 1.50}),
    (["çilek"], {5: 0.70, 6: 0.70, 12: 1.50, 1: 1.50}),
    (["kiraz"], {5: 0.80, 6: 0.80, 12: 1.50, 1: 1.50, 2: 1.50}),
    (["portakal", "mandalina"], {12: 0.80, 1: 0.80, 7: 1.35}),
    (["üzüm"], {7: 0.68, 8: 0.68, 12: 1.50, 1: 1.50, 2: 1.50}),
    (["elma", "armut"], {10: 0.78, 11: 0.78, 7: 1.18}),
]
# Least and greatest factor of vegetables and of fruit by region, and the cities named for it.
REGIONS: dict[str, tuple[tuple[float, float], tuple[float, float], list[str]]] = {
    "akdeniz": ((0.78, 0.82), (0.85, 0.88), ["antalya", "adana", "mersin"]),
    "ege": ((0.85, 0.88), (0.87, 0.90), ["izmir", "manisa", "aydın"]),
    "marmara": ((0.95, 1.00), (0.95, 1.00), ["istanbul", "bursa", "kocaeli"]),
    "güneydoğu": ((0.85, 0.90), (0.90, 0.95), ["gaziantep", "şanlıurfa"]),
    "iç anadolu": ((1.05, 1.05), (1.08, 1.08), ["ankara", "kayseri"]),
    "karadeniz": ((1.05, 1.12), (0.95, 1.08), ["trabzon", "artvin", "rize"]),
    "doğu anadolu": ((1.18, 1.22), (1.20, 1.25), ["erzurum", "van", "ağrı"]),
}
BASE_YEAR, NOISE, SEED = 2026, 0.04, 42


def curve(anchors: dict[int, float]) -> list[float]:
    """Twelve factors: the known ones, and between two of them, around the year, the straight line."""
    known = sorted(anchors)
    out = []
    for m in range(1, 13):
        before = max((k for k in known if k <= m), default=known[-1] - 12)
        after = min((k for k in known if k >= m), default=known[0] + 12)
        a, b = anchors[(before - 1) % 12 + 1], anchors[(after - 1) % 12 + 1]
        out.append(a if after == before else a + (b - a) * (m - before) / (after - before))
    return out


def folded(c: Column) -> Column:
    """Lower case by Turkish letters."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def season_months(product: Column) -> Column:
    """Twelve factors of a product, as an array; 1 for products without a known curve."""
    rule = first_rule(folded(product), [(w, i) for i, (w, _) in enumerate(ANCHORS)], -1)
    curves = F.array(*[F.array(*[F.lit(float(v)) for v in curve(a)]) for _, a in ANCHORS])
    return F.when(rule < 0, F.array_repeat(F.lit(1.0), 12)).otherwise(F.get(curves, F.greatest(rule, F.lit(0))))


def place_factor(city: Column, category: Column) -> Column:
    """Middle of the region's range for vegetables ('Sebze') or fruit ('Meyve'); 1 for other cities and categories."""
    kind = folded(category)
    out = F.lit(1.0)
    for veg, fruit, cities in REGIONS.values():
        mid = F.when(kind == "sebze", sum(veg) / 2).when(kind == "meyve", sum(fruit) / 2).otherwise(1.0)
        out = F.when(folded(city).isin(*cities), mid).otherwise(out)
    return out


def index_factor(year: Column) -> Column:
    """Price index of a year against the base year; null for years without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in WHOLESALE_INDEX.items() for x in (k, v / WHOLESALE_INDEX[BASE_YEAR])]), year)


def history(base: DataFrame, days: Column, noise: bool = True) -> DataFrame:
    """base (sehir, urun, kategori, en_dusuk, en_yuksek of the base year) at every day (tarih) of the array `days`: price x index x place x
    season x noise, at least 0.01, two digits; prices of years without an index are null. Other columns of base stay."""
    factor = place_factor(F.col("sehir"), F.col("kategori"))
    j = base.select("*", factor.alias("_p"), season_months(F.col("urun")).alias("_s")).withColumn("tarih", F.explode(days))
    f = index_factor(F.year("tarih")) * F.col("_p") * F.get(F.col("_s"), F.month("tarih") - 1)
    if noise:
        f = f * unit_noise(F.col("sehir"), F.col("urun"), F.col("tarih"), amplitude=NOISE, seed=SEED)
    priced = {c: final_price(F.col(c) * F.col("_f")) for c in ("en_dusuk", "en_yuksek")}
    return j.withColumn("_f", f).withColumns(priced).withColumn("veri_turu", F.lit("sentetik")).drop("_f", "_p", "_s")
