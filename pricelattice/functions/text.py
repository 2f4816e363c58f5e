"""String functions. Everything stays in whole-stage codegen; no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors to the base unit (kg, lt, adet).
UNIT_FACTORS = {"gr": ("kg", 0.001), "g": ("kg", 0.001), "kg": ("kg", 1.0), "ml": ("lt", 0.001), "cl": ("lt", 0.01), "lt": ("lt", 1.0), "l": ("lt", 1.0), "adet": ("adet", 1.0)}


def norm_key(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank. Dotted and dotless I fold to i first, so JVM locale never matters."""
    return F.regexp_replace(F.trim(F.lower(F.translate(c, "İI", "ii"))), r"\s+", " ")


def plain_key(c: Column) -> Column:
    """norm_key without locale folding: plain lower()."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def title_case(c: Column) -> Column:
    return F.initcap(c)


def decimal_comma(c: Column) -> Column:
    """'1.234,50' -> 1234.5, '12,5' -> 12.5, '12.5' -> 12.5; null when it is no number."""
    s = F.trim(c)
    return F.when(s.contains(","), F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(s).try_cast("double")


def csv_field_double(c: Column, i: int = 0) -> Column:
    """Field i of a comma list as double, null when empty or not a number."""
    return F.get(F.split(c, ","), F.lit(i)).try_cast("double")


def price_label(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f ₺/Kg", c))


def path_safe(c: Column) -> Column:
    return F.translate(c, " /", "_-")


def split_composite(c: Column) -> tuple[Column, Column]:
    """'City_District_x' -> (City, District_x): cut at the first underscore."""
    parts = F.split(c, "_", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def unit_of(c: Column) -> tuple[Column, Column, Column]:
    """(quantity, base unit, quantity in base units) of the first '500 gr' or '1,5 lt' in a title."""
    pat = r"(?i)(\d+(?:[.,]\d+)?)\s*(adet|gr|kg|ml|cl|lt|g|l)\b"
    qty = F.regexp_replace(F.nullif(F.regexp_extract(c, pat, 1), F.lit("")), ",", ".").try_cast("double")
    unit = F.lower(F.nullif(F.regexp_extract(c, pat, 2), F.lit("")))
    base = F.create_map(*[F.lit(x) for k, (b, _) in UNIT_FACTORS.items() for x in (k, b)])
    factor = F.create_map(*[F.lit(x) for k, (_, f) in UNIT_FACTORS.items() for x in (k, f)])
    return qty, base[unit], qty * factor[unit]


def per_base_unit(price: Column, title: Column) -> Column:
    """12.00 for '500 gr' -> 24.00 per kg."""
    q = unit_of(title)[2]
    return F.when(q > 0, price / q)


def price_range(c: Column) -> tuple[Column, Column]:
    """'79,00 - 164,90' -> (79.0, 164.9); one value stands for both ends."""
    parts = F.split(c, r"\s+-\s+")
    lo = decimal_comma(F.get(parts, F.lit(0)))
    return lo, F.coalesce(decimal_comma(F.get(parts, F.lit(1))), lo)


def like_any(c: Column, patterns: list[str]) -> Column:
    """OR of LIKE patterns; '_' and '%' keep their wildcard meaning."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.like(p)
    return out


def first_rule(c: Column, rules: list[tuple[list[str], object]], default: object = None) -> Column:
    """Value of the first rule of which any keyword is part of c. A chained CASE: no join, no shuffle."""
    out = None
    for words, value in rules:
        hit = None
        for w in words:
            hit = c.contains(w) if hit is None else hit | c.contains(w)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def nonempty_items(c: Column, sep: str = ";") -> Column:
    return F.filter(F.split(c, sep), lambda x: x != "")


def join_items(c: Column, sep: str = ", ", empty_as_null: bool = True) -> Column:
    joined = F.concat_ws(sep, c)
    return F.when(F.size(c) > 0, joined) if empty_as_null else F.coalesce(joined, F.lit(""))
