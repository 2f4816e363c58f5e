"""Product names: raw market names to a standard name and category by an alias table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: category of names that no alias knows.
OTHER = "Diğer"


def alias_key(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def capitalised(c: Column) -> Column:
    """Every run of letters with a capital first, all else as it is: '(salkım) a' -> '(Salkım) A'."""
    runs = F.regexp_extract_all(F.trim(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def standard_product(raw: Column, aliases: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(name, category) by `aliases` of (alias, name, category), a table of some hundred rows.

    The alias that equals the key wins; then the first in the table's order that is part of the key or holds it; a name without alias keeps
    its letters, capitalised, as OTHER. A blank name is part of every alias. A null name has no name and is OTHER.
    """
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name"), F.lit(c).alias("category")) for a, n, c in aliases])
    key = alias_key(raw)
    same = F.get(F.filter(table, lambda r: r["alias"] == key), F.lit(0))
    part = F.get(F.filter(table, lambda r: key.contains(r["alias"]) | r["alias"].contains(key)), F.lit(0))
    hit = F.coalesce(same, part)
    return F.coalesce(hit["name"], capitalised(raw)), F.coalesce(hit["category"], F.lit(OTHER))
