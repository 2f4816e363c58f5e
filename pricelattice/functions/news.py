"""The news filter: places and themes that a row must name."""

from __future__ import annotations

import re

from pyspark.sql import Column

# Places (names and codes) and themes; '_' stands for any one character, as in LIKE.
LOCATIONS = [
    "Turkey", "TU", "Russia", "RS", "Ukraine", "UP", "Germany", "GM", "Iraq", "IZ", "Syria", "SY", "Iran", "IR", "Brazil", "BR", "Argentina", "AR",
    "Netherlands", "NL", "Spain", "SP", "Egypt", "EG",
]
THEMES = [
    "FOOD_SECURITY", "ECON_INFLATION", "ECON_COSTOFLIFE", "ECON_PRICECONTROLS", "FUELPRICES", "ENV_DROUGHT", "ECON_OILPRICE", "ENV_NATURALGAS",
    "TAX_ECON_PRICE", "AGRICULTURE", "ECON_DIESELPRICE", "WB_135_TRANSPORT", "SUPPLY_CHAIN", "NATURAL_DISASTER_FLOODS", "ENV_CLIMATECHANGE",
    "NATURAL_DISASTER_EXTREME_WEATHER", "ECON_CURRENCY_EXCHANGE_RATE", "ECON_INTEREST_RATES", "TAX_FOODSTAPLES_WHEAT", "TAX_FOODSTAPLES_MEAT",
    "WB_175_FERTILIZERS", "UNEMPLOYMENT", "WB_2670_JOBS", "TAX_DISEASE_OUTBREAK", "SMUGGLING", "CORRUPTION", "BLOCKADE", "SANCTIONS",
]


def names_any(c: Column, parts: list[str]) -> Column:
    """Whether any part stands in the text: one alternation, read once, in place of a LIKE for each."""
    return c.rlike("(?s)" + "|".join(re.escape(p).replace("_", ".") for p in parts))


def wanted(locations: Column, themes: Column) -> Column:
    return names_any(locations, LOCATIONS) & names_any(themes, THEMES)
