"""Package sizes in product names: mass, volume and count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.text import fold

# Units and what one of them weighs, holds or counts.
MASS = {"kilogramos": 1000.0, "kilogramo": 1000.0, "kilos": 1000.0, "kilo": 1000.0, "kg": 1000.0, "gramos": 1.0, "gramo": 1.0, "grs": 1.0, "gr": 1.0, "g": 1.0, "libras": 453.592, "libra": 453.592, "lbs": 453.592, "lb": 453.592, "onzas": 28.3495, "onza": 28.3495, "oz": 28.3495}
VOLUME = {"litros": 1000.0, "litro": 1000.0, "lts": 1000.0, "lt": 1000.0, "l": 1000.0, "ml": 1.0, "cc": 1.0}
COUNT = dict.fromkeys("capsulas capsula caps cap comprimidos comprimido tabletas tableta tabs tab softgels softgel perlas perla sobres sobre sachets sachet porciones porcion servicios servicio servings serving unidades unidad barras barra".split(), 1.0)
DOSE = {"mg": 0.0}  # never a package size

_UNITS = sorted([*MASS, *VOLUME, *COUNT, *DOSE], key=lambda u: (-len(u), u))
MEASURE = rf"(\d+(?:[.,]\d+)?)\s*({'|'.join(_UNITS)})\b"


def _number(raw: Column) -> Column:
    """Three digits after a separator are thousands, unless only a zero stands before it."""
    plain = F.replace(raw, F.lit(","), F.lit("."))
    thousands = plain.rlike(r"^\d+\.\d{3}$") & ~plain.startswith("0.")
    return F.when(thousands, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain).try_cast("double")


def package(name: Column) -> Column:
    """struct<family, amount>: the largest size named; a count beats a mass, a mass a volume."""
    text = fold(name)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(MEASURE), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(MEASURE), F.lit(2)).alias("u"))

    def largest(units: dict[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
        amounts = F.transform(found, lambda m: F.coalesce(_number(m["n"]) * F.element_at(table, m["u"]), F.lit(0.0)))
        return F.coalesce(F.array_max(amounts), F.lit(0.0))

    count, mass, volume = largest(COUNT), largest(MASS), largest(VOLUME)
    pair = lambda family, amount: F.struct(F.lit(family).alias("family"), amount.alias("amount"))
    return F.when(count > 0, pair("count", count)).when(mass > 0, pair("mass", mass)).when(volume > 0, pair("volume", volume)).otherwise(pair("unknown", F.lit(0.0)))
