"""Price parsers. Four dialects read separators differently and stay apart under their own names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = r"(?i)\b(nan|null|undefined|none)\b"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _without(text: Column, *marks: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def _decimal_comma(text: Column) -> Column:
    return F.replace(_without(text, "."), F.lit(","), F.lit("."))


def _between(text: Column, below: float | None) -> Column:
    value = text.try_cast("double")
    return F.when((value > 0) & (value < below if below else F.lit(True)), value)


def local_price(raw: Column) -> Column:
    """Catalog dialect: three digits after a single dot are thousands; 0 < price < 10^8."""
    digits = F.regexp_replace(raw, "[^0-9.,]", "")
    dots, commas = _count(digits, "."), _count(digits, ",")
    tail = F.length(digits) - F.instr(digits, ".")
    text = (
        F.when(commas == 1, _decimal_comma(digits))
        .when((dots == 1) & (commas == 0), F.when(tail <= 2, digits).otherwise(_without(digits, ".")))
        .otherwise(_without(digits, ".", ","))
    )
    return F.when(~raw.rlike(INVALID), _between(text, 1e8))


def listing_price(raw: Column) -> Column:
    """Listing-page dialect: several commas are thousands too; no upper bound."""
    digits = F.regexp_replace(raw, "[^0-9.,]", "")
    dots, commas = _count(digits, "."), _count(digits, ",")
    tail = F.length(digits) - F.instr(digits, ".")
    text = (
        F.when((dots > 0) & (commas > 0), _decimal_comma(digits))
        .when(commas == 1, F.replace(digits, F.lit(","), F.lit(".")))
        .when(commas > 1, _without(digits, ","))
        .when((dots > 1) | ((dots == 1) & (tail == 3)), _without(digits, "."))
        .otherwise(digits)
    )
    return _between(text, None)


def tech_price(raw: Column) -> Column:
    """Electronics dialect: one comma is decimal, all else thousands; 0 < price < 2 * 10^8."""
    digits = F.regexp_replace(raw, "[^0-9.,]", "")
    return _between(F.when(_count(digits, ",") == 1, _decimal_comma(digits)).otherwise(_without(digits, ".", ",")), 2e8)


def shop_price(raw: Column) -> Column:
    """Shop-plugin dialect: two digits after the last separator are decimals, all else thousands."""
    text = F.regexp_replace(F.regexp_replace(raw, "[A-Za-z$€£]", ""), r"\s+", "")
    mark = F.substring(text, -3, 1)
    read = (
        F.when(text.rlike(r"[.,]\d{2}$") & (mark == ","), _decimal_comma(text))
        .when(text.rlike(r"[.,]\d{2}$") & (_count(text, ".") == 1), _without(text, ","))
        .when(text.rlike(r"[.,]\d{2}$"), _decimal_comma(text))
        .otherwise(_without(text, ".", ","))
    )
    return _between(read, None)


def unit_price(price: Column, units: Column) -> Column:
    return price / F.greatest(F.coalesce(units, F.lit(1)), F.lit(1))


def discount_pct(price: Column, original: Column) -> Column:
    """Percent off the original price; null if that is unknown."""
    return (original - price) / F.nullif(original, F.lit(0.0)) * 100


def present_value(price: Column, surcharge_pct: Column, instalments: Column, monthly: Column) -> Column:
    """Worth today of the instalments for a price with a surcharge."""
    each = price * (1 + surcharge_pct / 100.0) / instalments
    return F.aggregate(F.sequence(F.lit(1), instalments), F.lit(0.0), lambda total, k: total + each / F.pow(1 + monthly, k))


def financing(price: Column, surcharge_pct: Column, instalments: Column, monthly: Column) -> Column:
    """(signal, saving %, present value, instalment) of buying in instalments against paying cash."""
    valid = (price > 0) & (instalments > 0) & (surcharge_pct > -100) & (monthly > -1)
    worth = present_value(price, surcharge_pct, instalments, monthly)
    saving = (price - worth) / price * 100.0
    signal = F.when(saving > 5.0, "conviene_cuotas").when(saving < -5.0, "conviene_contado").otherwise("indistinto")
    found = F.struct(signal.alias("signal"), saving.alias("saving_pct"), worth.alias("present_value"), (price * (1 + surcharge_pct / 100.0) / instalments).alias("instalment"))
    none = F.struct(F.lit("sin_datos").alias("signal"), F.lit(0.0).alias("saving_pct"), F.lit(0.0).alias("present_value"), F.lit(0.0).alias("instalment"))
    return F.when(valid, found).otherwise(none)
