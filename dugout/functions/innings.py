"""Innings text to outs, for both leagues."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dugout.functions.text import BLANK, strip

# Innings formats; blanks around the text are part of the pattern.
_FRACTION = rf"^{BLANK}*(\d+)?\s*([⅓⅔])?{BLANK}*$"
_NUMBER = rf"^{BLANK}*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?{BLANK}*$"


def outs_from_fraction(inn: Column) -> Column:
    """``5 ⅔`` -> 17; decimals round half to even; anything else is 0."""
    # try_cast is slow on text that is no number, so it only sees digits
    digits = F.regexp_extract(inn, _FRACTION, 1)
    whole = F.when(digits != "", digits.try_cast("int")).otherwise(F.lit(0))
    part = F.when(inn.contains("⅓"), 1).when(inn.contains("⅔"), 2).otherwise(0)
    decimal = F.bround(strip(inn).try_cast("double") * 3).cast("int")
    return (
        F.when(F.coalesce(inn == "", F.lit(True)), F.lit(0))
        .when(inn.rlike(_FRACTION), whole * 3 + part)
        .when(inn.rlike(_NUMBER), F.coalesce(decimal, F.lit(0)))
        .otherwise(F.lit(0))
    )


def outs_from_decimal(inn: Column) -> Column:
    """``6.2`` -> 20: the digit after the point counts outs. NULL when it is not a number."""
    text = F.coalesce(inn, F.lit(""))

    def number(value: Column) -> Column:
        return F.when(value == "", F.lit(0)).otherwise(value.try_cast("int"))

    halves = F.split(text, r"\.", 2)
    return F.when(
        text.contains("."), number(halves.getItem(0)) * 3 + number(halves.getItem(1))
    ).otherwise(number(text) * 3)


def outs(inn: Column, league: str) -> Column:
    return outs_from_decimal(inn) if league == "mlb" else outs_from_fraction(inn)
