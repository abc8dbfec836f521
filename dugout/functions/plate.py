"""Plate-appearance codes of the box score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PLATE_CLASSES = (
    "K", "BB", "HBP", "GDP", "GO", "SACBUNT", "BUNT_OUT", "FO", "SACFLY", "LD",
    "REACH_ERROR", "HR", "1B", "2B", "3B",
)


def hit_class(code: Column) -> Column:
    """Bases of a hit code; a code nobody knows counts as a single."""
    return (
        F.when(code.endswith("안"), "1B")
        .when(code.endswith("2"), "2B")
        .when(code.endswith("3"), "3B")
        .otherwise("1B")
    )


def plate_class(code: Column) -> Column:
    """Class of one code; no code, no class. The order of the branches is the rule."""
    sacrifice = code.contains("희")
    return (
        F.when(code.isNull(), F.lit(None).cast("string"))
        .when(code == "삼진", "K")
        .when(code == "4구", "BB")
        .when(code == "사구", "HBP")
        .when(code.contains("병"), "GDP")
        .when(code.endswith("땅"), F.when(sacrifice, "SACBUNT").otherwise("GO"))
        .when(code.endswith("번"), F.when(sacrifice, "SACBUNT").otherwise("BUNT_OUT"))
        .when(code.endswith("비") | code.endswith("파"), F.when(sacrifice, "SACFLY").otherwise("FO"))
        .when(code.endswith("직"), "LD")
        .when(code.contains("실"), "REACH_ERROR")
        .when(code.endswith("홈"), "HR")
        .otherwise(hit_class(code))
    )


def plate_codes(slots: Column) -> Column:
    """Slots to single codes: a slot may hold two appearances joined by a slash."""
    filled = F.filter(slots, lambda s: s.isNotNull() & (s != ""))
    parts = F.flatten(F.transform(filled, lambda s: F.split(s, "/")))
    return F.filter(parts, lambda p: p != "")


def plate_classes(slots: Column) -> Column:
    return F.transform(plate_codes(slots), plate_class)


def class_count(classes: Column, name: str) -> Column:
    return F.coalesce(F.size(F.filter(classes, lambda c: c == name)), F.lit(0))


def fielding_chars(pos: Column) -> Column:
    """Fielding letters of a position string, in order; other letters are dropped."""
    from dugout.model import FIELD_CHARS

    return F.filter(
        F.split(F.coalesce(pos, F.lit("")), ""), lambda c: c.isin(*FIELD_CHARS)
    )


def position_of_char(char: Column) -> Column:
    from dugout.model import FIELD_CHARS

    out = None
    for letter, position in FIELD_CHARS.items():
        out = F.when(char == letter, position) if out is None else out.when(char == letter, position)
    return out
