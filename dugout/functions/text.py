"""Small string helpers used by every parser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters counted as blank: ASCII blanks, no-break space, ideographic space.
BLANK = r"[\s\u00a0\u3000]"


def strip(text: Column) -> Column:
    """Trim every kind of blank; ``trim`` removes only U+0020. Clean text is not rewritten."""
    edged = text.rlike(f"^{BLANK}|{BLANK}$")
    return F.when(edged, F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")).otherwise(text)


def is_blank(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True)) | ~text.rlike(r"[^\s\u00a0\u3000]")


def counter(value: Column) -> Column:
    """Box-score number: absent or blank is zero, junk is NULL (the game is then quarantined).

    What is a number as it stands needs no look at its blanks.
    """
    text = value.cast("string")
    return F.coalesce(text.try_cast("int"), F.when(is_blank(text), F.lit(0)).otherwise(strip(text).try_cast("int")))
