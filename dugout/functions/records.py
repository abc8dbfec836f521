"""Special-record strings: ``name(3회)`` lists and home-run lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Record kinds and the counter each feeds.
RECORD_KINDS = {
    "실책": "E", "폭투": "WP", "도루자": "CS", "보크": "BK", "견제사": "PICKOFF", "홈런": "HR",
}
# Record formats.
NAME_INNING = r"([^\s()]+)\((\d+)회\)"
HOME_RUN_ITEM = r"([^\d\s()]+)((?:\d+호)+)\(([^()]*)\)"
HOME_RUN_SINGLE = r"^(.+?)(\d+)호\((\d+)회(\d+)점\s*(.*?)\)$"
GRAND_SLAM_MARK = "4점"


def name_innings(result: Column) -> Column:
    names = F.regexp_extract_all(result, F.lit(NAME_INNING), F.lit(1))
    innings = F.regexp_extract_all(result, F.lit(NAME_INNING), F.lit(2))
    return F.transform(
        F.arrays_zip(names.alias("name"), innings.alias("inn")),
        lambda x: F.struct(x["name"].alias("name"), x["inn"].try_cast("int").alias("inn")),
    )


def grand_slam_names(result: Column) -> Column:
    """Distinct names whose home-run item holds a four-run shot, sorted."""
    names = F.regexp_extract_all(result, F.lit(HOME_RUN_ITEM), F.lit(1))
    blobs = F.regexp_extract_all(result, F.lit(HOME_RUN_ITEM), F.lit(3))
    items = F.filter(
        F.arrays_zip(names.alias("name"), blobs.alias("blob")),
        lambda x: x["blob"].contains(GRAND_SLAM_MARK),
    )
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: x["name"])))


def grand_slam_names_single(result: Column) -> Column:
    """The earlier reading of the same text: one item for the whole string."""
    whole = result.rlike(HOME_RUN_SINGLE) & (F.regexp_extract(result, HOME_RUN_SINGLE, 4) == "4")
    name = F.trim(F.regexp_extract(result, HOME_RUN_SINGLE, 1))
    return F.when(whole, F.array(name)).otherwise(F.array().cast("array<string>"))
