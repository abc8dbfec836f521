"""Live days.

A line can arrive late, out of order or corrected, and a line's credit depends on everything
before it. So the unit of work is a whole day: each micro-batch is kept in the line store
(``linestore.py``), which gives back the lines of the days it touched, and those days are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dugout.streaming.linestore import LINES

LANDED_LINES = LINES + ", game_date DATE"


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(LANDED_LINES).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
