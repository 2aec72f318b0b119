"""The failure log and track exports as streams: the batch results, kept up to date.

The engine's operators are batch operators; these two follow an appended source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def reason_union_stream(lines: DataFrame, line: str, at: str) -> DataFrame:
    """(url, reasons, n): the different reasons of every url so far; for output mode 'update' or 'complete'."""
    parsed = lines.select(T.log_url(F.col(line)).alias("url"), T.log_reason(F.col(line)).alias("reason"), F.col(at).alias("at")).filter("url <> ''")
    reasons = F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason"))))
    return parsed.groupBy("url").agg(reasons.alias("reasons"), F.count("*").alias("n"))


def new_tracks_stream(rows: DataFrame, at: str, delay: str = "30 days") -> DataFrame:
    """The first row of every track id; state older than ``delay`` is let go, so a later copy may come again."""
    return rows.filter(F.trim("track_id") != "").withWatermark(at, delay).dropDuplicatesWithinWatermark(["track_id"])


def late_counts_stream(rows: DataFrame, at: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Rows and tracks per window of export time, with late rows up to ``delay``."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, width)).agg(F.count("*").alias("n_rows"), F.approx_count_distinct("track_id").alias("n_tracks"))
