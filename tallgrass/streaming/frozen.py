"""Scoring and labelling of streams with statistics and thresholds frozen on a finished cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.labels import immune_states
from tallgrass.operators.scores import apply_wide


def score_stream(stream: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise wide rows as they come; ``stats`` is the static row of ``fit_wide``. A stateless map: no watermark is needed."""
    return apply_wide(stream, stats, columns)


def label_stream(stream: DataFrame, thresholds: DataFrame, infiltration: str, cytotoxic: str, dysfunction: str, exclusion: str) -> DataFrame:
    return immune_states(stream, thresholds, infiltration, cytotoxic, dysfunction, exclusion)


def windowed_states(labelled: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, state, n) by event time. ``time`` may be a timestamp without zone, which watermarks reject; it is cast."""
    timed = labelled.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("window"), "state").agg(F.count("*").alias("n"))
