"""Running tag counts over a stream of annotated examples. Optional: the batch operators give the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_counts(examples: DataFrame, time: str = "loaded_at", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Tokens and examples per language, tag and window of a stream with lang, gloss_tags and a time column."""
    tags = F.filter("gloss_tags", lambda t: t.isNotNull() & (t != ""))
    once = examples.withWatermark(time, late).select("lang", time, F.explode(tags).alias("tag"))
    return once.groupBy(F.window(time, window).alias("w"), "lang", "tag").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "lang", "tag", "cnt")
