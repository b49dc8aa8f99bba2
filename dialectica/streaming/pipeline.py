"""Structured Streaming forms of row-wise operators and of windowed counts (an addition: batch is the main form).

The row-wise operators hold no state, so a stream of records needs only the same expressions; deliveries that come
twice within the watermark are dropped by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.functions import json, text
from dialectica.operators import validate


def once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once among rows that arrive within delay of each other."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def validated(records: DataFrame, examples: DataFrame) -> DataFrame:
    """A stream of records against a static table of examples: parsed and errors for each record."""
    names = examples.select(F.col("idx").alias("index"), validate.known_names(F.col("history"), F.col("target_item")).alias("names"))
    df = records.join(names, "index", "left").withColumn("parsed", json.extract_object(F.col("raw_output")))
    return df.withColumn("errors", validate.errors(F.col("parsed"), F.coalesce("names", F.expr("cast(array() as array<string>)")))).drop("names")


def prompts(examples: DataFrame) -> DataFrame:
    return examples.select("idx", text.argument_prompt(F.col("history"), F.col("target_item")).alias("prompt"))


def error_rates(checked: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Records and invalid records in tumbling windows; late rows count until the watermark has passed."""
    w = F.window(time, window)
    return checked.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count("*").alias("records"), F.count_if(F.size("errors") > 0).alias("invalid")).select("w.start", "w.end", "records", "invalid")
