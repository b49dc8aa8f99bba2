"""Sinks: JSON lines in order, split outputs, CSV, small JSON files, HTML pages. All paths may be on any file system that Spark reaches."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectica.session import materialize


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file, through the session's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()


def json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """A folder of JSON-lines files; with order, sorted by it across the files."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def split_paths(path: str) -> dict[str, str]:
    """The paths of all, valid and invalid records and of the summary."""
    stem, suffix = os.path.splitext(path)
    suffix = suffix or ".jsonl"
    return {"all": stem + suffix, "valid": f"{stem}_valid{suffix}", "invalid": f"{stem}_invalid{suffix}", "summary": f"{stem}_summary.json"}


def split_records(records: DataFrame, path: str, **more) -> dict[str, str]:
    """Writes all, valid and invalid records and a summary. The records are sorted once and kept; filters keep their order."""
    paths = split_paths(path)
    valid = F.col("validation.is_valid")
    ordered = materialize(records.orderBy("index"))
    json_lines(ordered, paths["all"])
    json_lines(ordered.filter(valid), paths["valid"])
    json_lines(ordered.filter(~valid), paths["invalid"])
    n = ordered.agg(F.count("*").alias("num_examples"), F.count_if(valid).alias("num_valid"), F.count_if(~valid).alias("num_invalid"))
    codes = ordered.select(F.explode("validation.errors").alias("e")).groupBy("e.code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")
    summary(n, paths["summary"], error_counts={r.code: r.n for r in codes.collect()}, **more)
    return paths


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def summary(one_row: DataFrame, path: str, **more) -> None:
    """A one-row frame as a pretty JSON file."""
    write_text(one_row.sparkSession, path, json.dumps(one_row.first().asDict(recursive=True) | more, ensure_ascii=False, indent=2))


#: Pages in one folder of `pages`.
RANGE = 10_000


def pages(html: DataFrame, path: str) -> None:
    """Pages as lines of text (index, a tab, the page), in folders by ranges of RANGE indexes; line breaks within a page are written as character references."""
    flat = F.replace(F.replace("html", F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    df = html.select(F.floor(F.col("index") / RANGE).alias("range"), F.concat(F.col("index").cast("string"), F.lit("\t"), flat).alias("value"))
    df.write.mode("overwrite").partitionBy("range").text(path)


def page(html: DataFrame, path: str) -> None:
    """The one page of a frame as an HTML file."""
    write_text(html.sparkSession, path, html.select("html").first()[0])
