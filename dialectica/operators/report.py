"""Summaries and readable reports of examples and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.functions import text


def sentiment(history: Column) -> tuple[Column, Column, Column]:
    """Numbers of liked (4 or more), disliked (2 or less, also missing) and neutral (3) history items."""
    stars = F.transform(text.items_present(history), lambda h: F.coalesce(h.user_stars, F.lit(0.0)))
    count = lambda f: F.coalesce(F.size(F.filter(stars, f)), F.lit(0))
    return count(lambda s: s >= 4), count(lambda s: s <= 2), count(lambda s: s == 3)


def example_summary(examples: DataFrame, first: int | None = None) -> DataFrame:
    """One row: averages over the examples (or over the first ones by idx); a rating that is neither liked nor disliked is neutral."""
    df = examples.orderBy("idx").limit(first) if first is not None else examples
    good, bad, neutral = sentiment(F.col("history"))
    stars = F.coalesce("target_item.user_target_stars", F.lit(0.0))
    size = F.coalesce(F.size(text.items_present(F.col("history"))), F.lit(0))
    length = F.length(F.coalesce("target_item.target_review_text", F.lit("")))
    return df.agg(
        F.count("*").alias("n"), F.avg(F.greatest(size, F.lit(0))).alias("avg_history"), F.avg(length).alias("avg_target_length"), F.min(length).alias("min_target_length"), F.max(length).alias("max_target_length"),
        F.count_if(stars >= 4).alias("targets_positive"), F.count_if(stars <= 2).alias("targets_negative"), F.count_if((stars < 4) & (stars > 2)).alias("targets_neutral"),
        F.avg(F.greatest(good, F.lit(0))).alias("avg_positive"), F.avg(F.greatest(bad, F.lit(0))).alias("avg_negative"), F.avg(F.greatest(neutral, F.lit(0))).alias("avg_neutral"),
    )


def filter_records(records: DataFrame, only: str = "all") -> DataFrame:
    """all, valid or invalid records; records without a verdict are in neither of the last two."""
    if only not in ("all", "valid", "invalid"):
        raise ValueError(only)
    return records if only == "all" else records.filter(F.col("validation.is_valid") == (only == "valid"))


def validity_counts(records: DataFrame) -> DataFrame:
    v = F.col("validation.is_valid")
    return records.agg(F.count("*").alias("n"), F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"))


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def scored_report(scored: Column, show_prompt: bool = False, show_raw: bool = False) -> Column:
    """The readable form of scored arguments."""
    shown = [("ID", "id"), ("Type", "arg_type"), ("Text", "text"), ("Evidence", "evidence"), ("LLM score", "llm_score"), ("LLM reason", "llm_score_reason"), ("MF score", "mf_score"), ("Combined score", "combined_score")]
    shown += [("Scoring prompt", "llm_scoring_prompt")] * show_prompt + [("Scoring answer", "llm_scoring_raw_output")] * show_raw
    one = lambda a: F.concat_ws("\n", *(F.concat(F.lit(f"  {label}: "), _or_none(F.array_join(a[k], "; ") if k == "evidence" else a[k])) for label, k in shown))
    return F.concat(F.lit("Scored arguments:\n"), F.coalesce(F.nullif(F.array_join(F.transform(scored, one), "\n\n"), F.lit("")), F.lit("None")))


def record_report(records: DataFrame, show_prompt: bool = False, show_raw: bool = False, show_parsed: bool = False, show_scores: bool = False, show_llm_prompt: bool = False, show_llm_raw: bool = False) -> DataFrame:
    """index and report: the readable form of each record. show_parsed and show_scores need parsed_json (VARIANT), scoring and scored_arguments."""
    e = F.array_join(F.transform("validation.errors", lambda x: F.concat(F.lit("  - "), x.code, F.lit(": "), x.message)), "\n")
    parts = [
        F.concat(F.lit("Index: "), _or_none(F.col("index"))), F.concat(F.lit("User: "), _or_none(F.col("user_id"))), F.concat(F.lit("Target: "), _or_none(F.col("target_name"))),
        F.concat(F.lit("Valid: "), F.coalesce(F.initcap(F.col("validation.is_valid").cast("string")), F.lit("None"))),
    ]
    if show_scores:
        parts.append(F.when(F.col("scoring").isNotNull(), F.concat(F.lit("Scoring: "), F.to_json("scoring"))))
    parts.append(F.when(F.size("validation.errors") > 0, F.concat(F.lit("Errors:\n"), e)))
    if show_prompt:
        parts.append(F.concat(F.lit("Prompt:\n"), _or_none(F.col("prompt"))))
    if show_parsed:
        parts.append(F.concat(F.lit("Parsed JSON:\n"), F.coalesce(F.to_json("parsed_json"), F.lit("None"))))
    if show_scores:
        parts.append(scored_report(F.col("scored_arguments"), show_llm_prompt, show_llm_raw))
    if show_raw:
        parts.append(F.concat(F.lit("Raw output:\n"), _or_none(F.col("raw_output"))))
    return records.select("index", F.concat_ws("\n", *parts).alias("report"))
