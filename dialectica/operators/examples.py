"""Leave-one-out examples from reviews and businesses.

Order is always explicit: reviews carry `ord`, businesses `snapshot_at`; ties of a date are broken by `ord`.

Defined results: reviews with null user, business, stars or text are left out; a null date counts as ''; of a business
that comes several times, the last one that passes the category filter counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialectica.functions import text

CATEGORY, LEAST_LENGTH, LEAST_REVIEWS, MOST_REVIEWS, HISTORY, SAMPLE, SEED = "Restaurants", 30, 5, 50, 5, 100, 42


def clean_businesses(raw: DataFrame, category: str = CATEGORY, order: str = "snapshot_at") -> DataFrame:
    """Businesses of one category: categories split and stripped, null attributes and names made empty, one row for each id."""
    df = raw.withColumn("categories", text.split_categories(F.col("categories"))).filter(F.array_contains("categories", category))
    row = F.struct(
        F.coalesce("name", F.lit("")).alias("name"), "categories",
        F.coalesce("attributes", F.expr("cast(map() as map<string,string>)")).alias("attributes"), "stars", "review_count",
    )
    return df.groupBy("business_id").agg(F.max_by(row, order).alias("b")).select("business_id", "b.*")


def filter_reviews(raw: DataFrame, businesses: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Reviews of the businesses with at least least_length characters, as user_id, business_id, user_stars, review_text, date, ord."""
    stripped = text.strip(F.col("text"))
    df = raw.filter((F.length(stripped) >= least_length) & F.col("user_id").isNotNull() & F.col("stars").isNotNull())
    df = df.join(businesses.select("business_id").distinct(), "business_id", "left_semi")
    return df.select("user_id", "business_id", F.col("stars").alias("user_stars"), stripped.alias("review_text"), F.coalesce("date", F.lit("")).alias("date"), "ord")


def user_activity(reviews: DataFrame, least: int = LEAST_REVIEWS, most: int = MOST_REVIEWS) -> DataFrame:
    """user_id and n of users with least to most reviews, both included."""
    return reviews.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))


def sample_users(activity: DataFrame, size: int = SAMPLE, seed: int = SEED, history: int = HISTORY) -> DataFrame:
    """Up to size users in seeded pseudorandom order; only then those without enough reviews for a history are dropped."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), "user_id"))
    return eligible_users(activity.orderBy(key, "user_id").limit(size), history)


def eligible_users(activity: DataFrame, history: int = HISTORY) -> DataFrame:
    """All users with enough reviews for a history and a target."""
    return activity.filter(F.col("n") >= history + 1)


def bucket(stars: Column) -> Column:
    """0 for a liked, 1 for a disliked, 9 for any other rating."""
    return F.when(stars >= 4, 0).when(stars <= 2, 1).otherwise(9)


def split_history(reviews: DataFrame, size: int = HISTORY, per_bucket: int = 2) -> DataFrame:
    """Reviews with role: target (rn = 1) or history with pos 1 .. size, as chosen by the leave-one-out rule.

    The latest review is the target; of the rest the latest per_bucket liked and disliked ones are taken, and the
    latest others, without repeats of (business, date, text), fill up to size. One shuffle by user serves all windows.
    """
    user = Window.partitionBy("user_id")
    latest = (F.col("date").desc(), F.col("ord").desc())
    df = reviews.withColumn("rn", F.row_number().over(user.orderBy(*latest))).withColumn("bucket", F.when(F.col("rn") > 1, bucket(F.col("user_stars"))).otherwise(-1))
    df = df.withColumn("brn", F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("rn")))
    df = df.withColumn("sel", F.col("bucket").isin(0, 1) & (F.col("brn") <= per_bucket))
    same = Window.partitionBy("user_id", "business_id", "date", "review_text")
    pool = F.when(F.col("rn") > 1, F.col("rn"))
    df = df.withColumn("ksel", F.max(F.col("sel").cast("int")).over(same) == 1).withColumn("first", F.min(pool).over(same) == F.col("rn"))
    df = df.withColumn("ns", F.sum(F.col("sel").cast("int")).over(user)).withColumn("cand", (F.col("rn") > 1) & ~F.col("ksel") & F.col("first"))
    df = df.withColumn("frn", F.row_number().over(Window.partitionBy("user_id", "cand").orderBy("rn")))
    df = df.withColumn("fill", F.col("cand") & (F.col("frn") <= size - F.col("ns")))
    df = df.filter((F.col("rn") == 1) | F.col("sel") | F.col("fill"))
    group = F.when(F.col("rn") == 1, -1).when(F.col("fill"), 2).otherwise(F.col("bucket"))
    within = F.when(group == 2, F.col("rn")).otherwise(-F.col("rn"))
    df = df.withColumn("role", F.when(F.col("rn") == 1, "target").otherwise("history"))
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "role").orderBy("date", group, within)))
    return df.select("user_id", "business_id", "user_stars", "review_text", "date", "ord", "role", "pos")


def build_examples(reviews: DataFrame, businesses: DataFrame, users: DataFrame) -> DataFrame:
    """One example for each user: history array and target_item. A business that is missing drops the whole user."""
    chosen = reviews.join(users.select("user_id"), "user_id", "left_semi")
    parts = split_history(chosen).join(businesses, "business_id", "left")
    item = F.struct("pos", F.struct("business_id", "name", "categories", "attributes", "user_stars", "review_text").alias("item"))
    target = F.struct(
        "business_id", "name", "categories", "attributes", F.col("stars").alias("global_stars"), "review_count",
        F.col("user_stars").alias("user_target_stars"), F.col("review_text").alias("target_review_text"),
    )
    df = parts.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "history", item)), lambda a, b: a.pos - b.pos), lambda x: x["item"]).alias("history"),
        F.max_by(F.when(F.col("role") == "target", target), F.when(F.col("role") == "target", 1)).alias("target_item"),
        F.count_if(F.col("name").isNull()).alias("missing"),
    )
    return df.filter("missing = 0").drop("missing")


def once(examples: DataFrame, key: str = "idx", order: str = "ingested_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """Examples delivered several times, once: the first delivery; rows of a null key count as one.

    Rows of one key and time are one delivery, of which any row may stay; where they can differ, `ties` names the columns that decide (the least values first).

    A rank with a limit of 1 is cut down before the shuffle, and columns that aren't used behind it aren't read.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), *ties)
    return examples.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
