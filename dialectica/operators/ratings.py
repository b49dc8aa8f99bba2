"""Rating rows of examples, and collaborative models over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.functions.score import normalize_rating
from dialectica.session import numbered


def rating_rows(examples: DataFrame, include_target: bool = False, deduplicate: bool = True) -> DataFrame:
    """user_id, business_id, rating of history items (and targets); equal rows once, differing ratings of a pair all stay."""
    h = examples.select("user_id", F.explode("history").alias("h")).select("user_id", "h.business_id", F.col("h.user_stars").alias("rating"))
    if include_target:
        h = h.unionByName(examples.select("user_id", "target_item.business_id", F.col("target_item.user_target_stars").alias("rating")))
    h = h.filter("coalesce(user_id, '') <> '' and coalesce(business_id, '') <> '' and rating is not null")
    return h.distinct() if deduplicate else h


def rating_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("num_rows"), F.count_distinct("user_id").alias("num_users"), F.count_distinct("business_id").alias("num_items"))


def bias_model(rows: DataFrame, shrink: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row mean, item deviations, user deviations), the deviations shrunk towards 0."""
    mean = rows.agg(F.avg("rating").alias("mu"))
    centred = rows.withColumn("d", F.col("rating") - mean.scalar())
    item = centred.groupBy("business_id").agg((F.sum("d") / (shrink + F.count("*"))).alias("b_i"))
    user = centred.join(item, "business_id").groupBy("user_id").agg((F.sum(F.col("d") - F.col("b_i")) / (shrink + F.count("*"))).alias("b_u"))
    return mean, item, user


def bias_predictions(rows: DataFrame, examples: DataFrame, shrink: float = 5.0) -> DataFrame:
    """idx, user_id, business_id, predicted_rating and score of every target; unknown users and items deviate by 0."""
    mean, item, user = bias_model(rows, shrink)
    t = examples.select("idx", "user_id", "target_item.business_id").filter("user_id is not null and business_id is not null")
    t = t.join(item, "business_id", "left").join(user, "user_id", "left")
    raw = mean.scalar() + F.coalesce("b_i", F.lit(0.0)) + F.coalesce("b_u", F.lit(0.0))
    p = F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw))
    return t.select("idx", "user_id", "business_id", p.alias("predicted_rating"), normalize_rating(p).alias("score"))


def als_predictions(rows: DataFrame, examples: DataFrame, rank: int = 20, rounds: int = 10, reg: float = 0.1, seed: int = 42) -> DataFrame:
    """As bias_predictions, with a latent-factor model (ALS) on the residuals of the bias model.

    ALS needs whole numbers as ids: they number the distinct ids in their order, so the seed fixes the factors.
    """
    from pyspark.ml.recommendation import ALS

    mean, item, user = bias_model(rows)
    users, items = (numbered(rows.select(c).distinct(), n) for c, n in (("user_id", "u"), ("business_id", "i")))
    for ids, n in ((users, "u"), (items, "i")):
        if (ids.agg(F.max(n)).first()[0] or 0) >= 2**31:
            raise ValueError("more distinct ids than ALS can take")
    mu = mean.scalar()
    res = rows.join(item, "business_id").join(user, "user_id").join(users, "user_id").join(items, "business_id")
    res = res.select(F.col("u").cast("int"), F.col("i").cast("int"), (F.col("rating") - mu - F.col("b_i") - F.col("b_u")).cast("float").alias("r"))
    model = ALS(userCol="u", itemCol="i", ratingCol="r", rank=rank, maxIter=rounds, regParam=reg, seed=seed, coldStartStrategy="nan").fit(res)
    t = bias_predictions(rows, examples).join(users, "user_id", "left").join(items, "business_id", "left")
    t = model.transform(t.withColumns({"u": F.coalesce(F.col("u").cast("int"), F.lit(-1)), "i": F.coalesce(F.col("i").cast("int"), F.lit(-1))}))
    p = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("predicted_rating") + F.coalesce(F.nanvl("prediction", F.lit(None)), F.lit(0.0))))
    return t.select("idx", "user_id", "business_id", p.alias("predicted_rating"), normalize_rating(p).alias("score"))
