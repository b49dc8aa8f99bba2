"""Items that appear together (problem 3): basket collapsing.

Each record's items are deduplicated and sorted into a basket; equal baskets are collapsed into one with a weight;
pairs are enumerated once for every distinct basket and their weights are summed.

Defined results: items are lower-cased, outer spaces cut, inner runs of spaces made one; null and empty items are
dropped; records without any item count nowhere; a key that occurs several times is one record with the union of its
items; a null key is one record for each distinct list of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.session import materialize


def normal_item(c: Column) -> Column:
    """c in lower case, outer spaces cut, inner runs of spaces made one; blank becomes null."""
    s = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.when(s != "", s)


def record_items(examples: DataFrame, key: str = "idx") -> DataFrame:
    """key and items (array) of each example: the categories of its history items and its target."""
    lists = F.expr("concat(coalesce(transform(history, h -> h.categories), array()), array(target_item.categories))")
    return examples.select(F.col(key), F.flatten(F.filter(lists, lambda x: x.isNotNull())).alias("items"))


def baskets(records: DataFrame, key: str = "idx", items: str = "items") -> DataFrame:
    """basket (sorted distinct items) and weight (number of records with it)."""
    r = records.select(F.col(key).alias("k"), F.transform(items, normal_item).alias("items"))
    r = r.select("k", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).filter(F.size("items") > 0)
    # The salt keeps records of a null key apart; a known key's set is merged before the shuffle already.
    salt = F.when(F.col("k").isNull(), F.xxhash64("items")).otherwise(F.lit(0))
    sets = r.select("k", salt.alias("salt"), F.explode("items").alias("item")).groupBy("k", "salt").agg(F.array_sort(F.collect_set("item")).alias("basket"))
    return sets.groupBy("basket").agg(F.count("*").alias("weight"))


def pair_counts(collapsed: DataFrame) -> DataFrame:
    """cat_a, cat_b, n over all pairs a < b; a = b holds the count of the item alone and two nulls that of all records."""
    pairs = F.expr(
        "concat(flatten(transform(basket, (a, i) -> transform(slice(basket, i + 1, size(basket) - i), b -> struct(a as cat_a, b as cat_b)))),"
        " array(struct(cast(null as string) as cat_a, cast(null as string) as cat_b)))"
    )
    return collapsed.select(F.explode(pairs).alias("p"), "weight").groupBy("p.cat_a", "p.cat_b").agg(F.sum("weight").alias("n"))


def associations(records: DataFrame, key: str = "idx", items: str = "items") -> DataFrame:
    """Every pair that occurs: cat_a, cat_b, n_a, n_b, n_ab, n, lift and the convictions of both directions (null: never broken)."""
    counts = materialize(pair_counts(baskets(records, key, items)))
    single = counts.filter(F.col("cat_a") == F.col("cat_b"))
    a = single.select("cat_a", F.col("n").alias("n_a"))
    b = single.select("cat_b", F.col("n").alias("n_b"))
    total = counts.filter(F.col("cat_a").isNull()).agg(F.sum("n")).scalar()
    df = counts.filter(F.col("cat_a") < F.col("cat_b")).select("cat_a", "cat_b", F.col("n").alias("n_ab")).join(a, "cat_a").join(b, "cat_b").withColumn("n", total)
    broken_ab, broken_ba = F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    return df.select(
        "cat_a", "cat_b", "n_a", "n_b", "n_ab", "n",
        (F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
        F.try_divide(F.col("n_a").cast("double") * (F.col("n") - F.col("n_b")) / F.col("n"), broken_ab).alias("conviction_ab"),
        F.try_divide(F.col("n_b").cast("double") * (F.col("n") - F.col("n_a")) / F.col("n"), broken_ba).alias("conviction_ba"),
    )


def found(assoc: DataFrame, least: int = 5, times: float = 1.5) -> DataFrame:
    """Pairs held by at least `least` records and at least `times` as often as by chance."""
    m, n = F.col("n_ab").cast("decimal(20,0)"), F.col("n").cast("decimal(20,0)")
    a, b = F.col("n_a").cast("decimal(18,0)"), F.col("n_b").cast("decimal(18,0)")
    return assoc.filter((F.col("n_ab") >= least) & (m * n * 10 >= a * b * F.lit(round(times * 10)).cast("decimal(4,0)"))).select("cat_a", "cat_b")
