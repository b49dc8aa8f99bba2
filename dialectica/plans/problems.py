"""Queries of the general problems 2 and 3 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialectica.operators import cooccurrence, nested
from dialectica.operators import examples as ex
from dialectica.session import table

#: What p2_found reads of sample_input: review texts stay unread.
ATTRIBUTES_ONLY = (
    "idx bigint, history array<struct<business_id:string,attributes:map<string,string>>>, target_item struct<business_id:string,attributes:map<string,string>>"
)


def _attribute_lines(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.schema(ATTRIBUTES_ONLY).parquet(f"{folder}/sample_input.parquet")
    return nested.as_lines(given).unionByName(table(spark, folder, "sample_input_raw").select("idx", "line"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.item_paths(nested.labelled(_attribute_lines(spark, folder), "line", ["idx"]), "idx")


def _flat(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        given = nested.as_lines(ex.once(table(spark, folder, "sample_input")), whole=True)
        lines = given.unionByName(table(spark, folder, "sample_input_raw").select("idx", "line").distinct())
        return nested.flat_tables(nested.labelled(lines, "line", ["idx"], fields=True), ["idx"])[name]

    query.__name__ = f"p2_{name}"
    return query


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.associations(cooccurrence.record_items(table(spark, folder, "sample_input")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.found(p3_pairs(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_examples": _flat("examples"), "p2_items": _flat("items"), "p2_objects": _flat("objects"), "p2_attributes": _flat("attributes"), "p3_found": p3_found, "p3_pairs": p3_pairs}
