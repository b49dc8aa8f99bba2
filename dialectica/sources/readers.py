"""Sources: JSON lines with ordinals, CSV with a column check, prediction files of two layouts, single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialectica.functions import json, text

#: Schemas of the files.
BUSINESS = "business_id string, name string, categories string, attributes map<string,string>, stars double, review_count bigint"
REVIEW = "user_id string, business_id string, stars double, text string, date string"
ITEM = "business_id:string,name:string,categories:array<string>,attributes:map<string,string>"
EXAMPLE = f"user_id string, user_profile struct<review_count:bigint,average_stars:double>, history array<struct<{ITEM},user_stars:double,review_text:string>>, target_item struct<{ITEM},global_stars:double,review_count:bigint,user_target_stars:double,target_review_text:string>"
SCORED = "id:string,arg_type:string,text:string,evidence:array<string>,user_id:string,target_item_name:string,llm_score:double,llm_score_reason:string,llm_scoring_prompt:string,llm_scoring_raw_output:string,mf_score:double,combined_score:double,metadata:variant"
CONTEXT = "user_id:string,target_item:struct<name:string,categories:array<string>,attributes:map<string,string>,global_stars:double,user_target_stars:double,normalized_user_target_score:double>,history:array<struct<name:string,user_stars:double,categories:array<string>,attributes:map<string,string>>>"
METADATA = "target_item_name:string,arg_type:string,evidence:array<string>,llm_score:double,llm_score_reason:string,mf_score:double,combined_score:double"
GRAPH = f"root_id:string,nodes:map<string,struct<node_id:string,node_type:string,text:string,base_score:double,metadata:struct<{METADATA}>>>,edges:array<struct<source_id:string,target_id:string,relation_type:string>>"
DFQUAD = "root_id:string,root_text:string,root_base_score:double,support_scores:array<double>,attack_scores:array<double>,aggregated_support:double,aggregated_attack:double,final_score:double"
#: Records grow from command to command: parsed_json is any JSON value, and scoring, graph and context come later.
RECORD = (
    "index bigint, user_id string, target_name string, raw_output string, parsed_json variant, validation struct<is_valid:boolean,errors:array<struct<code:string,message:string>>,error_counts:map<string,bigint>>, prompt string, "
    f"scoring struct<llm_model:string,llm_weight:double,mf_weight:double,mf_source:string>, scored_arguments array<struct<{SCORED}>>, argument_graph struct<{GRAPH}>, dfquad struct<{DFQUAD}>, context struct<{CONTEXT}>"
)
RATING = "user_id string, business_id string, rating double"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord and line of every line, blank ones too; ord counts them from 0, file by file in the order of names.

    A scan may read the pieces of files in any order, so each piece (file and first byte) is counted, and its lines are
    numbered from the sum of the pieces before it. Only the table of the pieces is ordered.
    """
    df = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    pieces = df.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__row").alias("__low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("__file", "__start", "__low", before.alias("__before"))
    return df.join(pieces, ["__file", "__start"]).select((F.col("__before") + F.col("__row") - F.col("__low")).alias("ord"), F.col("value").alias("line"))


def blank(line: Column) -> Column:
    return text.strip(line) == ""


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, blanks: str = "skip") -> DataFrame:
    """Objects of a JSON-lines file with ord, the number of the line. A malformed line fails the read if strict, else all its fields are null.

    blanks: skip leaves blank lines out (they count in ord); fail makes them malformed, as where lines are found by number.
    """
    if blanks not in ("skip", "fail"):
        raise ValueError(blanks)
    df = lines(spark, path)
    at = F.col("line")
    if blanks == "skip":
        df = df.filter(~blank(at))
    elif strict:
        at = F.when(blank(at), F.raise_error(F.concat(F.lit("blank line, number "), F.col("ord").cast("string")))).otherwise(at)
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return df.select("ord", F.from_json(at, schema, {"mode": mode, "allowSingleQuotes": "false"}).alias("r")).select("ord", "r.*")


def record_file(spark: SparkSession, path: str, needs: str = "argument_graph") -> DataFrame:
    """The record that a whole JSON file holds; an error if it lacks `needs`."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if df.filter(F.col(needs).isNotNull()).isEmpty():
        raise ValueError(f"no {needs} in {path}")
    return df


def parsed(record: Column) -> Column:
    """The parsed answer of a record: its JSON value, or the value that its text spells; null for JSON null."""
    return F.when(json.kind(record) == "STRING", json.extract_object(record.try_cast("string"))).when(json.kind(record) != "NULL", record)


def rating_csv(spark: SparkSession, path: str) -> DataFrame:
    """user_id, business_id, rating of a CSV file with a header; missing columns are an error that names them, sorted."""
    df = spark.read.csv(path, header=True)
    missing = sorted({"user_id", "business_id", "rating"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select("user_id", "business_id", F.col("rating").try_cast("double").alias("rating"))


def _prediction(user: Column, business: Column, score: Column) -> list[Column]:
    """Texts and a number (or truth value, as 1 or 0) of VARIANT values; anything else is null."""
    number = F.when(json.kind(score) == "NUMBER", score.try_cast("double")).when(json.kind(score) == "BOOLEAN", score.try_cast("boolean").cast("double"))
    return [json.as_text(user).alias("user_id"), json.as_text(business).alias("business_id"), number.alias("score"), F.col("pos").cast("bigint")]


def parse_predictions(df: DataFrame, column: str = "value") -> DataFrame:
    """user_id, business_id, score, pos from JSON texts of either layout: a list of objects, or an object with user|||business keys.

    Rows of a wrong shape or type are dropped: ids are texts, scores numbers or truth values. pos gives the order, in which the last of equal pairs counts.
    """
    v = F.try_parse_json(column)
    get = lambda k: F.try_variant_get("r", f"$.{k}", "variant")
    listed = df.select(F.posexplode(json.elements(v)).alias("pos", "r")).filter(json.is_object(F.col("r")))
    a = listed.select(*_prediction(get("user_id"), get("business_id"), get("score")))
    mapped = df.select(F.posexplode(F.map_entries(F.when(json.is_object(v), v.try_cast("map<string,variant>")))).alias("pos", "e")).filter(F.contains("e.key", F.lit("|||")))
    parts = F.split("e.key", r"\|\|\|", 2)
    b = mapped.select(parts[0].alias("user_id"), parts[1].alias("business_id"), *_prediction(F.col("e.value"), F.col("e.value"), F.col("e.value"))[2:])
    return a.unionByName(b).filter("user_id is not null and business_id is not null and score is not null")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of one JSON document, or, from a path ending in .jsonl or a folder of part files, of JSON lines, which are read in parallel."""
    if path.endswith(".jsonl") or any("part-" in f.rsplit("/", 1)[-1] for f in spark.read.text(path).inputFiles()):
        return _numbered(lines(spark, path))
    return parse_predictions(spark.read.text(path, wholetext=True))


def _numbered(df: DataFrame) -> DataFrame:
    """Predictions of lines, in the order of the lines."""
    v = F.try_parse_json("line")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    rows = df.withColumn("pos", F.col("ord")).filter(json.is_object(v)).select(*_prediction(get("user_id"), get("business_id"), get("score")))
    return rows.filter("user_id is not null and business_id is not null and score is not null")
