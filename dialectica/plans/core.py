"""Queries of the recommendation pipeline over whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectica.functions import json, text
from dialectica.operators import examples as ex
from dialectica.operators import generation, graph, models, ratings, report, scoring, validate
from dialectica.session import table
from dialectica.sources import readers


def r6(c: Column | str) -> Column:
    """Six decimals; the small addend keeps ties from falling on either side by the last bit."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep, "NULL")


def businesses(spark: SparkSession, d: str) -> DataFrame:
    return ex.clean_businesses(table(spark, d, "raw_business"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return ex.filter_reviews(table(spark, d, "raw_review"), businesses(spark, d))


def given(spark: SparkSession, d: str) -> DataFrame:
    return ex.once(table(spark, d, "sample_input"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return ex.once(table(spark, d, "generation_results"), "index", "generated_at")


def business_clean(spark, d):
    return businesses(spark, d).select("business_id", "name", joined("categories").alias("categories"), F.size("attributes").cast("bigint").alias("n_attributes"), "stars", "review_count")


def review_semi_join(spark, d):
    return reviews(spark, d)


def user_activity(spark, d):
    return ex.user_activity(reviews(spark, d))


def user_activity_tight(spark, d):
    return ex.user_activity(reviews(spark, d), 7, 12)


def user_sample(spark, d):
    return ex.sample_users(ex.user_activity(reviews(spark, d)))


def _users(r, sampled):
    """The sample of at most 100 users, or all users with enough reviews."""
    activity = ex.user_activity(r)
    return ex.sample_users(activity) if sampled else ex.eligible_users(activity)


def _split(spark, d, sampled=True):
    r = reviews(spark, d)
    return ex.split_history(r.join(_users(r, sampled).select("user_id"), "user_id", "left_semi"))


def target_item(spark, d, sampled=True):
    t = _split(spark, d, sampled).filter("role = 'target'").join(businesses(spark, d), "business_id")
    return t.select("user_id", "business_id", "name", "ord", "date", F.col("user_stars").alias("user_target_stars"), F.col("stars").alias("global_stars"), "review_count")


def history_items(spark, d, sampled=True):
    h = _split(spark, d, sampled).filter("role = 'history'").join(businesses(spark, d), "business_id")
    return h.select("user_id", F.col("pos").cast("bigint").alias("pos"), "business_id", "name", "ord", "date", "user_stars")


def examples_built(spark, d, sampled=True):
    r, b = reviews(spark, d), businesses(spark, d)
    e = ex.build_examples(r, b, _users(r, sampled))
    return e.select("user_id", F.size("history").cast("bigint").alias("n_history"), joined(F.transform("history", lambda h: h.business_id)).alias("history"), F.col("target_item.business_id").alias("target"))


def example_summary(spark, d):
    s = report.example_summary(given(spark, d))
    return s.select(*(r6(c).alias(c) if c.startswith("avg") else F.col(c).cast("bigint") for c in s.columns))


def attribute_clean(spark, d):
    e = given(spark, d)
    items = e.select("idx", F.explode(F.expr("concat(array(struct(0L as item_pos, target_item.attributes as attributes)), coalesce(transform(history, (h, i) -> struct(cast(i + 1 as bigint) as item_pos, h.attributes as attributes)), array()))")).alias("x"))
    return items.select("idx", "x.item_pos", F.inline(text.attribute_pairs(F.col("x.attributes"))))


def attribute_text(spark, d):
    return given(spark, d).select("idx", text.attribute_text(F.col("target_item.attributes")).alias("attributes"))


def history_prompt(spark, d):
    return given(spark, d).select("idx", text.history_text(F.col("history")).alias("history"))


def target_prompt(spark, d):
    return given(spark, d).select("idx", text.target_text(F.col("target_item")).alias("target"))


def argument_prompt(spark, d):
    return given(spark, d).select("idx", text.argument_prompt(F.col("history"), F.col("target_item")).alias("prompt"))


def json_extract(spark, d):
    v = json.extract_object(F.col("raw_output"))
    n = F.size(json.elements(F.try_variant_get(v, "$.arguments", "variant")))
    return records(spark, d).select("index", v.isNotNull().alias("is_object"), F.when(n >= 0, n).cast("bigint").alias("n_arguments"))


def _checked(spark, d):
    return validate.validated(records(spark, d).drop("errors"), given(spark, d))


def validation_errors(spark, d):
    return validate.error_rows(_checked(spark, d)).select("index", "pos", "code")


def validation_messages(spark, d):
    return validate.error_rows(_checked(spark, d))


def validation_status(spark, d):
    return _checked(spark, d).select("index", (F.size("errors") == 0).alias("is_valid"), F.size("errors").cast("bigint").alias("n_errors"))


def error_counts(spark, d):
    return validate.error_counts(_checked(spark, d))


def valid_split(spark, d):
    return report.validity_counts(records(spark, d))


def invalid_records(spark, d):
    return report.filter_records(records(spark, d), "invalid").select("index", "target_name")


def record_report(spark, d):
    return report.record_report(records(spark, d))


def mf_rows(spark, d):
    return ratings.rating_rows(given(spark, d))


def mf_rows_with_target(spark, d):
    return ratings.rating_rows(given(spark, d), include_target=True)


def mf_summary(spark, d):
    return ratings.rating_summary(mf_rows(spark, d))


def mf_bias_predictions(spark, d):
    p = ratings.bias_predictions(mf_rows(spark, d), given(spark, d))
    return p.select("idx", "user_id", "business_id", r6("predicted_rating").alias("predicted_rating"), r6("score").alias("score"))


def mf_als_predictions(spark, d):
    return ratings.als_predictions(mf_rows(spark, d), given(spark, d))


def _gated(spark, d, only_valid=False):
    r = records(spark, d).withColumn("parsed", json.extract_object(F.col("raw_output"))).withColumn("is_valid", F.col("validation.is_valid"))
    return scoring.gate(r, given(spark, d), only_valid)


def score_gate(spark, d):
    return _gated(spark, d, True).groupBy(F.coalesce("skip", F.lit("scored")).alias("outcome")).agg(F.count("*").alias("n"))


def _taken(spark, d, *keep):
    """Records with readable JSON and a known example, with the example's columns."""
    df = scoring.readable(records(spark, d), given(spark, d), F.col("raw_output"), ("target_item", *keep))
    return df.withColumn("target_name", F.col("example.target_item.name"))


def _arguments(spark, d, *keep):
    return scoring.argument_rows(_taken(spark, d, *keep).select("index", "parsed", "example"))


def arguments(spark, d):
    return _arguments(spark, d)[0].select("index", "pos", "id", "arg_type", "text", joined("evidence").alias("evidence"))


def argument_quarantine(spark, d):
    return _arguments(spark, d)[1]


def scoring_prompt(spark, d):
    e = F.col("example")
    return _arguments(spark, d, "history")[0].select("index", "pos", text.scoring_prompt(e.history, e.target_item, F.col("id"), F.col("arg_type"), F.col("text"), F.col("evidence"), F.col("bare")).alias("prompt"))


def scored_text(index: Column, pos: Column) -> Column:
    """A stand-in for a model's scoring answers, computed from index and pos: scores up to 1.20, some answers without JSON."""
    n = (index * 31 + pos * 17) % 121
    number = F.concat((F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    good = F.concat(F.lit('Scores: {"score": '), number, F.lit(', "reason": " r'), pos.cast("string"), F.lit(' "}'))
    return F.when((index + pos) % 7 == 0, "no answer").when((index + pos) % 11 == 0, F.lit('{"score": "0.8", "reason": ""}')).otherwise(good)


def llm_score_parse(spark, d):
    s, r = scoring.parse_score(scored_text(F.col("index"), F.col("pos")))
    return _arguments(spark, d)[0].select("index", "pos", r6(s).alias("llm_score"), r.alias("llm_score_reason"))


def mf_fallback_score(spark, d):
    e = given(spark, d)
    a = e.select(F.col("idx").alias("index"))
    return scoring.global_rating_scores(a, e).select("index", r6("mf_score").alias("mf_score"))


def mf_precomputed_score(spark, d):
    e = given(spark, d)
    p = ratings.bias_predictions(mf_rows(spark, d), e).select("user_id", "business_id", "score", F.col("idx").alias("pos"))
    rows = e.select(F.col("idx").alias("index"), "user_id", F.col("target_item.business_id").alias("b"))
    return scoring.predicted_scores(rows, p, "user_id", "b").select("index", r6("mf_score").alias("mf_score"))


def _scored(spark, d, *keep):
    """Records with args, their scored arguments."""
    df = scoring.with_arguments(_taken(spark, d, *keep))
    raw = lambda a: scored_text(F.col("index"), a.pos)
    return df.withColumn("args", scoring.score_array(F.col("args"), raw, scoring.global_rating(F.col("example.target_item"))))


def score_arguments(spark, d):
    return _scored(spark, d).select("index", F.inline("args")).select("index", "pos", "id", "arg_type", r6("llm_score").alias("llm_score"), r6("mf_score").alias("mf_score"), r6("combined_score").alias("combined_score"))


def score_summary(spark, d):
    s = scoring.summary(_scored(spark, d).select("index", F.inline("args")))
    return s.select(*(r6(c).alias(c) if c.startswith("avg") else F.col(c) for c in s.columns))


def _graphs(spark, d, *keep):
    return graph.with_graph(_scored(spark, d, *keep))


def graph_nodes(spark, d):
    return _graphs(spark, d).select("index", F.inline("nodes")).select("index", "node_id", "node_type", "text", r6("base_score").alias("base_score"))


def graph_edges(spark, d):
    return _graphs(spark, d).select("index", F.inline("edges"))


def graph_supporters(spark, d):
    return graph.linked(_graphs(spark, d)).select("index", F.inline("links")).select("index", "pos", "source_id", "relation_type", r6("base_score").alias("base_score"))


def dfquad_root(spark, d):
    return graph.evaluate(_graphs(spark, d)).select("index", "root_text", *(r6(c).alias(c) for c in ("root_base_score", "aggregated_support", "aggregated_attack", "final_score")))


def argument_graph(spark, d):
    """The graphs as they are written to files: one object each."""
    return _graphs(spark, d).select("index", F.to_json(graph.graph_object(F.col("nodes"), F.col("edges"))).alias("graph"))


def context_summary(spark, d):
    c = graph.context(given(spark, d)).select("idx", "context.*")
    return c.select("idx", "user_id", F.col("target_item.name").alias("target"), r6("target_item.normalized_user_target_score").alias("target_score"), F.coalesce(F.size("target_item.attributes"), F.lit(0)).cast("bigint").alias("n_attributes"), joined(F.transform("history", lambda h: h["name"])).alias("history"))


def graph_layout(spark, d):
    return _graphs(spark, d).select("index", F.inline(graph.layout(F.col("nodes"), F.col("edges")))).select("index", "node_id", r6("x").alias("x"), r6("y").alias("y"))


def tooltip_html(spark, d):
    return _graphs(spark, d).select("index", F.inline(F.transform("nodes", lambda n: F.struct(n.node_id.alias("node_id"), graph.tooltip(n).alias("tooltip")))))


def history_html(spark, d):
    return graph.context(given(spark, d)).select("idx", graph.history_panel(F.col("context.history")).alias("html"))


def context_html(spark, d):
    return graph.context(given(spark, d)).select("idx", graph.context_panel(F.col("context")).alias("html"))


def graph_pages(spark, d):
    e = F.col("example")
    g = graph.evaluate(_graphs(spark, d, "user_id", "history"))
    return graph.pages(g.withColumn("context", graph.context_of(e.user_id, e.history, e.target_item)))


def select_slice(spark, d):
    return generation.select_slice(given(spark, d), 10, 25).select("idx", "user_id")


def record_lookup(spark, d):
    return generation.one(table(spark, d, "generation_results"), 17, order="generated_at").select("index", "user_id", "target_name")


def random_examples(spark, d):
    return generation.select_random(given(spark, d), 10, 42).select("idx", "draw")


def template_answers(spark, d):
    return given(spark, d).select(F.col("idx").alias("index"), F.lit("").alias("user_id"), generation.template_answer(F.col("history"), F.col("target_item")).alias("raw_output"))


def template_validation(spark, d):
    return validate.validated(template_answers(spark, d), given(spark, d)).select("index", F.size("errors").cast("bigint").alias("n_errors"))


def generated_scores(spark, d):
    """The scoring prompts through the inference hook, each distinct prompt once."""
    p = scoring_prompt(spark, d)
    g = generation.infer(p, "prompt", models.TemplateModel)
    s, r = scoring.parse_score(F.col("raw_output"))
    return g.select("index", "pos", s.alias("llm_score"), r.alias("reason"))


def predictions_parsed(spark, d):
    """Predictions of both file layouts, made from the examples, with rows of wrong types, as the precomputed scorer reads them."""
    e = given(spark, d).filter("user_id is not null and target_item.business_id is not null").select("idx", text.json_text(F.col("user_id")).alias("u"), text.json_text(F.col("target_item.business_id")).alias("b"))
    n = (F.col("idx") % 100).cast("string")
    row = lambda u, b, score: F.concat(F.lit('{"user_id": '), u, F.lit(', "business_id": '), b, F.lit(', "score": '), score, F.lit("}"))
    u, b = F.col("u"), F.col("b")
    listed = [row(u, b, F.concat(n, F.lit("e-2"))), row(F.lit("7"), b, n), row(u, F.lit("null"), n), row(u, b, F.concat(F.lit('"'), n, F.lit('"'))), row(u, b, F.lit("true")), F.lit("null"), F.lit("3"), F.lit('{"score": 1}'), row(u, b, F.lit("[1]"))]
    one = F.concat(F.lit("["), F.concat_ws(", ", *listed), F.lit("]"))
    key = F.concat(F.rtrim(u, F.lit('"')), F.lit("|||"), F.ltrim(b, F.lit('"')))
    two = F.concat(F.lit("{"), key, F.lit(": "), n, F.lit(', "bad": 1, "a|||b": "0.5", "c|||d": null}'))
    return readers.parse_predictions(e.select(F.when(F.col("idx") % 2 == 0, one).when(F.col("idx") % 3 == 0, F.lit("7")).otherwise(two).alias("value"))).drop("pos")


NAMES = """business_clean review_semi_join user_activity user_activity_tight user_sample target_item history_items examples_built example_summary attribute_clean
attribute_text history_prompt target_prompt argument_prompt json_extract validation_errors validation_messages validation_status error_counts valid_split invalid_records record_report
mf_rows mf_rows_with_target mf_summary mf_bias_predictions mf_als_predictions score_gate arguments argument_quarantine scoring_prompt llm_score_parse mf_fallback_score mf_precomputed_score
score_arguments score_summary graph_nodes graph_edges graph_supporters dfquad_root argument_graph context_summary graph_layout tooltip_html history_html context_html graph_pages select_slice record_lookup
random_examples template_answers template_validation generated_scores predictions_parsed"""
QUERIES = {n: globals()[n] for n in NAMES.split()}
#: The same over all users with enough reviews; the queries without _all take the sample of at most SAMPLE users.
QUERIES |= {f"{n}_all": partial(globals()[n], sampled=False) for n in ("target_item", "history_items", "examples_built")}
