"""python -m dialectica COMMAND: the pipeline's stages from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.functions import text
from dialectica.functions.score import check_weights
from dialectica.operators import examples as ex
from dialectica.operators import generation, graph, models, ratings, report, scoring, validate
from dialectica.session import get_spark, materialize
from dialectica.sources import readers, sinks


def _examples(spark, path: str) -> DataFrame:
    """Examples by the number of their line; a blank line is an error, since it has a number too."""
    return readers.json_lines(spark, path, readers.EXAMPLE, blanks="fail").withColumnRenamed("ord", "idx")


def _records(spark, path: str) -> DataFrame:
    """Records with parsed and is_valid."""
    return readers.json_lines(spark, path, readers.RECORD).drop("ord").withColumn("parsed", readers.parsed(F.col("parsed_json"))).withColumn("is_valid", F.col("validation.is_valid"))


def _model(a, default: models.ModelConfig) -> models.ModelConfig:
    return models.ModelConfig(a.model, a.max_new_tokens or default.max_new_tokens, getattr(a, "temperature", default.temperature), getattr(a, "top_p", default.top_p), getattr(a, "do_sample", False))


def build_examples(spark, a) -> None:
    raw = readers.json_lines(spark, a.businesses, readers.BUSINESS)
    b = ex.clean_businesses(raw, a.category, order="ord")
    r = ex.filter_reviews(readers.json_lines(spark, a.reviews, readers.REVIEW), b, a.least_length)
    users = ex.sample_users(ex.user_activity(r, a.least_reviews, a.most_reviews), a.users, a.seed)
    sinks.json_lines(ex.build_examples(r, b, users), a.output)


def build_ratings(spark, a) -> None:
    rows = materialize(ratings.rating_rows(_examples(spark, a.input), a.include_target, not a.no_deduplicate))
    sinks.csv(rows, a.output)
    sinks.summary(ratings.rating_summary(rows), a.output.rstrip("/") + "_summary.json", input_file=a.input, output_file=a.output, include_target=a.include_target, deduplicate=not a.no_deduplicate)


def train(spark, a) -> None:
    rows, e = readers.rating_csv(spark, a.ratings), _examples(spark, a.input)
    p = materialize(ratings.als_predictions(rows, e, a.factors, a.rounds, a.reg, a.seed) if a.model == "als" else ratings.bias_predictions(rows, e))
    sinks.json_lines(p.drop("idx"), a.output)
    sinks.summary(p.agg(F.count("*").alias("num_predictions")), a.output.rstrip("/") + "_summary.json", model=a.model, num_train_rows=rows.count())


def _generated(spark, a, chosen: DataFrame, e: DataFrame) -> DataFrame:
    config = _model(a, models.ModelConfig())
    p = chosen.select(F.col("idx").alias("index"), "user_id", F.col("target_item.name").alias("target_name"), text.argument_prompt(F.col("history"), F.col("target_item")).alias("prompt"))
    v = validate.validated(generation.infer(p, "prompt", models.loader(config), deduplicate=not config.do_sample), e)
    return v.select("index", "user_id", "target_name", "raw_output", F.col("parsed").alias("parsed_json"), validate.verdict(F.col("errors")).alias("validation"), "prompt")


def generate(spark, a) -> None:
    """Arguments for a slice of the examples or for some drawn at random."""
    e = _examples(spark, a.input)
    chosen = generation.select_random(e, a.num_examples, a.seed).drop("draw") if a.random else generation.select_slice(e, a.start_index, a.num_examples)
    v = _generated(spark, a, chosen, e)
    sinks.split_records(v if a.save_prompt else v.drop("prompt"), a.output, model=a.model)


def generate_one(spark, a) -> None:
    """Arguments for one example, printed."""
    e = _examples(spark, a.input)
    v = materialize(_generated(spark, a, generation.one(e, a.index, "idx"), e))
    print(report.record_report(v, a.show_prompt, True, True).first().report)
    if a.output:
        sinks.write_text(spark, a.output, v.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0] + "\n")


def _scored(spark, a, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with scoring and scored_arguments, those left out with the reason)."""
    e = _examples(spark, a.dataset)
    mf = scoring.Predictions(readers.predictions(spark, a.mf_predictions), name=a.mf_predictions) if a.mf_predictions else scoring.GlobalRating()
    llm = scoring.ModelScorer(models.loader(_model(a, models.SCORING)))
    more = [c for c, yes in (("llm_scoring_prompt", a.save_llm_prompt), ("llm_scoring_raw_output", a.save_llm_raw)) if yes]
    s, left = scoring.run(records, e, llm, mf, a.llm_weight, a.mf_weight, a.only_valid, a.save_llm_prompt, a.save_llm_raw)
    how = F.struct(F.lit(a.model).alias("llm_model"), F.lit(a.llm_weight).alias("llm_weight"), F.lit(a.mf_weight).alias("mf_weight"), F.lit(mf.name).alias("mf_source"))
    s = s.withColumns({"scoring": how, "scored_arguments": scoring.scored_objects(F.col("args"), F.col("example.user_id"), F.col("example.target_item.name"), *more)})
    return s.drop("parsed", "is_valid", "example", "args", "argument_graph", "dfquad", "context"), left


def score(spark, a) -> None:
    """Scores of the arguments of all records, or of the valid ones."""
    check_weights(a.llm_weight, a.mf_weight)
    s, left = _scored(spark, a, _records(spark, a.input))
    s = materialize(s)
    sinks.json_lines(s, a.output, "index")
    rows = scoring.summary(s.select("index", F.inline("scored_arguments"))).withColumns({"num_records": F.lit(s.count()), "num_skipped": F.lit(left.count())})
    sinks.summary(rows, a.output.rstrip("/") + "_summary.json", llm_model=a.model, llm_weight=a.llm_weight, mf_weight=a.mf_weight, mf_source=a.mf_predictions or "global_rating", only_valid=a.only_valid)


def score_one(spark, a) -> None:
    """Scores of the arguments of one record, printed."""
    check_weights(a.llm_weight, a.mf_weight)
    a.only_valid, a.save_llm_prompt, a.save_llm_raw = False, a.show_prompt, a.show_raw
    record = generation.one(_records(spark, a.input), a.index)
    if record.first().parsed is None:
        raise ValueError(f"record {a.index} has no parsed answer")
    s = _scored(spark, a, record)[0]
    if not a.show_prompt:
        s = s.withColumn("scored_arguments", F.transform("scored_arguments", lambda x: x.withField("llm_scoring_prompt", F.lit(None).cast("string"))))
    print(s.select(report.scored_report(F.col("scored_arguments"), a.show_prompt, a.show_raw)).first()[0])


def _reasoned(spark, a, records: DataFrame) -> DataFrame:
    g = graph.evaluate(graph.with_graph(records.withColumn("args", scoring.from_objects(F.col("scored_arguments"))).withColumn("target_name", F.coalesce(F.get("scored_arguments.target_item_name", F.lit(0)), "target_name")), a.root_base_score))
    g = g.withColumns({"argument_graph": graph.graph_object(F.col("nodes"), F.col("edges")), "dfquad": F.struct(*graph.DFQUAD)}).drop(*graph.DFQUAD, "context", "args")
    none = F.expr("cast(null as struct<" + readers.CONTEXT + ">)")
    if not a.dataset:
        return g.withColumn("context", none)
    c = graph.context(_examples(spark, a.dataset)).withColumnRenamed("idx", "index")
    return g.join(c, "index", "left")


def _pages(reasoned: DataFrame) -> DataFrame:
    return graph.pages(reasoned.select("index", "nodes", "edges", "context", "dfquad.*"))


def reason(spark, a) -> None:
    """Graphs of scored records, their evaluation, and pages. With index, of one record, which is printed too."""
    records = _records(spark, a.input).drop("parsed", "is_valid")
    if a.index is not None:
        records = generation.one(records, a.index)
        if not records.first().scored_arguments:
            raise ValueError(f"record {a.index} has no scored arguments")
    r = materialize(_reasoned(spark, a, records))
    out = r.drop("nodes", "edges")
    if a.index is not None:
        shown = [report.scored_report(F.col("scored_arguments"))] * a.show_scores + [F.to_json("argument_graph")] * a.show_graph + [F.to_json("dfquad")]
        print(*out.select(F.array(*shown)).first()[0], sep="\n\n")
    if a.output:
        if a.index is None:
            sinks.json_lines(out, a.output, "index")
        else:
            sinks.write_text(spark, a.output, out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0] + "\n")
    if a.html:
        (sinks.pages if a.index is None else sinks.page)(_pages(r), a.html)


def draw(spark, a) -> None:
    """The page of a file that holds one record with its graph."""
    r = readers.record_file(spark, a.input)
    n, e = graph.from_object(F.col("argument_graph"))
    sinks.page(_pages(r.withColumns({"nodes": n, "edges": e})), a.output)


def inspect(spark, a) -> None:
    if a.examples:
        report.example_summary(_examples(spark, a.file), a.n).show(vertical=True, truncate=False)
        return
    r = report.filter_records(_records(spark, a.file), a.only).orderBy("index").limit(a.n)
    for x in report.record_report(r, a.show_prompt, a.show_raw, True, a.show_scores, a.show_llm_prompt, a.show_llm_raw).orderBy("index").collect():
        print(x.report + "\n")


def prompt(spark, a) -> None:
    e = generation.one(_examples(spark, a.file), a.index, "idx")
    print(e.select(text.argument_prompt(F.col("history"), F.col("target_item"))).first()[0])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dialectica", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *args):
        c = sub.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        for name, kw in args:
            c.add_argument("--" + name, **kw)

    need, flag = {"required": True}, {"action": "store_true"}
    num = lambda t, d: {"type": t, "default": d}
    weights = [("llm-weight", num(float, 0.5)), ("mf-weight", num(float, 0.5))]
    command(build_examples, ("businesses", need), ("reviews", need), ("output", need), ("category", {"default": ex.CATEGORY}), ("least-length", num(int, ex.LEAST_LENGTH)), ("least-reviews", num(int, ex.LEAST_REVIEWS)), ("most-reviews", num(int, ex.MOST_REVIEWS)), ("users", num(int, ex.SAMPLE)), ("seed", num(int, ex.SEED)))
    command(build_ratings, ("input", need), ("output", need), ("include-target", flag), ("no-deduplicate", flag))
    command(train, ("ratings", need), ("input", need), ("output", need), ("model", {"choices": ["bias", "als"], "default": "bias"}), ("factors", num(int, 20)), ("rounds", num(int, 10)), ("reg", num(float, 0.1)), ("seed", num(int, 42)))
    model = [("model", {"default": models.TEMPLATE}), ("max-new-tokens", num(int, None))]
    sampling = [("temperature", num(float, 0.2)), ("top-p", num(float, 0.9)), ("do-sample", flag)]
    command(generate, ("input", need), ("output", need), ("start-index", num(int, 0)), ("num-examples", num(int, 10)), ("random", flag), ("seed", num(int, None)), ("save-prompt", flag), *model, *sampling)
    command(generate_one, ("input", need), ("index", num(int, 0)), ("output", {}), ("show-prompt", flag), *model, *sampling)
    command(score, ("dataset", need), ("input", need), ("output", need), ("mf-predictions", {}), ("only-valid", flag), ("save-llm-prompt", flag), ("save-llm-raw", flag), *weights, *model)
    command(score_one, ("dataset", need), ("input", need), ("index", num(int, 0)), ("mf-predictions", {}), ("show-prompt", flag), ("show-raw", flag), *weights, *model)
    command(reason, ("input", need), ("output", {}), ("dataset", {}), ("root-base-score", num(float, 0.5)), ("html", {}), ("index", num(int, None)), ("show-graph", flag), ("show-scores", flag))
    command(draw, ("input", need), ("output", need))
    command(inspect, ("file", need), ("n", num(int, 3)), ("examples", flag), ("only", {"choices": ["all", "valid", "invalid"], "default": "all"}), ("show-prompt", flag), ("show-raw", flag), ("show-scores", flag), ("show-llm-prompt", flag), ("show-llm-raw", flag))
    command(prompt, ("file", need), ("index", num(int, 0)))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(get_spark(), a)


if __name__ == "__main__":
    main()
