"""Scores of arguments: semantic scores from generated text, collaborative scores, and their combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.functions import json, score, text
from dialectica.operators import generation

DEFAULT_SCORE, DEFAULT_REASON = 0.5, "No valid scoring explanation returned by the LLM."


def gate(records: DataFrame, examples: DataFrame, only_valid: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """records with skip: null, invalid, no_json or no_example (the first that holds), and example: the columns `keep` of the example.

    Records have parsed and is_valid; examples have one row for each idx. One join by number serves both.
    """
    known = examples.select(F.col("idx").alias("index"), F.struct(F.lit(True).alias("known"), *keep).alias("example"))
    df = records.join(known, "index", "left")
    invalid = F.lit(only_valid) & ~F.coalesce("is_valid", F.lit(False))
    return df.withColumn("skip", F.when(invalid, "invalid").when(F.col("parsed").isNull(), "no_json").when(F.col("example").isNull(), "no_example"))


def _spelled(v: Column) -> Column:
    """A text as it is, null for JSON null, any other value as JSON."""
    return F.when(json.kind(v) == "STRING", v.try_cast("string")).when(json.kind(v) != "NULL", F.to_json(v))


def readable(records: DataFrame, examples: DataFrame, raw: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records that `gate` would not skip (all with readable JSON and a known example), with parsed and example.

    The JSON comes out of a generator, so that the test for it doesn't parse it a second time.
    """
    known = examples.select(F.col("idx").alias("index"), F.struct(F.lit(True).alias("known"), *keep).alias("example"))
    return records.join(known, "index").select("*", F.explode(F.filter(F.array(json.extract_object(raw)), lambda v: v.isNotNull())).alias("parsed"))


def argument_array(parsed: Column) -> Column:
    """The arguments of a parsed answer: pos, id, arg_type, text, evidence, bare, reason; null if it holds no list of them.

    Evidence that is one text instead of a list is a list of it, with bare set. reason says why an argument can't be used: it is no object, or lacks a key.
    """

    def one(a: Column, i: Column) -> Column:
        get = lambda k: F.try_variant_get(a, f"$.{k}", "variant")
        said = json.as_text(get("evidence"))
        evidence = F.coalesce(F.transform(json.elements(get("evidence")), _spelled), F.when(said.isNotNull(), F.array(said)))
        gone = F.filter(F.array(*(F.when(get(k).isNull(), F.lit(k)) for k in ("id", "type", "text", "evidence"))), lambda x: x.isNotNull())
        reason = F.when(~json.is_object(a), "not an object").otherwise(text.let(gone, lambda g: F.when(F.size(g) > 0, F.concat(F.lit("missing "), F.array_join(g, ", ")))))
        parts = {"pos": i.cast("bigint"), "id": _spelled(get("id")), "arg_type": _spelled(get("type")), "text": _spelled(get("text")), "evidence": evidence, "bare": said.isNotNull(), "reason": reason}
        return F.struct(*(c.alias(k) for k, c in parts.items()))

    return F.transform(json.elements(F.try_variant_get(parsed, "$.arguments", "variant")), one)


def with_arguments(records: DataFrame) -> DataFrame:
    """records (with parsed) with args, the usable arguments of each, and unusable, the others."""
    df = records.withColumn("__all", argument_array(F.col("parsed")))
    return df.withColumns({"args": F.filter("__all", lambda x: x.reason.isNull()), "unusable": F.filter("__all", lambda x: x.reason.isNotNull())}).drop("__all")


def argument_rows(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arguments, quarantine) of records with parsed: one row for each argument; those that can't be used go to quarantine with the reason."""
    rows = records.withColumn("__all", argument_array(F.col("parsed"))).drop("parsed").select("*", F.inline("__all")).drop("__all")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("index", "pos", "reason")


def answer(raw: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """struct(score, reason) of a generated scoring answer; each has its own default."""

    def parts(v: Column) -> Column:
        s, r = F.try_variant_get(v, "$.score", "variant"), text.strip(json.as_text(F.try_variant_get(v, "$.reason", "variant")))
        number = text.let(s, lambda x: F.when(json.kind(x) == "BOOLEAN", F.when(x.try_cast("boolean"), 1.0).otherwise(0.0)).when(json.kind(x) == "NUMBER", x.try_cast("double")))
        reason = text.let(r, lambda x: F.when(x != "", x).otherwise(F.lit(DEFAULT_REASON)))
        return F.struct(F.coalesce(text.let(number, lambda x: score.normalize_score(x, low, high)), F.lit(DEFAULT_SCORE)).alias("score"), reason.alias("reason"))

    default = F.struct(F.lit(DEFAULT_SCORE).alias("score"), F.lit(DEFAULT_REASON).alias("reason"))
    return text.let(json.extract_object(raw), lambda v: F.when(json.is_object(v), parts(v)).otherwise(default))


def parse_score(raw: Column, low: float = 0.0, high: float = 1.0) -> tuple[Column, Column]:
    """(score, reason) of a generated scoring answer."""
    a = answer(raw, low, high)
    return a.score, a.reason


def global_rating(target: Column, default: float = 0.5) -> Column:
    """The collaborative score by the target's global rating."""
    return F.coalesce(score.normalize_rating(target.global_stars), F.lit(default))


def global_rating_scores(rows: DataFrame, examples: DataFrame, default: float = 0.5) -> DataFrame:
    """rows (by index) with mf_score from the target's global rating."""
    e = examples.select(F.col("idx").alias("index"), global_rating(F.col("target_item"), default).alias("mf_score"))
    return rows.join(e, "index", "left").withColumn("mf_score", F.coalesce("mf_score", F.lit(default)))


def predicted_scores(rows: DataFrame, predictions: DataFrame, user: str, business: str, default: float = 0.5) -> DataFrame:
    """rows with mf_score looked up by the columns user and business; predictions: user_id, business_id, score, pos (the last one counts)."""
    p = predictions.groupBy("user_id", "business_id").agg(F.max_by("score", "pos").alias("mf_score"))
    df = rows.withColumns({"__u": F.col(user), "__b": F.col(business)}).join(p.withColumnsRenamed({"user_id": "__u", "business_id": "__b"}), ["__u", "__b"], "left").drop("__u", "__b")
    return df.withColumn("mf_score", score.clamp(F.coalesce("mf_score", F.lit(default))))


def precomputed_scores(rows: DataFrame, examples: DataFrame, predictions: DataFrame, default: float = 0.5) -> DataFrame:
    """rows (by index) with mf_score looked up by the example's user and target business."""
    keys = examples.select(F.col("idx").alias("index"), F.col("user_id").alias("__user"), F.col("target_item.business_id").alias("__business"))
    return predicted_scores(rows.join(keys, "index", "left"), predictions, "__user", "__business", default).drop("__user", "__business")


def _scored(a: Column, said: Column, mf: Column, llm_weight: float, mf_weight: float) -> dict[str, Column]:
    return {"llm_score": said.score, "llm_score_reason": said.reason, "mf_score": mf, "combined_score": score.combine(said.score, mf, llm_weight, mf_weight)}


def score_arguments(arguments: DataFrame, raw: Column, llm_weight: float = 0.5, mf_weight: float = 0.5) -> DataFrame:
    """arguments (with mf_score) and the scoring answers `raw` -> llm_score, llm_score_reason, combined_score."""
    score.check_weights(llm_weight, mf_weight)
    df = arguments.withColumn("answer", answer(raw))
    return df.withColumns(_scored(None, F.col("answer"), F.col("mf_score"), llm_weight, mf_weight)).drop("answer")


def score_array(args: Column, raw: Callable[[Column], Column], mf: Column, llm_weight: float = 0.5, mf_weight: float = 0.5) -> Column:
    """args with llm_score, llm_score_reason, mf_score and combined_score; raw gives the scoring answer of an argument."""
    score.check_weights(llm_weight, mf_weight)

    def one(a: Column) -> Column:
        return text.let(answer(raw(a)), lambda said: F.struct(*(a[k].alias(k) for k in ("pos", "id", "arg_type", "text", "evidence")), *(c.alias(k) for k, c in _scored(a, said, mf, llm_weight, mf_weight).items())))

    return F.transform(args, one)


def collected(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Scored argument rows as one row for each record: keys and args in order of pos. Answers of a model come as rows, so this is their way back."""
    a = F.struct("pos", "id", "arg_type", "text", "evidence", "llm_score", "llm_score_reason", "mf_score", "combined_score", *(c for c in ("llm_scoring_prompt", "llm_scoring_raw_output") if c in scored.columns))
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_list(a), lambda x, y: (x.pos - y.pos).cast("int")).alias("args"))


def summary(scored: DataFrame) -> DataFrame:
    """Totals and means of scored arguments, also of support and attack alone; means of nothing are null."""
    of = lambda t: F.avg(F.when(F.col("arg_type") == t, F.col("combined_score")))
    return scored.agg(
        F.count_distinct("index").alias("num_records"), F.count("*").alias("num_arguments"), F.avg("llm_score").alias("avg_llm"), F.avg("mf_score").alias("avg_mf"),
        F.avg("combined_score").alias("avg_combined"), of("support").alias("avg_support"), of("attack").alias("avg_attack"),
    )


def scored_objects(args: Column, user_id: Column, target_name: Column, *more: str) -> Column:
    """Scored arguments as they are written to files. more: further fields to keep (the scoring prompt, the raw answer)."""
    fields = lambda a: {"id": a.id, "arg_type": a.arg_type, "text": a.text, "evidence": a.evidence, "user_id": user_id, "target_item_name": target_name}
    return F.transform(args, lambda a: F.struct(*(c.alias(k) for k, c in fields(a).items()), *(a[k].alias(k) for k in ("llm_score", "llm_score_reason", *more, "mf_score", "combined_score")), F.parse_json(F.lit("{}")).alias("metadata")))


def from_objects(scored: Column) -> Column:
    """The arguments of scored_arguments as read from a file, numbered."""
    return F.transform(scored, lambda a, i: F.struct(i.cast("bigint").alias("pos"), *(a[k].alias(k) for k in ("id", "arg_type", "text", "evidence", "llm_score", "llm_score_reason", "mf_score", "combined_score"))))


class LLMScorer:
    """A semantic scorer: arguments (with prompt and mf_score) -> the same with raw, the scoring answer of each."""

    def score(self, arguments: DataFrame) -> DataFrame:
        raise NotImplementedError


class MFScorer:
    """A collaborative scorer: rows with index, user_id and example (with target_item) -> the same with mf_score."""

    def score(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


class GlobalRating(MFScorer):
    """The target's global rating on [0, 1]."""

    name = "global_rating"

    def __init__(self, default: float = DEFAULT_SCORE) -> None:
        self.default = default

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("mf_score", global_rating(F.col("example.target_item"), self.default))


class Predictions(MFScorer):
    """Scores looked up by user and target business."""

    def __init__(self, predictions: DataFrame, default: float = DEFAULT_SCORE, name: str = "predictions") -> None:
        self.predictions, self.default, self.name = predictions, default, name

    def score(self, rows: DataFrame) -> DataFrame:
        return predicted_scores(rows, self.predictions, "example.user_id", "example.target_item.business_id", self.default)


class ModelScorer(LLMScorer):
    """Scores generated by a model (generation.infer); equal prompts are answered once."""

    def __init__(self, load: Callable, **options) -> None:
        self.load, self.options = load, options

    def score(self, arguments: DataFrame) -> DataFrame:
        return generation.infer(arguments, "prompt", self.load, out="raw", **self.options)


def run(records: DataFrame, examples: DataFrame, llm: LLMScorer, mf: MFScorer, llm_weight: float = 0.5, mf_weight: float = 0.5, only_valid: bool = False, save_prompt: bool = False, save_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records with args scored, records with skip). Records have parsed and is_valid; records without a usable argument come out with an empty list."""
    score.check_weights(llm_weight, mf_weight)
    gated = gate(records, examples, only_valid, ("user_id", "history", "target_item"))
    taken = mf.score(gated.filter("skip is null").drop("skip"))
    if "mf_score" not in taken.columns:
        raise ValueError("a scorer must add mf_score")
    rows = argument_rows(taken.select("index", "parsed", "example", "mf_score"))[0]
    e = F.col("example")
    prompt = text.scoring_prompt(e.history, e.target_item, F.col("id"), F.col("arg_type"), F.col("text"), F.col("evidence"), F.col("bare"))
    said = llm.score(rows.withColumn("prompt", prompt).drop("example", "bare"))
    more = {k: F.col(c) for k, c, yes in (("llm_scoring_prompt", "prompt", save_prompt), ("llm_scoring_raw_output", "raw", save_raw)) if yes}
    args = collected(score_arguments(said, F.col("raw"), llm_weight, mf_weight).withColumns(more), ["index"])
    out = taken.drop("mf_score").join(args, "index", "left")
    return out.withColumn("args", F.coalesce("args", F.array().cast(dict(args.dtypes)["args"]))), gated.filter("skip is not null").select("index", "skip")
