"""Rule validation of generated arguments: an ordered list of errors for each record, without a shuffle of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.functions import json, text

#: Evidence that speaks of the history as a whole.
MARKERS = ("previous visits", "history", "other restaurants", "other choices", "favorite places")
KEYS = ("id", "type", "text", "evidence")
ARGUMENTS, PER_TYPE, MOST_EVIDENCE = 4, 2, 2
ERRORS = "array<struct<code:string,message:string>>"


def known_names(history: Column, target: Column) -> Column:
    """The distinct non-empty names of history items and target, as prompts show them: a null name is Unknown."""
    names = F.concat(F.coalesce(F.transform(text.items_present(history), lambda h: F.coalesce(h["name"], F.lit("Unknown"))), F.array().cast("array<string>")), F.array(F.coalesce(target["name"], F.lit("Unknown"))))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def _error(when: Column, code: str, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.when(when, F.struct(F.lit(code).alias("code"), F.concat(*parts).alias("message")))


def _present(*errors: Column) -> Column:
    return F.filter(F.array(*errors).cast(ERRORS), lambda e: e.isNotNull())


def _filled(v: Column) -> Column:
    """Whether a value is a text that isn't blank."""
    return F.coalesce(text.strip(json.as_text(v)) != "", F.lit(False))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _spelled(v: Column) -> Column:
    """A value as it is printed in messages: None, True, text as it is."""
    k = json.kind(v)
    return F.when(k.isNull() | (k == "NULL"), "None").when(k == "BOOLEAN", F.initcap(v.try_cast("string"))).when(k == "STRING", v.try_cast("string")).otherwise(F.to_json(v))


def _argument(a: Column, i: Column, names: Column) -> Column:
    """The errors of argument number i (from 1)."""
    n = i.cast("string")
    id_, type_, said, evidence = (_get(a, k) for k in KEYS)
    listed = json.elements(evidence).isNotNull()
    items = F.coalesce(json.elements(evidence), F.expr("cast(array() as array<variant>)"))

    def item(e: Column, j: Column) -> Column:
        s = json.as_text(e)
        known = F.exists(names, lambda x: F.contains(s, x)) | F.array_contains(F.array(*(F.contains(F.lower(s), F.lit(m)) for m in MARKERS)), True)
        bad = ~_filled(e)
        m = (j + 1).cast("string")
        return F.coalesce(
            _error(bad, "invalid_evidence_string", "Argument ", n, ", evidence ", m, " is empty or invalid."),
            _error(~F.coalesce(known, F.lit(False)), "weak_evidence_reference", "Argument ", n, ", evidence ", m, " does not mention a known item or aggregate history reference."),
        )

    size = F.size(items)
    missing = [_error(_get(a, k).isNull(), "missing_argument_key", "Argument ", n, f" is missing key '{k}'.") for k in KEYS]
    head = _present(
        *missing,
        _error(~_filled(id_), "invalid_argument_id", "Argument ", n, " has an invalid 'id'."),
        _error(~F.coalesce(json.as_text(type_).isin("support", "attack"), F.lit(False)), "invalid_argument_type", "Argument ", n, " has invalid type '", _spelled(type_), "'."),
        _error(~_filled(said), "invalid_argument_text", "Argument ", n, " has an empty or invalid 'text'."),
        _error(~listed, "invalid_evidence_list", "Argument ", n, " has invalid 'evidence' (must be a list)."),
        _error(listed & (size == 0), "empty_evidence_list", "Argument ", n, " has empty evidence."),
        _error(listed & (size > MOST_EVIDENCE), "too_many_evidence_items", "Argument ", n, " has more than 2 evidence strings."),
    )
    tail = F.filter(F.transform(items, item), lambda e: e.isNotNull())
    no_object = _present(_error(F.lit(True), "invalid_argument_object", "Argument ", n, " is not an object."))
    return F.when(json.is_object(a), F.concat(head, tail.cast(ERRORS))).otherwise(no_object)


def errors(parsed: Column, names: Column) -> Column:
    """All errors of a parsed answer, in the order of the rules."""
    args = json.elements(_get(parsed, "arguments"))

    def of_list(args: Column) -> Column:
        before = _present(_error(F.size(args) != ARGUMENTS, "wrong_argument_count", "Expected 4 arguments, got ", F.size(args), "."))
        each = F.flatten(F.transform(args, lambda a, i: _argument(a, i + 1, names)))
        heads = F.transform(F.filter(args, lambda a: json.is_object(a)), lambda a: F.struct(json.as_text(_get(a, "id")).alias("id"), json.as_text(_get(a, "type")).alias("type")))
        return F.concat(before, each, text.let(heads, after))

    def after(heads: Column) -> Column:
        ids = F.transform(F.filter(heads, lambda h: F.coalesce(text.strip(h.id) != "", F.lit(False))), lambda h: h.id)
        count = lambda t: F.size(F.filter(heads, lambda h: F.coalesce(h.type == t, F.lit(False))))
        return _present(
            text.let(ids, lambda x: _error(F.size(F.array_distinct(x)) != F.size(x), "duplicate_argument_ids", "Argument ids are not unique.")),
            text.let(count("support"), lambda n: _error(n != PER_TYPE, "wrong_support_count", "Expected 2 support arguments, got ", n, ".")),
            text.let(count("attack"), lambda n: _error(n != PER_TYPE, "wrong_attack_count", "Expected 2 attack arguments, got ", n, ".")),
        )

    checked = text.let(args, lambda x: F.when(x.isNull(), _present(_error(F.lit(True), "missing_arguments_list", "'arguments' field is missing or is not a list."))).otherwise(of_list(x)))
    return (
        F.when(parsed.isNull(), _present(_error(F.lit(True), "invalid_json", "Parsed JSON is None.")))
        .when(~json.is_object(parsed), _present(_error(F.lit(True), "invalid_root_object", "Parsed output is not a JSON object.")))
        .otherwise(checked)
    )


def validated(records: DataFrame, examples: DataFrame) -> DataFrame:
    """records (index, raw_output, ...) with parsed (VARIANT) and errors; names come from the example with the same number."""
    names = examples.select(F.col("idx").alias("index"), known_names(F.col("history"), F.col("target_item")).alias("names"))
    df = records.join(names, "index", "left").withColumn("parsed", json.extract_object(F.col("raw_output")))
    none = F.expr("cast(array() as array<string>)")
    return df.withColumn("errors", errors(F.col("parsed"), F.coalesce("names", none))).drop("names")


def verdict(errors: Column) -> Column:
    """The validation of a record as it is written to files: is_valid, errors, error_counts."""
    count = lambda code: F.size(F.filter(errors, lambda e: e.code == code)).cast("bigint")
    codes = F.array_distinct(F.transform(errors, lambda e: e.code))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), F.map_from_entries(F.transform(codes, lambda c: F.struct(c, count(c)))).alias("error_counts"))


def error_rows(checked: DataFrame) -> DataFrame:
    """index, pos (from 1), code, message of every error."""
    return checked.select("index", F.posexplode("errors").alias("pos", "e")).select("index", (F.col("pos") + 1).cast("bigint").alias("pos"), "e.code", "e.message")


def error_counts(checked: DataFrame) -> DataFrame:
    """Errors by code over all records."""
    return error_rows(checked).groupBy("code").agg(F.count("*").alias("n"))
