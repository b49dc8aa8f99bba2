"""Strict JSON objects in free text, as VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of the wrapper below, which no candidate holds.
_VALUE, _END = "\0v", "\0end"


def extract_object(text: Column) -> Column:
    """The JSON between the first { and the last } of a text, as VARIANT; null if it isn't one strict JSON value.

    The parser accepts text behind a value, so the candidate is parsed inside a wrapper, which then must have its two keys and no other.
    """
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    wrapped = F.concat(F.lit('{"\\u0000v":'), found, F.lit(',"\\u0000end":1}'))
    keys = F.transform(F.array(F.try_parse_json(wrapped).try_cast("map<string,variant>")), lambda m: F.when(F.map_keys(m) == F.array(F.lit(_END), F.lit(_VALUE)), m[_VALUE]))
    return keys[0]


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL (JSON null) or null (missing)."""
    s = F.regexp_replace(F.schema_of_variant(v), r"<.*|\(.*", "")
    return F.when(s.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), s).when(s == "VOID", "NULL").when(s.isNotNull(), "NUMBER")


def as_text(v: Column) -> Column:
    """A STRING value; null for any other kind."""
    return F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))


def is_object(v: Column) -> Column:
    """Whether a value is an OBJECT; false for null."""
    return v.try_cast("map<string,variant>").isNotNull()


def elements(v: Column) -> Column:
    """The elements of an ARRAY value; null for any other kind."""
    return v.try_cast("array<variant>")
