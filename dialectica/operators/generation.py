"""Text generation behind one Python hook, and selection of the examples to generate for."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.functions import text
from dialectica.session import materialize, numbered

def select_slice(examples: DataFrame, start: int, count: int, key: str = "idx") -> DataFrame:
    """Examples number start to start + count - 1."""
    if start < 0 or count < 0:
        raise ValueError("start and count must not be negative")
    return examples.filter(F.col(key).between(start, start + count - 1))


def select_random(examples: DataFrame, count: int, seed: int | None, key: str = "idx") -> DataFrame:
    """count examples drawn without replacement, with draw (the order of drawing); keys are distinct, and may have gaps. The draw itself is a list of count numbers."""
    total = examples.count()
    if count > total:
        raise ValueError(f"{count} of {total} examples")
    drawn = random.Random(seed).sample(range(total), count)
    rows = examples.sparkSession.createDataFrame([(k, i) for i, k in enumerate(drawn)], "__number bigint, draw bigint")
    # Keys may have gaps, so their places are drawn.
    keys = numbered(examples.select(key), "__number")
    return examples.join(keys.join(rows, "__number").select(key, "draw"), key)


def one(records: DataFrame, number: int, key: str = "index", order: str | None = None) -> DataFrame:
    """The record of a number (the first by `order` if there are several); an error if there is none."""
    df = records.filter(F.col(key) == number)
    df = (df.orderBy(order) if order else df).limit(1)
    if df.isEmpty():
        raise ValueError(f"no record with {key} = {number}")
    return df


def infer(prompts: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list[str]]], out: str = "raw_output", deduplicate: bool = True, batch: int = 64) -> DataFrame:
    """prompts with the generated text of `column` in `out`.

    load() runs once in each Python worker and gives a function from prompts to answers. Equal prompts are generated
    once unless deduplicate is off (as it must be when answers are sampled). The answers are materialised, so that
    filters on what is parsed from them never run the model again. A null prompt has a null answer.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part.assign(**{out: [(a or "").strip() for a in model(list(part[column]))]})

    asked = prompts.filter(F.col(column).isNotNull())
    if not deduplicate:
        with_answer = asked.select("*").mapInPandas(run, asked.withColumn(out, F.lit("").cast("string")).schema)
        return materialize(with_answer.unionByName(prompts.filter(F.col(column).isNull()).withColumn(out, F.lit(None).cast("string"))))
    once = asked.select(column).distinct()
    answers = materialize(once.mapInPandas(run, once.withColumn(out, F.lit("").cast("string")).schema))
    return prompts.join(answers, column, "left")


def template_answer(history: Column, target: Column) -> Column:
    """A deterministic answer of valid form, for tests and runs without a model: two supports, two attacks."""
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    target_name = F.coalesce(target["name"], F.lit("Unknown"))
    item = F.try_element_at(text.items_present(history), F.lit(1))
    seen = F.when(item.isNotNull(), F.coalesce(item["name"], F.lit("Unknown"))).otherwise(F.lit("previous visits"))
    args = [
        ("A1", "support", F.concat(target_name, F.lit(" resembles "), seen, F.lit(".")), seen),
        ("A2", "support", F.concat(F.lit("The history fits "), target_name, F.lit(".")), F.concat(F.lit("history with "), seen)),
        ("A3", "attack", F.concat(target_name, F.lit(" may disappoint.")), target_name),
        ("A4", "attack", F.concat(F.lit("Nothing else speaks for "), target_name, F.lit(".")), target_name),
    ]
    parts = [F.concat(F.lit(f'{{"id": "{i}", "type": "{t}", "text": '), quote(s), F.lit(', "evidence": ['), quote(e), F.lit("]}")) for i, t, s, e in args]
    return F.concat(F.lit('{"arguments": ['), F.concat_ws(", ", *parts), F.lit("]}"))
