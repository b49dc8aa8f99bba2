import pytest
from pyspark.sql import functions as F

from dialectica.functions import json, score, text


def values(spark, kind, rows, expr):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_normalize_rating(spark):
    assert values(spark, "double", [1.0, 3.0, 5.0, 4.3, 4.0, 0.0, 6.0, None], lambda c: F.round(score.normalize_rating(c), 9)) == [0, 0.5, 1, 0.825, 0.75, 0, 1, None]


def test_probabilistic_sum(spark):
    rows = [[], [0.5, 0.25], [0.8, 0.6], [0.4, 0.3], [1.0, 0.2], [-1.0, 2.0]]
    assert values(spark, "array<double>", rows, lambda c: F.round(score.probabilistic_sum(c), 9)) == [0, 0.625, 0.92, 0.58, 1, 1]


def test_gradual(spark):
    rows = [(0.5, 0.58, 0.92), (0.5, 0.7, 0.2), (0.3, 0.4, 0.4), (1.0, 0.0, 1.0), (0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "b double, a double, s double")
    assert [r[0] for r in df.select(F.round(score.gradual(F.col("b"), F.col("a"), F.col("s")), 9)).collect()] == [0.67, 0.25, 0.3, 1, 0]


def test_weights():
    score.check_weights(1.5, -0.5)
    with pytest.raises(ValueError):
        score.check_weights(0.6, 0.5)


def test_base_score(spark):
    df = spark.createDataFrame([(None, 0.4, 0.9), (None, None, 0.9), (None, None, None), (0.0, 0.4, 0.9)], "c double, l double, m double")
    assert [r[0] for r in df.select(score.base_score(F.col("c"), F.col("l"), F.col("m"))).collect()] == [0.4, 0.9, 0.5, 0]


def test_clean_attribute(spark):
    rows = ["u'casual'", "'none'", "None", " u'full_bar' ", "", None, "True", "\t a \n", " u'none' ", "u' a '"]
    assert values(spark, "string", rows, text.clean_attribute) == ["casual", None, None, "full_bar", "", None, "True", "a", None, " a "]


def test_strip_takes_all_white_space(spark):
    assert values(spark, "string", ["　\t a b  \n", "", None], text.strip) == ["a b", "", None]


def test_prompt_lines(spark):
    item = "named_struct('name', 'Sushi Place', 'categories', array('Japanese', 'Sushi Bars'), 'attributes', cast(null as map<string,string>), 'user_stars', 5D)"
    df = spark.sql(f"select array(null, {item}) h, named_struct('name', 'BBQ Grill', 'categories', array('BBQ', 'American'), 'attributes', map('OutdoorSeating', 'True', 'X', 'y'), 'global_stars', 4.0D) t")
    r = df.select(text.history_text(F.col("h")), text.target_text(F.col("t")), text.argument_prompt(F.col("h"), F.col("t"))).first()
    assert r[0] == "1. Sushi Place | categories: Japanese, Sushi Bars | rating: 5"
    assert r[1] == "BBQ Grill | categories: BBQ, American | attributes: outdoor_seating=True | global_rating: 4.0"
    assert r[2].endswith("TARGET_ITEM:\n" + r[1]) and '"id": "A1"' in r[2] and "{history}" not in r[2]


def test_slots_are_not_searched_in_what_is_filled_in(spark):
    assert spark.range(1).select(text.fill("a {x} b {y}", x=F.lit("{y}"), y=F.lit("2"))).first()[0] == "a {y} b 2"


def test_json_array_and_html(spark):
    df = spark.createDataFrame([(['é "q"', "b"], "<a href='x'>&\"")], "e array<string>, h string")
    assert df.select(text.json_array(F.col("e")), text.escape_html(F.col("h"))).first()[:] == ('["é \\"q\\"", "b"]', "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;")


def test_extract_object(spark):
    rows = ['x {"a":1} y', '{"a":1} {"b":2}', "}{", "{'a':1}", '{"a":1,"a":2}', None, "", "[1]", '{"a":1},"b":{"c":2}']
    assert values(spark, "string", rows, lambda c: F.to_json(json.extract_object(c))) == ['{"a":1}', None, None, None, '{"a":2}', None, None, None, None]


def test_properties_of_the_semantics(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(300):
        s = [round(r.random(), 3) for _ in range(r.randrange(0, 6))]
        b, a = round(r.random(), 3), round(r.random(), 3)
        rows.append((i, s, sorted(s), s + [1.0], [min(1.0, x + 0.1) for x in s], b, a))
    df = spark.createDataFrame(rows, "i int, s array<double>, t array<double>, u array<double>, v array<double>, b double, a double")
    p = score.probabilistic_sum
    out = df.select(p(F.col("s")).alias("s"), p(F.col("t")).alias("t"), p(F.col("u")).alias("u"), p(F.col("v")).alias("v"), "b", "a")
    g = score.gradual
    out = out.select("*", g(F.col("b"), F.col("a"), F.col("s")).alias("g"), g(F.col("b"), F.col("a"), F.col("v")).alias("more"), g(F.col("b"), F.col("v"), F.col("s")).alias("x"), g(F.col("b"), F.col("s"), F.col("s")).alias("same"))
    for x in out.collect():
        assert 0 <= x.s <= 1 and abs(x.s - x.t) < 1e-12 and x.u == 1 and x.v >= x.s - 1e-12
        assert 0 <= x.g <= 1 and x.more >= x.g - 1e-12 and 0 <= x.x <= 1 and abs(x.same - x.b) < 1e-12


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    r = df.select(score.clamp(F.col("a")), score.clamp(F.col("b")), score.normalize_score(F.col("b")), score.gradual(F.col("a"), F.lit(0.1), F.lit(0.2))).first()
    assert r[0] is None and r[1] == 1.0 and r[2] != r[2] and r[3] is None
