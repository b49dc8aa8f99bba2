import random

import pytest
from pyspark.sql import functions as F

from dialectica.operators import examples, generation, graph, ratings, report, scoring, validate
from dialectica.sources import readers, sinks


def naive_history(rows):
    """rows of one user: (business, stars, text, date, ord) -> (target ord, history ords in order)."""
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    target, pool = rows[-1], rows[:-1]
    good, bad = [r for r in pool if r[1] >= 4][-2:], [r for r in pool if r[1] <= 2][-2:]
    chosen = good + bad
    seen = {(r[0], r[3], r[2]) for r in chosen}
    for r in reversed(pool):
        if len(chosen) >= 5:
            break
        if (r[0], r[3], r[2]) not in seen:
            seen.add((r[0], r[3], r[2]))
            chosen.append(r)
    return target[4], [r[4] for r in sorted(chosen, key=lambda r: r[3])]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_split_history_equals_the_naive_rule(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    r = random.Random(3)
    rows = [(f"u{r.randrange(40)}", f"b{r.randrange(3)}", r.choice([1.0, 2.0, 3.0, 3.5, 4.0, 5.0]), r.choice("xy") * 30, f"2020-01-0{r.randrange(1, 4)}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id string, business_id string, user_stars double, review_text string, date string, ord bigint")
    got = {}
    for x in examples.split_history(df).collect():
        t, h = got.setdefault(x.user_id, [None, {}])
        if x.role == "target":
            got[x.user_id][0] = x.ord
        else:
            h[x.pos] = x.ord
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for u in {x[0] for x in rows}:
        t, h = naive_history([x[1:] for x in rows if x[0] == u])
        assert got[u][0] == t and [got[u][1][k] for k in sorted(got[u][1])] == h


def test_limit_comes_before_the_least_history(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "user_id string, n bigint")
    assert examples.sample_users(df.filter("n = 5"), 2).count() == 0
    assert {r.user_id for r in examples.sample_users(df, 3).collect()} == {"c"}


def test_businesses_and_reviews_with_nulls(spark):
    b = spark.createDataFrame(
        [("1", "A", " Restaurants , Bars", None, 3.0, 1, 1), ("1", "B", "Restaurants", {"a": "b"}, 4.0, 2, 2), ("1", "C", "Bars", None, 1.0, 1, 3), ("2", None, None, None, None, None, 1), (None, "N", "Restaurants", None, None, None, 1)],
        "business_id string, name string, categories string, attributes map<string,string>, stars double, review_count bigint, snapshot_at int",
    )
    out = {r.business_id: r.name for r in examples.clean_businesses(b).collect()}
    assert out == {"1": "B", None: "N"}
    long = "x" * 30
    r = spark.createDataFrame([("u", "1", 5.0, f" {long} ", None, 0), ("u", "1", None, long, "d", 1), ("u", "9", 1.0, long, "d", 2), ("u", "1", 1.0, "short", "d", 3), (None, "1", 1.0, long, "d", 4), ("u", "1", 1.0, None, "d", 5)], "user_id string, business_id string, stars double, text string, date string, ord bigint")
    assert [tuple(x) for x in examples.filter_reviews(r, examples.clean_businesses(b)).collect()] == [("u", "1", 5.0, long, "", 0)]
    assert examples.filter_reviews(r.limit(0), examples.clean_businesses(b.limit(0))).count() == 0


EXAMPLE = {"history": [{"name": "Pho Bar"}], "target_item": {"name": "Grill"}}


def record(n=4, **change):
    kinds = ["support", "support", "attack", "attack"]
    return {"arguments": [{"id": f"A{i + 1}", "type": kinds[i], "text": "t", "evidence": ["Pho Bar"]} | change.get(f"a{i}", {}) for i in range(n)]}


def codes(spark, raw):
    e = spark.createDataFrame([(1, [("Pho Bar",)], ("Grill",))], "idx bigint, history array<struct<name:string>>, target_item struct<name:string>")
    r = spark.createDataFrame([(1, raw)], "index bigint, raw_output string")
    return [(x.code, x.message) for x in validate.error_rows(validate.validated(r, e)).orderBy("pos").collect()]


def test_validation_rules(spark):
    import json

    j = json.dumps
    assert codes(spark, "prose " + j(record()) + " more") == []
    assert codes(spark, j(record())[:-1]) == [("invalid_json", "Parsed JSON is None.")]
    assert codes(spark, j({"args": []})) == [("missing_arguments_list", "'arguments' field is missing or is not a list.")]
    assert codes(spark, j(record(3))) == [("wrong_argument_count", "Expected 4 arguments, got 3."), ("wrong_attack_count", "Expected 2 attack arguments, got 1.")]
    seven = record()
    seven["arguments"][1] = 7
    assert codes(spark, j(seven)) == [("invalid_argument_object", "Argument 2 is not an object."), ("wrong_support_count", "Expected 2 support arguments, got 1.")]
    gone = record()
    del gone["arguments"][0]["text"]
    assert [c for c, _ in codes(spark, j(gone))] == ["missing_argument_key", "invalid_argument_text"]
    assert codes(spark, j(record(a0={"text": None}))) == [("invalid_argument_text", "Argument 1 has an empty or invalid 'text'.")]
    assert codes(spark, j(record(a2={"type": "neutral"}))) == [("invalid_argument_type", "Argument 3 has invalid type 'neutral'."), ("wrong_attack_count", "Expected 2 attack arguments, got 1.")]
    assert codes(spark, j(record(a2={"type": None})))[0][1] == "Argument 3 has invalid type 'None'."
    assert codes(spark, j(record(a1={"id": "A1"}))) == [("duplicate_argument_ids", "Argument ids are not unique.")]
    assert codes(spark, j(record(a0={"evidence": "x"}))) == [("invalid_evidence_list", "Argument 1 has invalid 'evidence' (must be a list).")]
    assert [c for c, _ in codes(spark, j(record(a0={"evidence": []}, a1={"evidence": ["Grill"] * 3})))] == ["empty_evidence_list", "too_many_evidence_items"]
    assert [c for c, _ in codes(spark, j(record(a0={"evidence": ["", "unrelated"]}, a1={"id": " "})))] == ["invalid_evidence_string", "weak_evidence_reference", "invalid_argument_id"]
    assert codes(spark, j(record(a0={"evidence": ["Previous VISITS"]}))) == []
    assert codes(spark, None) == [("invalid_json", "Parsed JSON is None.")]


def test_score_answers(spark):
    raw = ['{"score":1.7,"reason":" ok "}', '{"score":"0.8","reason":"r"}', '{"score":true}', '{"score":-1,"reason":""}', "nope", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    s, r = scoring.parse_score(F.col("x"))
    d = scoring.DEFAULT_REASON
    assert [tuple(x) for x in df.select("i", s, r).orderBy("i").select("*").collect()] == [(0, 1.0, "ok"), (1, 0.5, "r"), (2, 1.0, d), (3, 0.0, d), (4, 0.5, d), (5, 0.5, d)]


def scored(spark, rows):
    """One record of arguments (id, type, combined score), evaluated."""
    args = [(i, k, t, "</script><b>", ["e"], None, None, None, c) for i, (k, t, c) in enumerate(rows)]
    kind = "array<struct<pos:bigint,id:string,arg_type:string,text:string,evidence:array<string>,llm_score:double,llm_score_reason:string,mf_score:double,combined_score:double>>"
    df = spark.createDataFrame([(1, "Grill", args), (2, "Empty", []), (3, None, None)], f"index bigint, target_name string, args {kind}")
    return graph.evaluate(graph.with_graph(df))


def test_duplicate_node_ids_take_the_last_score_for_both_edges(spark):
    r = scored(spark, [("A1", "support", 0.9), ("A1", "attack", 0.2)]).collect()
    assert [(x.support_scores, x.attack_scores, x.final_score) for x in r] == [([0.2], [0.2], 0.5)]
    assert [(n.node_id, n.pos) for n in r[0].nodes] == [("ROOT", -1), ("A1", 0)]


def test_an_argument_called_root_replaces_the_root(spark):
    r = scored(spark, [("ROOT", "support", 0.9), ("A2", "other", 0.1)]).first()
    assert r.root_base_score == 0.9 and r.attack_scores == [0.1] and len(r.nodes) == 2


def test_layout(spark):
    place = lambda rows: {r.node_id: (r.x, r.y) for r in scored(spark, rows).select(F.inline(graph.layout(F.col("nodes"), F.col("edges")))).collect()}
    assert place([(f"A{i}", "support", 0.5) for i in range(3)] + [("B", "attack", 0.5)]) == {"ROOT": (700, 450), "A0": (260, 140), "A1": (260, 450), "A2": (260, 760), "B": (1140, 450)}
    # Equal ids take a place each: the node has the last one, on the right if it attacks at all.
    assert place([("A", "support", 0.5), ("A", "support", 0.5), ("B", "attack", 0.5), ("B", "support", 0.5), (None, "x", 0.5)]) == {"ROOT": (700, 450), "A": (260, 450), "B": (1140, 140), None: (1140, 760)}


def test_page_escapes_script_ends(spark):
    html = graph.pages(scored(spark, [("A1", "support", 0.9)]).withColumn("context", F.expr("cast(null as struct<" + readers.CONTEXT + ">)"))).first().html
    assert html.count("</script>") == 2 and "<b>" not in html.split("<script")[1] and "No source context" in html


def test_graph_object_and_back(spark):
    import json

    df = scored(spark, [("A 1", "support", 0.9), ("B", "attack", 0.0004)])
    one = df.select(F.to_json(graph.graph_object(F.col("nodes"), F.col("edges"))).alias("g"), "nodes", "edges").first()
    g = json.loads(one.g)
    assert g["nodes"]["B"]["base_score"] == 0.0004 and g["nodes"]["ROOT"]["metadata"] == {"target_item_name": "Grill"} and g["nodes"]["A 1"]["metadata"]["llm_score"] is None and g["edges"][1]["relation_type"] == "attack"
    back = spark.createDataFrame([(one.g,)], "g string").select(F.from_json("g", f"struct<{readers.GRAPH}>").alias("g"))
    n, e = graph.from_object(F.col("g"))
    r = back.select(n.alias("nodes"), e.alias("edges")).first()
    assert r.edges == one.edges and [(x.node_id, x.pos, x.base_score, x.arg_type, x.target_item_name) for x in r.nodes] == [(x.node_id, x.pos, x.base_score, x.arg_type, x.target_item_name) for x in one.nodes]


def test_numbers_as_text(spark):
    from dialectica.functions import text

    values = [0.5, 1.0, 0.00025, 0.0001, 0.00001, 3e-7, 1.5e-10, 0.1 + 0.2, 0.0, 123456.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.number(F.col("v"))).collect()] == [None if v is None else repr(v) for v in values]


def test_graphs_are_made_in_the_records_row(spark, data):
    """The only exchanges are those that keep first deliveries, which also serve the join of records and examples."""
    from dialectica.plans import core

    for q in ("dfquad_root", "graph_pages", "score_arguments"):
        plan = core.QUERIES[q](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and "Join" in plan, (q, plan)


def test_precomputed_scores(spark):
    e = spark.createDataFrame([(1, "u", ("b",)), (2, "u", ("c",)), (3, "v", ("b",)), (4, None, ("b",))], "idx bigint, user_id string, target_item struct<business_id:string>")
    p = readers.parse_predictions(spark.createDataFrame([('[{"user_id":"u","business_id":"b","score":0.1},{"user_id":"u","business_id":"b","score":1.4},{"user_id":"u","score":1}]',), ('{"u|||c": -0.2, "ub": 1}',)], "value string"))
    a = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "index bigint")
    assert {r["index"]: r.mf_score for r in scoring.precomputed_scores(a, e, p).collect()} == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.5}


def test_ratings(spark):
    e = spark.createDataFrame([(1, "u", [("a", 5.0), ("a", 5.0), ("a", 4.0), None, ("", 1.0), ("c", None)], ("t", 2.0)), (2, None, [("a", 1.0)], ("t", 1.0)), (3, "w", None, None)], "idx bigint, user_id string, history array<struct<business_id:string,user_stars:double>>, target_item struct<business_id:string,user_target_stars:double>")
    assert sorted(tuple(r) for r in ratings.rating_rows(e).collect()) == [("u", "a", 4.0), ("u", "a", 5.0)]
    assert ratings.rating_rows(e, include_target=True).count() == 3 and ratings.rating_rows(e, deduplicate=False).count() == 3
    assert ratings.rating_summary(ratings.rating_rows(e.limit(0))).first().num_rows == 0


def test_generation_hook_runs_once_for_each_distinct_prompt(spark, tmp_path):
    log = str(tmp_path / "calls")

    def load():
        def model(prompts):
            with open(log, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [p.upper() for p in prompts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, p string")
    out = generation.infer(df, "p", load).filter("raw_output <> 'X' or raw_output is null")
    assert {r.i: r.raw_output for r in out.collect()} == {1: "A", 2: "A", 3: "B", 4: None}
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_selection_errors(spark):
    df = spark.range(3).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError):
        generation.select_random(df, 4, 1)
    with pytest.raises(ValueError):
        generation.select_slice(df, -1, 2)
    with pytest.raises(ValueError):
        generation.one(df, 9, "idx")


def test_summary_of_examples(spark):
    e = spark.createDataFrame([(1, [(4.0,), (2.0,), (None,), None], (3.5, "abc")), (2, None, (None, None))], "idx bigint, history array<struct<user_stars:double>>, target_item struct<user_target_stars:double,target_review_text:string>")
    r = report.example_summary(e).first()
    assert (r.n, r.avg_history, r.avg_positive, r.avg_negative, r.targets_neutral, r.targets_negative, r.avg_target_length) == (2, 1.5, 0.5, 1.0, 1, 1, 1.5)


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"user_id": "a", "stars": 1}\n\n{"user_id": "b"}\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(p), readers.REVIEW).orderBy("ord").collect()
    assert [(r.ord, r.user_id, r.stars) for r in rows] == [(0, "a", 1.0), (2, "b", None)]
    with pytest.raises(Exception, match="blank line, number 1"):
        readers.json_lines(spark, str(p), readers.REVIEW, blanks="fail").collect()
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), readers.REVIEW).collect()
    c = tmp_path / "r.csv"
    c.write_text("user_id,x\nu,1\n")
    with pytest.raises(ValueError, match="business_id.*rating"):
        readers.rating_csv(spark, str(c))
    assert sinks.split_paths("a/b")["valid"] == "a/b_valid.jsonl"
    recs = spark.createDataFrame([(1, (True, [])), (2, (False, [("c", "m")]))], "index bigint, validation struct<is_valid:boolean,errors:array<struct<code:string,message:string>>>")
    paths = sinks.split_records(recs, str(tmp_path / "out.jsonl"))
    assert spark.read.json(paths["invalid"]).count() == 1 and "error_counts" in open(paths["summary"]).read()


def test_lines_are_numbered_file_by_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for k, n in enumerate((3, 400, 0, 50, 1)):
        (folder / f"part-{k:05}.txt").write_text("".join(f"{k}:{i}\n" for i in range(n)))
        want += [f"{k}:{i}" for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "300" else "4194304")
            got = readers.lines(spark, str(folder)).orderBy("ord").collect()
            assert [r.ord for r in got] == [*range(len(want))] and [r.line for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_predictions_of_wrong_types_are_dropped(spark, tmp_path):
    good = '{"user_id": "u", "business_id": "b", "score": 0.5}'
    bad = ['{"user_id": 7, "business_id": "b", "score": 0.5}', '{"user_id": "u", "business_id": "b", "score": "0.9"}', '{"user_id": "u", "business_id": null, "score": 1}', "null", "4", '["u"]', '{"user_id": "u", "business_id": "b", "score": {}}']
    df = spark.createDataFrame([("[" + ", ".join([good, *bad]) + "]",), ('{"u|||c|||d": true, "x|||y": "0.5", "z": 1, "v|||w": null}',), ("7",), ("nope",), (None,)], "value string")
    assert sorted((r.user_id, r.business_id, r.score) for r in readers.parse_predictions(df).collect()) == [("u", "b", 0.5), ("u", "c|||d", 1.0)]
    (tmp_path / "p.jsonl").write_text("\n".join([*bad, good, "{broken", good.replace("0.5", "0.7")]))
    assert [(r.user_id, r.score) for r in readers.predictions(spark, str(tmp_path / "p.jsonl")).orderBy("pos").collect()] == [("u", 0.5), ("u", 0.7)]
    (tmp_path / "p.json").write_text("[" + good + ",\n" + bad[0] + "]")
    assert readers.predictions(spark, str(tmp_path / "p.json")).count() == 1


def test_template_model_answers_as_the_expression(spark, data):
    from dialectica.functions import text
    from dialectica.operators import models
    from dialectica.plans import core

    rows = core.given(spark, data).select(text.argument_prompt(F.col("history"), F.col("target_item")).alias("p"), generation.template_answer(F.col("history"), F.col("target_item")).alias("a")).collect()
    assert models.loader(models.ModelConfig())()([r.p for r in rows]) == [r.a for r in rows]
    assert models.ModelConfig(do_sample=True).settings(3) == {"max_new_tokens": 650, "do_sample": True, "temperature": 0.2, "top_p": 0.9, "pad_token_id": 3} and models.SCORING.settings() == {"max_new_tokens": 300, "do_sample": False}
    assert [m["role"] for m in models.messages("x")] == ["system", "user"]


def test_draws_take_as_many_examples_as_asked_though_keys_have_gaps(spark):
    df = spark.createDataFrame([(k * k + 5,) for k in range(40)], "idx bigint")
    rows = generation.select_random(df, 12, 3).collect()
    assert sorted(r.draw for r in rows) == [*range(12)] and len({r.idx for r in rows}) == 12


def test_split_and_examples_of_all_users(spark, tmp_path):
    from dialectica.plans import core

    r = random.Random(5)
    users = {f"u{i}": r.choice([5, 6, 7, 9, 50, 51]) for i in range(260)}
    rows = [(u, f"b{r.randrange(4)}", r.choice([1.0, 2.0, 3.0, 4.0, 5.0]), r.choice("xy") * 30, f"2020-01-0{r.randrange(1, 4)}") for u, n in users.items() for _ in range(n)]
    r.shuffle(rows)
    rows = [(*x, i) for i, x in enumerate(rows)]
    spark.createDataFrame(rows, "user_id string, business_id string, stars double, text string, date string, ord bigint").write.parquet(f"{tmp_path}/raw_review.parquet")
    business = [(f"b{i}", f"B{i}", "Restaurants", None, 4.0, 1, i) for i in range(4)]
    spark.createDataFrame(business, "business_id string, name string, categories string, attributes map<string,string>, stars double, review_count bigint, snapshot_at int").write.parquet(f"{tmp_path}/raw_business.parquet")
    want = {u: naive_history([x[1:] for x in rows if x[0] == u]) for u, n in users.items() if 6 <= n <= 50}
    assert len(want) > examples.SAMPLE
    q, of = core.QUERIES, {x[5]: x[1] for x in rows}
    assert {x.user_id: x.ord for x in q["target_item_all"](spark, str(tmp_path)).collect()} == {u: t for u, (t, _) in want.items()}
    assert {(x.user_id, x.pos): x.ord for x in q["history_items_all"](spark, str(tmp_path)).collect()} == {(u, k): o for u, (_, h) in want.items() for k, o in enumerate(h, 1)}
    assert {x.user_id: (x.n_history, x.history, x.target) for x in q["examples_built_all"](spark, str(tmp_path)).collect()} == {u: (len(h), "|".join(of[o] for o in h), of[t]) for u, (t, h) in want.items()}
    assert q["target_item"](spark, str(tmp_path)).count() <= examples.SAMPLE


def naive_arguments(table):
    """{(index, pos): argument} of the first deliveries of all records with readable JSON, without those that lack a key."""
    import json

    rows = {}
    for r in sorted(table.collect(), key=lambda r: r.generated_at, reverse=True):
        rows[r["index"]] = r.parsed_json
    parsed = {i: json.loads(p) for i, p in rows.items() if p is not None}
    return {(i, k): a for i, v in parsed.items() if isinstance(v.get("arguments"), list) for k, a in enumerate(v["arguments"]) if isinstance(a, dict) and {"id", "type", "text", "evidence"} <= set(a)}


def test_arguments_and_graphs_of_all_records(spark, data):
    from math import prod

    from dialectica.plans import core

    table = spark.read.parquet(f"{data}/generation_results.parquet")
    want, q = naive_arguments(table), core.QUERIES
    invalid = {r["index"] for r in table.filter("not validation.is_valid").collect()}
    assert {i for i, _ in want} & invalid
    got = {(r["index"], r.pos): (r.id, r.arg_type, r.text, r.evidence) for r in q["arguments"](spark, data).collect()}
    assert got == {k: (a["id"], a["type"], a["text"], "|".join([a["evidence"]] if isinstance(a["evidence"], str) else a["evidence"])) for k, a in want.items()}
    assert {(r["index"], r.pos) for r in q["scoring_prompt"](spark, data).collect()} == set(want)
    graphs = {}
    for r in q["score_arguments"](spark, data).orderBy("index", "pos").collect():
        nodes, links = graphs.setdefault(r["index"], ({}, []))
        nodes[r.id] = r.combined_score
        links.append((r.id, r.arg_type == "support"))
    final = {r["index"]: r.final_score for r in q["dfquad_root"](spark, data).collect()}
    assert set(final) == {i for i, _ in want} == {r["index"] for r in q["graph_pages"](spark, data).collect()}
    for i, (nodes, links) in graphs.items():
        up, down = (1 - prod(1 - nodes[k] for k, s in links if s is side) for side in (True, False))
        assert abs(final[i] - (0.5 + 0.5 * (up - down))) < 1e-5, i


def test_evidence_that_is_one_text_is_kept(spark):
    import json

    from dialectica.functions import json as variants
    from dialectica.functions import text

    odd = record(3, a0={"evidence": 'Pho "Bar"'}, a1={"id": "A1"})
    df = spark.createDataFrame([(1, "u", "Grill", json.dumps(odd))], "index bigint, user_id string, target_name string, raw string").withColumn("parsed", variants.extract_object(F.col("raw")))
    rows, gone = scoring.argument_rows(df)
    assert [(r.id, r.evidence, r.bare) for r in rows.orderBy("pos").collect()] == [("A1", ['Pho "Bar"'], True), ("A1", ["Pho Bar"], False), ("A3", ["Pho Bar"], False)] and gone.count() == 0
    item = "struct<name:string,categories:array<string>,attributes:map<string,string>,user_stars:double,global_stars:double>"
    prompts = rows.withColumns({"h": F.expr(f"cast(null as array<{item}>)"), "t": F.expr(f"cast(null as {item})")}).orderBy("pos").select(text.scoring_prompt(F.col("h"), F.col("t"), F.col("id"), F.col("arg_type"), F.col("text"), F.col("evidence"), F.col("bare"))).collect()
    assert prompts[0][0].endswith('\nevidence: "Pho \\"Bar\\""') and prompts[1][0].endswith('\nevidence: ["Pho Bar"]')


def test_precomputed_scores_of_all_predictions(spark, data):
    from dialectica.plans import core

    predicted = core.QUERIES["mf_bias_predictions"](spark, data).collect()
    last = {(r.user_id, r.business_id): r.score for r in sorted(predicted, key=lambda r: r.idx)}
    keys = {r.idx: (r.user_id, r.target_item and r.target_item.business_id) for r in core.given(spark, data).collect()}
    got = {r["index"]: r.mf_score for r in core.QUERIES["mf_precomputed_score"](spark, data).collect()}
    assert set(got) == set(keys) and all(abs(got[i] - last.get(k, 0.5)) < 1e-5 for i, k in keys.items())
    assert any(got[i] != 0.5 for i in got)


def test_a_prediction_that_is_missing_gives_the_default(spark):
    e = spark.createDataFrame([(1, "u", ("b",)), (3, "u", ("c",))], "idx bigint, user_id string, target_item struct<business_id:string>")
    p = spark.createDataFrame([("u", "b", 0.9, 1)], "user_id string, business_id string, score double, pos bigint")
    assert {r["index"]: r.mf_score for r in scoring.precomputed_scores(e.select(F.col("idx").alias("index")), e, p).collect()} == {1: 0.9, 3: 0.5}
