import json
import os

import pytest
from pyspark.sql import functions as F

from dialectica import __main__ as cli
from dialectica.operators import examples
from dialectica.streaming import pipeline


def test_commands_from_files_to_files(spark, tmp_path, capsys):
    t = lambda x: str(tmp_path / x)
    with open(t("b.jsonl"), "w") as f:
        f.writelines(json.dumps({"business_id": f"b{i}", "name": f"Place {i}", "categories": "Restaurants, Bars", "stars": 3.5, "review_count": 9, "attributes": {"Alcohol": "u'none'", "OutdoorSeating": "True"}}) + "\n" for i in range(8))
    with open(t("r.jsonl"), "w") as f:
        f.writelines(json.dumps({"user_id": f"u{i % 3}", "business_id": f"b{i % 8}", "stars": 1 + i % 5, "text": "a long enough review text " * 2, "date": f"2020-01-{i + 1:02}"}) + "\n" for i in range(24))
    run = cli.main
    run(["build-examples", "--businesses", t("b.jsonl"), "--reviews", t("r.jsonl"), "--output", t("e")])
    assert spark.read.json(t("e")).count() == 3
    run(["build-ratings", "--input", t("e"), "--output", t("m")])
    run(["train", "--ratings", t("m"), "--input", t("e"), "--output", t("p")])
    assert spark.read.json(t("p")).count() == 3
    run(["generate", "--input", t("e"), "--output", t("g.jsonl"), "--num-examples", "3", "--save-prompt"])
    assert spark.read.json(t("g_valid.jsonl")).count() == 3 and json.load(open(t("g_summary.json")))["num_valid"] == 3
    assert isinstance(first(t("g.jsonl"))["parsed_json"]["arguments"], list)
    run(["score", "--dataset", t("e"), "--input", t("g.jsonl"), "--output", t("s"), "--only-valid", "--save-llm-prompt", "--save-llm-raw", "--mf-predictions", t("p")])
    s = first(t("s"))
    assert s["scoring"] == {"llm_model": "template", "llm_weight": 0.5, "mf_weight": 0.5, "mf_source": t("p")} and s["raw_output"] and s["validation"]["is_valid"]
    arg = s["scored_arguments"][0]
    assert (arg["id"], arg["arg_type"], arg["llm_score"], arg["user_id"], arg["metadata"]) == ("A1", "support", 0.5, s["user_id"], {}) and arg["llm_scoring_prompt"].startswith("You are an evaluator") and arg["llm_scoring_raw_output"]
    assert abs(arg["combined_score"] - (0.25 + arg["mf_score"] / 2)) < 1e-12 and json.load(open(t("s_summary.json")))["num_arguments"] == 12
    run(["reason", "--input", t("s"), "--dataset", t("e"), "--output", t("d"), "--html", t("h")])
    d = first(t("d"))
    g = d["argument_graph"]
    assert sorted(g["nodes"]) == ["A1", "A2", "A3", "A4", "ROOT"] and g["root_id"] == "ROOT" and g["nodes"]["ROOT"]["metadata"] == {"target_item_name": d["target_name"]}
    assert g["nodes"]["A1"] == {"node_id": "A1", "node_type": "argument", "text": arg["text"], "base_score": arg["combined_score"], "metadata": {k: arg[k] for k in ("arg_type", "evidence", "llm_score", "llm_score_reason", "mf_score", "combined_score")}}
    assert g["edges"][2] == {"source_id": "A3", "target_id": "ROOT", "relation_type": "attack"} and len(d["dfquad"]["support_scores"]) == 2 and 0 <= d["dfquad"]["final_score"] <= 1
    assert d["context"]["history"] and d["context"]["target_item"]["attributes"] == {"outdoor_seating": "True"} and d["scored_arguments"] == s["scored_arguments"]
    pages = [r.value for r in spark.read.text(t("h")).collect()]
    assert len(pages) == 3 and all("<svg" in x and x.partition("\t")[0].isdigit() and "User history" in x for x in pages)
    run(["reason", "--input", t("s"), "--dataset", t("e"), "--index", "1", "--output", t("one.json"), "--html", t("one.html"), "--show-graph", "--show-scores"])
    run(["draw", "--input", t("one.json"), "--output", t("again.html")])
    assert open(t("one.html")).read() == open(t("again.html")).read() and "<svg" in open(t("one.html")).read()
    run(["generate-one", "--input", t("e"), "--index", "2", "--output", t("g1.json")])
    assert json.load(open(t("g1.json")))["index"] == 2
    run(["score-one", "--dataset", t("e"), "--input", t("g.jsonl"), "--index", "2", "--show-raw"])
    assert "Scoring answer:" in capsys.readouterr().out
    run(["inspect", "--file", t("s"), "--only", "valid", "--show-raw", "--show-scores", "--show-llm-prompt"])
    out = capsys.readouterr().out
    assert "Parsed JSON:" in out and "Scoring prompt:" in out and '"mf_source"' in out
    run(["inspect", "--file", t("e"), "--examples"])
    run(["prompt", "--file", t("e"), "--index", "1"])
    for command, message in ((["draw", "--input", t("g1.json"), "--output", t("x.html")], "argument_graph"), (["reason", "--input", t("g.jsonl"), "--index", "0"], "scored"), (["reason", "--input", t("s"), "--index", "99"], "no record")):
        with pytest.raises(ValueError, match=message):
            run(command)


def first(folder):
    """The first record of a folder of JSON lines."""
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name)) as f:
                for line in f:
                    return json.loads(line)


def test_records_of_the_public_example_format(spark, tmp_path):
    """Records as a sequential program writes them: parsed_json an object or null, blank lines between records."""
    from dialectica.sources import readers

    e = [{"user_id": "U1", "history": [{"business_id": "B1", "name": "Sushi", "categories": ["Japanese"], "user_stars": 5, "review_text": "x"}], "target_item": {"business_id": "B9", "name": "Bowl", "categories": ["Ramen"], "attributes": {"Takeout": "True"}, "global_stars": 4.0, "user_target_stars": 5, "target_review_text": "y"}}]
    args = [{"id": "A1", "type": "support", "text": "t", "evidence": ["Sushi"]}, {"id": "A1", "type": "other", "text": "u", "evidence": "Bowl"}, {"id": "A3", "type": "attack", "text": "v"}]
    records = [{"index": 0, "user_id": "U1", "target_name": "Bowl", "raw_output": "", "parsed_json": {"arguments": args}, "validation": {"is_valid": False, "errors": [], "error_counts": {}}}, {"index": 0, "parsed_json": None}, {"index": 7, "parsed_json": {"arguments": []}}]
    (tmp_path / "e.jsonl").write_text("".join(json.dumps(x) + "\n" for x in e))
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) + "\n" for x in records))
    cli.main(["score", "--dataset", str(tmp_path / "e.jsonl"), "--input", str(tmp_path / "r.jsonl"), "--output", str(tmp_path / "s")])
    s = first(tmp_path / "s")
    assert [(a["id"], a["arg_type"], a["evidence"], a["mf_score"], a["combined_score"]) for a in s["scored_arguments"]] == [("A1", "support", ["Sushi"], 0.75, 0.625), ("A1", "other", ["Bowl"], 0.75, 0.625)]
    summary = json.load(open(tmp_path / "s_summary.json"))
    assert (summary["num_records"], summary["num_skipped"]) == (1, 2)
    cli.main(["reason", "--input", str(tmp_path / "s"), "--output", str(tmp_path / "d")])
    d = first(tmp_path / "d")
    assert sorted(d["argument_graph"]["nodes"]) == ["A1", "ROOT"] and d["dfquad"]["final_score"] == 0.5 and d["context"] is None
    assert readers.json_lines(spark, str(tmp_path / "r.jsonl"), readers.RECORD).count() == 3


def test_streams(spark, tmp_path, data):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.read.parquet(f"{data}/generation_results.parquet")
    table.repartition(2).write.parquet(src)
    e = examples.once(spark.read.parquet(f"{data}/sample_input.parquet"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    checked = pipeline.validated(pipeline.once(stream, "index", "generated_at", "3650 days"), e)
    q = checked.select("index", (F.size("errors") == 0).alias("ok")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["index"]: r.ok for r in spark.read.parquet(out).collect()}
    assert got == {r["index"]: r.validation.is_valid for r in table.collect()}
    rates = pipeline.error_rates(pipeline.validated(stream, e), "generated_at", "30 days")
    q = rates.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("records")).first()[0] == table.count()
