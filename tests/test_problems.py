import itertools
import json
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from dialectica.operators import cooccurrence, nested
from dialectica.plans import problems


def leaves(v, path):
    """Brute force: the leaf paths of an attribute value."""
    if isinstance(v, str):
        v = nested.spelled(v)
    if isinstance(v, dict):
        return [p for k, x in v.items() for p in leaves(x, f"{path}.{k}" if path else k)]
    if isinstance(v, list) and any(isinstance(x, dict) for x in v):
        return [p for i, x in enumerate(v) for p in leaves(x, f"{path}[{i}]")]
    return [path]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(0, 9) | st.text("ab ", max_size=3), lambda x: st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3) | st.lists(st.dictionaries(st.text("de", min_size=1, max_size=1), x, max_size=2), min_size=1, max_size=3) | st.lists(st.integers(0, 3), max_size=2), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("xyz", min_size=1, max_size=2), VALUES, max_size=4))
def test_labels_are_intervals_and_give_the_leaves(attributes):
    cols = nested.tree({"target_item": {"attributes": attributes}})
    nodes = list(zip(*cols))
    assert sorted(n[1] for n in nodes) == list(range(len(nodes)))
    for a in nodes:
        inside = [d for d in nodes if d[0] > a[0] and d[1] < a[1]]
        assert inside == nodes[a[0] + 1 : a[0] + 1 + a[1] - a[0] + a[2]]
    for d in nodes:
        above = [a for a in nodes if a[0] < d[0] and a[1] > d[1]]
        assert d[8] == (above[-1][0] if above else None)
    item = next(n for n in nodes if n[3] == "item")
    assert sorted(n[5] for n in nodes if n[3] == "leaf" and n[0] > item[0] and n[1] < item[1]) == sorted(p for k, x in attributes.items() for p in leaves(x, k))


def wrapped(value, times):
    """JSON text within JSON text; quotes double each time, so a small value."""
    for _ in range(times):
        value = json.dumps(value)
    return value


def test_shapes_of_lines(spark):
    item = {"business_id": "b", "attributes": {"A": {"x": None, "y": {}}, "M": [{"price": 1}, {}], "L": [], "P": "{'u': True, u'v': [1]}", "J": ' {"k": null} ', "T": "[x"}}
    paths = {"", "A.x", "M[0].price", "L", "P.u", "P.v", "J.k", "T"}
    one = {"history": item, "target_item": None}
    lines = [
        (1, json.dumps(one)), (1, json.dumps(one)), (2, json.dumps(json.dumps(one))), (3, json.dumps({"v": 2, "payload": {"record": one}})), (4, json.dumps({"history": {"3": item, "x": item}})), (5, json.dumps({"history": [None, item]})),
        (6, json.dumps(one)[:-9]), (7, None), (8, ""), (9, "# part done"), (10, "null"), (11, json.dumps({"target_item": {"attributes": [{"name": "A", "value": None}, {"name": "B", "value": {"c": 1}}]}})), (12, json.dumps({"target_item": {"attributes": json.dumps({"Z": 1})}})),
        (13, json.dumps({"target_item": {}})), (16, wrapped(one, 10)), (14, "[" * 100_000), (15, json.dumps({"user_id": "u"})), (None, json.dumps({"target_item": {}})),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in lines], "idx bigint, line string, nodes int")
    got = {}
    for r in nested.item_paths(nested.labelled(df, "line", ["idx"]), "idx").collect():
        assert r.attr_path not in got.setdefault((r.idx, r.item_pos), set())
        got[r.idx, r.item_pos].add(r.attr_path)
    assert got == {(1, 1): paths, (2, 1): paths, (3, 1): paths, (4, 3): paths, (5, 2): paths, (11, 0): {"", "A", "B.c"}, (12, 0): {"", "Z"}, (13, 0): {""}, (None, 0): {""}, (16, 1): paths}


DEEP = 3000


def test_deep_records(spark):
    deep = "null"
    for _ in range(DEEP):
        deep = '{"k": ' + deep + "}"
    df = spark.createDataFrame([(1, '{"target_item": {"attributes": ' + deep + "}}")], "idx bigint, line string")
    assert [len(r.attr_path) for r in nested.item_paths(nested.labelled(df, "line", ["idx"]), "idx").orderBy("attr_path").collect()] == [0, 2 * DEEP - 1]


def test_flat_tables(spark):
    line = json.dumps({"user_id": "u", "history": [{"name": "n", "stars": 2, "attributes": {"a": 1}}], "target_item": {"name": "t"}})
    t = nested.flat_tables(nested.labelled(spark.createDataFrame([(1, line)], "idx bigint, line string"), "line", ["idx"], fields=True), ["idx"])
    assert t["examples"].first().fields == {"user_id": "u"}
    assert {r.item_pos: r.fields for r in t["items"].collect()} == {0: {"name": "t"}, 1: {"name": "n", "stars": "2"}}
    a = t["attributes"].first()
    assert (a.item_pos, a.path, a.value) == (1, "a", "1")
    i = t["items"].filter("item_pos = 1").first()
    assert i.pre < a.pre and i.post > a.post and a.item_pre == i.pre and i.parent == t["examples"].first().pre
    o = t["objects"].first()
    assert (o.kind, o.path, o.item_pre, o.parent, a.parent) == ("attributes", "", i.pre, i.pre, o.pre)


def test_child_to_parent_joins_lose_nothing(spark, data):
    t = {n: problems.QUERIES[f"p2_{n}"](spark, data).collect() for n in ("examples", "items", "objects", "attributes")}
    key = {n: {(r.idx, r.pre): r for r in rows} for n, rows in t.items()}
    assert all(len(key[n]) == len(t[n]) for n in t) and any(r.kind == "array" for r in t["objects"])
    for r in t["items"]:
        assert (r.idx, r.parent) in key["examples"]
    for n in ("objects", "attributes"):
        for r in t[n]:
            item = key["items"][r.idx, r.item_pre]
            above = item if r.parent == item.pre else key["objects"][r.idx, r.parent]
            assert item.item_pos == r.item_pos and item.pre <= above.pre < r.pre and item.post >= above.post > r.post
            if r.parent != item.pre:
                assert r.path.startswith(above.path) and len(r.path) > len(above.path)


def test_p2_over_the_table_equals_brute_force(spark, data):
    want = set()
    for r in spark.read.parquet(f"{data}/sample_input.parquet").collect():
        for pos, it in [(0, r.target_item), *enumerate(r.history or [], 1)]:
            if it is not None:
                want.add((r.idx, pos, ""))
                want |= {(r.idx, pos, p) for k, v in (it.attributes or {}).items() for p in leaves(v, k)}
    got = [tuple(x) for x in problems.p2_found(spark, data).filter("idx < 5000000").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_equal_brute_force(spark):
    records = [(1, ["A  b", "c", "C ", None, ""]), (1, ["d"]), (2, ["a b", "c"]), (3, None), (4, [" "]), (5, ["c"]), (None, ["a b", "d"]), (None, ["a b", "d"]), (6, ["x"] * 50)]
    df = spark.createDataFrame([(k, v, 1) for k, v in records], "idx bigint, items array<string>, basket int")
    sets = [{"a b", "c", "d"}, {"a b", "c"}, {"c"}, {"a b", "d"}, {"x"}]
    single = Counter(x for s in sets for x in s)
    pair = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    rows = cooccurrence.associations(df).collect()
    assert {(r.cat_a, r.cat_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in rows} == {p: (single[p[0]], single[p[1]], m, len(sets)) for p, m in pair.items()}
    r = next(r for r in rows if (r.cat_a, r.cat_b) == ("a b", "d"))
    assert abs(r.lift - 2 * 5 / (3 * 2)) < 1e-12 and r.conviction_ba is None and abs(r.conviction_ab - 3 * 3 / 5 / 1) < 1e-12
    assert {tuple(x) for x in cooccurrence.found(cooccurrence.associations(df), least=2, times=1.5).collect()} == {p for p, m in pair.items() if m >= 2 and 10 * m * len(sets) >= 15 * single[p[0]] * single[p[1]]}
    assert cooccurrence.associations(df.limit(0)).count() == 0


def test_flat_tables_over_the_table_equal_brute_force(spark, data):
    def text(v):
        return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def fields(row):
        return {k: text(v) for k, v in row.items() if k not in ("history", "target_item", "attributes")}

    examples, items, attributes = {}, {}, set()
    table = spark.read.parquet(f"{data}/sample_input.parquet")
    for r in table.withColumn("ingested_at", table.ingested_at.cast("string")).orderBy(table.ingested_at.desc()).collect():
        row = r.asDict(recursive=True)
        idx = row.pop("idx")
        examples[idx] = fields(row)
        for pos, it in [(0, row["target_item"]), *enumerate(row["history"] or [], 1)]:
            if it is not None:
                items[idx, pos] = fields(it)
                attributes |= {(idx, pos, p) for k, v in (it["attributes"] or {}).items() for p in leaves(v, k)}
    assert any(x["user_profile"] for x in examples.values()) and len(examples) < table.count()
    got = {n: problems.QUERIES[f"p2_{n}"](spark, data).collect() for n in ("examples", "items", "attributes")}
    for n, keys in (("examples", ["idx"]), ("items", ["idx", "item_pos"]), ("attributes", ["idx", "item_pos", "pre"])):
        assert len({tuple(r[k] for k in keys) for r in got[n]}) == len(got[n]), n
    assert {r.idx: r.fields for r in got["examples"] if r.idx < 5000000} == examples
    assert {(r.idx, r.item_pos): r.fields for r in got["items"] if r.idx < 5000000} == items
    assert sorted((r.idx, r.item_pos, r.path) for r in got["attributes"] if r.idx < 5000000) == sorted(attributes)
    raw = spark.read.parquet(f"{data}/sample_input_raw.parquet")
    assert {r.idx for r in got["examples"]} - set(examples) == {r.idx for r in raw.collect() if nested.example_of(nested.readable(r.line)) is not None}
