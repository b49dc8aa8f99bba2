"""Deeply nested records as related flat tables (problem 2).

Every record is a tree. A depth-first traversal gives each node its pre-order and post-order number and its level;
node d lies below node a exactly when pre(d) > pre(a) and post(d) < post(a), and a has post - pre + level nodes below
it, which stand right behind it in pre-order; the node that holds d is the last one before d on the level above. The
nodes of a record stay together in one array, so that links by containment are slices of that array and need no
shuffle; `flat_tables` gives a flat table of each type of node.

Kinds: example, item (a history item or the target), attributes, object, array, leaf, field (a plain field of the
example or an item; only with fields=True).

Defined results: text that isn't a JSON object, or holds none, has no nodes; a null record has none; an example may be
wrapped in outer objects or be JSON inside a JSON string; a history that is one item is place 1, keys of a history
that is an object are places (other keys than whole numbers give no item), null items keep their place and have no
node; an empty object has no leaf, an array without objects is one leaf, an array holding objects counts its elements
from 0; an example may be JSON text within JSON text any number of times; JSON nested deeper than the interpreter's
parser takes is text that can't be read (tests state a depth that it takes); text that spells an object or array, as JSON or as a Python literal, is that object or array; attributes as a
list of name/value entries are an object of these names, the last of equal names counting.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.session import spread

NODE = "array<struct<pre:int,post:int,level:int,kind:string,name:string,path:string,item_pos:bigint,value:string,parent:int>>"
_ARROW = pa.list_(
    pa.struct([("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("path", pa.string()), ("item_pos", pa.int64()), ("value", pa.string()), ("parent", pa.int32())])
)
#: A place beyond this isn't a number of a history item.
MOST_PLACE = 2**62
EXAMPLE_KEYS = ("history", "target_item")
ITEM_KEYS = ("business_id", "name", "categories", "attributes", "user_stars", "review_text")


def spelled(text: str) -> Any:
    """The object or array that a text spells, else the text."""
    s = text.strip("﻿ \t\r\n")
    if not s or s[0] not in '{["':
        return text
    try:
        v = json.loads(s)
    except (ValueError, RecursionError):
        if s[0] == '"':
            return text
        try:
            v = ast.literal_eval(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            return text
    if isinstance(v, str):
        inner = spelled(v) if v != text else v
        return inner if isinstance(inner, (dict, list)) else text
    return v if isinstance(v, (dict, list)) else text


def readable(line: str | None) -> Any:
    """The JSON value of a line, unpacked from JSON strings; None if it holds none."""
    if line is None:
        return None
    s = line.strip("﻿ \t\r\n")
    while True:  # every round takes off a pair of quotes at least
        try:
            v = json.loads(s)
        except (ValueError, RecursionError):
            at = s.find("{")
            if at < 0:
                return None
            try:
                v, _end = json.JSONDecoder().raw_decode(s, at)
            except (ValueError, RecursionError):
                return None
        if not isinstance(v, str):
            return v
        s = v.strip("﻿ \t\r\n")


def example_of(value: Any) -> dict | None:
    """The first object, breadth first, that has a history or a target; without one, the outermost object."""
    outer = next((x for x in ([value] if isinstance(value, dict) else value if isinstance(value, list) else []) if isinstance(x, dict)), None)
    level = [value]
    while level:
        below: list[Any] = []
        for v in level:
            if isinstance(v, str):
                v = spelled(v)
            if isinstance(v, dict):
                if any(k in v for k in EXAMPLE_KEYS):
                    return v
                below += v.values()
            elif isinstance(v, list):
                below += v
        level = [v for v in below if isinstance(v, (dict, list)) or isinstance(v, str) and v.lstrip()[:1] in ("{", '"', "[")]
    return outer


def places(history: Any) -> list[tuple[int, Any]]:
    """(place, item) of every non-null history item."""
    if isinstance(history, str):
        history = spelled(history)
    if isinstance(history, list):
        found = list(enumerate(history, 1))
    elif isinstance(history, dict):
        if any(k in history for k in ITEM_KEYS):
            found = [(1, history)]
        else:
            found = [(int(k), v) for k, v in history.items() if isinstance(k, str) and k.strip().isdecimal() and int(k) < MOST_PLACE]
    else:
        found = []
    return [(p, spelled(v) if isinstance(v, str) else v) for p, v in found if v is not None]


def holds_objects(v: list) -> bool:
    """Whether an array holds an object, at any depth of arrays."""
    stack = [*v]
    while stack:
        x = stack.pop()
        if isinstance(x, str) and x.lstrip()[:1] == "{":
            x = spelled(x)
        if isinstance(x, dict):
            return True
        if isinstance(x, list):
            stack += x
    return False


def entries(v: Any) -> Any:
    """Attributes as an object: text unpacked, a list of name/value entries turned into an object."""
    if isinstance(v, str):
        v = spelled(v)
    if isinstance(v, list) and all(isinstance(x, dict) and "name" in x for x in v):
        return {str(x["name"]): x.get("value") for x in v}
    return v


def _text(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)


class _Tree:
    """Nodes in pre-order; post-order numbers are filled in when a node is left."""

    def __init__(self) -> None:
        self.cols: list[list] = [[] for _ in range(9)]
        self.left = 0
        #: The open node of each level.
        self.open: list[int] = []

    def enter(self, level: int, kind: str, name: str | None, path: str | None, pos: int | None, value: str | None) -> int:
        k = len(self.cols[0])
        del self.open[level:]
        parent = self.open[-1] if self.open else None
        self.open.append(k)
        for c, v in zip(self.cols, (k, -1, level, kind, name, path, pos, value, parent)):
            c.append(v)
        return k

    def leave(self, k: int) -> None:
        self.cols[1][k] = self.left
        self.left += 1

    def attributes(self, v: Any, pos: int) -> None:
        """The subtree of an item's attributes, with an explicit stack: depth is bounded by memory only."""
        stack: list[tuple] = [(v, "", None, 2, False)]
        while stack:
            v, path, name, level, done = stack.pop()
            if done:
                self.leave(v)
                continue
            if isinstance(v, str) and path:
                v = spelled(v)
            kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) and holds_objects(v) else "leaf"
            if not path:
                kind = "attributes"
            k = self.enter(level, kind, name, path, pos, _text(v) if kind == "leaf" else None)
            stack.append((k, None, None, 0, True))
            if isinstance(v, dict):
                dot = path + "." if path else ""
                stack += [(x, dot + str(n), str(n), level + 1, False) for n, x in reversed(v.items())]
            elif kind == "array" or not path and isinstance(v, list) and holds_objects(v):
                stack += [(x, f"{path}[{i}]", str(i), level + 1, False) for i, x in reversed([*enumerate(v)])]


def tree(example: dict | None, fields: bool = False) -> list[list]:
    """The node columns of one example."""
    t = _Tree()
    if example is None:
        return t.cols
    root = t.enter(0, "example", None, None, None, None)

    def plain(of: dict, level: int, pos: int | None) -> None:
        for n, v in of.items():
            if fields and n not in ("history", "target_item", "attributes"):
                t.leave(t.enter(level, "field", str(n), str(n), pos, _text(v)))

    plain(example, 1, None)
    target = example.get("target_item")
    target = spelled(target) if isinstance(target, str) else target
    for pos, item in [*([(0, target)] if target is not None else []), *places(example.get("history"))]:
        k = t.enter(1, "item", None, "", pos, None if isinstance(item, dict) else _text(item))
        if isinstance(item, dict):
            plain(item, 2, pos)
            a = entries(item.get("attributes"))
            if a is not None:
                t.attributes(a, pos)
        t.leave(k)
    t.leave(root)
    return t.cols


def labelled(records: DataFrame, line: str, keys: list[str], fields: bool = False) -> DataFrame:
    """keys and nodes (array in pre-order) of the JSON text in `line`; one row for each row, no shuffle."""
    schema = records.select(*keys).withColumn("nodes", F.expr(f"cast(null as {NODE})")).schema
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                cols: list[list] = [[] for _ in range(9)]
                offsets = [0]
                for text in part.column(n):
                    for c, more in zip(cols, tree(example_of(readable(text.as_py())), fields)):
                        c += more
                    offsets.append(len(cols[0]))
                struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW.value_type)], fields=list(_ARROW.value_type))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], names=[*keys, "nodes"])

    return spread(records.select(*keys, F.col(line).alias("__line"))).mapInArrow(run, schema)


def below(node: str = "a") -> str:
    """SQL: the nodes below `node`, by its interval."""
    return f"slice(nodes, {node}.pre + 2, {node}.post - {node}.pre + {node}.level)"


def contained(nodes: DataFrame, outer: str, inner: tuple[str, ...], keys: list[str]) -> DataFrame:
    """keys, a and d: every node of kind `outer` with every node of the kinds `inner` in its interval."""
    df = nodes.select(*keys, "nodes", F.explode(F.filter("nodes", lambda x: x.kind == outer)).alias("a"))
    return df.select(*keys, "a", F.explode(F.expr(f"filter({below()}, d -> d.kind in ({', '.join(map(repr, inner))}) and d.post < a.post)")).alias("d"))


def flat_tables(nodes: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """examples, items, objects (objects and arrays within attributes, and the attributes themselves) and attributes (leaves), tied by the keys, item_pos and interval labels. nodes: with fields=True.

    item_pre is the item that holds a node, parent the node right above it: of an item the example, of the attributes the item, of all below an object.
    """
    own = "map_from_entries(transform(filter({}, d -> d.kind = 'field' and d.level = a.level + 1), d -> struct(d.name, d.value)))"
    examples = nodes.select(*keys, "nodes", F.explode(F.filter("nodes", lambda x: x.kind == "example")).alias("a"))
    items = nodes.select(*keys, "nodes", F.explode(F.filter("nodes", lambda x: x.kind == "item")).alias("a"))
    leaves, objects = contained(nodes, "item", ("leaf",), keys), contained(nodes, "item", ("attributes", "object", "array"), keys)
    place = ("d.pre", "d.post", "d.parent", "d.path")
    return {
        "examples": examples.select(*keys, "a.pre", "a.post", F.expr(own.format(below())).alias("fields")),
        "items": items.select(*keys, "a.item_pos", "a.pre", "a.post", "a.parent", F.expr(own.format(below())).alias("fields")),
        "objects": objects.select(*keys, "a.item_pos", F.col("a.pre").alias("item_pre"), *place, "d.kind", "d.name"),
        "attributes": leaves.select(*keys, "a.item_pos", F.col("a.pre").alias("item_pre"), *place, "d.value"),
    }


def item_paths(nodes: DataFrame, key: str) -> DataFrame:
    """key, item_pos and attr_path: '' for each item, and the path of each leaf that lies in the item's interval."""
    df = nodes.select(key, "nodes", F.explode(F.filter("nodes", lambda x: x.kind == "item")).alias("a"))
    leaves = f"transform(filter({below()}, d -> d.kind = 'leaf' and d.post < a.post), d -> d.path)"
    return df.select(key, F.col("a.item_pos").alias("item_pos"), F.explode(F.expr(f"concat(array(''), {leaves})")).alias("attr_path")).distinct()


def as_lines(examples: DataFrame, key: str = "idx", whole: bool = False) -> DataFrame:
    """key and line: structured examples as JSON text, nulls kept. whole: with all columns, times as text to the microsecond; else history and target only."""
    columns = [F.col(c).cast("string").alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in examples.dtypes if c != key] if whole else ["history", "target_item"]
    return examples.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
