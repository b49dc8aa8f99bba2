"""Argument graphs of records (a star of supports and attacks around a root) and their gradual evaluation.

A record's graph is made, evaluated and drawn within the record's row, by higher-order functions over the array of its
scored arguments: no shuffle, whatever the number of records.

Defined results: records without arguments have no graph and are left out; of arguments with equal ids the last one is
the node, at the first one's place, and every argument keeps its own edge; an argument called ROOT takes the root's
place; an argument with another type than support attacks; a null id is a node like any other; without a name the
target is called target_item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectica.functions import score, text

ROOT = "ROOT"
#: The canvas and the columns of supports and attacks.
WIDTH, HEIGHT, MARGIN, SUPPORT_X, ATTACK_X = 1400, 900, 140, 260, 1140
_FIELDS = ("arg_type", "evidence", "llm_score", "llm_score_reason", "mf_score", "combined_score")
NODE = "struct<node_id:string,pos:bigint,node_type:string,text:string,base_score:double,arg_type:string,evidence:array<string>,llm_score:double,llm_score_reason:string,mf_score:double,combined_score:double,target_item_name:string>"


def relation(arg_type: Column) -> Column:
    return F.when(arg_type == "support", "support").otherwise("attack")


def nodes(args: Column, name: Column, root_base_score: float = 0.5) -> Column:
    """The nodes in order, root first. args: pos, id, arg_type, text, evidence and scores of each argument."""
    called = text.let(F.coalesce(F.nullif(name, F.lit("")), F.lit("target_item")), lambda n: n)

    def node(a: Column) -> Column:
        return F.struct(a.id, a.pos, F.lit("argument"), a.text, score.base_score(a.combined_score, a.llm_score, a.mf_score), *(a[k] for k in _FIELDS), F.lit(None).cast("string")).cast(NODE)

    root = F.struct(F.lit(ROOT), F.lit(-1).cast("bigint"), F.lit("root"), F.concat(F.lit("Recommend item: "), called), F.lit(float(root_base_score)), *(F.lit(None) for _ in _FIELDS), called).cast(NODE)

    def last_of_each(every: Column) -> Column:
        ids = F.array_distinct(F.transform(every, lambda x: x.node_id))
        of = lambda i: F.filter(every, lambda x: x.node_id.eqNullSafe(i))
        return F.transform(ids, lambda i: text.let(of(i), lambda same: F.element_at(same, -1).withField("pos", same[0].pos)))

    return text.let(F.concat(F.array(root), F.transform(args, node)), last_of_each)


def edges(args: Column) -> Column:
    """pos, source_id, target_id, relation_type of each argument, in order."""
    return F.transform(args, lambda a: F.struct(a.pos.alias("pos"), a.id.alias("source_id"), F.lit(ROOT).alias("target_id"), relation(a.arg_type).alias("relation_type")))


def with_graph(records: DataFrame, root_base_score: float = 0.5) -> DataFrame:
    """records (target_name and args) with nodes and edges."""
    # Out of a generator, since a filter would be moved down and compute the arguments a second time.
    some = F.explode(F.when(F.size("args") > 0, F.array("args"))).alias("args")
    df = records.select(*(c for c in records.columns if c != "args"), some)
    return df.withColumns({"nodes": nodes(F.col("args"), F.col("target_name"), root_base_score), "edges": edges(F.col("args"))})


def _node(all_nodes: Column, node_id: Column) -> Column:
    return F.filter(all_nodes, lambda n: n.node_id.eqNullSafe(node_id))[0]


def linked(graphs: DataFrame) -> DataFrame:
    """graphs with links, the supporters and attackers: every edge with its source node's score and text, in edge order."""
    link = lambda e: text.let(_node(F.col("nodes"), e.source_id), lambda n: F.struct(e.pos.alias("pos"), e.source_id.alias("source_id"), e.relation_type.alias("relation_type"), n.base_score.alias("base_score"), n.text.alias("text")))
    return graphs.withColumn("links", F.transform("edges", link))


def evaluate(graphs: DataFrame) -> DataFrame:
    """graphs with root_id, root_text, root_base_score, scores of supports and attacks in edge order, their aggregates, final_score."""
    of = lambda r: F.transform(F.filter("links", lambda x: x.relation_type == r), lambda x: x.base_score)
    root = F.col("__root")
    df = linked(graphs).withColumns({"support_scores": of("support"), "attack_scores": of("attack"), "__root": _node(F.col("nodes"), F.lit(ROOT))})
    df = df.withColumns({"root_id": F.lit(ROOT), "root_text": root.text, "root_base_score": root.base_score, "aggregated_support": score.probabilistic_sum(F.col("support_scores")), "aggregated_attack": score.probabilistic_sum(F.col("attack_scores"))})
    return df.withColumn("final_score", score.gradual(F.col("root_base_score"), F.col("aggregated_attack"), F.col("aggregated_support"))).drop("__root", "links")


DFQUAD = ("root_id", "root_text", "root_base_score", "support_scores", "attack_scores", "aggregated_support", "aggregated_attack", "final_score")


def graph_object(all_nodes: Column, all_edges: Column) -> Column:
    """The graph as one VARIANT object: root_id, nodes by id with their metadata, edges."""

    def entry(n: Column) -> Column:
        said = F.when(n.node_type == "root", F.to_json(F.struct(n.target_item_name.alias("target_item_name")))).otherwise(F.to_json(F.struct(*(n[k].alias(k) for k in _FIELDS)), {"ignoreNullFields": "false"}))
        body = F.struct(n.node_id.alias("node_id"), n.node_type.alias("node_type"), n.text.alias("text"), n.base_score.alias("base_score"))
        whole = F.concat(F.regexp_replace(F.to_json(body, {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"metadata":'), said, F.lit("}"))
        return F.concat(text.json_text(F.coalesce(n.node_id, F.lit("null"))), F.lit(":"), whole)

    drawn = F.to_json(F.transform(all_edges, lambda e: F.struct(e.source_id.alias("source_id"), e.target_id.alias("target_id"), e.relation_type.alias("relation_type"))), {"ignoreNullFields": "false"})
    return F.parse_json(F.concat(F.lit(f'{{"root_id":"{ROOT}","nodes":{{'), F.array_join(F.transform(all_nodes, entry), ","), F.lit('},"edges":'), drawn, F.lit("}")))


def from_object(g: Column) -> tuple[Column, Column]:
    """(nodes, edges) of a graph as read from a file: root_id, nodes by id, edges. Keys of an object have no order: the root comes first, then nodes in the order of their edges."""
    at = lambda n: F.when(n.node_id == ROOT, F.lit(-1)).otherwise(F.array_position(F.transform(g.edges, lambda e: e.source_id), n.node_id) - 1).cast("bigint")
    node = lambda n: F.struct(n.node_id, at(n), n.node_type, n.text, n.base_score, *(n.metadata[k] for k in _FIELDS), n.metadata.target_item_name).cast(NODE)
    edge = lambda e, i: F.struct(i.cast("bigint").alias("pos"), e.source_id.alias("source_id"), e.target_id.alias("target_id"), e.relation_type.alias("relation_type"))
    return F.array_sort(F.transform(F.map_values(g.nodes), node), lambda x, y: (x.pos - y.pos).cast("int")), F.transform(g.edges, edge)


def layout(all_nodes: Column, all_edges: Column) -> Column:
    """node_id, x, y of each node: root in the middle, supports left, attacks right, spread evenly.

    Arguments of equal ids take a place each, of which the node has the last one (of both sides, on the right).
    """

    def side(r: str, x: float) -> Column:
        def placed(of: Column) -> Column:
            n = F.size(of)
            y = lambda i: F.when(n == 1, F.lit(HEIGHT / 2)).otherwise(MARGIN + i * ((HEIGHT - 2 * MARGIN) / (n - 1)))
            return F.transform(of, lambda e, i: F.struct(e.source_id.alias("node_id"), F.lit(float(x)).alias("x"), y(i).alias("y")))

        return text.let(F.filter(all_edges, lambda e: (e.target_id == ROOT) & (e.relation_type == r)), placed)

    root = F.array(F.struct(F.lit(ROOT).alias("node_id"), F.lit(WIDTH / 2).alias("x"), F.lit(HEIGHT / 2).alias("y")))
    every = F.concat(root, side("support", SUPPORT_X), side("attack", ATTACK_X))
    return text.let(every, lambda e: F.transform(all_nodes, lambda n: F.element_at(F.filter(e, lambda p: p.node_id.eqNullSafe(n.node_id)), -1)))


def shown(c: Column) -> Column:
    return text.escape_html(F.coalesce(c.cast("string"), F.lit("None")))


def tooltip(n: Column) -> Column:
    """The tooltip of a node: lines joined by <br>; optional lines only where there is something to show."""
    number = lambda c: text.number(c)
    line = lambda label, c: F.concat(F.lit(f"<strong>{label}:</strong> "), shown(c))
    given = lambda label, c: F.when(c.isNotNull(), line(label, c))
    evidence = F.concat(F.lit("<strong>Evidence:</strong><br>"), F.array_join(F.transform(n.evidence, lambda e: F.concat(F.lit("- "), shown(e))), "<br>"))
    head = [line("ID", n.node_id), line("Type", F.when(n.node_type == "root", n.node_type).otherwise(n.arg_type)), line("Base score", number(n.base_score))]
    root = F.concat_ws("<br>", *head, given("Target item", n.target_item_name), line("Text", n.text))
    arg = F.concat_ws(
        "<br>", *head, line("Text", n.text), F.when(F.size(n.evidence) > 0, evidence), given("LLM score", number(n.llm_score)),
        F.when(n.llm_score_reason != "", line("LLM reason", n.llm_score_reason)), given("MF score", number(n.mf_score)), given("Combined score", number(n.combined_score)),
    )
    return F.when(n.node_type == "root", root).otherwise(arg)


def target_context(t: Column) -> Column:
    """A target item with cleaned, relabelled attributes and the normalised rating."""
    return F.struct(t.business_id.alias("business_id"), t["name"].alias("name"), t.categories.alias("categories"), F.map_from_entries(text.attribute_pairs(t.attributes)).alias("attributes"), t.global_stars.alias("global_stars"), t.user_target_stars.alias("user_target_stars"), score.normalize_rating(t.user_target_stars).alias("normalized_user_target_score"))


def history_context(history: Column) -> Column:
    """History items with cleaned, relabelled attributes; null items are left out."""
    return F.transform(text.items_present(history), lambda h: F.struct(h["name"].alias("name"), h.user_stars.alias("user_stars"), h.categories.alias("categories"), F.map_from_entries(text.attribute_pairs(h.attributes)).alias("attributes")))


def context_of(user_id: Column, history: Column, target: Column) -> Column:
    return F.struct(user_id.alias("user_id"), target_context(target).alias("target_item"), history_context(history).alias("history"))


def context(examples: DataFrame) -> DataFrame:
    """idx and context: user_id, target_item (with normalised rating) and history with cleaned, relabelled attributes."""
    return examples.select("idx", context_of(F.col("user_id"), F.col("history"), F.col("target_item")).alias("context"))


def history_panel(history: Column) -> Column:
    """HTML cards of the history items of a context."""
    card = lambda h: F.concat(
        F.lit('<div class="history-card"><div class="history-title">'), text.escape_html(F.coalesce(h["name"], F.lit("Unknown item"))), F.lit("</div><div><strong>User rating:</strong> "), F.coalesce(text.whole(h.user_stars), F.lit("N/A")),
        F.lit("</div><div><strong>Categories:</strong> "), F.coalesce(F.nullif(text.escape_html(F.array_join(h.categories, ", ")), F.lit("")), F.lit("N/A")), F.lit("</div><div><strong>Attributes:</strong> "), text.view_attributes(h.attributes), F.lit("</div></div>"),
    )
    cards = F.array_join(F.transform(history, card), "")
    return F.when(F.coalesce(cards, F.lit("")) == "", F.lit("<div class='history-empty'>No history available.</div>")).otherwise(cards)


def context_panel(c: Column) -> Column:
    """HTML of a context (null: there is none): the target item and the cards of the history."""
    t = c.target_item
    row = lambda label, v: F.concat(F.lit(f"<div><strong>{label}:</strong> "), v, F.lit("</div>"))
    or_na = lambda v: F.coalesce(F.nullif(text.escape_html(v), F.lit("")), F.lit("N/A"))
    box = F.concat(
        F.lit('<div class="target-box"><div class="target-title">'), text.escape_html(F.coalesce(t["name"], F.lit("Unknown target"))), F.lit("</div>"),
        row("User target rating", F.coalesce(text.whole(t.user_target_stars), F.lit("N/A"))), row("User target score [0,1]", F.coalesce(text.number(t.normalized_user_target_score), F.lit("N/A"))),
        row("Global rating", F.coalesce(text.number(t.global_stars), F.lit("N/A"))), row("Categories", or_na(F.array_join(t.categories, ", "))), row("Attributes", text.view_attributes(t.attributes)), F.lit("</div>"),
    )
    none = F.lit("<div class='history-empty'>No source context was saved.</div>")
    inside = F.when(c.isNull(), none).otherwise(F.concat(box, F.lit('<h3>User history</h3><div class="history-list">'), history_panel(c.history), F.lit("</div>")))
    return F.concat(F.lit('<div class="side-panel"><h2>Context</h2>'), inside, F.lit("</div>"))


#: Style and script of the pages.
STYLE = "body{display:grid;grid-template-columns:380px 1fr;font-family:sans-serif}circle{fill:#eef;stroke:#446}line.support{stroke:#2a7}line.attack{stroke:#c44}text{text-anchor:middle;font:14px sans-serif}.history-card,.target-box{border:1px solid #ccc;margin:6px;padding:6px}"
SCRIPT = 'const tips=JSON.parse(document.getElementById("tips").textContent);for(const g of document.querySelectorAll("g[data-id]"))g.onmouseenter=()=>{document.getElementById("tip").innerHTML=tips[g.dataset.id]};'
PAGE_HEAD = f"<!DOCTYPE html><html><head><meta charset='utf-8'><style>{STYLE}</style></head><body>"
PAGE_TAIL = f"</script><script>{SCRIPT}</script></main></body></html>"
PAGE_SVG = f'</p><svg viewBox="0 0 {WIDTH} {HEIGHT}">'
PAGE_TIPS = '</svg><div id="tip"></div><script type="application/json" id="tips">'


def _three(c: Column) -> Column:
    """Three decimals; the small addend keeps ties from falling on either side."""
    return F.format_string("%.3f", c + F.lit(1e-9))


def pages(evaluated: DataFrame) -> DataFrame:
    """index and html: one page for each evaluated graph (with context, or a null one), drawn as SVG; tooltips sit in a data block in which < is escaped."""
    df = evaluated.withColumn("at", layout(F.col("nodes"), F.col("edges")))
    place = lambda i: F.filter("at", lambda p: p.node_id.eqNullSafe(i))[0]
    t = text.number

    def circle(n: Column, i: Column) -> Column:
        p = F.get("at", i)
        # The root shows the final score, an argument its own.
        worth = F.when(n.node_id.eqNullSafe(F.lit(ROOT)), F.col("final_score")).otherwise(F.coalesce(n.combined_score, n.base_score))
        return F.concat(F.lit('<g data-id="'), shown(n.node_id), F.lit('"><circle r="46" cx="'), t(p.x), F.lit('" cy="'), t(p.y), F.lit('"/><text x="'), t(p.x), F.lit('" y="'), t(p.y), F.lit('">'), shown(n.node_id), F.lit(" "), _three(worth), F.lit("</text></g>"))

    def line(e: Column) -> Column:
        return text.let(place(e.source_id), lambda a: text.let(place(e.target_id), lambda b: F.concat(F.lit('<line class="'), e.relation_type, F.lit('" x1="'), t(a.x), F.lit('" y1="'), t(a.y), F.lit('" x2="'), t(b.x), F.lit('" y2="'), t(b.y), F.lit('"/>'))))

    tip = lambda n: F.concat(text.json_text(F.coalesce(n.node_id, F.lit("None"))), F.lit(":"), text.json_text(tooltip(n)))
    tips = F.concat(F.lit("{"), F.regexp_replace(F.array_join(F.transform("nodes", tip), ","), "<", r"\\u003c"), F.lit("}"))
    title = F.concat(F.lit("<main><h1>"), shown(F.col("root_text")), F.lit("</h1><p>Record "), shown(F.col("index")), F.lit(", user "), text.escape_html(F.coalesce("context.user_id", F.lit("N/A"))))
    scores = F.concat(*(x for label, c in (("final score", "final_score"), ("support", "aggregated_support"), ("attack", "aggregated_attack")) for x in (F.lit(f", {label} "), _three(F.col(c)))))
    html = F.concat(
        F.lit(PAGE_HEAD), context_panel(F.col("context")), title, scores, F.lit(PAGE_SVG), F.array_join(F.transform("edges", line), ""), F.array_join(F.transform("nodes", circle), ""), F.lit(PAGE_TIPS), tips, F.lit(PAGE_TAIL),
    )
    return df.select("index", html.alias("html"))
