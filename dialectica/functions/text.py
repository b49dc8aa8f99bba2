"""Text expressions: stripping, attribute cleaning, prompt lines, HTML escapes. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space when a text is stripped.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: The attributes shown in prompts, in order, with their labels.
ATTRIBUTE_LABELS = {
    "RestaurantsPriceRange2": "price_range",
    "RestaurantsTakeOut": "takeout",
    "RestaurantsDelivery": "delivery",
    "OutdoorSeating": "outdoor_seating",
    "RestaurantsAttire": "attire",
    "Alcohol": "alcohol",
    "NoiseLevel": "noise",
    "RestaurantsGoodForGroups": "good_for_groups",
    "GoodForKids": "good_for_kids",
    "RestaurantsReservations": "reservations",
}

#: The prompt that asks for arguments; {history} and {target} are its slots.
ARGUMENT_PROMPT = """You are an assistant that generates structured arguments for a recommendation task.

TASK:
Given a user history and a target item, generate arguments FOR and AGAINST recommending the target item to the user.

INSTRUCTIONS:
- Infer user preferences from the history.
- Compare the target item with positively and negatively rated history items.
- Generate exactly 4 arguments: 2 support and 2 attack.
- Each argument must be specific and grounded in the input.
- History items contain name, categories, rating, and sometimes filtered attributes.
- The target item contains categories and filtered attributes.
- Do not invent missing facts or attributes.
- Keep each argument text short.
- Use at most 2 short evidence snippets per argument.
- Return valid JSON only.

OUTPUT FORMAT:
{
  "arguments": [
    {
      "id": "A1",
      "type": "support",
      "text": "...",
      "evidence": ["...", "..."]
    },
    {
      "id": "A2",
      "type": "support",
      "text": "...",
      "evidence": ["...", "..."]
    },
    {
      "id": "A3",
      "type": "attack",
      "text": "...",
      "evidence": ["...", "..."]
    },
    {
      "id": "A4",
      "type": "attack",
      "text": "...",
      "evidence": ["...", "..."]
    }
  ]
}

USER_HISTORY:
{history}

TARGET_ITEM:
{target}"""

#: The prompt that asks for the score of one argument.
SCORING_PROMPT = """You are an evaluator for recommendation arguments.

TASK:
Given:
- a user history
- a target item
- one generated argument

Evaluate how good the argument is.

SCORING CRITERIA:
- Coherence: is the argument logically consistent?
- Grounding: is it supported by the provided input?
- Relevance: is it useful for deciding whether to recommend the target item?

Return only valid JSON in the following format:
{
  "score": 0.0,
  "reason": "short explanation"
}

RULES:
- The score must be a float between 0.0 and 1.0
- 0.0 means very poor argument
- 1.0 means very strong argument
- The reason must be short and explicit
- Do not return any text outside the JSON

USER_HISTORY:
{history}

TARGET_ITEM:
{target}

ARGUMENT:
id: {id}
type: {type}
text: {text}
evidence: {evidence}"""


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it; keeps generated code small."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    """c without outer white space of any kind."""
    return F.btrim(c, F.lit(WHITE))


def clean_attribute(c: Column) -> Column:
    """An attribute text without its quotes and Unicode prefix; null for null and for any spelling of none."""
    v = F.btrim(F.replace(strip(c), F.lit("u'"), F.lit("'")), F.lit("'"))
    return let(v, lambda x: F.when(F.lower(x) == "none", None).otherwise(x))


def split_categories(c: Column) -> Column:
    """A comma-separated text as an array of stripped pieces; empty pieces stay."""
    return F.transform(F.split(c, ","), strip)


def whole(c: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def number(c: Column) -> Column:
    """A double as text: the shortest digits, with an exponent only below 0.0001."""
    d = c.cast("double")
    s = d.cast("string")
    small = F.rtrim(d.cast("decimal(38,30)").cast("string"), F.lit("0"))
    tiny = F.regexp_replace(F.regexp_replace(F.replace(F.lower(s), F.lit(".0e"), F.lit("e")), r"e-(\d)$", "e-0$1"), r"e(\d)", "e+$1")
    return F.when((F.abs(d) < 1e-3) & (F.abs(d) >= 1e-4), small).when((F.abs(d) < 1e-4) & (d != 0), tiny).otherwise(s)


def attribute_pairs(m: Column) -> Column:
    """(label, value) of the shown attributes that have a value, in their fixed order."""
    shown = F.array(*(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label")) for key, label in ATTRIBUTE_LABELS.items()))
    each = F.transform(shown, lambda x: F.struct(x.label.alias("label"), clean_attribute(F.try_element_at(m, x.key)).alias("value")))
    return F.filter(each, lambda x: x.value.isNotNull())


def attribute_text(m: Column) -> Column:
    """label=value pairs joined by '; ', or none."""
    t = F.array_join(F.transform(attribute_pairs(m), lambda x: F.concat(x.label, F.lit("="), x.value)), "; ")
    return let(t, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "none").otherwise(x))



def items_present(history: Column) -> Column:
    """The history without null entries."""
    return F.filter(history, lambda h: h.isNotNull())


def history_text(history: Column) -> Column:
    """One numbered line for each history item."""

    def line(h: Column, i: Column) -> Column:
        return F.concat(
            (i + 1).cast("string"), F.lit(". "), F.coalesce(h["name"], F.lit("Unknown")),
            F.lit(" | categories: "), F.coalesce(F.array_join(h.categories, ", "), F.lit("")),
            F.lit(" | rating: "), F.coalesce(whole(h.user_stars), F.lit("N/A")),
            let(attribute_text(h.attributes), lambda a: F.when(a == "none", "").otherwise(F.concat(F.lit(" | attributes: "), a))),
        )

    return F.coalesce(F.array_join(F.transform(items_present(history), line), "\n"), F.lit(""))


def target_text(t: Column) -> Column:
    """The line of a target item."""
    return F.concat(
        F.coalesce(t["name"], F.lit("Unknown")), F.lit(" | categories: "), F.coalesce(F.array_join(t.categories, ", "), F.lit("")),
        F.lit(" | attributes: "), attribute_text(t.attributes), F.lit(" | global_rating: "), F.coalesce(t.global_stars.cast("string"), F.lit("N/A")),
    )


def fill(template: str, **slots: Column) -> Column:
    """A prompt template with columns in its slots; slots are not searched in what is filled in."""
    parts: list[Column] = []
    rest = template
    while True:
        at = min(((rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest), default=None)
        if at is None:
            return F.concat(*parts, F.lit(rest))
        i, k = at
        parts += [F.lit(rest[:i]), F.coalesce(slots[k], F.lit(""))]
        rest = rest[i + len(k) + 2 :]


def argument_prompt(history: Column, target: Column) -> Column:
    return fill(ARGUMENT_PROMPT, history=history_text(history), target=target_text(target))


def json_text(c: Column) -> Column:
    """A text as a JSON string, letters unescaped."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def json_array(texts: Column) -> Column:
    """An array of texts as a JSON array with ', ' between its elements, letters unescaped."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_text), ", "), F.lit("]"))


def scoring_prompt(history: Column, target: Column, id_: Column, type_: Column, text: Column, evidence: Column, bare: Column | None = None) -> Column:
    """bare: whether evidence is one text that was given without a list."""
    shown = json_array(evidence)
    if bare is not None:
        shown = F.when(bare, F.regexp_extract(shown, r"(?s)^\[(.*)\]$", 1)).otherwise(shown)
    return fill(SCORING_PROMPT, history=history_text(history), target=target_text(target), id=id_, type=type_, text=text, evidence=shown)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def view_attributes(m: Column) -> Column:
    """All attributes of a map as escaped key=value pairs, or N/A."""
    t = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(escape_html(e.key), F.lit("="), F.coalesce(escape_html(e.value), F.lit("None")))), "; ")
    return let(t, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "N/A").otherwise(x))
