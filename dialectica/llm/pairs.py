"""Broken prompt and response pairs (problem 4).

For every defect several noisy labelling functions vote for it (+), against it (-) or abstain (0). A label model
learns, by expectation maximization, how often each function gives each vote to defective and to sound pairs; it needs
only the numbers of each pattern of votes, which are counted over all records on the executors (a few hundred patterns
for any size of data). A record keeps every defect whose posterior exceeds that defect's cutoff; the cutoffs are
selected, for the models as fitted, on pairs with known defects that `made_pairs` makes (fixed number and seed).

Defects: empty, truncated, refusal, copies_prompt, other_language.

Defined results: a null answer is empty; a pair without prompt is never copies_prompt or other_language; records
delivered twice give the same votes and count once in the result.
"""

from __future__ import annotations

import ast
import functools
import json
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.llm import made_pairs
from dialectica.llm.spam import FUNCTION_WORDS
from dialectica.session import materialize, spread

DEFECTS = ("empty", "refusal", "copies_prompt", "other_language", "truncated")
#: Range of the cutoffs.
LEAST_CUTOFF, MOST_CUTOFF = 0.1, 0.9
#: A labelling function takes answers of fewer letters and words as too short to argue; it is one vote of several and cuts nothing.
SHORT_LETTERS, SHORT_WORDS = 400, 60
#: Words that are a shell without content, keys of the answers, ends of sentences, marks of a cut.
SHELL = frozenset("null none n/a na nil nan answer response output result json arguments undefined message text error empty".split())
KEYS = frozenset("arguments id type text evidence support attack a1 a2 a3 a4".split())
ENDS = ".!?。！？؟।"
CUT = regex.compile(r"(?:\[\s*(?:cut|truncated|\.\.\.|…|continued)\s*\]|…|\.\.\.|<\|?(?:eos|end|cut)\|?>)\s*[\"'`}\]]*\s*$", regex.I)
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\p{Z}]+")
#: Ways to decline a task in the first person, by language.
REFUSALS = regex.compile(
    r"\b(?:i|we)(?:\s+am|'m|\s+are|'re|\s+do|\s+would|'d|\s+will|'ll|\s+have)?\s+(?:really\s+)?(?:cannot|can\s?not|can't|could\s?n[o']t|won't|will\s+not|must\s+(?:decline|refuse)|(?:have|need)\s+to\s+(?:decline|refuse|pass)|to\s+(?:decline|refuse|pass)|unable|not\s+(?:able|allowed|permitted|comfortable|going|in\s+a\s+position|willing|qualified)|refuse|decline|rather\s+not|don't\s+(?:feel\s+comfortable|think\s+i\s+should|want)|do\s+not\s+(?:feel\s+comfortable|think\s+i\s+should|want)|leave\s+th\w+(?:\s+\w+)?\s+unanswered|prefer\s+not)"
    r"|\bit\s+(?:is|would\s+be)\s+(?:not\s+possible|impossible|not\s+appropriate|inappropriate|unfair|wrong)\b|\b(?:isn't|is\s+not)\s+something\s+i\b|\bleave\s+this\s+(?:one\s+)?unanswered|\bpass\s+on\s+this\b"
    r"|\bmy\s+(?:guidelines|policy|policies|instructions|principles)\b|\bas\s+an?\s+(?:ai|language|artificial|assistant)\b|\bagainst\s+my\b|\bi\s+cannot\b|\bconsult\s+a\s+human\b"
    r"|\bno\s+(?:puedo|debo|podr[ée]|quiero|estoy\s+en\s+condiciones)\b|\bprefiero\s+no\b|\bno\s+me\s+(?:es\s+posible|siento)|\bcomo\s+(?:modelo|asistente|ia)\b|\bme\s+niego\b|\bno\s+tengo\s+permitido\b"
    r"|\bje\s+(?:ne\s+(?:peux|puis|veux|dois|souhaite|suis)|préf[èe]re\s+(?:ne|m'abstenir)|refuse|dois\s+(?:refuser|décliner)|m'abst)|\bm'est\s+impossible|\ben\s+tant\s+qu[e'’]|\bil\s+ne\s+m'est\s+pas\b"
    r"|\bkann\s+ich\b[^.]{0,40}\bnicht\b|\bich\s+kann\b[^.]{0,40}\bnicht\b|\b(?:darf|möchte|werde|will)\s+ich\b[^.]{0,60}\b(?:nicht|keine?n?)\b|\bich\s+(?:darf|möchte|werde|will)\b[^.]{0,60}\b(?:nicht|keine?n?)\b|\bals\s+(?:sprachmodell|ki|assistent)|\bich\s+lehne\b"
    r"|\bnon\s+(?:posso|voglio|mi\s+è\s+possibile)|\bpreferisco\s+non\b|\bnão\s+(?:posso|quero|devo|consigo)\b|\bprefiro\s+não\b|\bcome\s+(?:modello|assistente|ia)\b|\bnie\s+mogę\b|\bя\s+не\s+(?:могу|буду)\b|できません|お答えでき|无法|不能",
    regex.I,
)
HEDGES = regex.compile(r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|regrettably|afraid|lo\s+siento|lamento|lamentablemente|désolée?|malheureusement|regrette|tut\s+mir\s+leid|leider|entschuldigung|mi\s+dispiace|purtroppo|desculpe|infelizmente|przepraszam|извините|к\s+сожалению)\b|申し訳|抱歉", regex.I)
#: Words by which somebody speaks of themselves.
FIRST = frozenset("i my me je j ich mir yo mi prefiero puedo".split())
_PLAIN = regex.compile(r"\bA\d+\s*\((?:support|attack)\)\s*:\s*(.*?)(?=\s*\bEvidence\s*:|\n\s*A\d+\s*\(|$)", regex.S | regex.I)
_FIELD = regex.compile(r"""["']text["']\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')""", regex.S)
_STRING = regex.compile(r'"((?:[^"\\]|\\.)*)"\s*(:)?', regex.S)
_NAME = regex.compile(r"^(?:\d+\.\s*)?([^|\n]+?)\s*\|", regex.M)
_LANGUAGES: dict[str, list[tuple[str, float]]] = {}
for _l in ("en", "es", "fr", "de", "it", "pt", "pl", "nl"):
    for _w in FUNCTION_WORDS[_l].split():
        _LANGUAGES.setdefault(_w, []).append((_l, 1.0))
for _w, _of in _LANGUAGES.items():
    _LANGUAGES[_w] = [(_l, 1.0 / len(_of)) for _l, _ in _of]


_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9_]+")
_LETTER, _KANA, _HAN, _HANGUL, _CYRILLIC, _ARABIC, _GREEK = (regex.compile(x) for x in (r"\p{L}", r"[\p{Hiragana}\p{Katakana}]", r"\p{Han}", r"\p{Hangul}", r"\p{Cyrillic}", r"\p{Arabic}", r"\p{Greek}"))


def words(text: str) -> list[str]:
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text.lower())


def script(text: str) -> tuple[str, float, float] | None:
    """The language that the script of a text tells; None for Latin and unknown scripts."""
    letters = None if text.isascii() else _LETTER.findall(text)
    if letters:
        n = len(letters)
        latin = sum(c < "ɐ" for c in letters)
        if latin < 0.6 * n:
            kana = len(_KANA.findall(text))
            counts = {"ja": 3 * kana, "zh": 0 if kana else len(_HAN.findall(text)), "ko": len(_HANGUL.findall(text)), "ru": len(_CYRILLIC.findall(text)), "ar": len(_ARABIC.findall(text)), "el": len(_GREEK.findall(text))}
            best = max(counts, key=counts.get)  # type: ignore[arg-type]
            if counts[best] > 0.2 * n:
                return best, 9.0, 9.0
    return None


def tally(of: list[str]) -> dict[str, float]:
    """What function words among `of` tell for each language."""
    score: dict[str, float] = {}
    for w in of:
        for lang, x in _LANGUAGES.get(w, ()):
            score[lang] = score.get(lang, 0.0) + x
    return score


def likeliest(score: dict[str, float]) -> tuple[str, float, float]:
    """(language, score, margin to the next); '' if nothing tells."""
    if not score:
        return "", 0.0, 0.0
    order = sorted(score.items(), key=lambda x: -x[1])
    return order[0][0], order[0][1], order[0][1] - (order[1][1] if len(order) > 1 else 0.0)


def language(text: str) -> tuple[str, float, float]:
    """(language, score, margin to the next) by script or function words; '' if nothing tells."""
    return script(text) or likeliest(tally(words(text)))


@functools.lru_cache(maxsize=4096)
def asked_in(instructions: str) -> tuple[str, float, float]:
    """The language of a prompt's instructions, of which a corpus has few."""
    return language(instructions)


#: A { up to NEAR characters from the start opens the answer; farther on, only one that opens an object of arguments, or at which the text is cut.
NEAR = 200
LATE = regex.compile(r"""\{\s*(?:["']arguments["']\s*:|["']?\w*\s*$)""")


def open_ended(text: str) -> bool | None:
    """Whether brackets or a string are left open; None if the answer isn't of that form."""
    s = _FENCE.sub("", text)
    at = s.find("{") if s[:1] not in "{[" else 0
    if at > NEAR and (m := LATE.search(s)):
        at = m.start()
    elif at > NEAR:
        return None
    if at < 0 or at > 0 and _PLAIN_HEAD.search(s, 0, at):
        return None
    depth = 0
    while m := _STRUCTURE.search(s, at):
        c = m[0]
        at = m.end()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth = max(0, depth - 1)
        elif c == '"' or depth:
            end = (_DOUBLE if c == '"' else _SINGLE).match(s, at)
            if not end:
                return True
            at = end.end()
    return depth > 0


_STRUCTURE, _DOUBLE, _SINGLE = re.compile(r"[\[\]{}\"']"), re.compile(r'(?:[^"\\]|\\.)*+"', re.S), re.compile(r"(?:[^'\\]|\\.)*+'", re.S)
_FENCE, _PLAIN_HEAD, _NO_WORDS, _ROWS = regex.compile(r"^\s*>?\s*(?:```\w*\s*)?"), regex.compile(r"A\d+\s*\((?:support|attack)\)"), regex.compile(r"(?i)\bn/a\b|</?\w+>|```\w*"), regex.compile(r"(?m)^.*\|.*$")
_TAIL, _ITEM_TAIL, _EVIDENCE, _OPEN_ITEM = regex.compile(r"[\s\"'`)}\]]+$"), regex.compile(r"[\s\"')\]]+$"), regex.compile(r"\bEvidence\s*:\s*\S"), regex.compile(r"\n\s*A\d*\s*(?:\([a-z]*)?\s*$")


def parsed(text: str):
    """The object between the first { and the last }, as JSON or as a Python literal; None if there is none."""
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        return json.loads(text[a : b + 1])
    except (ValueError, RecursionError):
        pass
    try:
        return ast.literal_eval(text[a : b + 1])
    except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
        return None


def strings(v) -> list[str]:
    """All text values, in order."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack += reversed([y for k, y in x.items() if k not in ("id", "type")])
        elif isinstance(x, (list, tuple)):
            stack += reversed(x)
    return out


def arguments(text: str, value) -> list[str]:
    """The argument texts of an answer."""
    if isinstance(value, dict) and isinstance(value.get("arguments"), list):
        found = [x["text"] for x in value["arguments"] if isinstance(x, dict) and isinstance(x.get("text"), str)]
        if found:
            return found
    found = [a or b for a, b in _FIELD.findall(text)]
    return found or [x.strip() for x in _PLAIN.findall(text) if x.strip()]


def votes(prompt: str | None, raw: str | None, given: str | None = None) -> dict[str, str]:
    """Each defect's votes, one character for each labelling function. given: the answer's JSON, if that is known to be readable."""
    text = raw or ""
    bare = INVISIBLE.sub(" ", text).strip()
    try:
        value = json.loads(given) if given and bare else None
    except (ValueError, RecursionError):
        value = None
    if value is None:
        value = parsed(text)
    args = arguments(text, value)
    inner = [s for s in strings(value) if s.strip()] if value is not None else []
    said = " ".join(inner) if inner else _STRING.sub(lambda m: " " if m[2] else f" {m[1]} ", bare) if bare[:1] in "{[" else bare
    a, b = text.find("{"), text.rfind("}")
    if inner and b > a >= 0:
        said = f"{text[:a]} {said} {text[b + 1:]}"
    content = [w for w in words(_NO_WORDS.sub(" ", said)) if w not in SHELL]
    letters = sum(len(w) for w in content if not w.isdigit())
    out = {}
    sign = lambda yes, no=True: "+" if yes else "-" if no else "0"

    out["empty"] = sign(not bare) + sign(letters == 0) + sign(value is not None and not inner and letters == 0, bool(inner)) + sign(letters < 3, letters >= 12)

    structured = sum(sum(map(len, words(x))) >= 12 for x in args)
    spoken = set(words(said))
    first, hedges = not FIRST.isdisjoint(spoken), bool(HEDGES.search(said))
    speaks = first or hedges
    refuses = bool(REFUSALS.search(said.replace("’", "'")))
    own = [x for x in args if REFUSALS.search(x.replace("’", "'"))] if refuses else []
    out["refusal"] = (
        sign(refuses and (structured < 2 or 2 * len(own) >= len(args)))
        + sign(hedges, False)
        + sign(first and structured < 2 and letters > 0, structured >= 2 or letters == 0)
        + sign(speaks and 0 < letters < SHORT_LETTERS and len(content) < SHORT_WORDS and structured - len(own) < 1 and not any(c in said for c in "|="), structured >= 2)
    )

    declines = out["refusal"][0] == "+"
    out["copies_prompt"] = out["other_language"] = "0000"
    share = 0.0
    if prompt and prompt.strip():
        pw, aw = ([w for w in words(x) if w not in KEYS] for x in (prompt, said))
        grams = set(zip(pw, pw[1:], pw[2:]))
        hits = [g in grams for g in zip(aw, aw[1:], aw[2:])]
        share = sum(hits) / len(hits) if hits else 0.0
        run = most = 0
        for h in hits:
            run = run + 1 if h else 0
            most = max(most, run)
        low = said.lower()
        marks = sum(low.count(m) for m in ("| categories:", "| rating:", "global_rating", "categories:"))
        start = [w for w in words(said) if w not in ("sure", "prompt", "here", "ok", "okay")][:12]
        head = words(prompt)[:8]
        out["copies_prompt"] = (
            sign(share >= 0.5 and len(hits) >= 6, share < 0.4) + sign(most >= 14, most < 10) + sign(marks >= 1 and len(hits) >= 4) + sign(len(head) >= 5 and sum(w in start for w in head) >= min(6, len(head)) and len(hits) >= 6, False)
        )
        names = sorted({n.strip() for n in _NAME.findall(prompt)}, key=len, reverse=True)
        clean = list(args or [said])
        for n in names:
            clean = [x.replace(n, " ") for x in clean]
        full = " ".join(clean)
        parts = [words(x) for x in clean]
        tallies = [tally(x) for x in parts]
        lang, score, margin = script(full) or likeliest({k: sum(t.get(k, 0.0) for t in tallies) for k in {k: 0 for t in tallies for k in t}})
        asked, sure, _ = asked_in(_ROWS.sub(" ", prompt))
        tokens = [w for x in parts for w in x if not w.isdigit()]
        if asked and sure >= 1.5 and not declines and letters >= 12:
            own_words = sum(any(x == asked for x, _ in _LANGUAGES.get(w, ())) for w in tokens) / max(1, len(tokens))
            by = [script(x) or likeliest(t) for x, t in zip(clean, tallies)]
            other = sum(x[0] not in ("", asked) and x[2] >= 0.5 for x in by)
            same = sum(x[0] == asked for x in by)
            foreign = lang not in ("", asked)
            out["other_language"] = (
                ("+" if foreign and score >= 1.5 and margin >= 0.8 else "-" if lang == asked and margin > 0 else "0")
                + ("+" if own_words < 0.12 and len(tokens) >= 5 and foreign else "-" if own_words > 0.25 else "0")
                + ("+" if 2 * other > len(by) else "-" if same >= other and same else "0")
                + ("+" if foreign and score == 9.0 else "0")
            )

    open_ = open_ended(text)
    if share >= 0.5 and 0 <= NEAR < text.find("{"):
        open_ = None  # braces of the copied prompt
    cut = bool(CUT.search(text))
    tail = _TAIL.sub("", bare)
    json_like = open_ is not None
    ended = bool(tail) and tail[-1] in ENDS and not cut
    shut = bool(args) and len(_EVIDENCE.findall(text)) >= len(args) and not _OPEN_ITEM.search(text)
    unended = sum(not _ITEM_TAIL.sub("", x)[-1:] in ENDS or not x.strip() for x in args)
    out["truncated"] = (
        ("0" if open_ is None or letters == 0 else sign(open_))
        + sign(cut and letters > 0, False)
        + ("0" if json_like or not letters or share >= 0.5 or declines else sign(not ended))
        + ("+" if unended else "0" if not args or open_ or not json_like and not ended else "-")
        + ("0" if json_like or not args or share >= 0.5 or declines or shut and not ended else sign(not shut))
    )
    return out


#: Numbers of labelling functions, where there are not four.
FUNCTIONS = {"truncated": 5}


def vote_table(pairs: DataFrame, key: str = "index") -> DataFrame:
    """key and a column of votes for each defect; no shuffle."""
    schema = pairs.select(key).withColumns({d: F.lit(None).cast("string") for d in DEFECTS}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [votes(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[d] for r in rows], pa.string()) for d in DEFECTS)], names=schema.names)

    return spread(pairs.select(key, "prompt", "raw_output", "parsed_json" if "parsed_json" in pairs.columns else F.lit(None).cast("string").alias("parsed_json"))).mapInArrow(run, schema)


#: Start of every label model: rate of the defect, votes of functions on defective and on sound pairs; STRENGTH pseudo-counts of it hold the model there while data are few.
PRIOR, STRENGTH, ROUNDS = 0.02, 8.0, 50
START = {True: {"+": 0.85, "-": 0.15}, False: {"+": 0.03, "-": 0.97}}


class LabelModel:
    """Rate of a defect and how often each labelling function gives each vote. Votes are independent given the label, and abstaining tells nothing of it."""

    def __init__(self, rate: float, table: dict[bool, list[dict[str, float]]]) -> None:
        self.rate, self.table = rate, table

    def posterior(self, pattern: str) -> float:
        logs = {y: math.log(self.rate if y else 1 - self.rate) + sum(math.log(self.table[y][i][v]) for i, v in enumerate(pattern) if v != "0") for y in (True, False)}
        top = max(logs.values())
        w = {y: math.exp(v - top) for y, v in logs.items()}
        return w[True] / (w[True] + w[False])


def label_model(counts: dict[str, int], functions: int = 4) -> LabelModel:
    """Fit by expectation maximization over the counts of the patterns of votes. Pseudo-counts hold the start: a function votes + for defective pairs and - for sound ones more often than not."""
    patterns = sorted(counts)
    n = len(patterns[0]) if patterns else functions
    model = LabelModel(PRIOR, {y: [dict(START[y]) for _ in range(n)] for y in (True, False)})
    total = sum(counts.values())
    for _ in range(ROUNDS if patterns else 0):
        post = {p: model.posterior(p) for p in patterns}
        rate = (sum(counts[p] * post[p] for p in patterns) + STRENGTH * PRIOR) / (total + STRENGTH)
        table: dict[bool, list[dict[str, float]]] = {True: [], False: []}
        for y in (True, False):
            for i in range(n):
                mass = {v: STRENGTH * START[y][v] for v in "+-"}
                for p in patterns:
                    if p[i] != "0":
                        mass[p[i]] += counts[p] * (post[p] if y else 1 - post[p])
                s = sum(mass.values())
                table[y].append({v: mass[v] / s for v in "+-"})
        model = LabelModel(rate, table)
    return model


@functools.lru_cache(maxsize=2)
def known_votes(number: int = 1500, seed: int = 11) -> list[tuple[str, dict[str, str]]]:
    """The defect (or none) and the votes of each made pair."""
    return [(kind, votes(p, a)) for p, a, kind in made_pairs.make(number, seed)]


def select_cutoffs(models: dict[str, LabelModel], known: list[tuple[str, dict[str, str]]] | None = None) -> dict[str, float]:
    """For each defect the cutoff of the largest F1 on pairs with known defects, within the range of cutoffs: the middle, in log odds, of the best ones.

    Of a pair with a defect, other defects that would be kept too count as wrong only if they come before it in the order of DEFECTS.
    """
    out = {}
    for k, d in enumerate(DEFECTS):
        scored = sorted(((models[d].posterior(v[d]), kind == d) for kind, v in known or known_votes() if kind == "none" or DEFECTS.index(kind) >= k), reverse=True)
        yes, hits, best = sum(y for _, y in scored), 0, []
        for i, (p, y) in enumerate(scored):
            hits += y
            following = scored[i + 1][0] if i + 1 < len(scored) else 0.0
            if following < p:
                best.append((2 * hits / (i + 1 + yes) if yes else 0.0, p, following))
        top = max(best, default=(0.0, 1.0, 0.0))[0]
        odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        high, low = max((odds(p) for f, p, _ in best if f == top), default=0.0), min((odds(q) for f, _, q in best if f == top), default=0.0)
        out[d] = min(MOST_CUTOFF, max(LEAST_CUTOFF, 1 / (1 + math.exp(-(high + low) / 2))))
    return out


class Posteriors:
    """Votes of all records (kept), the label models and the cutoffs."""

    def __init__(self, pairs: DataFrame, key: str = "index") -> None:
        self.key, self.table = key, materialize(vote_table(pairs, key))
        each = F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS))
        # One count of all patterns; there are at most 3 ** 5 for a defect.
        counts: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
        for r in self.table.select(F.inline(each)).groupBy("defect", "votes").agg(F.count("*").alias("n")).collect():
            counts[r.defect][r.votes] = r.n
        self.models = {d: label_model(counts[d], FUNCTIONS.get(d, 4)) for d in DEFECTS}
        self.cutoffs = select_cutoffs(self.models)
        self.known = {d: {p: self.models[d].posterior(p) for p in counts[d]} for d in DEFECTS}

    def frame(self) -> DataFrame:
        """key and the posterior of each defect, for each record. The models are literals of the plan."""
        df = self.table
        for d, post in self.known.items():
            pairs_ = [F.lit(x) for kv in post.items() for x in kv]
            df = df.withColumn(d, F.try_element_at(F.create_map(*pairs_), F.col(d)) if pairs_ else F.lit(None).cast("double"))
        return df

    def labels(self) -> DataFrame:
        """key, defect, posterior, rank: every defect whose posterior exceeds its cutoff (a record may have several)."""
        each = F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(self.cutoffs[d]).alias("cut"), F.lit(k).alias("rank")) for k, d in enumerate(DEFECTS)))
        return self.frame().select(self.key, F.inline(F.filter(each, lambda x: x.posterior > x.cut))).drop("cut")


def labels(pairs: DataFrame, key: str = "index") -> DataFrame:
    """key, defect, posterior, rank: every defect whose posterior exceeds its cutoff, for each delivery."""
    return Posteriors(pairs, key).labels()


def found(pairs: DataFrame, key: str = "index") -> DataFrame:
    """key and the one defect of each defective record: of several, the one that explains the others (order of DEFECTS)."""
    return labels(pairs, key).groupBy(key).agg(F.min_by("defect", "rank").alias("defect"))
