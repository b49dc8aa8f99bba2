"""Pairs of prompt and answer with known defects, made by rule: the cutoffs of problem 4 are selected on them."""

from __future__ import annotations

import json
import random

_PLACES = ["Copper Kettle", "Lakeside Noodles", "The Old Press", "Juniper Bakery", "Corner Taco Stand", "Villa Verde"]
_KINDS = ["Cafes", "Noodles", "Pubs", "Bakeries", "Tacos", "Italian"]
#: Two reasons for and two against, by language; {0} a place of the history, {1} the target.
_REASONS = {
    "en": ["People who enjoyed {0} will find a similar menu at {1}.", "{1} costs about as much as {0}, which this guest rated well.", "The music at {1} could be too much for somebody who likes quiet rooms.", "Service was the reason for the low mark of {0}, and {1} has the same owner."],
    "es": ["A quien le gustó {0} le convendrá también la carta de {1}.", "{1} cuesta más o menos lo mismo que {0}, que tuvo buena nota.", "La música de {1} puede molestar a una persona que busca calma.", "El servicio de {0} le pareció lento y {1} es del mismo dueño."],
    "fr": ["Une personne qui a aimé {0} trouvera une carte semblable chez {1}.", "Les prix de {1} sont proches de ceux de {0}, bien noté.", "La salle de {1} est peut-être trop bruyante pour cette personne.", "Le service de {0} lui a déplu et {1} est au même patron."],
    "de": ["Wer {0} mochte, findet bei {1} eine ähnliche Karte.", "{1} kostet etwa so viel wie {0}, das gut bewertet wurde.", "In {1} ist es für diesen Gast vielleicht zu laut.", "Der Service im {0} war ihm zu langsam, und {1} hat denselben Wirt."],
}
_TASK = {
    "en": "Read what this guest visited and say in short arguments whether the place below suits them: two for it and two against it. Answer only with one JSON object that has a list called arguments.",
    "es": "Lee lo que visitó esta persona y di con argumentos breves si el local le conviene: dos a favor y dos en contra. Contesta solo con un objeto JSON que tenga una lista llamada arguments.",
    "fr": "Lis ce que cette personne a visité et dis par de courts arguments si le lieu lui convient : deux pour et deux contre. Réponds seulement par un objet JSON avec une liste nommée arguments.",
    "de": "Lies, was dieser Gast besucht hat, und sage mit kurzen Argumenten, ob der Ort zu ihm passt: zwei dafür und zwei dagegen. Antworte nur mit einem JSON-Objekt, das eine Liste namens arguments hat.",
}
_EMPTY = [None, "", "  \n", "null", "N/A", "{}", "[]", '{"arguments": []}', '{"arguments": [], "result": ""}', "```\n```", "...", "\u200b"]
_REFUSALS = {
    "en": ["I'm sorry, but I can't help with that request.", "I would rather not judge this guest.", "As a language model I am not able to do that.", "Unfortunately I have to decline this task.", "I won't write these arguments."],
    "es": ["Lo siento, no puedo ayudar con esto.", "Prefiero no opinar sobre esta persona."],
    "fr": ["Désolé, je ne peux pas répondre à cette demande.", "Je préfère ne pas juger cette personne."],
    "de": ["Es tut mir leid, dabei kann ich leider nicht helfen.", "Ich möchte diesen Gast nicht beurteilen."],
}
_LEADS = ["", "", "", "Here you go:\n", "Sure.\n", "Answer: "]


def _prompt(r: random.Random, lang: str, places: list[str]) -> str:
    lines = [f"{k}. {p} | categories: {', '.join(r.sample(_KINDS, 2))} | rating: {r.randrange(1, 6)}" for k, p in enumerate(places[:-1], 1)]
    return f"{_TASK[lang]}\n\nHISTORY\n" + "\n".join(lines) + f"\n\nPLACE\n{places[-1]} | categories: {r.choice(_KINDS)} | attributes: none | global_rating: 3.5"


def _answer(r: random.Random, lang: str, places: list[str]) -> str:
    said = [t.format(places[0], places[-1]) for t in _REASONS[lang]]
    if r.random() < 0.7:
        rows = [{"id": f"A{k}", "type": "support" if k < 3 else "attack", "text": t, "evidence": [places[0]] if r.random() < 0.8 else places[:2]} for k, t in enumerate(said, 1)]
        text = json.dumps({"arguments": rows}, ensure_ascii=False, indent=r.choice([None, 2]))
        return r.choice(_LEADS) + (f"```json\n{text}\n```" if r.random() < 0.2 else text)
    return "\n".join(f"A{k} ({'support' if k < 3 else 'attack'}): {t} Evidence: {places[0]}." for k, t in enumerate(said, 1))


def _malformed(r: random.Random, text: str) -> str:
    """A complete answer of odd form, which is no defect."""
    return r.choice([text.replace('"', "'"), text.replace('"type"', '"kind"'), text + "\nI hope that helps.", text.replace("support", "pro"), text.replace("}, {", "},, {")])


def _cut(r: random.Random, text: str) -> str:
    start = max(text.find("text"), 20)
    return text[: r.randrange(min(start + 10, len(text) - 12), len(text) - 10)].rstrip(".") + r.choice(["", "", "", "...", " [truncated]"])


def make(number: int, seed: int) -> list[tuple[str, str | None, str]]:
    """(prompt, answer, defect or none): a fifth of the pairs has one of the five defects."""
    r, out = random.Random(seed), []
    for i in range(number):
        lang = r.choice([*_TASK, "en"])
        places = r.sample(_PLACES, 4)
        p, good = _prompt(r, lang, places), _answer(r, lang, places)
        if i % 5:
            out.append((p, _malformed(r, good) if r.random() < 0.15 else good, "none"))
            continue
        kind = r.choice(["empty", "refusal", "copies_prompt", "other_language", "truncated"])
        if kind == "empty":
            a = r.choice(_EMPTY)
        elif kind == "refusal":
            t = r.choice(_REFUSALS[lang])
            a = r.choice([t, t, json.dumps({"arguments": [], "note": t}, ensure_ascii=False), json.dumps({"error": t}, ensure_ascii=False)])
        elif kind == "copies_prompt":
            a = r.choice([p, p.lower(), "Sure, here it is. " + p, "> " + p, p[len(p) // 4 :], p[: len(p) * 3 // 4]])
        elif kind == "other_language":
            a = _answer(r, r.choice([x for x in _TASK if x != lang]), places)
        else:
            a = _cut(r, good)
        out.append((p, a, kind))
    return out
