import json
import random
from collections import Counter

import pytest

from dialectica.llm import pairs as P

PLACES = ["Silver Otter Grill", "Old Mill Sushi", "Dusty Fig Cantina", "Blue Door Tavern"]
TEXTS = {
    "en": ["The user liked {0} and {1} has the same kitchen.", "Prices at {1} are close to those of {0}.", "The room at {1} may be too loud for this user.", "The user gave {0} a low rating for slow service."],
    "es": ["La buena nota de {0} sugiere que {1} le gustará al usuario.", "El nivel de precios de {1} es parecido al de {0}.", "El ambiente de {1} puede ser demasiado ruidoso para el usuario.", "Al usuario no le gustó {0}, que se parece a {1}."],
    "it": ["I prezzi di {1} sono simili a quelli di {0}.", "L'utente sceglie spesso locali di questo tipo come {0}.", "La sala di {1} è troppo rumorosa per lui.", "La media di {1} resta sotto le sue aspettative."],
}
ASK = {"en": "Write short arguments about the place for this user. Give two reasons in favour and two against, and reply with one JSON object and nothing else.", "es": "Escribe argumentos breves sobre el local para el usuario: dos a favor y dos en contra. Responde en español con un único objeto JSON."}


def prompt(r, lang):
    a = r.sample(PLACES, 3)
    return f"{ASK[lang]}\n\nHISTORY\n1. {a[0]} | categories: Bars, Food | rating: 4\n2. {a[1]} | categories: Sushi | rating: 2 | attributes: noise=loud\n\nPLACE\n{a[2]} | categories: Grill | attributes: none | global_rating: 3.5", a


def answer(r, lang, a, form="json"):
    said = [t.format(a[0], a[2]) for t in TEXTS[lang]]
    if form == "json":
        return json.dumps({"arguments": [{"id": f"A{i}", "type": "support", "text": t, "evidence": [a[0]]} for i, t in enumerate(said)]}, ensure_ascii=False, indent=r.choice([None, 2]))
    return "\n".join(f"A{i} (support): {t} Evidence: {a[0]}." for i, t in enumerate(said))


def broken(r, p, a, lang, kind):
    good = answer(r, lang, a, r.choice(["json", "plain"]))
    if kind == "empty":
        return r.choice([None, " ", "{}", "N/A", '{"arguments": []}', "```json\n```", "​", "-"])
    if kind == "truncated":
        return good[: r.randrange(40, len(good) - 12)] + r.choice(["", "", "…", " [cut]"])
    if kind == "refusal":
        t = r.choice(["I'm sorry, but I cannot help with this.", "As an AI model I am not able to judge places.", "No puedo ayudarte con esta petición, lo siento."])
        return r.choice([t, json.dumps({"error": t}), json.dumps({"arguments": [], "message": t})])
    if kind == "copies_prompt":
        return r.choice([p, "Sure! " + p, "> " + p.replace("\n", "\n> "), p.upper(), p[: len(p) * 2 // 3]])
    return answer(r, "it", a, r.choice(["json", "plain"]))


@pytest.fixture(scope="module")
def cases():
    """Held-out pairs with known defects: the cutoffs are validated on them."""
    r, out = random.Random(5), []
    for i in range(900):
        lang = r.choice(["en", "en", "es"])
        p, a = prompt(r, lang)
        kind = r.choice(P.DEFECTS) if i % 5 == 0 else "none"
        out.append((i, p, answer(r, lang, a, r.choice(["json", "plain"])) if kind == "none" else broken(r, p, a, lang, kind), kind))
    return out


def test_cutoffs_on_known_defects(spark, cases):
    df = spark.createDataFrame([(i, p, a, "x") for i, p, a, _ in cases], "index bigint, prompt string, raw_output string, defect string")
    got = {r["index"]: r.defect for r in P.found(df).collect()}
    hits = Counter()
    for i, _, _, kind in cases:
        hits[kind, got.get(i, "none")] += 1
    for k in P.DEFECTS:
        right, all_, said = hits[k, k], sum(v for (a, _), v in hits.items() if a == k), sum(v for (_, b), v in hits.items() if b == k)
        assert right >= 0.85 * all_ and right >= 0.9 * said, (k, hits)


def test_sound_answers_of_odd_form():
    r = random.Random(1)
    p, a = prompt(r, "en")
    good = answer(r, "en", a)
    model = P.label_model({"-00-0": 900, "+0000": 30, "-00+0": 20, "++000": 20})
    for odd in (good + ' and {"note": "done"}', "```json\n" + good + "\n```", "Of course.\n" + good, good.replace('"', "'").replace("user's", "users"), good[:-2] + ",]}"):
        v = P.votes(p, odd)
        assert "+" not in v["refusal"][:1] + v["empty"] + v["copies_prompt"] + v["other_language"], (odd, v)
        assert model.posterior(v["truncated"]) < 0.5, (odd, v)


def test_label_model():
    m = P.label_model({"---": 900, "+++": 60, "++0": 20, "000": 20, "+--": 5})
    post = {p: m.posterior(p) for p in ("---", "+++", "++0", "000", "+--", "0++")}
    assert post["+++"] > 0.99 and post["++0"] > 0.9 and post["---"] < 0.01 and post["000"] < 0.3 and post["+--"] < 0.5 and post["0++"] > 0.9
    assert P.label_model({}).posterior("0000") == pytest.approx(P.PRIOR)


def test_cutoffs_are_selected_on_known_pairs():
    m = P.LabelModel(0.1, {True: [{"+": 0.9, "-": 0.1}], False: [{"+": 0.05, "-": 0.95}]})
    models = {d: m for d in P.DEFECTS}
    known = [("empty", {d: "+" for d in P.DEFECTS})] * 9 + [("none", {d: "-" for d in P.DEFECTS})] * 90
    cut = P.select_cutoffs(models, known)
    assert m.posterior("-") < cut["empty"] < m.posterior("+")
    kinds = Counter(kind for kind, _ in P.known_votes())
    assert set(kinds) == {*P.DEFECTS, "none"} and kinds["none"] == 1200


def test_json_that_is_given_gives_the_same_votes():
    for p, a, _ in P.made_pairs.make(300, 4):
        value = P.parsed(a or "")
        try:
            given = (a or "")[(a or "").index("{") : (a or "").rindex("}") + 1] if value is not None else None
            json.loads(given or "")
        except ValueError:
            given = None
        assert P.votes(p, a, given) == P.votes(p, a)


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (2, None, "Ciao, tutto bene?"), (3, "", ""), (None, "Write this.", "{" * 3000), (5, "p", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "index bigint, prompt string, raw_output string, posterior double")
    got = {r["index"]: r.defect for r in P.found(df).collect()}
    assert got[1] == "empty" and got[3] == "empty" and got.get(2) not in ("other_language", "copies_prompt")
    assert P.found(df.limit(0)).count() == 0
    assert P.labels(df).filter("`index` = 1 and defect = 'empty'").count() == 2


def test_answers_behind_a_long_preamble():
    from dialectica.llm import pairs

    preamble = "Here is what I make of this guest and of the place that they may visit next. " * 4
    whole = '{"arguments": [{"id": "A1", "type": "support", "text": "They like noodles.", "evidence": ["Pho Bar"]}]}'
    assert len(preamble) > 200 and pairs.open_ended(preamble + whole) is False and pairs.open_ended(preamble + whole[:-30]) is True
    assert pairs.open_ended(preamble + "with {braces} only") is None and pairs.open_ended(preamble) is None
    prompt = "Give two arguments for the guest."
    assert "+" not in pairs.votes(prompt, preamble + whole)["truncated"] and pairs.votes(prompt, preamble + whole[:-40])["truncated"][0] == "+"
