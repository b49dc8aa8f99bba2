import os

import numpy as np
import pytest

from dialectica.llm import toxicity as T

SAID = {
    "abuse": ["You are an idiot and a liar.", "What a moron this cook is.", "I hope you die, you bastard.", "The waiter is a worthless asshole.", "Go hang yourself.", "Shut up, you stupid bitch.", "Someone should break your legs.", "Drop dead, scumbag.", "Du Arschloch, halt die Fresse.", "Quel connard, ce patron.", "Eres un gilipollas.", "このバカ野郎", "I will beat you up tonight.", "You pathetic loser, get lost.", "The host is a brainless cretin."],
    "hate": ["All foreigners are vermin.", "Immigrants are parasites, deport them.", "Those women are animals.", "Gypsies are thieves, every last one.", "No refugees, keep them out.", "Jews are a plague.", "Ausländer raus, dieses Ungeziefer.", "Los inmigrantes son ratas.", "外国人は害虫だ", "Muslims should go back where they came from."],
    "sexual": ["I want to see her tits.", "Send nudes, I am horny.", "She gave me a blowjob.", "Porn and sex on cam.", "I would lick every inch of him.", "He was masturbating again.", "Her pussy and my dick.", "Ich will sie ficken.", "Je veux la baiser.", "店員とセックスしたい"],
    "none": ["The soup was fine.", "Damn slow service.", "The room was ugly and cold.", "We saw a rat near the bins.", "Two women ran the bar.", "Immigrants own this place and cook well.", "A guest shouted insults and was asked to leave.", "I felt like an idiot for waiting.", "Chicken breasts and thighs.", "That sauce is killer.", "The chairs are garbage.", "My kids like the animals.", "Bloody mary to die for.", "Cheap, fast, friendly.", "Nothing special, but fine.", "The waiter was useless at maths.", "Never again.", "Great view of the river.", "They should serve more bread.", "The cat is called Pig."],
}
LABELS = [(f"{before} {t}", y) for before in ("We came on a Monday.", "It rained.", "Five of us had lunch.") for y, of in SAID.items() for t in of] + [("x", None), ("y", "odd")]


@pytest.fixture(scope="module")
def chain():
    return T.fit_chain([(t, y) for t, y in LABELS if y])


@pytest.mark.parametrize("text", ["The rice was cold. What a brain-dead 1d10t running the bar.", "you pathetic sc​umbag", "You s.c.u.m.b.a.g, get lost.", "u r a b*tch", "YOU МОRОN", "Deport all foreigners.", "Gli stranieri sono parassiti, fuori tutti.", "このクズ野郎、死ねばいいのに。", "Call for a happy ending, all positions.", "Halt die Fresse, du dumme Schlampe.", "dm me for n u d e s"])
def test_cases(chain, text):
    assert max(chain.score(text)) >= chain.cutoff


@pytest.mark.parametrize("text", ["The rooster logo, a proud cock, hangs over the bar.", "Killer beans, and I could murder a burger.", "Silly me, I felt like an idiot for ordering one.", "A drunk guest shouted insults and the host asked him to leave.", "The breast and thighs were juicy.", "Terrible, overpriced, never again.", "Livraison en retard.", "Naked burrito and dirty fries.", ""])
def test_harmless(chain, text):
    assert max(chain.score(text)) < chain.cutoff


def test_kinds(chain):
    assert np.argmax(chain.score("Slap that moron.")) == 0 and np.argmax(chain.score("Hot porn, all positions.")) == 1 and np.argmax(chain.score("Typical immigrants, rats, the lot of them.")) == 2


def test_later_models_see_earlier_probabilities(chain):
    assert [len(w) for w in chain.later] == [T.WIDTH + 1, T.WIDTH + 2, T.WIDTH + 3] and chain.first.shape == (T.WIDTH + T.BUCKETS,)
    assert all(w[T.WIDTH] > 0.5 for w in chain.later)


def loss(chain, texts):
    """Mean log loss over the categories, and the share of right verdicts among harmful and among other texts."""
    total, right, of = 0.0, {True: 0, False: 0}, {True: 0, False: 0}
    for t, y in texts:
        p = chain.score(t)
        total -= sum(np.log(np.clip(v if y == c else 1 - v, 1e-6, 1)) for v, c in zip(p, T.CATEGORIES))
        of[y != "none"] += 1
        right[y != "none"] += (max(p) >= chain.cutoff) == (y != "none")
    return total / len(texts), right[True] / of[True], right[False] / of[False]


def test_held_out_labels_and_what_the_chain_adds():
    """Folds of the labelled sample: what is found of the texts left out, and that the models are worse without the chain."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.001/review_labels.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    texts = [(r["text"], r["label"].strip().lower()) for r in pq.read_table(path).to_pylist() if r["label"] and r["text"]]
    for k in range(3):
        c = T.fit_chain([x for i, x in enumerate(texts) if i % 3 != k])
        held = texts[k::3]
        with_, without = loss(c, held), loss(c.without_chain(), held)
        assert with_[0] < 0.9 * without[0] and with_[1] >= 0.95 and with_[2] >= 0.95, (k, with_, without)


def test_texts_that_fail_the_gate_score_as_nothing(chain):
    import pyarrow as pa

    texts = [t for t, _ in LABELS] + ["a ratty carpet", "rat", "Harrods", "kys", "= a plague", "害虫だ", "b i t c h", "m0ron", "b**ch", "you ｍｏｒｏｎ", "mo\u200bron", "idiooooot", "МОRОN", "$lut", "Nice.", "Très bien, señor.", ""]
    zero = chain.score("")
    gate = T.maybe(pa.array(texts), chain.markers)
    for t, yes in zip(texts, gate):
        assert yes or chain.score(t) == zero, t
    assert gate[-3:] == [False] * 3 and T.maybe(pa.array([None], pa.string()), ["word"]) == [False]


def test_markers_are_learned_words():
    more = [("That guest is such a zork again.", "abuse"), ("You zork of a cook.", "abuse"), ("A zork runs it.", "abuse")] * 8
    c = T.fit_chain([(t, y) for t, y in LABELS if y] + more)
    assert "zork" in c.markers and max(c.score("Some zork sat there.")) >= c.cutoff > max(c.score("Some cork sat there."))


def test_cutoff():
    assert abs(T.best_cutoff(np.array([0.9, 0.8, 0.2, 0.1]), np.array([True, True, False, False])) - 0.5) < 1e-9
    assert T.best_cutoff(np.array([0.9]), np.array([True])) == T.LEAST_CUTOFF


def test_without_labels_nothing_is_found():
    c = T.fit_chain([("You idiot.", None), ("fine", "none")])
    assert c.score("You idiot.") == (0.0, 0.0, 0.0)


def test_tables(spark):
    rows = [(1, " Web", [("You moron.",), None, (None,)], ("Fine.",)), (1, " Web", [("You moron.",), None, (None,)], ("Fine.",)), (2, "web", None, ("",)), (3, None, [("ok " * 100_000,)], None)]
    e = spark.createDataFrame([(i, s, None if h is None else [None if x is None else (x[0],) for x in h], t, 0.1) for i, s, h, t in rows], "idx bigint, source string, history array<struct<review_text:string>>, target_item struct<target_review_text:string>, score double")
    labels = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(LABELS)], "label_id bigint, text string, label string")
    assert [tuple(r) for r in T.found(e, labels).collect()] == [(1, 1)]
    rates = {r.source: (r.reviews, r.flagged) for r in T.rates(e, labels).collect()}
    assert rates == {"web": (3, 1), None: (1, 0)}
    assert T.found(e.limit(0), labels.limit(0)).count() == 0


def whole(chain, text):
    """Probabilities of a text, sentence by sentence with all classes and known sequences, and no gate."""
    best = np.zeros(3)
    for s, v in [*T.sentences(text), ("", None)]:
        v = T._ZERO if v is None else v
        p = [T._sigmoid(v @ chain.first[: T.WIDTH] + sum(chain.first[T.WIDTH + b] for b in {T._bucket(g) for g in T.grams(s)} & chain.known))]
        for w in chain.later:
            p.append(T._sigmoid(np.append(v, T._logit(np.array(p))) @ w))
        best = np.maximum(best, p[1:])
    return best


def test_no_text_is_left_out(spark, chain):
    """Texts whose words are no class and no marker are scored by what they hold, classes in any spelling are found."""
    more = [("That guest is such a zork again.", "abuse"), ("You zork of a cook.", "abuse"), ("A zork runs it.", "abuse")] * 8
    labels = [(t, y) for t, y in LABELS if y] + more
    c = T.fit_chain(labels)
    zero = max(c.score(""))
    learned = ["Some cork sat there.", "Fine. A fork, at last."]
    disguised = ["kill\u00a0yourself", "What a \u24dc\u24de\u24e1\u24de\u24dd.", "twa7", "i\u00a0d\u00a0i\u00a0o\u00a0t", "Break your été bones.", "\u2170diot"]
    texts = [*learned, *disguised, "Nice."]
    e = spark.createDataFrame([(i, "web", None, (t,), 0.1) for i, t in enumerate(texts)], "idx bigint, source string, history array<struct<review_text:string>>, target_item struct<target_review_text:string>, score double")
    got = {r.idx: (r.p_abuse, r.p_sexual, r.p_hate) for r in T.scores(e, c).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], whole(c, t), rtol=0, atol=1e-12), t
    assert all(max(got[i]) > zero + 0.005 for i in (0, 1)) and all(max(got[i]) >= c.cutoff for i in range(2, len(texts) - 1)) and max(got[len(texts) - 1]) == zero


def test_scores_of_arrays_are_those_of_sentences(chain):
    import random

    import pyarrow as pa

    r = random.Random(1)
    bits = [*"aZ3!*@$|+' .\n(\")\t\x1c\x85…。’é-_мı\u00a0\u200be\u0301", ". ", "! ", "<br>", "<br />", "you ", "idiot", "m0ron", "b**ch", "kill", "\u00a0yourself", "I felt like an idiot", "soup", " was", "害虫", "\u24d8", "zzz", "All foreigners ", "vermin", "don’t eat with "]
    texts = ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(1000)] + [t for t, _ in LABELS] + [None, "You moron. " * 50_000, "word " * 50_000]
    got = chain.score_all(pa.array(texts, pa.string()))
    for t, p in zip(texts, got):
        if t is None or len(t) < 1000:
            assert np.allclose(p, whole(chain, t or ""), rtol=0, atol=1e-12), t
            assert tuple(p) == chain.score(t), t
    assert tuple(got[-2]) == chain.score("You moron.") and tuple(got[-1]) == chain.score("word " * 2)


def test_slices_hold_all_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (0, 11, 3, 3, 3, 3, None, 10, 40, 0)])], names=["t"])
    assert [len(p) for p in T.slices(batch, 0)] == [1, 1, 3, 2, 1, 1, 1] and pa.Table.from_batches(T.slices(batch, 0)).to_pylist() == batch.to_pylist()
    assert list(T.slices(batch.slice(0, 0), 0)) == []


def test_broken_bytes(chain):
    import pyarrow as pa

    broken = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 12, 17], dtype=np.int32)), pa.py_buffer(b"You \xff moron.Nice."))
    got = chain.score_all(broken)
    assert tuple(got[0]) == chain.score("You � moron.") and got[0].max() >= chain.cutoff and tuple(got[1]) == chain.score("")
