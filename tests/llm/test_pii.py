from collections import Counter

import pytest

from dialectica.llm import pii as P


@pytest.fixture(scope="module")
def field():
    return P.train()


def test_held_out_sentences(field):
    maker, right, gold, said = P._Maker(1234), Counter(), Counter(), Counter()
    for _ in range(600):
        t, spans = maker.sentence()
        a, b = {k for _, _, k in spans}, {k for _, _, k in field.entities(t)}
        right.update(a & b)
        gold.update(a)
        said.update(b)
    for k in range(1, 6):
        assert right[k] >= 0.88 * gold[k] and right[k] >= 0.93 * said[k], (P.KINDS[k], right, gold, said)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to anna.berg [at] mail dot example, please.", {"email"}), ("My number is +1 212 555 0123.", {"phone"}), ("ring five five five, zero one four five", {"phone"}), ("They wanted my SSN 951-06-2141.", {"id_number"}), ("passport X01234567 was shown", {"id_number"}), ("We live at 4461 Hollowwood Road, in the end.", {"address"}), ("Send it to P.O. Box 6330.", {"address"}),
        ("Geliefert wurde an Birkenstr. 12.", {"address"}), ("Thanks again to Leila Drummelsen.", {"person_name"}), ("Ask for Dr. Oyelaren.", {"person_name"}), ("担当は高森 由利子さんでした。", {"person_name"}), ("電話は０７７００ ９００３２６まで。", {"phone"}),
        ("Leila was kind.", set()), ("It sits off Cinderfield Drive.", set()), ("Follow them at @lucky.otter for news.", set()), ("Receipt number 2048817, since 2021-05-14.", set()), ("$45 for table 14, open 11:30-22:00", set()), ("The Hungry Basil Diner beats Bloody Mary night.", set()), ("see www.menu-board.example", set()), ("", set()),
    ],
)
def test_cases(field, text, kinds):
    assert {P.KINDS[k] for _, _, k in field.entities(text)} == kinds


def test_skip_edges_carry_labels(field):
    lat = P.Lattice("Told Leila Quorvand. Then Quorvand left with Leila.")
    assert len(lat.skips(lat.active())) >= 1 and field.skip[P.NAME] > 0


def test_redaction_keeps_the_rest(field):
    t = "  Told Leila Drummelsen,\tcall 555-0134 …  "
    assert P.redact(t, field.entities(t)) == "  Told [PERSON_NAME],\tcall [PHONE] …  "
    assert P.redact(None, []) is None and P.redact("a", []) == "a"


def test_training_is_deterministic():
    a, b = P.train.__wrapped__(300, rounds=5), P.train.__wrapped__(300, rounds=5)
    assert (a.node == b.node).all() and a.index == b.index


def test_tables(spark, field):
    item = "struct<review_text:string,kinds:int>"
    rows = [(1, "s", [("mail a.b@c.example",), None, (None,), ("",)], ("555-0134",)), (1, "s", [("mail a.b@c.example",), None, (None,), ("",)], ("555-0134",)), (2, None, None, None), (3, None, [("x " * 100_000 + "ring 212-555-0134",)], (" ",)), (None, None, [("mail a.b@c.example",)], None)]
    df = spark.createDataFrame([(i, s, None if h is None else [None if x is None else (x[0], 1) for x in h], None if t is None else (t[0], 1)) for i, s, h, t in rows], f"idx bigint, source string, history array<{item}>, target_item struct<target_review_text:string,kinds:int>")
    assert sorted((r.idx or 0, r.item_pos, r.kind) for r in P.found(df).collect()) == [(0, 1, "email"), (1, 0, "phone"), (1, 1, "email"), (3, 1, "phone")]
    assert P.found(df.limit(0)).count() == 0


FAR = "The soup was warm and the room was quiet, so we stayed until late. " * 3


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (f"We met Anna Kowalski at the door. {FAR}In the end Kowalski waved.", ["Anna Kowalski", "Kowalski"]),
        (f"We met Anna Kowalski at the door. {FAR}Kowalski's dog and KOWALSKI were there, Kowalsky too.", ["Anna Kowalski", "Kowalski's", "KOWALSKI", "Kowalsky"]),
        ("Told Leila Quorvand. Then Quorvand left with Leila.", ["Leila Quorvand", "Quorvand"]), (f"Ask for Dr. Oyelaren. {FAR}Oyelaren said sorry.", ["Dr. Oyelaren", "Oyelaren"]),
        (f"{FAR}Kowalski waved.", []), (f"We met Anna Kowalski at the door. {FAR}Kovacs waved.", ["Anna Kowalski"]), (f"We met Anna Baker at the door. {FAR}The baker sits on Baker Street.", ["Anna Baker"]),
    ],
)
def test_family_names_that_come_again(field, text, names):
    assert [text[a:b] for a, b, k in field.entities(text) if k == P.NAME] == names


def test_alike():
    assert P.alike("Kowalski", "KOWALSKI’s") and P.alike("kowalski", "kowalskis") and P.alike("kowalski", "kowalsky")
    assert not P.alike("lee", "leeds") and not P.alike("kowalski", "bowalski") and not P.alike("anders", "sanders")


def test_labels_move_along_skip_edges(field):
    """Without the weight of skip edges, no family name that stands alone is found."""
    maker, none = P._Maker(77), P.Field(field.index, field.node, field.pair, field.skip * 0)
    with_, without, lone = 0, 0, 0
    for _ in range(200):
        full, s = maker.given(), maker.surname().split()[-1].capitalize()
        t = f"{maker.r.choice(OPENINGS).format(full + ' ' + s)} {FAR if maker.r.random() < 0.5 else ''}{maker.r.choice(CLOSINGS).format(s)}"
        at = t.rindex(s)
        found = lambda f, t=t, at=at: any(a <= at < b and k == P.NAME for a, b, k in f.entities(t))
        lone, with_, without = lone + 1, with_ + found(field), without + found(none)
    assert with_ >= 0.9 * lone and without <= 0.1 * lone, (lone, with_, without)


#: Sentences of another make than those for training.
OPENINGS = ["My aunt hired {} as a gardener.", "The violin belonged to {} for years.", "In March {} repaired our roof.", "A photo of {} hangs in the hall.", "Everyone in the choir admires {}."]
CLOSINGS = ["Nobody but {} had a key.", "Soon {} will retire.", "The dog follows {} everywhere.", "At noon we saw {} in the garden.", "I still trust {}."]
OTHERS = ["Nobody but Spain had a key.", "Soon Christmas will come.", "The dog follows Google everywhere.", "At noon we saw Paris in the rain.", "I still trust Toyota."]


def test_other_capitalised_words_stay(field):
    for first in OPENINGS:
        for other in OTHERS:
            t = f"{first.format('Anna Tendorvel')} {FAR}{other}"
            assert [t[a:b] for a, b, k in field.entities(t)] == ["Anna Tendorvel"], t


def test_sentences_of_another_make(field):
    hits = sum(any(k == P.NAME for _, _, k in field.entities(o.format(n))) for o in OPENINGS for n in ("Oskar Lindqvarn", "Dr. Hollowbeck", "Mrs Tarnwick", "J. Pellburn", "Priya Vellanoor"))
    assert hits >= 21
    assert [P.KINDS[k] for t in ("The courier lost 33 Quarry Lane on the map.", "A note with 0044 7700 900123 lay there.", "It came from o.tarn@letters.example, I believe.", "Its cover shows passport X12345678.") for _, _, k in field.entities(t)] == ["address", "phone", "email", "id_number"]


def test_a_given_name_again_is_no_case(field):
    assert redacted(field, "I complained to Anna Tendorvel about the tea. Later Tendorvel shouted at us. Anna brought it.") == ["Anna Tendorvel", "Tendorvel"]


def redacted(field, text):
    return [text[a:b] for a, b, _ in field.entities(text)]


def test_texts_that_fail_the_gate_hold_nothing(field):
    import pyarrow as pa

    maker = P._Maker(99)
    texts = [maker.sentence()[0] for _ in range(1500)] + ["", " ", "Plain words only, no more.", "５５５ ０１３４ ０１３", "five five five, zero one four five", "Straße 5", "私書箱 12"]
    for t, maybe in zip(texts, P.evident(pa.array(texts))):
        assert maybe or not field.entities(t), t
    assert P.evident(pa.array(["The soup was warm and the room was quiet.", None])) == [False, False]
