import math

import numpy as np
import pytest

from dialectica.llm import spam

PROSE = ["The soup was warm and the room was quiet, so we stayed until late.", "I would come back for the fish, but not on a Friday.", "La comida llegó fría y el camarero ni se disculpó.", "Das Essen war lecker und die Portionen waren groß.", "Le service était lent mais la carte est bonne.", "店の雰囲気が落ち着いていて良かったです。", "Grilled cod with rice  $12", "- Roast beef (beans) $9", "We waited 20 minutes before the waiter said hello."]
SPAM = ["cheap pizza · best pizza · pizza near me · pizza delivery · pizza deals · cheap pizza · pizza coupon · best pizza · pizza near me · pizza deals", "http://a.example/x http://b.example/y http://c.example/z http://d.example/q http://e.example/w http://f.example/v http://g.example/u", "#pizza #pizzanearme #best_pizza #deals #cheap #food #order #coupon #vegan #sushi #ramen #gift", "Home > Deals > Login > About > Home > Menu > Next page > Login > Deals > Home > About > Login > Next page", "gift card gift card GIFT CARD g1ft card Gift Card gift card gift card gift card gift card gift card gift card"]


@pytest.fixture(scope="module")
def model():
    texts = [f"{PROSE[j]} {PROSE[(i + j) % len(PROSE)]}\n{PROSE[(3 * i + j) % len(PROSE)]}" for i in range(60) for j in range(len(PROSE))]
    b = spam.Batch(*([*x] for x in [*zip(*(spam.encode(t) for t in texts))][:3]))
    return spam.Model(*np.unique(b.grams[b.prose()[b.block]], return_counts=True))


def test_spam_and_prose(model):
    for t in SPAM:
        assert model.page(t)[3], t
    for t in PROSE:
        assert not model.page(t)[3], t


def test_share_decides(model):
    prose = " ".join(PROSE[:4])
    assert not model.page(prose + "\n\n" + SPAM[0])[3] and model.page(PROSE[0] + "\n\n" + SPAM[0] + "\n" + SPAM[3])[3]


def batch(texts):
    return spam.Batch(*([*x] for x in [*zip(*(spam.encode(t) for t in texts))][:3]))


def test_lists_train_no_model():
    assert not batch(SPAM).prose().any() and batch(PROSE).prose().all()


def test_marks_equal_brute_force():
    texts = [*PROSE, *SPAM, "", "Word. Stop word word word. a b c d e f g h i j k l m n o p", " ".join(PROSE)]
    names = [[spam.CLASSES[i] for i in seq] for t in texts for _, seq in spam.blocks(t)]
    m = batch(texts).marks()

    def run(seq):
        most = now = 0
        for c in seq:
            now = now + 1 if c[:2] in ("~w", "~C", "~@") else 0
            most = max(most, now)
        return most

    assert m["run"].tolist() == [run(s) for s in names]
    assert m["again"].tolist() == [sum(c[0] == "~" and c[-1] in "Rr" for c in s) for s in names]
    assert m["dense"].tolist() == [sum(c in ("url+", "tag+", "html+") for c in s) for s in names]


def test_counting_is_the_same_however_tables_are_cut(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate((PROSE + SPAM) * 5)], "doc_id bigint, text string, gram string")
    a, b = spam.train(spam.encoded(df.repartition(1))), spam.train(spam.encoded(df.repartition(7)))
    assert (a.keys == b.keys).all() and (a.counts == b.counts).all() and len(a.keys)


def test_model_equals_brute_force(model):
    """Bits a token of blocks, from counts by class names."""
    counts = {}
    for k, n in zip(model.keys.tolist(), model.counts.tolist()):
        counts[k // spam.WIDTH**2, k // spam.WIDTH % spam.WIDTH, k % spam.WIDTH] = n
    total = sum(counts.values())
    add = lambda f: {k: sum(n for g, n in counts.items() if f(g) == k) for k in {f(g) for g in counts}}
    h3, c2, h2, c1 = add(lambda g: g[:2]), add(lambda g: g[1:]), add(lambda g: g[1]), add(lambda g: g[2])

    def bits(a, b, x):
        p1 = (c1.get(x, 0) + 0.5) / (total + 0.5 * (len(c1) + 1))
        p2 = (c2.get((b, x), 0) + 4 * p1) / (h2.get(b, 0) + 4)
        return -math.log2((counts.get((a, b, x), 0) + 4 * p2) / (h3.get((a, b), 0) + 4))

    for t in PROSE[:4] + SPAM[:3] + ["", "Unseen; words — ☃ here"]:
        *parts, _ = spam.encode(t)
        b = spam.Batch(*([x] for x in parts))
        want = []
        for _, seq in spam.blocks(t):
            ids = [spam.START, spam.START, *seq, spam.END]
            want.append(sum(bits(*ids[i : i + 3]) for i in range(len(ids) - 2)) / (len(seq) + 1))
        assert np.allclose(model.blocks(b)[0], want)


def test_second_model_is_trained_by_the_first(spark):
    """Lists that the form doesn't tell leave the second model if the first one finds them abnormal."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE * 40 + SPAM)], "doc_id bigint, text string")
    pages = spam.encoded(df)
    first = spam.fit(pages)
    second = spam.fit(pages, first)
    none = spam.fit(pages, spam.Model(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert 0.9 * first.counts.sum() < second.counts.sum() < 1.1 * first.counts.sum() and none.counts.sum() >= 0
    assert {r.doc_id for r in spam.found(df).collect()} == {len(PROSE) * 40 + i for i in range(len(SPAM))}


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (4, SPAM[0]), (4, SPAM[0]), (5, "!!! ???"), (6, "word"), (7, "x " * 200_000), (None, PROSE[0]), (8, "<b " + "a" * 1000 + ">" + PROSE[0])]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id bigint, text string, spam boolean")
    out = {r.doc_id: r for r in spam.score(spam.encoded(df), model).collect()}
    assert out[4].spam and not out[6].spam and not out[1].spam and out[2].perplexity is None and not out[None].spam and not out[5].spam and not out[8].spam
    assert spam.found(df.limit(0)).collect() == []


def test_short_pages(model):
    for t in ("#food #yum #pizza #nyc #deal", "sushi · ramen · sushi · udon · sushi", "寿司｜安い寿司｜寿司 予約｜寿司 配達｜寿司"):
        assert len(t) < 40 and model.page(t)[3], (t, model.page(t))
    for t in ("Loved the soup!", "Great.", "ok", "Open 9-17 | Mon", "店の雰囲気が良かったです。", "#food"):
        assert not model.page(t)[3], t
