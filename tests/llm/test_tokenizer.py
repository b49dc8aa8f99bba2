import os
import random

import pytest

from dialectica.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.TOKENIZERS, T.VOCABULARY)), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.read_model())


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(os.path.join(T.TOKENIZERS, T.VOCABULARY))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_a_public_implementation(encoder, reference):
    r = random.Random(1)
    parts = ["a", "the", " ", "\n", "\t", "é", "日本", "👍", "\x1c", "\x85", " ", "1", "٣", "'s", "'", ".", "Ab", "<|endoftext|>", "﻿", "́", "ſ", "🤷‍♀️", "  "]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        assert encoder.encode(s) == reference(s)


def test_long_pre_tokens(encoder, reference):
    r = random.Random(2)
    for s in ("a" * 5000, "".join(r.choice("abcdefghij") for _ in range(20_000)), "ab" * 3000, " " * 4000, "0" * 3000):
        assert encoder.encode(s) == reference(s)
    assert len(encoder.encode("".join(r.choice("abc") for _ in range(300_000)))) > 1000


def test_rank_queue_gives_the_least_rank_first():
    r, q, kept = random.Random(3), T.RankQueue(), {}
    for _ in range(2000):
        k = r.randrange(50_000)
        q.push(k, r.randrange(9))
        kept[k] = 1
        if r.random() < 0.5:
            assert q.first() == min(kept)
            q.clear(q.first())
            del kept[min(kept)]
    while kept:
        assert q.first() == min(kept)
        q.clear(min(kept))
        del kept[min(kept)]
    assert q.first() == -1


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "BATCH_IDS", 3)
    rows = [(1, "hello world, hello world"), (2, ""), (3, None), (4, "  "), (4, "  "), (None, "x")]
    df = spark.createDataFrame([(i, t, 7, "y") for i, t in rows], "doc_id bigint, text string, ids int, __text string")
    out = T.encode_column(df, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in out) == [(0, 1), (1, 5), (2, 0), (3, 0), (4, 2), (4, 2)] or sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 3, 4, 4]
    assert {r.doc_id: r.ids for r in out}[3] == []
    assert sorted(r.n_tokens for r in T.count_column(df, ["doc_id"]).collect()) == sorted(len(r.ids) for r in out)
    assert T.encode_column(df.limit(0), ["doc_id"]).count() == 0
