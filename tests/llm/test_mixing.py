import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialectica.llm import mixing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokenizer.TOKENIZERS, tokenizer.VOCABULARY)), reason="no vocabulary here")
BLOCK = 50


@pytest.fixture(scope="module")
def mixer(spark):
    docs = [(i, f"word {i} " * (1 + i % 7), ["Big", " big ", "small", None, "other"][i % 5 if i % 5 < 2 or i % 3 == 0 else 0], "x") for i in range(600)] + [(900, None, "big", "x"), (901, "", "small", "x"), (902, "very long " * 400, "small", "x")]
    mix = [("m", "big", 1.0, 2, 0.5), ("m", "Small ", 3.0, 3, 0.5), ("m", "absent", 1.0, 5, 0.5), ("n", "other", 1.0, 1, 0.01), ("n", "big", None, 4, 0.01), ("z", None, 1.0, 1, 1.0), ("y", "big", 1.0, None, 1.0), ("w", "big", 2.0, 5, 1.7), ("w", "other", 1.0, 1, 1.7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens string")
    m = spark.createDataFrame(mix, "mix_id string, source string, weight double, max_repeats bigint, size_factor double")
    return mixing.Mixer(d, m, block_tokens=BLOCK, shards=4)


def test_counts_meet_targets_to_half_a_block(mixer):
    shares = {(r.mix_id, r.source): r for r in mixer.shares().collect()}
    for r in shares.values():
        cap = r.max_repeats * r.available_tokens
        assert abs(r.actual_tokens - min(r.wanted_tokens, cap)) <= BLOCK / 2, r
        assert r.most_uses <= r.max_repeats
    assert shares["m", "absent"].actual_tokens == 0 and shares["y", "big"].actual_tokens == 0
    assert ("z", None) not in shares and abs(shares["m", "big"].target_share - 0.2) < 1e-9


def test_blocks_have_a_fixed_length(mixer):
    size, seen = Counter(), defaultdict(list)
    for r in mixing.pieces(mixer.docs, BLOCK).collect():
        size[r.source, r.block] += r.tokens
        seen[r.doc_id].append((r.first, r.tokens, r.n_tokens))
    last = {s: max(b for t, b in size if t == s) for s, _ in size}
    assert all(n == BLOCK for (s, b), n in size.items() if b != last[s])
    for parts in seen.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:])) and sum(n for _, n, _ in parts) == parts[0][2]
    assert len(seen[902]) > 10


def test_uses_come_from_the_slots(mixer):
    rows = mixer.uses().collect()
    assert max(Counter((r.mix_id, r.doc_id) for r in rows).values()) == 1
    times = Counter((r.mix_id, r.source, r.block) for r in mixer.assigned().collect())
    want = Counter()
    for r in mixing.pieces(mixer.docs, BLOCK).collect():
        for m in "mnwyz":
            want[m, r.doc_id] += r.tokens * times[m, r.source, r.block]
    assert {(r.mix_id, r.doc_id): r.used_tokens for r in rows} == dict(+want)
    assert all(abs(r.uses * r.n_tokens - r.used_tokens) < 1e-6 and 0 < r.uses <= r.most_uses for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixer.uses().collect()))


def test_permutations_use_every_block_once_an_epoch(mixer):
    seen = defaultdict(list)
    for r in mixer.assigned().collect():
        seen[r.mix_id, r.source, r.epoch].append(r.block)
    plan = {(p["mix_id"], p["source"]): p for p in mixer.plan}
    for (m, s, e), b in seen.items():
        n = plan[m, s]["blocks"]
        assert len(b) == len(set(b)) and set(b) <= set(range(n)) and (len(b) == n or (m, s, e + 1) not in seen)
    assert sum(map(len, seen.values())) == sum(p["slots"] for p in mixer.plan)


def test_slots_do_not_depend_on_the_size_of_chunks(mixer):
    whole = sorted(map(tuple, mixer.assigned().collect()))
    assert whole == sorted(map(tuple, mixer.assigned(chunk=3).collect())) and whole == sorted(map(tuple, mixer.assigned(chunk=10**9).collect()))


def test_ranges_of_very_many_slots_stay_bounded(spark):
    n = 10_000_000_000
    steps, shift, turn = mixing.permutation(1, "m", "s", n)
    assert all(s * n < 2**63 for s in steps)
    rows = spark.createDataFrame([("m", "s", 0, 5, n, n, steps, shift, turn)], mixing.SLOTS)
    r = mixing.chunks(rows).agg(F.count("*").alias("n"), F.max("size").alias("most"), F.sum("size").alias("all")).first()
    assert (r.n, r.most, r["all"]) == (100_000, 100_000, n)
    few = mixing.numbered(rows.withColumn("first", F.lit(n - 7)).withColumn("slots", F.lit(20).cast("bigint"))).collect()
    for x in few:
        assert x.block == (steps[x.epoch % mixing.STEPS] * x.j + shift + turn * x.epoch) % n and mixing.place(x.block, x.epoch, n, steps, shift, turn) == x.j
    assert {x.epoch for x in few} == {0, 1}


def test_shards_follow_the_draws(mixer):
    by = Counter((r.mix_id, r.source, r.shard) for r in mixer.assigned().collect())
    assert by == Counter({(r.mix_id, r.source, r.shard): r.slots for r in mixer.shard_counts().collect() if r.slots})


def test_draws_are_multinomial_and_exact():
    out = mixing.draw([1000, 10, 0], 8, 1)
    assert out.sum(axis=0).tolist() == [1000, 10, 0] and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    assert np.array_equal(out, mixing.draw([1000, 10, 0], 8, 1)) and not np.array_equal(out, mixing.draw([1000, 10, 0], 8, 2))


def test_hot_source_is_summed_in_many_tasks(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id doc_id", "'s' source", "1 + id % 9 n_tokens")
    whole = {r.doc_id: r.start for r in mixing.streams(docs).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    rows = sorted(mixing.streams(docs).collect(), key=lambda r: r.start)
    assert len(rows) == len(whole) == 500 and rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_last_slots():
    assert mixing.last_slots(0.0, 5, 10, 4, 0) == 0 and mixing.last_slots(1e9, 5, 10, 4, 0) == 5
    for left in range(46):
        for at in range(5):
            m = mixing.last_slots(left, 5, 10, 4, at)
            assert abs(10 * m - 4 * (at < m) - left) <= 5


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    m = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], "mix_id string, source string, weight double, max_repeats bigint, size_factor double")
    assert mixing.Mixer(d, m).uses().count() == 0 and mixing.Mixer(d, m.limit(0)).shares().count() == 0 and mixing.Mixer(d, m).shares().count() == 1


def test_documents_of_shards_add_up_to_the_uses(mixer):
    rows, got = mixer.shard_documents().collect(), Counter()
    assert {r.shard for r in rows} == set(range(4))
    for r in rows:
        got[r.mix_id, r.doc_id] += r.uses * r.n_tokens
    assert got == Counter({(r.mix_id, r.doc_id): r.used_tokens for r in mixer.uses().collect()})


def test_documents_of_shards_are_a_query():
    from dialectica.llm import queries

    assert "p7_documents" in queries.QUERIES
