"""Mixing sources to target weights (problem 7).

The tokens of each source form one stream: its documents in the order of a hash of their ids. The stream is cut into
blocks of exactly `block_tokens` tokens (only a source's last block may be shorter), so a document lies in one block or
in several, and a block holds pieces of documents, each with its offset.

For every mix and source the wanted tokens are share x size_factor x tokens of all documents, at most max_repeats x
tokens of the source; the number of slots is the number of blocks that comes nearest to that. For every output shard
the slots of each source are a multinomial draw, by what the sources still have to give, so that the draws of all
shards add up to the slots. Slot number `at` of a source belongs to epoch at div blocks and to place at mod blocks; a
pseudorandom permutation of the block indexes, its own for each mix, source and epoch, maps places to blocks, and blocks
are joined by index. An epoch uses every block once, so no token is used more than max_repeats times, and the tokens of
a source differ from what is wanted (as far as caps allow) by at most half a block, or all of a source below one block.

A document's `uses` is the mean number of uses of its tokens: used_tokens / n_tokens. It is a whole number unless block
ends fall into the document, and never above max_repeats.

Where a cap leaves a source short, the other sources keep their own wanted tokens: what is missing isn't given to
them, since that would move their counts away from their targets.

Defined results: null sources are in no mix, though their tokens count in the total; sources compare trimmed and in
lower case; a source named twice in a mix has the sum of its weights and its largest max_repeats; null or negative
weights and caps count as 0; documents without tokens are never chosen; an empty table gives no rows; rows of one
doc_id are documents of their own.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialectica.llm import tokenizer
from dialectica.session import materialize

BLOCK_TOKENS, SHARDS, SEED = 1024, 16, 42
#: Rows that share one window task when running sums are made.
ROWS_PER_BUCKET = 50_000
#: Slots that are numbered from one row at least; of more than CHUNK ** 2 slots it is their square root.
CHUNK = 1 << 14
#: Largest number of rows of the table of targets, which the driver reads whole.
MOST_TARGETS = 100_000
#: Steps that the permutations of a source's epochs take in turn.
STEPS = 16
SLOTS = "mix_id string, source string, shard bigint, first bigint, slots bigint, blocks bigint, steps array<bigint>, shift bigint, turn bigint"


def source_key(c: str = "source"):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def counted(documents: DataFrame, path: str = tokenizer.TOKENIZERS) -> DataFrame:
    """doc_id, source (as compared) and n_tokens of each document, computed once."""
    df = documents.select("doc_id", source_key().alias("source"), "text")
    return materialize(tokenizer.count_column(df, ["doc_id", "source"], path=path))


def streams(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and start (the document's first token in its source's stream).

    Running sums are made in hash buckets of bounded size, never in one task for a source; a table of the buckets'
    sums gives every bucket its first token.
    """
    docs = docs.filter("n_tokens > 0 and source is not null").withColumn("h", F.xxhash64("doc_id"))
    n = max(1, math.ceil(docs.count() / ROWS_PER_BUCKET))
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(n)))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    sums = sums.select("source", "bucket", before(Window.partitionBy("source").orderBy("bucket"), "s").alias("base"))
    local = before(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens"), "n_tokens")
    df = docs.withColumn("local", local).join(sums, ["source", "bucket"])
    return df.select("doc_id", "source", F.col("n_tokens").cast("bigint"), (F.col("base") + F.col("local")).cast("bigint").alias("start"))


def pieces(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs with block, first (the piece's first token in the document) and tokens: one row for each block a document lies in."""
    b = F.lit(block_tokens).cast("bigint")
    last = F.col("start") + F.col("n_tokens") - 1
    df = docs.withColumn("block", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + n_tokens - 1) div {block_tokens})")))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(last, (F.col("block") + 1) * b - 1)
    return df.select("doc_id", "source", "n_tokens", "start", "block", (low - F.col("start")).alias("first"), (high - low + 1).alias("tokens"))


def permutation(seed: int, mix: str, source: str, n: int) -> tuple[list[int], int, int]:
    """(steps, shift, turn) of the affine permutations of 0 .. n-1: epoch e maps j to (step * j + shift + turn * e) mod n, with step e mod STEPS of the steps.

    Steps have no common divisor with n and keep step * n below 2 ** 62.
    """
    rng = random.Random(f"{seed}|{mix}|{source}")
    most = max(2, min(n, 2**62 // n))
    steps: list[int] = []
    while len(steps) < STEPS:
        step = rng.randrange(1, most)
        if math.gcd(step, n) == 1:
            steps.append(step)
    return steps, rng.randrange(n), rng.randrange(min(n, 2**31))


def place(block: int, epoch: int, n: int, steps: list[int], shift: int, turn: int) -> int:
    """The place that an epoch's permutation maps to the block."""
    return (block - shift - turn * (epoch % 2**31)) * pow(steps[epoch % STEPS], -1, n) % n


def last_slots(left: float, n: int, block_tokens: int, gap: int, at: int) -> int:
    """How many slots of the last epoch come nearest to `left` tokens; the block in place `at` lacks `gap` tokens."""
    tokens = lambda m: m * block_tokens - (gap if at < m else 0)
    near = min(n, int(left // block_tokens))
    return min((m for m in range(max(0, near - 1), min(n, near + 2) + 1)), key=lambda m: (abs(tokens(m) - left), m))


def targets(mix: DataFrame, stats: dict[str, int], total: int, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> list[dict]:
    """What each mix wants of each source, and its number of slots. stats: tokens of each source; total: tokens of all documents."""
    rows = (
        mix.select("mix_id", source_key().alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("r"), F.coalesce("size_factor", F.lit(0.0)).alias("f"))
        .filter("mix_id is not null and source is not null")
        .groupBy("mix_id", "source")
        .agg(F.sum("w").alias("w"), F.max("r").alias("r"), F.max("f").alias("f"))
        .orderBy("mix_id", "source")
        .limit(MOST_TARGETS + 1)
        .collect()
    )
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out = []
    weight: dict[str, float] = {}
    for x in rows:
        weight[x.mix_id] = weight.get(x.mix_id, 0.0) + x.w
    for x in rows:
        share = x.w / weight[x.mix_id] if weight[x.mix_id] else 0.0
        tokens = stats.get(x.source, 0)
        wanted = share * max(x.f, 0.0) * total
        p = {"mix_id": x.mix_id, "source": x.source, "share": share, "max_repeats": int(x.r), "wanted": wanted, "tokens": tokens, "blocks": 0, "slots": 0}
        if tokens:
            n = p["blocks"] = -(-tokens // block_tokens)
            p["steps"], p["shift"], p["turn"] = permutation(seed, x.mix_id, x.source, n)
            given = min(wanted, float(x.r) * tokens)
            full = min(int(given // tokens), int(x.r))
            p["slots"] = full * n
            if full < x.r:
                at = place(n - 1, full, n, p["steps"], p["shift"], p["turn"])
                p["slots"] += last_slots(given - full * tokens, n, block_tokens, n * block_tokens - tokens, at)
        out.append(p)
    return out


def draw(quota: list[int], shards: int, seed: int | list[int]) -> np.ndarray:
    """Slots of every source (columns) in every shard (rows): multinomial draws that add up to the quota."""
    rng = np.random.default_rng(seed)
    left = np.array(quota, dtype=np.int64)
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k)
        if k == shards - 1:
            got = left.copy()
        else:
            got = np.zeros_like(left)
            while want > 0 and (left - got).sum() > 0:
                room = left - got
                more = np.minimum(rng.multinomial(want, room / room.sum()), room)
                got += more
                want -= int(more.sum())
        out[k] = got
        left -= got
    return out


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows (as SLOTS) cut into ranges of slots: low and size. Neither the ranges of a row nor the slots of a range are more than the square root of its slots, or chunk."""
    df = rows.filter("slots > 0").withColumn("size", F.greatest(F.lit(chunk).cast("bigint"), F.ceil(F.sqrt("slots"))))
    df = df.withColumn("part", F.explode(F.expr("sequence(0L, (slots - 1) div size)")))
    return df.withColumn("low", F.col("part") * F.col("size")).withColumn("size", F.least("size", F.col("slots") - F.col("low"))).drop("part")


def numbered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """mix_id, source, shard, at, epoch, j, block: one row for each slot of rows (as SLOTS), mapped to its block."""
    parts = chunks(rows, chunk)
    few = 2 * rows.sparkSession.sparkContext.defaultParallelism
    n = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    df = parts.repartition(max(1, min(-(-n // chunk), max(few, n // (64 * chunk)))), "mix_id", "source", "shard", "low")
    df = df.withColumn("at", F.explode(F.expr("sequence(first + low, first + low + size - 1)")))
    df = df.withColumn("epoch", F.expr("at div blocks")).withColumn("j", F.expr("at % blocks"))
    block = F.expr(f"(steps[cast(epoch % {STEPS} as int)] * j % blocks + shift + turn * (epoch % {2**31}) % blocks) % blocks")
    return df.select("mix_id", "source", "shard", "at", "epoch", "j", block.alias("block"))


class Mixer:
    """The choice for all mixes: plan and draws (driver), slots, uses of documents, shares."""

    def __init__(self, documents: DataFrame, mix: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED, path: str = tokenizer.TOKENIZERS) -> None:
        self.spark, self.block_tokens = documents.sparkSession, block_tokens
        all_docs = counted(documents, path)
        self.total = int(all_docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        self.docs = materialize(streams(all_docs))
        #: Only sources that mix_targets names are wanted here; their number is bounded with that table.
        named = mix.select(source_key().alias("source")).distinct()
        per = self.docs.join(named, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"))
        self.plan = targets(mix, {x.source: int(x.t) for x in per.collect()}, self.total, block_tokens, seed)
        self.draws = []
        for m in sorted({p["mix_id"] for p in self.plan}):
            of = [p for p in self.plan if p["mix_id"] == m and p["slots"]]
            first = [0] * len(of)
            for k, got in enumerate(draw([p["slots"] for p in of], shards, [seed, zlib.crc32(m.encode())])):
                for i, (p, n) in enumerate(zip(of, got)):
                    self.draws.append((m, p["source"], k, first[i], int(n), p["blocks"], p["steps"], p["shift"], p["turn"]))
                    first[i] += int(n)

    def shard_counts(self) -> DataFrame:
        """mix_id, shard, source, slots: the multinomial draws, which add up to all slots of the source."""
        return self.spark.createDataFrame(self.draws, SLOTS).select("mix_id", "shard", "source", "slots")

    def assigned(self, chunk: int = CHUNK) -> DataFrame:
        """mix_id, source, shard, at, epoch, j, block: the slots that the draws give to each shard."""
        return numbered(self.spark.createDataFrame(self.draws, SLOTS), chunk)

    def uses(self) -> DataFrame:
        """mix_id, doc_id, source, n_tokens, uses (mean uses of its tokens), used_tokens, most_uses (of one of its tokens): the chosen documents."""
        by = self.assigned().groupBy("source", "block", "mix_id").agg(F.count("*").alias("times"))
        df = pieces(self.docs, self.block_tokens).join(by, ["source", "block"])
        df = df.groupBy("mix_id", "doc_id", "source", "n_tokens", "start").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("most_uses"))
        return df.select("mix_id", "doc_id", "source", "n_tokens", (F.col("used_tokens") / F.col("n_tokens")).alias("uses"), "used_tokens", "most_uses")

    def shares(self) -> DataFrame:
        """For each mix and source the target share, wanted, available and chosen tokens, the actual share of the mix and of its wanted size."""
        got = self.uses().groupBy("mix_id", "source").agg(F.sum("used_tokens").alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("most_uses").alias("most_uses"))
        plan = self.spark.createDataFrame(
            [(p["mix_id"], p["source"], p["share"], p["max_repeats"], p["wanted"], p["tokens"]) for p in self.plan],
            "mix_id string, source string, target_share double, max_repeats bigint, wanted_tokens double, available_tokens bigint",
        )
        df = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "n_docs", "most_uses"])
        w = Window.partitionBy("mix_id")
        return df.withColumn("actual_share", F.try_divide("actual_tokens", F.sum("actual_tokens").over(w))).withColumn("share_of_wanted", F.try_divide("actual_tokens", F.sum("wanted_tokens").over(w)))

    def shard_documents(self) -> DataFrame:
        """mix_id, shard, doc_id, source, first, n_tokens, uses: the pieces of documents in every output shard, with the piece's first token in the document and its number of tokens."""
        by = self.assigned().groupBy("source", "block", "mix_id", "shard").agg(F.count("*").alias("uses"))
        return pieces(self.docs, self.block_tokens).join(by, ["source", "block"]).select("mix_id", "shard", "doc_id", "source", "first", F.col("tokens").alias("n_tokens"), "uses")
