"""Keyword-stuffed and link-list pages (problem 8).

A page is cut into blocks (lines and sentences; short ones are joined), and each block becomes a sequence of function
words and word classes. A trigram model of such sequences is trained on the prose of the whole corpus: first on blocks
that aren't lists by their form, then anew on all blocks, whatever their form, that the first model finds normal. A
block is abnormal if its perplexity under the second model lies far above what the model itself gives for prose, or far
below; a page is flagged if more than half of its characters lie in abnormal blocks.

Word classes: function words and frequent punctuation stand for themselves; other words are classed by their shape, by
whether they, or the two-word phrase that they end, came shortly before in the page, and links, link hosts, mark-up, tags, prices and
numbers have classes of their own; Han and kana are classed character by character. All classes are numbered (CLASSES).

Texts are read and cut once; the numbers of the classes, 2 bytes each, are kept for the two counts and the scoring. The
n-gram counts cover all documents. Their number is bounded by the fixed set of classes, not by the corpus, so the counts
are summed on the executors and the sums are read by the driver.

Defined results: null, empty and blank texts are never flagged and have no perplexity; a page without words or
characters of a word is not flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.session import materialize, spread

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or but if so of to in on at for from with without by as is are was were be been am do does did have has had not no nor we us our you your he she it its they them their i me my this that these those there here what which who when where how than then just only very too also even after before while because about over under again once some any all one two three four five six up down out off into much more most nothing something please tell",
    "es": "el la los las un una unos unas y o pero si de del al en con sin por para como es son era fue ha han hay no ni se su sus lo le les me mi nos muy más ya que qué quien cuando donde este esta eso también bien",
    "fr": "le la les un une des du de et ou mais si dans en à au aux avec sans pour par sur est sont était a ont il elle on nous vous ils ne pas plus très trop ce cette ces son sa ses mon ma qui que quoi où y se",
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn in im am an auf aus bei mit ohne für von vom zu zum zur ist sind war hat haben hatte nicht kein keine wir uns ich mich man es sie er sich auch sehr nur noch schon hier wie als",
    "it": "il lo la i gli le un uno una e o ma se di del della dei delle da in nel con senza per su è sono era ha hanno non più molto che chi mi ci si al alla ai davvero",
    "pt": "o a os as um uma e ou mas se de do da dos das em no na nos nas com sem por para é são era foi não mais muito que quem me ao à pela pelo",
    "pl": "i oraz ale lub w we z ze na do od za po przed przy dla o u jest są był była było nie się to ta ten te jak już tu nas bez",
    "ru": "и в во не на с со что как а но по к у за из от до для это мы я он она они был была было были есть ли же бы так уже здесь там очень",
    "ar": "في من إلى على عن مع هذا هذه كان كانت لا ما لم و أو ثم قد كل جدا لكن",
    "ko": "그리고 하지만 아주 너무 정말 매우 또 더 잘 안 못 다시",
    "nl": "de het een en of maar in op aan met zonder voor van te is zijn was niet geen we ik je er ook",
    "zh": "的 了 是 在 我 不 有 也 和 就 都 很 到 这 那 还 去 来 一 个 吧 吗 着 过 给 对 没",
    "ja": "は が を に で の と も へ や か ら り て た ま す し い な",
}
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: Characters that stand in for letters in disguised words.
_PLAIN = str.maketrans("@4301$5", "aaeoiss")
TOKEN = regex.compile(
    r"(?P<url>(?:https?://|www\.)\S+|[\w-]+(?:\.|\s?\(\.\)\s?|\s?\[\.\]\s?|\sdot\s)(?:example|test|invalid|localhost|com|net|org|info|shop|biz)\b(?:/\S*)?)"
    r"|(?P<html></?[a-zA-Z][^<>\n]*>)|(?P<tag>[#＃]\w+)|(?P<num>[$€£¥]?\d[\d.,:%]*)"
    r"|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}ー])|(?P<word>[\p{L}@][\p{L}\p{M}\p{N}'’@$]*)|(?P<nl>\n)|(?P<p>[^\s\w])"
)
_CUT = regex.compile(r"\n+|<br ?/?>|(?<=[.!?…])\s+|(?<=[。！？])")
#: Blocks of fewer tokens are joined with their neighbours; a page's history of words reaches back so far.
SHORT, WORD_BACK, PHRASE_BACK, LINK_BACK = 6, 14, 120, 24
#: A block is abnormal beyond mean + HIGH + SPREAD x deviation / sqrt(tokens) bits a token, or, with LONG tokens at least, below mean - LOW: a few tokens of one frequent class are no list yet.
HIGH, SPREAD, LOW, LONG = 1.2, 0.95, 1.75, 18
#: As HIGH, for blocks that train the second model: what is nearly abnormal stays out of it.
TRAIN = 0.8
#: A page is flagged only if its abnormal blocks are this many bits away from prose, together, and it has LEAST characters, a Chinese, Japanese or Korean one counting twice, or LISTED tags or separators: of shorter pages the model alone can't tell.
EVIDENCE, LEAST, LISTED = 25.0, 40, 3
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
LIST_SIGN = regex.compile(r"(?<!\S)[#＃]\p{L}|[·|｜•»]|\s>\s|https?://")
_POINTS = frozenset(".,!?:;()\"'…。、，！？")
_SEPARATORS = frozenset("|·•*/>;»~=#›—")
#: Punctuation that stands for itself; all other signs are one class.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»·•…‘’“”‹›–—°€£¥©®™。、，！？「」"
CLASSES = [
    "^", "$$", "nl", "0", "sym", *dict.fromkeys(["$", *PUNCTUATION]), *(k + m for k in ("url", "tag", "html") for m in ("", "+")), *(k + m for k in ("~w", "~C", "~@", "~h", "~K", "~H") for m in ("", "r", "R", "RR")), *sorted(_FUNCTION - set(PUNCTUATION))
]
INDEX = {c: i for i, c in enumerate(CLASSES)}
WIDTH = len(CLASSES)
START, END = INDEX["^"], INDEX["$$"]


_WORD = {k: INDEX[k] for k in ("~w", "~C", "~@", "~h", "~K", "~H")}
_FUNCTION_ID = {w: INDEX[w] for w in _FUNCTION}
_SYM, _NL, _PRICE, _NUMBER = INDEX["sym"], INDEX["nl"], INDEX["$"], INDEX["0"]
_FAR = -(10**9)


class Page:
    """Class numbers of one page's blocks."""

    def __init__(self) -> None:
        self.at = 0
        self.words: dict[str, int] = {}
        self.phrases: dict[str, tuple[int, int]] = {}
        self.links: list[int] = []
        self.last = ""

    def classes(self, text: str) -> list[int]:
        out: list[int] = []
        shout = text.isupper()
        at, last, words, phrases = self.at, self.last, self.words, self.phrases
        for m in TOKEN.finditer(text):
            kind = m.lastgroup
            t = m.group()
            at += 1
            if kind == "word" or kind == "cjk":
                low = t.lower()
                phrase = last + " " + low
                before = phrases.get(phrase)
                times = before[1] + 1 if before and at - before[0] <= PHRASE_BACK else 0
                phrases[phrase] = (at, times)
                last = low
                c = _FUNCTION_ID.get(low)
                if c is None:
                    plain = low if low.isalpha() else low.translate(_PLAIN)
                    near = kind == "word" and at - words.get(plain, _FAR) <= WORD_BACK
                    words[plain] = at
                    if plain != low and not low.isdigit():
                        c = _WORD["~@"]
                    elif kind == "cjk":
                        o = ord(t)
                        c = _WORD["~h" if o < 0x30A0 else "~K" if o < 0x3100 else "~H"]
                    else:
                        c = _WORD["~C" if t[0].isupper() and not shout else "~w"]
                    c += 3 if times > 1 else 2 if times else 1 if near else 0
                out.append(c)
            else:
                last = ""
                if kind == "p":
                    c = INDEX.get(t, _SYM)
                    if not out or out[-1] != c:
                        out.append(c)
                elif kind == "num":
                    out.append(_PRICE if t[0] in "$€£¥" else _NUMBER)
                elif kind == "nl":
                    out.append(_NL)
                elif kind != "html" or t[:2].lower() == "<a":  # mark-up other than links says nothing here
                    self.links = [k for k in self.links if at - k <= LINK_BACK]
                    out.append(INDEX[kind + "+" if len(self.links) >= 2 else kind])
                    self.links.append(at)
        self.at, self.last = at, last
        return out


def blocks(text: str) -> Iterator[tuple[int, list[int]]]:
    """(characters, class numbers) of each block; short pieces are joined until they have SHORT tokens."""
    page, size, seq = Page(), 0, []
    for piece in _CUT.split(text):
        if not piece or piece.isspace():
            continue
        c = page.classes(piece)
        n = len(piece.strip())
        if len(c) >= SHORT and seq:
            yield size, seq
            size, seq = 0, []
        if seq:
            seq.append(_NL)
        seq += c
        size += n
        if len(seq) >= SHORT:
            yield size, seq
            size, seq = 0, []
    if seq:
        yield size, seq


def _table(f) -> np.ndarray:
    return np.array([bool(f(c)) for c in CLASSES])


_IS_WORD = _table(lambda c: c[:2] in ("~w", "~C", "~@"))
_MARKS = {
    "again": _table(lambda c: c[0] == "~" and c[-1] in "Rr"),
    "often": _table(lambda c: c.endswith("RR") and c[:2] != "~C"),
    "first links": _table(lambda c: c in ("url", "tag", "html")),
    "dense": _table(lambda c: c in ("url+", "tag+", "html+")),
    "points": _table(lambda c: c in _POINTS),
    "signs": _table(lambda c: c in _SEPARATORS),
    "plain": _table(lambda c: c in _FUNCTION or c[:2] == "~h"),
}


#: What is kept of a page: numbers of the classes of all blocks in a row, and of each block its characters and tokens; enough: whether the page is long enough, or list enough, to be flagged.
PAGES = "ids binary, sizes binary, lengths binary, enough boolean"


def encode(text: str | None) -> tuple[bytes, bytes, bytes, bool]:
    """A page as PAGES."""
    ids: list[int] = []
    sizes, lengths = [], []
    if text and not text.isspace():
        for size, seq in blocks(text):
            ids += seq
            sizes.append(size)
            lengths.append(len(seq))
    total = sum(sizes)
    enough = bool(sizes) and (total >= LEAST or total + len(WIDE.findall(text)) >= LEAST or len(LIST_SIGN.findall(text)) >= LISTED)
    return np.array(ids, np.int16).tobytes(), np.array(sizes, np.int32).tobytes(), np.array(lengths, np.int32).tobytes(), enough


class Batch:
    """Pages as arrays: the trigrams of all blocks, ends included, and what is known of blocks."""

    def __init__(self, ids: list[bytes], sizes: list[bytes], lengths: list[bytes]) -> None:
        self.pages = len(ids)
        self.sizes, n = np.frombuffer(b"".join(sizes), np.int32), np.frombuffer(b"".join(lengths), np.int32).astype(np.int64)
        self.ids, self.n = np.frombuffer(b"".join(ids), np.int16), n
        self.page = np.repeat(np.arange(self.pages), [len(x) // 4 for x in sizes])
        self.tokens = n + 1
        # Every block is two starts, its classes, one end.
        seq = np.full(int((n + 3).sum()), START, np.int64)
        first = np.cumsum(n + 3) - (n + 3)
        at = np.arange(len(seq)) - np.repeat(first, n + 3)
        inner = (at >= 2) & (at < np.repeat(n + 2, n + 3))
        seq[inner] = self.ids
        seq[first + n + 2] = END
        self.grams = ((seq[:-2] * WIDTH + seq[1:-1]) * WIDTH + seq[2:])[at[:-2] < np.repeat(n + 1, n + 3)[:-2]] if len(n) else np.zeros(0, np.int64)
        self.block = np.repeat(np.arange(len(n)), n + 1)

    def marks(self) -> dict[str, np.ndarray]:
        """Numbers of tokens of some kinds in each block, and the longest run of words without function words."""
        of = np.repeat(np.arange(len(self.n)), self.n)
        out = {k: np.bincount(of[table[self.ids]], minlength=len(self.n)) for k, table in _MARKS.items()}
        # A run ends at a token of another kind or with its block.
        word = _IS_WORD[self.ids].astype(np.int64)
        total = np.cumsum(word)
        starts = np.zeros(len(word), bool)
        starts[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        reset = np.maximum.accumulate(np.where((word == 0) | starts, total - (word == 1) * starts, 0)) if len(word) else total
        out["run"] = np.zeros(len(self.n), np.int64)
        np.maximum.at(out["run"], of, total - reset)
        return out

    def prose(self) -> np.ndarray:
        """Whether each block may train the first model: not a list, by its form."""
        m, n = self.marks(), self.n
        fit = (m["again"] <= 0.4 * n) & (m["often"] <= 0.1 * n) & ((m["first links"] <= 1) | (m["first links"] <= 0.05 * n)) & (m["dense"] == 0) & (m["signs"] <= 3) & (m["run"] <= 9)
        return fit & (m["plain"] + m["points"] > 0) & ((n < 24) | (m["plain"] >= 0.1 * n))

    def runs_on(self) -> np.ndarray:
        """Whether each block has the function words of prose and few repeats and links: then odd order alone, as of sentences without stops, isn't abnormal."""
        m, n = self.marks(), self.n
        return (m["plain"] >= 0.3 * n) & (m["again"] < 0.2 * n) & (m["first links"] + m["dense"] < 0.1 * n)


class Model:
    """Interpolated trigram model of class sequences, in bits a token. keys: sorted numbers of trigrams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        n = counts.astype(float)
        self.pair = np.bincount(keys // WIDTH, n, WIDTH * WIDTH)  # contexts
        two = np.bincount(keys % (WIDTH * WIDTH), n, WIDTH * WIDTH)
        one, before = np.bincount(keys % WIDTH, n, WIDTH), np.bincount(keys // WIDTH % WIDTH, n, WIDTH)
        p1 = (one + 0.5) / (one.sum() + 0.5 * (np.count_nonzero(one) + 1))
        self.p2 = ((two.reshape(WIDTH, WIDTH) + 4 * p1) / (before[:, None] + 4)).ravel()
        bits, total = self.bits(keys), max(1.0, n.sum())
        self.mean = float((n * bits).sum() / total)
        self.deviation = math.sqrt(max(0.0, float((n * bits * bits).sum() / total) - self.mean**2))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, grams), max(0, len(self.keys) - 1))
        seen = np.where(self.keys[at] == grams, self.counts[at], 0) if len(self.keys) else np.zeros(len(grams))
        return -np.log2((seen + 4 * self.p2[grams % (WIDTH * WIDTH)]) / (self.pair[grams // WIDTH] + 4))

    def blocks(self, b: Batch, high: float = HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a token, whether far above prose, whether far below) of each block."""
        v = np.bincount(b.block, self.bits(b.grams), len(b.tokens)) / b.tokens
        return v, v > self.mean + high + SPREAD * self.deviation / np.sqrt(b.tokens), (v < self.mean - LOW) & (b.tokens > LONG)

    def score(self, b: Batch, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Perplexity of each page and deviation of its most abnormal block (NaN for pages without blocks), share of characters in abnormal blocks, flag.

        Odd order alone, as of sentences without stops, isn't abnormal: a block with the function words of prose and few repeats and links is not counted for being far above.
        """
        v, high, low = self.blocks(b)
        odd = high & ~b.runs_on() | low
        of = lambda x: np.bincount(b.page, x, b.pages)
        total, bad, tokens = of(b.sizes), of(b.sizes * odd), of(b.tokens)
        far = np.abs(v - self.mean)
        worst = np.zeros(b.pages)
        np.maximum.at(worst, b.page, far)
        with np.errstate(invalid="ignore", divide="ignore"):
            perplexity = np.exp2(np.minimum(60.0, of(v * b.tokens) / tokens))
        none = tokens == 0
        perplexity[none] = worst[none] = np.nan
        return perplexity, worst, bad / np.maximum(1, total), (bad > 0.5 * total) & (of(far * b.tokens * odd) >= EVIDENCE) & enough

    def page(self, text: str | None) -> tuple[float, float, float, bool]:
        *parts, enough = encode(text)
        return tuple(x[0] for x in self.score(Batch(*([x] for x in parts)), np.array([enough])))


def _batch(batch: pa.RecordBatch, first: int) -> Batch:
    return Batch(*(batch.column(first + k).to_pylist() for k in range(3)))


def encoded(documents: DataFrame, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """keep and the page as PAGES, computed once."""
    schema = documents.select(keep).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in PAGES.split(", ")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(t.as_py()) for t in batch.column(1)]
            cols = [*zip(*rows)] if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=schema.names)

    return materialize(spread(documents.select(keep, text)).mapInArrow(run, schema))


def fit(pages: DataFrame, before: Model | None = None) -> Model:
    """The model of the blocks that `before` finds normal; without one, of those that aren't lists by form."""
    shared = pages.sparkSession.sparkContext.broadcast(before and (before.keys, before.counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            b = _batch(batch, 0)
            if model:
                _, high, low = model.blocks(b, TRAIN)
                take = ~(high | low)
            else:
                take = b.prose()
            keys, n = np.unique(b.grams[take[b.block]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    sums = pages.select("ids", "sizes", "lengths").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    return Model(sums["gram"].to_numpy(), sums["n"].to_numpy())


def train(pages: DataFrame) -> Model:
    """The model of the prose of all pages (as from `encoded`)."""
    return fit(pages, fit(pages))


def score(pages: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """keep, perplexity, deviation (bits, of the most abnormal block), share (of characters in abnormal blocks), spam."""
    shared = pages.sparkSession.sparkContext.broadcast((model.keys, model.counts))
    schema = pages.select(keep).withColumns({"perplexity": F.lit(None).cast("double"), "deviation": F.lit(None).cast("double"), "share": F.lit(None).cast("double"), "spam": F.lit(None).cast("boolean")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for batch in batches:
            m = m or Model(*shared.value)
            perplexity, worst, share, spam = m.score(_batch(batch, 1), batch.column(4).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(perplexity, from_pandas=True), pa.array(worst, from_pandas=True), pa.array(share), pa.array(spam)], names=schema.names)

    return pages.select(keep, "ids", "sizes", "lengths", "enough").mapInArrow(run, schema)


def scores(documents: DataFrame) -> DataFrame:
    pages = encoded(documents)
    return score(pages, train(pages))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each page flagged."""
    return scores(documents).filter("spam").select("doc_id").distinct()
