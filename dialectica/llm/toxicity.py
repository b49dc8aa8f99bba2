"""Abusive, hateful or sexual content (problem 1): a classifier chain.

Every review is normalised (compatibility forms, invisible characters, look-alike letters, digits and signs for
letters, spaced or dotted letters, drawn-out letters) and cut into sentences. A sentence has two kinds of features: the
words, pairs of words and letter sequences of the labelled sample that it holds, and a small vector of lexical classes.
The chain predicts, one after the other, whether a sentence is harmful at all, abusive, sexual, hateful. The first
model sees all features; each later one sees the lexical classes and the earlier probabilities, and is trained on
out-of-fold predictions of the earlier models, so what the labelled texts teach reaches the categories through the
chain. A review's score is that of its worst sentence.

The models are fitted on the labelled sample alone (at most MOST_LABELS rows, read by the driver); a labelled text names
no sentence, so its worst sentence is taken as the labelled one, round by round.

Every sentence of every text is scored with all that was learned. A pass of the columnar engine over the sentences in
plain spelling tells those that may hold a word of the lexical classes; only for these the classes are looked up one by
one, the others' vector is that of no class. Words, pairs and letter sequences are hashed and summed as arrays, for all
sentences. The least score is that of an empty sentence.

Defined results: null, empty and blank texts are no reviews of this table and get no row; labels that are null or
unknown are left out of training; without labels every probability is 0. Bytes that aren't UTF-8 count as a sign.
"""

from __future__ import annotations

import functools
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.llm.pii import review_texts
from dialectica.session import spread

CATEGORIES = ("abuse", "sexual", "hate")
LINKS = ("harm", *CATEGORIES)
MOST_LABELS = 5_000
#: Letters of other scripts that look like Latin ones.
_ALIKE = dict(zip("асеорхуѕіјһԁѵгкмтвнзαοερντικυχγβɑɡⅼ", "aceopxysijhdvrkmtbhzaoepvtikuxybagl"))
_ALIKE |= {"ı": "i", "ł": "l", "ø": "o", "ß": "ss"}
_LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "€": "e", "£": "l"}
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}@$!0-9]([ .\-_*·]{1,2})[\p{L}@$!0-9](?:\1[\p{L}@$!0-9]){2,}(?![\p{L}\p{N}*@$])")
_UNSEEN = regex.compile(r"\p{Cf}")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}@$!+|*€£]+(?:['’\-][\p{L}\p{M}\p{N}@$!+*]+)*")
_CUT = regex.compile(r"(?<=[.!?…])[\s\"')]+|(?<=[。！？])|\n+|<br ?/?>")

#: Lexical classes, several languages, in normalised spelling (accents kept).
LEXICON = {
    "insult": r"idiots?|morons?|moronic|imbeciles?|cretins?|half-?wits?|dumb-?as+(?:es)?|dumbas+h?o?l?e?s?|dickheads?|dick-?heads?|as+-?holes?|arse-?holes?|bastards?|bitch(?:es|s)?|whores?|sluts?|scum-?bags?|scum|low-?lif(?:es?|es|ves)|dip-?shits?|shit-?heads?|shit-?bags?|(?<!en )(?<!du )(?<!de )(?<!le )retards?|retarded|pricks?|cunts?|wankers?|twats?|douche-?bags?|losers?|pigs?|swine|skanks?|fuck-?ers?|motherfuck\w*|fuck-?wits?|inbreds?|brain-?dead|brainless|pathetic|subnormal|degenerates?|jerk-?offs?|hijos? de (?:puta|perra)|puta|putas|puto|gilipollas|cabr[oó]n(?:es)?|zorras?|capullos?|imb[eé]cil(?:es)?|pendejos?|mal nacidos?|subnormales?|connards?|connasses?|conne|salauds?|salopes?|salope|putes?|ordures?|encul[eé]s?|abrutis?|b[aâ]tards?|fils de pute|arschl[oö]ch(?:er)?|arsch|schlampen?|hurens[oö]hne?|hure|wichser|drecksau|drecksack|fotze|missgeburt|miststück|vollidiot(?:en)?|stronz[oiae]|troi[ae]|puttan[ae]|cretin[aoi]|bastard[oi]|coglion[ei]|testa di cazzo|merda|deficient[ei]|filh[oa]s? da puta|vaca burra|vaca|burra|ot[aá]rios?|vagabund[ao]s?|cuz[aã]o|imbecil|desgraçad[ao]s?|kurwa|skurwysyn\w*|debil\w*|суки?|урод\w*|мразь|тварь|ублюд\w*|クズ(?:野郎)?|バカ(?:野郎)?|馬鹿(?:野郎)?|ブス|アホ|傻[逼比]|蠢货|垃圾人|混蛋|贱人|병신|개새끼|씨발|ي?ا ?كلب|حقير",
    "profane": r"fuck(?:ing|ed)?|shit(?:ty)?|mierda|a la mierda|jod[ae]\w*|merde|scheiß\w*|verdammt\w*|cazzo|porra|caralho|foda-se|bloody hell",
    "garbage": r"garbage|trash|filth|filthy|worthless|useless|drooling|ugly|disgusting|vile|repulsive|waste of (?:space|air|skin)|piece of (?:shit|crap|trash)|pathetic|smirk",
    "threat": r"kill yoursel(?:f|ves)|kys|k y s|hang yourself|go die|(?:you |should |just |better )(?:all )?die|die off|drop dead|a dead one|get my hands on|break (?:every|all|your|his|her|their) (?:\w+ )?(?:bones?|legs?|neck|face|teeth|jaw)|every bone|baseball bat|with a (?:bat|knife|gun|hammer|crowbar)|watch (?:your|his|her|their) backs?|burn (?:this|that|the|it|your) (?:\w+ )?(?:down|dump)|burn \w+ down|locked inside|jump off a|off a bridge|chokes? (?:on|to)|never gets? up again|may (?:your|his|her|their) (?:whole |entire )?famil(?:y|ies)|get sick from|under a (?:truck|bus|train)|slap th(?:at|is|e) \w+|deserves? to (?:die|breathe|suffer|rot|burn)|not deserve to|rot in hell|nobody would miss|would miss you|hope (?:you|he|she|they|the \w+|your \w+) (?:\w+ )?(?:die|dies|rots?|chokes?|burns?|suffers?|drowns?)|beat (?:you|him|her|them) (?:up|to)|punch (?:you|him|her|them|that)|smash (?:your|his|her|that)|stab (?:you|him|her|them)|shoot (?:you|him|her|them)|know where (?:you|he|she|they|the \w+(?: \w+)?) (?:lives?|parks?|sleeps?|works?)|world a favou?r|we will see who laughs|you will (?:regret|pay)|ojal[aá] (?:se |te |os )?(?:muer\w+|pudr\w+)|mu[eé]rete|te voy a matar|que se muera|cr[eè]v(?:e|es|ez)|va mourir|te tuer|verreck\w*|stirb|umbringen|dich kriegen|spero che (?:crep\w+|muo\w+)|crepi|crepa|ti ammazzo|tomara que (?:morra\w*|apodreç\w+)|morra|vou te matar|zdechnij|zabij|сдохни|убью|死ね(?:ば(?:いい)?)?|ぶっ?殺\w*|殺して(?:やる)?|去死|杀了你|죽어|죽여",
    "command": r"shut (?:up|your|the)|get lost|piss off|screw you|up yours|fuck (?:off|you)|go to hell|iros a|vete a|v[aá]yanse|ferme (?:ta|la)|ta gueule|gueule|halt (?:die|dein|deine)|fresse|cala (?:a|essa)|boca|chiudi|vaffanculo|vai (?:te|se)|stai zitto|замолчи|黙れ|滚|閉嘴|you little|listen,? you",
    "dehuman": r"vermin|parasit\w*|rats?|animals|filth|plague|sub-?human\w*|trash|scum|cockroach\w*|roaches|pests?|savages?|lice|infest\w*|breed of|disease|garbage|monkeys?|apes?|liars(?: and thieves)?|thieves|criminals|ratas?|par[aá]sitos?|plagas?|escoria|vermine?s?|cafards?|ungeziefer|schmarotzer\w*|abschaum|gesindel|ausländerpack|asylantenpack|lumpenpack|drecks?pack|parassit[ai]|feccia|topi|pragas?|parasitas?|esc[oó]ria|robactwo|паразит\w*|отброс\w*|害虫|ゴキブリ|寄生虫|蟑螂|벌레|حشرات",
    "group": r"immigrants?|migrants?|foreigners?|refugees?|muslims?|jews?|jewish|christians?|hindus?|arabs?|blacks|asians|mexicans?|africans?|gypsies|gays?|lesbians?|trans(?:gender)?|queers?|fags?|faggots?|women|woman|girls?|females?|cripples?|disabled|handicapped|old people|the elderly|people of (?:that|this|your) (?:faith|religion|race|color|colour|kind)|that faith|that religion|this religion|those people|these people|your kind|their kind|people like (?:them|that|her|him)|women like her|extranjeros?|inmigrantes|moros|negros|gitanos|mujeres|maricones|judíos|étrangers?|immigrés?|arabes|noirs|juifs|musulmans?|femmes|ausländer\w*|flüchtlinge?|juden|türken|frauen|stranieri|immigrati|zingari|negri|ebrei|donne|estrangeiros?|imigrantes?|ciganos|pretos|mulheres|obcokrajowc\w*|imigran\w*|żyd\w*|иностранц\w*|мигрант\w*|приезжи\w*|外国人|移民|中国人|朝鮮人|女ども|外地人|외국인|الأجانب|المهاجر\w*",
    "exclude": r"deport(?: the| all| them|ed)?|go back to (?:where|your)|back (?:to )?where you came from|where you came from|nobody wants|no one wants|keep (?:the |those |these )?\w+(?: \w+)? out|get out of (?:our|this|my)|do not eat with|don't eat with|not (?:sit|eat|serve) (?:with|next to)|spit on (?:them|him|her)|refuse to be served|served by|never wash|cleansed? of|needs? to be cleansed|should not let|shouldn't let|never let one|belong in the|belongs? in the (?:kitchen|back)|not giving orders|too stupid for it|the lot of them|every last one|sit next to decent|decent (?:families|people)|moved in here|no coincidence|first they hire|bought the place|vanish(?:ed)? overnight|all vanished|cleaner place|street clean|no (?:the )?\w+(?: \w+)?, no problem|better place without|smells? like (?:the )?\w+ in here|= (?:a |an )?(?:vermin|parasites|rats|animals|filth|plague|sub-?human|trash|scum|pests|disease|cancer)|born (?:liars|thieves|criminals)|free the tables|die off|looks? at that while eating|fuera|dehors|raus|gehört raus|fuori|fora(?: daqui)?|出て行け|帰れ|滚出|вон|ensucian",
    "sexual": r"porn\w*|xxx|nudes?|naked body|topless|tits|titties|bo+bs?|blow-?jobs?|handjobs?|horny|jerk(?:ed|ing)? off|masturbat\w*|orgasms?|pus+y|pus+ies|dildos?|nipples?|boners?|erections?|cum(?:ming|shots?)?|coming on (?:them|her|him|me|you)|ride me|bend (?:her|him|me) over|lick (?:every|her|his|your|me)|every inch of|made me (?:so )?hard|me hard|suck(?:ing|ed|s)? (?:on |his |her |my |your |me)|lips sucking|go(?:es)? down on|happy endings?|all positions|strip(?:s|ping)? on cam|on cam|hot sex|sex(?:ting)?|sexy time|anal|threesomes?|gangbang\w*|escorts?|fuck (?:that|the|her|him|me|my|this|a) (?:\w+ )?(?:bartender|waiter|waitress|host|hostess|server|owner|cook|manager|cashier|all|hard|girl|guy)?|would fuck|best ass|tight (?:little )?(?:skirt|ass|body)|grinding on|on my lap|wet (?:blow|puss|holes?|sluts?)|dirty (?:sluts?|talk|nudes?|blow\w*|orgasms?|porn|puss\w*)|uncensored|no limits|full video|webcam|discreet|follar\w*|tetas|culo|coño|polla|correrme|porno|baiser\w*|b(?:ite|ites) |nichons|sucer|ficken\w*|titten|geil|blasen|scopar\w*|tette|figa|pompin\w*|foder|fodia|buceta|peitos|chupar|трах\w*|сиськи|секс\w*|порно|セックス|エロ\w*|おっぱい|やりたい|抱きたい|裸|做爱|色情|섹스|야동|جنس",
    "target": r"you|your|yourself|yours|u|ur|yo|he|she|him|her|his|hers|they|them|their|whoever|anyone|those|that \w+ of a|owner|owners|waiters?|waitress|bartender|cashier|cook|chef|server|host|hostess|manager|staff|kitchen|reviewer|reviewers|people|everyone|camarer[oa]|dueñ[oa]|patron|serveuse?r?|wirt|kellner(?:in)?|koch|proprietario|camerier[ea]|don[oa]|garçom|empregad[oa]|tu|te|ti|vous|toi|du|dich|ihr|sei|você|sua|seu|店員|店長|客|老板|服务员",
    "self": r"i felt like|felt like an? \w+|i am (?:such )?an?|i'm (?:such )?an?|call me|my own",
    "report": r"shouted|insults?|yelling|yelled|called (?:me|us|him|her|someone)|signs? (?:says?|said)|rude|asked (?:him|her|them) to leave|banned|apologi[sz]ed|someone (?:at|said|called)|guest|overheard|reported",
    "food": r"killer|murder an?|could murder|to die for|damn good|sinfully|naked|dirty (?:fries|martini|rice|chai)|spotted dick|cock(?:erel|tails?|-a-leekie)?|rooster|breasts?|thighs?|stuffed|bloody mary|pulled pork|spicy|nightmare|appetite",
}
_CLASSES = {k: regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{v})(?![\p{{L}}\p{{N}}])" if k not in () else v) for k, v in LEXICON.items()}
#: Scripts without spaces: the same words, found anywhere.
_ANYWHERE = {k: regex.compile("|".join(x for x in v.split("|") if regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", x)) or r"(?!)") for k, v in LEXICON.items()}
_GATE = ("insult", "profane", "garbage", "threat", "command", "dehuman", "group", "exclude", "sexual")
_PEOPLE = regex.compile(r"\b(?:[Tt]hose|[Tt]hese|all|[Tt]ypical|[Aa]ll|by|with|wants|let|of|THOSE|[Ll]ike) (?:those |these |the )?(\p{Lu}\p{L}{3,}(?:i|ans?|ians|ese|ish|s|ecs))\b|\b(\p{Lu}\p{L}{3,}(?:i|ans|ians|ese|ish|ecs)) (?:people|=|are|never|in here|bought|sit)\b|\b(\p{Lu}\p{L}{3,}(?:ish|ese|ian|an)) people\b|(?:like|with) (\p{L}{4,}(?:i|ans|ians|ese|ecs)) (?:in here|,|never)")


def normal(text: str) -> str:
    """The text in plain spelling: lower case, look-alikes, signs for letters, spaced and drawn-out letters undone."""
    t = text
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKC", t))
    t = _SPACED.sub(lambda m: regex.sub(r"[ .\-_*·]", "", m[0]), t)
    return _TOKEN.sub(lambda m: _normal_word(m[0]), t).replace("’", "'").replace("\n", " ")


@functools.lru_cache(maxsize=50_000)
def _normal_word(token: str) -> str:
    w = token.lower()
    if not w.isascii() and regex.search(r"[a-z]", w) or not w.isascii() and all(c in _ALIKE or c.isascii() for c in w):
        w = "".join(_ALIKE.get(c, c) for c in w)
    if any(c.isalpha() for c in w) and any(c in _LEET for c in w.rstrip("!")) and regex.search(r"[a-z]", w):
        v = "".join(_LEET.get(c, c) for c in w.rstrip("!"))
        if not regex.fullmatch(r"\d+[a-z]{1,2}", w):
            w = v
    return regex.sub(r"([a-z])\1{2,}", r"\1", w)


#: What a plain text never holds: other letters than ASCII, signs inside words, drawn-out or spaced letters, stars.
_ODD = regex.compile(r"[^\x00-\x7f]|[a-zA-Z]![a-zA-Z0-9@$+|*]|[a-zA-Z][@$0-9+|*]|[@$0-9+|*!][a-zA-Z]|([a-zA-Z])\1\1|(?<![a-zA-Z])[a-zA-Z](?:[ .\-_*]{1,2}[a-zA-Z]){2}[ .\-_*]")
_MASK = regex.compile(r"(?<![\p{L}\p{N}*])[\p{L}]+\*+[\p{L}*]*")


#: Words that are often masked by stars; plurals are made by rule.
_MASKED = [w + end for w in "bitch asshole dumbass bastard whore slut moron idiot cretin imbecile halfwit scumbag lowlife dipshit dickhead cunt fuck shit porn pussy blowjob orgasm nude tit retard".split() for end in ("", "s", "es")] + ["fucking", "nudes"]


def _unmask(s: str) -> str:
    """Words masked by stars, as b**ch, become the one insult or sexual word of the same length, if there is one."""

    def fit(m: regex.Match) -> str:
        pattern = regex.compile(regex.escape(m[0]).replace(r"\*", "[a-z]?"))
        for w in _MASKED:
            if pattern.fullmatch(w):
                return w
        return m[0]

    return _MASK.sub(fit, s) if "*" in s else s


#: What people say of themselves isn't aimed at anyone.
_SELF = regex.compile(r"\b(?:i|we) (?:felt|feel|looked|look|was|were|am|must be) (?:like )?(?:such )?(?:an? )?(?:complete |total |real )?(?:idiots?|morons?|fools?|pigs?|losers?)\b")
NAMES = [*LEXICON, "people"]
_PAIRS = [("insult", "target"), ("insult", "self"), ("insult", "report"), ("insult", "command"), ("garbage", "target"), ("group", "dehuman"), ("group", "exclude"), ("group", "garbage"), ("group", "threat"), ("group", "insult"), ("people", "dehuman"), ("people", "exclude"), ("people", "garbage"), ("dehuman", "exclude"), ("threat", "target"), ("threat", "report"), ("command", "insult"), ("sexual", "food"), ("sexual", "target"), ("insult", "food"), ("profane", "target"), ("garbage", "threat"), ("dehuman", "target"), ("profane", "insult"), ("insult", "threat")]
WIDTH = len(NAMES) + len(_PAIRS) + 4


#: The patterns of the classes as the columnar engine can read them, over sentences in plain spelling: without look-arounds and with a wider \w, so that they match wherever a class does.
_GATES = [rf"(?:^|[^\p{{L}}\p{{N}}])(?:{regex.sub(r'[(][?]<!(?:[^)]*)[)]', '', LEXICON[k]).replace(chr(92) + 'w', '[^ ]')})" for k in _GATE] + [_ANYWHERE[k].pattern for k in _GATE if _ANYWHERE[k].pattern != "(?!)"]
#: _ODD, _SELF and _CUT for the columnar engine; its \s knows ASCII only.
_ODD_GATE = "|".join([r"[^\x00-\x7f]|[a-zA-Z]![a-zA-Z0-9@$+|*]|[a-zA-Z][@$0-9+|*]|[@$0-9+|*!][a-zA-Z]|(?:^|[^a-zA-Z])[a-zA-Z](?:[ .\-_*]{1,2}[a-zA-Z]){2}[ .\-_*]", *(3 * c for c in string.ascii_letters)])
_SELF_GATE = _SELF.pattern.replace(r"\b", "")
_CUT_GATE = r"""([.!?…])[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"')]+|([。！？])|\n+|<br ?/?>"""


def plain(sentences: pa.Array) -> pa.Array:
    """Sentences in plain spelling, as `classes` gives them."""
    out = pc.ascii_lower(sentences)
    odd = pc.match_substring_regex(sentences, _ODD_GATE)
    if pc.any(odd).as_py():
        out = pc.replace_with_mask(out, odd, pa.array([normal(x) for x in sentences.filter(odd).to_pylist()], out.type))
    rest = pc.or_(pc.match_substring(out, "*"), pc.match_substring_regex(out, _SELF_GATE))
    if pc.any(rest).as_py():
        out = pc.replace_with_mask(out, rest, pa.array([_SELF.sub(" ", _unmask(x)) for x in out.filter(rest).to_pylist()], out.type))
    return out


def maybe(texts: pa.Array, markers: list[str], spelled: pa.Array | None = None) -> list[bool]:
    """Whether each text (spelled: its plain spelling) may hold a word of the classes or a marker; null counts as false."""
    s = plain(texts) if spelled is None else spelled
    own = [r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(map(regex.escape, markers)) + r")(?:[^\p{L}\p{N}]|$)"] if markers else []
    out = functools.reduce(pc.or_, (pc.match_substring_regex(s, gate) for gate in [*_GATES, *own]))
    return pc.fill_null(out, False).to_pylist()


def classes(sentence: str) -> tuple[str, np.ndarray | None]:
    """The sentence in plain spelling and the vector of its lexical classes; None if no class that could make a case occurs."""
    s = normal(sentence) if _ODD.search(sentence) else sentence.lower()
    s = _SELF.sub(" ", _unmask(s))
    return s, vector(s, sentence)


def vector(s: str, sentence: str) -> np.ndarray | None:
    """The vector of the lexical classes of a sentence, s in plain spelling."""
    hits = {}
    for k in _GATE:
        n = len(_CLASSES[k].findall(s)) + (len(_ANYWHERE[k].findall(s)) if not s.isascii() else 0)
        if n:
            hits[k] = n
    if not hits:
        return None
    named = _PEOPLE.search(sentence) if any(k in hits for k in ("dehuman", "exclude", "garbage", "threat")) else None
    for k in NAMES:
        if k not in hits and k not in _GATE and k != "people" and (_CLASSES[k].search(s) or _ANYWHERE[k].search(s)):
            hits[k] = 1
    if named:
        hits["people"] = 1
    v = np.zeros(WIDTH)
    for i, k in enumerate(NAMES):
        v[i] = min(2, hits.get(k, 0))
    for i, (a, b) in enumerate(_PAIRS):
        v[len(NAMES) + i] = a in hits and b in hits
    v[-4] = sum(k in hits for k in ("insult", "threat", "command", "sexual", "dehuman", "exclude")) >= 2
    v[-3] = hits.get("insult", 0) >= 2
    v[-2] = hits.get("sexual", 0) >= 2
    v[-1] = 1.0
    return v


_ZERO = np.zeros(WIDTH)
_ZERO[-1] = 1.0
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}']+")
#: Size of the table of hashed sequences, and the number of labelled texts that must hold one.
BUCKETS, LEAST_TEXTS = 4096, 5


def grams(s: str) -> set[str]:
    """Words, pairs of neighbours and sequences of 4 letters of a sentence in plain spelling."""
    w = _LETTERS.findall(s)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *("#" + x[i : i + 4] for y in w for x in (f"<{y}>",) for i in range(len(x) - 3))}


@functools.lru_cache(maxsize=200_000)
def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


@functools.lru_cache(maxsize=50_000)
def _word_buckets(w: str) -> tuple[int, ...]:
    """Buckets of what `grams` makes of one word."""
    return tuple({_bucket(g) for g in grams(w)})


def sentences(text: str) -> list[tuple[str, np.ndarray | None]]:
    return [classes(x) for x in _CUT.split(text) if x and not x.isspace()]


#: Fewer sentences than these are read one by one, which takes less time than making the columnar engine's patterns.
FEW = 50


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The strings of the lists that aren't empty, and the number of the list of each."""
    owner, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(flat, "")
    return owner.filter(full).to_numpy().astype(np.int64), flat.filter(full)


def _readable(texts: pa.Array) -> pa.Array:
    """texts, with a replacement character for bytes that aren't UTF-8."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([b and b.decode("utf-8", "replace") for b in texts.cast(pa.large_binary()).to_pylist()], texts.type)


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The sentences of all texts, and the number of the text of each; a blank one may be among them."""
    return _parts(pc.split_pattern(pc.replace_substring_regex(texts, _CUT_GATE, "\\1\\2\n"), "\n"))


def _words(spelled: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all sentences, and the number of the sentence of each."""
    if len(spelled) < FEW:
        found = [_LETTERS.findall(s) for s in spelled.to_pylist()]
        return np.repeat(np.arange(len(found)), [len(w) for w in found]), pa.array([w for of in found for w in of], spelled.type)
    return _parts(pc.split_pattern_regex(spelled, r"[^\p{L}\p{M}\p{N}']+"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray | _Rows, y: np.ndarray, free: np.ndarray, rounds: int = 400, decay: float = 0.004) -> np.ndarray:
    """Regularised logistic regression, both classes of equal weight. free: columns without decay."""
    w = np.zeros(x.shape[1])
    acc = np.full(x.shape[1], 1e-6)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    keep = decay * ~free
    for _ in range(rounds):
        e = (y - _sigmoid(x @ w)) * c
        g = (x.back(e) if isinstance(x, _Rows) else x.T @ e) - keep * w
        acc += g * g
        w += 0.3 * g / np.sqrt(acc)
    return w


class Chain:
    """Linear models in the order of LINKS: the first sees classes and hashed sequences, each later one classes and the earlier probabilities.

    markers only tell which words alone the first model has learned to be harmful; no score depends on them.
    """

    def __init__(self, first: np.ndarray | None, later: list[np.ndarray], known: frozenset[int], markers: list[str], cutoff: float = 0.5) -> None:
        self.first, self.later, self.known, self.markers, self.cutoff = first, later, known, markers, cutoff
        self.is_known = np.isin(np.arange(BUCKETS), list(known))

    def probabilities(self, x: np.ndarray, learned: np.ndarray) -> np.ndarray:
        """Probability of each link, for each sentence: its classes, and the sum of what the first model has learned of its sequences."""
        if self.first is None:
            return np.zeros((len(x), len(LINKS)))
        # Sums row by row: a sentence's value doesn't depend on those beside it, as that of a matrix product may.
        p = _sigmoid((x * self.first[:WIDTH]).sum(axis=1) + learned)[:, None]
        for w in self.later:
            p = np.column_stack([p, _sigmoid((x * w[:WIDTH]).sum(axis=1) + (_logit(p) * w[WIDTH:]).sum(axis=1))])
        return p

    def learned(self, spelled: pa.Array) -> np.ndarray:
        """Sum of the first model's weights of the known buckets of each sentence in plain spelling, each bucket once."""
        owner, words = _words(spelled)
        coded = words.dictionary_encode()
        word, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        of_word = [_word_buckets(w) for w in vocabulary]
        size = np.array([len(b) for b in of_word], dtype=np.int64)
        flat = np.array([b for of in of_word for b in of], dtype=np.int64)
        # Places of all buckets of all words: a word's first place in the flat table, then its next ones.
        n = size[word]
        place = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(n) - n), n)
        # A pair's checksum goes on from that of its first word and the space.
        begun, ended = [zlib.crc32(f"{w} ".encode()) for w in vocabulary], [w.encode() for w in vocabulary]
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pair = np.array([zlib.crc32(ended[b], begun[a]) for a, b in zip(word[at].tolist(), word[at + 1].tolist())], dtype=np.int64) % BUCKETS
        bucket = np.concatenate([flat[place], pair])
        sentence = np.concatenate([np.repeat(owner, n), owner[at]])
        take = self.is_known[bucket]
        held = np.sort(sentence[take] * BUCKETS + bucket[take])
        held = held[np.diff(held, prepend=-1) > 0]
        return np.bincount(held // BUCKETS, self.first[WIDTH + held % BUCKETS], len(spelled))

    def score_all(self, texts: pa.Array) -> np.ndarray:
        """Probability of each category for each text, of the worst sentence in that category."""
        owner, raw = _cut(_readable(texts))
        spelled = plain(raw)
        x = np.tile(_ZERO, (len(raw) + 1, 1))
        for k in range(len(raw)) if len(raw) < FEW else np.flatnonzero(maybe(raw, [], spelled)):
            v = vector(spelled[k].as_py(), raw[k].as_py())
            if v is not None:
                x[k] = v
        sums = np.zeros(len(x))
        if self.first is not None and len(raw):
            sums[:-1] = self.learned(spelled)
        p = self.probabilities(x, sums)[:, 1:]
        out = np.tile(p[-1], (len(texts), 1))
        np.maximum.at(out, owner, p[:-1])
        return out

    def score(self, text: str) -> tuple[float, ...]:
        """Probability of each category, of the worst sentence in that category."""
        return tuple(self.score_all(pa.array([text], pa.string()))[0].tolist())

    def without_chain(self) -> Chain:
        """The same models with no weight on earlier probabilities."""
        return Chain(self.first, [np.concatenate([w[:WIDTH], np.zeros(len(w) - WIDTH)]) for w in self.later], self.known, self.markers, self.cutoff)


def _logit(p: np.ndarray) -> np.ndarray:
    """Earlier probabilities as later models see them: log odds, which a linear model can add up."""
    q = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q)) / 4


def fit_chain(texts: list[tuple[str, str]], folds: int = 3, passes: int = 2) -> Chain:
    """texts: (text, label). Earlier probabilities in training are out-of-fold, with folds by text. Deterministic, and so kept for the process."""
    return _fit_chain(tuple(texts), folds, passes)


class _Rows:
    """A dense block of columns beside a sparse one (values 0.5), as one matrix."""

    def __init__(self, dense: np.ndarray, row: np.ndarray, column: np.ndarray, width: int) -> None:
        self.dense, self.row, self.column, self.width = dense, row, column, width
        self.shape = (len(dense), dense.shape[1] + width)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        return self.dense @ w[:k] + 0.5 * np.bincount(self.row, w[k:][self.column], len(self.dense))

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times v."""
        return np.concatenate([self.dense.T @ v, 0.5 * np.bincount(self.column, v[self.row], self.width)])

    def __getitem__(self, take: np.ndarray) -> _Rows:
        at = np.cumsum(take) - 1
        keep = take[self.row]
        return _Rows(self.dense[take], at[self.row[keep]], self.column[keep], self.width)


@functools.lru_cache(maxsize=4)
def _fit_chain(texts: tuple[tuple[str, str], ...], folds: int, passes: int) -> Chain:
    data = [(t, y) for t, y in texts if t and y in ("none", *CATEGORIES)]
    if not any(y != "none" for _, y in data):
        return Chain(None, [], frozenset(), [])
    bags = [sentences(t) for t, _ in data]
    held = Counter(g for bag in bags for g in {b for s, _ in bag for b in map(_bucket, grams(s))})
    known = frozenset(b for b, n in held.items() if n >= LEAST_TEXTS)
    column = {b: i for i, b in enumerate(sorted(known))}
    small, fold, owner, row, at = [], [], [], [], []
    for k, bag in enumerate(bags):
        for s, v in bag or [("", None)]:
            held_here = [column[b] for b in sorted({_bucket(g) for g in grams(s)}) if b in column]
            row += [len(small)] * len(held_here)
            at += held_here
            small.append(_ZERO if v is None else v)
            fold.append(k % folds)
            owner.append(k)
    small, f, owner = np.array(small), np.array(fold), np.array(owner)
    x = _Rows(small, np.array(row, dtype=int), np.array(at, dtype=int), len(column))
    label = np.array([y for _, y in data])
    worst = small[:, : len(NAMES)].sum(axis=1)
    first = later = None
    for _ in range(passes):
        # The worst sentence of each harmful text has its label, the others have none.
        target = np.full(len(small), "none", dtype=object)
        for k in np.flatnonzero(label != "none"):
            mine = np.flatnonzero(owner == k)
            target[mine[worst[mine].argmax()]] = label[k]

        def link(z: np.ndarray | _Rows, y: np.ndarray, rounds: int, decay: float, chained: bool) -> tuple[np.ndarray, np.ndarray]:
            free = np.zeros(z.shape[1], dtype=bool)
            free[WIDTH - 1] = True
            free[WIDTH:] = chained
            out = np.zeros(z.shape[0])
            for k in range(folds):
                out[f == k] = _sigmoid(z[f == k] @ _fit(z[f != k], y[f != k], free, rounds, decay))
            return _fit(z, y, free, rounds, decay), out

        first, out = link(x, (target != "none").astype(float), 80, 0.002, False)
        earlier, later = out[:, None], []
        for c in CATEGORIES:
            w, out = link(np.column_stack([small, _logit(earlier)]), (target == c).astype(float), 300, 0.006, True)
            later.append(w)
            earlier = np.column_stack([earlier, out])
        worst = earlier[:, 0]
    wide = np.zeros(WIDTH + BUCKETS)
    wide[:WIDTH] = first[:WIDTH]
    for b, i in column.items():
        wide[WIDTH + b] = 0.5 * first[WIDTH + i]
    # The largest out-of-fold probability of a category, of the worst sentence of each text, sets the cutoff.
    top = np.zeros(len(data))
    np.maximum.at(top, owner, earlier[:, 1:].max(axis=1))
    # Markers: words of the sample that alone make a sentence half as likely harmful as not, or more.
    alone = {w: wide[WIDTH - 1] + sum(wide[WIDTH + b] for b in {_bucket(g) for g in grams(w)}) for bag in bags for s, _ in bag for w in _LETTERS.findall(s)}
    return Chain(wide, later, known, sorted(w for w, z in alone.items() if z > MARKER and len(w) > 2), best_cutoff(top, label != "none"))


def best_cutoff(score: np.ndarray, harmful: np.ndarray) -> float:
    """The middle, in log odds, of the range of cutoffs with the largest F1, within LEAST_CUTOFF and 1 - LEAST_CUTOFF."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(harmful[order])
    f1 = 2 * hits / (np.arange(1, len(score) + 1) + harmful.sum())
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(score) else 0.0
    middle = _sigmoid(2 * (_logit(score[order[k]]) + _logit(np.float64(low))))
    return float(np.clip(middle, LEAST_CUTOFF, 1 - LEAST_CUTOFF))


#: Log odds from which a word alone is a marker.
MARKER = -1.2
LEAST_CUTOFF = 0.2


def labelled(labels: DataFrame) -> list[tuple[str, str]]:
    """The labelled sample, at most MOST_LABELS rows in the order of label_id."""
    rows = labels.filter("label is not null and text is not null").orderBy("label_id", "text").select("text", "label").limit(MOST_LABELS).collect()
    return [(r.text, r.label.strip().lower()) for r in rows]


#: Bytes of texts that are scored as one set of arrays, unless one text alone is longer.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most SLICE bytes of texts, or of one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + SLICE, side="right")))
        yield batch.slice(start, end - start)
        start = end


def scores(examples: DataFrame, chain: Chain) -> DataFrame:
    """idx, item_pos, source, p_abuse, p_sexual, p_hate, score (the largest) of every review, each delivery."""
    shared = examples.sparkSession.sparkContext.broadcast((chain.first, chain.later, chain.known, chain.markers, chain.cutoff))
    reviews = review_texts(examples)
    names = ["idx", "item_pos", "source", "p_abuse", "p_sexual", "p_hate", "score"]
    schema = reviews.select("idx", "item_pos", "source").withColumns({n: F.lit(None).cast("double") for n in names[3:]}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Chain(*shared.value)
            for part in slices(batch, 3):
                p = model.score_all(part.column(3))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *(pa.array(c, pa.float64()) for c in (*p.T, p.max(axis=1)))], names=names)

    return spread(reviews.select("idx", "item_pos", "source", "text")).mapInArrow(run, schema)


def found(examples: DataFrame, labels: DataFrame, cutoff: float | None = None) -> DataFrame:
    """idx and item_pos of the reviews whose score reaches the cutoff (by default the one that labelled texts give)."""
    chain = fit_chain(labelled(labels))
    return scores(examples, chain).filter(F.col("score") >= (chain.cutoff if cutoff is None else cutoff)).select("idx", "item_pos").distinct()


def rates(examples: DataFrame, labels: DataFrame, cutoff: float | None = None) -> DataFrame:
    """source (as compared: trimmed, lower case), reviews, flagged, rate; a review delivered twice counts once."""
    chain = fit_chain(labelled(labels))
    key = F.lower(F.trim("source"))
    once = scores(examples, chain).groupBy("idx", "item_pos").agg(F.max("score").alias("score"), F.min(key).alias("source"))
    df = once.groupBy("source").agg(F.count("*").alias("reviews"), F.count_if(F.col("score") >= (chain.cutoff if cutoff is None else cutoff)).alias("flagged"))
    return df.withColumn("rate", F.col("flagged") / F.col("reviews"))
