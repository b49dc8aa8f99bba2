"""Personal information in free text (problem 5): a skip-chain conditional random field.

A text is cut into chunks (words, e-mail addresses, runs of digits, codes, signs). Each chunk gets a label: none,
email, phone, id_number, address or person_name. A linear chain joins neighbours; skip edges join equal or similar
chunks anywhere in the text, so that what is plainly a name in one place is one in the others too. The weights are
fitted by composite likelihood on sentences that this module makes itself (fixed number and seed); marginals come from
loopy belief propagation on chain and skip edges together.

Chunks that no evidence touches (no digits run, address sign, given name, title, name cue, street form) can only have
the label none, so messages are passed only in windows around evidence; this is part of the model, not a cut of it.

Defined results: null, empty and blank texts hold nothing and come out unchanged; a given name alone, a street without
number, handles, web addresses, prices, dates, receipt, order and table numbers aren't personal information; the text
between entities comes out unchanged, to the character.
"""

from __future__ import annotations

import bisect
import functools
import random
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.session import spread

KINDS = ("none", "email", "phone", "id_number", "address", "person_name")
NONE, EMAIL, PHONE, IDENT, ADDRESS, NAME = range(6)
#: A chunk is part of a name from this marginal on; names are checked for a family name afterwards.
NAME_CUTOFF = 0.25
#: Bound of the weight of a skip edge.
MOST_AGREEMENT = 12.0
PLACEHOLDER = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", IDENT: "[ID_NUMBER]", ADDRESS: "[ADDRESS]", NAME: "[PERSON_NAME]"}

#: Common given names of many countries (words that are also dishes, plants or places are left out).
GIVEN = frozenset(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony steven andrew kenneth joshua kevin brian
    patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty sandra ashley emily donna michelle carol amanda melissa
    leila kofi priya mateo thiago zora oskar emeka saoirse yusuf greta anouk noor pavel tobias ludmila hiroto ilse wren aino renske callum bianca jonas
    maria carlos juan luis ana carmen pedro miguel javier lucia sofia pablo diego fernando joao paulo beatriz ines tiago rui giulia marco luca paolo francesca chiara
    hans klaus jürgen ursula heike stefan katrin lukas felix pierre jean claire sophie camille julien antoine margot nicolas mohammed ahmed fatima aisha omar hassan ali layla
    ivan olga sergei dmitri natasha tatiana anna piotr agnieszka katarzyna marek jan lars ingrid sven astrid wei mei hiroshi yuki sakura kenji haruto ravi anjali arjun deepa sanjay
    chidi ngozi kwame amara zainab ibrahim devon marta martin paul george peter alice emma laura elena irene helen ruth rosa clara eva nina vera simon oliver henry jack noah ethan mia zoe siobhan niamh liam aoife rory eoin ольга иван сергей наталья мария анна дмитрий نور محمد فاطمة أحمد علي ليلى""".split()
)
#: Forms of address, words of streets and units, and words that announce each kind.
TITLES = frozenset("mr mrs ms miss mister dr doctor prof professor herr frau señor señora sr sra sres don doña mme mlle monsieur madame signor signora sig senhor senhora dra sir pan pani mevrouw meneer".split())
#: Titles that are common words without a capital letter.
CAPITAL_TITLES = frozenset("don pan sir miss sig".split())
PARTICLES = frozenset("van von der den de da do dos del della di la le al el bin ibn ter ten zu".split())
STREET = frozenset("street st road rd avenue ave lane ln drive dr way place pl court ct crescent cres terrace terr boulevard blvd square sq close row parkway pkwy highway hwy alley circle cir trail grove gardens mews walk quay wharf".split())
STREET_FIRST = r"calle|c/|avenida|avda\.?|plaza|paseo|rua|r\.|travessa|rue|avenue|allée|impasse|chemin|via|viale|piazza|corso|vicolo|ulica|ul\.|aleja|ул\.|улица|проспект|شارع"
BUSINESS = frozenset("diner cafe café grill bistro kitchen tavern cantina sushi bakery smokehouse brewpub creperie taqueria trattoria steakhouse pizzeria deli bar house room restaurant eatery pub inn hotel shop market".split())
PHONE_CUES = frozenset("call called phone tel telephone ring rang whatsapp mobile cell number text sms reach dial fax rückruf anrufen nummer llámenme llame teléfono móvil número rappelez appelez numéro portable liguem ligue telefone telefono chiamate chiamami numer zadzwoń звоните телефон contact under para".split())
ID_CUES = frozenset("ssn social security passport licence license dni nie nif cpf id tax national insurance identity ausweis personalausweis reisepass steuer documento pièce carte passeport identité codice fiscale pesel паспорт card ni driver's drivers document utr sin".split())
NO_CUES = frozenset("receipt order flight lot table code sku wine since calories scored cost price room gate bus version page invoice booking ticket open hours reservation model isbn seats party".split())
NAME_CUES = frozenset("signed named uns serviti atendió waiter waitress server cashier bartender hostess told mister".split())
NAME_CUE_PAIRS = frozenset(tuple(x.split()) for x in "complained to,addressed to,spoke to,talked to,thanks to,again to,belongs to,ask for,asked for,reservation under,booked under,served by,name is,name was,called by,signed by,atendidos por,atendido por,merci à,i am,i'm called,counter staff".split(","))
UNITS = frozenset("apt apartment unit suite flat floor no esq piso 2ºb".split())
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"

_AT = r"(?:\s[@＠]\s|[@＠]|\s?[\(\[\{<]\s?(?:at|@|arroba)\s?[\)\]\}>]\s?)"
_DOT = r"(?:[.．。]|\s?[\(\[\{<]\s?(?:dot|punto|punkt|\.)\s?[\)\]\}>]\s?|\s(?:dot|punto|punkt)\s)"
_EMAIL = rf"[A-Za-zÀ-ɏ0-9][A-Za-zÀ-ɏ0-9._%+\-]*(?:{_AT}[\p{{L}}\p{{N}}\-]+(?:{_DOT}[\p{{L}}\p{{N}}\-]+)*{_DOT}\p{{L}}{{2,}}|\s(?:at|arroba|@)\s[\p{{L}}\p{{N}}\-]+(?:\s(?:dot|punto|punkt)\s[\p{{L}}\p{{N}}\-]+)*\s(?:dot|punto|punkt)\s\p{{L}}{{2,}}|\s(?:at|arroba)\s[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)*\.(?:com|net|org|edu|example|test|invalid|de|fr|es|it|pt|pl|uk|jp)\b)"
CHUNK = regex.compile(
    rf"(?P<E>(?i:{_EMAIL}))"
    r"|(?P<U>(?:https?://|www\.)\S+|(?<![\p{L}\p{N}])[@#＠]\w[\w.]*)"
    rf"|(?P<N>\b(?:{DIGIT_WORDS})(?:[\s,\-]+(?:{DIGIT_WORDS})){{5,}}\b)"
    r"|(?P<A>(?<![\p{L}\p{N}])(?:[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d](?![\p{L}\p{N}])|\d{7,8}\s?-\s?[A-Za-z](?![\p{L}\p{N}])|\p{Lu}{1,3}-?\d(?=(?:[\d\p{Lu}-]*\d){4})[\d\p{Lu}-]*[\d\p{Lu}]|\p{L}{1,3}-?\d(?=(?:[\d\-]*\d){4})[\d\-]*\d)(?![\p{L}\p{N}]))"
    r"|(?P<D>(?<![A-Za-zÀ-ɏ\p{N}.,$€£])(?:[+＋]|\()?\p{Nd}(?:(?:[  ]?[()\-‐-―－.·]{0,2}[  ]?|/)\p{Nd}){4,}(?![\p{Nd}]|[.,:]\p{Nd}))"
    r"|(?P<J>(?:(?<=担当は|担当者は|担当の|スタッフの|店員の|名前は|と申す|店長の|ウェイターの)[\p{Han}々]{1,4}[\s　]?[\p{Han}\p{Hiragana}\p{Katakana}ー々]{1,6}?(?=さん|様|氏|くん|君|です|でし|と|に|が|を|、|。|$)|(?<![\p{Han}\p{Hiragana}\p{Katakana}])[\p{Han}々]{2,4}[\s　][\p{Han}\p{Hiragana}\p{Katakana}々]{1,5}(?:さん|様)?(?![\p{Han}\p{Hiragana}\p{Katakana}])|(?<![\p{Hangul}])[김이박최정강조윤장임한오서신권황안송류홍전고문손양배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모장남탁국어은편용예경봉사부가복태목형피두감음빈동온호범좌승간상][\p{Hangul}]{2,3}(?=님|씨|[^\p{Hangul}]|$)))"
    r"|(?P<w>(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+(?:['’\-](?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+)*)|(?P<d>\p{Nd}+)|(?P<p>[^\s]|\n)"
)
ADDRESS_FORMS = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}$€£.,:/\-])(?:No\.?\s?)?\d{{1,5}}(?:\s?-\s?\d{{1,4}})?[A-Za-z]?,?\s(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?\s)?(?:[\p{{L}}'’\-]+\s){{1,3}}(?:{'|'.join(sorted(STREET, key=len, reverse=True))})\b\.?(?:,?\s(?:Apt|Apartment|Unit|Suite|Flat|Floor)\.?\s?\w+)?", regex.I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{STREET_FIRST})(?:\s|(?<=[./])\s?)(?:[\p{{L}}'’\-]+\.?\s?){{1,4}},?\s?(?:n\.?º?\s?|nº\s?|д\.\s?)?\d{{1,5}}(?:\s?[A-Za-z])?\b(?:,\s?\d{{1,2}}\.?\s?º\s?\w*\.?)?(?:,?\s\d{{4,5}}(?:-\d{{3}})?\b)?", regex.I),
    regex.compile(r"(?<![\p{L}\p{N}$€£.,:])\d{1,5}(?:\s?(?:bis|ter|[a-z]))?,?\s(?:rue|avenue|boulevard|allée|impasse|chemin|place|quai|route)\s(?:[\p{L}'’\-]+[\s,]?){1,5}?(?=[,.;\n)]|\s\d|$)(?:,?\s\d{5}\s[\p{L}\-]+)?", regex.I),
    regex.compile(r"(?<![\p{L}\p{N}])(?:am|an der|im)?\s?[\p{L}\-]*\p{L}{2,}(?:straße|strasse|str\.?|weg|gasse|allee|platz|graben|ring|ufer|damm|laan|straat|gracht)\s\d{1,4}\s?[a-z]?(?![\p{L}\p{N}]|[.,:]?\d)(?:,\s\d{5}\s[\p{L}\-]+)?", regex.I),
    regex.compile(r"(?<![\p{L}])(?:p\.?\s?o\.?\s?box|post\s?office\s?box|postbox|postfach|apartado(?:\s(?:de\scorreos|postal))?|casella\spostale|caixa\spostal|boîte\spostale|b\.?p\.|skrytka\spocztowa|а/я|私書箱)\s?(?:no\.?\s?|nº\s?|n\.º\s?)?\d{1,7}", regex.I),
    regex.compile(r"[\p{Han}ヶケが々]{1,6}(?:都|道|府|県|市|区|町|村)[\p{Han}\p{Hiragana}\p{Katakana}ヶ々]{0,12}(?:\p{Nd}+|[一二三四五六七八九十]+)(?:丁目|番地|番|号|-\p{Nd}+)(?:[\p{Nd}\-−丁目番地号]*)?"),
    regex.compile(r"[\p{Han}]{2,8}(?:路|街|大道|巷)\p{Nd}+号"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:No|Nr|Num|Number)\.?\s?\d{{1,5}}[a-z]?,?\s(?:[\p{{L}}'’\-]+\s){{1,3}}(?:{'|'.join(sorted(STREET, key=len, reverse=True))})\b\.?", regex.I),
]
#: Every form of an address holds a digit or a Chinese or Japanese numeral.
NUMERAL = regex.compile(r"[\p{Nd}一二三四五六七八九十]")


_NUMBERS = regex.compile(r"\p{Nd}+")
_DATE = regex.compile(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d|(?:19|20)\d\d\s?[-–]\s?(?:19|20)?\d\d")


def chunks(text: str) -> list[tuple[int, int, str, str]]:
    return [(m.start(), m.end(), m.lastgroup or "p", m.group()) for m in CHUNK.finditer(text)]


def _digits(s: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in s if unicodedata.decimal(c, None) is not None)


def _shape(s: str) -> str:
    return "U" if s.isupper() and len(s) > 1 else "C" if s[0].isupper() else "l"


def _script(s: str) -> str:
    c = s[0]
    return "latin" if c < "Ͱ" else "cyr" if "Ѐ" <= c <= "ӿ" else "arab" if "؀" <= c <= "ۿ" else "hang" if "가" <= c <= "힯" else "other"


def _stem(s: str) -> str:
    """A word without possessive ending."""
    return s.lower().replace("’", "'").strip("-").removesuffix("'s").removesuffix("'")


def alike(a: str, b: str) -> bool:
    """Whether two words can be one family name: equal without case and possessive, one with an ending of at most 2 letters, or, if long, one edit apart."""
    a, b = sorted((_stem(a), _stem(b)), key=len)
    if a == b:
        return len(a) >= 3
    if len(b) - len(a) <= 2 and len(a) >= 5 and b.startswith(a):
        return True
    if len(a) < 6 or len(b) - len(a) > 1 or a[0] != b[0]:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Lattice:
    """Chunks of one text with features, allowed labels and evidence."""

    def __init__(self, text: str) -> None:
        self.items = items = chunks(text)
        n = self.n = len(items)
        self.low = low = [s.lower().replace("’", "'") for _, _, _, s in items]
        kinds = self.kinds = [k for _, _, k, _ in items]
        self.street = [0] * n
        starts_at: list[int] = []
        for f, form in enumerate(ADDRESS_FORMS if NUMERAL.search(text) else (), 1):
            for m in form.finditer(text):
                starts_at = starts_at or [x[0] for x in items]
                # Chunks that begin in the match, and the one before them if it ends in it.
                for i in range(max(0, bisect.bisect_left(starts_at, m.start()) - 1), bisect.bisect_left(starts_at, m.end())):
                    a, b = items[i][0], items[i][1]
                    if b > m.start() and (b <= m.end() + 1 or a >= m.start()):
                        self.street[i] = self.street[i] or f
        given = [kinds[i] == "w" and low[i] in GIVEN for i in range(n)]
        title = [kinds[i] == "w" and low[i] in TITLES for i in range(n)]
        cap = [kinds[i] == "w" and (items[i][3][0].isupper() or low[i][:3] in ("al-", "el-") and len(low[i]) > 5) for i in range(n)]
        single = [kinds[i] == "w" and len(items[i][3]) == 1 and i + 2 < n and items[i + 1][3] == "." and kinds[i + 2] == "w" and len(items[i + 2][3]) > 2 and items[i + 1][0] == items[i][1] for i in range(n)]
        initial = [single[i] and (cap[i] or i > 0 and (given[i - 1] or items[i - 1][3] in "|/\n" or self.announced(i))) for i in range(n)]
        self.allowed = [[NONE] for _ in range(n)]
        evident = [False] * n
        for i, k in enumerate(kinds):
            if k == "E":
                self.allowed[i].append(EMAIL)
            elif k in "NDA":
                self.allowed[i] += [PHONE, IDENT]
            elif k == "J":
                self.allowed[i].append(NAME)
            if self.street[i] and k not in "EUJ":
                self.allowed[i].append(ADDRESS)
            evident[i] = k in ("E", "N", "D", "A", "J") or bool(self.street[i])
        for i in range(n):
            j = i + 1
            starts = given[i] or initial[i] and (cap[i + 2] or not cap[i] or low[i + 2] in PARTICLES)
            if title[i]:
                if j < n and items[j][3] == ".":
                    j += 1
                starts = j < n and kinds[j] == "w" and (cap[j] or low[j] in PARTICLES or given[j] or self.announced(i) and low[i] not in ("sir", "miss", "don", "pan", "sig")) and (cap[i] or low[i] not in CAPITAL_TITLES)
            j = i + 1
            if not starts and cap[i] and j < n and cap[j] and (self.announced(i) or self.listed(i)) and len(low[i]) > 2 and _shape(items[i][3]) == _shape(items[j][3]) == "C" and low[i] not in _STOP and low[j] not in BUSINESS:
                starts = True
            if not starts and cap[i] and _script(items[i][3]) == "cyr" and j < n and cap[j]:
                starts = True
            if starts:
                for k in range(max(0, i - 4), min(n, i + 8)):
                    s = items[k][3]
                    if kinds[k] == "w" and (low[k] not in _STOP or title[k] or initial[k] or low[k] in PARTICLES) or s in ".," and (k <= i + 5):
                        if NAME not in self.allowed[k]:
                            self.allowed[k].append(NAME)
                        evident[k] = evident[k] or kinds[k] == "w" and (k >= i or cap[k])
        self.given, self.title, self.cap, self.initial = given, title, cap, initial
        self.evident = evident
        # In a text with a full name every capitalised lone word may be a family name: whether it is one, skip edges tell.
        full = any(evident[i] and NAME in self.allowed[i] and kinds[i] == "w" for i in range(n))
        self.repeat = [full and cap[i] and self.family(i) and not self.street[i] and self.lone(i) for i in range(n)]
        for i in range(n):
            if self.repeat[i] and NAME not in self.allowed[i]:
                self.allowed[i].append(NAME)

    def begins(self, i: int) -> bool:
        """Whether chunk i begins a sentence, where any word has a capital letter."""
        return i == 0 or self.ends(i - 1)

    def ends(self, k: int) -> bool:
        """Whether chunk k ends a sentence; the point of a title or an initial doesn't."""
        return self.items[k][3] in "!?…\n:" or self.items[k][3] == "." and not (k and (self.title[k - 1] or self.kinds[k - 1] == "w" and len(self.low[k - 1]) == 1))

    def lone(self, i: int) -> bool:
        """Whether chunk i has no given name, title or initial near it, and no capitalised neighbour but the first word of a sentence."""
        near = [j for j in range(max(0, i - 2), min(self.n, i + 3)) if j != i and not any(self.ends(k) for k in range(min(i, j) + 1, max(i, j)))]
        beside = [j for j in (i - 1, i + 1) if 0 <= j < self.n]
        if i + 1 < self.n and self.kinds[i + 1] == "w" and (self.low[i + 1] in STREET or self.low[i + 1] in BUSINESS):
            return False
        return not any(self.given[j] or self.title[j] or self.initial[j] for j in near) and not any(self.cap[j] and self.low[j] not in _STOP and not self.begins(j) for j in beside)

    def family(self, i: int) -> bool:
        """Whether chunk i can be a family name by itself."""
        w = self.low[i]
        return self.kinds[i] == "w" and len(w) >= 3 and not (self.given[i] or self.title[i] or self.initial[i] or w in PARTICLES or w in _STOP or w in BUSINESS or w in STREET)

    def announced(self, i: int) -> bool:
        """Whether the words before chunk i announce a name."""
        if i > 1 and self.low[i - 1] in ",:":
            i -= 1
        return i > 0 and (self.low[i - 1] in NAME_CUES or i > 1 and (self.low[i - 2], self.low[i - 1]) in NAME_CUE_PAIRS)

    def listed(self, i: int) -> bool:
        """Whether two words from chunk i on head a list with an address, number or code."""
        k = i + 2
        return k + 1 < self.n and self.items[k][3] in "|/,;\n" and (self.kinds[k + 1] in "EDAN" or bool(self.street[k + 1])) and (i == 0 or self.items[i - 1][3] in ".!?\n|/")

    def active(self) -> list[int]:
        return [i for i in range(self.n) if len(self.allowed[i]) > 1]

    def features(self, i: int) -> list[str]:
        items, low, kinds = self.items, self.low, self.kinds
        k, s = kinds[i], items[i][3]
        f = ["b", "k=" + k]
        before = [low[j] for j in range(max(0, i - 4), i) if kinds[j] == "w"]
        after = [low[j] for j in range(i + 1, min(self.n, i + 3)) if kinds[j] == "w"]
        if self.street[i]:
            f += ["street", f"street{self.street[i]}", "street:" + k]
        if k in "NDA":
            digits = _digits(s)
            f += [f"nd={min(len(digits), 16)}:{k}", "pat=" + "-".join(str(len(x)) for x in _NUMBERS.findall(s)) + ":" + k]
            if s[0] in "+＋" or digits[:2] == "00" and digits[2:3] != "" and s[:4].isdigit():
                f.append("plus:" + k)
            if s[0] == "(" or "(" in s:
                f.append("paren")
            if _DATE.fullmatch(s):
                f.append("date")
            if "555" in digits or digits[:5] == "07700":
                f.append("fiction")
            if k == "A":
                f.append("code=" + regex.sub(r"\d+", "9", regex.sub(r"[A-Za-z]", "a", s)))
            near = before[-4:]
            for name, cues in (("phone", PHONE_CUES), ("id", ID_CUES), ("no", NO_CUES)):
                if any(w in cues for w in near[-2:]):
                    f.append("cue2:" + name)
                elif any(w in cues for w in near):
                    f.append("cue4:" + name)
            if any(c in "".join(x[3] for x in items[max(0, i - 4) : i]) for c in "電話携帯"):
                f.append("cue2:phone")
            if i and items[i - 1][3] in "$€£#":
                f.append("sign")
            if after and after[0] in ("calories", "grams", "euros", "dollars", "people", "euro", "usd", "kcal"):
                f.append("unit")
            f.append("list" if i and items[i - 1][3] in "|/;," else "nolist")
        elif k in ("w", "J", "p"):
            f.append("low=" + low[i] if k == "p" else "sh=" + _shape(s) + _script(s))
            if k != "p":
                f += [n for n, yes in (("given", self.given[i]), ("title", self.title[i]), ("init", self.initial[i]), ("particle", low[i] in PARTICLES), ("business", low[i] in BUSINESS), ("stop", low[i] in _STOP), ("streetword", low[i] in STREET)) if yes]
            near = [j for j in range(i - 3, i + 4) if 0 <= j < self.n and j != i]
            for j in near:
                d = j - i
                tag = "G" if self.given[j] else "T" if self.title[j] else "I" if self.initial[j] else "B" if low[j] in BUSINESS and kinds[j] == "w" else "P" if low[j] in PARTICLES else "S" if low[j] in _STOP else "C" if self.cap[j] else items[j][3] if kinds[j] == "p" else kinds[j]
                if abs(d) <= 2 or tag in "GTI":
                    f.append(f"{d}:{tag}")
                if d == -1 and kinds[j] == "w":
                    f.append("cue:" + ("name" if self.announced(i) else "no"))
                if abs(d) == 1:
                    f.append(f"{d}:{tag}:{_shape(s) if k != 'p' else s}")
        return f

    def skips(self, active: list[int]) -> list[tuple[int, int]]:
        """Pairs of equal or similar chunks, each joined with the last one like it: family names (by `alike`; a given name again is no case, so it has no edge), numbers and addresses of e-mail."""
        last: dict[str, int] = {}
        out = []
        for i in active:
            if self.kinds[i] in ("p", "d") or len(self.low[i]) < 3 or self.low[i] in _STOP or self.low[i] in STREET:
                continue
            key = _digits(self.low[i]) if self.kinds[i] in "DA" else self.low[i].strip("'-")
            if self.kinds[i] == "w" and not self.family(i):
                continue
            if key not in last and self.kinds[i] == "w":
                key = next((x for x in last if self.kinds[last[x]] == "w" and alike(x, key)), key)
            if key in last and i - last[key] > 1:
                out.append((last[key], i))
            last[key] = i
        return out


#: Frequent words that are never part of a name here.
_STOP = frozenset(
    """the a an and or but if so of to in on at for from with without by as is are was were be been do does did have has had not no we us our you your he she it its they them their i me my
    this that these those there here what which who when where how then than just only very too also even after before while because about over again once some any all told ask thanks thank signed said
    think told everyone mention review found found keys person complained addressed bill reservation under table window got refund shouted allergy delight call mail write reply under name up card
    por para con el los las y en que nos atendió hat uns bedient fomos atendidos ci ha serviti merci pour son accueil pas les des et der die das und mit""".split()
)


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted({regex.escape(w, literal_spaces=True) for w in words}, key=len, reverse=True))


_STREETS = _any(STREET | {"rue", "allée", "impasse", "chemin", "quai", "route"})
#: A text that fits none of these has no evidence, whatever else it holds: superset tests, linear passes of the columnar engine over a batch.
GATES = (
    # a number of 5 digits or more with signs between them, or a code
    r"\p{Nd}(?:[^\p{L}\p{Nd}]*\p{Nd}){4}|\p{L}-?\d(?:[\d\p{L}-]*\d){4}|[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}",
    # a number before or behind the words of an address
    rf"\p{{Nd}}[^\s]{{0,8}}\s(?:[^\s]+\s){{1,6}}(?:{_STREETS})(?:[^\p{{L}}]|$)|\p{{Nd}}[^\s]{{0,8}}\s(?:rue|avenue|boulevard|allée|impasse|chemin|place|quai|route)\s",
    r"(?:^|[^\p{L}])(?:calle|c/|avenida|avda|plaza|paseo|rua|r\.|travessa|rue|avenue|allée|impasse|chemin|via|viale|piazza|corso|vicolo|ulica|ul\.|aleja)[^\p{Nd}]*\p{Nd}",
    r"(?:straße|strasse|str\.?|weg|gasse|allee|platz|graben|ring|ufer|damm|laan|straat|gracht)\s\p{Nd}|(?:box|postfach|apartado|postale?|b\.?p\.|skrytka\spocztowa|а/я|私書箱)[^\p{Nd}]*\p{Nd}",
    # e-mail addresses, digits in words, other scripts, initials
    rf"[@＠]|(?:at|arroba)\s?[)\]}}>]|\s(?:at|arroba)\s[^\s]*(?:\s[^\s]*){{0,8}}(?:\s(?:dot|punto|punkt)\s|\.(?:com|net|org|edu|example|test|invalid|de|fr|es|it|pt|pl|uk|jp))|(?:{DIGIT_WORDS})[\s,\-]+(?:{DIGIT_WORDS})[\s,\-]+(?:{DIGIT_WORDS})[\s,\-]|[\p{{Cyrillic}}\p{{Arabic}}\p{{Hangul}}\p{{Han}}]|(?:^|[^\p{{L}}])\p{{L}}\.\s?\p{{L}}",
    # given names and titles (some of them only with a capital letter), words that announce a name with a capital letter behind them
    rf"(?:^|[^\p{{L}}])(?:{_any(GIVEN | TITLES - CAPITAL_TITLES)}|(?-i:{_any(x for t in CAPITAL_TITLES for x in (t.capitalize(), t.upper()))}))(?:[^\p{{L}}]|$)",
    rf"(?:^|[^\p{{L}}])(?:{_any(NAME_CUES)}|(?:{'|'.join(a + '[^a-z]+' + b for a, b in sorted(NAME_CUE_PAIRS))}))[^\p{{L}}]+(?-i:\p{{Lu}}|al-|el-)",
)


def evident(texts: pa.Array) -> list[bool]:
    """Whether each text may hold personal information; false only for texts without any evidence. Null counts as false."""
    out = pc.match_substring_regex(texts, GATES[0], ignore_case=True)
    for gate in GATES[1:]:
        out = pc.or_(out, pc.match_substring_regex(texts, gate, ignore_case=True))
    return pc.fill_null(out, False).to_pylist()


def soft(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Field:
    """Weights of the field: node features by label, transitions, and one agreement weight for each label on skip edges."""

    def __init__(self, index: dict[str, int], node: np.ndarray, pair: np.ndarray, skip: np.ndarray) -> None:
        self.index, self.node, self.pair, self.skip = index, node, pair, skip

    def scores(self, lat: Lattice, active: list[int]) -> np.ndarray:
        out = np.full((len(active), 6), -1e4)
        for r, i in enumerate(active):
            at = [self.index[f] for f in lat.features(i) if f in self.index]
            s = self.node[at].sum(axis=0) if at else np.zeros(6)
            for y in lat.allowed[i]:
                out[r, y] = s[y]
        return out

    def marginals(self, lat: Lattice, rounds: int = 4) -> tuple[list[int], np.ndarray]:
        """Active chunks and their label marginals by (loopy) belief propagation."""
        active = lat.active()
        if not active:
            return active, np.zeros((0, 6))
        node = self.scores(lat, active)
        n = len(active)
        place = {i: r for r, i in enumerate(active)}
        edges = [(place[a], place[b]) for a, b in lat.skips(active)]
        joined = [active[r + 1] == active[r] + 1 for r in range(n - 1)]
        # A chunk next to an inactive one has a neighbour of label none.
        for r, i in enumerate(active):
            if r == 0 or not joined[r - 1]:
                node[r] += self.pair[NONE]
            if r == n - 1 or not joined[r]:
                node[r] += self.pair[:, NONE]
        agree = np.diag(self.skip)
        to_b = np.zeros((len(edges), 6))
        to_a = np.zeros((len(edges), 6))
        for _ in range(rounds if edges else 1):
            total = node.copy()
            for e, (a, b) in enumerate(edges):
                total[a] += to_a[e]
                total[b] += to_b[e]
            left, right = np.zeros((n, 6)), np.zeros((n, 6))
            for r in range(1, n):
                if joined[r - 1]:
                    m = log_sum(self.pair + (total[r - 1] + left[r - 1])[:, None], 0)
                    left[r] = m - m.max()
            for r in range(n - 2, -1, -1):
                if joined[r]:
                    m = log_sum(self.pair + (total[r + 1] + right[r + 1])[None, :], 1)
                    right[r] = m - m.max()
            belief = total + left + right
            for e, (a, b) in enumerate(edges):
                m = log_sum(agree + (belief[a] - to_a[e])[:, None], 0)
                to_b[e] = m - m.max()
                m = log_sum(agree + (belief[b] - to_b[e])[:, None], 0)
                to_a[e] = m - m.max()
        return active, soft(belief)

    def entities(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of every entity of a text, in order."""
        lat = Lattice(text)
        if not any(lat.evident):
            return []
        active, p = self.marginals(lat)
        runs: list[list[int]] = []
        for i, y in zip(active, np.where(p[:, NAME] >= NAME_CUTOFF, NAME, p.argmax(axis=1))):
            if y == NONE:
                continue
            if runs and runs[-1][1] == i - 1 and runs[-1][2] == y and y in (ADDRESS, NAME):
                runs[-1][1] = i
            else:
                runs.append([i, i, int(y)])
        out, families, lone = [], set(), []
        for a, b, y in runs:
            if y == NAME:
                while b > a and lat.kinds[b] == "p":
                    b -= 1
                while a < b and lat.kinds[a] == "p":
                    a += 1
                words = [i for i in range(a, b + 1) if lat.kinds[i] == "w" and lat.low[i] not in PARTICLES]
                # A word before a given name that a family name follows, and a first word of a sentence before a lone name, aren't part of it.
                sure = lambda i: lat.given[i] or lat.title[i] or lat.initial[i]
                if len(words) > 2 and not sure(words[0]) and sure(words[1]) and lat.family(words[2]):
                    words = words[1:]
                    a = words[0]
                if len(words) > 1 and lat.begins(words[0]) and all(lat.repeat[i] for i in words[1:]):
                    words = words[1:]
                if words and all(lat.repeat[i] for i in words):
                    lone += words
                    continue
                whole = any(lat.kinds[i] == "J" for i in range(a, b + 1)) or len(words) >= 2 and not all(lat.given[i] or lat.title[i] or lat.initial[i] for i in words) or len(words) >= 2 and sum(lat.given[i] for i in words) >= 2
                if not whole:
                    continue
                families |= {lat.low[i] for i in words if lat.family(i)}
            if y == ADDRESS and not any(lat.kinds[i] in "dDA" for i in range(a, b + 1)):
                continue
            out.append((lat.items[a][0], lat.items[b][1], y))
        # A family name alone counts only if the text gives it in full elsewhere.
        out += [(lat.items[i][0], lat.items[i][1], NAME) for i in lone if any(alike(lat.low[i], x) for x in families)]
        return sorted(out)


# Sentences for training, made by rule.

_SYLLABLES = "bar ten dor vel mi ra nok stein ford ley ka shi mo ve gu lan de ro qu el win ber ta sko ru zo pin hal ster wick mar chi ola nwe".split()
_TOWNS = [*"Northwick Elmsford Karlby Montreux Sandvale Oldbrook Westmere".split(), "Port Hale", "Lower Marden", "East Bridgeton", "Marble Heights"]
#: Sentences are written for this module; gaps: N a full name, M its family name alone (or with its ending changed), H its given name, P phone, E e-mail, I number, A address, L family name, G given name, S street, B business, T town, C a capitalised word that is no name, D digits.
_POSITIVE = [
    # persons
    "I wrote a long letter to {N} last spring.", "We owe a lot to {N}, whose advice was sound.", "The parcel for {N} arrived damaged.", "According to {N} the shop will move.", "{N} runs the place with her brother.", "Yesterday {N} explained the rules to us.", "Kind regards, {N}", "Yours sincerely, {N}", "My neighbour {N} recommended it.", "The man at the counter, {N} by his badge, was rude.",
    "Our guide {N} knew every street.", "Please ask for {N} when you get there.", "You should talk to {N} about prices.", "I am {N} and I come here often.", "She said her name was {N}.", "The desk is kept by {N} on weekdays.", "I would like to thank {N} for the cake.", "Served by {N}, who smiled all evening.", "a table booked under {N} for eight", "Der Kellner {N} war sehr nett.", "Ich habe mit {N} gesprochen.", "Gracias a {N} por todo.", "Hablé con {N} por teléfono.",
    "Nous avons rencontré {N} hier soir.", "Le patron, {N}, est charmant.", "Abbiamo parlato con {N} ieri.", "Il proprietario {N} ci ha aiutato.", "Falei com {N} ontem.", "O gerente {N} resolveu tudo.", "{N}", "{N}.", "It was {N} who paid.", "Best, {N}\nThe bread was stale.", "Written by {N} The tea was cold.", "{N}\nWe had a good time.",
    # numbers, addresses and lists
    "Give me a ring on {P} if you find my umbrella.", "Text {P} for a table.", "The line {P} is always busy.", "He left {P} as his mobile number.", "Dial {P} and wait.", "Meine Nummer ist {P}.", "Mein Handy: {P}", "Mi teléfono es {P}.", "Mon portable est le {P}.", "Il mio cellulare: {P}", "O meu telefone é {P}.", "After noon I answer at {P}.", "fax {P}", "{P}", "Phone: {P}",
    "Mail it to {E} by Friday.", "My address for letters is {E}.", "Contact {E} for the pictures.", "questions? {E}", "Schreib an {E}.", "Escríbeme a {E}.", "Écrivez à {E}.", "Scrivete a {E}.", "({E})", "{E}",
    "The clerk copied my {I} by hand.", "My {I} was printed on the bill.", "They asked for {I} at the door.", "I had to show {I} to get in.", "a lost card, {I}, lies at the bar", "Meine Nummer lautet {I}.", "Mi número es {I}.", "Mon numéro : {I}.", "{I}",
    "Our flat at {A} is close by.", "Bring it to {A} before nine.", "The courier went to {A} instead.", "I moved to {A} in May.", "We walked home to {A} after dinner.", "Ich wohne in {A}.", "Vivo en {A}.", "J'habite {A}.", "Abito in {A}.", "Moro na {A}.", "{A}", "Ship to: {A}",
    "{N} says that the cook left.", "In the morning {N} shouted across the room.", "{N} promised us a refund and kept the promise.", "{N} knows all the guests.", "The bread was warm. {N} / {P} / {E}", "It rained. {N} / {A}", "A fine evening. {N}, {A}, {E}, {I}", "Good soup. {N}, {I}, {P}", "{N} | {A}", "{N}\n{I}\nIt was fine.", "{N}\n{A}\n{P}", "The sauce was thin. {N}, {E} We paid and left.", "{N}, {I} They close early.",
    "{N}\n{P}", "{N}\n{E}\n{A}", "{N}, {P}", "{N} / {I}", "{N} | {P} | {E}", "{N}, {A}, {I}", "We will be back. {N}, {E}", "Nothing more to say. {N}\n{I}", "{L}, {G}, {P}", "{L}, {G}, {A}", "Write to: {E} {N}", "番号は{P}です。", "宛先は{E}。", "住所は{A}です。", "担当者は{N}でした。",
    # the family name again, alone
    "{N} opened the door. Later {M} brought the bill.", "We asked {N} twice, but {M} did not answer.", "The owner is {N}. When it was late {M} closed up, and {M} was tired.", "I met {N} in {T}. The food was fine. In the end {M} drove us home.", "Dr. {L} came first and then {M} left.", "{N} cooks here. On {C} {M} makes bread. The {C} soup is good.", "Thank you, {N}! Everyone praised {M} that night.", "Wir sprachen mit {N}. Dann ging {M} nach Hause.", "Nous avons vu {N}. Ensuite {M} est parti.", "{N} and I talked. {H} was calm, {M} was not.", "{N} came in. Then {M} sat down with {H}.", "They called {N}. At nine {M} came with {H} and {G}.",
]
_NEGATIVE = [
    "{G} opened the door for us.", "Hugs from {G}", "My cousin {G} loved the cake.", "With {G} and {G2} we were four.", "Happy birthday, {G}!", "{G} waved. Then {H} paid and {H} left.", "I saw {G} on {C}. The {C} place was shut, and {H} went to {T}.", "{N} opened the door. The {C} bread was warm, and {C} beer was served on {C}.", "We asked {N} about {C} food. {C} is better than {C}.", "Dr. {L} liked the {C} salad. Then {C} came and {T} was far.", "{N} said hello. {H} was kind. {H} brought {C} tea.",
    "The shop lies on {S}, next to the bank.", "Turn left into {S} and walk on.", "{S} is noisy at night.", "The bus stops at {S}.", "Ticket {D2}-{D4}-{D1} was not valid.", "My voucher {D7} had expired.", "Booking {D5}, gate {D2}.", "Posted by @tiny.heron last week.", "More at www.night-kitchen.example today.", "Breakfast 07:00-10:30, dinner 18:00-23:00.",
    "On 2019-03-08 we came back.", "Closed from 01.08. to 21.08. each year.", "About 800-900 kcal in a bowl.", "Rated 3.5/5 on 12/04/2022.", "A bottle of 2015, batch {D3}-{D3}.", "The bill was 1.480,50 for all of us.", "That makes $37 for two.", "Use SUMMER2023 for a discount.", "Room {D2}, second floor, built in 1964.", "Page {D3} of the menu.",
    "{D22} on the box.", "Next to {B} there is a park.", "{B} has better coffee.", "I prefer {B} on Sundays.", "The buses to {T} and {T} are slow.", "From {T} it takes an hour.", "I drank a tom collins and an arnold palmer.", "A caesar salad and a bloody mary, please.", "We met at 7 and left at 10.", "Forty guests, six tables, one oven.", "Please ask for the bill.", "Thanks to the whole team.", "The model {D5} broke.", "They called number 31 before 29.",
    "Two of us shared five plates.", "Dear {B}, well done.", "St Martin's Day was quiet.", "Dr Pepper is on the list.", "Ms Pacman stands in the corner.", "We would miss this place.", "I miss the old sir of the house.", "They would miss you and you would miss them.", "Sunday lunch, nothing more, nothing less.", "The parcel went to {A} by van.", "The {C} and the {C} were full.", "{C} evenings at {B} are loud.",
]
#: Capitalised words that are no names of persons.
_CAPITALISED = "Monday Friday Sunday April August Christmas Easter Italian Mexican Korean French Greek Turkish English Spanish Guinness Heineken Nutella Internet Sushi Ramen Pizza Espresso Chardonnay Champagne Parmesan Cheddar Chef Manager Later Everything Nothing Again Service".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.names = sorted(GIVEN)

    def surname(self) -> str:
        s = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((2, 2, 3, 3, 4)))).capitalize()
        x = self.r.random()
        return "O'" + s if x < 0.05 else "van der " + s if x < 0.1 else "al-" + s if x < 0.15 else s + "-" + self.r.choice(("Dale", "Moor")) if x < 0.2 else s

    def given(self) -> str:
        return self.r.choice(self.names).capitalize()

    def case(self, s: str, lower: float = 0.24) -> str:
        x = self.r.random()
        return s.lower() if x < lower else s.upper() if x < lower + 0.08 else s

    def name(self) -> str:
        r, g, s = self.r, self.given(), self.surname()
        forms = [f"{g} {s}"] * 5 + [f"{g} {r.choice('ABCDEFGHIJKLMRST')}. {s}", f"{r.choice('ABCDEFGHIJKLMRST')}. {s}"] * 2 + [f"{r.choice(('Mr', 'Mrs.', 'Ms.', 'Dr.', 'Herr', 'Frau', 'Prof.', 'Mr.', 'Dr.'))} {s}", f"{s}, {g}"] * 4 + [f"{s} {g}", "高森 由利子", "김하늘", "Иванова Мария", "محمد الحسن"]
        return r.choice(forms)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, r = self.digits, self.r
        words = DIGIT_WORDS.split("|")
        return r.choice(
            [f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"1{d(3)}555{d(4)}", f"555-{d(4)}", f"+44 7700 900{d(3)}", f"07700 900 {d(3)}", f"07700 900{d(3)}", f"0044 (0)7700 900-{d(3)}", f"+49 30 {d(5)} {d(3)}", f"030/{d(5)}-{d(3)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"０７７００ ９００{d(3)}", "5 5 5 - 0 1 " + " ".join(d(2)), ", ".join([" ".join(r.choice(words) for _ in range(3)), " ".join(r.choice(words) for _ in range(4))]), f"+1.{d(3)}.555.{d(4)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}"]
        )

    def email(self) -> str:
        r = self.r
        u = r.choice((self.given().lower() + "." + self.surname().lower().replace(" ", ""), self.given().lower() + self.digits(2), self.surname().lower().replace(" ", "") + "+food"))
        host = r.choice(("example.org", "mailbox.example", "home.invalid", "post.test", "mx.inbox.example"))
        at = r.choice(("@",) * 4 + ("＠", " [at] ", " (at) ", "(@)", " @ "))
        if r.random() < 0.2:
            return u.replace("+", "") + " at " + host.replace(".", " dot ")
        return u + at + (host.replace(".", "(.)") if at == "(@)" else host)

    def ident(self) -> str:
        d, r = self.digits, self.r
        return r.choice(
            [f"SSN 9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"social security number {d(3)}-{d(2)}-{d(4)}", f"passport X{d(8)}", f"passport no. ZZ-{d(6)}", f"X{d(8)}", f"ZZ-{d(6)}", f"driver's licence D{d(4)}-{d(4)}-{d(2)}", f"D{d(4)}-{d(4)}-{d(2)}", f"DNI {d(8)}-K", f"{d(8)}-K", f"National Insurance QQ{d(6)}A", f"QQ {d(2)} {d(2)} {d(2)} C", f"tax ID 00 {d(3)} {d(3)} {d(3)}", f"00 {d(3)} {d(3)} {d(3)}", f"L{d(2)}T{d(5)}", f"NIF {d(9)}", f"passport {d(9)}"]
        )

    def street(self) -> str:
        r = self.r
        return f"{self.surname().split()[-1].replace(chr(39), '')} {r.choice(('Street', 'Road', 'Rd', 'Lane', 'Avenue', 'Ave', 'Way', 'Place', 'Court', 'Crescent', 'Terrace', 'Blvd', 'Drive'))}"

    def address(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randrange(1, 9999))
        s = self.street()
        return r.choice(
            [f"{n} {s}", f"{n} {s}, {r.choice(_TOWNS)}", f"{n} {r.choice('NSEW')} {s}", f"{n} South {s}, {r.choice(_TOWNS)}", f"{n} {s}, Unit {d(1)}B", f"{n} {s}, Apt 3, {r.choice(_TOWNS)} {d(5)}", f"No. {d(2)}, {s}", f"{n}-{d(1)} {s}", f"P.O. Box {d(4)}", f"P.O. Box {d(2)}, {r.choice(_TOWNS)}", f"Calle Mayor {d(2)}, 2ºB", f"Rua das Flores {d(3)}, 3.º esq.", f"{d(2)} rue des Lilas, {d(5)} Montreux", f"Lindenstr. {d(2)}", f"Birkenweg {d(1)}, {d(5)} Karlby", f"via dei Pini {d(2)}", f"Postfach {d(4)}"]
        )

    def business(self) -> str:
        r = self.r
        a, b = r.choice(("Hungry", "Silver", "Little", "Blue Door", "Dusty", "Amber")), r.choice(("Otter", "Basil", "Heron", "Kettle", "Olive", "Plum"))
        return r.choice((f"{a} {b}", f"{b} & {r.choice(('Elk', 'Fig', 'Moth'))}", f"{a} {b} {r.choice(('Diner', 'Cafe', 'Grill', 'Bakery', 'Tea Room'))}"))

    def again(self, full: str, given: bool) -> str:
        """The family name (or the given name) of a full name, as texts repeat it."""
        words = [w for w in regex.findall(r"[\p{L}'’\-]+", full) if len(w) > 1 and w.lower() not in TITLES and w.lower() not in PARTICLES]
        own = [w for w in words if w.lower() in GIVEN]
        if given:
            return own[0] if own else self.given()
        family = [w for w in words if w.lower() not in GIVEN] or words or [full]
        s = family[-1]
        x = self.r.random()
        return s.capitalize() if x < 0.6 else s.capitalize() + "'s" if x < 0.75 else s.upper() if x < 0.85 else s.capitalize() + "s" if x < 0.93 else s.capitalize()[:-1] + self.r.choice("aeiouy")

    def sentence(self) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        template = r.choice(_POSITIVE if r.random() < 0.62 else _NEGATIVE)
        text, spans = "", []
        held = ""
        for part in regex.split(r"(\{\w+\})", template):
            if not part.startswith("{"):
                x = r.random()
                text += part if x < 0.86 else part.lower() if x < 0.96 else part.upper()
                continue
            key, kind = part[1:-1], NONE
            if key == "N":
                s, kind = (self.case(self.name(), 0.36) if "{M}" not in template and "{H}" not in template else f"{self.given()} {self.surname()}"), NAME
                held = s
            elif key == "M":
                s, kind = self.again(held, False), NAME
            elif key == "H":
                s = self.again(held, True)
            elif key == "C":
                s = r.choice(_CAPITALISED)
            elif key == "P":
                s, kind = self.phone(), PHONE
            elif key == "E":
                s, kind = self.case(self.email()), EMAIL
            elif key == "I":
                s, kind = self.ident(), IDENT
            elif key == "A":
                s, kind = (self.address() if r.random() < 0.85 else self.address().lower()), ADDRESS
            elif key == "L":
                s, kind = self.surname(), NAME
                held = s
            elif key[0] == "G":
                s = self.case(self.given(), 0.12)
                held = s
                kind = NAME if template.startswith("{L}") else NONE
            elif key == "S":
                s = self.street()
            elif key[0] == "B":
                s = self.case(self.business())
            elif key == "T":
                s = r.choice(_TOWNS)
            else:
                s = self.digits(int(key[1:]))
            if kind != NONE:
                spans.append((len(text), len(text) + len(s), kind))
            text += s
        return text, spans


def gold(lat: Lattice, spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each chunk for known spans; of an id's words before its digits, none."""
    out = []
    for i, (a, b, k, s) in enumerate(lat.items):
        y = next((kind for x, z, kind in spans if a < z and b > x), NONE)
        out.append(y if y in lat.allowed[i] else NONE)
    return out


@functools.lru_cache(maxsize=4)
def train(sentences: int = 14000, seed: int = 7, rounds: int = 250, rate: float = 0.6, decay: float = 2e-4) -> Field:
    """Fit by composite likelihood: every chunk alone, and given its true neighbours on chain and skip edges.

    The first half keeps the node weights strong enough to start an entity without labelled neighbours. Deterministic, and so kept for the process.
    """
    maker = _Maker(seed)
    index: dict[str, int] = {}
    rows, cols, labels, lefts, rights, skips, masks = [], [], [], [], [], [], []
    known: dict[tuple, int] = {}
    weights: list[float] = []
    for _ in range(sentences):
        parts = [maker.sentence() for _ in range(maker.r.choice((1, 1, 2)))]
        text, spans = "", []
        for t, sp in parts:
            text += " " * bool(text)
            spans += [(a + len(text), b + len(text), k) for a, b, k in sp]
            text += t
        lat = Lattice(text)
        y = gold(lat, spans)
        active = lat.active()
        partner: dict[int, list[int]] = {}
        for a, b in lat.skips(active):
            partner.setdefault(a, []).append(b)
            partner.setdefault(b, []).append(a)
        for i in active:
            at = tuple(index.setdefault(f, len(index)) for f in lat.features(i))
            left, right = (y[i - 1] if i else NONE), (y[i + 1] if i + 1 < lat.n else NONE)
            near = tuple(sorted(y[j] for j in partner.get(i, [])))
            # Equal cases are kept once, with their number as weight.
            key = (at, y[i], left, right, near, tuple(lat.allowed[i]))
            if key in known:
                weights[known[key]] += 1
                continue
            r = known[key] = len(labels)
            weights.append(1.0)
            rows += [r] * len(at)
            cols += at
            labels.append(y[i])
            lefts.append(left)
            rights.append(right)
            skips.append(np.bincount(near, minlength=6) if near else np.zeros(6))
            m = np.full(6, -1e4)
            m[lat.allowed[i]] = 0
            masks.append(m)
    R, C = np.array(rows), np.array(cols)
    Y, Lf, Rt, K, M = np.array(labels), np.array(lefts), np.array(rights), np.array(skips, dtype=float), np.array(masks)
    n, d = len(Y), len(index)
    share = (np.array(weights) / sum(weights))[:, None]
    node, pair, skip = np.zeros((d, 6)), np.zeros((6, 6)), np.zeros(6)
    gn, gp, gs = np.full((d, 6), 1e-3), np.full((6, 6), 1e-3), np.full(6, 1e-3)
    truth = np.eye(6)[Y]
    for _ in range(rounds):
        alone = M.copy()
        for y in range(6):
            alone[:, y] += np.bincount(R, weights=node[C, y], minlength=n)
        e, e2 = ((truth - p) * share for p in (soft(alone), soft(alone + pair[Lf] + pair[:, Rt].T + K * skip)))
        g = np.stack([np.bincount(C, weights=(e + e2)[R, y], minlength=d) for y in range(6)], axis=1) - decay * node
        h = np.zeros((6, 6))
        np.add.at(h, Lf, e2)
        np.add.at(h.T, Rt, e2)
        h -= decay * pair
        k = (e2 * K).sum(axis=0) - decay * skip
        for w, grad, acc in ((node, g, gn), (pair, h, gp), (skip, k, gs)):
            acc += grad * grad
            w += rate * grad / np.sqrt(acc)
    return Field(index, node, pair, np.clip(skip, 0, MOST_AGREEMENT))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with a typed placeholder in place of each entity."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def review_texts(examples: DataFrame) -> DataFrame:
    """idx, item_pos, source, text of every review text; item_pos 0 is the target, 1, 2, ... the place in history."""
    target = F.struct(F.lit(0).cast("bigint").alias("item_pos"), F.col("target_item.target_review_text").alias("text"))
    history = F.transform("history", lambda h, i: F.struct((i + 1).cast("bigint").alias("item_pos"), h.review_text.alias("text")))
    both = F.concat(F.array(target), F.coalesce(history, F.array().cast("array<struct<item_pos:bigint,text:string>>")))
    return examples.select("idx", "source", F.inline(F.filter(both, lambda x: x.text.isNotNull())))


def scan(texts: DataFrame, keep: list[str], text: str = "text", model: Field | None = None) -> DataFrame:
    """keep, kinds (array of the kinds found) and redacted text; one row for each row, no shuffle."""
    m = model or train()
    shared = texts.sparkSession.sparkContext.broadcast((m.index, m.node, m.pair, m.skip))
    n = len(keep)
    schema = texts.select(*keep).withColumns({"kinds": F.expr("cast(null as array<string>)"), "redacted": F.lit(None).cast("string")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None
        for batch in batches:
            field = field or Field(*shared.value)
            kinds, out = [], []
            for t, maybe in zip(batch.column(n), evident(batch.column(n))):
                s = t.as_py()
                spans = field.entities(s) if maybe else []
                kinds.append(sorted({KINDS[k] for _, _, k in spans}))
                out.append(redact(s, spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], names=schema.names)

    return spread(texts.select(*keep, text)).mapInArrow(run, schema)


def found(examples: DataFrame) -> DataFrame:
    """idx, item_pos and each kind found in that review."""
    df = scan(review_texts(examples), ["idx", "item_pos"])
    return df.select("idx", "item_pos", F.explode("kinds").alias("kind")).distinct()
