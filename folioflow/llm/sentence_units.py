"""Problem 4: sentence boundaries across languages and scripts.

Segmentation rules are (break or not, pattern before, pattern after), kept in tables per language, per script and a
default, and cascaded in this order: of a language in Latin letters its own table comes first if at least two of its
function words stand in the text and no other language has as many. At each place that could end a
sentence the first rule whose two patterns match decides; both patterns see the whole text. Quotations and brackets are
paired first, within a paragraph: a place inside a pair is never a boundary, and a pair that opened inside a sentence ends
it only if what follows starts anew.

A null, empty or blank text has no unit and no boundary; a text without a boundary is one unit. p4_found has
only texts without a line break, as its definition says; p4_row_units divides every row of originalText. There a line break
is white space, since printed sentences run on over it (a formula on its own line stays in its sentence); a standing line
(problem 2) is a unit of its own and what stands around it is read as one. Running heads and page numbers inside a
sentence stay in it: taking them out is problem 3. Rows whose text was decoded wrongly give no boundary. Redelivered rows
count once.

Scale: p4_found has no shuffle but the final distinct of the found places; rows that hold no place at all are dropped by a
JVM filter before Python sees them. p4_row_units shuffles the rows once by id, to meet their standing lines.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache, reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.tables import table

# Marks, abbreviations and month names by language group.
END = ".!?…。！？؟۔।॥｡።፧፨։။។៕"
CLOSERS = "”»’\"')]）】」』›"
OPENERS = "“«„‘\"'(（[【「『‹¿¡»"
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "„": "“”", "“": "”", "«": "»", "»": "«", "‹": "›", '"': '"'}
TITLES = r"Dr|Dra|Prof|Profs|Mr|Mrs|Ms|St|Ste|Sr|Sra|Srta|Hr|Fr|Mme|Mlle|MM|Mgr|Gen|Col|Lt|Sgt|Rev|Hon|Messrs|Ing|Dipl|Lic|Jr|Dres|Eng|Exmo|Drs"
BEFORE_NUMBER = r"[Nn]o|[Nn]os|[Nn]r|[Nn]rn|[Nn]úm|[Nn]|[Vv]ol|[Vv]ols|[Pp]p|[Pp]|[Pp]gs?|[Pp]ág|[Pp]ágs|[Ff]igs?|[Ss]ec|[Ss]ecs|[Ss]ect|[Ss]ez|[Ee]qs?|[Rr]efs?|[Rr]ev|[Cc]h|[Cc]hap|[Cc]ap|[Tt]ab|[Aa]bb|[Aa]bs|[Aa]nm|[Bb]d|[Ss]|[Aa]rt|[Kk]ap|[Ss]p|[Tt]h|[Ll]em|[Aa]pp|[Aa]lgs?|NO|VOL|PP|FIG|SEC|NR|S|PÁG|ABB"
ALWAYS = r"vs|ca|cf|approx|aprox|aprx|env|viz|resp|incl|excl|esp|al\.?,|e\.g|i\.e|e\. ?g|i\. ?e|z\. ?B|d\. ?h|u\. ?a|o\. ?ä|s\. ?o|s\. ?u|bzw|vgl|sog|evtl|ggf|inkl|zzgl|bspw|p\. ?ex|c\.-à-d|c\. à d|c\.-à|ej|p\. ?ej|cols|EE|UU|av|apr|J\.-C|Vgl|Cf|Ca|Approx|Aprox|Env|Ggf|Bzw|Evtl|Inkl|dept|ed|eds|trans|jun|sen"
CYRILLIC = r"рис|см|с|стр|т\. ?е|т\. ?к|т|проф|др|напр|им|ул|гл|табл|ред|акад|доц|тов|гр|руб|тыс|млн|млрд|п|пп|ср|Рис|См|Проф|Гл|Табл|Напр|Ср"
GREEK = r"κ|κα|κ\. ?ά|π\. ?χ|δηλ|βλ|σελ|σχ|εικ|αρ|κεφ|πίν|καθ|Βλ|Σχ|Εικ|Κεφ|Πίν|Δρ|δρ|τ"
DEVANAGARI = r"डॉ|पृ|प्रो|श्री|चि|सं|ई|उदा|कृ"
ARABIC = r"د|أ|ص|م|ج|رقم|شكل|دکتر|آ"
THAI = r"ดร|ผศ|รศ|ศ|นพ|พญ|พ\.ศ|ค\.ศ|น|ม\.ค|ก\.พ|จ|อ|ต"
MONTHS = r"Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner|Jan|Feb|Apr|Jun|Jul|Aug|Sept|Okt|Nov|Dez|Jahrhunderts?|Jh|Kapitels?|Abschnitts?|Auflage|Tag(?:es)?|Woche|Jahrestag|Sitzung|Lauf(?:es)?|Mal|Platz|Stelle|Grad(?:es)?|Ordnung|Klasse"

ITALIAN = r"sigg?|sig\.ra|sig\.na|dott|dott\.ssa|prof\.ssa|avv|arch|geom|rag|on|ten|cap|ecc\.,|cfr|pag|pagg|par|tav|nn|es|p\. ?es|a\. ?C|d\. ?C"
DUTCH = r"dhr|mevr|mw|drs|ir|mr|nl|bijv|bv|blz|afb|hfdst|vgl|zgn|o\. ?a|d\. ?w\. ?z|t\. ?o\. ?v|m\. ?b\. ?t|n\. ?a\. ?v|i\. ?p\. ?v|m\. ?a\. ?w"
FRENCH = r"MM|Mmes?|Mlles?|Me|Mgr|Pr|Ste?|éd|édit|trad|chap|art|cf|env|av|apr|p\. ?ex|c\.-à-d"
SPANISH = r"Srta?s?|Sras?|Dra?s|Dña|Uds?|Vds?|págs?|núms?|máx|mín|aprox|Avda|p\. ?ej|a\. ?C|d\. ?C|EE|UU"
PORTUGUESE = r"Sras?|Srs|Dras?|Exm[oa]s?|Ilm[oa]s?|págs?|núms?|máx|mín|aprox|p\. ?ex|a\. ?C|d\. ?C"
ENGLISH = r"Messrs|Mrs|Mr|Ms|Capt|Maj|Gov|Sen|Rep|Pres|Supt|Figs?|Eqs?|Secs?|Refs?|Chs?|viz|approx|est"
POLISH = r"inż|mgr|hab|np|tj|tzw|tzn|ul|al|godz|św|rys|tab|str|pkt|red|m\. ?in|ok|im"
TURKISH = r"Doç|Yrd|Sn|Av|örn|bkz|çev|haz|yy|Çev|Haz|Bkz"
NORDIC = r"t\. ?ex|t\. ?eks|f\. ?eks|bl\. ?a|d\. ?v\. ?s|dvs|s\. ?k|m\. ?fl|kl|jfr|jf|kap|sid|fr\. ?o\. ?m"

W = r"(?<![\p{L}\p{M}\p{N}])"
OPEN = r"[“«„‘\"'(（\[【「『‹¿¡»]*"
SPACED = r"\s+" + OPEN

#: Each table: ordered (break?, before, after). `before` must match up to the end of the mark, `after` from there.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "german": [
        (False, r"(?<![\p{N},.])\p{N}{1,2}\.", rf"\s+(?:{MONTHS})\b"),
        (False, rf"{W}(?:Abb|Abs|Anm|Bd|Kap|Nr|Tab|Art|Hrsg|Std|Min|Sek|Mio|Mrd|usf)\.", r"\s+[\p{Ll}\p{N}]"),
    ],
    "italian": [(False, rf"{W}(?:{ITALIAN})\.", r"\s*\S")],
    "dutch": [(False, rf"{W}(?:{DUTCH})\.", r"\s*\S")],
    "french": [(False, rf"{W}(?:{FRENCH})\.", r"\s*\S")],
    "spanish": [(False, rf"{W}(?:{SPANISH})\.", r"\s*\S")],
    "portuguese": [(False, rf"{W}(?:{PORTUGUESE})\.", r"\s*\S")],
    "english": [(False, rf"{W}(?:{ENGLISH})\.", r"\s*\S")],
    "polish": [(False, rf"{W}(?:{POLISH})\.", r"\s*\S"), (False, r"(?<![\p{N},.])\p{N}{1,4}\.", r"\s+\p{Ll}")],
    "turkish": [(False, rf"{W}(?:{TURKISH})\.", r"\s*\S")],
    "nordic": [(False, rf"{W}(?:{NORDIC})\.", r"\s*\S"), (False, r"(?<![\p{N},.])\p{N}{1,2}\.", r"\s+\p{Ll}")],
    "latin": [
        (False, rf"{W}(?:{TITLES})\.", r"\s*\S"),
        (False, rf"{W}(?:{BEFORE_NUMBER})\.", r"\s*[(\[]?\p{N}"),
        (False, rf"{W}(?:{ALWAYS})\.", r"\s*\S"),
        (False, rf"{W}\p{{Ll}}\.", r"\s?\p{L}{1,2}\."),
        (False, rf"{W}(?:et al)\.", r"\s*[\p{Ll}\p{N}(\[,;]"),
        (False, r"(?<![\p{L}\p{M}\p{N}°’'&])\p{Lu}\.(?:-\p{Lu}\.)?", r"\s*\p{L}"),
    ],
    "cyrillic": [
        (False, rf"{W}(?:{CYRILLIC})\.", r"\s*[\p{Ll}\p{N}(,«]"),
        (False, rf"{W}(?:проф|акад|доц|им|ул|тов|гр|см|рис|стр|гл|табл|напр|ср|Проф|См|Рис)\.", r"\s*\S"),
        (False, r"(?<![\p{L}\p{M}\p{N}°])\p{Lu}\.", r"\s*\p{Lu}"),
        (False, rf"{W}г\.", r"\s*(?:\p{Ll}|[(,])"),
    ],
    "greek": [
        (False, rf"{W}(?:{GREEK})\.", r"\s*\S"),
        (True, r"[\p{L}\p{N}»)];", rf"{SPACED}[\p{{Lu}}\p{{N}}]"),
        (True, r"[\p{L}\p{N}»)];", rf"\s+{OPEN}$"),
        (False, r";", r""),
    ],
    "devanagari": [(False, rf"(?<![\p{{L}}\p{{M}}])(?:{DEVANAGARI})\.", r"\s*\S"), (True, r"[।॥]", r"\s*\S")],
    "arabic": [(False, rf"{W}(?:{ARABIC})\.", r"\s*\S"), (True, r"[؟۔]", r"\s*\S")],
    "thai": [
        (False, rf"(?:{THAI})\.", r"\s*\S"),
        (False, r"(?:ตามที่|เช่น|คือ|ได้แก่|และ|หรือ|ของ|ที่|ว่า|กับ|โดย|ใน)\s*", r""),
        (False, r"", r"[ๆฯ]"),
        (True, r"[\p{Thai}ๆฯ)”][  　]+", rf"{OPEN}[\p{{Thai}}\p{{Latin}}]"),
        (False, r"[  　]+", r""),
    ],
    "cjk": [
        (True, r"[。！？｡][。！？｡…]*", r"\s*\S"),
        (True, r"…+[。！？｡]+", r"\s*\S"),
        (False, r"…+", r""),
        (True, r"[!?]+", r"\s*[\p{Han}\p{Hiragana}\p{Katakana}]"),
    ],
    "ethiopic": [(True, r"[።፧፨]+", r"\s*\S")],
    "armenian": [(True, r"։", r"\s*\S")],
    "burmese": [(True, r"။", r"\s*\S")],
    "khmer": [(True, r"[។៕]", r"\s*\S")],
    "hangul": [(True, r"[.!?]+|…+", r"\s+" + OPEN + r"[\p{L}\p{N}]")],
    "default": [
        (False, r"\p{N}[.]", r"\p{N}"),
        (False, r"[.…]", r"[.…,;:\-–/@_]"),
        (True, r"(?:[\p{Ll}\p{N}%)\]°]|°\p{L}|µ\p{L})[.!?…]+", r"\p{Lu}\p{Ll}|\p{Lu}\s\p{Ll}|[¿¡]"),
        (False, r"[.!?…]", r"(?=[^\s“«„‘\"(（\[【「『‹¿¡])"),
        (True, r"[.!?…]", rf"{SPACED}\p{{Ll}}{{1,2}}\p{{Lu}}"),
        (False, r"[.!?…]", rf"\s*{OPEN}\p{{Ll}}"),
        (True, r"[.!?…。！？｡؟۔।॥]", rf"\s*{OPEN}[\p{{L}}\p{{N}}]"),
        (False, r"", r""),
    ],
}
LANGUAGES = ("english", "german", "french", "spanish", "portuguese", "italian", "dutch", "polish", "turkish", "nordic")
CASCADE = {
    "latin": ("german", "latin", "default"), "cyrillic": ("cyrillic", "latin", "default"), "greek": ("greek", "latin", "default"), "devanagari": ("devanagari", "latin", "default"), "arabic": ("arabic", "latin", "default"),
    "thai": ("thai", "latin", "default"), "cjk": ("cjk", "latin", "default"), "hangul": ("latin", "hangul", "default"), "ethiopic": ("ethiopic", "latin", "default"), "armenian": ("armenian", "latin", "default"),
    "burmese": ("burmese", "latin", "default"), "khmer": ("khmer", "latin", "default"),
} | {x: (x, "latin", "default") for x in LANGUAGES}
# Frequent words that tell languages in Latin letters apart; a word of several languages tells nothing.
FUNCTION_WORDS = {
    "english": "the of and to is that with as was are this which from have be not been",
    "german": "der die das und nach wurde unter mit bei für ist wie nicht ein eine einer auch sich von zu im dem den jede unser",
    "french": "le les des du et est une dans pour qui par sur pas au avec ce cette sont ne nous leur",
    "spanish": "el los las y del una es por con para se al como más esta este su según nuestro",
    "portuguese": "o os as um uma não em do da dos das no na ao pelo pela com são mais nosso",
    "italian": "il lo gli di che è per non della del delle dei nel una sono con alla questo anche",
    "dutch": "het een van en is dat niet zijn wordt voor met aan ook deze bij naar onze",
    "polish": "w z na się nie jest że do to oraz jak dla przez są od po",
    "turkish": "ve bir bu için ile olarak daha çok gibi olan değil",
    "nordic": "och att det som är av på inte til og ikke med den ett eller",
}
#: What continues a sentence after a closed quotation that opened it, in scripts without letter case.
CONTINUES = regex.compile(r"[、，,；;：:]|[とをにがはもでのへやというって]|[\p{Hangul}]|之|的|这|那|一[句词语]")
# Code points of the scripts that have tables of their own.
RANGES = {
    "thai": ((0xE00, 0xE7F),), "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)), "cjk": ((0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)), "devanagari": ((0x900, 0x963), (0x966, 0x97F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "ethiopic": ((0x1200, 0x139F),), "armenian": ((0x530, 0x58F),), "burmese": ((0x1000, 0x109F),), "khmer": ((0x1780, 0x17FF),),
}
_PAIRED_LETTERS = ("greek", "cyrillic")  # single letters of these are symbols in any text
_TOLD = {w: k for k, v in FUNCTION_WORDS.items() for w in v.split() if sum(w in u.split() for u in FUNCTION_WORDS.values()) == 1}
_TELLING = frozenset(_TOLD)
_CASED = ("latin", *LANGUAGES, "cyrillic", "greek", "armenian")


def language_of(text: str) -> str:
    """The language of a text in Latin letters, or `latin`."""
    words = _TELLING & set(text.lower().split())
    if len(words) < 2:
        return "latin"
    (best, n), *rest = Counter(_TOLD[w] for w in words).most_common(2)
    return best if n > 1 and (not rest or n > rest[0][1]) else "latin"


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Code point -> number of its script in RANGES, 0 for all others."""
    out = np.zeros(0x30000, np.uint8)
    for i, ranges in enumerate(RANGES.values(), 1):
        for lo, hi in ranges:
            out[lo : hi + 1] = i
    return out


def script_of(text: str) -> str:
    """The rule cascade's name for a text: the script that most of its letters have, Latin split by language."""
    if text.isascii():
        return language_of(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = script_table()[np.minimum(points, 0x2FFFF)]
    counts = np.bincount(kinds, minlength=len(RANGES) + 1)
    counts[0] = 0
    if not counts.any():
        return language_of(text)
    names = list(RANGES)
    for name in _PAIRED_LETTERS:
        i = names.index(name) + 1
        if counts[i]:
            on = kinds == i
            near = on[1:] & on[:-1]
            counts[i] = (np.append(near, False) | np.append(False, near)).sum()
    most = int(counts.max())
    best = names[int(counts.argmax()) - 1] if most else "latin"
    if not most or best in _PAIRED_LETTERS and most * 3 < sum(c.isalpha() and c < "ʰ" for c in text):
        return language_of(text)
    return best


@lru_cache(maxsize=None)
def compiled(cascade: str) -> list[tuple[bool, regex.Pattern, regex.Pattern]]:
    """The cascade's rules in order; `before` looks back from the end of the mark, `after` is matched from there."""
    return [(b, regex.compile(f"(?<=(?:{x}))"), regex.compile(y)) for t in CASCADE[cascade] for b, x, y in TABLES[t]]


@lru_cache(maxsize=None)
def places(cascade: str) -> regex.Pattern:
    """Where a sentence could end: a run of marks with what closes after it."""
    marks = END + (";;" if cascade == "greek" else "")
    closers = CLOSERS + ("“" if cascade == "german" else "")
    tail = rf"([{regex.escape(closers)}]*)((?:\s?\[\p{{N}}[\p{{N}},–\- ]*\])*)"
    core = rf"[{regex.escape(marks)}]+"
    return regex.compile(rf"({core}){tail}" + (r"|(?<=[\p{Thai}ๆฯ)”])([  　]+)(?=\S)" if cascade == "thai" else ""))


def paired(text: str) -> list[tuple[int, int]]:
    """(open, close) offsets of quotations and brackets that are closed in their paragraph; unclosed ones hold nothing."""
    stack, out = [], []
    for m in _MARKS.finditer(text):
        c, i = m.group(), m.start()
        if c[0] == "\n":
            stack.clear()
            continue
        for j in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[j][0]]:
                out.append((stack[j][1], i))
                del stack[j:]
                break
        else:
            if c in PAIRS and (c not in '"»' or i == 0 or not text[i - 1].isalnum() and text[i - 1] not in ".!?…"):
                stack.append((c, i))
    return out


_MARKS = regex.compile("[" + regex.escape("".join({*PAIRS, *"".join(PAIRS.values())})) + r"]|\n\s*\n")


class Places:
    """The places of a text at which a sentence could end, in order; each is decided when it is asked for.

    Only a place after a closed quotation depends on where its sentence started, so one is decided without those before it.
    """

    def __init__(self, text: str):
        self.text, self.cascade, self.known = text, script_of(text), {}
        found = [(m.start(), m.end() if m.lastindex and m.lastindex >= 4 and m.group(4) is not None else m.end(1), m.end()) for m in places(self.cascade).finditer(text)]
        self.at = []
        for start, mark_end, stop in found:
            nxt = stop
            while nxt < len(text) and text[nxt].isspace():
                nxt += 1
            if nxt < len(text):
                self.at.append((start, mark_end, stop, nxt))
        self.next = [x[3] for x in self.at]
        if self.at:
            spans = sorted(paired(text))
            self.opens, self.reach = [a for a, _ in spans], list(accumulate((z for _, z in spans), max))
            self.closing = sorted((z, a) for a, z in spans)
            self.closes, self.rules = [z for z, _ in self.closing], compiled(self.cascade)

    def _inside(self, start: int, stop: int) -> bool:
        i = bisect_left(self.opens, start)
        return i > 0 and self.reach[i - 1] >= stop

    def _closed(self, start: int, stop: int) -> list[int]:
        """Where the pairs opened that close in the place itself."""
        return [a for _, a in self.closing[bisect_left(self.closes, start) : bisect_left(self.closes, stop)] if a < start]

    def _decide(self, i: int, sentence: int | None) -> bool | None:
        """Whether a sentence starts after place i; None if that takes the start of its sentence and none is given."""
        start, mark_end, stop, nxt = self.at[i]
        text = self.text
        if self._inside(start, stop):
            return False
        opened = self._closed(start, stop)
        if opened:
            if sentence is None:
                return None
            mid = any(text[sentence:a].strip() for a in opened)
            if self.cascade in _CASED:
                p = nxt
                while p < len(text) and text[p] in OPENERS:
                    p += 1
                if mid and not (text[p : p + 1].isupper() and stop < nxt and self.cascade != "german"):
                    return False
            elif mid or (stop == nxt and CONTINUES.match(text, nxt)):
                return False
        for brk, b, a in self.rules:
            if b.match(text, mark_end) and a.match(text, stop):
                return brk
        return False

    def verdict(self, i: int) -> bool:
        if i not in self.known:
            got = self._decide(i, None)
            if got is None:
                j, start = i, 0
                while j > 0:  # back to a sentence whose start is known, then on from there
                    j -= 1
                    told = self.known.get(j, self._decide(j, None))
                    if told:
                        start = self.next[j]
                        j += 1
                        break
                for k in range(j, i + 1):
                    if k not in self.known:
                        self.known[k] = self._decide(k, start)
                    if self.known[k]:
                        start = self.next[k]
            else:
                self.known[i] = got
        return self.known[i]

    def last(self, low: int, high: int) -> int | None:
        """The last offset in (low, high] at which a sentence starts."""
        for i in range(bisect_right(self.next, high) - 1, -1, -1):
            if self.next[i] <= low:
                return None
            if self.verdict(i):
                return self.next[i]
        return None

    def all(self) -> list[int]:
        out, start = [], 0
        for i, nxt in enumerate(self.next):
            if nxt > start:
                got = self.known[i] = self._decide(i, start)
                if got:
                    out.append(nxt)
                    start = nxt
        return out


def boundaries(text: str | None) -> list[int]:
    """Offsets (code points) at which a later sentence of the text starts."""
    return Places(text).all() if text and not text.isspace() else []


def units(text: str | None) -> list[str]:
    """The sentences of a text, without the space between them."""
    if not text or text.isspace():
        return []
    cuts = [0, *boundaries(text), len(text)]
    return [u for u in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if u]


def row_units(text: str, standing: list[int] | None = None, sound: bool = True) -> list[str]:
    """The units of a row of lines: standing lines (by number) alone, the rest of the lines as one text; wrongly decoded text
    is not divided."""
    if not standing:
        return units(text) if sound else [text.strip()] if text.strip() else []
    alone, rest, at, out = set(standing), [], 0, []
    for n, line in enumerate(text.split("\n")):
        if n in alone:
            out.append((at, line.strip()))
        else:
            rest.append((at, line))
        at += len(line) + 1
    joined = "\n".join(x for _, x in rest)
    cuts = [0, *(boundaries(joined) if sound else []), len(joined)]
    starts, pos = [], 0
    for start, line in rest:
        starts.append((pos, start))
        pos += len(line) + 1
    for a, z in zip(cuts, cuts[1:]):
        if u := joined[a:z].strip():
            a += len(joined[a:z]) - len(joined[a:z].lstrip())
            base = [x for x in starts if x[0] <= a][-1]
            out.append((base[1] + a - base[0], u))
    return [u for _, u in sorted(out) if u]


#: JVM filter: a mark with anything after it, or a space behind what may end a Thai sentence; everything else is one unit.
MARKS = END + ";\u037e"
MARKED, THAI, THAI_END = r"[{}]\s*\S", r"\p{InThai}", r"[\p{InThai})”][ \x{a0}\x{3000}]+\S"


def may_divide(text: str) -> Column:
    """Whether a text may have a boundary. A class of marks beyond ASCII is slow, so it is sought only where one of them stands."""
    t, far = F.col(text), [c for c in MARKS if not c.isascii()]
    near = t.rlike(MARKED.format("".join(c for c in MARKS if c.isascii())))
    return near | (reduce(or_, map(t.contains, far)) & t.rlike(MARKED.format("".join(far)))) | (t.rlike(THAI) & t.rlike(THAI_END))


def boundary_rows(df: DataFrame, key: str, text: str, sound=None) -> DataFrame:
    """(key, next_start): each boundary of each row. `sound(texts)` may tell which texts were decoded rightly."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [(k, t, b) for k, t in zip(keys, texts) if (b := boundaries(t))]
            if sound and cut:
                cut = [c for c, ok in zip(cut, sound([t for _, t, _ in cut])) if ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, b in cut for _ in b], batch.column(0).type), pa.array([i for _, _, b in cut for i in b], pa.int32())],
                names=["k", "next_start"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(may_divide("t"))
    return rows.mapInArrow(run, f"k {kind}, next_start int").withColumnRenamed("k", key)


def unit_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_no, unit): the sentences of each row, numbered from 0."""

    def run(batches):
        for batch in batches:
            got = [(k, i, u) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, u in enumerate(units(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], batch.column(0).type), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
                names=["k", "unit_no", "unit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInArrow(
        run, f"k {kind}, unit_no int, unit string").withColumnRenamed("k", key)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm.wrong_encoding import fitted_detector

    rows = table(spark, d, "sentences").where(~F.col("originalText").contains("\n"))
    found = boundary_rows(rows, "id", "originalText", fitted_detector(spark, d).sound)
    return found.withColumnRenamed("id", "sentence_id").distinct()


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    return unit_rows(table(spark, d, "documents"), "doc_id", "text")


def p4_row_units(spark: SparkSession, d: str) -> DataFrame:
    """(sentence_id, unit_no, unit): the sentences of every row of originalText, with line breaks or without."""
    from folioflow.llm.repeated_lines import p2_found
    from folioflow.llm.wrong_encoding import fitted_detector

    sent = spark.sparkContext.broadcast(fitted_detector(spark, d))
    rows = table(spark, d, "sentences").where("originalText is not null").select(F.col("id").alias("sentence_id"), F.col("originalText").alias("t")).dropDuplicates(["sentence_id"])
    lines = p2_found(spark, d).groupBy("sentence_id").agg(F.collect_list("line_no").alias("standing"))

    def run(batches):
        for batch in batches:
            ids, texts, standing = (batch.column(i).to_pylist() for i in range(3))
            cut = [row_units(t, ls) for t, ls in zip(texts, standing)]
            may = [i for i, us in enumerate(cut) if len(us) > 1 and not texts[i].isascii()]
            for i, ok in zip(may, sent.value.sound([texts[i] for i in may])):
                if not ok:
                    cut[i] = row_units(texts[i], standing[i], False)
            got = [(k, n, u) for k, us in zip(ids, cut) for n, u in enumerate(us)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
                names=["sentence_id", "unit_no", "unit"])

    return rows.join(lines, "sentence_id", "left").select("sentence_id", "t", "standing").mapInArrow(run, "sentence_id string, unit_no int, unit string")


#: White space of every kind, for both engines.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): each document's units put together again, without white space."""
    u = F.struct("unit_no", "unit")
    return p4_units(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(u)), lambda x: x["unit"]), "").alias("t")).select("doc_id", F.regexp_replace("t", _SPACE, "").alias("text"))


QUERIES = {"p4_found": p4_found, "p4_units": p4_units, "p4_row_units": p4_row_units, "p4_joined": p4_joined}
ORACLE = {"p4_joined": rf"SELECT doc_id, regexp_replace(text, '{_SPACE}', '', 'g') AS text FROM documents WHERE regexp_replace(text, '{_SPACE}', '', 'g') <> ''"}
