"""Problem 3: noise in text read from scanned pages.

A lexicon of the corpus' frequent words (and of the frequent pairs of adjacent words) comes from one pass over all texts.
A word outside the lexicon is looked up in a symmetric-delete index of the lexicon, both sides deleting up to two
characters, whatever their length; candidates are weighed by an edit distance in which known misreadings (rn for m, 1 for l,
...) cost little, misreadings learned from the corpus a little more, and any other edit one. The context of adjacent words
decides between candidates; a learned misreading needs a frequent pair on one side, and an edit that nothing explains needs one on
both. Misreadings are learned from all rare words that differ from one far more frequent word in one place inside the word;
other writings of sound characters (problem 1) teach none.
Words broken by printed hyphenation are rejoined when the whole word
is known or its parts are not; page numbers and running heads (lines that are titles of the library) between lines of a
sentence are taken out; lines are joined to a paragraph, formulas keeping lines of their own.

Null and empty texts are no case and stay as they are. Words in capitals, numbers, look-alike and invisible characters are
no noise by themselves. Redelivered rows count once in every result; in the lexicon's counts, which only choose
frequent words, rows count as delivered.

Scale: the lexicon's size has a bound by construction, since words with at least a share `LEAST_SHARE` of all tokens
number at most 1 / LEAST_SHARE; the same holds for word pairs. Its index is built once and sent as two arrays of numbers.
Misreadings are learned where the rare words lie; only the counts of the short pieces are shuffled, and only the learned ones
come to the driver. Words rarer than the share are neither repaired to nor
protected by the lexicon: they stand as they are unless a misreading of a frequent word explains them. Counting merges inside each task before the shuffle.
Titles are joined by hash with the few candidate lines, never broadcast by hand. A second pass reads the texts once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.same_look import ODD, TOKEN, by_character, in_doubt, table_form
from folioflow.session import cut
from folioflow.sources.tables import table

LEAST_SHARE, LEAST_COUNT, RATIO, ACCEPT, ANY = 1e-5, 12, 20, 0.95, 1.0
LEARNED_COST, LEAST_LEARNED = 0.45, 5
FLUSH, MEMO, BLOCK = 300_000, 200_000, 200_000

# What a printed letter is misread as.
MISREAD = [
    ("e", "c"), ("n", "ri"), ("o", "0"), ("O", "0"), ("i", "!"), ("t", "f"), ("s", "5"), ("S", "5"), ("l", "1"), ("I", "1"), ("i", "1"), ("d", "cl"), ("u", "ii"),
    ("c", "("), ("C", "("), ("h", "b"), ("m", "rn"), ("g", "9"), ("b", "6"), ("w", "vv"), ("B", "8"), ("a", "@"), ("l", "|"), ("i", "|"), ("l", "!"), ("z", "2"), ("Z", "2"),
    ("q", "9"), ("A", "4"), ("G", "6"), ("H", "I-I"), ("k", "lc"), ("h", "li"), ("y", "v"), ("l", "I"), ("t", "+"), ("E", "€"), ("e", "€"), ("r", "f"), ("D", "0"), ("T", "7"), ("ti", "fi"), ("ü", "ii"), ("u", "li"),
    ("о", "0"), ("О", "0"), ("з", "3"), ("З", "3"), ("и", "н"), ("е", "с"), ("ы", "ьi"), ("ы", "ы"), ("ш", "щ"), ("ч", "4"), ("б", "6"), ("п", "л"), ("ы", "ьl"), ("ю", "1о"), ("ж", "}к"), ("м", "rn"),
    ("l", "i"), ("i", "l"), ("m", "in"), ("m", "ni"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("о", "ю"), ("ы", "ьі"), ("п", "n"), ("л", "п"),
    ("ο", "0"), ("Ο", "0"), ("σ", "o"), ("ι", "1"), ("ε", "6"), ("ν", "v"), ("υ", "v"), ("β", "6"), ("η", "n"), ("ω", "w"), ("έ", "6"), ("ό", "6"),
]
HYPHENS = "-‐¬­"
_TRIM = ".,;:!?\"“”„«»()[]{}—–…'‘’¿¡*/\\<>·|"
_QUOTES = "\"“”„«»’‘…"
_TRIM_END = _TRIM.replace("(", "").replace("!", "").replace("|", "")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:[’'-][\p{L}\p{M}]+)*")
_LOWER = regex.compile(r"[\p{Ll}\p{M}]+(?:[’'-][\p{Ll}\p{M}]+)*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Hangul}]")
_CODE = regex.compile(r"\\\[|\\\(|\$\$|https?:|@|\\[a-z]+")


def core_of(token: str) -> str:
    """A token without the marks around it; marks that may be misread letters stay inside."""
    return token.strip(_TRIM)


_BASE = np.uint64(0x5851F42D4C957F2D)
_INV, _INV2 = (np.uint64(pow(0x5851F42D4C957F2D, -k, 1 << 64)) for k in (1, 2))


@lru_cache(maxsize=256)
def _shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(powers of the base, first and second of each two places) for words of n characters."""
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)[:n], *np.triu_indices(n, 1)


def deletion_hashes(w: str) -> np.ndarray:
    """Hashes of a word with up to two characters deleted: differences of prefix hashes, moved up where characters are gone."""
    n = len(w)
    powers, i, j = _shape(n)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(0x9E3779B97F4A7C15)) * powers, out=p[1:])
    one = p[:-1] + (p[n] - p[1:]) * _INV
    # two places i < j: what lies between moves up by one, what follows by two
    near, far = p[1:] * _INV, p[1:] * _INV2
    two = (p[:-1] - near)[i] + ((p[:-1] * _INV) - far)[j] + p[n:] * _INV2
    return np.concatenate([p[-1:], one, two])


def deletion_hashes_of(words: list[str]) -> np.ndarray:
    """A row of deletion_hashes for each of some words of one length."""
    n = len(words[0])
    powers, i, j = _shape(n)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
    p = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum((codes + np.uint64(0x9E3779B97F4A7C15)) * powers, axis=1, out=p[:, 1:])
    one = p[:, :-1] + (p[:, n:] - p[:, 1:]) * _INV
    near, far = p[:, 1:] * _INV, p[:, 1:] * _INV2
    two = (p[:, :-1] - near)[:, i] + ((p[:, :-1] * _INV) - far)[:, j] + p[:, n:] * _INV2
    return np.concatenate([p[:, n:], one, two], axis=1)


class Lexicon:
    """Frequent words with counts, frequent pairs, learned misreadings, and the symmetric-delete index over the words."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], rare: dict[str, int] | None = None):
        self.words, self.pairs, self.learned = dict(words), pairs, {}
        self._index()
        # a frequent misreading of a far more frequent word is no word
        for w in [w for w in self.words if self.best(w, exclude=w, least=RATIO * self.words[w])]:
            del self.words[w]
        self._index()
        if rare:
            self._learn(rare)
            self._index()

    def _index(self) -> None:
        self.memo: dict[str, list] = {}
        self.list = [w for w in self.words if len(w) >= 3]
        self.longest, self.alphabet = max(map(len, self.list), default=0), frozenset("".join(self.list))
        hashes = [np.unique(deletion_hashes(w)) for w in self.list]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], owner[order]

    def _learn(self, rare: dict[str, int]) -> None:
        """Misreadings that many of the rare words share."""
        seen: Counter = Counter()
        within: Counter = Counter()
        for a, b, inside in self.pieces(rare.items()):
            seen[a, b] += 1
            within[a, b] += inside
        self.learn([(a, b) for (a, b), n in seen.items() if n >= LEAST_LEARNED and within[a, b] * 4 >= n * 3])

    def learn(self, pieces: list[tuple[str, str]]) -> None:
        for a, b in sorted(pieces):
            self.learned.setdefault(b[-1], []).append((a, b))
        self.memo = {}

    def pieces(self, rare) -> list[tuple[str, str, bool]]:
        """What one_piece gives for each of some rare words (with counts) that may be a misreading of far more frequent words in
        one way: one short piece read for another, mostly inside a word (endings that change are grammar)."""
        sizes: dict[int, list[tuple[str, int]]] = {}
        for t, n in rare:
            if 3 <= len(t) <= self.longest + 2:
                sizes.setdefault(len(t), []).append((t, n))
        out = []
        for size, some in sizes.items():
            step = max(1, BLOCK // size**2)
            for k in range(0, len(some), step):
                block = some[k : k + step]
                for (t, n), near in zip(block, self._near_all([t for t, _ in block])):
                    near = {w for w in near if self.words[w] >= RATIO * n and w != t}
                    got = {piece for w in near if (piece := one_piece(w, t))}
                    if len(got) == 1:
                        a, b, inside = got.pop()
                        if (a, b) not in _LISTED and same_writing(a, b) and not (not t.isascii() and self.knows(plain(t))):
                            out.append((a, b, inside))
        return out

    def _near_all(self, tokens: list[str]) -> list[set[str]]:
        """_near of each of some tokens of one length."""
        out: list[set[str]] = [set() for _ in tokens]
        if len(self.keys):
            h = deletion_hashes_of(tokens)
            width = h.shape[1]
            h = h.ravel()
            lo = np.searchsorted(self.keys, h)
            on = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == h)
            hi = np.searchsorted(self.keys, h[on], "right")
            for r, a, z in zip((on // width).tolist(), lo[on].tolist(), hi.tolist()):
                out[r].update(self.list[i] for i in self.owners[a:z].tolist())
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.memo = {}

    def _near(self, token: str) -> set[str]:
        """The words that share a form with up to two characters deleted on both sides. A token longer than any word by more than
        two shares none."""
        if not 3 <= len(token) <= self.longest + 2:
            return set()
        h = deletion_hashes(token)
        lo = np.searchsorted(self.keys, h)
        on = self.keys[np.minimum(lo, len(self.keys) - 1)] == h
        if not on.any():
            return set()
        h, lo = h[on], lo[on]
        hi = np.searchsorted(self.keys, h, "right")
        return {self.list[i] for a, z in zip(lo.tolist(), hi.tolist()) for i in self.owners[a:z].tolist()}

    def candidates(self, token: str, least: int = 0) -> list[tuple[float, str]]:
        """(cost, word) of the lexicon words that the token may be a misreading of, cheapest first."""
        if token not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = [(c, w) for w in self._near(token) if w != token and (c := misread_cost(w, token, self.learned)) <= ANY]
            self.memo[token] = sorted(got, key=lambda x: (x[0], -self.words[x[1]], x[1]))
        return [x for x in self.memo[token] if self.words[x[1]] >= least]

    def best(self, token: str, exclude: str = "", least: int = 0) -> str | None:
        got = [w for c, w in self.candidates(token, int(least)) if w != exclude and c <= ACCEPT and not self._soft(c)]
        return got[0] if got else None

    def knows(self, word: str) -> bool:
        return word in self.words or word.lower() in self.words or word.capitalize() in self.words

    def repair(self, token: str, before: str = "", after: str = "", raw: str = "") -> str | None:
        """The word a token was misread from, or None if the token stands as it is."""
        core = token if token.isascii() else plain(token)
        if self.knows(core) or core.isupper() or not any(c.isalpha() for c in core):
            return None
        if core[:1].isdigit() and sum(c.isalpha() for c in core) < 3:
            return None
        got = self.candidates(core)
        if not got:
            return None
        ranked = sorted(got, key=lambda x: (x[0] - 0.1 * self._context(before, x[1], after), -self.words[x[1]], x[1]))
        for cost, word in ranked:
            if (cost > ACCEPT or self._soft(cost)) and any(c > "\x7f" and c not in word and c not in _QUOTES for c in raw or core):
                continue  # characters out of nowhere are wrong decoding, not misreading
            support = self._context(before, word, after)
            if support >= (2 if cost > ACCEPT else 1 if self._soft(cost) or (core.isalpha() and len(word) < 4) else 0):
                return word
        return None

    @staticmethod
    def _soft(cost: float) -> bool:
        """Whether a learned misreading is part of a cost: listed ones cost 0.3 each."""
        return cost <= ACCEPT and abs(cost / 0.3 - round(cost / 0.3)) > 1e-6

    def _context(self, before: str, word: str, after: str) -> int:
        return ((before, word) in self.pairs) + ((word, after) in self.pairs)


def plain(token: str) -> str:
    """A token with other writings of its characters (problem 1) undone by table."""
    core = by_character(token)
    return TOKEN.sub(lambda m: table_form(m.group()) if in_doubt(m.group()) else m.group(), core) if ODD.search(core) else core


_BY_OUT: dict[str, list[tuple[str, str]]] = {}
for _a, _b in MISREAD:
    _BY_OUT.setdefault(_b[-1], []).append((_a, _b))
_LISTED = set(MISREAD)


def one_piece(word: str, seen: str) -> tuple[str, str, bool] | None:
    """(what was printed, what was read, whether inside the word) if the two differ in one place by at most two characters."""
    a, n = 0, min(len(word), len(seen))
    while a < n and word[a] == seen[a]:
        a += 1
    z = 0
    while z < n - a and word[-1 - z] == seen[-1 - z]:
        z += 1
    x, y = word[a : len(word) - z], seen[a : len(seen) - z]
    return (x, y, z >= 2) if 0 < len(x) <= 2 and 0 < len(y) <= 2 else None


def same_writing(printed: str, read: str) -> bool:
    """Whether a piece may be read for another by a machine: as ASCII, or as letters of the printed script beyond Latin. All else is
    look-alikes or wrong decoding."""
    kind = unicodedata.name(printed[0], "?").split()[0]
    return read.isascii() or (kind != "LATIN" and all(unicodedata.name(c, "?").startswith(kind) for c in read))


def misread_cost(word: str, seen: str, learned: dict[str, list[tuple[str, str]]] | None = None) -> float:
    """Weighted edit distance from a printed word to what was read: 0.3 a known misreading, LEARNED_COST a learned one, 1 any
    other edit. Costs over ANY do not matter."""
    n, m = len(word), len(seen)
    if abs(n - m) > 3:
        return 9.0
    big = 9.0
    d = [[big] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            x = d[i][j]
            if i and j:
                if word[i - 1] == seen[j - 1]:
                    x = min(x, d[i - 1][j - 1])
                else:
                    x = min(x, d[i - 1][j - 1] + 1)
                for a, b in _BY_OUT.get(seen[j - 1], ()):
                    if i >= len(a) and j >= len(b) and word[i - len(a) : i] == a and seen[j - len(b) : j] == b:
                        x = min(x, d[i - len(a)][j - len(b)] + 0.3)
                for a, b in learned.get(seen[j - 1], ()) if learned else ():
                    if i >= len(a) and j >= len(b) and word[i - len(a) : i] == a and seen[j - len(b) : j] == b:
                        x = min(x, d[i - len(a)][j - len(b)] + LEARNED_COST)
            if i:
                x = min(x, d[i - 1][j] + 1)
            if j:
                x = min(x, d[i][j - 1] + 1)
            d[i][j] = x
    return d[n][m]


# ---------------------------------------------------------------- lexicon from the corpus


def gram_counts(texts: DataFrame) -> DataFrame:
    """(a, b, n): occurrences of words (b null) and of adjacent lower-case words over all texts."""

    def run(batches):
        one: Counter = Counter()
        two: Counter = Counter()

        def out():
            words: Counter = Counter()
            strip: dict[str, str] = {}
            for t, n in one.items():
                c = strip[t] = core_of(t)
                if _WORD.fullmatch(c) and not _UNSPACED.search(c):
                    words[c] += n
            pairs: Counter = Counter()
            low = {t: c for t, c in strip.items() if c == t and _LOWER.fullmatch(c)}
            for (t, u), n in two.items():
                if t in low and (c := strip.get(u)) and _LOWER.fullmatch(c):
                    pairs[(t, c)] += n
            total = sum(one.values())
            rows = [("", "", total), *((w, None, n) for w, n in words.items()), *((t, c, n) for (t, c), n in pairs.items())]
            one.clear()
            two.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["a", "b", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                toks = t.split()
                one.update(toks)
                two.update(zip(toks, toks[1:]))
            if len(one) + len(two) > FLUSH:
                yield out()
        if one:
            yield out()

    part = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "a string, b string, n bigint")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def corpus_lexicon(texts: DataFrame, share: float = LEAST_SHARE, least: int = LEAST_COUNT) -> Lexicon:
    """The lexicon of all texts. What comes to the driver are the grams of at least `share` of all tokens: at most 1/share each."""
    counts = cut(gram_counts(texts))
    total = counts.where((F.col("a") == "") & (F.col("b") == "")).agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("a") != "") & (F.col("n") >= max(least, total * share)))
    words, pairs = {}, {}
    for r in rows.select("a", "b", "n").collect():
        if r.b is None:
            words[r.a] = r.n
        else:
            pairs[(r.a, r.b)] = r.n
    few = counts.where(F.col("b").isNull() & (F.col("a") != "") & (F.col("n") < max(least, total * share)) & F.col("a").rlike(r"^[\p{L}\p{M}]{4,}$"))
    lex = Lexicon(words, pairs)
    lex.learn(learned_pieces(few.select("a", "n"), lex))
    return lex


def learned_pieces(rare: DataFrame, lex: Lexicon) -> list[tuple[str, str]]:
    """The misreadings that at least LEAST_LEARNED of all rare words share, most of them inside the word. `rare` has (a, n), a word a row."""
    sent = rare.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lx, seen, within = sent.value, Counter(), Counter()
        for batch in batches:
            for a, b, inside in lx.pieces(zip(*(c.to_pylist() for c in batch.columns))):
                seen[a, b] += 1
                within[a, b] += inside
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([within[k] for k in seen], pa.int64())],
            names=["a", "b", "n", "inside"])

    got = rare.mapInArrow(run, "a string, b string, n bigint, inside bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    return [(r.a, r.b) for r in got.where((F.col("n") >= LEAST_LEARNED) & (F.col("inside") * 4 >= F.col("n") * 3)).collect()]


# ---------------------------------------------------------------- one text

_NUMBER_LINE = regex.compile(r"\s*[-–—·\[(|*~]*\s*\d{1,4}\s*[-–—·\])|*~]*\s*")
_NUMBERED = regex.compile(r"\s*(?:(?P<a>\d{1,4})\s*\|\s*(?P<x>.*\S)|(?P<y>.*\p{L}.*\S)(?:\s{2,}|\s*\|\s*|\s+)(?P<b>\d{1,4}))\s*")
_SET_OFF = regex.compile(r"\s{2,}\d{1,4}\s*$|\|\s*\d+\s*$")
_HANGUL = regex.compile(r"\p{Hangul}")
_FORMULA = regex.compile(r"\s*(?:\\\[|\\begin|\$\$|\\\()")
_ENDS = regex.compile(r"[.!?。！？…।؟۔:][\"'”’»」』)\]]*\s*$")
_BROKEN = regex.compile(rf"(?<![\p{{L}}\p{{M}}])((?:[\p{{L}}\p{{M}}]+[’'])?[\p{{L}}\p{{M}}]+)([{HYPHENS}]) +([\p{{Ll}}\p{{M}}]+)")
_LAST = regex.compile(rf"((?:[\p{{L}}\p{{M}}]+[’'])?[\p{{L}}\p{{M}}]+)([{HYPHENS}])\s*$")
_ELISION = regex.compile(r"^[\p{L}\p{M}]+[’']")
_FIRST = regex.compile(r"\s*([\p{L}\p{M}]+)")


def head_core(line: str) -> tuple[str, bool]:
    """(a line without its page number, lower case; whether it carries a page number set off from it)."""
    m = _NUMBERED.fullmatch(line)
    if not m:
        return line.strip().lower(), False
    return (m["x"] or m["y"]).strip(" |·-").lower(), bool(m["x"]) or bool(_SET_OFF.search(line))


def broken(a: str, mark: str, b: str, lex: Lexicon) -> bool:
    """Whether a + hyphen + b is one word broken by printing."""
    if lex.knows(a + b) or lex.knows(_ELISION.sub("", a) + b):
        return True
    if lex.knows(f"{a}-{b}"):
        return False
    if mark != "-":
        return True
    if lex.repair(a + b):
        return True
    return not lex.knows(b) and not lex.knows(a) and a.lower() not in _PREFIXES


_PREFIXES = {"pre", "post", "non", "co", "re", "self", "multi", "semi", "anti", "sub", "vor", "nach", "ein", "aus", "pré", "auto", "quasi"}


def examine(text: str, lex: Lexicon, titles: set[str] = frozenset(), found_only: bool = False):
    """(noisy?, repaired text, candidate head lines): the work on one text.

    Candidate head lines are lines inside the text that may be titles; those in `titles` are taken as running heads.
    """
    noisy, maybe = False, []
    lines = text.split("\n")
    kept: list[str] = lines
    if len(lines) > 2:
        kept = [lines[0]]
        for i, line in enumerate(lines[1:-1], 1):
            if not line.strip() or _FORMULA.match(line):
                kept.append(line)
                continue
            inner = not _ENDS.search(kept[-1]) and not _FORMULA.match(kept[-1])
            core, marked = head_core(line)
            if _NUMBER_LINE.fullmatch(line) and inner:
                noisy = True
                continue
            if (core in titles or marked or (core.upper() == line.strip() and line.strip().isupper() and not text.isupper())) and inner:
                noisy = True
                continue
            if inner and core and not core.isdigit():
                maybe.append(core)
            kept.append(line)
        kept.append(lines[-1])
    # lines joined to a paragraph
    tight = len(_UNSPACED.findall(text)) * 3 > sum(map(str.isalpha, text)) and not _HANGUL.search(text)
    parts: list[str] = []
    for line in kept:
        if not parts or _FORMULA.match(line) or _FORMULA.match(parts[-1].rpartition("\n")[2]):
            parts.append(line)
            continue
        prev = parts[-1]
        m, f = _LAST.search(prev), _FIRST.match(line)
        if m:
            if f and f[1][:1].islower() and broken(m[1], m[2], f[1], lex):
                noisy = True
                parts[-1] = prev[: m.start(2)] + line.lstrip()
                continue
            if m[2] != "-":
                noisy = True
            elif f and not f[1][:1].islower() and len(m[1]) > 1:
                # what follows may be a running head not yet known as a title: look behind it
                k = kept.index(line)
                nxt = _FIRST.match(kept[k + 1]) if k + 1 < len(kept) else None
                if nxt and nxt[1][:1].islower() and broken(m[1], m[2], nxt[1], lex):
                    noisy = True
        if _ENDS.search(prev):
            parts.append(line)
        elif tight:
            parts[-1] = prev.rstrip() + line.lstrip()
        else:
            parts[-1] = prev.rstrip() + " " + line.lstrip()
    out = "\n".join(parts)

    def rejoin(m):
        nonlocal noisy
        if broken(m[1], m[2], m[3], lex):
            noisy = True
            return m[1] + m[3]
        return m.group()

    if any(h in out for h in HYPHENS):
        out = _BROKEN.sub(rejoin, out)
    if found_only and noisy:
        return True, None, []
    fixed = []
    for line in out.split("\n"):
        if _CODE.search(line):
            fixed.append(line)
            continue
        toks = line.split(" ")
        # in a line with letters that no word has, unlisted edits would repair wrong decoding
        foreign = None
        for i, t in enumerate(toks):
            if t in lex.words or len(t) < 3:
                continue
            c = core_of(t)
            if len(c) < 3 or c in lex.words or _UNSPACED.search(c):
                c2 = t.strip(_TRIM_END)
                if c2 == c or len(c2) < 3 or _UNSPACED.search(c2) or c in lex.words:
                    continue
                c = c2
            got = None
            for form in dict.fromkeys((t.lstrip(_TRIM).rstrip(_TRIM_END), t.lstrip(_TRIM_END).rstrip(_TRIM_END), c)):
                if form[:1] in "(!|" and (len(form) < 5 or lex.knows(by_character(core_of(form)))):
                    continue
                if foreign is None:
                    foreign = line if not line.isascii() and any(c > "\x7f" and c.isalpha() for c in set(line) - lex.alphabet) else ""
                if len(form) >= 3 and (got := lex.repair(form, core_of(toks[i - 1]) if i else "", core_of(toks[i + 1]) if i + 1 < len(toks) else "", foreign or t)):
                    c = form
                    break
                if lex.knows(form):
                    break
            if got:
                noisy = True
                toks[i] = t.replace(c, got, 1)
        fixed.append(" ".join(toks))
    return noisy, "\n".join(fixed), maybe


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, sentence_id, text) of originalText and parsedText."""
    s = table(spark, d, "sentences").select(F.lit("originalText").alias("field_name"), F.col("id").alias("sentence_id"), F.col("originalText").alias("text"))
    r = table(spark, d, "ai_correction_reviews").select(F.lit("parsedText").alias("field_name"), F.col("sentenceId").alias("sentence_id"), F.col("parsedText").alias("text"))
    return s.unionByName(r)


def title_rows(documents: DataFrame) -> DataFrame:
    """(title): the library's titles, lower case, without a file suffix."""
    t = F.regexp_replace(F.lower(F.trim("title")), r"\.(?:pdf|docx?|txt)$", "")
    return documents.select(t.alias("title")).where("title is not null and title <> ''").distinct()


def scan_rows(rows: DataFrame, documents: DataFrame, lex: Lexicon, found_only: bool = True) -> DataFrame:
    """(field_name, sentence_id, repaired): the noisy rows. With found_only `repaired` stays null and costs nothing."""
    sent = rows.sparkSession.sparkContext.broadcast(lex)
    keep = ["field_name", "sentence_id"]

    def first(batches):
        lx = sent.value
        for batch in batches:
            f, k, texts = (batch.column(i).to_pylist() for i in range(3))
            res = [examine(t, lx, found_only=found_only) for t in texts]
            pick = [i for i, r in enumerate(res) if r[0] or r[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for i in pick], pa.string()), pa.array([k[i] for i in pick], pa.string()), pa.array([res[i][0] for i in pick], pa.bool_()),
                 pa.array([res[i][2] for i in pick], pa.list_(pa.string())), pa.array([None if found_only else texts[i] for i in pick], pa.string())],
                names=[*keep, "noisy", "maybe", "text"])

    got = rows.where(F.col("text").isNotNull()).select(*keep, "text").mapInArrow(first, "field_name string, sentence_id string, noisy boolean, maybe array<string>, text string")
    got = cut(got)
    open_lines = got.where(F.size("maybe") > 0).select(*keep, F.explode("maybe").alias("title"))
    heads = open_lines.distinct().join(title_rows(documents), "title")
    if found_only:
        return got.where("noisy").select(*keep).unionByName(heads.select(*keep)).distinct().withColumn("repaired", F.lit(None).cast("string"))
    named = heads.groupBy(*keep).agg(F.collect_set("title").alias("heads"))

    def second(batches):
        lx = sent.value
        for batch in batches:
            f, k, texts, hs = (batch.column(i).to_pylist() for i in range(4))
            res = [examine(t, lx, set(h or ())) for t, h in zip(texts, hs)]
            pick = [i for i, r in enumerate(res) if r[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for i in pick], pa.string()), pa.array([k[i] for i in pick], pa.string()), pa.array([res[i][1] for i in pick], pa.string())],
                names=[*keep, "repaired"])

    again = got.distinct().join(named, keep, "left").where(F.col("noisy") | F.col("heads").isNotNull())
    return again.select(*keep, "text", "heads").mapInArrow(second, "field_name string, sentence_id string, repaired string")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = text_rows(spark, d)
    return scan_rows(rows, table(spark, d, "library_documents"), corpus_lexicon(rows)).select("field_name", "sentence_id")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = text_rows(spark, d)
    return scan_rows(rows, table(spark, d, "library_documents"), corpus_lexicon(rows), found_only=False)


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
