"""Problem 5: text whose bytes were read in a wrong encoding.

A multinomial classifier over hashed byte bigrams (of the text's UTF-8 bytes, those touching a non-ASCII byte)
is trained on synthetically garbled rows: each class is one exact chain, "written in A, read in B", twice for doubly
garbled text, and one class is sound text. The chains of a row, and of its stretches that the sound classes explain badly, are
predicted by their scores; only predicted chains are inverted, and one is accepted when the inverse decodes strictly into
known characters and looks sounder.

The training rows are all of the corpus' own texts, each once: bigrams of sound text, those of every chain, and the thresholds
are counted over all of them, the scripts of a chain weighing alike. What a chain makes of a text follows from its pairs of
adjacent characters, or, where the reader takes several bytes as one character, from its words; so pairs and words are counted, and
garbled once each. The inventory of known characters: `all_known` adds those that the fit has too seldom. Rows found
garbled in a first fit leave the sound class before the second fit, and so once more; only their counts are taken anew, and taken off.

Null and empty texts and pure ASCII are sound. With fewer than LEAST_ROWS training rows only texts with characters that no
sound text has are found. Text that lost bytes (U+FFFD) is found but restored only as far as the
inverse decodes. Redelivered rows count once.

Scale: the texts that are not ASCII are shuffled once to be distinct; of counts, words and pairs merge inside each task before the
shuffle. To the driver come pairs of characters by script and applicable chains, bounded by the alphabet, and one vector a chain from each
task and script. The model that goes to the workers has a fixed size (classes x buckets). Vectorised passes drop the rows without a suspicious
window of bigrams, then those that `judge` would surely call sound (`found`); what they learn of stretches and runs is remembered.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.same_look import TOKEN, by_character, in_doubt, table_form
from folioflow.session import cut
from folioflow.sources.tables import table

KNOWN_ROWS, KNOWN_SHARE = 2, 0.05
FULL, FLUSH = 9000, 300_000
PRINTED, WEST, EAST, ALARM, SCRIPT = 1, 2, 4, 8, 16
CHUNK, LONG, KEPT, SLACK = 250_000, 50_000, 200_000, 0.1
SAMPLE, BUCKETS, WINDOW, PER_CLASS, SMOOTH, LEAST_ROWS = 9000, 1 << 16, 6, 120, 0.002, 20
TOP, TOP_STRETCH, STRETCH_MARGIN, PRIOR = 10, 8, 3.0, 14.0
READERS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1256", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "cp874", "iso8859_15", "gb18030", "cp932", "cp949", "big5", "euc_jp")
LEGACY = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "cp1256", "iso8859_6", "cp874", "gb18030", "big5", "cp932", "euc_jp", "cp949")
LEGACY_READERS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1256", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "gb18030", "cp932", "cp949", "big5", "utf-8")
MULTI = {"utf-8", "gb18030", "cp932", "cp949", "big5", "euc_jp"}
LOST = "�"
KEPT_BY_DETECTOR = ("_valid_", "_bounds_", "_remembered_", "_seen")


@lru_cache(maxsize=None)
def byte_table(codec: str) -> tuple[list[str], dict[str, int]]:
    """byte -> character of a one-byte codec, undefined bytes as the control character of their value, and back."""
    chars = [bytes([b]).decode(codec, "replace").replace(LOST, chr(b)) for b in range(256)]
    return chars, {c: b for b, c in enumerate(chars)}


def read_as(raw: bytes, codec: str) -> str:
    """Bytes read in a codec, as a lenient reader does."""
    if codec in MULTI:
        return raw.decode(codec, "replace")
    chars = byte_table(codec)[0]
    return "".join([chars[b] for b in raw])


def unread(text: str, codec: str) -> bytes | None:
    """The bytes a reader of the codec turned into the text, or None."""
    if codec in MULTI:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    back = byte_table(codec)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def written(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def chains() -> list[tuple[tuple[str, str], ...]]:
    """Every chain that is a class: steps (written in, read in), the first step first."""
    one = [(("utf-8", b),) for b in READERS]
    one += [((a, b),) for a in LEGACY for b in LEGACY_READERS if a != b]
    two = [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
    return one + two


def garble(text: str, chain) -> str | None:
    for a, b in chain:
        raw = written(text, a)
        if raw is None:
            return None
        text = read_as(raw, b)
    return text


def invert(text: str, chain) -> str | None:
    """The text before the chain, if every step decodes strictly."""
    for a, b in reversed(chain):
        raw = unread(text, b)
        if raw is None:
            return None
        try:
            text = raw.decode(a)
        except UnicodeDecodeError:
            return None
    return text


_MULT = np.uint32(2654435761)


def bigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each adjacent byte pair, and whether one of its bytes is not ASCII."""
    a, b = raw[:-1], raw[1:]
    idx = (((a.astype(np.uint32) << np.uint32(8)) | b) * _MULT) >> np.uint32(32 - 16)
    return idx.astype(np.int32), (a | b) >= 0x80


def features(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), np.uint8)
    idx, on = bigrams(raw)
    return idx[on]


_WIDE = regex.compile(r"[^\x00-\x7f]")
#: Never sound: control characters of the second block, lost bytes, private use.
_ALARM = regex.compile(r"[\x80-\x84\x86-\x9f�-]")
#: Letters of a script that stands apart from Latin, or of any other script alone, inside a Latin word.
_MIXED = regex.compile(r"\p{Latin}[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Devanagari}]|[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Devanagari}]\p{Latin}|\p{Latin}[\p{Thai}\p{Hangul}\p{Han}\p{Katakana}]{1,2}\p{Ll}")
_SCRIPTS = [regex.compile(p) for p in (r"\p{Cyrillic}", r"\p{Greek}", r"\p{Arabic}", r"\p{Thai}", r"\p{Devanagari}", r"\p{Han}|\p{Hiragana}|\p{Katakana}", r"\p{Hangul}", r"[\u00c0-\u024f]")]
_WEST = regex.compile(r"[\x80-\u052f\u2010-\u22ff](?:[ -~]{0,2}[\x80-\u052f\u2010-\u22ff])*")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
_HYPHENED = regex.compile(r"(\p{L})[-¬‐\xad]\s+(?=\p{Ll})")
_PAGE_NUMBER = regex.compile(r"(?m)^[^\p{L}\n]*\d+[^\p{L}\n]*$\n?")
_HUMP = regex.compile(r"(?<!\p{L})\p{Ll}\p{Lu}")
_REWRITTEN = regex.compile(r"\p{L}[-¬‐\xad]\s|(?m:^[^\p{L}\n]*\d+[^\p{L}\n]*$)|[¹²³⁰⁴-⁹‐‑\u00a0\u00ad\u200b-\u200f\u2000-\u200a\u202f\u205f\u2060-\u2064\u3000\ufeff\ufe00-\ufe0f\uff01-\uffee\ufb00-\ufb06\u0300-\u036f\u2103\u3099\u309a\u1100-\u11ff]|¬\n|[A-Za-z]\p{Mn}*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][A-Za-z]")
_RUN = regex.compile(r"[^\x00-\x7f](?:[ -~\xa0]{0,2}[^\x00-\x7f])*")


def _changed(text: str, got: str) -> tuple[str, str, str]:
    """(the part of a text that differs from another, its counterpart, the rest of the text)."""
    a, z, n = 0, 0, min(len(text), len(got))
    while a < n and text[a] == got[a]:
        a += 1
    while z < n - a and text[-1 - z] == got[-1 - z]:
        z += 1
    return text[a : len(text) - z], got[a : len(got) - z], text[:a] + text[len(text) - z :]


@lru_cache(maxsize=None)
def _kind(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c > "\xbf" and c.isalpha() else ""


def group_of(text: str) -> str:
    """The script that most of a text's letters beyond ASCII have."""
    letters = Counter(k for c in text if c > "\xbf" and (k := _kind(c)))
    return max(letters, key=letters.get) if letters else "LATIN"


def main_groups(sizes: dict[str, int]) -> list[str]:
    """The scripts that are not rare, or all if all are."""
    least = max(3, sum(sizes.values()) // 1000)
    return [g for g, n in sizes.items() if n >= least] or list(sizes)


@lru_cache(maxsize=None)
def _numbers() -> tuple[np.ndarray, list[str]]:
    """Per code point, filled in by `kinds` as they come: what it is, and the names of the scripts that are numbered there."""
    return np.full(0x110000, -1, np.int16), [""]


def kinds(codes: np.ndarray) -> np.ndarray:
    """What each code point is: bits of PRINTED, WEST, EAST and ALARM, and from SCRIPT on the number of its script by `_kind`."""
    known, names = _numbers()
    out = known[codes]
    if (out < 0).any():
        for x in np.unique(codes[out < 0]).tolist():
            c = chr(x)
            if (name := _kind(c)) not in names:
                names.append(name)
            known[x] = (" " <= c <= "~") * PRINTED | bool(_WEST.match(c)) * WEST | bool(_EAST.match(c)) * EAST | bool(_ALARM.match(c)) * ALARM | names.index(name) * SCRIPT
        out = known[codes]
    return out


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with a line break behind it, and where each text starts."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def linked(on: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of places that are `on` with no more than two others in between, none of them at a `stop`."""
    at = np.flatnonzero(on)
    if not len(at):
        return at, at
    passed = np.cumsum(stop)
    end = np.flatnonzero((np.diff(at) > 3) | (passed[at[1:] - 1] > passed[at[:-1]]))
    return at[np.concatenate([[0], end + 1])], at[np.concatenate([end, [len(at) - 1]])] + 1


@lru_cache(maxsize=None)
def places_in_utf8(reader: str) -> np.ndarray:
    """What the bytes that a one-byte reader made characters of may be in a UTF-8 sequence, by code point: 1 for those that continue
    one, n for those that begin one of n bytes."""
    out = np.zeros(0x10000, np.uint8)
    for b, c in enumerate(byte_table(reader)[0]):
        out[ord(c)] = 0 if b < 0x80 else 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    return out


def sequences(codes: np.ndarray, reader: str) -> np.ndarray:
    """Places of code points where a UTF-8 sequence read by the reader may start."""
    n = places_in_utf8(reader)[np.where(codes < 0x10000, codes, 0)]
    on = np.flatnonzero((n[:-1] > 1) & (n[1:] == 1))
    if not len(on):
        return on
    n = np.concatenate([n, [0, 0]])
    return on[((n[on] < 3) | (n[on + 2] == 1)) & ((n[on] < 4) | (n[on + 3] == 1))]


def island(text: str) -> bool:
    """A few East Asian characters alone in a text of ASCII letters."""
    n = len(_EAST.findall(text))
    return 0 < n <= 6 and len(text) >= 12 * n


class Detector:
    """The fitted classifier: flags garbled texts, names their chain and restores them."""

    def __init__(self, texts: list[str], per_class: int = PER_CLASS):
        self.chains = chains()
        sound = [t for t in dict.fromkeys(texts) if _WIDE.search(t) and not _ALARM.search(t)]
        self.fitted = len(sound) >= LEAST_ROWS
        self.first = 0.0
        if not self.fitted:  # too little text to learn from: only what is never sound is found
            return
        for seldom in (0.004, 0.004, 0.0):
            self.fit_sound(sound, seldom)
            self.fit_chains(sound, per_class)
            if seldom:
                sound = [t for t, bad in zip(sound, self.flags(sound)) if not bad]

    def fit_sound(self, sound: list[str], seldom: float) -> None:
        """The sound class: one multinomial per script, mixed in equal parts so that no script is rare.

        A bigram that stands in at most `seldom` of the rows (or in one row only) makes a text worth a look.
        """
        chars = Counter(c for t in sound for c in set(t) if c > "\x7f")
        groups: dict[str, list[str]] = {}
        for t in sound:
            groups.setdefault(group_of(t), []).append(t)
        per = {g: (len(ts), np.bincount(np.concatenate([features(t) for t in ts]), minlength=BUCKETS)) for g, ts in groups.items()}
        self.groups = {g: groups[g] for g in main_groups({g: len(ts) for g, ts in groups.items()})}
        rows = np.bincount(np.concatenate([np.unique(features(t)) for t in sound]), minlength=BUCKETS)
        self.set_sound(len(sound), chars, per, rows, seldom)
        self.first = min(float(np.quantile(self._windows(sound), 0.97)), 90.0)
        self.typical = float(np.quantile([self.level(t) for t in sound[:3000]], 0.02))

    def set_sound(self, n: int, chars: dict[str, int], per: dict[str, tuple[int, np.ndarray]], rows: np.ndarray, seldom: float) -> None:
        """The sound class out of counts over n rows: rows with a character, rows and bigrams of a script, rows with a bigram.

        Beyond FULL rows the counts are scaled to so many, so that smoothing weighs the same however many rows there are.
        """
        self._forget()
        least = max(2, n // 2000)
        self.known = {c for c, k in chars.items() if k >= least}
        scale = min(1.0, FULL / n)
        per_script = []
        for g in main_groups({g: k for g, (k, _) in per.items()}):
            m = per[g][1] * scale
            per_script.append((m + SMOOTH) / (m.sum() + SMOOTH * BUCKETS))
        self.per_script = np.ascontiguousarray(np.log(np.array(per_script)).astype(np.float32).T)
        self.base = np.log(np.mean(per_script, axis=0)).astype(np.float32)
        self.odds = np.where(rows <= max(1, seldom * n, n / FULL), 100.0, np.clip(-self.base - 7.0, 0, 6)).astype(np.float32)

    def fit_chains(self, sound: list[str], per_class: int) -> None:
        """One multinomial per chain, over garbled texts of every script that the chain changes."""
        pool = [t for i in range(per_class) for ts in self.groups.values() for t in ts[i : i + 1]]
        raws = {a: [written(t, a) for t in pool] for a in {"utf-8", *LEGACY}}
        keep, counts = [], []
        for chain in self.chains:
            got, n = [], 0
            for t, raw in zip(pool, raws[chain[0][0]]):
                if raw is None or raw.isascii():
                    continue
                g = read_as(raw, chain[0][1]) if len(chain) == 1 else garble(t, chain)
                if g is None or g == t:
                    continue
                got.append(features(g))
                n += 1
                if n >= per_class:
                    break
            if n >= 3:
                keep.append(chain)
                counts.append(np.bincount(np.concatenate(got), minlength=BUCKETS))
        self.set_chains(keep, counts)

    def set_chains(self, keep: list[tuple], counts: list[np.ndarray]) -> None:
        """The multinomials of the chains out of the counts of their bigrams."""
        self._forget()
        self.classes = keep
        m = np.array(counts, np.float64).reshape(-1, BUCKETS)
        w = np.log((m + SMOOTH) / (m.sum(1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
        # text written in UTF-8 is far the most frequent, so its chains have a greater prior
        self.prior = np.array([PRIOR if c[0][0] == "utf-8" else 0.0 for c in keep], np.float32)
        # only the buckets that some class has are kept; all others share one column
        live = np.flatnonzero(m.any(0))
        self.column = np.full(BUCKETS, len(live), np.int32)
        self.column[live] = np.arange(len(live))
        self.weights = np.ascontiguousarray(np.concatenate([w[:, live], w.min(1, keepdims=True)], axis=1).T)

    def level(self, text: str) -> float:
        """How sound a text looks: the mean log probability of its bigrams in the best script's multinomial."""
        idx = features(text)
        return float(self.per_script[idx].mean(0).max()) if len(idx) else 0.0

    def _windows(self, texts: list[str]) -> np.ndarray:
        """Each text's largest sum of odds over a window of bigrams."""
        if not texts or not self.fitted:
            return np.zeros(len(texts))
        raws = [("\n" + t + "\n").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) for r in raws])
        raw = np.frombuffer(b"".join(raws) + b"\n" * (WINDOW + 1), np.uint8)
        idx, on = bigrams(raw)
        total = np.concatenate([[0], np.cumsum(np.where(on, self.odds[idx], 0), dtype=np.float64)])
        w = total[WINDOW:] - total[:-WINDOW]
        starts = np.concatenate([[0], ends[:-1]])
        return np.maximum.reduceat(w[: ends[-1]], starts)

    def total(self, text: str) -> float:
        """Log likelihood of a text's bigrams in the best script's multinomial."""
        idx = features(text)
        return float(self.per_script[idx].sum(0).max()) if len(idx) else 0.0

    def _score(self, idx: np.ndarray) -> tuple[np.ndarray, float]:
        """Log likelihood of each chain, and of the best sound class."""
        return self.weights[self.column[idx]].sum(0), float(self.per_script[idx].sum(0).max())

    def _plausible(self, text: str) -> bool:
        return all(c in self.known for c in text if c > "\x7f") and "\x00" not in text

    def _inverted_runs(self, text: str, predicted: list[int]) -> tuple[str | None, tuple | None]:
        """The inverse by those predicted chains that left UTF-8 sequences in a one-byte reader: each run of them alone, where
        it decodes into known characters and looks sounder. Of several chains the one that inverts most."""
        best = (None, None, 0)
        for chain in (self.classes[c] for c in predicted if self.classes[c][0][0] == "utf-8" and self.classes[c][-1][1] not in MULTI):
            hits = 0

            def fix(m):
                nonlocal hits
                got = self._remembered(("fixed", chain, m.group(), text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]), self._fixed)
                if got is None:
                    return m.group()
                hits += len(m.group()) - len(got) + 1
                return got

            out = self._valid[chain[-1][1]].sub(fix, text)
            if hits > best[2]:
                best = (out, chain, hits)
        return best[0], best[1]

    def _stretches(self, text: str) -> list[tuple[int, int, np.ndarray]]:
        """The stretches of a text that a chain explains better than any sound class, with the chains' scores."""
        out, seen = [], self.__dict__.get("_seen", {})
        for a, z in seen[text][1] if text in seen else self._parts(text):
            idx = features(text[max(0, a - 1) : z + 1])
            if len(idx):
                part, own = self._score(idx)
                if part.max() - own > STRETCH_MARGIN:
                    out.append((a, z, part))
        return out

    def _undone(self, text: str, predicted: list[int]) -> tuple[str | None, tuple | None]:
        """The inverse by predicted chains, and once more where it is garbled still."""
        if not self.__dict__.get("_seen", {}).get(text, (True,))[0]:
            return text, None
        out, chain = self._inverted_runs(text, predicted)
        if chain is not None and not out.isascii():
            ll, _ = self._score(features(out))
            again, more = self._inverted_runs(out, np.argsort(-ll - self.prior)[:TOP].tolist())
            if more is not None:
                return again, (*more, *chain)
        return out, chain

    @property
    def eastern(self) -> list[int]:
        """Classes of UTF-8 read in an eastern encoding."""
        return [i for i, c in enumerate(self.classes) if len(c) == 1 and c[0][0] == "utf-8" and c[0][1] in MULTI]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in KEPT_BY_DETECTOR}

    def _forget(self) -> None:
        """Drops what was kept of an earlier fit."""
        for k in KEPT_BY_DETECTOR:
            self.__dict__.pop(k, None)

    @property
    def _bounds(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per bucket the sound classes and, for each reader, the greatest of its chains; and the weights of each reader's chains."""
        if "_bounds_" not in self.__dict__:
            own = [np.array([i for i, c in enumerate(self.classes) if c[-1][1] == b]) for b in sorted({c[-1][1] for c in self.classes})]
            each = [np.ascontiguousarray(self.weights[:, i]) for i in own]
            self.__dict__["_bounds_"] = np.ascontiguousarray(np.concatenate([self.per_script, np.stack([w.max(1) for w in each], 1)[self.column]], axis=1)), each
        return self.__dict__["_bounds_"]

    def _explained(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the texts, none of them ASCII, a chain explains better than the best sound class by STRETCH_MARGIN, or nearly;
        each text's sums of the first of _bounds).

        A reader's chains are summed only where the sum of their greatest weights does not settle it.
        """
        both, each = self._bounds
        idx, on, owner = joined_bigrams(texts)
        idx = idx[on]
        starts = np.searchsorted(owner[on], np.arange(len(texts)))
        sums = np.add.reduceat(both[idx], starts, axis=0)
        n = self.per_script.shape[1]
        least = sums[:, :n].max(1) + (STRETCH_MARGIN - SLACK)
        sizes, column, high = np.diff(starts, append=len(idx)), self.column[idx], np.zeros(len(texts), bool)
        for k, w in enumerate(each):
            open_ = (sums[:, n + k] > least) & ~high
            if open_.any():
                m = sizes[open_]
                got = np.add.reduceat(w[column[np.repeat(open_, sizes)]], np.cumsum(m) - m, axis=0).max(1)
                high[open_] = got > least[open_]
        return high, sums

    def _spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """_parts of many texts, in their order: (number of the text, its start, from, to, whether it is one of _RUN), places in
        joined_codes."""
        codes, starts = joined_codes(texts)
        kind = kinds(codes)
        stop, of = (kind & PRINTED == 0), np.repeat(np.arange(len(texts)), np.diff(starts))
        wide = codes > 0x7F
        spans = [linked(wide, stop & ~wide)]
        east = np.zeros(len(texts), bool)
        east[of[kind & EAST > 0]] = True
        west = (kind & WEST > 0) & east[of]
        spans.append(linked(west, stop & ~west))
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        owner = np.cumsum(raw & 0xC0 != 0x80) - 1
        idx, on = bigrams(raw)
        odd = np.flatnonzero(on & (self.odds[idx] >= 100))
        between = np.zeros(len(codes), bool)
        between[starts[1:] - 1] = True
        odd = odd[~between[owner[odd]] & ~between[owner[odd + 1]]]
        if len(odd):
            chars = np.unique(np.concatenate([owner[odd], owner[odd + 1]]))
            end = np.flatnonzero((np.diff(chars) > 4) | (np.diff(of[chars]) > 0))
            a, z = chars[np.concatenate([[0], end + 1])], chars[np.concatenate([end, [len(chars) - 1]])] + 1
            a, z = (a[:, None] + [0, 0, 1, 1]).ravel(), (z[:, None] - [0, 1, 0, 1]).ravel()
            spans.append((a[a < z], z[a < z]))
        runs = np.arange(sum(len(a) for a, _ in spans)) < len(spans[0][0])
        a, z = (np.concatenate(x) for x in zip(*spans))
        by = np.argsort(of[a], kind="stable")
        return of[a[by]], starts[of[a[by]]], a[by], z[by], runs[by]

    def _remembered(self, key: tuple, what):
        """What a function says of a key, kept for KEPT of them."""
        seen = self.__dict__.setdefault("_remembered_", {})
        if key not in seen:
            if len(seen) >= KEPT:
                seen.clear()
            seen[key] = what(*key[1:])
        return seen[key]

    def _fixed(self, chain: tuple, run: str, before: str, after: str) -> str | None:
        """The inverse of a run by a chain, if it decodes into known characters and looks sounder."""
        got = invert(run, chain)
        if got is not None and got != run and _WIDE.search(got) and self._plausible(got):
            if self.total(got.join((before, after))) - self.total(run.join((before, after))) > 4:
                return got
        return None

    def _undoes(self, run: str, before: str, after: str, reader: str) -> bool:
        """Whether a chain of UTF-8 read by the reader, predicted or not, inverts a run."""
        return any(c[0][0] == "utf-8" and c[-1][1] == reader and self._remembered(("fixed", c, run, before, after), self._fixed) is not None for c in self.classes)

    def _hopeless(self, run: str, before: str, after: str) -> bool:
        """Whether a stretch alone makes no text garbled: no chain explains it better, or it is usual, or no inverse has only known characters."""
        idx = features(run.join((before, after)))
        part, own = self._score(idx)
        if part.max() - own <= STRETCH_MARGIN or self.base[idx].mean() > self.typical - 1:
            return True
        return not any((back := invert(run, self.classes[c])) is not None and back != run and self._plausible(back) for c in np.argsort(-part)[:6].tolist())

    def _worth(self, texts: list[str], sure: list[bool]) -> list[bool]:
        """Which of the texts `judge` may find garbled: the sure ones, those with a run that a chain may invert, and those that a chain
        explains better, or a stretch of them that is not hopeless. What it learns of the stretches and runs is kept for `judge` in _seen.
        """
        out, self._seen = list(sure), {}
        joined, (codes, starts) = "\n".join([*texts, ""]), joined_codes(texts)
        runs = [False] * len(texts)
        for reader, pattern in self._valid.items():
            for i in np.unique(np.searchsorted(starts, sequences(codes, reader), "right") - 1).tolist():
                runs[i] = runs[i] or any(self._remembered(("undoes", m.group(), texts[i][max(m.start() - 1, 0) : m.start()], texts[i][m.end() : m.end() + 1], reader), self._undoes) for m in pattern.finditer(texts[i]))
        t, start, a, z, run = self._spans(texts)
        near = [joined[x:y] for x, y in zip(np.maximum(a - 1, start).tolist(), np.minimum(z + 1, starts[t + 1] - 1).tolist())]
        number = {x: i for i, x in enumerate(dict.fromkeys(near))}
        of = np.array([number[x] for x in near], np.int64)
        high, sums = self._explained(list(number))
        # the bigrams of a text are those of its runs
        whole = np.add.reduceat(sums[of[run]], np.searchsorted(t[run], np.arange(len(texts))), axis=0)
        n = self.per_script.shape[1]
        better = whole[:, n:].max(1) > whole[:, :n].max(1) + (STRETCH_MARGIN - SLACK)
        if better.any():
            better[better] = self._explained([texts[i] for i in np.flatnonzero(better).tolist()])[0]
        open_: list[dict] = [{} for _ in texts]
        k = np.flatnonzero(high[of])
        for i, x, y in zip(t[k].tolist(), (a - start)[k].tolist(), (z - start)[k].tolist()):
            open_[i][x, y] = None
        for i, (x, far) in enumerate(zip(texts, better.tolist())):
            if out[i] or runs[i] or far or not all(self._remembered(("hopeless", x[y:w], x[max(y - 1, 0) : y], x[w : w + 1]), self._hopeless) for y, w in open_[i]):
                out[i] = True
                self._seen[x] = runs[i], list(open_[i])
        return out

    def found(self, texts: list[str]) -> list[tuple[int, tuple]]:
        """(number, what `judge` says) of the garbled ones of the texts."""
        wide = [i for i, t in enumerate(texts) if not t.isascii()]
        if len(wide) < len(texts):
            return [(wide[i], j) for i, j in self.found([texts[i] for i in wide])] if wide else []
        if not texts:
            return []
        codes, starts = joined_codes(texts)
        kind = kinds(codes)
        alarm = np.logical_or.reduceat(kind & ALARM > 0, starts[:-1])
        n = np.add.reduceat(kind & EAST > 0, starts[:-1], dtype=np.int64)
        alarm |= (0 < n) & (n <= 6) & (np.diff(starts) - 1 >= 12 * n)  # as `island`
        on = np.flatnonzero(alarm | (self._windows(texts) >= self.first)).tolist()
        if not self.fitted or not self.classes:
            return [(i, j) for i in on if (j := self.judge(texts[i]))[0]]
        long = [i for i in on if len(texts[i]) > LONG]
        out, k, on = [(i, j) for i in long if (j := self.judge(texts[i]))[0]], 0, [i for i in on if len(texts[i]) <= LONG]
        while k < len(on):
            some, size = [], 0
            while k < len(on) and size < CHUNK:
                some.append(on[k])
                size += len(texts[on[k]])
                k += 1
            worth = self._worth([texts[i] for i in some], alarm[some].tolist())
            out += [(i, j) for i, w in zip(some, worth) if w and (j := self.judge(texts[i]))[0]]
            self._seen = {}
        return sorted(out, key=lambda x: x[0])

    @property
    def _valid(self) -> dict[str, regex.Pattern]:
        """Per one-byte reader: the character sequences that are UTF-8 sequences of bytes."""
        if "_valid_" not in self.__dict__:
            out = {}
            for b in {c[-1][1] for c in self.classes if c[0][0] == "utf-8" and c[-1][1] not in MULTI}:
                ch = byte_table(b)[0]
                cls = lambda lo, hi: "[" + "".join(regex.escape(ch[i]) for i in range(lo, hi)) + "]"
                cont = cls(0x80, 0xC0)
                out[b] = regex.compile(f"(?:{cls(0xC2, 0xE0)}{cont}|{cls(0xE0, 0xF0)}{cont}{{2}}|{cls(0xF0, 0xF5)}{cont}{{3}})+")
            self.__dict__["_valid_"] = out
        return self._valid_

    def judge(self, text: str) -> tuple[bool, tuple | None, str | None]:
        """(garbled?, chain, restored text or None)."""
        bad, chain, got = self._judge(text)
        if bad and (got is None or (chain[0][0] != "utf-8" and sum(c > "\x7f" for c in _changed(text, got)[0]) <= 3)) and _REWRITTEN.search(text) and not _ALARM.search(text):
            # other writings of sound characters (problem 1), printed hyphens and page numbers are no wrong decoding
            plain = by_character(_HYPHENED.sub(r"\1", _PAGE_NUMBER.sub("", text)).translate(_RAISED))
            plain = TOKEN.sub(lambda m: table_form(m.group()) if in_doubt(m.group()) else m.group(), plain)
            if plain != text and not self._judge(plain)[0]:
                return False, None, None
        return bad, chain, got

    def _judge(self, text: str) -> tuple[bool, tuple | None, str | None]:
        if text.isascii():
            return False, None, None
        alarm = bool(_ALARM.search(text))
        if not self.fitted or not self.classes:
            return alarm, None, None
        ll, sound = self._score(features(text))
        # chains in the order of the classifier's scores: of the whole text, then of its stretches
        predicted = np.argsort(-ll - self.prior)[:TOP].tolist()
        out, chain = self._undone(text, predicted)
        if chain is not None and self.level(out) > self.typical and not _ALARM.search(out):
            return True, chain, out
        spans = self._stretches(text)
        more = dict.fromkeys(predicted)
        for _, _, part in spans:
            more |= dict.fromkeys(np.argsort(-part - self.prior)[:TOP_STRETCH].tolist())
        if len(more) > len(predicted):
            out, chain = self._undone(text, list(more))
            if chain is not None and self.level(out) > self.typical:
                return True, chain, out
        best = (out, chain) if chain is not None else None
        order = self._strict_first(np.argsort(-ll)[:TOP].tolist())
        alone = island(text)
        if alone:
            order = list(dict.fromkeys([*self.eastern, *order]))
        if alarm or best or alone or ll.max() - sound > 3:
            for c in order:
                got = self._restore(text, self.classes[c])
                if got is not None and (best is None or self.level(got) > self.level(best[0])):
                    best = (got, self.classes[c])
                    break
            if best:
                return True, best[1], best[0]
            if alone and ll.max() - sound <= 3 and not alarm:
                return False, None, None
            top = self.classes[int(ll.argmax())]
            if alarm or (ll.max() - sound > 10 and self.base[features(text)].mean() < self.typical - 1.5):
                return True, top, None
        # a part of the text may be garbled and the rest sound
        for a, z, part in spans:
            run = text[a:z]
            if len(run) == len(text) or self.base[features(text[max(0, a - 1) : z + 1])].mean() > self.typical - 1:
                continue
            for c in self._strict_first(np.argsort(-part)[:6].tolist()):
                back = invert(run, self.classes[c])
                if back is None or back == run or not self._plausible(back):
                    continue
                got = text[:a] + back + text[z:]
                if self._sounder(text, got, self.classes[c]):
                    return True, self.classes[c], got
        return False, None, None

    def _parts(self, text: str) -> list[tuple[int, int]]:
        """Places that may be garbled in sound text: runs of non-ASCII letters, of other than East Asian letters in East Asian
        text, and stretches around bigrams that sound text does not have, with and without their outermost characters."""
        out = [m.span() for m in _RUN.finditer(text)]
        if _EAST.search(text):
            out += [m.span() for m in _WEST.finditer(text)]
        sizes = [len(c.encode("utf-8", "surrogatepass")) for c in text]
        owner = np.repeat(np.arange(len(text)), sizes)
        idx, on = bigrams(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
        odd = np.flatnonzero(on & (self.odds[idx] >= 100))
        if len(odd):
            chars = np.unique(np.concatenate([owner[odd], owner[odd + 1]]))
            for g in np.split(chars, np.flatnonzero(np.diff(chars) > 4) + 1):
                a, z = int(g[0]), int(g[-1]) + 1
                out += [(a + i, z - j) for i in (0, 1) for j in (0, 1) if a + i < z - j]
        return list(dict.fromkeys(out))

    def _strict_first(self, order: list[int]) -> list[int]:
        """Chains written in UTF-8 first: their inverse decodes by chance almost never."""
        return sorted(order, key=lambda c: self.classes[c][0][0] != "utf-8")

    def _restore(self, text: str, chain) -> str | None:
        """The inverse of the text, or of its runs one by one, if it decodes strictly into known characters and looks
        sounder than the text."""
        got = invert(text, chain)
        if got is None:
            def fix(m):
                part = invert(m.group(), chain)
                return part if part is not None and self._plausible(part) else m.group()

            got = _RUN.sub(fix, text)
        return got if got != text and self._plausible(got) and self._sounder(text, got, chain) else None

    def _sounder(self, text: str, got: str, chain) -> bool:
        """Whether an inverse is believable: no mixed words, in keeping with the unchanged rest, and more probable."""
        if _MIXED.search(got) and (chain[-1][1] not in MULTI or len(_MIXED.findall(got)) > len(_MIXED.findall(text))):
            return False
        if len(_HUMP.findall(got)) > len(_HUMP.findall(text)):
            return False
        old, new, rest = _changed(text, got)
        if chain[-1][1] in MULTI and chain[-1][1] != "utf-8":
            # few characters of an eastern reader: they must be alone in their script
            if 0 < (n := len(_EAST.findall(old))) < 3 and _EAST.search(rest):
                return False
        for script in _SCRIPTS[:-1]:
            # a letter or two of a script for others of it, the rest being sound, is a misprint at most
            if len(old) <= 2 and script.search(old) and script.search(new) and script.search(rest):
                return False
        for script in _SCRIPTS:
            # a sound rest in another script speaks against a part that changes script
            if len(script.findall(rest)) >= 3 and not script.search(new) and any(o.search(new) for o in _SCRIPTS):
                return False
        return self.total(got) > self.total(text) + 5 and self.level(got) > self.typical - 1.0

    def suspect(self, text: str, window: float) -> bool:
        """Whether a text is worth judging."""
        return window >= self.first or bool(_ALARM.search(text)) or island(text)

    def flags(self, texts: list[str]) -> list[bool]:
        bad = {i for i, _ in self.found(texts)}
        return [i in bad for i in range(len(texts))]

    def sound(self, texts: list[str]) -> list[bool]:
        return [not f for f in self.flags(texts)]


def training_texts(rows: DataFrame, key: str, text: str, sample: int = SAMPLE) -> list[str]:
    """A bounded sample of non-ASCII rows, the first `sample` by a hash of their keys, for trials; no query fits on it.

    A count of the rows sets the share of hashes that is looked at, so that no more than about twice the sample is gathered
    however many tasks there are.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    odd = rows.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(h.alias("h"), F.col(text).alias("t"))
    n = odd.count()
    share = int(min(1.0, 1.5 * sample / max(n, 1) + 100 / max(n, 1)) * (1 << 30))
    return [r.t for r in odd.where(F.col("h") < share).orderBy("h", "t").limit(sample).collect()]


# ---------------------------------------------------------------- the fit over all rows


_ORDER = chains()
_WHOLE = sum(1 << i for i, c in enumerate(_ORDER) if c[0][1] in MULTI)  # chains whose reader takes several bytes as one character


@lru_cache(maxsize=None)
def _bits(c: str) -> tuple[int, int]:
    """(chains that can write a character, chains that change it), as bits in the order of chains()."""
    raws = {a: written(c, a) for a in ("utf-8", *LEGACY)}
    can = change = 0
    for i, chain in enumerate(_ORDER):
        a, b = chain[0]
        if (raw := raws[a]) is not None:
            can |= 1 << i
            if b in MULTI or len(raw) > 1 or byte_table(b)[0][raw[0]] != c:
                change |= 1 << i
    return can, change


def applicable(text: str) -> int:
    """The chains that can garble a text, as bits."""
    can, change = (1 << len(_ORDER)) - 1, 0
    for c in set(text):
        if c > "\x7f":
            x, y = _bits(c)
            can &= x
            change |= y
    return can & change


@lru_cache(maxsize=None)
def _bit_rows() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Per code point the row of its _bits, filled in by `masks` as they come; and the rows, each as words of 63 bits."""
    return np.full(0x110000, -1, np.int32), [[], []]


def masks(codes: np.ndarray, starts: np.ndarray) -> list[int]:
    """`applicable` of many texts: the code points that are not ASCII, and where those of each text start (none is without)."""
    at, rows = _bit_rows()
    words = range(0, len(_ORDER), 63)
    if (at[codes] < 0).any():
        for x in np.unique(codes[at[codes] < 0]).tolist():
            at[x] = len(rows[0])
            for row, bits in zip(rows, _bits(chr(x))):
                row.append([bits >> k & (1 << 63) - 1 for k in words])
    can, change = (np.array(row, np.int64)[at[codes]] for row in rows)
    both = np.bitwise_and.reduceat(can, starts, axis=0) & np.bitwise_or.reduceat(change, starts, axis=0)
    sets, of = np.unique(both, axis=0, return_inverse=True)
    values = [sum(w << k for w, k in zip(row, words)) for row in sets.tolist()]
    return [values[i] for i in of.ravel().tolist()]


def groups_of(codes: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    """`group_of` of n texts: their code points, and the text of each."""
    kind = kinds(codes) // SCRIPT
    names = _numbers()[1]
    on = np.flatnonzero(kind > 0)
    key, first, many = np.unique(owner[on] * len(names) + kind[on], return_index=True, return_counts=True)
    best = np.lexsort((first, -many, key // len(names)))
    text, at = np.unique((key // len(names))[best], return_index=True)
    out = ["LATIN"] * n
    for i, k in zip(text.tolist(), (key % len(names))[best[at]].tolist()):
        out[i] = names[k]
    return out


def text_counts(texts: DataFrame) -> DataFrame:
    """(part, a, b, c, n): what the fit counts over all texts (t), none of them ASCII.

    `rows` by script and chains; `char` rows with a character; `seen` rows with a bucket of bigrams; `pair` adjacent characters, one of them
    not ASCII, by script and chains; `word` words that are not ASCII, by script and those chains whose readers need whole words.
    """

    def run(batches):
        one: Counter = Counter()
        seen = np.zeros(BUCKETS, np.int64)
        pairs: dict[tuple[str, int], list] = {}
        size = 0

        def merged(ps):
            k = np.concatenate([x for x, _ in ps])
            k, of = np.unique(k, return_inverse=True)
            return k, np.bincount(of, np.concatenate([x for _, x in ps])).astype(np.int64)

        def out():
            rows = [(*k, n) for k, n in one.items()]
            rows += [("seen", str(b), "", "", int(seen[b])) for b in np.flatnonzero(seen).tolist()]
            for (g, m), ps in pairs.items():
                rows += [("pair", g, f"{m:x}", chr(k >> 21) + chr(k & 0x1FFFFF), n) for k, n in zip(*(x.tolist() for x in merged(ps)))]
            one.clear()
            pairs.clear()
            seen[:] = 0
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, [pa.string()] * 4 + [pa.int64()])], names=["part", "a", "b", "c", "n"])

        for ts in (b.column(0)[k : k + 4000].to_pylist() for b in batches for k in range(0, b.num_rows, 4000)):
            pad = np.frombuffer("".join(f" {t} " for t in ts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            starts = np.cumsum([0, *(len(t) + 2 for t in ts)])
            of = np.repeat(np.arange(len(ts)), np.diff(starts))
            wide = np.flatnonzero(pad > 0x7F)
            begin = np.searchsorted(of[wide], np.arange(len(ts)))
            gs, ms = groups_of(pad[wide], of[wide], len(ts)), masks(pad[wide], begin)
            sorts = {k: i for i, k in enumerate(dict.fromkeys(zip(gs, ms)))}
            sort = np.array([sorts[k] for k in zip(gs, ms)], np.int64)
            for (g, m), n in Counter(zip(gs, ms)).items():
                one["rows", g, f"{m:x}", ""] += n
            chars, n = np.unique(np.unique(of[wide] << 21 | pad[wide]) & 0x1FFFFF, return_counts=True)
            for x, y in zip(chars.tolist(), n.tolist()):
                one["char", chr(x), "", ""] += y
            # both characters of a pair lie in one text: the spaces between two texts are ASCII
            on = np.unique(np.concatenate([wide - 1, wide]))
            k, n = np.unique(sort[of[on]] << 42 | pad[on] << 21 | pad[on + 1], return_counts=True)
            ends = np.searchsorted(k >> 42, np.arange(len(sorts) + 1))
            for (key, i) in sorts.items():
                pairs.setdefault(key, []).append((k[ends[i] : ends[i + 1]] & (1 << 42) - 1, n[ends[i] : ends[i + 1]]))
            for t, g, m in zip(ts, gs, ms):
                w = f"{m & _WHOLE:x}"
                for x in t.split(" "):
                    if not x.isascii():
                        one["word", g, w, x] += 1
            idx, on, owner = joined_bigrams(ts)
            seen += np.bincount(np.unique(owner[on].astype(np.int64) << 16 | idx[on]) & 0xFFFF, minlength=BUCKETS)
            size += len(k)
            if size > FLUSH:
                for key, ps in pairs.items():
                    pairs[key] = [merged(ps)]
                size = sum(len(ps[0][0]) for ps in pairs.values())
            if len(one) + size > FLUSH:
                yield out()
                size = 0
        yield out()

    return texts.mapInArrow(run, "part string, a string, b string, c string, n bigint").groupBy("part", "a", "b", "c").agg(F.sum("n").alias("n"))


def joined_bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features of many texts at once: bucket, whether it counts, and number of its text for each adjacent byte pair."""
    raws = [f" {t} ".encode("utf-8", "surrogatepass") for t in texts]
    idx, on = bigrams(np.frombuffer(b"".join(raws) + b" ", np.uint8))
    return idx, on, np.repeat(np.arange(len(raws)), [len(r) for r in raws])


def quotas(sizes: dict[str, int], per_class: int = PER_CLASS) -> dict[str, float]:
    """The weight of a row of each script in a class: all scripts weigh alike, together as much as per_class rows, but no row more than
    one."""
    left, out = float(per_class), {}
    for i, (g, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        part = min(n, left / (len(sizes) - i))
        out[g] = part / n
        left -= part
    return out


def pair_vector(chain, chars: list[str], first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts of the bigrams that a chain makes of weighted pairs of adjacent characters (numbers in `chars`); what lies inside a
    character is counted with the pair that it is the first of."""
    on = np.flatnonzero(weight)
    first, last, weight = first[on], last[on], weight[on]
    used = np.unique(np.concatenate([first, last]))
    made = [(garble(chars[c], chain) if chain else chars[c]).encode("utf-8", "surrogatepass") for c in used.tolist()]
    sizes = np.array([len(x) for x in made], np.int64)
    raw = np.frombuffer(b"".join(made) + b" ", np.uint8)
    ends = np.cumsum(sizes)
    first, last = np.searchsorted(used, first), np.searchsorted(used, last)
    own = np.repeat(np.bincount(first, weight, len(used)), sizes)
    own[ends - 1] = 0  # from one character's bytes to the next one's
    idx, wide = bigrams(raw)
    out = np.bincount(idx[wide], own[wide], BUCKETS)
    idx, wide = bigrams(np.stack([raw[ends - 1][first], raw[ends - sizes][last]], 1).ravel())
    idx, wide = idx[::2], wide[::2]
    return out + np.bincount(idx[wide], weight[wide], BUCKETS)


def word_vectors(words: DataFrame) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of the bigrams that each chain whose reader needs whole words makes of the words (a, b, c, n), by script."""

    def run(batches):
        total: dict[tuple[int, str], list] = {}

        def merged(ps):
            v = np.bincount(np.concatenate([k for k, _ in ps]), np.concatenate([w for _, w in ps]), BUCKETS)
            live = np.flatnonzero(v)
            return live.astype(np.int32), v[live]

        for batch in batches:
            like: dict[tuple[str, int], tuple[list, list]] = {}
            for g, m, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                ws, ns = like.setdefault((g, int(m, 16)), ([], []))
                ws.append(w)
                ns.append(n)
            # every word has a space of its own on both sides
            joined = {k: (f" {'  '.join(ws)} ", np.array(ns, np.float64)) for k, (ws, ns) in like.items()}
            for i, ((a, b), *_) in enumerate(_ORDER):
                of: dict[str, list] = {}
                for (g, m), x in joined.items():
                    if m >> i & 1:
                        of.setdefault(g, []).append(x)
                for g, xs in of.items():
                    # the spaces at the end close a sequence that lacks bytes
                    raw = np.frombuffer(read_as("".join([*(x for x, _ in xs), "   "]).encode(a), b).encode("utf-8", "surrogatepass"), np.uint8)
                    ns = np.concatenate([n for _, n in xs])
                    idx, wide = bigrams(raw)
                    own = ns[np.minimum((np.cumsum(raw == 32)[:-1] - 1) // 2, len(ns) - 1)]
                    total.setdefault((i, g), []).append((idx[wide], own[wide]))
                    total[i, g] = [merged(total[i, g])]
        rows = [(i, g, *merged(ps)) for (i, g), ps in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary())],
            names=["i", "g", "k", "w"])

    out: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
    for r in words.mapInArrow(run, "i int, g string, k binary, w binary").toLocalIterator():
        k, w = np.frombuffer(r.k, np.int32), np.frombuffer(r.w, np.float64)
        out[r.i, r.g] = added(out[r.i, r.g], (k, w)) if (r.i, r.g) in out else (k, w)
    return out


def added(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The sum, or the difference, of two lists of (keys, counts), the keys in order and each once."""
    k, of = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    n = np.bincount(of, np.concatenate([x[1], sign * y[1]]), len(k))
    return k[n != 0], n[n != 0]


class Counts:
    """text_counts in the driver, the words as what the chains make of them. Counts of texts that are left out are taken off."""

    def __init__(self, texts: DataFrame):
        counts = cut(text_counts(texts))
        self.rows: Counter = Counter()
        self.chars: Counter = Counter()
        self.seen = np.zeros(BUCKETS)
        self.masks: dict[tuple[str, int], int] = {}
        key, many = array("q"), array("q")
        for part, a, b, c, n in counts.where("part <> 'word'").toLocalIterator():
            if part == "rows":
                self.rows[a, int(b, 16)] = n
            elif part == "char":
                self.chars[a] = n
            elif part == "seen":
                self.seen[int(a)] = n
            else:
                key.append(self.masks.setdefault((a, int(b, 16)), len(self.masks)) << 42 | ord(c[0]) << 21 | ord(c[1]))
                many.append(n)
        self.pairs = self._ordered(np.array(key, np.int64), np.array(many, np.float64))
        self.words = word_vectors(counts.where("part = 'word'").select("a", "b", "c", "n"))

    @staticmethod
    def _ordered(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(k)
        return k[by], n[by]

    def take_off(self, other: Counts) -> None:
        self.rows -= other.rows
        self.chars -= other.chars
        self.seen -= other.seen
        number = np.array([self.masks[g] for g in other.masks], np.int64)
        k, n = other.pairs
        if len(k):
            self.pairs = added(self.pairs, self._ordered(number[k >> 42] << 42 | k & (1 << 42) - 1, n), -1)
        for g, v in other.words.items():
            self.words[g] = added(self.words[g], v, -1)


def level_counts(texts: DataFrame, det: Detector) -> tuple[float, float]:
    """(first, typical) over all texts: quantiles of the windows' sums and of the levels, to a hundredth and a thousandth."""
    sent = texts.sparkSession.sparkContext.broadcast(det)

    def run(batches):
        d, seen = sent.value, Counter()
        per_script = d.per_script.astype(np.float64)
        for ts in (b.column(0)[k : k + 2000].to_pylist() for b in batches for k in range(0, b.num_rows, 2000)):
            seen.update(("w", int(x)) for x in np.rint(d._windows(ts) * 100).tolist())
            idx, on, owner = joined_bigrams(ts)
            n = np.bincount(owner[on], minlength=len(ts))
            ends = np.concatenate([[0], np.cumsum(n)])[:-1]
            level = np.add.reduceat(per_script[idx[on]], ends[n > 0], axis=0).max(1) / n[n > 0] if n.any() else np.zeros(0)
            seen.update(("l", int(x)) for x in np.rint(level * 1000).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["k", "x", "n"])

    got: dict[str, list] = {"w": [], "l": []}
    for r in texts.mapInArrow(run, "k string, x bigint, n bigint").groupBy("k", "x").agg(F.sum("n").alias("n")).collect():
        got[r.k].append((r.x, r.n))
    sent.destroy()
    out = []
    for k, q, unit in (("w", 0.97, 100), ("l", 0.02, 1000)):
        x, n = np.array(sorted(got[k])).T
        out.append(float(x[np.searchsorted(np.cumsum(n), q * (n.sum() - 1) + 1)]) / unit)
    return min(out[0], 90.0), out[1]


def fit_once(texts: DataFrame, seldom: float, counts: Counts | None = None) -> Detector:
    """A detector whose counts and thresholds are of all of the texts (t), all taken for sound."""
    counts = counts or Counts(texts)
    det = Detector([])
    n = sum(counts.rows.values())
    if n < LEAST_ROWS:
        return det
    det.fitted = True
    by_mask = sorted((g, m, k) for (g, m), k in counts.rows.items())
    place = {(g, m): i for i, (g, m, _) in enumerate(by_mask)}
    mask_of = np.array([place.get(g, -1) for g in counts.masks], np.int32)[counts.pairs[0] >> 42]
    pairs, pair_of = np.unique(counts.pairs[0] & (1 << 42) - 1, return_inverse=True)
    codes, ends = np.unique(np.concatenate([pairs >> 21, pairs & 0x1FFFFF]), return_inverse=True)
    chars, first, last = [chr(c) for c in codes.tolist()], ends[: len(pairs)], ends[len(pairs) :]

    def weighed(per_mask) -> np.ndarray:
        return np.bincount(pair_of, np.array(per_mask, np.float64)[mask_of] * counts.pairs[1], len(pairs))

    sizes: dict[str, int] = {}
    for g, _, k in by_mask:
        sizes[g] = sizes.get(g, 0) + k
    per = {g: (k, pair_vector((), chars, first, last, weighed([float(h == g) for h, _, _ in by_mask]))) for g, k in sizes.items()}
    det.set_sound(n, counts.chars, per, counts.seen, seldom)
    det.first, det.typical = level_counts(texts, det)
    main, weights = set(main_groups(sizes)), {}
    for i in range(len(_ORDER)):
        on: Counter = Counter()
        for g, m, k in by_mask:
            if m >> i & 1 and g in main:
                on[g] += k
        if sum(on.values()) >= 3:
            weights[i] = quotas(on)
    vectors = {}
    for i, w in weights.items():
        if _WHOLE >> i & 1:
            vectors[i] = np.zeros(BUCKETS)
            for g in w:
                k, v = counts.words.get((i, g), ((), ()))
                vectors[i][np.asarray(k, np.int64)] += w[g] * np.asarray(v)
        else:
            vectors[i] = pair_vector(_ORDER[i], chars, first, last, weighed([w.get(g, 0.0) if m >> i & 1 else 0.0 for g, m, _ in by_mask]))
    det.set_chains([_ORDER[i] for i in weights], list(vectors.values()))
    return det


def fit_all(texts: DataFrame) -> Detector:
    """The detector of all texts (t): those that a fit finds garbled are left out of the next one, and their counts taken off."""
    sound, counts = texts, Counts(texts)
    for seldom in (0.004, 0.004, 0.0):
        det = fit_once(sound, seldom, counts)
        if seldom and det.fitted:
            sent = texts.sparkSession.sparkContext.broadcast(det)

            def run(batches, sent=sent):
                for batch in batches:
                    ts = batch.column(0)
                    yield pa.RecordBatch.from_arrays([ts, pa.array(sent.value.sound(ts.to_pylist()), pa.bool_())], names=["t", "sound"])

            judged = cut(sound.mapInArrow(run, "t string, sound boolean"))
            sound = judged.where("sound").select("t")
            counts.take_off(Counts(judged.where("not sound").select("t")))
            sent.destroy()
    return det


def all_known(rows: DataFrame, key: str, text: str, detector: Detector) -> set[str]:
    """The detector's known characters and those that the rest of the rows adds.

    Rows with a character unknown so far are judged. A character is known if KNOWN_ROWS rows that are not found garbled have
    it, and KNOWN_SHARE of its own rows, as a garbled row that was missed must not make its characters known. What comes to
    the driver is bounded by the alphabet.
    """
    sent = rows.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        det = sent.value
        usual = det.known | set(map(chr, range(0x80)))
        for batch in batches:
            odd = [(k, t, new) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not usual.issuperset(t) and (new := {c for c in set(t) - usual if not _ALARM.match(c)})]
            alarm = [bool(_ALARM.search(t)) for _, t, _ in odd]
            rest = iter(det.flags([t for (_, t, _), a in zip(odd, alarm) if not a]))
            got = [(k, c, bad) for (k, _, new), a in zip(odd, alarm) for bad in [a or next(rest)] for c in sorted(new)]
            cols = list(zip(*got)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.bool_()))], names=["k", "c", "bad"])

    new = rows.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).cast("string"), text).mapInArrow(run, "k string, c string, bad boolean").distinct()
    counts = new.groupBy("c").agg(F.count("*").alias("n"), F.count_if(~F.col("bad")).alias("sound"))
    got = {r.c for r in counts.where((F.col("sound") >= KNOWN_ROWS) & (F.col("sound") >= KNOWN_SHARE * F.col("n"))).collect()}
    sent.destroy()
    return detector.known | got


def fitted_detector(spark: SparkSession, d: str) -> Detector:
    """The detector fitted on the sentences table of a folder, anew at each call: no query's time leaves out its fit."""
    rows = table(spark, d, "sentences")
    det = fit_all(cut(rows.select(F.col("originalText").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]") & ~F.col("t").rlike(r"[\x{80}-\x{84}\x{86}-\x{9f}\x{e000}-\x{f8ff}\x{fffd}]")).distinct()))
    if det.fitted:
        det.known = all_known(rows, "id", "originalText", det)
    return det


def judged_rows(df: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The garbled rows of df with `chain` and `restored` (null where the inverse does not decode)."""
    sent = df.sparkSession.sparkContext.broadcast(detector)
    keep = [c for c in df.columns if c != text]

    def run(batches):
        det = sent.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            got = det.found(texts)
            take = pa.array([i for i, _ in got], pa.int64())
            cols = [batch.column(c).take(take) for c in keep]
            cols.append(pa.array([" then ".join(f"{a} read as {b}" for a, b in j[1]) if j[1] else None for _, j in got], pa.string()))
            cols.append(pa.array([j[2] for _, j in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "chain", "restored"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", chain string, restored string"
    return df.where(F.col(text).rlike(r"[^\x00-\x7f]")).mapInArrow(run, schema)


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, sentence_id, text) of originalText and pdfOriginalText."""
    s = table(spark, d, "sentences").select(F.lit("originalText").alias("field_name"), F.col("id").alias("sentence_id"), F.col("originalText").alias("text"))
    r = table(spark, d, "ai_correction_reviews").select(F.lit("pdfOriginalText").alias("field_name"), "sentenceId", F.col("pdfOriginalText").alias("text"))
    return s.unionByName(r.withColumnRenamed("sentenceId", "sentence_id"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return judged_rows(text_rows(spark, d), fitted_detector(spark, d)).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return judged_rows(text_rows(spark, d), fitted_detector(spark, d)).select("field_name", "sentence_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
