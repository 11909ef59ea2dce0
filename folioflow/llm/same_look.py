"""Problem 1: text that looks the same and is written with other characters.

Tokens of the corpus that are cleanly written (one script, composed, no ignorable) form the vocabulary. A token written
otherwise is walked through a trie of the vocabulary by a weighted edit automaton: following an edge by a look-alike costs
nothing, nor does skipping an ignorable; every other edit costs one, and only walks within the cost limit (0 by default)
arrive. Of the spellings reached, an ASCII one is taken first, then the one least in code point order: the canonical
spelling of the whole class of look-alikes, so equal looks get equal spellings. A token that reaches nothing is
normalised by the table of look-alikes. What is no token (East Asian text, marks, spaces) is normalised by character.

Kept apart, because one can see it: letter case, accents, raised and lowered digits, other digits and words, line breaks, and
joiners where they shape letters (ZWJ and ZWNJ next to Arabic or Indic letters). Any run of spaces counts as one
space; outer white space is dropped.

Null texts are no case and stay null; an empty or blank text is normalised to an empty one and is no case. Redelivered rows
count once.

Scale: the vocabulary and the tokens to look up are never gathered: both are shuffled by hashes of their skeletons (with a
cost limit of n, also of the skeletons without up to n characters, so that all within n edits meet) into buckets, as many as the
tokens need, each of which builds its own small trie. Only rows that hold an odd character leave the JVM.
Mappings are joined back salted, as one token can stand in a third of the rows. Pairs are made only between different texts
of one look, with the rows of one text salted on one side.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import cut
from folioflow.sources.tables import table

SALTS, PER_BUCKET, FLUSH = 8, 2000, 300_000
#: Stands in a form for a token that is looked up; private use, so no text in one consistent form needs it.
MARK = "\ue010"

# Characters without a look of their own, spaces, and letters that look like ASCII letters.
IGNORABLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿᠎͏؜‪‫‬‭‮⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯" + "".join(map(chr, range(0xFE00, 0xFE10)))
SPACES = "\t\x0b\x0c\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
LETTERS = {
    "cyrillic": ("аеорсухіјѕһӏԁԛԝґАВЕКМНОРСТУХІЈЅԌԚԜЗҮ", "aeopcyxijshldqwrABEKMHOPCTYXIJSGQW3Y"),
    "greek": ("οανρυικτχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oavpuiktxyABEZHIKMNOPTYXcj"),
    "armenian": ("օհսոցզյՕՍՏԼ", "ohungqjOUSL"),
    "cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiAJEWMHYGZRWVSLCPKdGB"),
    "lisu": ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
    "other": ("ɡɑıѵᴏᴄᴠᴡᴢⅼⅰⅴⅹⅽⅾⅿℓ‐‑−―⁃’ʼ", "gaivocvwzlivxcdml------—-''"),
}
_FIX = {"ґ": None, "З": None, "Ү": "Y", "υ": None, "ι": None, "κ": None, "τ": None, "χ": None, "γ": None, "ı": None, "−": None, "―": None, "’": None, "ʼ": "’", "⁃": None, "ℓ": None}


@lru_cache(maxsize=1)
def look_table() -> dict[str, str]:
    """Look-alike letter -> ASCII letter. Pairs that one can tell apart in ordinary print are taken out."""
    out = {}
    for a, b in LETTERS.values():
        out |= {x: y for x, y in zip(a, b) if x not in _FIX}
    out |= {x: y for x, y in _FIX.items() if y}
    out |= {"‐": "-", "‑": "-", "µ": "μ"}
    return out


@lru_cache(maxsize=1)
def width_table() -> dict[int, str | None]:
    """Character -> its form of ordinary width: wide, narrow and ligature compatibility forms, spaces, ignorables dropped."""
    out: dict[int, str | None] = {}
    for c in [*range(0xFF01, 0xFFEF), *range(0xFB00, 0xFB07), *range(0x3130, 0x318F), 0x2126, 0x212A, 0x212B, 0xB5, 0x2103, 0x2109, 0x2011, *range(0x2000, 0x200B)]:
        d = unicodedata.decomposition(chr(c))
        if d.startswith(("<wide>", "<narrow>", "<compat>", "<noBreak>")) or (d and not d.startswith("<")):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    for c in range(0x1D400, 0x1D800):  # mathematical letters and digits
        d = unicodedata.decomposition(chr(c))
        if d.startswith("<font>"):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    out |= {ord(c): " " for c in SPACES}
    out |= {ord(c): None for c in IGNORABLE}
    return out


#: Joiners that shape the letters around them.
_JOINERS = regex.compile(r"(?<=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Malayalam}\p{Kannada}\p{Gujarati}])[‌‍](?=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Malayalam}\p{Kannada}\p{Gujarati}])")
_KEEP = {"‌": "", "‍": ""}
#: A token: letters (with their marks) of scripts that have look-alikes among each other.
TOKEN = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}][\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}\p{Mn}]*")
_DOTLESS = regex.compile("[ıȷ](?=[\u0300-\u0314])")
_SPACE = regex.compile(r" {2,}| ?\n ?")
ODD = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}ɡɑᴏᴄᴠᴡᴢⅼⅰⅴⅹⅽⅾⅿѵ]")
_CLEAR = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Latin}--[A-Za-z]]", regex.V1)


def by_character(text: str) -> str:
    """The text in ordinary width, composed, with single spaces and without ignorables; look-alike letters untouched."""
    if not text.isascii():
        if "‌" in text or "‍" in text:
            text = _JOINERS.sub(lambda m: _KEEP[m.group()], text)
        text = text.translate(width_table())
        if "ı" in text or "ȷ" in text:  # under a mark nobody sees whether the dot is there
            text = _DOTLESS.sub(lambda m: "i" if m.group() == "ı" else "j", text)
        text = unicodedata.normalize("NFC", text)
        if "" in text:
            text = text.replace("", "‌").replace("", "‍")
        text = text.replace("‐", "-").replace("‑", "-")
    else:
        text = text.translate({9: " ", 11: " ", 12: " "})
    return _SPACE.sub(lambda m: "\n" if "\n" in m.group() else " ", text).strip()


@lru_cache(maxsize=200_000)
def in_doubt(token: str) -> bool:
    """Whether a token has to be looked up: it mixes scripts, or none of its letters tells its script. A number that looks like a
    letter is a script of its own."""
    if token.isascii() or not ODD.search(token):
        return False
    looks = look_table()
    scripts = {unicodedata.name(c, "?").split()[0] if c.isalpha() else "NUMBER" for c in token if c.isalpha() or c in looks}
    return len(scripts) > 1 or all(c in looks or not c.isalpha() for c in token)


@lru_cache(maxsize=200_000)
def skeleton(token: str) -> str:
    """The token with every look-alike letter replaced by what it looks like."""
    looks = look_table()
    return "".join(looks.get(c, c) for c in token)


def table_form(token: str) -> str:
    """What becomes of a token that no vocabulary entry looks like: its look-alikes turned to ASCII letters, unless letters
    of its own script remain, which then take the others along."""
    flat = skeleton(token)
    rest = [c for c in flat if c.isalpha() and not c.isascii()]
    kinds = {unicodedata.name(c, "?").split()[0] for c in rest} - {"LATIN"}
    if len(kinds) == 1 and not any(unicodedata.name(c, "?").startswith("LATIN") for c in rest):
        alphabet = {"CYRILLIC": "cyrillic", "GREEK": "greek"}.get(kinds.pop())
        if alphabet:
            a, b = LETTERS[alphabet]
            looks = look_table()
            back = {y: x for x, y in zip(a, b) if looks.get(x) == y}
            if all(c in back or not c.isascii() or not c.isalpha() for c in flat):
                return "".join(back.get(c, c) for c in flat)
    return flat


class Trie:
    """Vocabulary trie, walked by a weighted edit automaton."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def reach(self, token: str, limit: int = 0) -> list[str]:
        """The vocabulary entries within `limit` of a token, the canonical one first."""
        found = self.costs(token, limit)
        return sorted(found, key=lambda w: (found[w], not w.isascii(), w))

    def costs(self, token: str, limit: int = 0) -> dict[str, int]:
        """The vocabulary entries within `limit` with their costs. State: (trie node, position in the token) -> least cost."""
        looks, same = look_table(), {}
        kin = _kin()
        states, seen, found = [(self.root, 0, 0)], {}, {}
        while states:
            node, i, cost = states.pop()
            key = (id(node), i)
            if seen.get(key, limit + 1) <= cost:
                continue
            seen[key] = cost
            if i == len(token):
                if "" in node:
                    found[node[""]] = min(cost, found.get(node[""], cost))
            else:
                c = token[i]
                if c in IGNORABLE:
                    states.append((node, i + 1, cost))
                base = looks.get(c, c)
                for x in same.setdefault(base, (base, *kin.get(base, ()))):
                    if x in node:
                        states.append((node[x], i + 1, cost))
                if cost < limit:
                    states.append((node, i + 1, cost + 1))
            if cost < limit:
                for x, nxt in node.items():
                    if x:
                        states.append((nxt, i, cost + 1))
                        if i < len(token):
                            states.append((nxt, i + 1, cost + 1))
        return found


@lru_cache(maxsize=1)
def _kin() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for x, y in look_table().items():
        out[y] = (*out.get(y, ()), x)
    return out


# ---------------------------------------------------------------- DataFrame side


def _bucket_keys(token: Column, limit: int) -> Column:
    """Hashes of a token's skeleton, and with a limit also of the skeletons without up to `limit` characters: equal for all
    look-alikes, and shared by any two tokens within the limit."""
    looks = {k: v for k, v in look_table().items() if len(v) == 1}
    flat = F.regexp_replace(F.translate(token, "".join(looks), "".join(looks.values())), f"[{IGNORABLE}]+", "")
    keys = F.array(flat)
    for _ in range(limit):
        without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, without))))
    return F.transform(keys, lambda k: F.xxhash64(k))


#: JVM test for text that only Python can bring into form: ignorables, odd spaces, wide, narrow and compatibility forms, marks
#: that could compose, jamo, and letters of one script beside another's.
_ODD_CHARS = (
    r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}"
    r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ff01}-\x{ffee}\x{fb00}-\x{fb06}\x{2126}\x{212a}\x{212b}\x{2103}\x{2109}\x{2010}\x{2011}"
    r"\x{b5}\x{3bc}\x{1100}-\x{11ff}\x{3099}\x{309a}\x{300}-\x{36f}\x{653}-\x{655}\x{93c}\x{3131}-\x{318e}\x{261}\x{251}\x{1d0f}\x{1d04}\x{1d20}-\x{1d22}\x{2170}-\x{217f}\x{475}\x{2bc}\x{131}\x{237}\x{1d400}-\x{1d7ff}]"
)
_ODD_LETTERS = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsLisu}]"


def odd_text(text: Column) -> Column:
    """Whether a text may need more than single spaces and trimming."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_ODD_CHARS + "|" + _ODD_LETTERS)


def plain_form(text: Column) -> Column:
    """The form of a text without odd characters: outer white space dropped, runs of spaces made one."""
    loose = F.lit(False)
    for x in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c"):
        loose = loose | text.contains(x)
    loose = loose | (F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) != text)
    t = F.regexp_replace(text, r"[ \t\x0b\x0c]*\n[ \t\x0b\x0c]*", "\n")
    return F.when(~loose, text).otherwise(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0b\x0c]+", " "), r"^\s+|\s+$", ""))


_CLEAN_WORD = regex.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+|[\u0400-\u052f]+|[\u0370-\u03ff\u1f00-\u1fff]+")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word): the distinct cleanly written tokens of all texts, made distinct within each task before the shuffle."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(_CLEAN_WORD.findall(t))
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])

    return texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string").distinct()


def segments(text: str) -> tuple[str, list[str]]:
    """(form by character with a mark for each doubtful token, the doubtful tokens in order)."""
    form = by_character(text)
    if not ODD.search(form):
        return form, []
    got: list[str] = []

    def put(m):
        if in_doubt(m.group()):
            got.append(m.group())
            return MARK
        return m.group()

    return TOKEN.sub(put, form.replace(MARK, " ")), got


def spellings(tokens: DataFrame, vocab: DataFrame, limit: int = 0, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(token, spelling): the canonical spelling of each doubtful token, by trie or else by table."""
    left = cut(tokens.select("token").distinct().withColumn("key", F.explode(_bucket_keys(F.col("token"), limit))))
    # whatever a token could reach shares a key with it, so only such entries travel on
    right = vocab.withColumn("key", F.explode(_bucket_keys(F.col("word"), limit))).join(left.select("key").distinct(), "key", "left_semi")
    buckets = max(16, left.count() // per_bucket + 1)
    left, right = (x.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")) for x in (left, right))

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(b["word"].unique().tolist())
        out = []
        for t in a["token"].unique().tolist():
            got = trie.costs(t, limit)
            best = min(got.items(), key=lambda x: (x[1], not x[0].isascii(), x[0]), default=None)
            out.append((t, best[0], best[1]) if best else (t, table_form(t), limit + 1))
        return pd.DataFrame(out, columns=["token", "spelling", "cost"])

    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(walk, "token string, spelling string, cost int")
    if not limit:  # one key a token, so one row
        return found.select("token", "spelling")
    best = F.min(F.struct("cost", F.col("spelling").rlike(r"[^\x00-\x7f]").alias("odd"), "spelling"))
    return found.groupBy("token").agg(best.alias("m")).select("token", "m.spelling")


def canonical_texts(rows: DataFrame, carry: list[str], limit: int = 0, salts: int = SALTS) -> DataFrame:
    """(*carry, form): each row's text in its one consistent form. `rows` has (row, text, *carry); a null text has a null form."""
    odd = odd_text(F.col("text"))
    plain = rows.where(F.col("text").isNull() | ~odd).select(*carry, plain_form(F.col("text")).alias("form"))

    def run(batches):
        for batch in batches:
            got = [segments(t) for t in batch.column("text").to_pylist()]
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[*carry, "form", "tokens"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    segs = cut(rows.where(odd).select(*carry, "text").mapInArrow(run, f"{kinds}, form string, tokens array<string>"))
    done = segs.where(F.size("tokens") == 0).select(*carry, "form")
    open_rows = segs.where(F.size("tokens") > 0)
    flat = open_rows.select("row", F.posexplode("tokens").alias("pos", "token")).distinct()
    names = spellings(flat, vocabulary(rows), limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    got = (
        flat.withColumn("salt", F.pmod(F.hash("row"), F.lit(salts))).join(names, ["token", "salt"])
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "spelling"))).alias("names"))
    )
    parts = F.split("form", MARK)
    whole = F.array_join(F.zip_with(parts, F.transform("names", lambda x: x["spelling"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    filled = open_rows.join(got, "row").select(*carry, whole.alias("form"))
    return plain.unionByName(done).unionByName(filled)


def look_pairs(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(row_a, row_b): rows of one form and different texts, the smaller row first. `rows` has (row, text).

    Rows are carried by hashes of form and text (96 bits each). Two texts that are their own forms differ in form, so one
    row of every pair has a text that is not its form: only those are replicated over the salts.
    """
    tagged = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.hash("text"))
    forms = canonical_texts(tagged, ["row", "t1", "t2"]).where(F.length("form") > 0)
    keyed = cut(forms.select("row", "t1", "t2", F.xxhash64("form").alias("f1"), F.hash("form").alias("f2")))
    changed = keyed.where((F.col("t1") != F.col("f1")) | (F.col("t2") != F.col("f2"))).distinct()
    left = changed.select("f1", "f2", F.col("row").alias("one"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    right = keyed.withColumn("salt", F.pmod(F.hash("row"), F.lit(salts)))
    hit = right.join(left, ["f1", "f2", "salt"]).where((F.col("t1") != F.col("u1")) | (F.col("t2") != F.col("u2")))
    return hit.select(F.least("row", "one").alias("row_a"), F.greatest("row", "one").alias("row_b")).where("row_a <> row_b").distinct()


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """(row, text) of originalText and pdfOriginalText."""
    s = table(spark, d, "sentences").select(F.concat(F.lit("s:"), "id").alias("row"), F.col("originalText").alias("text"))
    r = table(spark, d, "ai_correction_reviews").select(F.concat(F.lit("r:"), "sentenceId").alias("row"), F.col("pdfOriginalText").alias("text"))
    return s.unionByName(r).where(F.col("text").isNotNull())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(text_rows(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """(row, class, n_texts): each text row with its class of texts that look the same and the number of different texts in it.
    An empty form has the class of the empty text."""
    forms = canonical_texts(text_rows(spark, d).withColumn("t", F.xxhash64("text")), ["row", "t"])
    keyed = cut(forms.select("row", "t", F.xxhash64("form").alias("class")).distinct())
    sizes = keyed.select("class", "t").distinct().groupBy("class").agg(F.count("*").alias("n_texts"))
    return keyed.select("row", "class").join(sizes, "class").select("row", "class", "n_texts").distinct()


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(text_rows(spark, d), ["row"]).distinct()


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes}
