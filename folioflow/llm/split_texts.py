"""Problem 9: splitting oversized texts at natural boundaries, within a limit of tokens.

The separators form a hierarchy: section, paragraph, line, sentence, word, character. From where a piece starts, the farthest
place within the limit is found on the token offsets of the whole text; the piece ends at the last boundary before it of the
highest level that leaves the piece at least `LEAST_FILL` full, and so on down to single characters. The next piece starts
`overlap` tokens before that end (moved left to a whole character). Every piece is measured on its own and shortened if its
own tokens exceed the limit. White space belongs to the piece before it, so the pieces without their overlaps give the
text back.

Only texts over the limit give pieces; null and empty texts never do. Combining marks stay with their character while any
other place remains.

Scale: no shuffle, one pass of Arrow batches; texts no longer in bytes than the limit are dropped by the JVM, since every
token has at least one byte.
"""

from __future__ import annotations

import bisect
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.sentence_units import Places
from folioflow.llm.token_sizes import limits, rank_encoding, sent_ranks
from folioflow.sources.tables import table

LEAST_FILL = 0.25
#: Ends of sections, paragraphs and lines; a match's end is a boundary.
SECTION = regex.compile(r"(?:\f\s*|\n[^\S\n]*\n\s*)(?=(?:#{1,6}\s|\\section|\d+(?:\.\d+)*\.?\s+\p{Lu}|(?:References|Abstract|Appendix|Literatur|Références|Referencias|参考文献)\b|\[1\]\s))|\n(?=\d+(?:\.\d+)*\s+\p{Lu}\p{L}+[^\n.]{0,60}\n)")
PARAGRAPH = regex.compile(r"\r?\n[^\S\n]*\r?\n\s*")
LINE = regex.compile(r"\r\n?|[\n  ]")
WORD = regex.compile(r"\s+")


class TokenRuler:
    """Token offsets of a text by one tokenizer, in code points."""

    def __init__(self, text: str, ids: list[int], widths: np.ndarray):
        self.n = len(ids)
        ends = np.concatenate([[0], np.cumsum(widths[ids])]) if ids else np.zeros(1, np.int64)
        if len(text) == ends[-1]:
            self.ends, self.bytes_at = ends, None
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            w = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            self.bytes_at = np.concatenate([[0], np.cumsum(w)])
            self.ends = ends

    def _byte(self, p: int) -> int:
        return p if self.bytes_at is None else int(self.bytes_at[p])

    def reach(self, start: int, tokens: int) -> int:
        """The farthest code point such that the text from start holds at most so many tokens."""
        first = int(np.searchsorted(self.ends, self._byte(start), "right")) - 1
        stop = int(self.ends[min(first + tokens, self.n)])
        return stop if self.bytes_at is None else int(np.searchsorted(self.bytes_at, stop, "right")) - 1

    def measure(self, text: str, start: int, end: int, enc) -> int:
        """Tokens of text[start:end] measured alone. Between two seams they are those of the whole text, so only the edges are
        encoded again."""
        first = SEAM.search(text, start + 1, min(end, start + 120))
        if first and end - start > 300:
            last = None
            for last in SEAM.finditer(text, max(first.end(), end - 120), end):  # noqa: B007
                pass
            if last:
                a, z = first.start(), last.start()
                inner = int(np.searchsorted(self.ends, self._byte(z))) - int(np.searchsorted(self.ends, self._byte(a)))
                return len(enc.encode_ordinary(text[start:a])) + inner + len(enc.encode_ordinary(text[z:end]))
        return len(enc.encode_ordinary(text[start:end]))

    def back(self, end: int, tokens: int) -> int:
        """The last code point from which to `end` there are at least so many tokens."""
        last = int(np.searchsorted(self.ends, self._byte(end), "left"))
        stop = int(self.ends[max(0, last - tokens)])
        return stop if self.bytes_at is None else int(np.searchsorted(self.bytes_at, stop, "right")) - 1


#: A place at which pre-tokens part however a text goes on before and after: between a letter or digit and a space before a letter.
SEAM = regex.compile(r"(?<=[\p{L}\p{N}]) (?=\p{L})")


class Marks:
    """The ends of sections, paragraphs, lines and sentences of a text, each level found in the whole text when it is first
    asked for."""

    def __init__(self, text: str):
        self.text, self.found, self.places = text, {}, None

    def last_sentence(self, low: int, high: int) -> int | None:
        self.places = self.places or Places(self.text)
        return self.places.last(low, high)

    def last(self, level: int, low: int, high: int) -> int | None:
        if level not in self.found:
            self.found[level] = [m.end() for m in (SECTION, PARAGRAPH, LINE)[level].finditer(self.text)]
        at = self.found[level]
        i = bisect.bisect_right(at, high) - 1
        return at[i] if i >= 0 and at[i] > low else None


def last_boundary(text: str, low: int, high: int, marks: Marks) -> int:
    """The best end in (low, high]: the last boundary of the highest level there is."""
    for level in range(3):
        got = marks.last(level, low, high)
        if got is not None:
            return got
    got = marks.last_sentence(low, high)
    if got is not None:
        return got
    a = high
    while a > low:
        z, a = a, max(low, a - 200)
        found = [m.end() for m in WORD.finditer(text, a, min(len(text), z + 1)) if low < m.end() <= high]
        if found:
            return found[-1]
    p = high
    while p > low + 1 and p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p if p > low else high


def shared_start(text: str, end: int, overlap: int, ruler: TokenRuler, enc) -> int:
    """Where the next piece starts so that the text it shares has the overlap's tokens, measured alone; if no place has just
    so many, the nearest with more."""
    more = None
    for step in (0, 1, -1, 2, 3):
        p = ruler.back(end, overlap + step)
        n = len(enc.encode_ordinary(text[p:end]))
        if n == overlap:
            return p
        if n > overlap and (more is None or p > more):
            more = p
    return more if more is not None else ruler.back(end, overlap)


def split_text(text: str | None, limit: int, overlap: int, enc, widths: np.ndarray, marks: Marks | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces, in code points; nothing if the text is within the limit."""
    if not text or (len(text) <= limit and len(text.encode("utf-8", "surrogatepass")) <= limit):
        return []
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return []
    ruler = TokenRuler(text, ids, widths)
    overlap = max(0, min(overlap, limit // 2))
    marks = marks or Marks(text)
    out: list[tuple[int, int, int]] = []
    start, done = 0, 0
    while done < len(text):
        budget = limit
        while True:
            high = max(ruler.reach(start, budget), done + 1)
            if high >= len(text):
                end = len(text)
            else:
                least = max(done, ruler.reach(start, int(budget * LEAST_FILL)))
                end = last_boundary(text, min(least, high - 1), high, marks)
            n = ruler.measure(text, start, end, enc)
            if n <= limit or (end <= done + 1 and start >= done):
                break
            if budget > n - limit + 1:
                budget -= n - limit
            else:
                budget = max(1, budget // 2)
            if end <= done + 1:  # the overlap alone fills the piece: give it up
                start = done
        out.append((start, end, n))
        done = end
        start = end
        if overlap and end < len(text):
            start = max(shared_start(text, end, overlap, ruler, enc), out[-1][0] + 1)
            start = min(start, end)
    return out


def split_rows(df: DataFrame, key: str, text: str, wanted: list) -> DataFrame:
    """(limit_id, key, piece_no, start, end, n_tokens, shared, piece): `shared` code points are shared with the piece before."""
    params = [(r.limit_id, r.tokenizer, r.max_tokens, r.overlap_tokens or 0) for r in wanted]
    least = min((p[2] for p in params), default=0)

    sent = sent_ranks(df.sparkSession, sorted({p[1] for p in params}))

    def run(batches):
        tools = {}
        for _, name, _, _ in params:
            enc = rank_encoding(name, sent.value)
            tools[name] = enc, np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = Marks(t)
                for lid, name, cap, over in params:
                    was = 0
                    for i, (a, b, n) in enumerate(split_text(t, cap, over, *tools[name], marks)):
                        rows.append((lid, k, i, a, b, n, was - a if i else 0, t[a:b]))
                        was = b
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32(), batch.column(0).type, *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["limit_id", "k", "piece_no", "start", "end", "n_tokens", "shared", "piece"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > least)
    schema = f"limit_id int, k {kind}, piece_no int, start int, end int, n_tokens int, shared int, piece string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(table(spark, d, "documents"), "doc_id", "text", limits(spark, d, "SPLIT"))


def p9_joined(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, doc_id, text, n_over): each long document's pieces put together again without what they share, and how many of them
    are over the limit."""
    caps = {r.limit_id: r.max_tokens for r in limits(spark, d, "SPLIT")}
    p = p9_pieces(spark, d)
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("limit_id")) if caps else F.lit(0)
    own = F.struct("piece_no", F.substring("piece", F.col("shared") + 1, F.length("piece")).alias("t"))
    return p.groupBy("limit_id", "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["t"]), "").alias("text"), F.count_if(F.col("n_tokens") > cap).alias("n_over"))


def p9_whole(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, doc_id, text): for each limit every document's text as its pieces give it, or as it is if it needs none."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    ids = F.array(*[F.lit(r.limit_id) for r in limits(spark, d, "SPLIT")]).cast("array<int>")
    each = docs.select("doc_id", "text", F.explode(ids).alias("limit_id"))
    got = p9_joined(spark, d).where("n_over = 0").select("limit_id", "doc_id", F.col("text").alias("t"))
    return each.join(got, ["limit_id", "doc_id"], "left").select("limit_id", "doc_id", F.coalesce("t", "text").alias("text"))


QUERIES = {"p9_pieces": p9_pieces, "p9_joined": p9_joined, "p9_whole": p9_whole}
ORACLE = {"p9_whole": "SELECT limit_id, doc_id, text FROM documents, size_limits WHERE purpose = 'SPLIT' AND text IS NOT NULL"}
