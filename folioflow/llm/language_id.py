"""Languages of short texts: a multinomial over hashed character n-grams, one class for each label of the corpus.

It is fitted on a bounded sample of labelled documents (`PER_LABEL` of each label, the first by a hash of their ids), whose
labels may be missing, odd in spelling or wrong: labels are cut to their first part in lower case, and paragraphs that the first
fit gives to another class leave the second. Text most of whose characters beyond ASCII its best
class never has, such as wrongly decoded text, has no language. Without labelled
documents nothing has one.

Texts are handled as one array of code points with the offsets at which each text starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LABEL, LEAST, BUCKETS, SMOOTH, STRANGE, GRAMS = 80, 3, 1 << 16, 0.05, 0.05, (1, 2, 3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Code point -> the one of its lower case; digits alike, white space alike."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        low = c.lower()
        out[i] = 32 if c.isspace() else 48 if c.isdigit() else ord(low) if len(low) == 1 else i
    return out


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code points of all texts, the offsets of their starts and of the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return lower_table()[raw], at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; texts may be empty."""
    out = np.zeros(len(at) - 1)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full])
    return out


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place; the first ones of a text reach into the text before, which is as good as a
    random start for one or two characters."""
    h = points.astype(np.uint64) * _A
    for k in range(1, n):
        h[k:] = h[k:] * _B + points[:-k].astype(np.uint64) * _A
    return ((h ^ (h >> np.uint64(29))) * _B >> np.uint64(48)).astype(np.int32)


def letters(points: np.ndarray) -> np.ndarray:
    """A character's number; those of the large East Asian sets by stretches of 2,048."""
    return np.where(points < 0x3000, points, 0x3000 + (points >> 11)).astype(np.int64) & 0x3FFF


class Languages:
    """The fitted classes. `name(texts)` gives each text's label or "" and the margin of its score."""

    def __init__(self, labelled: list[tuple[str, str]]):
        parts = [(k, p) for k, t in labelled for p in t.split("\n") if len(p) >= 30]
        counts: dict[str, int] = {}
        for k, _ in parts:
            counts[k] = counts.get(k, 0) + 1
        self.labels = sorted(k for k, n in counts.items() if n >= LEAST)
        parts = [(k, p) for k, p in parts if k in self.labels]
        self.weights, self.seen = np.zeros((0, BUCKETS), np.float32), np.zeros((0, BUCKETS), bool)
        for _ in range(3):
            if not self.labels or not parts:
                self.labels = []
                return
            self._fit(parts)
            got = self.name([p for _, p in parts])[0]
            parts = [(k, p) for (k, p), g in zip(parts, got) if g in (k, "")]

    def _fit(self, parts) -> None:
        points, at = points_of([p for _, p in parts])
        who = np.repeat([self.labels.index(k) for k, _ in parts], np.diff(at))
        m = np.zeros((len(self.labels), BUCKETS))
        for n in GRAMS:
            g = grams(points, n)
            for c in range(len(self.labels)):
                m[c] += np.bincount(g[who == c], minlength=BUCKETS)
        self.seen = np.array([np.bincount(letters(points[who == c]), minlength=1 << 14) >= 2 for c in range(len(self.labels))])
        self.weights = np.log((m + SMOOTH) / (m.sum(1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)

    def name(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(label or "" of each text, the margin between its best two classes)."""
        if not self.labels or not texts:
            return [""] * len(texts), np.zeros(len(texts))
        points, at = points_of(texts)
        s = np.zeros((len(texts), len(self.labels)))
        for n in GRAMS:
            g = grams(points, n)
            for c in range(len(self.labels)):
                s[:, c] += sums(self.weights[c][g], at)
        best = s.argmax(1)
        margin = s.max(1) - np.partition(s, -2, axis=1)[:, -2] if len(self.labels) > 1 else np.full(len(texts), 99.0)
        odd = np.flatnonzero((points >= 0x80) & (points < 0xFE00) & ((points < 0x2000) | (points > 0x206F)))
        cls = np.repeat(best, np.diff(at))[odd]
        strange = np.zeros(len(points))
        strange[odd] = np.where(self.seen[cls, letters(points[odd])], -1, 1)
        known = (sums(strange, at) <= STRANGE * np.diff(at)) & (margin > 0)
        return [self.labels[b] if k else "" for b, k in zip(best.tolist(), known.tolist())], np.where(known, margin, 0.0)


def fitted_languages(documents: DataFrame, per_label: int = PER_LABEL) -> Languages:
    """The classes fitted on about `per_label` documents of each label."""
    label = F.lower(F.regexp_extract("lang", "^[ ]*([A-Za-z]+)", 1)).alias("label")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")
    rows = documents.where("lang is not null and text is not null").select(label, h, "doc_id", "lang", "text").where("label <> ''")
    counts = {r.label: r["count"] for r in documents.where("lang is not null").select(label).groupBy("label").count().collect() if r.label}
    if not counts:
        return Languages([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (1.5 * per_label + 20) / n) * (1 << 30)))])
    got: dict[str, list[str]] = {}
    for r in rows.where(F.col("h") < F.element_at(share, F.col("label"))).orderBy("h", "doc_id", "text").select("label", "text").collect():
        got.setdefault(r.label, []).append(r.text)
    return Languages([(k, t) for k, ts in sorted(got.items()) for t in ts[:per_label]])
