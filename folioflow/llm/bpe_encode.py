"""Problem 7: the ids that a public byte-level BPE gives for every text.

Two tiers. A minimal perfect hash over the vocabulary resolves whole pre-tokens that are themselves vocabulary
entries; the others go through merges kept in a heap over linked bytes. Before the heap a pre-token is cut
at every byte pair that no vocabulary entry contains: no merge can cross such a place, so the cut changes no id and
the pieces (a name between CJK characters, say) repeat and are looked up again.

A null and an empty text give an empty list. The strings of special tokens are ordinary text.

Scale: no shuffle; one pass of Arrow batches over the scan. What is sent to each worker is the vocabulary's hash
tables, whose size is fixed by the tokenizer file. A worker's memory of resolved pre-tokens is cleared
when it is full, which costs time and no result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.tables import table

TOKENIZERS_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that the rank files are published with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES, CHUNK_CHARS = 200_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash, bucket and displacement: n keys on n slots, no empty slot.

    Keys are placed bucket by bucket, the fullest first; a bucket takes the first displacement that sends its keys to
    free and different slots. A lookup reads one displacement and one slot and compares the key that lies there.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        lo, hi = self._halves(keys)
        bucket = (lo % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)  # slot -> key number
        free = np.ones(n, bool)
        base, step = (hi % np.uint64(n)).astype(np.int64), 1 + (lo >> np.uint64(32)).astype(np.int64) % max(1, n - 1)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            ks = order[starts[b] : starts[b + 1]]
            d = 0
            while True:
                at = (base[ks] + (d // n) * 7919 + (d % n) * step[ks]) % n if sizes[b] > 1 else None
                if at is None:  # a single key: straight to a free slot
                    slot = int(np.argmax(free))
                    self.shift[b] = -slot - 1
                    at = np.array([slot])
                    break
                if free[at].all() and len(set(at.tolist())) == len(at):
                    self.shift[b] = d
                    break
                d += 1
            free[at] = False
            self.slot_of[at] = ks

    @staticmethod
    def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        return h, (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))

    def find(self, keys: list[bytes], own: list[bytes]) -> np.ndarray:
        """The number of each key in `own`, the list the hash was built on, or -1."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        lo, hi = self._halves(keys)
        d = self.shift[(lo % np.uint64(self.buckets)).astype(np.int64)]
        base, step = (hi % np.uint64(self.n)).astype(np.int64), 1 + (lo >> np.uint64(32)).astype(np.int64) % max(1, self.n - 1)
        at = np.where(d < 0, -d - 1, (base + (d // self.n) * 7919 + (d % self.n) * step) % self.n)
        got = self.slot_of[at]
        return np.fromiter((g if own[g] == k else -1 for g, k in zip(got.tolist(), keys)), np.int64, len(keys))


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the lowest-ranked adjacent pair merges first, leftmost on ties; bytes are a linked list."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # a live node i spans piece[i:end[i]]; end[i] is the next node
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of its halves has merged meanwhile
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Text -> ids, with the two tiers and a memory of what was resolved."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Entries that merging does not reach from their own bytes must not be resolved whole.
        self.own = [k for k in ranks if len(k) == 1 or heap_merge(k, ranks) == [ranks[k]]]
        self.ids = [ranks[k] for k in self.own]
        self.perfect = PerfectHash(self.own)
        pairs = np.zeros(1 << 16, bool)
        for k in ranks:
            for a, b in zip(k, k[1:]):
                pairs[a << 8 | b] = True
        self.pairs = pairs
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, tuple] = {}
        self.parts: dict[bytes, tuple] = {}
        self.pattern = regex.compile(PATTERN)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "parts", "pattern")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def _cut(self, b: bytes) -> list[bytes]:
        a = np.frombuffer(b, np.uint8).astype(np.int32)
        at = np.flatnonzero(~self.pairs[a[:-1] << 8 | a[1:]]) + 1
        if not len(at):
            return [b]
        ends = [0, *at.tolist(), len(b)]
        return [b[i:j] for i, j in zip(ends, ends[1:])]

    def _resolve(self, new: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        missed = []
        for t, b, g in zip(new, raw, self.perfect.find(raw, self.own).tolist()):
            if g >= 0:
                self.memo[t] = (self.ids[g],)
            else:
                missed.append((t, self._cut(b)))
        parts = list({p for _, ps in missed for p in ps if p not in self.parts})
        for p, g in zip(parts, self.perfect.find(parts, self.own).tolist()):
            self.parts[p] = (self.ids[g],) if g >= 0 else tuple(heap_merge(p, self.ranks))
        get = self.parts.__getitem__
        for t, ps in missed:
            self.memo[t] = get(ps[0]) if len(ps) == 1 else tuple(chain.from_iterable(map(get, ps)))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.memo) > MEMO_ENTRIES or len(self.parts) > MEMO_ENTRIES:
            self.memo.clear()
            self.parts.clear()
        new = set().union(*cut) - self.memo.keys() if cut else ()
        if new:
            self._resolve(list(new))
        get = self.memo.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]


@lru_cache(maxsize=4)
def encoder_for(path: str) -> Encoder:
    return Encoder(read_ranks(path))


_LOCAL: dict[str, Encoder] = {}


def encode_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", tokenizers_dir: str = TOKENIZERS_DIR) -> DataFrame:
    """(key, ids): the ids of each row's text; null and empty texts give an empty list, repeated rows stay."""
    path = f"{tokenizers_dir}/{tokenizer}.tiktoken"
    sent = df.sparkSession.sparkContext.broadcast(encoder_for(path))

    def run(batches):
        enc = _LOCAL.setdefault(path, sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, flat, i = [], [], 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_CHARS):
                    n += len(texts[j])
                    j += 1
                got = enc.encode_many(texts[i:j])
                counts += map(len, got)
                flat.append(np.fromiter(chain.from_iterable(got), np.int32, sum(map(len, got))))
                i = j
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
