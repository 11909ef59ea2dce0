"""Problem 8: filling containers of fixed capacity with texts measured in tokens.

Sizes are whole numbers up to the capacity, so an instance is a histogram with at most as many entries as the capacity,
however many texts there are. On it, Martello and Toth's reduction fixes sets of one, two or three items that provably
dominate every other way to pack their largest item (whole classes of equal sizes at once), and best-fit decreasing
packs the rest. The resulting patterns (a number of equal containers each) are then dealt out to the texts by their rank
among the texts of their size.

A text larger than the capacity is divided into full pieces, each with a container of its own, and one remainder that is an
item like others. Null and empty texts have size 0, take no room and go to container 0. Repeated rows are packed as often as
they come. Without texts there is no container.

Scale: tokens are counted once and cut off in a table in the shared folder; only (size, number) pairs, at most
capacity many, and the patterns, at most a few per size, pass the driver. Ranks within a size are made in hash buckets, whose
number grows with the data, so that a size that a third of all texts have is spread over tasks.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.token_sizes import limits, token_counts
from folioflow.session import cut
from folioflow.sources.tables import table

ROWS_PER_BUCKET = 200_000


class Pool:
    """A multiset of sizes with the queries of the reduction."""

    def __init__(self, hist: dict[int, int]):
        self.n = {s: c for s, c in hist.items() if c > 0}
        self.keys = sorted(self.n)

    def take(self, s: int, c: int) -> None:
        self.n[s] -= c
        if not self.n[s]:
            del self.n[s]
            del self.keys[bisect.bisect_left(self.keys, s)]

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.keys, most)
        return self.keys[i - 1] if i else None

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest sizes, one item of size `without` set aside."""
        out: list[int] = []
        for s in self.keys:
            c = self.n[s] - (s == without)
            out += [s] * min(c, k - len(out))
            if len(out) == k:
                break
        return out


def reduce_instance(pool: Pool, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on a histogram: (sizes of one container, number of such containers), fixed for good.

    For the largest item j not looked at: if nothing fits beside it, it stands alone; if the largest item that fits fills up
    the container, or only one item can ever fit beside it, the two dominate; if at most two fit, the largest single
    partner dominates when no fitting pair is larger, and the best pair does when it holds the largest single partner
    and no other pair could use the room better. Otherwise j stays.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(pool.n, reverse=True)
    for s in sizes:
        while pool.n.get(s):
            n, room = pool.n[s], cap - s
            small = pool.smallest(3, s)
            if not small or small[0] > room:
                fixed.append(((s,), n))
                pool.take(s, n)
                break
            pool.n[s] -= 1
            if not pool.n[s]:
                del pool.n[s]
                pool.keys.remove(s)
            p = pool.largest(room)
            if s in pool.n:
                pool.n[s] += 1
            else:
                pool.n[s] = 1
                bisect.insort(pool.keys, s)
            one = len(small) < 2 or small[0] + small[1] > room
            if p == room or one:
                c = n // 2 if p == s else min(n, pool.n[p])
                fixed.append(((s, p), c))
                pool.take(s, c)
                pool.take(p, c)
                continue
            if len(small) < 3 or sum(small) > room:  # at most two fit beside s
                a, b = best_pair(pool, s, room)
                if a is None or p >= a + b:
                    c = n // 2 if p == s else min(n, pool.n[p])
                    fixed.append(((s, p), c))
                    pool.take(s, c)
                    pool.take(p, c)
                    continue
                if p == a and a + b == room:
                    fixed.append(((s, a, b), 1))
                    for x in (s, a, b):
                        pool.take(x, 1)
                    continue
            break
    return fixed


def best_pair(pool: Pool, s: int, room: int) -> tuple[int | None, int | None]:
    """The two other items of largest sum that fit into the room, the larger first; of equal sums the most uneven."""
    best, got = -1, (None, None)
    keys = pool.keys
    i, j = 0, bisect.bisect_right(keys, room) - 1
    left = lambda x: pool.n[x] - (x == s)
    while j >= 0 and i <= j:
        t = keys[i] + keys[j]
        if t > room:
            j -= 1
            continue
        if left(keys[i]) > 0 and left(keys[j]) > 0 and (i != j or left(keys[i]) > 1) and t > best:
            best, got = t, (keys[j], keys[i])
        i += 1
    return got


def best_fit(pool: Pool, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal containers are filled together."""
    groups: dict[int, list[list]] = {}  # room -> [[pattern, number]]
    rooms: list[int] = []

    def put(room: int, pattern: tuple, c: int) -> None:
        if c:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([pattern, c])

    for s in sorted(pool.n, reverse=True):
        n = pool.n[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                q = cap // s
                full, rest = divmod(n, q)
                put(cap - q * s, (s,) * q, full)
                if rest:
                    put(cap - rest * s, (s,) * rest, 1)
                n = 0
                break
            room = rooms[i]
            pattern, c = groups[room].pop()
            if not groups[room]:
                del groups[room]
                del rooms[i]
            q = room // s
            used = min(c, n // q)
            put(room - q * s, pattern + (s,) * q, used)
            n -= used * q
            c -= used
            if c and n:
                put(room - n * s, pattern + (s,) * n, 1)
                n, c = 0, c - 1
            put(room, pattern, c)
    return [(tuple(p), c) for gs in groups.values() for p, c in gs]


def pack_histogram(hist: dict[int, int], cap: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(patterns with their numbers, how many containers the reduction fixed)."""
    pool = Pool({s: c for s, c in hist.items() if 0 < s <= cap})
    fixed = [f for f in reduce_instance(pool, cap) if f[1]]
    return fixed + best_fit(pool, cap), sum(c for _, c in fixed)


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank, first container, items of this size per container) of each pattern that holds it, by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, c in patterns:
        for s in set(pattern):
            m = pattern.count(s)
            out.setdefault(s, []).append((ranks.get(s, 0), base, m))
            ranks[s] = ranks.get(s, 0) + c * m
        base += c
    return {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in out.items()}


def fill(items: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, piece_no, n_tokens, container): `items` has (key, size); sizes over the capacity are divided."""
    pieces = items.select(
        F.col(key).alias("k"),
        F.explode(
            F.when(F.col("size") > cap, F.expr(f"transform(sequence(0, cast((size - 1) div {cap} as int)), i -> struct(i as piece_no, cast(least({cap}, size - i * {cap}) as int) as n))"))
            .otherwise(F.array(F.struct(F.lit(0).alias("piece_no"), F.col("size").cast("int").alias("n"))))
        ).alias("p"),
    ).select("k", "p.piece_no", F.col("p.n").alias("n"))
    hist = {r.n: r.c for r in pieces.where("n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}
    total = sum(hist.values())
    slots = slot_table(pack_histogram(hist, cap)[0])
    buckets = max(16, total // ROWS_PER_BUCKET + 1)
    tagged = pieces.where("n > 0").withColumn("bucket", F.pmod(F.xxhash64("k", "piece_no"), F.lit(buckets)).cast("int"))
    before = tagged.groupBy("n", "bucket").agg(F.count("*").alias("c")).withColumn(
        "before", F.sum("c").over(W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    ranked = (
        tagged.withColumn("r", F.row_number().over(W.partitionBy("n", "bucket").orderBy("k", "piece_no")))
        .join(before.select("n", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["n", "bucket"])
        .select("k", "piece_no", "n", (F.col("r") - 1 + F.col("before")).alias("rank"))
    )

    def place(batches):
        for batch in batches:
            n, rank = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            at = np.zeros(len(n), np.int64)
            for s in np.unique(n):
                first, base, m = slots[int(s)]
                rows = n == s
                i = np.searchsorted(first, rank[rows], "right") - 1
                at[rows] = base[i] + (rank[rows] - first[i]) // m[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at)], names=["k", "piece_no", "n_tokens", "container"])

    kind = items.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"k {kind}, piece_no int, n_tokens int, container bigint")
    none = pieces.where("n = 0").select("k", "piece_no", F.col("n").alias("n_tokens"), F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(none).withColumnRenamed("k", key)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    wanted = limits(spark, d, "FILL")
    if not wanted:
        return spark.createDataFrame([], "limit_id int, doc_id bigint, piece_no int, n_tokens int, container bigint")
    names = sorted({r.tokenizer for r in wanted})
    counts = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", names))
    out = None
    for r in wanted:
        items = counts.select("doc_id", F.col("n")[names.index(r.tokenizer)].alias("size"))
        one = fill(items, "doc_id", r.max_tokens).select(F.lit(r.limit_id).cast("int").alias("limit_id"), "doc_id", "piece_no", "n_tokens", "container")
        out = one if out is None else out.unionByName(one)
    return out


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, containers, tokens, least): containers used, tokens in them, and the least number any packing needs."""
    caps = table(spark, d, "size_limits").where("purpose = 'FILL'").select("limit_id", "max_tokens")
    used = p8_containers(spark, d).where("n_tokens > 0").groupBy("limit_id").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(caps), "limit_id").select("limit_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least"))


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, n_docs, n_over, n_divided, n_lost): documents placed, containers over their capacity, documents divided though they would
    fit, and documents whose pieces do not add up to their size."""
    wanted = limits(spark, d, "FILL")
    if not wanted:
        return spark.createDataFrame([], "limit_id int, n_docs bigint, n_over bigint, n_divided bigint, n_lost bigint")
    names = sorted({r.tokenizer for r in wanted})
    counts = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", names))
    out = None
    for r in wanted:
        items = counts.select("doc_id", F.col("n")[names.index(r.tokenizer)].alias("size"))
        placed = cut(fill(items, "doc_id", r.max_tokens))
        over = placed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > r.max_tokens).alias("n_over"))
        docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k")).join(items, "doc_id", "full")
        whole = docs.agg(F.count("t").alias("n_docs"), F.count_if((F.col("k") > 1) & (F.col("size") <= r.max_tokens)).alias("n_divided"), F.count_if(~F.col("t").eqNullSafe(F.col("size").cast("bigint"))).alias("n_lost"))
        counted = ("n_docs", "n_over", "n_divided", "n_lost")
        both = [x.select(*[F.col(k) if k in x.columns else F.lit(0).cast("bigint").alias(k) for k in counted]) for x in (whole, over)]
        one = both[0].unionByName(both[1]).agg(*[F.sum(k).alias(k) for k in counted]).select(F.lit(r.limit_id).cast("int").alias("limit_id"), *counted)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p8_containers": p8_containers, "p8_use": p8_use, "p8_valid": p8_valid}
ORACLE = {"p8_valid": "SELECT limit_id, (SELECT count(*) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_lost FROM size_limits WHERE purpose = 'FILL'"}
