"""Ordinals of sentences in their documents, neighbours, related sentences, samples and batches."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import display_text, keywords, page_line, tokens, utf16_length
from folioflow.session import cut

MAX_SENTENCES, MAX_CHARACTERS, CHUNK = 16, 9000, 4096
BLOCK, SMALL, RELATED = 8192, 256, 3
WALK = ["documentId", "chunk", "enter", "leave", "starts", "ends"]


def ordinals(sentences: DataFrame) -> DataFrame:
    """The rows with `ord`, 0-based in reading order within the document.

    Ranked by page first and shifted by the counts of earlier pages, so that a document with a tenth of all rows
    is never sorted in one task.
    """
    counts = sentences.groupBy("documentId", "pageNumber").agg(F.count("*").alias("_c"))
    before = counts.select("documentId", "pageNumber", F.coalesce(F.sum("_c").over(W.partitionBy("documentId").orderBy("pageNumber").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    r = F.row_number().over(W.partitionBy("documentId", "pageNumber").orderBy("position", "id"))
    return sentences.withColumn("_r", r).join(before, ["documentId", "pageNumber"]).withColumn("ord", F.col("_r") - 1 + F.col("_b")).drop("_r", "_b")


class _Block:
    """A stretch of a document's sentences by word; a word stands once for each of its occurrences."""

    def __init__(self, first: int):
        self.first, self.n, self.posts, self.arrays = first, 0, {}, {}

    def add(self, words: list[str]) -> None:
        for w in words:
            self.posts.setdefault(w, []).append(self.n)
        self.n += 1

    def best(self, words: list[str], at: int) -> list[tuple[int, int]]:
        """(ordinal, hits) of the sentences with most occurrences of the words, without the neighbours of `at`."""
        found = [w for w in words if w in self.posts]
        if not found:
            return []
        at -= self.first
        if self.n <= SMALL:
            hits = Counter(i for w in found for i in self.posts[w] if abs(i - at) > 2)
            return [(self.first + i, c) for i, c in sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:RELATED]]
        for w in found:
            if w not in self.arrays:
                self.arrays[w] = np.array(self.posts[w], np.int32)
        h = np.bincount(np.concatenate([self.arrays[w] for w in found]), minlength=self.n)
        h[max(0, at - 2) : max(0, at + 3)] = 0
        out = []
        for _ in range(RELATED):
            i = int(h.argmax())
            if not h[i]:
                break
            out.append((self.first + i, int(h[i])))
            h[i] = 0
        return out


def related(sentences: DataFrame, want: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sentenceId, documentId, ord, rank): the sentences of its document with most occurrences of a wanted sentence's keywords.

    A document is cut into blocks of ordinals and each request goes to every block of its document; the best of the blocks
    are ranked. The work in a document grows with its sentences times its requests, but no pair of them becomes a row, and
    no task holds more than a block of sentences.
    """
    asked = want.groupBy("documentId").agg(F.count("*").alias("_n")).select("documentId")
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    s = sentences.join(asked, "documentId", "left_semi").select(
        "documentId", F.floor(F.col("ord") / block).alias("block"), F.lit(0).alias("kind"), F.col("ord").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("sentenceId"), words.alias("words"))
    last = s.groupBy("documentId").agg(F.max("block").alias("_last"))
    r = want.select("documentId", F.col("ord").cast("bigint").alias("ord"), F.col("id").alias("sentenceId"), keywords(F.col("text")).alias("words")).where(F.size("words") > 0)
    r = r.join(last, "documentId").select("documentId", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("block"), F.lit(1).alias("kind"), "ord", "sentenceId", "words")

    def run(batches):
        """Blocks come sorted, each with its sentences before its requests."""
        key, b = None, None
        for p in batches:
            got = []
            for doc, k, kind, o, sid, ws in zip(*(p.column(i).to_pylist() for i in range(6))):
                if (doc, k) != key:
                    key, b = (doc, k), _Block(o)
                if kind == 0:
                    b.add(ws)
                else:
                    got += [(sid, doc, i, h) for i, h in b.best(ws, o)]
            cols = list(zip(*got)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["sentenceId", "documentId", "ord", "hits"])

    rows = s.unionByName(r).repartition("documentId", "block").sortWithinPartitions("documentId", "block", "kind", "ord")
    best = rows.mapInArrow(run, "sentenceId string, documentId string, ord bigint, hits bigint")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("sentenceId").orderBy(F.desc("hits"), "ord"))).where(F.col("rank") <= RELATED).drop("hits")


def context_of(sentences: DataFrame, requests: DataFrame) -> DataFrame:
    """(sentenceId, context): for each requested sentence the two before it, itself, the two after it, then the three others of
    its document with most occurrences of its keywords; lines are tagged with their page.

    Neighbours are an equi-join on (document, ordinal); related ones are sought block by block of a document.
    """
    asked = requests.select(F.col("sentenceId").alias("id")).distinct().withColumn("asked", F.lit(True))
    s = ordinals(sentences).select("id", "documentId", "pageNumber", "ord", display_text(F.col("correctedText"), F.col("originalText")).alias("text"))
    s = cut(s.join(asked, "id", "left"))
    want, s = s.where("asked").drop("asked"), s.drop("asked")
    near = want.select(F.col("id").alias("sentenceId"), "documentId", F.lit(0).alias("part"), F.explode(F.array(*[F.col("ord") + k for k in (-2, -1, 0, 1, 2)])).alias("ord")).withColumn("rank", F.col("ord").cast("bigint"))
    far = related(s, want).select("sentenceId", "documentId", F.lit(1).alias("part"), "ord", F.col("rank").cast("bigint").alias("rank"))
    lines = near.unionByName(far).join(s.select("documentId", "ord", "pageNumber", "text"), ["documentId", "ord"])
    line = F.struct("part", "rank", page_line(F.col("pageNumber"), F.col("text")).alias("line"))
    return lines.groupBy("sentenceId").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"))


def sampled(sentences: DataFrame, first: int = 30, parts: int = 80) -> DataFrame:
    """The rows a document's analysis reads: the first 30, and every (n div 80)-th."""
    s = ordinals(sentences)
    n = s.groupBy("documentId").agg(F.count("*").alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    return s.join(n, "documentId").where((F.col("ord") < first) | (F.col("ord") % step == 0)).drop("_n")


def analysis_text(sentences: DataFrame, most: int = 24_000) -> DataFrame:
    """(documentId, text): the sampled sentences of each document by line, cut at `most` characters. A sample has at most
    some hundred and ninety rows, whatever the document's size."""
    line = F.struct("ord", F.coalesce(display_text(F.col("correctedText"), F.col("originalText")), F.lit("")).alias("t"))
    s = sampled(sentences).groupBy("documentId").agg(F.sort_array(F.collect_list(line)).alias("x"))
    return s.select("documentId", F.left(F.array_join(F.transform("x", lambda i: i["t"]), "\n"), F.lit(most)).alias("text"))


def greedy_batches(sentences: DataFrame, max_rows: int = MAX_SENTENCES, max_chars: int = MAX_CHARACTERS, chunk: int = CHUNK) -> DataFrame:
    """(documentId, start, end): the batches a document is sent in: as many sentences as fit the limits, one at least.

    Where a batch starts depends on all before it, but a chunk of ordinals can be entered at most at `max_rows` places. Each
    chunk is walked from every such place; chunks are chained by these few rows; the walk from the right place is kept. No
    task sees more than a chunk of sentences.
    """
    size = F.coalesce(utf16_length(display_text(F.col("correctedText"), F.col("originalText"))), F.lit(0))
    s = ordinals(sentences).select("documentId", F.col("ord").cast("bigint").alias("ord"), size.cast("bigint").alias("size"))
    here = s.withColumn("chunk", F.floor(F.col("ord") / chunk))
    ahead = s.where((F.col("ord") >= chunk) & (F.col("ord") % chunk < max_rows)).withColumn("chunk", F.floor(F.col("ord") / chunk) - 1)

    def walk(doc: str, ch: int, base: int, sizes: list[int]) -> list[tuple]:
        stop = min(chunk, len(sizes))
        out = []
        for enter in range(min(max_rows if ch else 1, stop)):
            i, starts, ends = enter, [], []
            while i < stop:
                j, total = i, 0
                while j < len(sizes) and j - i < max_rows and (j == i or total + sizes[j] <= max_chars):
                    total += sizes[j]
                    j += 1
                starts.append(base + i)
                ends.append(base + j)
                i = j
            out.append((doc, ch, enter, i - chunk, starts, ends))
        return out

    def walks(batches):
        """Chunks come sorted; a task holds the rows of one."""
        key, base, sizes = None, 0, []
        for p in batches:
            out = []
            for doc, ch, o, n in zip(p["documentId"], p["chunk"], p["ord"], p["size"]):
                if (doc, ch) != key:
                    if key:
                        out += walk(*key, base, sizes)
                    key, base, sizes = (doc, ch), o, []
                sizes.append(n)
            yield pd.DataFrame(out, columns=WALK)
        yield pd.DataFrame(walk(*key, base, sizes) if key else [], columns=WALK)

    rows = here.unionByName(ahead).repartition("documentId", "chunk").sortWithinPartitions("documentId", "chunk", "ord")
    walked = cut(rows.mapInPandas(walks, "documentId string, chunk bigint, enter int, leave int, starts array<bigint>, ends array<bigint>"))

    def chain(batches):
        """For each document, in chunk order, where its walk enters each chunk."""
        key, at, step = None, 0, {}

        def close(out):
            nonlocal at
            if key:
                out.append((*key, at))
                at = max(0, step.get(at, 0))

        for p in batches:
            out: list[tuple] = []
            for doc, ch, e, n in zip(p["documentId"], p["chunk"], p["enter"], p["leave"]):
                if (doc, ch) != key:
                    close(out)
                    if not key or key[0] != doc:
                        at = 0
                    key, step = (doc, ch), {}
                step[e] = n
            yield pd.DataFrame(out, columns=["documentId", "chunk", "enter"])
        out = []
        close(out)
        yield pd.DataFrame(out, columns=["documentId", "chunk", "enter"])

    links = walked.select("documentId", "chunk", "enter", "leave").repartition("documentId").sortWithinPartitions("documentId", "chunk", "enter")
    right = links.mapInPandas(chain, "documentId string, chunk bigint, enter int")
    kept = walked.join(right, ["documentId", "chunk", "enter"], "left_semi")
    return kept.select("documentId", F.explode(F.arrays_zip("starts", "ends")).alias("b")).select("documentId", F.col("b.starts").alias("start"), F.col("b.ends").alias("end"))


def running_totals(batches: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Batches with each column's total up to and with them, what a resumed run starts from."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return batches.select("*", *[F.sum(c).over(w).alias(f"{c}Total") for c in columns])


def chunked(rows: DataFrame, by: list[str], ord_: str, n: int) -> DataFrame:
    """(by, chunk, rows): rows in their order, n to a chunk."""
    item = F.struct(ord_, *[c for c in rows.columns if c not in (*by, ord_)])
    return rows.groupBy(*by, F.floor(F.col(ord_) / n).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("rows"))


def resume_page(committed: Column, firsts: Column) -> Column:
    """First page to read again: moved back while a sentence that starts before it reaches it.

    `firsts` holds (first, last) pages of the sentences; visited from the last start back, one pass settles it.
    """
    ordered = F.sort_array(firsts, asc=False)
    return F.aggregate(ordered, committed, lambda page, s: F.when((s["first"] < page) & (s["last"] >= page), s["first"]).otherwise(page))
