"""Layout boxes of a page: decoding, suppression, containment, ownership of glyphs, order, agreement.

Boxes come as rows (page, class, score, left, top, right, bottom, ord). Everything is joined or grouped by page, whose number of
boxes the detector bounds (300 queries); nothing is paired across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions.text import sigmoid, squeeze
from folioflow.schema import LAYOUT_LABELS

BOX = ["left", "top", "right", "bottom"]
SAME_CLASS_IOU, OTHER_CLASS_IOU, CONTAINED, TOP = 0.6, 0.98, 0.9, 300
LARGE = ("chart", "display_formula", "doc_title", "inline_formula", "paragraph_title")  # fixed value


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def top_pairs(scores: DataFrame, by: list[str], n: int = TOP) -> DataFrame:
    """The n best (query, class) pairs of each page; ties by position."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= n)


def suppressed(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Greedy non-maximum suppression: in order of score, a box goes if it overlaps a kept one of its class by 0.6 or more, or of
    another class by 0.98 or more. One page's boxes are folded in one array."""
    fields = ["score", "ord", "class", *BOX]
    item = F.struct((-F.col("score")).alias("k"), *[F.col(c) for c in ("ord", "class", "score", *BOX)])
    pages = boxes.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("all"))

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: G.iou(k, b) >= F.when(k["class"] == b["class"], SAME_CLASS_IOU).otherwise(OTHER_CLASS_IOU))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return pages.select(*by, F.explode(kept).alias("b")).select(*by, *[F.col("b")[c].alias(c) for c in fields])


def without_page_images(boxes: DataFrame, by: list[str], landscape: Column) -> DataFrame:
    """Without images that cover almost the whole page, unless that would leave none or there is only one box."""
    big = (F.col("class") == LAYOUT_LABELS.index("image")) & (G.area(box()) > F.when(landscape, 0.82).otherwise(0.93))
    w = W.partitionBy(*by)
    tagged = boxes.withColumn("_big", big).withColumn("_n", F.count("*").over(w)).withColumn("_small", F.count_if(~F.col("_big")).over(w))
    return tagged.where(~F.col("_big") | (F.col("_n") <= 1) | (F.col("_small") == 0)).drop("_big", "_n", "_small")


def uncontained(boxes: DataFrame, by: list[str], large: list[int] | None = None) -> DataFrame:
    """Without boxes that lie to nine tenths in another box of a class that takes what it holds."""
    ids = large if large is not None else [LAYOUT_LABELS.index(x) for x in LARGE]
    outer = boxes.where(F.col("class").isin(ids)).select(*by, F.col("ord").alias("o_ord"), *[F.col(c).alias("o_" + c) for c in BOX])
    cond = [boxes[c] == outer[c] for c in by]
    clash = (F.col("ord") != F.col("o_ord")) & (G.containment(box(), box("o_")) >= CONTAINED)
    for c in cond:
        clash = clash & c
    return boxes.join(outer, clash, "left_anti")


def owners(points: DataFrame, regions: DataFrame, by: list[str], rank: Column, keys: list[str]) -> DataFrame:
    """points with `owner`, the `ord` of the region that owns them: of the regions holding the point the one of highest rank, then
    score, then the first; null where none does. `regions` needs ord, score and a box; `rank` is over its columns."""
    r = regions.select(*by, F.col("ord").alias("owner"), F.col("score").alias("_s"), rank.alias("_k"), *[F.col(c).alias("_" + c) for c in BOX]).where("_k > 0")
    hit = points.join(r, by).where((F.col("x") >= F.col("_left")) & (F.col("x") <= F.col("_right")) & (F.col("y") >= F.col("_top")) & (F.col("y") <= F.col("_bottom")))
    best = hit.groupBy(*by, *keys).agg(F.min(F.struct((-F.col("_k")).alias("a"), (-F.col("_s")).alias("b"), F.col("owner").alias("c"))).alias("m"))
    return points.join(best.select(*by, *keys, F.col("m.c").alias("owner")), [*by, *keys], "left")


def filled_runs(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """points with owner gaps filled from before, else from after, and `run`, the number of the run of one owner."""
    w = W.partitionBy(*by).orderBy(order)
    back = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    full = points.withColumn("owner", F.coalesce(F.last("owner", True).over(back), F.first("owner", True).over(ahead)))
    new = F.when(F.lag("owner").over(w).eqNullSafe(F.col("owner")), 0).otherwise(1)
    return full.withColumn("_new", new).withColumn("run", (F.sum("_new").over(back) - 1).cast("int")).drop("_new")


def order_votes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, query, votes, rank) from pairwise logits (i < j) that j comes after i: i's votes get 1 - p, j's get p; fewer votes come
    first, ties by number."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    each = pairs.select(*by, F.explode(F.array(F.struct(F.col("i").alias("query"), (1 - p).alias("v")), F.struct(F.col("j").alias("query"), p.alias("v")))).alias("x"))
    votes = each.groupBy(*by, F.col("x.query").alias("query")).agg(F.sum("x.v").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.round("votes", 9), "query")) - 1)


def matched(first: DataFrame, second: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """(by, a, b, iou): greedy one-to-one match of two sets of boxes of a page, of equal class and with enough overlap; boxes of the
    first are served in order, each taking its best free partner, of equally good ones the first. One page's boxes are folded in arrays."""
    item = lambda d: d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "class", *BOX))).alias("all"))
    pages = item(first).withColumnRenamed("all", "_x").join(item(second).withColumnRenamed("all", "_y"), by)
    none = F.array().cast("array<struct<a:bigint,b:bigint,iou:double>>")

    def step(done: Column, a: Column) -> Column:
        free = F.filter("_y", lambda b: (b["class"] == a["class"]) & ~F.exists(done, lambda m: m["b"] == b["ord"]))
        rated = F.filter(F.transform(free, lambda b: F.struct((-G.iou(a, b)).alias("k"), b["ord"].alias("b"))), lambda r: r["k"] <= -least)
        best = F.array_min(rated)
        got = F.struct(a["ord"].cast("bigint").alias("a"), best["b"].cast("bigint").alias("b"), (-best["k"]).alias("iou"))
        return F.when(F.size(rated) > 0, F.concat(done, F.array(got))).otherwise(done)

    return pages.select(*by, F.explode(F.aggregate("_x", none, step)).alias("m")).select(*by, "m.a", "m.b", "m.iou")


def unmatched(boxes: DataFrame, matches: DataFrame, by: list[str], side: str) -> DataFrame:
    """The boxes of one side (a or b) that no match has."""
    return boxes.join(matches.select(*by, F.col(side).alias("ord")), [*by, "ord"], "left_anti")


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks, arrays of 0 and 1 of one length; 0 where both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    some = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) | (y > 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(some == 0, F.lit(0.0)).otherwise(both / some)


def detections(candidates: DataFrame, order: DataFrame, by: list[str], threshold: float, landscape: Column, n: int = TOP, large: list[int] | None = None) -> DataFrame:
    """A page's regions from the raw scores of (query, class) pairs: the n best, those over the threshold, as corner boxes, without
    suppressed boxes, pictures of the whole page and boxes held by larger ones; with `readingOrder` and in that order.

    `candidates` has query, class, logit, cx, cy, w, h; `order` has query, rank, votes.
    """
    ord_ = F.col("query") * len(LAYOUT_LABELS) + F.col("class")
    scored = candidates.select(*by, ord_.alias("ord"), "query", "class", sigmoid(F.col("logit")).alias("score"), G.corner_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("b")).select(*by, "ord", "query", "class", "score", "b.*")
    best = top_pairs(scored, by, n).where(F.col("score") > threshold).drop("rank")
    kept = suppressed(best.drop("query"), by)
    left = uncontained(without_page_images(kept, by, landscape), by, large)
    named = left.withColumn("query", F.floor(F.col("ord") / len(LAYOUT_LABELS)).cast("bigint")).join(order.select(*by, F.col("query").cast("bigint").alias("query"), F.col("rank").alias("readingOrder"), "votes"), [*by, "query"])
    at = F.row_number().over(W.partitionBy(*by).orderBy("readingOrder", F.desc(F.round("votes", 9)), "ord")) - 1
    return named.withColumn("position", at).drop("votes")


def smallest_holding(boxes: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """(point, ord): the smallest box that holds each point, of equal ones the first."""
    j = points.join(boxes, by).where(G.holds(box(), F.col("x"), F.col("y")))
    return j.groupBy("point").agg(F.min(F.struct(G.area(box()).alias("a"), "ord"))["ord"].alias("ord"))


def nearest_centre(boxes: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """(point, ord): the box whose centre is nearest to each point, of equal ones the first."""
    dx, dy = (F.col("left") + F.col("right")) / 2 - F.col("x"), (F.col("top") + F.col("bottom")) / 2 - F.col("y")
    return points.join(boxes, by).groupBy("point").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "ord"))["ord"].alias("ord"))


def pair_agreement(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs, inversions) between the order of `a` and that of `b`."""
    m, n = matches.alias("m"), matches.alias("n")
    cond = F.col("m.a") < F.col("n.a")
    for c in by:
        cond = cond & (F.col(f"m.{c}") == F.col(f"n.{c}"))
    return m.join(n, cond).groupBy(*[F.col(f"m.{c}") for c in by]).agg(F.count("*").alias("pairs"), F.count_if(F.col("m.b") > F.col("n.b")).alias("inversions"))


def hit(regions: DataFrame, points: DataFrame, by: list[str], radius: float, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(point, sentence): the sentence whose region is nearest to a point, within the radius in pixels; of equally near ones that
    with the smallest region, then the first."""
    j = points.join(regions, by)
    d = G.point_distance2(box(), F.col("x"), F.col("y"), width, height)
    near = j.withColumn("_d", d).groupBy("point", "sentence", "ord").agg(F.min("_d").alias("d"), F.min(G.area(box())).alias("a")).where(F.col("d") <= radius * radius)
    return near.groupBy("point").agg(F.min(F.struct("d", "a", "ord", "sentence")).alias("m")).select("point", F.col("m.sentence").alias("sentence"))


def front_roles(blocks: DataFrame, by: list[str], first: Column | None = None) -> DataFrame:
    """Blocks with, on first pages, paragraphs before the title as HEADER and those between title and abstract as AUTHOR; pages
    without both stay as they are. `first` tells first pages; without it all are."""
    w = W.partitionBy(*by)
    t = F.min(F.when(F.col("type") == "DOCUMENT_TITLE", F.col("ord"))).over(w)
    b = blocks.withColumn("_t", t)
    b = b.withColumn("_a", F.min(F.when((F.col("type") == "ABSTRACT") & (F.col("ord") > F.col("_t")), F.col("ord"))).over(w))
    para = (F.col("type") == "PARAGRAPH") & F.col("_a").isNotNull() & (F.lit(True) if first is None else first)
    kind = F.when(para & (F.col("ord") < F.col("_t")), "HEADER").when(para & (F.col("ord") > F.col("_t")) & (F.col("ord") < F.col("_a")), "AUTHOR").otherwise(F.col("type"))
    return b.withColumn("type", kind).drop("_t", "_a")


CONTENTS_HEADINGS = ("CONTENTS", "TABLE OF CONTENTS")  # fixed value


def is_contents_heading(text: Column) -> Column:
    return F.upper(squeeze(text)).isin(*CONTENTS_HEADINGS)


def contents_roles(blocks: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Blocks with paragraphs under a contents heading of their column as CONTENTS, up to the next section title of that column.

    The page's section titles are gathered by page; a paragraph finds the last heading before it and the first title after
    that heading, both by overlap of columns.
    """
    title = F.struct("ord", is_contents_heading(text).alias("head"), box().alias("b"))
    t = blocks.withColumn("_ts", F.sort_array(F.collect_list(F.when(F.col("type") == "SECTION_TITLE", title)).over(W.partitionBy(*by))))
    above = F.filter("_ts", lambda x: x["head"] & (x["ord"] < F.col("ord")) & (G.column_overlap(x["b"], box()) >= 0.5))
    t = t.withColumn("_h", F.try_element_at(above, F.lit(-1)))
    after = F.filter("_ts", lambda x: (x["ord"] > F.col("_h")["ord"]) & (G.column_overlap(x["b"], F.col("_h")["b"]) >= 0.5))
    stop = F.try_element_at(after, F.lit(1))["ord"]
    hit = (F.col("type") == "PARAGRAPH") & F.col("_h").isNotNull() & (stop.isNull() | (F.col("ord") < stop))
    return t.withColumn("type", F.when(hit, "CONTENTS").otherwise(F.col("type"))).drop("_ts", "_h")
