"""Evidence rows, text layers, replies and requests of models, windows of a character model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.codecs import clamp, name_uuid
from folioflow.functions.text import sigmoid, strip, strip_fence

CELL = "struct<text:string,left:float,top:float,right:float,bottom:float>"
TEXT_LAYER = f"struct<error:string,pages:array<struct<width:float,height:float,lines:array<{CELL}>,words:array<{CELL}>>>>"
REPLY = "struct<items:array<struct<id:string,corrected_source:string,zh_translation:string>>>"


def code_point(c: Column) -> Column:
    """Code point of a one-character string."""
    return F.ascii(c).cast("bigint")


def positioned(rows: DataFrame) -> DataFrame:
    """Evidence rows with `position`, counted from 0 within (document, page, channel) in emission order `ord`, and stable ids; boxes
    and scores are kept within 0 and 1."""
    w = W.partitionBy("documentId", "pageNumber", "channel").orderBy("ord")
    out = rows.withColumn("position", F.row_number().over(w) - 1)
    name = F.concat_ws(":", "documentId", F.col("pageNumber").cast("string"), "channel", F.col("position").cast("string"))
    out = out.withColumn("id", name_uuid(name))
    for c in ("left", "top", "right", "bottom", "confidence"):
        if c in out.columns:
            out = out.withColumn(c, clamp(F.col(c), 0.0, 1.0))
    return out


def latex_of_regions(evidence: DataFrame) -> DataFrame:
    """Formula regions with the LaTeX decoded for them; of several the one with the last position."""
    e = evidence
    last = e.where("kind = 'FORMULA_LATEX'").groupBy(F.col("parentId").alias("id")).agg(F.max(F.struct("position", "text"))["text"].alias("latex"))
    return e.where("kind = 'FORMULA_REGION'").join(last, "id", "left")


def debug_rows(evidence: DataFrame, kinds: list[str]) -> DataFrame:
    return evidence.where(F.col("kind").isin(kinds)).orderBy("channel", "position")


def text_layer_pages(layers: DataFrame, json: str = "json") -> DataFrame:
    """Text-layer JSON -> one row per page with (pageNumber, width, height, lines, words); an error in it raises."""
    p = F.from_json(F.col(json), TEXT_LAYER)
    ok = F.when(F.trim(F.coalesce(p["error"], F.lit(""))) != "", F.raise_error(p["error"]).cast(TEXT_LAYER)).otherwise(p)
    return layers.select("*", ok.alias("_p")).select(*layers.columns, F.posexplode("_p.pages").alias("pageNumber", "page")).select(*layers.columns, "pageNumber", "page.*")


def words_of_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text, box, words): each line of a page with its words from left to right: those whose middle is within a point of
    the line's band and that overlap it across. `words` stays empty unless they spell the line."""
    line = pages.select(*keys, "pageNumber", "width", "height", F.posexplode("lines").alias("line", "l")).where("width > 0 and height > 0")
    word = pages.select(*keys, "pageNumber", F.posexplode("words").alias("word", "w"))
    mid = (F.col("w.top") + F.col("w.bottom")) / 2
    near = (mid >= F.col("l.top") - 1) & (mid <= F.col("l.bottom") + 1) & (F.least("w.right", "l.right") > F.greatest("w.left", "l.left"))
    j = line.join(word, [*keys, "pageNumber"], "left").where(F.col("w").isNull() | near)
    got = j.groupBy(*keys, "pageNumber", "line").agg(F.sort_array(F.collect_list(F.struct(F.col("w.left").alias("x"), "word", "w"))).alias("ws"))
    words = F.transform("ws", lambda x: x["w"])
    bare = lambda t: F.regexp_replace(t, r"\s+", "")
    out = line.join(got, [*keys, "pageNumber", "line"], "left").withColumn("words", words)
    spelled = bare(F.array_join(F.transform("words", lambda w: w["text"]), "")) == bare(F.col("l.text"))
    text = strip(F.col("l.text"))
    return out.where(text != "").select(
        *keys, "pageNumber", "line", text.alias("text"), (F.col("l.left") / F.col("width")).alias("left"), (F.col("l.top") / F.col("height")).alias("top"),
        (F.col("l.right") / F.col("width")).alias("right"), (F.col("l.bottom") / F.col("height")).alias("bottom"), F.when(spelled, F.col("words")).alias("words"))


def validated_replies(batches: DataFrame) -> DataFrame:
    """(batch, verdict, items): replies read as JSON and held against the requested ids: UNREADABLE, DUPLICATE, MISMATCH, EMPTY or OK.
    Items come in the order of the request."""
    r = F.from_json(strip_fence(F.col("reply")), REPLY)["items"]
    items = F.transform(r, lambda i: F.struct(i["id"].alias("id"), strip(i["corrected_source"]).alias("corrected"), strip(i["zh_translation"]).alias("translated")))
    got = F.transform("items", lambda i: i["id"])
    blank = lambda t: F.coalesce(t, F.lit("")) == ""
    verdict = (
        F.when(F.col("items").isNull(), "UNREADABLE").when(F.size(F.array_distinct(got)) != F.size(got), "DUPLICATE")
        .when(F.array_sort(F.array_distinct(got)) != F.array_sort(F.array_distinct("ids")), "MISMATCH")
        .when(F.exists("items", lambda i: blank(i["corrected"]) | blank(i["translated"])), "EMPTY").otherwise("OK")
    )
    ordered = F.flatten(F.transform("ids", lambda x: F.filter("items", lambda i: i["id"] == x)))
    return batches.withColumn("items", items).select("batch", verdict.alias("verdict"), F.when(verdict == "OK", ordered).alias("items"))


def batch_requests(sentences: DataFrame, by: list[str]) -> DataFrame:
    """(by, request): JSON of the sentences of a batch, in order."""
    item = F.struct("position", "id", "text")
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("source")))
    return sentences.groupBy(*by).agg(F.to_json(F.struct(items.alias("items"))).alias("request"))


def usage(reply: Column) -> Column:
    """Token counts of a reply, 0 where they are missing."""
    n = lambda p: F.coalesce(F.get_json_object(reply, f"$.usage.{p}").try_cast("int"), F.lit(0)).alias(p)
    return F.struct(n("prompt_tokens"), n("prompt_cache_hit_tokens"), n("prompt_cache_miss_tokens"), n("completion_tokens"))


def window_starts(length: Column, window: int = 512, stride: int = 256) -> Column:
    """Starts of overlapping windows over a text, the last one aligned to its end."""
    last = F.greatest(length - window, F.lit(0))
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.ceil(last / stride).cast("int")), lambda i: F.least(i * stride, last)), F.array(last)))


def code_point_hashes(point: Column, primes: list[int], buckets: int = 8192) -> Column:
    """Buckets of a code point, one for each prime."""
    return F.array(*[((point + 1) * p) % buckets for p in primes])


def page_quality(pages: DataFrame, lines: DataFrame, by: list[str], native: Column) -> DataFrame:
    """Pages with `quality`: the mean confidence of their lines; without lines 1 where there is embedded text, else 0."""
    mean = lines.groupBy(*by).agg(F.avg(F.col("confidence").cast("double")).alias("_q"))
    return pages.join(mean, by, "left").withColumn("quality", F.coalesce("_q", F.when(native, 1.0).otherwise(0.0))).drop("_q")


def adapter(logits: Column, weights: list[float], intercept: float) -> Column:
    """Probability of a boundary from the averaged logits of a place: a logistic model over them."""
    z = F.lit(intercept)
    for i, w in enumerate(weights):
        z = z + F.get(logits, F.lit(i)) * w
    return sigmoid(z)


def adapter_parameters(json: Column) -> Column:
    """struct(coefficients, intercept, threshold) of an adapter's file."""
    return F.from_json(json, "struct<coefficients:array<double>,intercept:double,threshold:double>")


def window_scores(windows: DataFrame, key: list[str], weights: list[float], intercept: float) -> DataFrame:
    """(key, cp, p): probability after each code point. `windows` has the start of each window and its logits, an array of arrays by
    place; where windows overlap their logits are averaged."""
    each = windows.select(*key, "start", F.posexplode("logits").alias("i", "l")).select(*key, (F.col("start") + F.col("i")).alias("cp"), F.posexplode("l").alias("k", "v"))
    mean = each.groupBy(*key, "cp", "k").agg(F.avg("v").alias("m"))
    rows = mean.groupBy(*key, "cp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("m"))
    return rows.select(*key, "cp", adapter(F.col("m"), weights, intercept).alias("p"))


def complete_formulas(decoded: DataFrame) -> DataFrame:
    """Decoded formulas that came to their end and say something."""
    return decoded.where(F.col("terminated") & (strip(F.col("latex")) != ""))


def light_paper(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, light): whether a page's sampled pixels are paper: 55 % light and 78 % neutral. `pixels` has r, g, b."""
    lum = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    return pixels.groupBy(*by).agg(((F.count_if(lum >= 205) * 100 >= F.count("*") * 55) & (F.count_if(spread <= 28) * 100 >= F.count("*") * 78)).alias("light"))
