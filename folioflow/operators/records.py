"""Rows of the store made of what models and the sentence stream give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.codecs import encode_regions, name_uuid
from folioflow.functions.text import accepted_correction, display_text, strip

SOURCE, NO_CROP = "HYBRID_PDF_VISUAL", "PDF 原页裁片"  # fixed values


def sentence_records(found: DataFrame, old: DataFrame) -> DataFrame:
    """Sentences of the stream (documentId, firstPage, position, text, role, confidence, regions) as rows of the store: ids by
    document, page and position, so that a sentence found again keeps its correction, which `old` (id, correctedText) holds."""
    key = F.concat_ws(":", "documentId", F.col("firstPage").cast("string"), F.col("position").cast("string"))
    rows = found.select(name_uuid(key).alias("id"), "documentId", F.col("firstPage").alias("pageNumber"), "position", F.col("text").alias("originalText"), encode_regions(F.col("regions")).alias("regions"),
                        F.concat(F.lit(SOURCE + ":"), "role").alias("source"), F.col("confidence").cast("float").alias("confidence"))
    return rows.join(old.select("id", "correctedText"), "id", "left").select("id", "documentId", "pageNumber", "position", "originalText", "correctedText", "regions", "source", "confidence")


def decided(sentences: DataFrame, items: DataFrame, ratio: Column, enabled: Column) -> DataFrame:
    """Sentences with a model's answer (sentenceId, correctedText as `proposed`, translatedText) and what becomes of it: `stored`, the
    correction to keep, and `review`, whether someone has to look.

    With corrections off the old correction stays. An answer equal to the shown text, or near enough to it, is stored unless it is
    the original; any other goes to review and the old correction stays.
    """
    s = sentences.withColumn("_shown", display_text(F.col("correctedText"), F.col("originalText"))).join(items.withColumnRenamed("sentenceId", "id"), "id")
    clean = strip(F.col("proposed"))
    taken = F.when(clean == F.col("_shown"), clean).otherwise(accepted_correction(F.col("_shown"), F.col("proposed"), ratio))
    stored = F.when(~enabled | taken.isNull(), F.col("correctedText")).otherwise(F.nullif(taken, F.col("originalText")))
    return s.withColumn("stored", stored).withColumn("review", enabled & taken.isNull())


def decision_rows(decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrections, translations, reviews) to apply to the store."""
    corrections = decisions.select(F.col("id").alias("sentenceId"), F.col("stored").alias("correctedText"))
    translations = decisions.select(F.col("id").alias("sentenceId"), F.coalesce("stored", "originalText").alias("sourceText"), "translatedText", now.alias("updatedAt"))
    reviews = decisions.where("review").select(F.col("id").alias("sentenceId"), "documentId", "pageNumber", F.lit(NO_CROP).alias("pdfOriginalText"), F.col("_shown").alias("parsedText"), F.col("proposed").alias("proposedText"), "translatedText", now.alias("createdAt"))
    return corrections, translations, reviews
