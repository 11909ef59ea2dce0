"""Library projections, searches and bulk operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.codecs import name_uuid
from folioflow.functions.text import strip


def progress(done: Column, total: Column) -> Column:
    return done.cast("double") / F.greatest(total, F.lit(1))


def search(documents: DataFrame, names: DataFrame, query: str, folder: str | None = None) -> DataFrame:
    """Documents of a folder (if given) whose title, or one of whose tag names, holds the query in any letter case.

    `names` has (documentId, name). A blank query keeps all.
    """
    out = documents if folder is None else documents.where(F.col("folderId") == folder)
    if not query.strip():
        return out
    q = F.lit(query.lower())
    tagged = names.where(F.contains(F.lower("name"), q)).select(F.col("documentId").alias("id")).distinct().withColumn("_tag", F.lit(True))
    return out.join(tagged, "id", "left").where(F.contains(F.lower("title"), q) | F.col("_tag")).select(*documents.columns)


def distinct_names(names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Names that differ only in letter case taken once, in the first spelling by `ord`; with their ids."""
    n = names.withColumn("name", strip(F.col("name"))).where("name <> ''")
    one = n.groupBy(*(by or []), F.lower("name").alias("key")).agg(F.min(F.struct("ord", "name")).alias("x"))
    return one.select(*(by or []), F.col("x.name").alias("name"), name_uuid(F.col("key")).alias("id"))


def tagged(documents: DataFrame, names: list[str]) -> DataFrame:
    """(documentId, name, id): each of a given list of tags on each document; names that differ only in letter case count once."""
    first: dict[str, str] = {}
    for n in names:
        if n.strip():
            first.setdefault(n.strip().lower(), n.strip())
    tags = F.array(*map(F.lit, first.values())) if first else F.array().cast("array<string>")
    return documents.select("documentId", F.explode(tags).alias("name")).withColumn("id", name_uuid(F.lower("name")))


def imported(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(sha256, action): what an import of each incoming file does: NEW, RESTORE of a trashed copy, or DUPLICATE, an error."""
    have = existing.groupBy("sha256").agg(F.bool_and("isTrashed").alias("trashed"))
    return incoming.select("sha256").distinct().join(have, "sha256", "left").select(
        "sha256", F.when(F.col("trashed").isNull(), "NEW").when(F.col("trashed"), "RESTORE").otherwise("DUPLICATE").alias("action"))


def vocabulary_row(word: Column, note: Column, sentence: Column, now: Column) -> list[Column]:
    key = F.lower(F.trim(word))
    return [key.alias("id"), F.trim(word).alias("word"), key.alias("normalizedWord"), note.alias("note"), sentence.alias("sourceSentenceId"), now.alias("createdAt")]


def toggled(chosen: Column, one: Column) -> Column:
    """A choice with one item put in, or taken out if it is there."""
    return F.when(F.array_contains(chosen, one), F.array_remove(chosen, one)).otherwise(F.array_append(chosen, one))


def toggled_all(chosen: Column, every: Column) -> Column:
    """A choice with all shown items put in, or taken out if all of them are there."""
    return F.when(F.size(F.array_except(every, chosen)) == 0, F.array_except(chosen, every)).otherwise(F.array_union(chosen, every))


def block_text(lines: Column, kind: Column, images: tuple[str, ...]) -> Column:
    """A block's text: its lines, one below the other; none for pictures."""
    return F.when(kind.isin(*images), F.lit("")).otherwise(F.array_join(lines, "\n"))
