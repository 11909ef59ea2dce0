"""Files in and out: imports by content hash, text layers, and publishing of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import title_of_file
from folioflow.operators.library import imported


def scanned_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(filePath, title, sha256, length) of the files of a folder; contents are hashed where they are read and go no further."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.substring_index("path", "/", -1), "%20", " ")
    return f.select(F.col("path").alias("filePath"), title_of_file(name).alias("title"), F.sha2("content", 256).alias("sha256"), "length")


def import_plan(spark: SparkSession, path: str, library: DataFrame) -> DataFrame:
    """Scanned files with the action their import takes; of files with one content the first path is kept."""
    f = scanned_files(spark, path)
    first = f.groupBy("sha256").agg(F.min(F.struct("filePath", "title", "length")).alias("x")).select("sha256", "x.*")
    return first.join(imported(library, first), "sha256")


def text_layers(spark: SparkSession, path: str) -> DataFrame:
    """(filePath, json): whole text-layer files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("filePath"), F.col("value").alias("json"))


def containing(df: DataFrame, column: str, needle: str | None) -> DataFrame:
    return df if not needle else df.where(F.contains(F.col(column), F.lit(needle)))


def publish(df: DataFrame, path: str, by: list[str]) -> None:
    """Rows written over the partitions they touch; other partitions stay as they are. Safe to repeat."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def image_name(page, position):
    """File name of an exported image block."""
    return F.concat(F.lit("第"), (page + 1).cast("string"), F.lit("页-图片"), (position + 1).cast("string"), F.lit(".png"))
