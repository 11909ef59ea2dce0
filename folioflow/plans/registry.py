"""The registry of the core's queries and the views of the driver's tables that they share.

Redelivered rows are taken once. Boxes and points come from the embeddings (25 to a page), strokes from the events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.operators import store as ST
from folioflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PRELUDE = r"""WITH RECURSIVE lib AS (SELECT DISTINCT * FROM library_documents), sen AS (SELECT DISTINCT * FROM sentences),
rev AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sentenceId ORDER BY ingestedAt DESC) AS n FROM ai_correction_reviews) WHERE n = 1),
disp AS (SELECT id, documentId, pageNumber, position, coalesce(correctedText, originalText) AS text FROM sen),
ordn AS (SELECT *, row_number() OVER (PARTITION BY documentId ORDER BY pageNumber, position, id) - 1 AS ord FROM disp),
e AS (SELECT vec_id, label, vec_id // 25 AS page, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
box AS (SELECT page, vec_id AS ord, label AS class, abs(v[1]) AS score, greatest(0.0, least(1.0, 0.5 + v[2] - (0.1 + abs(v[4])) / 2)) AS l, greatest(0.0, least(1.0, 0.5 + v[3] - (0.1 + abs(v[5])) / 2)) AS t,
  greatest(0.0, least(1.0, 0.5 + v[2] + (0.1 + abs(v[4])) / 2)) AS r, greatest(0.0, least(1.0, 0.5 + v[3] + (0.1 + abs(v[5])) / 2)) AS b FROM e),
pt AS (SELECT page, vec_id AS point, 0.5 + v[6] AS x, 0.5 + v[7] AS y FROM e)
"""


def query(name: str, sql: str | None = None):
    """Registers a query; `sql` goes after the common views."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = PRELUDE + sql
        return f

    return put


# ---------------------------------------------------------------- views


def lib(s, d) -> DataFrame:
    return table(s, d, "library_documents").distinct()


def sen(s, d, *cols) -> DataFrame:
    t = table(s, d, "sentences")
    return (t.select(*cols) if cols else t).distinct()


def rev(s, d) -> DataFrame:
    return ST.newest(table(s, d, "ai_correction_reviews"), ["sentenceId"], [F.desc("ingestedAt")])


def disp(s, d) -> DataFrame:
    return sen(s, d, "id", "documentId", "pageNumber", "position", "originalText", "correctedText")


def emb(s, d) -> DataFrame:
    v = lambda i: F.col("embedding")[i - 1].cast("double")
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("class"), F.floor(F.col("vec_id") / 25).alias("page"), *[v(i).alias(f"v{i}") for i in range(1, 10)])


def box_rows(s, d) -> DataFrame:
    b = G.corner_box(F.lit(0.5) + F.col("v2"), F.lit(0.5) + F.col("v3"), F.lit(0.1) + F.abs("v4"), F.lit(0.1) + F.abs("v5"))
    return emb(s, d).select("page", F.col("vec_id").alias("ord"), "class", F.abs("v1").alias("score"), b.alias("b")).select("page", "ord", "class", "score", "b.*")


def point_rows(s, d) -> DataFrame:
    return emb(s, d).select("page", F.col("vec_id").alias("point"), (F.lit(0.5) + F.col("v6")).alias("x"), (F.lit(0.5) + F.col("v7")).alias("y"))


def stroke_rows(s, d) -> DataFrame:
    """A short polyline per event, from its numbers."""
    e = table(s, d, "events")
    at = lambda k: F.struct(((F.col("event_id") * k) % 101 / 100.0).alias("x"), ((F.col("event_id") * (k + 2)) % 103 / 102.0).alias("y"), F.lit(0.5).alias("pressure"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("documentId"), (F.col("event_id") % 5).alias("pageNumber"), F.unix_micros(F.col("ts").cast("timestamp")).alias("createdAt"),
                    F.col("event_type").alias("tool"), F.array(at(3), at(7), at(11), at(13)).alias("points"))


_STROKES = r""", st AS (SELECT event_id AS id, user_id AS documentId, event_id % 5 AS pageNumber, epoch_us(ts) AS createdAt, event_type AS tool,
  list_transform([3, 7, 11, 13], lambda k: struct_pack(x := (event_id * k) % 101 / 100.0, y := (event_id * (k + 2)) % 103 / 102.0)) AS pts FROM events) """
