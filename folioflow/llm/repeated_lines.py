"""Problem 2: lines that one source's documents carry over and over.

Lines are compared by a hash of their normal form (letter case folded through upper case, so that sharp s
and final sigma fold too; the digits 0-9 removed). A line with at least `min_letters` letters is
frequent in a source when it stands in at least `min_docs` different documents of it (and, if asked,
in at least `min_share` of the source's documents).

Null texts, empty texts, texts without a letter and documents without a source give no frequent line.
Redelivered rows count once: documents are counted distinct, and the found rows are distinct.

Scale: only (source, line hash, document) triples are shuffled, after a partial distinct on the map
side, so a line that a third of all rows carry costs one row per map task and document. The join back is
salted on the line's side; the frequent side is replicated once per salt and is small against the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import cut
from folioflow.sources.tables import table

MIN_LETTERS, MIN_DOCS, SALTS = 40, 5, 8


def line_form(line: Column) -> Column:
    """Normal form of a line: case folded, digits 0-9 removed, outer white space dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.upper(line)), "[0-9]+", ""), r"^\s+|\s+$", "")


def line_rows(sentences: DataFrame, documents: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, line_no, doc, src, h1, h2) for each line long enough of a document that has a source.

    `h1`, `h2` together are a 96-bit hash of the line's normal form. A document delivered twice is taken
    once; one delivered with different sources belongs to the smallest of them.
    """
    docs = (
        documents.where(F.col("folderId").isNotNull())
        .groupBy(F.col("id").alias("doc"))
        .agg(F.min("folderId").alias("src"))
    )
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]+", ""))
    lines = (
        sentences.where(F.length("originalText") >= min_letters)
        .select(F.col("id"), F.col("documentId").alias("doc"), F.posexplode(F.split("originalText", "\n")).alias("line_no", "line"))
        .where((F.length("line") >= min_letters) & (letters >= min_letters))
        .select("id", "doc", "line_no", line_form(F.col("line")).alias("form"))
        .select("id", "doc", "line_no", F.xxhash64("form").alias("h1"), F.hash("form").alias("h2"))
    )
    return lines.join(docs, "doc")


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, min_share: float = 0.0, sizes: DataFrame | None = None) -> DataFrame:
    """(src, h1, h2, n_docs) of the lines standing in enough different documents of a source."""
    out = (
        lines.select("src", "h1", "h2", "doc").distinct().groupBy("src", "h1", "h2").agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    if min_share > 0 and sizes is not None:
        out = out.join(sizes, "src").where(F.col("n_docs") >= F.col("size") * F.lit(min_share)).drop("size")
    return out


def repeated_lines(sentences: DataFrame, documents: DataFrame, min_letters: int = MIN_LETTERS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """(sentence_id, line_no, src, n_docs): every line that its source repeats."""
    lines = cut(line_rows(sentences, documents, min_letters))  # parsed once, used twice
    freq = frequent_lines(lines, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.hash("id"), F.lit(salts)))
    hit = salted.join(freq, ["src", "h1", "h2", "salt"])
    return hit.select(F.col("id").alias("sentence_id"), F.col("line_no").cast("int").alias("line_no"), "src", "n_docs").distinct()


def without_repeated_lines(sentences: DataFrame, documents: DataFrame, **kw) -> DataFrame:
    """(id, documentId, pageNumber, position, text): every sentence row once, without its source's repeated lines.

    A text all of whose lines are repeated becomes null, and a null text stays null.
    """
    marks = repeated_lines(sentences, documents, **kw).groupBy(F.col("sentence_id").alias("id")).agg(F.collect_set("line_no").alias("gone"))
    rows = sentences.select("id", "documentId", "pageNumber", "position", "originalText").distinct()
    kept = F.filter(F.split("originalText", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    text = F.when(F.col("gone").isNull(), F.col("originalText")).when(F.size(kept) > 0, F.array_join(kept, "\n"))
    return rows.join(marks, "id", "left").select("id", "documentId", "pageNumber", "position", text.alias("text"))


def rebuilt_documents(sentences: DataFrame, documents: DataFrame, **kw) -> DataFrame:
    """(documentId, pageNumber, n_rows, text): each page of each document rebuilt, in reading order, without repeated lines.

    A document is rebuilt by page: one of its pages has a bounded number of rows, while a running volume that
    holds a tenth of all rows would not fit one task as a whole.
    """
    rows = without_repeated_lines(sentences, documents, **kw).where(F.col("text").isNotNull())
    page = F.sort_array(F.collect_list(F.struct("position", "id", "text")))
    return rows.groupBy("documentId", "pageNumber").agg(
        F.count("*").alias("n_rows"), F.array_join(F.transform(page, lambda x: x["text"]), "\n").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "sentences"), table(spark, d, "library_documents")).select("sentence_id", "line_no")


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return rebuilt_documents(table(spark, d, "sentences"), table(spark, d, "library_documents"))


_LINES = r"""
WITH docs AS (SELECT id AS doc, min(folderId) AS src FROM library_documents WHERE folderId IS NOT NULL GROUP BY id),
s AS (SELECT DISTINCT id, documentId, pageNumber, position, originalText FROM sentences),
cut AS (SELECT id, documentId AS doc, string_split(originalText, chr(10)) AS ls FROM s WHERE originalText IS NOT NULL),
ln AS (SELECT id, doc, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM cut),
lf AS (SELECT ln.id, ln.doc, docs.src, line_no, regexp_replace(replace(lower(upper(line)), 'ß', 'ss'), '[0-9]+', '', 'g') AS form
       FROM ln JOIN docs USING (doc) WHERE length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 40),
freq AS (SELECT src, trim(form) AS form FROM lf GROUP BY src, trim(form) HAVING count(DISTINCT doc) >= 5),
hit AS (SELECT DISTINCT lf.id, line_no FROM lf JOIN freq ON lf.src = freq.src AND trim(lf.form) = freq.form)
"""

QUERIES = {"p2_found": p2_found, "p2_documents": p2_documents}
ORACLE = {
    "p2_found": _LINES + "SELECT id AS sentence_id, CAST(line_no AS INTEGER) AS line_no FROM hit",
    "p2_documents": _LINES + r""", kept AS (
  SELECT s.id, s.documentId, s.pageNumber, s.position,
         CASE WHEN count(*) FILTER (WHERE h.id IS NULL) > 0 THEN string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE h.id IS NULL) END AS text
  FROM s JOIN ln l ON l.id = s.id LEFT JOIN hit h ON h.id = l.id AND h.line_no = l.line_no
  GROUP BY s.id, s.documentId, s.pageNumber, s.position)
SELECT documentId, pageNumber, count(*) AS n_rows, string_agg(text, chr(10) ORDER BY position, id) AS text
FROM kept WHERE text IS NOT NULL GROUP BY documentId, pageNumber""",
}
