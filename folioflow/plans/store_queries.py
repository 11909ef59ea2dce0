"""Queries of the store's reads and writes, one for each, over views of the driver's tables that have the store's shape.

A read with an order gives each row's `rank` in it. A write gives the table's rows after it. Each has its SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow import schema
from folioflow.functions import codecs, text as X
from folioflow.operators import evidence as EV, library as LIB, store as ST
from folioflow.plans.registry import box_rows, lib, query, rev, sen, table

_VIEWS = r""", blk AS (SELECT 'p' || page AS documentId, CAST(ord % 3 AS INTEGER) AS pageNumber, CAST(ord AS INTEGER) AS position, 'T' || class AS type, round(l, 9) AS lft FROM box),
evi AS (SELECT 'e' || ord AS id, 'p' || page AS documentId, CAST(ord % 3 AS INTEGER) AS pageNumber, 'C' || (class % 3) AS channel, CASE class % 4 WHEN 0 THEN 'LAYOUT_BLOCK' WHEN 1 THEN 'OCR_LINE' WHEN 2 THEN 'FORMULA_REGION' ELSE 'FORMULA_LATEX' END AS kind,
  CAST(ord AS INTEGER) AS position, CASE WHEN class % 4 = 3 THEN 'e' || (ord // 4 * 4) END AS parentId, 't' || ord AS text FROM box),
tag AS (SELECT DISTINCT lower(split_part(lang, '-', 1)) AS id, upper(split_part(lang, '-', 1)) AS name FROM documents WHERE lang IS NOT NULL),
dt AS (SELECT DISTINCT documentId, lower(split_part(lang, '-', 1)) AS tagId FROM documents WHERE lang IS NOT NULL), pg AS (SELECT DISTINCT * FROM pages),
spn AS (SELECT id AS sentenceId, CAST(0 AS INTEGER) AS position, 'TEXT' AS kind, originalText AS text FROM sen WHERE originalText IS NOT NULL),
tra AS (SELECT sentenceId, parsedText AS sourceText, translatedText, createdAt AS updatedAt FROM rev WHERE translatedText IS NOT NULL),
stk AS (SELECT event_id AS id, user_id AS documentId, CAST(event_id % 5 AS INTEGER) AS pageNumber, event_type AS tool, epoch_us(ts) AS createdAt FROM events),
voc AS (SELECT lower(trim(title)) AS id, min(trim(title)) AS word, min(doc_id) AS createdAt FROM documents WHERE trim(title) <> '' GROUP BY 1),
cfg AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation) """


def blk(s, d) -> DataFrame:
    return box_rows(s, d).select(F.concat(F.lit("p"), "page").alias("documentId"), (F.col("ord") % 3).cast("int").alias("pageNumber"), F.col("ord").cast("int").alias("position"), F.concat(F.lit("T"), "class").alias("type"), F.round("left", 9).alias("lft"))


def evi(s, d) -> DataFrame:
    k = F.col("class") % 4
    kind = F.when(k == 0, "LAYOUT_BLOCK").when(k == 1, "OCR_LINE").when(k == 2, "FORMULA_REGION").otherwise("FORMULA_LATEX")
    return box_rows(s, d).select(
        F.concat(F.lit("e"), "ord").alias("id"), F.concat(F.lit("p"), "page").alias("documentId"), (F.col("ord") % 3).cast("int").alias("pageNumber"), F.concat(F.lit("C"), (F.col("class") % 3).cast("string")).alias("channel"), kind.alias("kind"),
        F.col("ord").cast("int").alias("position"), F.when(k == 3, F.concat(F.lit("e"), (F.floor(F.col("ord") / 4) * 4).cast("string"))).alias("parentId"), F.concat(F.lit("t"), "ord").alias("text"))


def tag(s, d) -> DataFrame:
    n = F.substring_index("lang", "-", 1)
    return table(s, d, "documents").where("lang is not null").select(F.lower(n).alias("id"), F.upper(n).alias("name")).distinct()


def dt(s, d) -> DataFrame:
    return table(s, d, "documents").where("lang is not null").select("documentId", F.lower(F.substring_index("lang", "-", 1)).alias("tagId")).distinct()


def spn(s, d) -> DataFrame:
    return sen(s, d, "id", "originalText").where("originalText is not null").select(F.col("id").alias("sentenceId"), F.lit(0).alias("position"), F.lit("TEXT").alias("kind"), F.col("originalText").alias("text"))


def tra(s, d) -> DataFrame:
    return rev(s, d).where("translatedText is not null").select("sentenceId", F.col("parsedText").alias("sourceText"), "translatedText", F.col("createdAt").alias("updatedAt"))


def stk(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("documentId"), (F.col("event_id") % 5).cast("int").alias("pageNumber"), F.col("event_type").alias("tool"), F.unix_micros(F.col("ts").cast("timestamp")).alias("createdAt"))


def voc(s, d) -> DataFrame:
    t = table(s, d, "documents").where("trim(title) <> ''")
    return t.groupBy(F.lower(F.trim("title")).alias("id")).agg(F.min(F.trim("title")).alias("word"), F.min("doc_id").alias("createdAt"))


def cfg(s, d) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))


def pg(s, d) -> DataFrame:
    return table(s, d, "pages").distinct()


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows with their rank in the order of a read, within what the read looks up."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def add(name: str, run, sql: str) -> None:
    query(name, _VIEWS + sql)(run)


c = F.col
VIEW = {"blk": blk, "evi": evi, "tag": tag, "dt": dt, "spn": spn, "tra": tra, "stk": stk, "voc": voc, "cfg": cfg, "pg": pg, "lib": lib, "rev": rev, "sen": lambda s, d: sen(s, d, "id", "documentId", "pageNumber", "position", "originalText", "correctedText")}


# Reads: (name, view, what is looked up, order, columns).
_READS = [
    ("read_layout_blocks", "blk", ["documentId", "pageNumber"], ["position"], ["documentId", "pageNumber", "position", "type"]),
    ("read_page_evidence", "evi", ["documentId", "pageNumber"], ["channel", "position"], ["id"]),
    ("read_spans", "spn", ["sentenceId"], ["position"], ["sentenceId", "kind", "text"]),
    ("read_reviews", "rev", ["documentId"], ["pageNumber", "createdAt", "sentenceId"], ["sentenceId"]),
    ("read_strokes", "stk", ["documentId", "pageNumber"], ["createdAt", "id"], ["id", "tool"]),
    ("read_note_strokes", "stk", ["documentId"], ["createdAt", "id"], ["id"]),
    ("read_page_sentences", "sen", ["documentId", "pageNumber"], ["position", "id"], ["id"]),
]
for _n, _v, _by, _order, _cols in _READS:
    add(_n, lambda s, d, v=_v, by=_by, order=_order, cols=_cols: ranked(VIEW[v](s, d), by, order).select(*cols, "rank"),
        f"SELECT {', '.join(_cols)}, row_number() OVER (PARTITION BY {', '.join(_by)} ORDER BY {', '.join(_order)}) AS rank FROM {_v}")

# Lookups of one key: (name, view, key column, key, columns).
_POINTS = [
    ("get_document", "lib", "id", "d000000000", ["id", "title", "pageCount"]), ("get_sentence", "sen", "documentId", "d000000001", ["id", "originalText"]), ("get_translation", "tra", "sentenceId", None, ["sentenceId", "translatedText"]),
    ("get_setting", "cfg", "key", "NATION_3", ["value"]), ("get_note_strokes", "stk", "documentId", 7, ["id", "createdAt"]), ("get_evidence", "evi", "documentId", "p3", ["id", "kind"]),
]
for _n, _v, _k, _x, _cols in _POINTS:
    add(_n, lambda s, d, v=_v, k=_k, x=_x, cols=_cols: (ST.lookup(VIEW[v](s, d), **{k: x}) if x is not None else VIEW[v](s, d)).select(*cols),
        f"SELECT {', '.join(_cols)} FROM {_v}" + ("" if _x is None else f" WHERE {_k} = {_x!r}"))

add("get_by_hash", lambda s, d: ST.newest(lib(s, d).join(table(s, d, "library_documents").select("sha256").distinct(), "sha256", "left_semi"), ["sha256"], ["id"]).select("sha256", "id"), "SELECT sha256, min(id) AS id FROM lib GROUP BY sha256")
add("library_by_opened", lambda s, d: ranked(lib(s, d), ["isTrashed"], [F.desc("lastOpenedAt"), "id"]).select("id", "isTrashed", "rank"), "SELECT id, isTrashed, row_number() OVER (PARTITION BY isTrashed ORDER BY lastOpenedAt DESC NULLS LAST, id) AS rank FROM lib")
add("folders_by_name", lambda s, d: ranked(table(s, d, "folders"), [], ["name", "id"]).select("id", "rank"), "SELECT id, row_number() OVER (ORDER BY name, id) AS rank FROM folders")
add("vocabulary_by_age", lambda s, d: voc(s, d).select("id", "word", "createdAt"), "SELECT * FROM voc")
add("debug_evidence", lambda s, d: EV.debug_rows(evi(s, d), ["LAYOUT_BLOCK", "OCR_LINE", "FORMULA_REGION"]).select("id", "kind"), "SELECT id, kind FROM evi WHERE kind IN ('LAYOUT_BLOCK', 'OCR_LINE', 'FORMULA_REGION')")
add("image_blocks", lambda s, d: blk(s, d).where(F.concat(F.lit("I"), "type").isin("IT4", "IT7")).select("documentId", "position"), "SELECT documentId, position FROM blk WHERE type IN ('T4', 'T7')")
add("formula_latex", lambda s, d: EV.latex_of_regions(evi(s, d)).select("id", "latex"), "SELECT r.id, arg_max(l.text, l.position) AS latex FROM evi r LEFT JOIN evi l ON l.parentId = r.id AND l.kind = 'FORMULA_LATEX' WHERE r.kind = 'FORMULA_REGION' GROUP BY r.id")
add("selected_sentences", lambda s, d: ranked(VIEW["sen"](s, d).join(rev(s, d).select(c("sentenceId").alias("id")), "id", "left_semi"), ["documentId"], ["pageNumber", "position", "id"]).select("id", "rank"),
    "SELECT id, row_number() OVER (PARTITION BY documentId ORDER BY pageNumber, position, id) AS rank FROM sen WHERE id IN (SELECT sentenceId FROM rev)")
add("review_sentence", lambda s, d: rev(s, d).select("sentenceId", c("documentId").alias("d")).join(VIEW["sen"](s, d).withColumnRenamed("id", "sentenceId"), "sentenceId", "left").select("sentenceId", "originalText"),
    "SELECT r.sentenceId, s.originalText FROM rev r LEFT JOIN sen s ON s.id = r.sentenceId")

# Updates: (name, view, condition as SQL of both engines, {column: (Column, SQL)}).
_UPDATES = [
    ("set_trashed", "lib", "id = 'd000000003'", {"isTrashed": (lambda: F.lit(True), "true")}),
    ("set_folder", "lib", "id < 'd000000010'", {"folderId": (lambda: F.lit(None).cast("string"), "NULL")}),
    ("restore", "lib", "isTrashed", {"isTrashed": (lambda: F.lit(False), "false")}),
    ("mark_opened", "lib", "pageCount > 5", {"lastOpenedAt": (lambda: F.lit(5).cast("bigint"), "5")}),
    ("set_progress", "lib", "status = 'READY'", {"status": (lambda: F.lit("FAILED"), "'FAILED'"), "processedPages": (lambda: c("pageCount"), "pageCount"), "errorMessage": (lambda: F.lit("x"), "'x'")}),
    ("set_translation", "lib", "processedPages > 3", {"fullTranslationStatus": (lambda: F.lit("RUNNING"), "'RUNNING'")}),
    ("correct_sentence", "sen", "position = 0", {"correctedText": (lambda: X.correction_or_null(c("originalText"), F.lit("")), "nullif(regexp_replace(originalText, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '')")}),
]
for _n, _v, _if, _set in _UPDATES:
    add(_n, lambda s, d, v=_v, cond=_if, new=_set: ST.update(VIEW[v](s, d), F.expr(cond), **{k: x() for k, (x, _) in new.items()}).select("id", *new),
        f"SELECT id, {', '.join(f'CASE WHEN {_if} THEN {x} ELSE {k} END AS {k}' for k, (_, x) in _set.items())} FROM {_v}")


def _context(s, d) -> DataFrame:
    """Documents in the present schema whose analysis begins if it is wanted and ends for the read ones."""
    docs = ST.update(ST.migrate(lib(s, d), "documents"), c("status") == "READY", aiContextStatus=F.lit("PENDING"))
    begun, _ = ST.compare_and_set(docs, c("pageCount") > 3, "aiContextStatus", "PENDING", "ANALYZING", aiContextError=F.lit(None).cast("string"))
    return ST.update(begun, (c("aiContextStatus") == "ANALYZING") & (c("pageCount") % 2 == 0), aiContextStatus=F.lit("READY"), aiContextSummary=c("title"), aiContextPromptTokens=F.lit(9))


add("analysis_states", lambda s, d: _context(s, d).select("id", "aiContextStatus", "aiContextSummary", "aiContextPromptTokens"), r"""SELECT id, CASE WHEN status <> 'READY' THEN 'NOT_REQUESTED' WHEN pageCount <= 3 THEN 'PENDING' WHEN pageCount % 2 = 0 THEN 'READY' ELSE 'ANALYZING' END AS aiContextStatus,
 CASE WHEN status = 'READY' AND pageCount > 3 AND pageCount % 2 = 0 THEN title END AS aiContextSummary, CASE WHEN status = 'READY' AND pageCount > 3 AND pageCount % 2 = 0 THEN 9 ELSE 0 END AS aiContextPromptTokens FROM lib""")

# Deletes by condition: (name, view, condition, key columns).
_DELETES = [
    ("drop_sentences", "sen", "documentId = 'd000000000'", ["id"]), ("drop_page_blocks", "blk", "documentId = 'p2' AND pageNumber = 1", ["documentId", "position"]), ("drop_page_evidence", "evi", "documentId = 'p2' AND pageNumber = 1", ["id"]),
    ("drop_pages", "pg", "documentId = 'd000000000'", ["documentId", "pageNumber"]), ("drop_blocks", "blk", "documentId = 'p2'", ["documentId", "position"]), ("drop_evidence", "evi", "documentId = 'p2'", ["id"]),
    ("drop_review", "rev", "pageNumber = 0", ["sentenceId"]), ("drop_stroke", "stk", "id = 17", ["id"]), ("clear_note", "stk", "documentId = 3", ["id"]), ("drop_folder", "folders", "createdAt > 1640000000000", ["id"]),
    ("clear_tags", "dt", "documentId = 'd000000001'", ["documentId", "tagId"]), ("drop_word", "voc", "createdAt % 2 = 0", ["id"]),
]
for _n, _v, _if, _keys in _DELETES:
    add(_n, lambda s, d, v=_v, cond=_if, keys=_keys: ST.delete(VIEW[v](s, d) if v in VIEW else table(s, d, v), F.expr(cond)).select(*keys), f"SELECT {', '.join(_keys)} FROM {_v} WHERE NOT ({_if})")

# Deletes of many keys, given as a table: (name, view, key, view of the keys, their column, condition on them).
_MANY = [
    ("drop_reviews", "rev", "sentenceId", "sen", "id", "pageNumber > 1"), ("drop_strokes", "stk", "id", "stk", "id", "tool = 'click'"), ("drop_note_strokes", "stk", "documentId", "stk", "documentId", "id < 20"), ("drop_settings", "cfg", "key", "cfg", "key", "value > '2'"),
]
for _n, _v, _k, _from, _kc, _if in _MANY:
    add(_n, lambda s, d, v=_v, k=_k, o=_from, kc=_kc, cond=_if: ST.delete_keys(VIEW[v](s, d), VIEW[o](s, d).where(cond).select(c(kc).alias(k)), [k]).select("id" if v == "stk" else k),
        f"SELECT {'id' if _v == 'stk' else _k} FROM {_v} WHERE {_k} NOT IN (SELECT {_kc} FROM {_from} WHERE {_if})")

# Inserts that must find their keys free, and rows that take the place of old ones: (name, view, keys, a value column, condition that parts old from new).
_KEYS = {"blk": ["documentId", "pageNumber", "position"], "evi": ["id"], "spn": ["sentenceId", "position"], "stk": ["id"], "dt": ["documentId", "tagId"], "pg": ["documentId", "pageNumber"], "sen": ["id"], "tra": ["sentenceId"], "voc": ["id"], "cfg": ["key"], "tag": ["id"], "lib": ["id"]}
_INSERTS = [("insert_document", "lib", "pageCount > 4"), ("insert_stroke", "stk", "id % 10 = 3"), ("insert_strokes", "stk", "tool = 'click'"), ("insert_note_stroke", "stk", "documentId = 4"), ("insert_note_strokes", "stk", "pageNumber = 2")]
for _n, _v, _if in _INSERTS:
    add(_n, lambda s, d, v=_v, cond=_if: ST.insert(VIEW[v](s, d).where(f"NOT ({cond})"), VIEW[v](s, d).where(cond), _KEYS[v]).select(*_KEYS[v]), f"SELECT {', '.join(_KEYS[_v])} FROM {_v}")
_UPSERTS = [
    ("insert_blocks", "blk", "type", "position % 3 = 0"), ("insert_evidence", "evi", "text", "position % 4 = 1"), ("insert_spans", "spn", "text", "sentenceId > 's00000000500'"), ("insert_document_tags", "dt", None, "tagId = 'en'"), ("upsert_page", "pg", "source", "pageNumber = 0"),
    ("upsert_sentences", "sen", "originalText", "position < 3"), ("upsert_translation", "tra", "translatedText", "updatedAt % 2 = 0"), ("upsert_strokes", "stk", "tool", "pageNumber = 1"), ("upsert_note_strokes", "stk", "tool", "documentId % 2 = 0"), ("upsert_vocabulary", "voc", "word", "createdAt % 3 = 0"),
    ("upsert_settings", "cfg", "value", "value = '1'"), ("upsert_folder", "folders", "name", "createdAt > 1640000000000"), ("upsert_tags", "tag", "name", "id = 'en'"),
]
for _n, _v, _c, _if in _UPSERTS:
    _k = _KEYS.get(_v, ["id"])

    def _run(s, d, v=_v, col=_c, cond=_if, k=_k):
        whole = VIEW[v](s, d) if v in VIEW else table(s, d, v)
        old = whole.select(*k, *([col] if col else []))
        new = whole.where(cond).select(*k, *([F.concat(F.lit("new:"), c(col)).alias(col)] if col else []))
        twice = new.unionByName(new.withColumn(col, F.concat(c(col), F.lit("!")))) if col else new.unionByName(new)
        return ST.upsert(old, twice, k)

    add(_n, _run, f"SELECT {', '.join(_k)}" + (f", CASE WHEN {_if} THEN 'new:' || {_c} || '!' ELSE {_c} END AS {_c}" if _c else "") + f" FROM {_v}")


# ---------------------------------------------------------------- transactions


def _first(s, d) -> DataFrame:
    return lib(s, d).where("pageCount > 4").select("id")


def _reset(s, d) -> dict:
    docs = ST.update(ST.migrate(lib(s, d), "documents"), F.lit(True), aiContextSummary=c("title"), fullTranslationTotal=F.lit(7), fullTranslationError=F.lit("e"))
    return ST.reset_index({"documents": docs, "sentences": VIEW["sen"](s, d), "pages": pg(s, d), "ai_correction_reviews": rev(s, d)}, _first(s, d))


_ALL = [f.name for f in schema.TABLES["documents"]]
_GIVEN = {"id", "title", "filePath", "sha256", "importedAt", "lastOpenedAt", "pageCount", "processedPages", "status", "errorMessage", "fullTranslationStatus", "folderId", "isTrashed"}


def _sql_value(v) -> str:
    return "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


_DEFAULT = schema.DEFAULTS["documents"]
_MIGRATED = ", ".join(n if n in _GIVEN else f"{_sql_value(_DEFAULT.get(n))} AS {n}" for n in _ALL)
query("migrated_documents", f"SELECT {_MIGRATED} FROM lib")(lambda s, d: ST.migrate(lib(s, d), "documents"))


def _after_reset(n: str) -> str:
    old = {"aiContextSummary": "title", "fullTranslationTotal": "7", "fullTranslationError": "'e'"}.get(n, n if n in _GIVEN else _sql_value(_DEFAULT.get(n)))
    if n in ("id", "title", "filePath", "sha256", "importedAt", "lastOpenedAt", "pageCount", "folderId", "isTrashed"):
        return n
    new = {"aiContextStatus": "'PENDING'"}.get(n, _sql_value(_DEFAULT.get(n)))
    return f"CASE WHEN pageCount > 4 THEN {new} ELSE {old} END AS {n}"


query("reset_documents", f"SELECT {', '.join(map(_after_reset, _ALL))} FROM lib")(lambda s, d: _reset(s, d)["documents"])
add("reset_sentences", lambda s, d: _reset(s, d)["sentences"].select("id"), "SELECT id FROM sen WHERE documentId NOT IN (SELECT id FROM lib WHERE pageCount > 4)")
add("reset_pages", lambda s, d: _reset(s, d)["pages"].select("documentId", "pageNumber"), "SELECT documentId, pageNumber FROM pg WHERE documentId NOT IN (SELECT id FROM lib WHERE pageCount > 4)")
add("reset_reviews", lambda s, d: _reset(s, d)["ai_correction_reviews"].select("sentenceId"), "SELECT sentenceId FROM rev WHERE sentenceId NOT IN (SELECT id FROM sen WHERE documentId IN (SELECT id FROM lib WHERE pageCount > 4))")


def _published(s, d) -> dict:
    page = pg(s, d).where("pageNumber = 0")
    new = VIEW["sen"](s, d).where("pageNumber = 0 AND position < 2").withColumn("originalText", F.lit("again"))
    t = {"pages": pg(s, d), "sentences": VIEW["sen"](s, d), "page_layout_blocks": VIEW["sen"](s, d).select("documentId", "pageNumber", "position"), "page_evidence": pg(s, d).select("documentId", "pageNumber", "source")}
    return ST.replace_page(t, page.withColumn("source", F.lit("NEW")), {"sentences": new, "page_layout_blocks": page.select("documentId", "pageNumber", F.lit(0).alias("position")), "page_evidence": page.select("documentId", "pageNumber", F.lit("NEW").alias("source"))})


_P0 = "(documentId, pageNumber) IN (SELECT documentId, pageNumber FROM pg WHERE pageNumber = 0)"
add("publish_pages", lambda s, d: _published(s, d)["pages"].select("documentId", "pageNumber", "source"), "SELECT documentId, pageNumber, CASE WHEN pageNumber = 0 THEN 'NEW' ELSE source END AS source FROM pg")
add("publish_sentences", lambda s, d: _published(s, d)["sentences"].select("id", "originalText"), "SELECT id, CASE WHEN pageNumber = 0 AND position < 2 THEN 'again' ELSE originalText END AS originalText FROM sen")
add("publish_blocks", lambda s, d: _published(s, d)["page_layout_blocks"], f"SELECT documentId, pageNumber, position FROM sen WHERE NOT {_P0} UNION ALL SELECT documentId, pageNumber, 0 FROM pg WHERE pageNumber = 0")


def _span_tables(s, d) -> tuple:
    new = VIEW["sen"](s, d).where("position = 1 AND originalText IS NOT NULL")
    old = VIEW["sen"](s, d).where("position <> 1 OR originalText IS NULL")
    return ST.with_children(old, spn(s, d).where("sentenceId > 's00000000300'"), new, new.select(c("id").alias("sentenceId"), F.lit(0).alias("position"), F.lit("NEW").alias("kind"), F.lit("t").alias("text")), ["id"], ["sentenceId", "position"], "sentenceId")


add("sentences_with_spans", lambda s, d: _span_tables(s, d)[1], """SELECT sentenceId, position, kind, text FROM spn WHERE sentenceId > 's00000000300' AND sentenceId NOT IN (SELECT id FROM sen WHERE position = 1)
UNION ALL SELECT id, 0, 'NEW', 't' FROM sen WHERE position = 1 AND originalText IS NOT NULL""")


def _batch(s, d) -> tuple:
    r = rev(s, d)
    asked = r.where("pageNumber <= 2").select("sentenceId")
    good = r.where("pageNumber <= 2 AND proposedText IS NOT NULL").select("sentenceId", c("proposedText").alias("correctedText"))
    again = r.where("pageNumber = 1").withColumn("parsedText", F.lit("again"))
    new = r.where("pageNumber <= 2 AND translatedText IS NOT NULL").select("sentenceId", F.lit("s").alias("sourceText"), "translatedText", F.lit(1).cast("bigint").alias("updatedAt"))
    return ST.apply_batch(r, VIEW["sen"](s, d), tra(s, d), asked, good, new, again)


add("batch_reviews", lambda s, d: _batch(s, d)[0].select("sentenceId", "parsedText"), "SELECT sentenceId, CASE WHEN pageNumber = 1 THEN 'again' ELSE parsedText END AS parsedText FROM rev WHERE pageNumber > 2 OR pageNumber = 1")
add("batch_sentences", lambda s, d: _batch(s, d)[1].select("id", "correctedText"), "SELECT s.id, CASE WHEN r.sentenceId IS NOT NULL THEN r.proposedText ELSE s.correctedText END AS correctedText FROM sen s LEFT JOIN rev r ON r.sentenceId = s.id AND r.pageNumber <= 2 AND r.proposedText IS NOT NULL")
add("batch_translations", lambda s, d: _batch(s, d)[2].select("sentenceId", "sourceText"), "SELECT t.sentenceId, CASE WHEN r.pageNumber <= 2 THEN 's' ELSE t.sourceText END AS sourceText FROM tra t JOIN rev r ON r.sentenceId = t.sentenceId")


def _resolved(s, d) -> DataFrame:
    r = rev(s, d)
    accept = r.where("pageNumber < 3").select("sentenceId", (c("proposedText").isNotNull()).alias("accept"))
    t = tra(s, d).select("sentenceId", "sourceText", "translatedText", "updatedAt")
    docs = ST.migrate(lib(s, d), "documents").withColumn("fullTranslationCorrectedCount", F.lit(-1))
    return ST.resolve_reviews(r, accept, VIEW["sen"](s, d), t, F.lit(0).cast("bigint"), docs)[3]


add("resolve_recount", lambda s, d: _resolved(s, d).select("id", "fullTranslationCorrectedCount"), """, fix AS (SELECT s.id, s.documentId, CASE WHEN r.sentenceId IS NOT NULL THEN nullif(r.proposedText, s.originalText) ELSE s.correctedText END AS x
 FROM sen s LEFT JOIN rev r ON r.sentenceId = s.id AND r.pageNumber < 3 AND r.proposedText IS NOT NULL), n AS (SELECT documentId, count(x) AS n FROM fix WHERE documentId IN (SELECT documentId FROM rev WHERE pageNumber < 3) GROUP BY 1)
SELECT l.id, CAST(coalesce(n.n, -1) AS INTEGER) AS fullTranslationCorrectedCount FROM lib l LEFT JOIN n ON n.documentId = l.id""")
add("replace_strokes", lambda s, d: ST.replace(stk(s, d), stk(s, d).where("pageNumber = 3").select("id"), stk(s, d).where("pageNumber = 3 AND id % 2 = 0").withColumn("tool", F.lit("PEN")), ["id"]).select("id", "tool"),
    "SELECT id, CASE WHEN pageNumber = 3 THEN 'PEN' ELSE tool END AS tool FROM stk WHERE pageNumber <> 3 OR id % 2 = 0")
add("replace_note_strokes", lambda s, d: ST.replace(stk(s, d), stk(s, d).where("documentId = 5").select("id"), stk(s, d).where("documentId = 5 AND id % 2 = 1").withColumn("tool", F.lit("PEN")), ["id"]).select("id", "tool"),
    "SELECT id, CASE WHEN documentId = 5 THEN 'PEN' ELSE tool END AS tool FROM stk WHERE documentId <> 5 OR id % 2 = 1")
add("undo_note_stroke", lambda s, d: ST.undo_last(stk(s, d), ["documentId"], [F.desc("createdAt"), F.desc("id")]).select("id"), "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY documentId ORDER BY createdAt DESC, id DESC) AS n FROM stk) WHERE n > 1")


def _cascade(s, d) -> DataFrame:
    tabs = {"documents": lib(s, d), "sentences": VIEW["sen"](s, d), "pages": pg(s, d), "ai_correction_reviews": rev(s, d), "sentence_spans": spn(s, d), "translations": tra(s, d), "document_tags": dt(s, d)}
    out = ST.cascade_delete(tabs, "documents", ST.required(lib(s, d).where("isTrashed").select("id")))
    row: dict[str, Column] = {"documents": c("id"), "sentences": c("id"), "pages": F.concat_ws(":", "documentId", "pageNumber"), "ai_correction_reviews": c("sentenceId"), "sentence_spans": c("sentenceId"), "translations": c("sentenceId"), "document_tags": F.concat_ws(":", "documentId", "tagId")}
    parts = [out[t].select(F.lit(t).alias("t"), k.alias("k")) for t, k in row.items()]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u


add("cascade_delete", _cascade, """, dead AS (SELECT id FROM lib WHERE isTrashed), ds AS (SELECT id FROM sen WHERE documentId IN (SELECT id FROM dead))
SELECT 'documents' AS t, id AS k FROM lib WHERE NOT isTrashed UNION ALL SELECT 'sentences', id FROM sen WHERE id NOT IN (SELECT id FROM ds) UNION ALL SELECT 'pages', documentId || ':' || pageNumber FROM pg WHERE documentId NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'ai_correction_reviews', sentenceId FROM rev WHERE sentenceId NOT IN (SELECT id FROM ds) UNION ALL SELECT 'sentence_spans', sentenceId FROM spn WHERE sentenceId NOT IN (SELECT id FROM ds)
UNION ALL SELECT 'translations', sentenceId FROM tra WHERE sentenceId NOT IN (SELECT id FROM ds) UNION ALL SELECT 'document_tags', documentId || ':' || tagId FROM dt WHERE documentId NOT IN (SELECT id FROM dead)""")


def _organised(s, d) -> tuple:
    choice = lib(s, d).where("pageCount > 3").select("id", F.lit("fd01").alias("folderId"), F.array(F.lit(" Read "), F.lit("read"), F.concat(F.lit("P"), c("pageCount").cast("string")), F.lit(" ")).alias("names"))
    tags = tag(s, d)
    return ST.organised(lib(s, d), tags, dt(s, d), choice)


_UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-3' || substr(md5({0}), 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(md5({0}), 17, 1)) - 1) % 4, 1) || substr(md5({0}), 18, 3) || '-' || substr(md5({0}), 21, 12)"
add("organise_documents", lambda s, d: _organised(s, d)[0].select("id", "folderId"), "SELECT id, CASE WHEN pageCount > 3 THEN 'fd01' ELSE folderId END AS folderId FROM lib")
add("organise_tags", lambda s, d: _organised(s, d)[1], f"SELECT id, name FROM tag UNION ALL SELECT DISTINCT {_UUID.format('lower(x)')}, x FROM (SELECT 'Read' AS x FROM lib WHERE pageCount > 3 UNION ALL SELECT 'P' || pageCount FROM lib WHERE pageCount > 3)")
add("organise_bridge", lambda s, d: _organised(s, d)[2], f"SELECT documentId, tagId FROM dt WHERE documentId NOT IN (SELECT id FROM lib WHERE pageCount > 3) UNION ALL SELECT id, {_UUID.format('lower(x)')} FROM (SELECT id, unnest(['Read', 'P' || pageCount]) AS x FROM lib WHERE pageCount > 3)")
add("folder_rows", lambda s, d: ST.clear_folder(lib(s, d), table(s, d, "folders"), table(s, d, "folders").where("createdAt > 1640000000000"))[1].select("id", "name"), "SELECT id, name FROM folders WHERE createdAt <= 1640000000000")
add("setting_rows", lambda s, d: table(s, d, "nation").select("n_name", F.explode(ST.translation_settings(F.concat(F.lit(" m"), "n_regionkey"), F.concat(F.lit("{text} "), "n_name"), c("n_nationkey") / 10.0)).alias("x")).select("n_name", "x.key", "x.value"),
    "SELECT n_name, unnest(['model', 'prompt', 'max_change_ratio']) AS key, unnest(['m' || n_regionkey, '{text} ' || n_name, CAST(greatest(0.05, least(1.0, n_nationkey / 10.0)) AS VARCHAR)]) AS value FROM nation")
add("document_settings", lambda s, d: ST.document_setting(lib(s, d).where("pageCount > 3").select(F.concat(F.lit("layout."), "id").alias("key"), F.col("pageCount").cast("string").alias("value")), lib(s, d), "layout."),
    "SELECT id, CASE WHEN pageCount > 3 THEN CAST(pageCount AS VARCHAR) END AS value FROM lib")
add("clamped_settings", lambda s, d: cfg(s, d).select("key", codecs.setting(F.create_map("key", "value"), "NATION_3", "int", 7, 2, 9).alias("v")), "SELECT key, greatest(2, least(9, CASE WHEN key = 'NATION_3' THEN CAST(value AS INTEGER) ELSE 7 END)) AS v FROM cfg")
add("bulk_tag_rows", lambda s, d: LIB.tagged(lib(s, d).select(c("id").alias("documentId")).distinct(), ["Alpha", "beta", "ALPHA", " "]).select("documentId", "name", "id"), f"SELECT DISTINCT lib.id AS documentId, x.n AS name, {_UUID.format('lower(x.n)')} AS id FROM lib, (SELECT unnest(['Alpha', 'beta']) AS n) x")
