"""The named queries of the core, each with the SQL that DuckDB checks it by where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import codecs, geometry as G, text as X
from folioflow.functions.diff import changed
from folioflow.functions.latex import encoded, normalized
from folioflow.operators import boxes as B, evidence as EV, ink, library as LIB, retrieval as RT, store as ST
from folioflow.operators.sentence_stream import segment_documents
from folioflow.plans.registry import _STROKES, ORACLE, QUERIES, box_rows, disp, emb, lib, point_rows, query, rev, sen, stroke_rows, table

def queries() -> dict:
    from folioflow.plans import function_queries, store_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLE)


# ---------------------------------------------------------------- retrieval of context, the flagship


@query("neighbour_context", r"""SELECT a.id, string_agg(b.text, chr(10) ORDER BY b.ord) AS context FROM ordn a JOIN ordn b ON a.documentId = b.documentId AND b.ord BETWEEN a.ord - 2 AND a.ord + 2 GROUP BY a.id""")
def neighbour_context(s, d):
    o = RT.ordinals(disp(s, d)).select("id", "documentId", "ord", X.display_text(F.col("correctedText"), F.col("originalText")).alias("text"))
    to = o.select("id", "documentId", F.explode(F.array(*[F.col("ord") + k for k in (-2, -1, 0, 1, 2)])).alias("ord"))
    j = to.join(o.select("documentId", "ord", "text"), ["documentId", "ord"])
    lines = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), lambda t: t.isNotNull())
    return j.groupBy("id").agg(F.nullif(F.array_join(lines, "\n"), F.lit("")).alias("context"))


@query("keyword_hits", r""", t AS (SELECT id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM disp) SELECT id, count(DISTINCT w) AS keywords, count(*) AS tokens FROM t WHERE length(w) >= 5 GROUP BY id""")
def keyword_hits(s, d):
    t = X.display_text(F.col("correctedText"), F.col("originalText"))
    return disp(s, d).select("id", F.size(X.keywords(t)).cast("bigint").alias("keywords"), F.size(X.tokens(t)).cast("bigint").alias("tokens")).where("tokens > 0")


@query("doc_sample", r""", n AS (SELECT documentId, count(*) AS n FROM ordn GROUP BY 1) SELECT o.id, o.documentId, o.ord FROM ordn o JOIN n USING (documentId) WHERE o.ord < 30 OR o.ord % greatest(n.n // 80, 1) = 0""")
def doc_sample(s, d):
    return RT.sampled(disp(s, d)).select("id", "documentId", "ord")


# ---------------------------------------------------------------- library and store


@query("library_trash", "SELECT id, title, lastOpenedAt FROM lib WHERE isTrashed")
def library_trash(s, d):
    return ST.lookup(lib(s, d), [F.desc("lastOpenedAt"), "id"], isTrashed=True).select("id", "title", "lastOpenedAt")


@query("library_search", r"""SELECT id, title FROM lib WHERE contains(lower(title), 'measure') OR contains(lower(title), 'gradient') OR id IN (SELECT documentId FROM documents WHERE contains(lower(lang), 'gradient'))
 OR contains(lower(title), 'estudio') """)
def library_search(s, d):
    names = table(s, d, "documents").select("documentId", F.col("lang").alias("name")).where("name is not null")
    found = [LIB.search(lib(s, d), names, q) for q in ("measure", "gradient", "Estudio")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("id", "title").distinct()


@query("library_titles", r"SELECT id, CASE WHEN trim(regexp_replace(title, '\.pdf$', '', 'i')) = '' THEN '未命名文档' ELSE regexp_replace(title, '\.pdf$', '', 'i') END AS title FROM lib")
def library_titles(s, d):
    return lib(s, d).select("id", X.title_of_file(F.col("title")).alias("title"))


@query("doc_by_hash", "SELECT sha256, min(id) AS id, count(*) AS n FROM lib GROUP BY sha256")
def doc_by_hash(s, d):
    return lib(s, d).groupBy("sha256").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("text_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def text_hash(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text"), 256).alias("hash"))


@query("import_dedupe", r""", have AS (SELECT sha256, bool_and(isTrashed) AS tr FROM lib WHERE processedPages > 0 GROUP BY 1) SELECT DISTINCT l.sha256, CASE WHEN tr IS NULL THEN 'NEW' WHEN tr THEN 'RESTORE' ELSE 'DUPLICATE' END AS action FROM lib l LEFT JOIN have USING (sha256)""")
def import_dedupe(s, d):
    """What importing every file would do to a library of those that have been read."""
    return LIB.imported(lib(s, d).where("processedPages > 0"), lib(s, d))


@query("folder_lookup", "SELECT l.id, f.name AS folder FROM lib l LEFT JOIN folders f ON f.id = l.folderId")
def folder_lookup(s, d):
    f = table(s, d, "folders").select(F.col("id").alias("folderId"), F.col("name").alias("folder"))
    return lib(s, d).join(f, "folderId", "left").select("id", "folder")


@query("folder_delete", "SELECT id, CASE WHEN folderId IN (SELECT id FROM folders WHERE createdAt > 1640000000000) THEN NULL ELSE folderId END AS folderId FROM lib")
def folder_delete(s, d):
    f = table(s, d, "folders")
    return ST.clear_folder(lib(s, d), f, f.where("createdAt > 1640000000000"))[0].select("id", "folderId")


@query("folder_names", "SELECT id, name FROM folders")
def folder_names(s, d):
    return table(s, d, "folders").select("id", "name").orderBy("name")


@query("bulk_move", "SELECT id, CASE WHEN id IN (SELECT documentId FROM rev) THEN 'fd00' ELSE folderId END AS folderId, CASE WHEN id IN (SELECT documentId FROM rev) THEN true ELSE isTrashed END AS isTrashed FROM lib")
def bulk_move(s, d):
    keys = rev(s, d).select(F.col("documentId").alias("id"))
    return ST.update_keys(lib(s, d), keys, "id", folderId=F.lit("fd00"), isTrashed=F.lit(True)).select("id", "folderId", "isTrashed")


@query("cas_transition", "SELECT count(*) FILTER (WHERE status = 'READY' AND isTrashed) AS changed FROM lib")
def cas_transition(s, d):
    return ST.compare_and_set(lib(s, d), F.col("isTrashed"), "status", "READY", "QUEUED")[1]


@query("cas_rows", "SELECT id, CASE WHEN status = 'READY' AND isTrashed THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'READY' AND isTrashed THEN 0 ELSE processedPages END AS processedPages FROM lib")
def cas_rows(s, d):
    return ST.compare_and_set(lib(s, d), F.col("isTrashed"), "status", "READY", "QUEUED", processedPages=F.lit(0))[0].select("id", "status", "processedPages")


@query("progress_ratio", "SELECT id, round(CAST(processedPages AS DOUBLE) / greatest(pageCount, 1), 9) AS ratio FROM lib")
def progress_ratio(s, d):
    return lib(s, d).select("id", F.round(LIB.progress(F.col("processedPages"), F.col("pageCount")), 9).alias("ratio"))


@query("corrected_count", "SELECT l.id, count(s.correctedText) AS n FROM lib l LEFT JOIN sen s ON s.documentId = l.id GROUP BY l.id")
def corrected_count(s, d):
    docs = lib(s, d).withColumn("fullTranslationCorrectedCount", F.lit(0))
    return ST.refresh_corrected(docs, sen(s, d, "id", "documentId", "correctedText")).select("id", F.col("fullTranslationCorrectedCount").cast("bigint").alias("n"))


@query("delete_from_page", "SELECT id FROM sen WHERE NOT (documentId = 'd000000000' AND pageNumber >= 3)")
def delete_from_page(s, d):
    return ST.delete(sen(s, d, "id", "documentId", "pageNumber"), (F.col("documentId") == "d000000000") & (F.col("pageNumber") >= 3)).select("id")


@query("doc_sentences", "SELECT id, pageNumber, position FROM sen WHERE documentId = 'd000000000'")
def doc_sentences(s, d):
    return ST.lookup(sen(s, d, "id", "documentId", "pageNumber", "position"), ["pageNumber", "position"], documentId="d000000000").select("id", "pageNumber", "position")


@query("page_sentences", r""", r AS (SELECT id, documentId, unnest(string_split(regions, '|')) AS p FROM sen) SELECT documentId, try_cast(split_part(p, ',', 1) AS INTEGER) AS page, count(DISTINCT id) AS n FROM r
WHERE len(string_split(p, ',')) = 5 AND try_cast(split_part(p, ',', 1) AS INTEGER) IS NOT NULL AND try_cast(split_part(p, ',', 5) AS FLOAT) IS NOT NULL GROUP BY 1, 2""")
def page_sentences(s, d):
    r = sen(s, d, "id", "documentId", "regions").select("id", "documentId", F.explode(F.array_distinct(F.transform(codecs.decode_regions(F.col("regions")), lambda b: b["page"]))).alias("page"))
    return r.groupBy("documentId", "page").agg(F.count("*").alias("n"))


@query("reviews_upsert", "SELECT sentenceId, documentId, pageNumber, createdAt FROM rev")
def reviews_upsert(s, d):
    r = table(s, d, "ai_correction_reviews")
    first = ST.newest(r, ["sentenceId"], ["ingestedAt"])
    return ST.upsert(first, rev(s, d), ["sentenceId"]).select("sentenceId", "documentId", "pageNumber", "createdAt")


def _translations(s, d) -> DataFrame:
    return rev(s, d).where("translatedText is not null").select(
        "sentenceId", F.col("parsedText").alias("sourceText"), "translatedText", F.lit(7).alias("promptTokens"), F.lit(1).alias("cacheHitTokens"), F.lit(2).alias("cacheMissTokens"),
        F.lit(3).alias("completionTokens"), F.lit("CNY").alias("costCurrency"), F.lit("0.01").alias("costAmount"), F.col("createdAt").alias("updatedAt"))


@query("resolve_reviews", r""", acc AS (SELECT sentenceId FROM rev WHERE proposedText <> parsedText)
SELECT s.id, CASE WHEN a.sentenceId IS NOT NULL THEN CASE WHEN r.proposedText = s.originalText THEN NULL ELSE r.proposedText END ELSE s.correctedText END AS correctedText
FROM sen s LEFT JOIN acc a ON a.sentenceId = s.id LEFT JOIN rev r ON r.sentenceId = a.sentenceId""")
def resolve_reviews(s, d):
    r = rev(s, d)
    accept = r.select("sentenceId", F.coalesce(F.col("proposedText") != F.col("parsedText"), F.lit(False)).alias("accept"))
    return ST.resolve_reviews(r, accept, sen(s, d, "id", "originalText", "correctedText"), _translations(s, d), F.lit(0).cast("bigint"))[1].select("id", "correctedText")


@query("resolve_translations", r""", tr AS (SELECT sentenceId, 7 AS p FROM rev WHERE translatedText IS NOT NULL)
SELECT coalesce(a.sentenceId, t.sentenceId) AS sentenceId, coalesce(t.p, 0) AS promptTokens, CASE WHEN a.sentenceId IS NOT NULL THEN CASE WHEN t.p IS NULL THEN '0' ELSE '0.01' END ELSE '0.01' END AS costAmount
FROM (SELECT sentenceId FROM rev WHERE proposedText <> parsedText) a FULL JOIN tr t ON a.sentenceId = t.sentenceId""")
def resolve_translations(s, d):
    r = rev(s, d)
    accept = r.select("sentenceId", F.coalesce(F.col("proposedText") != F.col("parsedText"), F.lit(False)).alias("accept"))
    return ST.resolve_reviews(r, accept, sen(s, d, "id", "originalText", "correctedText"), _translations(s, d), F.lit(0).cast("bigint"))[2].select("sentenceId", "promptTokens", "costAmount")


@query("cached_translation", r"SELECT t.id, (r.sentenceId IS NOT NULL AND r.parsedText = t.text) AS cached FROM disp t LEFT JOIN rev r ON r.sentenceId = t.id AND r.translatedText IS NOT NULL")
def cached_translation(s, d):
    """Whether a sentence's stored translation still belongs to its present text."""
    t = _translations(s, d).select(F.col("sentenceId").alias("id"), "sourceText")
    j = disp(s, d).join(t, "id", "left")
    return j.select("id", F.coalesce(F.col("sourceText").eqNullSafe(X.display_text(F.col("correctedText"), F.col("originalText"))) & F.col("sourceText").isNotNull(), F.lit(False)).alias("cached"))


@query("undo_last_stroke", _STROKES + "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY documentId, pageNumber ORDER BY createdAt DESC, id DESC) AS n FROM st) WHERE n > 1")
def undo_last_stroke(s, d):
    return ST.undo_last(stroke_rows(s, d), ["documentId", "pageNumber"], [F.desc("createdAt"), F.desc("id")]).select("id")


@query("sentences_with_notes", "SELECT s.id FROM sen s WHERE s.id IN (SELECT sentenceId FROM rev)")
def sentences_with_notes(s, d):
    return sen(s, d, "id").join(rev(s, d).select(F.col("sentenceId").alias("id")), "id", "left_semi")


@query("doc_tag_names", r"SELECT DISTINCT documentId, lower(split_part(lang, '-', 1)) AS name FROM documents WHERE lang IS NOT NULL")
def doc_tag_names(s, d):
    bridge = table(s, d, "documents").where("lang is not null").select("documentId", F.lower(F.substring_index("lang", "-", 1)).alias("tagId")).distinct()
    tags = bridge.select("tagId").distinct().select("tagId", F.col("tagId").alias("name"))
    return bridge.join(tags, "tagId").select("documentId", "name")


@query("doc_tag_lists", r"SELECT documentId, string_agg(DISTINCT lower(split_part(lang, '-', 1)), ',' ORDER BY lower(split_part(lang, '-', 1))) AS tags FROM documents WHERE lang IS NOT NULL GROUP BY documentId")
def doc_tag_lists(s, d):
    return doc_tag_names(s, d).groupBy("documentId").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))


@query("distinct_tags_ci", r""", n AS (SELECT trim(lang) AS name, doc_id FROM documents WHERE trim(lang) <> '') SELECT arg_min(name, (doc_id, name)) AS name FROM n GROUP BY lower(name)""")
def distinct_tags_ci(s, d):
    return LIB.distinct_names(table(s, d, "documents").select(F.col("lang").alias("name"), F.col("doc_id").alias("ord"))).select("name")


@query("bulk_tag", r", g AS (SELECT unnest(['Alpha', 'beta']) AS tag) SELECT l.id AS documentId, lower(g.tag) AS tag FROM (SELECT DISTINCT id FROM lib WHERE folderId IS NOT NULL) l, g")
def bulk_tag(s, d):
    """Each of a fixed list of tags on each of many documents."""
    docs = lib(s, d).where("folderId is not null").select(F.col("id").alias("documentId")).distinct()
    return LIB.tagged(docs, ["Alpha", "beta", "ALPHA"]).select("documentId", F.lower("name").alias("tag"))


# ---------------------------------------------------------------- text


@query("display_text", "SELECT id, text FROM disp")
def display_text(s, d):
    return disp(s, d).select("id", X.display_text(F.col("correctedText"), F.col("originalText")).alias("text"))


_WS = r"[ \t\n\x0b\f\r]"


@query("correction_norm", rf""", c AS (SELECT sentenceId, parsedText, regexp_replace(proposedText, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM rev) SELECT sentenceId, CASE WHEN t = '' OR t = parsedText THEN NULL ELSE t END AS correction FROM c""")
def correction_norm(s, d):
    return rev(s, d).select("sentenceId", X.correction_or_null(F.col("proposedText"), F.col("parsedText")).alias("correction"))


@query("normalize_ws", rf"""SELECT id, regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS text FROM disp""")
def normalize_ws(s, d):
    return disp(s, d).select("id", X.squeeze(X.display_text(F.col("correctedText"), F.col("originalText"))).alias("text"))


@query("readable_ratio", rf"""SELECT id, round(CASE WHEN regexp_matches(originalText, '[\pL\p{{Nd}}]') THEN length(regexp_replace(originalText, '[^\pL\p{{Nd}} \t\n\x0b\f\r.,;:!?()\[\]{{}}''"\-/+*=<>%&@#_\\]', '', 'g')) / greatest(length(originalText), 1)::DOUBLE ELSE 0 END, 6) AS share
FROM sen WHERE originalText IS NOT NULL""")
def readable_ratio(s, d):
    return sen(s, d, "id", "originalText").where("originalText is not null").select("id", F.round(X.readable_share(F.col("originalText")), 6).alias("share"))


@query("uuid3_ids", r"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT id, md5(documentId || ':' || pageNumber || ':' || position) AS h FROM sen)""")
def uuid3_ids(s, d):
    name = F.concat_ws(":", "documentId", F.col("pageNumber").cast("string"), F.col("position").cast("string"))
    return sen(s, d, "id", "documentId", "pageNumber", "position").select("id", codecs.name_uuid(name).alias("uuid"))


@query("token_diff", None)
def token_diff(s, d):
    return rev(s, d).select("sentenceId", changed("parsedText", "proposedText").alias("x")).select("sentenceId", "x.old", "x.new")


@query("latex_normalize", None)
def latex_normalize(s, d):
    f = sen(s, d, "id", "originalText").select("id", F.explode(F.regexp_extract_all("originalText", F.lit(r"\\\[[\s\S]*?\\\]"), F.lit(0))).alias("f"))
    return f.select("id", "f", normalized("f").alias("plain"))


@query("point_codec", _STROKES + "SELECT id, string_agg(printf('%.6f,%.6f,%.4f', p.x::DOUBLE, p.y::DOUBLE, 0.5), ';' ORDER BY i) AS points FROM (SELECT id, unnest(pts) AS p, generate_subscripts(pts, 1) AS i FROM st) GROUP BY id")
def point_codec(s, d):
    return stroke_rows(s, d).select("id", codecs.encode_points(codecs.decode_points(codecs.encode_points(F.col("points")))).alias("points"))


@query("page_text", r"SELECT documentId, pageNumber, string_agg('[' || (pageNumber + 1) || '] ' || text, chr(10) ORDER BY position, id) AS text FROM disp WHERE text IS NOT NULL GROUP BY 1, 2")
def page_text(s, d):
    """Sentences of each page joined for a request, tagged with the page."""
    t = X.display_text(F.col("correctedText"), F.col("originalText"))
    line = F.concat(F.lit("["), (F.col("pageNumber") + 1).cast("string"), F.lit("] "), t)
    x = F.sort_array(F.collect_list(F.when(t.isNotNull(), F.struct("position", "id", line.alias("line")))))
    return disp(s, d).where(t.isNotNull()).groupBy("documentId", "pageNumber").agg(F.array_join(F.transform(x, lambda i: i["line"]), "\n").alias("text"))


@query("char_ordinals", r"SELECT id, coalesce(sum(length(text)) OVER (PARTITION BY documentId, pageNumber ORDER BY position, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER (PARTITION BY documentId, pageNumber ORDER BY position, id) - 1 AS line FROM disp")
def char_ordinals(s, d):
    from pyspark.sql import Window as W

    t = F.length(X.display_text(F.col("correctedText"), F.col("originalText")))
    w = W.partitionBy("documentId", "pageNumber").orderBy("position", "id")
    return disp(s, d).select("id", F.coalesce(F.sum(t).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), (F.row_number().over(w) - 1).cast("bigint").alias("line"))


# ---------------------------------------------------------------- boxes


@query("box_iou", r"""SELECT a.page, a.ord AS a, b.ord AS b, round(i / nullif(ua + ub - i, 0), 6) AS iou FROM (SELECT x.page, x.ord AS a, y.ord AS b, greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) AS i,
 (x.r - x.l) * (x.b - x.t) AS ua, (y.r - y.l) * (y.b - y.t) AS ub FROM box x JOIN box y ON x.page = y.page AND x.ord < y.ord) q, LATERAL (SELECT q.page, q.a AS ord) a, LATERAL (SELECT q.b AS ord) b WHERE i > 0""")
def box_iou(s, d):
    x = box_rows(s, d).select("page", F.col("ord").alias("a"), B.box().alias("x"))
    y = box_rows(s, d).select("page", F.col("ord").alias("b"), B.box().alias("y"))
    return x.join(y, "page").where((F.col("a") < F.col("b")) & (G.intersection(F.col("x"), F.col("y")) > 0)).select("page", "a", "b", F.round(G.iou(F.col("x"), F.col("y")), 6).alias("iou"))


@query("contained_boxes", r"""SELECT x.page, x.ord FROM box x WHERE NOT EXISTS (SELECT 1 FROM box y WHERE y.page = x.page AND y.ord <> x.ord AND y.class IN (1, 3) AND (x.r - x.l) * (x.b - x.t) > 0
 AND greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) / ((x.r - x.l) * (x.b - x.t)) >= 0.9)""")
def contained_boxes(s, d):
    return B.uncontained(box_rows(s, d), ["page"], [1, 3]).select("page", "ord")


@query("topk_pairs", "SELECT page, ord FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS n FROM box) WHERE n <= 5")
def topk_pairs(s, d):
    return B.top_pairs(box_rows(s, d), ["page"], 5).select("page", "ord")


@query("glyph_owner", r""", h AS (SELECT p.page, p.point, x.ord, row_number() OVER (PARTITION BY p.point ORDER BY (x.class % 4) DESC, x.score DESC, x.ord) AS n FROM pt p JOIN box x ON x.page = p.page AND x.class % 4 > 0 AND p.x BETWEEN x.l AND x.r AND p.y BETWEEN x.t AND x.b)
SELECT p.page, p.point, coalesce(h.ord, -1) AS owner FROM pt p LEFT JOIN h ON h.point = p.point AND h.n = 1""")
def glyph_owner(s, d):
    return B.owners(point_rows(s, d), box_rows(s, d), ["page"], F.col("class") % 4, ["point"]).select("page", "point", F.coalesce("owner", F.lit(-1)).alias("owner"))


@query("owner_runs", r""", h AS (SELECT p.page, p.point, x.ord, row_number() OVER (PARTITION BY p.point ORDER BY (x.class % 4) DESC, x.score DESC, x.ord) AS n FROM pt p JOIN box x ON x.page = p.page AND x.class % 4 > 0 AND p.x BETWEEN x.l AND x.r AND p.y BETWEEN x.t AND x.b),
o AS (SELECT p.page, p.point, h.ord AS owner FROM pt p LEFT JOIN h ON h.point = p.point AND h.n = 1),
f AS (SELECT page, point, coalesce(last_value(owner IGNORE NULLS) OVER (PARTITION BY page ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(owner IGNORE NULLS) OVER (PARTITION BY page ORDER BY point ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM o),
g AS (SELECT *, CASE WHEN lag(owner) OVER (PARTITION BY page ORDER BY point) IS NOT DISTINCT FROM owner THEN 0 ELSE 1 END AS new FROM f)
SELECT page, point, owner, CAST(sum(new) OVER (PARTITION BY page ORDER BY point) - 1 AS INTEGER) AS run FROM g""")
def owner_runs(s, d):
    # the first row of a page has no row before it, so a page without any owner starts run 0 by lag's null only in SQL's sense
    return B.filled_runs(B.owners(point_rows(s, d), box_rows(s, d), ["page"], F.col("class") % 4, ["point"]), ["page"], "point").select("page", "point", "owner", "run")


@query("hit_test", r""", q AS (SELECT p.point, x.ord, greatest(x.l - p.x, p.x - x.r, 0) * 600 AS dx, greatest(x.t - p.y, p.y - x.b, 0) * 800 AS dy, (x.r - x.l) * (x.b - x.t) AS a FROM pt p JOIN box x ON x.page = p.page),
g AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dx * dx + dy * dy, a, ord) AS n FROM q WHERE dx * dx + dy * dy <= 324) SELECT point, ord AS sentence FROM g WHERE n = 1""")
def hit_test(s, d):
    regions = box_rows(s, d).select("page", F.col("ord").alias("sentence"), "ord", *B.BOX)
    return B.hit(regions, point_rows(s, d), ["page"], 18.0, 600.0, 800.0)


@query("reading_order", r""", pr AS (SELECT x.page, x.ord AS i, y.ord AS j, 1 / (1 + exp(-(y.t - x.t) * 5)) AS p FROM box x JOIN box y ON x.page = y.page AND x.ord < y.ord),
v AS (SELECT page, i AS q, 1 - p AS v FROM pr UNION ALL SELECT page, j, p FROM pr), s AS (SELECT page, q, sum(v) AS votes FROM v GROUP BY 1, 2)
SELECT page, q AS query, row_number() OVER (PARTITION BY page ORDER BY round(votes, 9), q) - 1 AS rank FROM s""")
def reading_order(s, d):
    x = box_rows(s, d).select("page", F.col("ord").alias("i"), F.col("top").alias("a"))
    y = box_rows(s, d).select("page", F.col("ord").alias("j"), F.col("top").alias("b"))
    pairs = x.join(y, "page").where("i < j").select("page", "i", "j", ((F.col("b") - F.col("a")) * 5).alias("logit"))
    return B.order_votes(pairs, ["page"]).select("page", "query", F.col("rank").cast("bigint").alias("rank"))


@query("order_agreement", r""", m AS (SELECT page, ord AS a, row_number() OVER (PARTITION BY page ORDER BY t, ord) AS b FROM box) SELECT m.page, count(*) AS pairs, count(*) FILTER (WHERE m.b > n.b) AS inversions FROM m JOIN m n ON m.page = n.page AND m.a < n.a GROUP BY m.page""")
def order_agreement(s, d):
    from pyspark.sql import Window as W

    m = box_rows(s, d).select("page", F.col("ord").alias("a"), F.row_number().over(W.partitionBy("page").orderBy("top", "ord")).alias("b"))
    return B.pair_agreement(m, ["page"])


@query("formula_overlap", r""", c AS (SELECT x.page, x.ord AS block, y.ord AS formula, greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) / nullif((y.r - y.l) * (y.b - y.t), 0) AS o FROM box x JOIN box y ON x.page = y.page AND x.class = 5 AND y.class = 7),
g AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY o DESC, formula) AS n FROM c WHERE o >= 0.2) SELECT page, block, formula FROM g WHERE n = 1""")
def formula_overlap(s, d):
    x = box_rows(s, d).where("class = 5").select("page", F.col("ord").alias("block"), B.box().alias("x"))
    y = box_rows(s, d).where("class = 7").select("page", F.col("ord").alias("formula"), B.box().alias("y"))
    c = x.join(y, "page").withColumn("o", G.containment(F.col("y"), F.col("x"))).where("o >= 0.2")
    return ST.newest(c, ["page", "block"], [F.desc("o"), "formula"]).select("page", "block", "formula")


@query("contents_asof", r""", h AS (SELECT * FROM box WHERE class = 2), p AS (SELECT * FROM box WHERE class <> 2) SELECT p.page, p.ord, max(h.ord) AS heading FROM p JOIN h ON h.page = p.page AND h.ord < p.ord
 AND greatest(least(p.r, h.r) - greatest(p.l, h.l), 0) / greatest(least(p.r - p.l, h.r - h.l), 0.001) >= 0.5 GROUP BY 1, 2""")
def contents_asof(s, d):
    """The last heading before each block in its column."""
    h = box_rows(s, d).where("class = 2").select("page", F.col("ord").alias("heading"), B.box().alias("h"))
    p = box_rows(s, d).where("class <> 2").select("page", "ord", B.box().alias("p"))
    return p.join(h, "page").where((F.col("heading") < F.col("ord")) & (G.column_overlap(F.col("p"), F.col("h")) >= 0.5)).groupBy("page", "ord").agg(F.max("heading").alias("heading"))


@query("evidence_positions", r"""SELECT page, ord, row_number() OVER (PARTITION BY page, class % 3 ORDER BY ord) - 1 AS position FROM box""")
def evidence_positions(s, d):
    rows = box_rows(s, d).select(F.col("page").cast("string").alias("documentId"), F.lit(0).alias("pageNumber"), (F.col("class") % 3).cast("string").alias("channel"), "page", "ord", "score", *B.BOX)
    return EV.positioned(rows).select("page", "ord", F.col("position").cast("bigint").alias("position"))


@query("logit_average", r""", w AS (SELECT vec_id, unnest([0, 16, 32, 48]) AS s, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)),
c AS (SELECT vec_id, s, unnest(generate_series(s, least(s + 31, 63))) AS cp, v FROM w WHERE s <= 32) SELECT vec_id, CAST(cp AS INTEGER) AS cp, round(1 / (1 + exp(-(0.5 + avg(v[cp + 1] + s / 100.0)))), 6) AS p FROM c GROUP BY vec_id, cp""")
def logit_average(s, d):
    """Logits of overlapping windows averaged per place and passed through the adapter."""
    v = table(s, d, "embeddings")
    w = v.select("vec_id", "embedding", F.explode(EV.window_starts(F.lit(64), 32, 16)).alias("s"))
    each = w.select("vec_id", "s", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + 31, F.lit(63)))).alias("cp"), "embedding")
    z = F.avg(F.col("embedding")[F.col("cp")].cast("double") + F.col("s") / 100.0)
    return each.groupBy("vec_id", "cp").agg(F.round(X.sigmoid(F.lit(0.5) + z), 6).alias("p"))


@query("geometric_confidence", r"""SELECT documentId, round(exp(avg(ln(greatest(confidence::DOUBLE, 1e-8)))), 6) AS c FROM sen GROUP BY documentId""")
def geometric_confidence(s, d):
    return sen(s, d, "id", "documentId", "confidence").groupBy("documentId").agg(F.round(F.exp(F.avg(F.log(F.greatest(F.col("confidence").cast("double"), F.lit(1e-8))))), 6).alias("c"))


# ---------------------------------------------------------------- ink


@query("stroke_bounds", _STROKES + "SELECT documentId, min(p.x)::DOUBLE AS left, min(p.y)::DOUBLE AS top, max(p.x)::DOUBLE AS right, max(p.y)::DOUBLE AS bottom FROM (SELECT documentId, unnest(pts) AS p FROM st) GROUP BY 1")
def stroke_bounds(s, d):
    return ink.stroke_bounds(stroke_rows(s, d), ["documentId"])


@query("stroke_select", _STROKES + "SELECT id FROM st WHERE len(list_filter(pts, lambda p: p.x BETWEEN 0.2 AND 0.4 AND p.y BETWEEN 0.2 AND 0.4)) > 0")
def stroke_select(s, d):
    b = F.struct(F.lit(0.2).alias("left"), F.lit(0.2).alias("top"), F.lit(0.4).alias("right"), F.lit(0.4).alias("bottom"))
    return stroke_rows(s, d).where(G.any_inside(F.col("points"), b)).select("id")


@query("stroke_transform", _STROKES + "SELECT id, round(list_sum(list_transform(pts, lambda p: greatest(0, least(1, 0.5 + (greatest(0, least(1, p.x + 0.1)) - 0.5) * 1.5)))), 6)::DOUBLE AS xs FROM st")
def stroke_transform(s, d):
    p = G.scaled(G.moved(F.col("points"), F.lit(0.1), F.lit(-0.05)), F.lit(0.5), F.lit(0.5), F.lit(1.5), F.lit(0.8))
    return stroke_rows(s, d).select("id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x["x"]), 6).alias("xs"))


# ---------------------------------------------------------------- sentences out of pages


# ---------------------------------------------------------------- pages


def observed_pages(s, d) -> DataFrame:
    """Boxes as regions, points as one-letter lines of both sources, and the boxes of one class as formulas too."""
    none = F.array().cast("array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>")
    region = F.struct((F.col("class") * 2).cast("int").alias("class"), "score", F.col("ord").cast("int").alias("readingOrder"), *B.BOX, F.lit(None).cast("binary").alias("mask"))
    formula = F.when(F.col("class") == 5, F.struct(F.lit("INLINE").alias("type"), F.lit(r"\[x\]").alias("latex"), F.col("score").alias("confidence"), *B.BOX))
    regions = box_rows(s, d).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ord", region.alias("r")))).alias("r"), F.collect_list(formula).alias("formulas"))
    line = F.struct(F.lit("word").alias("text"), F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + 0.05).alias("right"), (F.col("y") + 0.02).alias("bottom"), F.lit(0.9).alias("confidence"), none.alias("glyphs"), F.lit(False).alias("isFormula"))
    lines = point_rows(s, d).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("point", line.alias("l")))), lambda x: x["l"]).alias("native"))
    return regions.join(lines, "page").select(
        F.col("page").cast("string").alias("documentId"), F.lit(0).alias("pageNumber"), F.transform("r", lambda x: x["r"]).alias("regions"), "native", F.col("native").alias("ocr"), "formulas")


@query("page_parse", None)
def page_parse(s, d):
    from folioflow.operators.page_parse import parse_pages

    return parse_pages(observed_pages(s, d)).select("documentId", "position", "type", "layoutLabel", F.size("lines").alias("lines"))


@query("light_pages", r""", px AS (SELECT page, CAST(floor(255 * (1 - abs(v[1]))) AS INTEGER) AS r, CAST(floor(255 * (1 - abs(v[2]))) AS INTEGER) AS g, CAST(floor(255 * (1 - abs(v[3]))) AS INTEGER) AS b FROM e)
SELECT page, (count(*) FILTER (WHERE (r * 299 + g * 587 + b * 114) // 1000 >= 205) * 100 >= count(*) * 55 AND count(*) FILTER (WHERE greatest(r, g, b) - least(r, g, b) <= 28) * 100 >= count(*) * 78) AS light FROM px GROUP BY page""")
def light_pages(s, d):
    c = lambda k: F.floor(255 * (1 - F.abs(k))).cast("int")
    return EV.light_paper(emb(s, d).select("page", c("v1").alias("r"), c("v2").alias("g"), c("v3").alias("b")), ["page"])


@query("vocabulary_rows", r"SELECT lower(trim(title)) AS id, min(doc_id) AS first, count(*) AS n FROM documents WHERE trim(title) <> '' GROUP BY 1")
def vocabulary_rows(s, d):
    t = table(s, d, "documents").where("trim(title) <> ''")
    words = t.select("doc_id", *LIB.vocabulary_row(F.col("title"), F.lit(""), F.lit(None).cast("string"), F.lit(0)))
    return words.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query("front_matter", r""", h AS (SELECT page, min(ord) FILTER (WHERE class = 1) AS title FROM box GROUP BY page), a AS (SELECT h.page, h.title, min(b.ord) AS abstract FROM h JOIN box b ON b.page = h.page AND b.class = 2 AND b.ord > h.title GROUP BY 1, 2)
SELECT b.page, b.ord, CASE WHEN b.class NOT IN (1, 2) AND b.ord < a.title THEN 'HEADER' WHEN b.class NOT IN (1, 2) AND b.ord > a.title AND b.ord < a.abstract THEN 'AUTHOR' WHEN b.class = 1 THEN 'DOCUMENT_TITLE' WHEN b.class = 2 THEN 'ABSTRACT' ELSE 'PARAGRAPH' END AS type FROM box b LEFT JOIN a USING (page)""")
def front_matter(s, d):
    return B.front_roles(box_rows(s, d).withColumn("type", F.when(F.col("class") == 1, "DOCUMENT_TITLE").when(F.col("class") == 2, "ABSTRACT").otherwise("PARAGRAPH")), ["page"]).select("page", "ord", "type")
