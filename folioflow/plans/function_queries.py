"""Queries of single functions, of batches and contexts, of boxes and ink, of models' answers, and of the sentence stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import schema
from folioflow.functions import codecs, geometry as G, text as X
from folioflow.functions.latex import COMMANDS, DIGITS, LOWERED, RAISED, encoded
from folioflow.operators import boxes as B, evidence as EV, ink, library as LIB, records as RC, retrieval as RT, store as ST
from folioflow.operators.sentence_stream import segment_documents
from folioflow.plans.registry import _STROKES, box_rows, disp, emb, lib, point_rows, query, rev, sen, stroke_rows, table

c, lit = F.col, F.lit
_WS = r"[ \t\n\x0b\f\r]"


def shown():
    return X.display_text(c("correctedText"), c("originalText"))


# ---------------------------------------------------------------- context and batches


@query("context_retrieval", r""", want AS (SELECT o.* FROM ordn o JOIN (SELECT sentenceId AS id FROM rev) m USING (id)),
tok AS (SELECT id, documentId, ord, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM ordn),
near AS (SELECT w.id AS sentenceId, 0 AS part, o.ord AS rank, o.pageNumber, o.text FROM want w JOIN ordn o ON o.documentId = w.documentId AND abs(o.ord - w.ord) <= 2),
kw AS (SELECT DISTINCT w.id AS sentenceId, w.documentId, w.ord AS o, t.word FROM want w JOIN tok t ON t.id = w.id WHERE length(t.word) >= 5),
hit AS (SELECT k.sentenceId, t.id, t.ord, count(*) AS hits FROM kw k JOIN tok t ON t.documentId = k.documentId AND t.word = k.word WHERE abs(t.ord - k.o) > 2 GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY sentenceId ORDER BY hits DESC, ord) AS rank FROM hit),
al AS (SELECT * FROM near UNION ALL SELECT t.sentenceId, 1, t.rank, o.pageNumber, o.text FROM top t JOIN ordn o USING (id) WHERE t.rank <= 3)
SELECT sentenceId, string_agg('[p.' || (pageNumber + 1) || '] ' || text, chr(10) ORDER BY part, rank) AS context FROM al GROUP BY sentenceId""")
def context_retrieval(s, d):
    """Context of every sentence in the review queue."""
    return RT.context_of(disp(s, d), rev(s, d).select("sentenceId"))


_BATCHES = r""", sz AS (SELECT documentId, ord, pageNumber, text, sum(coalesce(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')), 0)) OVER (PARTITION BY documentId ORDER BY ord) AS cum FROM ordn),
b0 AS (SELECT a.documentId, a.ord, a.ord + greatest(1, count(b.ord)) AS nxt FROM sz a LEFT JOIN sz z ON z.documentId = a.documentId AND z.ord = a.ord - 1
  LEFT JOIN sz b ON b.documentId = a.documentId AND b.ord BETWEEN a.ord AND a.ord + 15 AND b.cum - coalesce(z.cum, 0) <= 9000 GROUP BY 1, 2),
bt AS (SELECT documentId, ord AS start, nxt AS "end" FROM b0 WHERE ord = 0 UNION ALL SELECT b0.documentId, b0.ord, b0.nxt FROM bt JOIN b0 ON b0.documentId = bt.documentId AND b0.ord = bt."end") """
query("greedy_batches", _BATCHES + 'SELECT documentId, start, CAST("end" AS BIGINT) AS "end" FROM bt')(lambda s, d: RT.greedy_batches(disp(s, d)))


@query("batch_context", _BATCHES + """, ats AS (SELECT documentId, start, unnest([start - 2, start - 1, "end", "end" + 1]) AS ord FROM bt)
SELECT a.documentId, a.start, coalesce(string_agg('[p.' || (o.pageNumber + 1) || '] ' || o.text, chr(10) ORDER BY o.ord), '') AS context FROM ats a JOIN ordn o USING (documentId, ord) GROUP BY 1, 2""")
def batch_context(s, d):
    """The two sentences before and after each batch."""
    b = RT.greedy_batches(disp(s, d))
    o = RT.ordinals(disp(s, d)).select("documentId", c("ord").cast("bigint").alias("ord"), "pageNumber", shown().alias("text"))
    at = b.select("documentId", "start", F.explode(F.array(c("start") - 2, c("start") - 1, c("end"), c("end") + 1)).alias("ord"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", X.page_line(c("pageNumber"), c("text")).alias("line")))), lambda x: x["line"])
    return at.join(o, ["documentId", "ord"]).groupBy("documentId", "start").agg(F.array_join(lines, "\n").alias("context"))


@query("analysis_text", r""", n AS (SELECT documentId, count(*) AS n FROM ordn GROUP BY 1) SELECT o.documentId, substr(string_agg(coalesce(o.text, ''), chr(10) ORDER BY o.ord), 1, 24000) AS text FROM ordn o JOIN n USING (documentId) WHERE o.ord < 30 OR o.ord % greatest(n.n // 80, 1) = 0 GROUP BY 1""")
def analysis_text(s, d):
    return RT.analysis_text(disp(s, d))


@query("resume_page", r""", p AS (SELECT DISTINCT documentId, pageNumber AS f, coalesce(list_max(list_transform(string_split(regions, '|'), lambda x: try_cast(split_part(x, ',', 1) AS INTEGER))), pageNumber) + pageNumber % 3 AS l FROM sen),
dn AS (SELECT id AS documentId, CAST(min(processedPages) AS INTEGER) AS c FROM lib GROUP BY id),
st AS (SELECT documentId, c FROM dn UNION ALL SELECT st.documentId, min(p.f) FROM st JOIN p ON p.documentId = st.documentId AND p.f < st.c AND p.l >= st.c GROUP BY st.documentId)
SELECT documentId, min(c) AS page FROM st WHERE documentId IN (SELECT documentId FROM p) GROUP BY 1""")
def resume_page(s, d):
    """Page to read each document from again; sentences are taken to reach up to two pages further than they do."""
    r = codecs.decode_regions(c("regions"))
    p = sen(s, d, "documentId", "pageNumber", "regions").select("documentId", c("pageNumber").alias("first"), (F.coalesce(F.array_max(F.transform(r, lambda b: b["page"])), c("pageNumber")) + c("pageNumber") % 3).alias("last")).distinct()
    committed = lib(s, d).groupBy(c("id").alias("documentId")).agg(F.min("processedPages").alias("c"))
    spans = p.join(committed, "documentId").groupBy("documentId", "c").agg(F.collect_set(F.struct("first", "last")).alias("x"))
    return spans.select("documentId", RT.resume_page(c("c"), c("x")).cast("int").alias("page"))


@query("library_active", "SELECT id, title, lastOpenedAt, row_number() OVER (ORDER BY lastOpenedAt DESC NULLS LAST, id) AS rank FROM lib WHERE NOT isTrashed")
def library_active(s, d):
    from folioflow.plans.store_queries import ranked

    return ranked(ST.lookup(lib(s, d), isTrashed=False), ["isTrashed"], [F.desc("lastOpenedAt"), "id"]).select("id", "title", "lastOpenedAt", "rank")


@query("settings_typed", r"SELECT user_id, greatest(20, least(60, arg_max(try_cast(json_extract_string(props, '$.k') AS INTEGER), event_id))) AS k FROM events GROUP BY user_id")
def settings_typed(s, d):
    e = table(s, d, "events").select("user_id", c("event_id").alias("ord"), lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value"))
    return ST.settings_map(e, ["user_id"]).select("user_id", codecs.setting(c("settings"), "k", "int", 30, 20, 60).alias("k"))


# ---------------------------------------------------------------- text

_PRIMES = (31, 43, 59, 61, 73, 97, 103, 113)  # fixed values
query("cp_hash", "SELECT id, " + ", ".join(f"list_sum(list_transform(string_split(originalText, ''), lambda c: ((unicode(c) + 1) * {k}) % 8192))::BIGINT AS h{k}" for k in _PRIMES) + " FROM sen WHERE originalText <> ''")(
    lambda s, d: sen(s, d, "id", "originalText").where("originalText <> ''").select(
        "id", F.aggregate(F.transform(F.filter(F.split("originalText", ""), lambda x: x != ""), EV.code_point), F.array_repeat(lit(0).cast("bigint"), len(_PRIMES)), lambda a, x: F.zip_with(a, EV.code_point_hashes(x, list(_PRIMES)), lambda u, v: u + v)).alias("h"))
    .select("id", *[c("h")[i].alias(f"h{k}") for i, k in enumerate(_PRIMES)]))

_SPANS = r""", prt AS (SELECT id, string_split(regexp_replace(originalText, '(\\\[[\s\S]*?\\\])', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps FROM sen WHERE originalText IS NOT NULL),
sp AS (SELECT id, ps, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS i FROM prt),
sk AS (SELECT id, i, text, CASE WHEN i % 2 = 1 THEN 'TEXT' WHEN trim(regexp_extract(array_to_string(ps[1:i - 1], ''), '[^\n]*$'), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) = '' AND trim(regexp_extract(array_to_string(ps[i + 1:], ''), '^[^\n]*'), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) = ''
  THEN 'DISPLAY_FORMULA' ELSE 'INLINE_FORMULA' END AS kind FROM sp WHERE text <> '') """


@query("span_rows", _SPANS + "SELECT id AS sentenceId, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS position, kind, text FROM sk")
def span_rows(s, d):
    t = sen(s, d, "id", "originalText").where("originalText is not null")
    return t.select(c("id").alias("sentenceId"), F.posexplode(X.spans(c("originalText"))).alias("position", "x")).select("sentenceId", "position", "x.kind", "x.text")


def _latex_sql(t: str) -> str:
    body = f"regexp_replace(regexp_replace({t}, '([{RAISED}]+)', '^{{\\1}}', 'g'), '([{LOWERED}]+)', '_{{\\1}}', 'g')"
    body = f"regexp_replace(translate({body}, '{RAISED + LOWERED}', '{DIGITS + DIGITS}'), '([%#&])', '\\\\\\1', 'g')"
    for k, v in COMMANDS.items():
        body = f"replace({body}, '{k}', '\\{v} ')"
    return f"'\\[' || regexp_replace(regexp_replace({body}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') || '\\]'"


query("latex_encode", f", t AS (SELECT id, regexp_replace(regexp_replace(originalText, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM sen WHERE originalText IS NOT NULL) SELECT id, CASE WHEN t = '' OR (starts_with(t, '\\[') AND ends_with(t, '\\]')) THEN t ELSE {_latex_sql('t')} END AS latex FROM t")(
    lambda s, d: sen(s, d, "id", "originalText").where("originalText is not null").select("id", encoded(c("originalText")).alias("latex")))

_FORMULAS = r", f AS (SELECT id, unnest(regexp_extract_all(originalText, '\\\[[\s\S]*?\\\]')) AS f FROM sen WHERE originalText IS NOT NULL) "


@query("formula_words", _FORMULAS + r""", b AS (SELECT id, f, regexp_replace(regexp_replace(substr(f, 3, length(f) - 4), '((\\[!,;:])|\\(quad|qquad|enspace|thinspace|medspace|thickspace))+\s*$', ''), '\s+$', '') AS b FROM f)
SELECT id, f, CASE WHEN id % 2 = 0 THEN 'variable' ELSE 'equation (1)' END || CASE WHEN regexp_matches(b, '\\(right|left)\.$') THEN '' ELSE regexp_extract(b, '[.,;:?!]$') END AS w FROM (SELECT DISTINCT length(id) + CAST(substr(id, 2) AS BIGINT) AS id, f, b FROM b)""")
def formula_words(s, d):
    """What a boundary model reads for each formula; by turns inline and numbered."""
    f = sen(s, d, "id", "originalText").select((F.length("id") + F.substring("id", 2, 20).cast("bigint")).alias("id"), F.explode(F.regexp_extract_all("originalText", lit(r"\\\[[\s\S]*?\\\]"), lit(0))).alias("f")).distinct()
    kind = F.when(c("id") % 2 == 0, "INLINE_FORMULA").otherwise("DISPLAY_FORMULA")
    return f.select("id", "f", X.model_word(kind, lit(True), c("f")).alias("w"))


query("filled_templates", "SELECT id, replace(replace('A {context} of {text} in {context}', '{context}', coalesce(folderId, '-')), '{text}', title) AS t FROM lib WHERE title NOT LIKE '%{%'")(
    lambda s, d: lib(s, d).where("title NOT LIKE '%{%'").select("id", X.fill_template(lit("A {context} of {text} in {context}"), F.coalesce("folderId", lit("-")), c("title")).alias("t")))
query("tag_split", "SELECT doc_id, list_filter(list_transform(string_split(replace(title, '，', ','), ','), lambda t: trim(t)), lambda t: t <> '') AS names FROM documents WHERE title IS NOT NULL AND title NOT LIKE '%' || chr(9) || '%'")(
    lambda s, d: table(s, d, "documents").where("title is not null and title not like '%\t%'").select("doc_id", X.tag_names(c("title")).alias("names")))
query("routes", "SELECT id, kind, CASE WHEN kind IN ('reader', 'note') THEN id WHEN kind = 'settings' AND pageCount % 2 = 0 THEN id END AS argument FROM (SELECT id, pageCount, ['library', 'reader', 'settings', 'note', 'vocabulary'][1 + pageCount % 5] AS kind FROM lib)")(
    lambda s, d: lib(s, d).select("id", F.array(*map(lit, codecs.ROUTES))[c("pageCount") % 5].alias("k"), "pageCount").select("id", codecs.decode_route(codecs.encode_route(c("k"), F.when(c("k").isin("reader", "note") | ((c("k") == "settings") & (c("pageCount") % 2 == 0)), c("id")))).alias("r")).select("id", "r.kind", "r.argument"))
query("reliable_rows", r"""SELECT id, (regexp_matches(originalText, '[\pL\p{Nd}]') AND CAST(length(regexp_replace(originalText, '[^\pL\p{Nd} \t\n\x0b\f\r.,;:!?()\[\]{}''"\-/+*=<>%&@#_\\]', '', 'g')) / greatest(length(originalText), 1)::DOUBLE AS FLOAT) >= CAST(0.82 AS FLOAT)) AS ok FROM sen WHERE originalText IS NOT NULL""")(
    lambda s, d: sen(s, d, "id", "originalText").where("originalText is not null").select("id", X.readable(c("originalText")).alias("ok")))
query("region_codec", r""", r AS (SELECT id, string_split(unnest(string_split(regions, '|')), ',') AS p FROM sen) SELECT id, try_cast(p[1] AS INTEGER) AS page, try_cast(p[2] AS FLOAT) AS l, try_cast(p[3] AS FLOAT) AS t, try_cast(p[4] AS FLOAT) AS r, try_cast(p[5] AS FLOAT) AS b FROM r
WHERE len(p) = 5 AND try_cast(p[1] AS INTEGER) IS NOT NULL AND try_cast(p[2] AS FLOAT) IS NOT NULL AND try_cast(p[3] AS FLOAT) IS NOT NULL AND try_cast(p[4] AS FLOAT) IS NOT NULL AND try_cast(p[5] AS FLOAT) IS NOT NULL""")(
    lambda s, d: sen(s, d, "id", "regions").select("id", F.explode(codecs.decode_regions(codecs.encode_regions(codecs.decode_regions(c("regions"))))).alias("x")).select("id", "x.page", c("x.left").alias("l"), c("x.top").alias("t"), c("x.right").alias("r"), c("x.bottom").alias("b")))
query("page_quality", "SELECT p.documentId, p.pageNumber, round(coalesce(q.q, CASE WHEN p.textQuality > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS quality FROM (SELECT DISTINCT * FROM pages) p LEFT JOIN (SELECT documentId, pageNumber, avg(confidence::DOUBLE) AS q FROM sen GROUP BY 1, 2) q USING (documentId, pageNumber)")(
    lambda s, d: EV.page_quality(table(s, d, "pages").distinct(), sen(s, d, "id", "documentId", "pageNumber", "confidence"), ["documentId", "pageNumber"], c("textQuality") > 0.5).select("documentId", "pageNumber", F.round("quality", 6).alias("quality")))
query("block_texts", "SELECT documentId, pageNumber, CASE WHEN pageNumber % 3 = 1 THEN '' ELSE coalesce(string_agg(text, chr(10) ORDER BY position, id), '') END AS text FROM disp GROUP BY 1, 2")(
    lambda s, d: disp(s, d).withColumn("t", shown()).groupBy("documentId", "pageNumber").agg(F.transform(F.sort_array(F.collect_list(F.when(c("t").isNotNull(), F.struct("position", "id", "t")))), lambda x: x["t"]).alias("ls"))
    .select("documentId", "pageNumber", LIB.block_text(c("ls"), F.when(c("pageNumber") % 3 == 1, "IMAGE").otherwise("PARAGRAPH"), schema.IMAGE_BLOCK_TYPES).alias("text")))


@query("reply_validate", r""", q AS (SELECT *, CAST(createdAt % 5 AS INTEGER) AS k FROM rev) SELECT sentenceId, CASE WHEN k = 0 THEN 'DUPLICATE' WHEN k = 1 THEN 'MISMATCH' WHEN k = 2 THEN 'UNREADABLE'
 WHEN proposedText IS NULL OR translatedText IS NULL OR regexp_replace(proposedText, '[ \t\n\x0b\f\r]+', '', 'g') = '' OR regexp_replace(translatedText, '[ \t\n\x0b\f\r]+', '', 'g') = '' THEN 'EMPTY' ELSE 'OK' END AS verdict FROM q""")
def reply_validate(s, d):
    """Each review as a one-item reply in a code fence, by turns with its item twice, another id, or broken JSON."""
    k = c("createdAt") % 5
    item = F.struct(F.when(k == 1, F.concat(lit("x"), "sentenceId")).otherwise(c("sentenceId")).alias("id"), c("proposedText").alias("corrected_source"), c("translatedText").alias("zh_translation"))
    json = F.to_json(F.struct(F.when(k == 0, F.array(item, item)).otherwise(F.array(item)).alias("items")))
    reply = F.concat(lit("```json\n"), F.when(k == 2, F.concat(lit("["), json)).otherwise(json), lit("\n```"))
    return EV.validated_replies(rev(s, d).select(c("sentenceId").alias("batch"), F.array("sentenceId").alias("ids"), reply.alias("reply"))).select(c("batch").alias("sentenceId"), "verdict")


query("request_json", "SELECT documentId, pageNumber, string_agg(id || '=' || text, chr(10) ORDER BY position, id) AS items FROM disp WHERE text IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: EV.batch_requests(disp(s, d).where(shown().isNotNull()).withColumn("text", shown()), ["documentId", "pageNumber"])
    .select("documentId", "pageNumber", F.array_join(F.transform(F.from_json("request", "items array<struct<id:string,source:string>>")["items"], lambda i: F.concat(i["id"], lit("="), i["source"])), "\n").alias("items")))
query("usage_counts", "SELECT event_id, CAST(event_id % 7 AS INTEGER) AS prompt_tokens, 0 AS prompt_cache_hit_tokens, 0 AS prompt_cache_miss_tokens, CAST(user_id AS INTEGER) AS completion_tokens FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"prompt_cache_hit_tokens":"x"}}', c("event_id") % 7, c("user_id")).alias("j")).select("event_id", EV.usage(c("j")).alias("u")).select("event_id", "u.*"))


@query("text_layers", r"SELECT documentId, pageNumber, string_agg(text, chr(10) ORDER BY position, id) AS lines FROM disp WHERE text IS NOT NULL GROUP BY 1, 2")
def text_layers(s, d):
    """Each page's sentences written as a text layer and read back."""
    cell = F.struct(c("position"), c("id"), F.struct(shown().alias("text"), lit(0.0).alias("left"), c("position").cast("double").alias("top"), lit(9.0).alias("right"), (c("position") + 1.0).alias("bottom")).alias("cell"))
    page = F.struct(lit(100.0).alias("width"), lit(100.0).alias("height"), F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["cell"]).alias("lines"), F.array().cast("array<struct<text:string>>").alias("words"))
    layers = disp(s, d).where(shown().isNotNull()).groupBy("documentId", c("pageNumber").alias("p")).agg(F.to_json(F.struct(F.array(page).alias("pages"))).alias("json"))
    return EV.text_layer_pages(layers).select("documentId", c("p").alias("pageNumber"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("lines"))


# ---------------------------------------------------------------- models' answers and records

def _decisions(s, d) -> DataFrame:
    items = rev(s, d).select("sentenceId", c("proposedText").alias("proposed"), "translatedText")
    return RC.decided(sen(s, d, "id", "documentId", "pageNumber", "originalText", "correctedText"), items, lit(0.25), lit(True))


@query("decisions_off", "SELECT s.id AS sentenceId, s.correctedText FROM sen s JOIN rev r ON r.sentenceId = s.id")
def decisions_off(s, d):
    """With corrections off every old correction stays."""
    items = rev(s, d).select("sentenceId", c("proposedText").alias("proposed"), "translatedText")
    return RC.decision_rows(RC.decided(sen(s, d, "id", "documentId", "pageNumber", "originalText", "correctedText"), items, lit(0.25), lit(False)), lit(0).cast("bigint"))[0]


# A correction in SQL: the edit distance row by row, only where the lengths allow it.
_ACCEPT = r"""list_reduce(string_split({a}, ''), lambda row, ch: list_reduce(range(1, length({b}) + 1), lambda nr, j: list_append(nr, least(nr[j] + 1, row[j + 1] + 1, row[j] + CASE WHEN string_split({b}, '')[j] = ch THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, length({b}) + 1))[length({b}) + 1]"""
_TRIM = r"regexp_replace({0}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
_FORMULA = r"regexp_extract_all({0}, '\\\[[\s\S]*?\\\]|\$[^$]+\$')"
_TAKEN = (
    ", ca AS (SELECT *, " + _TRIM.format("proposed") + " AS cl FROM rq), cm AS (SELECT *, greatest(1, CAST(floor(CAST(greatest(length(src), length(cl), 1) AS FLOAT) * CAST(0.25 AS FLOAT)) AS INTEGER)) AS most FROM ca),"
    + " cd AS (SELECT *, CASE WHEN cl <> '' AND cl <> src AND abs(length(src) - length(cl)) <= most AND " + _FORMULA.format("cl") + " = " + _FORMULA.format("src") + " THEN " + _ACCEPT.format(a="src", b="cl") + " END AS dist FROM cm),"
    + " ct AS (SELECT *, CASE WHEN dist <= most THEN cl END AS taken FROM cd) "
)
query("accept_correction", ", rq AS (SELECT sentenceId, parsedText AS src, proposedText AS proposed FROM rev)" + _TAKEN + "SELECT sentenceId, taken AS accepted FROM ct")(
    lambda s, d: rev(s, d).select("sentenceId", X.accepted_correction(c("parsedText"), c("proposedText"), lit(0.25)).alias("accepted")))
_DECIDED = (
    ", rq AS (SELECT s.id, s.documentId, s.pageNumber, s.originalText, s.correctedText, coalesce(s.correctedText, s.originalText) AS src, r.proposedText AS proposed, r.translatedText FROM sen s JOIN rev r ON r.sentenceId = s.id)"
    + _TAKEN + ", dc AS (SELECT *, CASE WHEN cl = src THEN cl ELSE taken END AS fin FROM ct) "
)
query("decisions", _DECIDED + "SELECT id, CASE WHEN fin IS NULL THEN correctedText ELSE nullif(fin, originalText) END AS stored, fin IS NULL AS review FROM dc")(lambda s, d: _decisions(s, d).select("id", "stored", "review"))
query("decision_reviews", _DECIDED + "SELECT id AS sentenceId, documentId, pageNumber, src AS parsedText, proposed AS proposedText, translatedText FROM dc WHERE fin IS NULL")(
    lambda s, d: RC.decision_rows(_decisions(s, d), lit(0).cast("bigint"))[2].select("sentenceId", "documentId", "pageNumber", "parsedText", "proposedText", "translatedText"))
query("decision_translations", _DECIDED + "SELECT id AS sentenceId, coalesce(CASE WHEN fin IS NULL THEN correctedText ELSE nullif(fin, originalText) END, originalText) AS sourceText, translatedText FROM dc")(
    lambda s, d: RC.decision_rows(_decisions(s, d), lit(0).cast("bigint"))[1].select("sentenceId", "sourceText", "translatedText"))

_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("sentence_records", f"SELECT {_UUID} AS id, documentId, pageNumber, position, originalText, CASE WHEN position % 2 = 0 THEN 'old' END AS correctedText, 'HYBRID_PDF_VISUAL:BODY' AS source, regions FROM (SELECT *, md5(documentId || ':' || pageNumber || ':' || position) AS h, pageNumber || ',0.0,0.5,1.0,1.0' AS regions FROM sen WHERE originalText IS NOT NULL)".replace("SELECT *, md5", "SELECT documentId, pageNumber, position, originalText, md5"))
def sentence_records(s, d):
    """Sentences as rows of the store; those at even positions had a correction before."""
    t = sen(s, d, "documentId", "pageNumber", "position", "originalText", "confidence").where("originalText is not null")
    box = F.array(F.struct(c("pageNumber").alias("page"), lit(-1.0).alias("left"), lit(0.5).alias("top"), lit(1.0).alias("right"), lit(7.0).alias("bottom")))
    found = t.select("documentId", c("pageNumber").alias("firstPage"), "position", c("originalText").alias("text"), lit("BODY").alias("role"), "confidence", box.alias("regions"))
    key = F.concat_ws(":", "documentId", c("pageNumber").cast("string"), c("position").cast("string"))
    old = t.where("position % 2 = 0").select(codecs.name_uuid(key).alias("id"), lit("old").alias("correctedText")).distinct()
    return RC.sentence_records(found, old).select("id", "documentId", "pageNumber", "position", "originalText", "correctedText", "source", "regions")


# ---------------------------------------------------------------- boxes

_IOU = "greatest(least({0}.r, {1}.r) - greatest({0}.l, {1}.l), 0) * greatest(least({0}.b, {1}.b) - greatest({0}.t, {1}.t), 0) / nullif(({0}.r - {0}.l) * ({0}.b - {0}.t) + ({1}.r - {1}.l) * ({1}.b - {1}.t) - greatest(least({0}.r, {1}.r) - greatest({0}.l, {1}.l), 0) * greatest(least({0}.b, {1}.b) - greatest({0}.t, {1}.t), 0), 0)"
_TWIN = """, bx AS (SELECT page, ord, class % 3 AS class, score, l, t, r, b FROM box UNION ALL SELECT page, ord + 100000, (class + 1) % 3, score / 2, l, t, r, b FROM box) """


def twin_boxes(s, d) -> DataFrame:
    """The boxes in three classes, and each once more in another class with half its score."""
    b = box_rows(s, d)
    again = b.withColumn("ord", c("ord") + 100000).withColumn("class", c("class") + 1).withColumn("score", c("score") / 2)
    return b.unionByName(again).withColumn("class", c("class") % 3)


query("nms", _TWIN + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS n FROM bx),
k AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ord BIGINT, class INTEGER, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[]) AS kept FROM bx
  UNION ALL SELECT k.page, x.n, CASE WHEN len(list_filter(k.kept, lambda q: {_IOU.format('q', 'x')} >= CASE WHEN q.class = x.class THEN 0.6 ELSE 0.98 END)) > 0 THEN k.kept
    ELSE list_append(k.kept, CAST(struct_pack(ord := x.ord, class := x.class, l := x.l, t := x.t, r := x.r, b := x.b) AS STRUCT(ord BIGINT, class INTEGER, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE))) END FROM k JOIN rk x ON x.page = k.page AND x.n = k.n + 1)
SELECT page, unnest(kept).ord AS ord FROM (SELECT page, arg_max(kept, n) AS kept FROM k GROUP BY page)""")(
    lambda s, d: B.suppressed(twin_boxes(s, d), ["page"]).select("page", "ord"))
query("match_detections", f""", tw AS (SELECT page, ord, class, l + 0.01 AS l, t + 0.01 AS t, r + 0.01 AS r, b + 0.01 AS b FROM box),
cd AS (SELECT x.page, x.ord AS a, y.ord AS b, {_IOU.format('x', 'y')} AS iou FROM box x JOIN tw y ON x.page = y.page AND x.class = y.class WHERE {_IOU.format('x', 'y')} >= 0.5),
al AS (SELECT page, a, list(struct_pack(k := -iou, b := b) ORDER BY -iou, b) AS cs, row_number() OVER (PARTITION BY page ORDER BY a) AS n FROM cd GROUP BY page, a),
k AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a BIGINT, b BIGINT, iou DOUBLE)[]) AS ms FROM cd
  UNION ALL SELECT k.page, al.n, CASE WHEN len(list_filter(al.cs, lambda q: NOT list_contains(list_transform(k.ms, lambda m: m.b), q.b))) = 0 THEN k.ms ELSE list_append(k.ms, CAST(struct_pack(a := al.a,
    b := list_filter(al.cs, lambda q: NOT list_contains(list_transform(k.ms, lambda m: m.b), q.b))[1].b, iou := -list_filter(al.cs, lambda q: NOT list_contains(list_transform(k.ms, lambda m: m.b), q.b))[1].k) AS STRUCT(a BIGINT, b BIGINT, iou DOUBLE))) END FROM k JOIN al ON al.page = k.page AND al.n = k.n + 1)
SELECT page, m.a, m.b, round(m.iou, 6) AS iou FROM (SELECT page, unnest(arg_max(ms, n)) AS m FROM k GROUP BY page)""")(
    lambda s, d: B.matched(box_rows(s, d), box_rows(s, d).select("page", "ord", "class", "score", *[(c(x) + 0.01).alias(x) for x in B.BOX]), ["page"]).withColumn("iou", F.round("iou", 6)))
query("page_images", """, bg AS (SELECT page, ord, class, CASE WHEN class = 4 THEN l * 0.02 ELSE l END AS l, CASE WHEN class = 4 THEN t * 0.02 ELSE t END AS t, CASE WHEN class = 4 THEN 1 - (1 - r) * 0.1 ELSE r END AS r, CASE WHEN class = 4 THEN 1 - (1 - b) * 0.1 ELSE b END AS b FROM box),
f AS (SELECT *, (class = 4 AND (r - l) * (b - t) > CASE WHEN page % 2 = 0 THEN 0.82 ELSE 0.93 END) AS big FROM bg), g AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, count(*) FILTER (WHERE NOT big) OVER (PARTITION BY page) AS small FROM f) SELECT page, ord FROM g WHERE NOT big OR n <= 1 OR small = 0""")(
    lambda s, d: B.without_page_images(box_rows(s, d).select("page", "ord", F.when(c("class") == 4, schema.LAYOUT_LABELS.index("image")).otherwise(c("class") % 4).alias("class"), *[F.when(c("class") == 4, c(x) * 0.02 if x in ("left", "top") else 1 - (1 - c(x)) * 0.1).otherwise(c(x)).alias(x) for x in B.BOX]), ["page"], c("page") % 2 == 0).select("page", "ord"))
query("crops", """SELECT ord, x AS left, y AS top, CAST(least(greatest(floor(r * 1800 + 0.5), x + 1), 1800) - x AS INTEGER) AS width, CAST(least(greatest(floor(b * 2400 + 0.5), y + 1), 2400) - y AS INTEGER) AS height
FROM (SELECT *, CAST(least(greatest(floor(l * 1800 + 0.5), 0), 1799) AS INTEGER) AS x, CAST(least(greatest(floor(t * 2400 + 0.5), 0), 2399) AS INTEGER) AS y FROM box)""")(
    lambda s, d: box_rows(s, d).select("ord", G.pixel_crop(B.box(), lit(1800), lit(2400)).alias("c")).select("ord", "c.*"))


def _detected(s, d) -> DataFrame:
    """Scores, centres and sizes of 25 queries a page; votes from the boxes' tops."""
    e = emb(s, d)
    cand = e.select("page", (c("vec_id") % 25).alias("query"), "class", (c("v1") * 4).alias("logit"), (lit(0.5) + c("v2")).alias("cx"), (lit(0.5) + c("v3")).alias("cy"), (lit(0.1) + F.abs("v4")).alias("w"), (lit(0.1) + F.abs("v5")).alias("h"))
    order = e.select("page", (c("vec_id") % 25).alias("query"), c("v3").alias("votes"))
    from pyspark.sql import Window as W

    order = order.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy(F.round("votes", 9), "query")) - 1)
    return B.detections(cand, order, ["page"], 0.45, lit(False), 20, [1, 3])


query("detections", """, ca AS (SELECT page, vec_id % 25 AS q, label AS class, (vec_id % 25) * 25 + label AS ord, 1 / (1 + exp(-v[1] * 4)) AS score, greatest(0.0, least(1.0, 0.5 + v[2] - (0.1 + abs(v[4])) / 2)) AS l, greatest(0.0, least(1.0, 0.5 + v[3] - (0.1 + abs(v[5])) / 2)) AS t,
  greatest(0.0, least(1.0, 0.5 + v[2] + (0.1 + abs(v[4])) / 2)) AS r, greatest(0.0, least(1.0, 0.5 + v[3] + (0.1 + abs(v[5])) / 2)) AS b, row_number() OVER (PARTITION BY page ORDER BY round(v[3], 9), vec_id % 25) - 1 AS place FROM e),
tp AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS n FROM ca), rk AS (SELECT * FROM tp WHERE n <= 20 AND score > 0.45),
k AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ord BIGINT, class INTEGER, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[]) AS kept FROM rk
  UNION ALL SELECT k.page, x.n, CASE WHEN len(list_filter(k.kept, lambda kk: """ + _IOU.format("kk", "x") + """ >= CASE WHEN kk.class = x.class THEN 0.6 ELSE 0.98 END)) > 0 THEN k.kept
    ELSE list_append(k.kept, CAST(struct_pack(ord := x.ord, class := x.class, l := x.l, t := x.t, r := x.r, b := x.b) AS STRUCT(ord BIGINT, class INTEGER, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE))) END FROM k JOIN rk x ON x.page = k.page AND x.n = k.n + 1),
kp AS (SELECT page, unnest(arg_max(kept, n)) AS z FROM k GROUP BY page),
un AS (SELECT x.page, x.z.ord AS ord FROM kp x WHERE NOT EXISTS (SELECT 1 FROM kp y WHERE y.page = x.page AND y.z.ord <> x.z.ord AND y.z.class IN (1, 3) AND (x.z.r - x.z.l) * (x.z.b - x.z.t) > 0
  AND greatest(least(x.z.r, y.z.r) - greatest(x.z.l, y.z.l), 0) * greatest(least(x.z.b, y.z.b) - greatest(x.z.t, y.z.t), 0) / ((x.z.r - x.z.l) * (x.z.b - x.z.t)) >= 0.9))
SELECT u.page, u.ord, CAST(row_number() OVER (PARTITION BY u.page ORDER BY c.place, u.ord) - 1 AS INTEGER) AS position FROM un u JOIN ca c ON c.page = u.page AND c.ord = u.ord""")(lambda s, d: _detected(s, d).select("page", "ord", "position"))
query("smallest_holding", "SELECT p.point, arg_min(x.ord, ((x.r - x.l) * (x.b - x.t), x.ord)) AS ord FROM pt p JOIN box x ON x.page = p.page AND p.x BETWEEN x.l AND x.r AND p.y BETWEEN x.t AND x.b GROUP BY p.point")(
    lambda s, d: B.smallest_holding(box_rows(s, d), point_rows(s, d), ["page"]))
query("nearest_centre", "SELECT p.point, arg_min(x.ord, (((x.l + x.r) / 2 - p.x) * ((x.l + x.r) / 2 - p.x) + ((x.t + x.b) / 2 - p.y) * ((x.t + x.b) / 2 - p.y), x.ord)) AS ord FROM pt p JOIN box x ON x.page = p.page GROUP BY p.point")(
    lambda s, d: B.nearest_centre(box_rows(s, d), point_rows(s, d), ["page"]))
query("unmatched_boxes", "SELECT page, ord FROM box WHERE ord % 3 <> 0")(lambda s, d: B.unmatched(box_rows(s, d), box_rows(s, d).where("ord % 3 = 0").select("page", c("ord").alias("a")), ["page"], "a").select("page", "ord"))
query("mask_iou", "SELECT vec_id, round(coalesce(len(list_filter(range(1, 33), lambda i: v[i] > 0 AND v[i + 32] > 0))::DOUBLE / nullif(len(list_filter(range(1, 33), lambda i: v[i] > 0 OR v[i + 32] > 0)), 0), 0), 6) AS iou FROM e")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(B.mask_iou(F.transform(F.slice("embedding", 1, 32), lambda x: (x > 0).cast("int")), F.transform(F.slice("embedding", 33, 32), lambda x: (x > 0).cast("int"))), 6).alias("iou")))
query("owned_points", "SELECT p.point, x.ord FROM pt p JOIN box x ON x.page = p.page AND p.x BETWEEN x.l AND x.r AND p.y BETWEEN x.t AND x.b WHERE x.ord % 2 = 0 OR (CAST(floor(least(1, greatest(0, p.x)) * 200) AS INTEGER) % 2 = 0)")(
    lambda s, d: point_rows(s, d).join(box_rows(s, d), "page").where(G.owns_point(B.box(), F.when(c("ord") % 2 == 1, F.unhex(F.repeat(lit("0100"), 20000))), c("x"), c("y"))).select("point", "ord"))
query("padded_crops", "SELECT ord, round(greatest(0, l - 0.02), 9) AS left, round(greatest(0, t - 0.015), 9) AS top, round(least(1, r + 0.02), 9) AS right, round(least(1, b + 0.015), 9) AS bottom FROM box")(
    lambda s, d: box_rows(s, d).select("ord", G.padded(B.box()).alias("p")).select("ord", *[F.round(f"p.{x}", 9).alias(x) for x in B.BOX]))
query("formula_margins", "SELECT ord, CAST(greatest(2, floor((b - t) * 900 * CASE WHEN class % 2 = 0 THEN 0.04 ELSE 0.10 END + 0.5)) AS INTEGER) AS across, CAST(greatest(2, floor((b - t) * 900 * CASE WHEN class % 2 = 0 THEN 0.08 ELSE 0.10 END + 0.5)) AS INTEGER) AS along FROM box")(
    lambda s, d: box_rows(s, d).select("ord", G.formula_margins(c("class") % 2 == 0, (c("bottom") - c("top")) * 900).alias("m")).select("ord", "m.*"))
query("even_glyphs", "SELECT ord, i AS glyph, substr('glyph', i, 1) AS text, round(l + (r - l) / 5 * (i - 1), 9) AS left, round(l + (r - l) / 5 * i, 9) AS right FROM box, (SELECT unnest(range(1, 6)) AS i) g")(
    lambda s, d: box_rows(s, d).select("ord", F.posexplode(G.even_glyphs(lit("glyph"), c("left"), c("top"), c("right"), c("bottom"), c("score"))).alias("i", "g")).select("ord", (c("i") + 1).cast("bigint").alias("glyph"), "g.text", F.round("g.left", 9).alias("left"), F.round("g.right", 9).alias("right")))
_LABELS = ", ".join(f"({i}, {n!r}, {schema.BLOCK_TYPE_OF_LABEL.get(n, 'PARAGRAPH')!r}, {str(n in schema.OCR_LABELS).lower()}, {str(n in schema.SELECTABLE_LABELS).lower()})" for i, n in enumerate(schema.LAYOUT_LABELS))
query("label_types", f", lb(k, label, type, ocr, selectable) AS (VALUES {_LABELS}) SELECT x.ord, lb.label, lb.type, lb.ocr, lb.selectable FROM box x JOIN lb ON lb.k = x.ord % 25")(
    lambda s, d: box_rows(s, d).select("ord", F.element_at(F.array(*map(lit, schema.LAYOUT_LABELS)), (c("ord") % 25 + 1).cast("int")).alias("label")).select("ord", "label", F.coalesce(F.try_element_at(F.create_map(*[lit(x) for kv in schema.BLOCK_TYPE_OF_LABEL.items() for x in kv]), c("label")), lit("PARAGRAPH")).alias("type"), c("label").isin(*schema.OCR_LABELS).alias("ocr"), c("label").isin(*schema.SELECTABLE_LABELS).alias("selectable")))
query("window_scores", """, w AS (SELECT vec_id, unnest([0, 8, 16]) AS start, v FROM e), f AS (SELECT vec_id, start + i AS cp, v[i + 1] + start / 10.0 AS a, v[i + 2] AS b FROM w, (SELECT unnest(range(0, 16)) AS i) g) SELECT vec_id, CAST(cp AS INTEGER) AS cp, round(1 / (1 + exp(-(-0.5 + 1.5 * avg(a) + 0.25 * avg(b)))), 6) AS p FROM f GROUP BY vec_id, cp""")(
    lambda s, d: EV.window_scores(table(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.array(lit(0), lit(8), lit(16))).alias("start")).select("vec_id", "start", F.transform(F.sequence(lit(0), lit(15)), lambda i: F.array(F.get("embedding", i).cast("double") + c("start") / 10.0, F.get("embedding", i + 1).cast("double"))).alias("logits")), ["vec_id"], [1.5, 0.25], -0.5).withColumn("p", F.round("p", 6)))
query("complete_formulas", "SELECT vec_id FROM e WHERE v[1] > 0 AND vec_id % 4 <> 0")(
    lambda s, d: EV.complete_formulas(emb(s, d).select("vec_id", (c("v1") > 0).alias("terminated"), F.when(c("vec_id") % 4 == 0, " \n").otherwise("x").alias("latex"))).select("vec_id"))
query("words_of_lines", r"""SELECT sentenceId, text, CASE WHEN n % 2 = 0 THEN array_to_string(string_split(text, ' '), '|') END AS words FROM (SELECT sentenceId, regexp_replace(regexp_replace(proposedText, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g') AS text, length(proposedText) AS n FROM rev WHERE proposedText IS NOT NULL) WHERE text <> ''""")(
    lambda s, d: _lines_with_words(s, d))


def _lines_with_words(s, d) -> DataFrame:
    """Answers as one line of a text layer with their words, in other order; every other one lacks a word and so spells nothing."""
    r = rev(s, d).where("proposedText is not null").select("sentenceId", X.squeeze(c("proposedText")).alias("t"), (F.length("proposedText") % 2).alias("odd")).where("t <> ''")
    ws = F.split("t", " ")
    cell = lambda t, a, z: F.struct(t.alias("text"), a.cast("float").alias("left"), lit(10.0).cast("float").alias("top"), z.cast("float").alias("right"), lit(20.0).cast("float").alias("bottom"))
    words = F.reverse(F.transform(ws, lambda w, i: cell(w, i * 10 + 1, i * 10 + 9)))
    words = F.when(c("odd") == 1, F.concat(F.slice(words, 2, F.size(words)), F.array(cell(lit("§§"), lit(0), lit(5))))).otherwise(words)
    pages = r.select("sentenceId", lit(0).alias("pageNumber"), lit(1000.0).alias("width"), lit(100.0).alias("height"), F.array(cell(c("t"), lit(0), F.size(ws) * 10)).alias("lines"), words.alias("words"))
    return EV.words_of_lines(pages, ["sentenceId"]).select("sentenceId", "text", F.array_join(F.transform("words", lambda w: w["text"]), "|").alias("words"))


# ---------------------------------------------------------------- choices and ink

query("toggled", "SELECT id, CASE WHEN list_contains(x, 'b') THEN list_filter(x, lambda i: i <> 'b') ELSE list_append(x, 'b') END AS one, CASE WHEN pageCount % 3 = 0 THEN [] ELSE list_concat(x, list_filter(['a', 'b'], lambda i: NOT list_contains(x, i))) END AS al FROM (SELECT id, pageCount, CASE pageCount % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a'] ELSE ['c'] END AS x FROM lib)")(
    lambda s, d: lib(s, d).select("id", F.when(c("pageCount") % 3 == 0, F.array(lit("a"), lit("b"))).when(c("pageCount") % 3 == 1, F.array(lit("a"))).otherwise(F.array(lit("c"))).alias("x")).select("id", LIB.toggled(c("x"), lit("b")).alias("one"), LIB.toggled_all(c("x"), F.array(lit("a"), lit("b"))).alias("al")))
query("stroke_pressure", _STROKES + """SELECT id, [round(greatest(0.2, least(1.5, ((id * 7) % 37 / 20.0 + (id * 7 + 1) % 37 / 20.0) / 2)), 9), round(greatest(0.2, least(1.5, ((id * 7 + 1) % 37 / 20.0 + (id * 7 + 2) % 37 / 20.0) / 2)), 9), round(greatest(0.2, least(1.5, ((id * 7 + 2) % 37 / 20.0 + (id * 7 + 3) % 37 / 20.0) / 2)), 9)]::DOUBLE[] AS pressure FROM st""")(
    lambda s, d: stroke_rows(s, d).select("id", F.transform(G.segment_pressure(F.transform("points", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((c("id") * 7 + i) % 37 / 20.0).alias("pressure"))), lit(True)), lambda v: F.round(v, 9)).alias("pressure")))
query("long_strokes", _STROKES + "SELECT id FROM st WHERE id % 3 > 1")(lambda s, d: stroke_rows(s, d).withColumn("points", F.slice("points", 1, (c("id") % 3).cast("int"))).where(F.size("points") >= 2).select("id"))
query("nearest_stroke", _STROKES + """, tp AS (SELECT point, page % 5 AS pageNumber, point % (SELECT max(user_id) + 1 FROM events) AS documentId, x, y FROM pt),
n AS (SELECT t.point, s.id, min((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d FROM tp t JOIN (SELECT id, documentId, pageNumber, unnest(pts) AS p FROM st) s ON s.documentId = t.documentId AND s.pageNumber = t.pageNumber GROUP BY 1, 2)
SELECT point AS touch, id FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, id) AS k FROM n WHERE d < 0.003) WHERE k = 1""")(
    lambda s, d: _near_strokes(s, d))
query("area_erase", _STROKES + """, q AS (SELECT id, generate_subscripts(pts, 1) AS i, unnest(pts) AS p FROM st), f AS (SELECT id, i, (sqrt((p.x - 0.3) ** 2 + (p.y - 0.3) ** 2) > 0.1 AND sqrt((p.x - 0.5) ** 2 + (p.y - 0.5) ** 2) > 0.1) AS far FROM q),
t AS (SELECT id FROM f GROUP BY id HAVING NOT bool_and(far)), g AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS grp FROM f WHERE far), r AS (SELECT id, grp, count(*) AS points, min(i) AS i FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT t.id, CAST(CASE WHEN r.id IS NOT NULL THEN row_number() OVER (PARTITION BY t.id ORDER BY r.i) - 1 END AS INTEGER) AS fragment, CAST(r.points AS INTEGER) AS points FROM t LEFT JOIN r ON r.id = t.id""")(
    lambda s, d: ink.erased(stroke_rows(s, d), F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0.3, 0.3), (0.5, 0.5))]), lit(0.1)).select("id", "fragment", F.size("points").alias("points")))
query("ink_shapes", "SELECT vec_id, round(0.5 + v[1] * cos(2 * pi() / 4) + v[2] * sin(2 * pi() / 4), 9) AS ex, round(0.5 + v[1] - v[2], 9) AS rx, round(v[1] / 8 + v[2] * 3 / 8 + v[3] * 3 / 8 + v[4] / 8, 9) AS bx, CAST(floor(((degrees(atan2(v[2], v[1])) + 360) % 180) + 0.5) AS INTEGER) AS deg, abs(sqrt(v[1] * v[1] + v[2] * v[2]) - sqrt(v[3] * v[3] + v[4] * v[4])) <= greatest(sqrt(v[1] * v[1] + v[2] * v[2]), sqrt(v[3] * v[3] + v[4] * v[4])) * 0.02 AND abs(v[1] * v[3] + v[2] * v[4]) <= sqrt(v[1] * v[1] + v[2] * v[2]) * sqrt(v[3] * v[3] + v[4] * v[4]) * 0.03 AS regular FROM e")(
    lambda s, d: emb(s, d).select(
        "vec_id", F.round(G.ellipse_points(lit(0.5), lit(0.5), c("v1"), lit(0.1), c("v2"), lit(0.1), lit(1.0))[18]["x"], 9).alias("ex"), F.round(G.rectangle_points(lit(0.5), lit(0.5), c("v1"), lit(0.0), c("v2"), lit(0.0), lit(1.0))[1]["x"], 9).alias("rx"),
        F.round(G.bezier_points(F.array(*[F.struct(c(f"v{i}").alias("x"), lit(0.0).alias("y"), lit(1.0).alias("pressure")) for i in (1, 2, 3, 4)]))[36]["x"], 9).alias("bx"), G.line_degrees(lit(0.0), lit(0.0), c("v1"), c("v2")).alias("deg"), G.regular_shape(c("v1"), c("v2"), c("v3"), c("v4")).alias("regular")))
query("snapped_lines", """, g AS (SELECT vec_id, v[1] AS x, v[2] AS y, sqrt(v[1] * v[1] + v[2] * v[2]) AS len, atan2(v[2], v[1]) AS a FROM e), h AS (SELECT *, floor(a / (pi() / 4) + 0.5) * (pi() / 4) AS t FROM g)
SELECT vec_id, round(CASE WHEN len >= 0.0001 AND abs(a - t) * 180 / pi() <= 6 THEN cos(t) * len ELSE x END, 9) + 0.0 AS x, round(CASE WHEN len >= 0.0001 AND abs(a - t) * 180 / pi() <= 6 THEN sin(t) * len ELSE y END, 9) + 0.0 AS y FROM h""")(
    lambda s, d: emb(s, d).select("vec_id", G.snapped_end(lit(0.0), lit(0.0), c("v1"), c("v2")).alias("p")).select("vec_id", (F.round("p.x", 9) + 0.0).alias("x"), (F.round("p.y", 9) + 0.0).alias("y")))
query("ink_values", "SELECT vec_id, round(greatest(0.03, sqrt(greatest(0, least(1.5, v[1] * 2)))), 9) AS pen, round(greatest(0.05, greatest(0, least(1.5, v[1] * 2))), 9) AS mouse, round(greatest(0, least(255, abs(v[2]) * 255 * -0.9 + 245)), 6) AS night, round(CASE WHEN abs(v[3]) < 0.0001 THEN 1 ELSE greatest(-8, least(8, v[4] / v[3])) END, 6) AS scale FROM e")(
    lambda s, d: emb(s, d).select("vec_id", F.round(G.stylus_pressure(c("v1") * 2), 9).alias("pen"), F.round(G.stylus_pressure(c("v1") * 2, True), 9).alias("mouse"), F.round(G.night_channel(F.abs("v2") * 255), 6).alias("night"), F.round(G.safe_scale(c("v4"), c("v3")), 6).alias("scale")))
query("wrapped_angles", "SELECT vec_id, round(v[1] * 20 - 2 * pi() * ceil((v[1] * 20 - pi()) / (2 * pi())), 6) AS a FROM e WHERE abs(v[1] * 20) > 3.2")(lambda s, d: emb(s, d).where("abs(v1 * 20) > 3.2").select("vec_id", F.round(G.wrapped_angle(c("v1") * 20), 6).alias("a")))
query("box_handles", "SELECT ord, round(l, 9) AS x0, round(b, 9) AS y2, round((l + r) / 2, 9) AS rx, round(greatest(t - 0.055, 0.01), 9) AS ry FROM box")(
    lambda s, d: box_rows(s, d).select("ord", F.round(G.corner_handles(B.box())[0]["x"], 9).alias("x0"), F.round(G.corner_handles(B.box())[2]["y"], 9).alias("y2"), F.round(G.rotation_handle(B.box())["x"], 9).alias("rx"), F.round(G.rotation_handle(B.box())["y"], 9).alias("ry")))


query("shape_controls", """, g AS (SELECT vec_id, vec_id % 2 = 0 AS snap, vec_id % 3 = 0 AS cen, 0.5::DOUBLE AS x1, 0.4::DOUBLE AS y1, 0.5 + v[1] AS x2, 0.4 + v[2] AS y2 FROM e), h AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1)) AS m, snap AND abs(abs(x2 - x1) - abs(y2 - y1)) <= greatest(abs(x2 - x1), abs(y2 - y1)) * 0.12 AS q FROM g),
k AS (SELECT *, CASE WHEN q THEN x1 + sign(x2 - x1) * m ELSE x2 END AS ex, CASE WHEN q THEN y1 + sign(y2 - y1) * m ELSE y2 END AS ey FROM h),
z AS (SELECT vec_id, CASE WHEN cen THEN x1 - abs(ex - x1) ELSE least(x1, ex) END AS lx, CASE WHEN cen THEN x1 + abs(ex - x1) ELSE greatest(x1, ex) END AS hx, CASE WHEN cen THEN y1 - abs(ey - y1) ELSE least(y1, ey) END AS ly, CASE WHEN cen THEN y1 + abs(ey - y1) ELSE greatest(y1, ey) END AS hy FROM k)
SELECT vec_id, round((lx + hx) / 2, 9) AS cx, round((ly + hy) / 2, 9) AS cy, round(hx, 9) AS hx, round(hy, 9) AS hy FROM z""")(
    lambda s, d: emb(s, d).select("vec_id", G.shape_controls(lit(0.5), lit(0.4), lit(0.5) + c("v1"), lit(0.4) + c("v2"), lit(1.0), c("vec_id") % 2 == 0, c("vec_id") % 3 == 0).alias("p")).select("vec_id", F.round(c("p")[0]["x"], 9).alias("cx"), F.round(c("p")[0]["y"], 9).alias("cy"), F.round(c("p")[1]["x"], 9).alias("hx"), F.round(c("p")[2]["y"], 9).alias("hy")))
query("edited_controls", """, g AS (SELECT vec_id, v[1] AS mx, v[2] AS my, sqrt(v[1] * v[1] + v[2] * v[2]) AS a, sqrt(v[3] * v[3] + v[4] * v[4]) AS b FROM e), h AS (SELECT *, CASE WHEN abs(a - b) <= greatest(a, b) * 0.12 AND a > 0.0001 THEN b / a ELSE 1 END AS k FROM g) SELECT vec_id, round(mx * k, 9) AS x, round(my * k, 9) AS y FROM h""")(
    lambda s, d: emb(s, d).select("vec_id", G.edited_control(G._point(lit(0.0), lit(0.0), lit(1.0)), G._point(c("v1"), c("v2"), lit(1.0)), G._point(c("v3"), c("v4"), lit(1.0))).alias("p")).select("vec_id", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y")))
query("stroke_controls", _STROKES + """SELECT id, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n, round(CASE id % 3 WHEN 0 THEN pts[1].x WHEN 1 THEN (list_min(list_transform(pts, lambda p: p.x)) + list_max(list_transform(pts, lambda p: p.x))) / 2 END, 9)::DOUBLE AS x FROM st""")(
    lambda s, d: stroke_rows(s, d).select("id", G.stroke_controls(F.element_at(F.array(lit("LINE"), lit("ELLIPSE"), lit("PEN")), (c("id") % 3 + 1).cast("int")), c("points"), F.slice("points", 1, 0)).alias("k")).select("id", F.size("k").alias("n"), F.round(F.get("k", lit(0))["x"].cast("double"), 9).alias("x")))
query("pen_events", "SELECT event_id, (event_id % 5 IN (2, 4) OR (event_id % 70000 & 16386) = 16386 OR (event_id % 70000 & 49154) = 49154) AS pen, (event_id % 128 & 96) <> 0 AS side, (event_id % 4 = 3 OR (event_id % 64 & 32) <> 0) AS gone FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", G.pen_event((c("event_id") % 5).cast("int"), (c("event_id") % 70000).cast("int")).alias("pen"), G.side_button((c("event_id") % 128).cast("int")).alias("side"), G.cancelled((c("event_id") % 4).cast("int"), (c("event_id") % 64).cast("int")).alias("gone")))
query("adapter_files", "SELECT n_nationkey, 3 AS n, n_nationkey / 2.0::DOUBLE AS intercept, 0.25::DOUBLE AS threshold FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", EV.adapter_parameters(F.format_string('{"coefficients":[1,2.5,3],"intercept":%s,"threshold":0.25}', (c("n_nationkey") / 2).cast("string"))).alias("a")).select("n_nationkey", F.size("a.coefficients").alias("n"), "a.intercept", "a.threshold"))
query("running_totals", "SELECT sentenceId, CAST(sum(length(coalesce(proposedText, ''))) OVER (PARTITION BY documentId ORDER BY pageNumber, createdAt, sentenceId) AS BIGINT) AS tokensTotal FROM rev")(
    lambda s, d: RT.running_totals(rev(s, d).select("sentenceId", "documentId", "pageNumber", "createdAt", F.length(F.coalesce("proposedText", lit(""))).alias("tokens")), ["documentId"], ["pageNumber", "createdAt", "sentenceId"], ["tokens"]).select("sentenceId", "tokensTotal"))
query("chunked_rows", "SELECT page, ord // 2 AS chunk, string_agg(CAST(class AS VARCHAR), ',' ORDER BY ord) AS classes FROM box GROUP BY 1, 2")(
    lambda s, d: RT.chunked(box_rows(s, d).select("page", "ord", "class"), ["page"], "ord", 2).select("page", "chunk", F.array_join(F.transform("rows", lambda r: r["class"].cast("string")), ",").alias("classes")))


def _near_strokes(s, d) -> DataFrame:
    """Touches spread over the documents of all strokes."""
    users = table(s, d, "events").agg(F.max("user_id") + 1).first()[0] or 1
    touches = point_rows(s, d).select(c("point").alias("touch"), (c("page") % 5).alias("pageNumber"), (c("point") % users).alias("documentId"), "x", "y")
    return ink.nearest(stroke_rows(s, d).withColumn("ord", c("id")), touches, ["documentId", "pageNumber"])


# ---------------------------------------------------------------- sentences out of pages


def sentence_blocks(s, d) -> DataFrame:
    """Each sentence row as a block of its page, its lines as lines: by position titles, captions, contents and abstracts among
    paragraphs; a line in formula brackets is a formula."""
    lines = F.transform(F.split("originalText", "\n"), lambda t, i: F.struct(
        t.alias("text"), lit(0.1).alias("left"), (i * 0.03).alias("top"), lit(0.9).alias("right"), (i * 0.03 + 0.03).alias("bottom"), lit(0.9).alias("confidence"), t.rlike(r"^\\\[.*\\\]$").alias("isFormula")))
    k = c("position") % 23
    kind = F.when(k == 7, "SECTION_TITLE").when(k == 11, "CAPTION").when(k == 13, "CONTENTS").when(k == 17, "ABSTRACT").otherwise("PARAGRAPH")
    x = sen(s, d, "documentId", "pageNumber", "position", "originalText").where("originalText is not null")
    return x.select("documentId", "pageNumber", c("position").alias("readingOrder"), kind.alias("type"), lit("text").alias("layoutLabel"), lit(True).alias("selectableBody"),
                    lit(0.1).alias("left"), lit(0.1).alias("top"), lit(0.9).alias("right"), lit(0.9).alias("bottom"), lines.alias("lines"))


# The stream in SQL: lines of one running text are put together with the joints between them, formulas with their marks kept apart by
# private characters; places before capitals are cut, and pieces without letters go with what follows.
_STREAM = r""", sb AS (SELECT documentId, pageNumber, position, originalText, CASE position % 23 WHEN 7 THEN 'TITLE' WHEN 11 THEN 'CAPTION' WHEN 13 THEN 'CONTENTS' WHEN 17 THEN 'ABSTRACT' ELSE 'BODY' END AS role FROM sen WHERE originalText IS NOT NULL),
sr AS (SELECT *, count(*) FILTER (WHERE role = 'TITLE') OVER (PARTITION BY documentId ORDER BY pageNumber, position) AS stretch FROM sb),
sl AS (SELECT * EXCLUDE (originalText), unnest(string_split(originalText, chr(10))) AS raw, generate_subscripts(string_split(originalText, chr(10)), 1) AS i FROM sr),
sq AS (SELECT *, regexp_replace(regexp_replace(raw, '_SP', ' ', 'g'), '^ | $', '', 'g') AS t, regexp_matches(raw, '^\\\[.*\\\]$') AS f FROM sl),
sk AS (SELECT *, CASE role WHEN 'BODY' THEN 'B' || stretch WHEN 'ABSTRACT' THEN 'A' || stretch WHEN 'CONTENTS' THEN 'C' || pageNumber || ':' || position || ':' || i ELSE role || pageNumber || ':' || position END AS gk FROM sq WHERE t <> ''),
sf AS (SELECT *, lead(t) OVER w AS nt, lead(f) OVER w AS nf, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\\\[', ''), '\\\]$', ''), '((\\[!,;:])|\\(quad|qquad|enspace|thinspace|medspace|thickspace))+\s*$', ''), '\s+$', '') AS inner_ FROM sk WINDOW w AS (PARTITION BY documentId, gk ORDER BY pageNumber, position, i)),
sp AS (SELECT *, CASE WHEN f THEN chr(57344) || translate(t, '.?!', chr(57345) || chr(57346) || chr(57347)) || chr(57348) || CASE WHEN regexp_matches(inner_, '\\(right|left)\.$') THEN '' ELSE regexp_extract(inner_, '[.,;:?!]$') END
   WHEN NOT f AND nt IS NOT NULL AND NOT nf AND ends_with(t, '-') AND regexp_matches(nt, '^\p{Ll}') THEN substr(t, 1, length(t) - 1) ELSE t END
   || CASE WHEN nt IS NULL OR (NOT f AND NOT nf AND ends_with(t, '-') AND regexp_matches(nt, '^\p{Ll}')) THEN '' ELSE ' ' END AS piece FROM sf),
sj AS (SELECT documentId, gk, any_value(role) AS role, string_agg(piece, '' ORDER BY pageNumber, position, i) AS txt FROM sp GROUP BY 1, 2),
sc AS (SELECT documentId, gk, role, string_split(CASE WHEN role IN ('TITLE', 'CONTENTS') THEN txt ELSE regexp_replace(txt, '([.?!])(\s*)(\p{Lu})', '\1\2' || chr(1) || '\3', 'g') END, chr(1)) AS fr FROM sj),
su AS (SELECT documentId, gk, role, unnest(fr) AS x, generate_subscripts(fr, 1) AS i FROM sc),
sg AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(x, '\p{L}') THEN 1 ELSE 0 END) OVER (PARTITION BY documentId, gk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM su)
SELECT documentId, role, trim(translate(regexp_replace(string_agg(x, '' ORDER BY i), '[' || chr(57344) || ']|' || chr(57348) || '[.,;:?!]?', '', 'g'), chr(57345) || chr(57346) || chr(57347), '.?!')) AS text FROM sg GROUP BY documentId, gk, role, g""".replace("_SP", r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


@query("stream_texts", _STREAM)
def stream_texts(s, d):
    """The texts of all sentences with their roles, found again from their blocks."""
    return segment_documents(sentence_blocks(s, d)).select("documentId", "role", "text")


@query("sentence_stream", None)
def sentence_stream(s, d):
    """Sentences of all documents, found again from their blocks."""
    return segment_documents(sentence_blocks(s, d)).select("documentId", "firstPage", "position", "text", "role", F.size("regions").alias("regions"))
