import os
import random

import pytest
from pyspark.sql import functions as F

from folioflow import schema
from folioflow.operators import boxes as B, evidence as EV, ink, records as RC, retrieval as RT, store as ST

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_insert_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert rows(ST.upsert(old, new, ["id"])) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(Exception, match="taken"):
        ST.insert(old, new, ["id"]).collect()
    assert len(ST.insert(old, new.where("id = 3"), ["id"]).collect()) == 3
    assert rows(ST.delete(old, F.col("v") == "a")) == [(2, "b")]
    assert rows(ST.upsert(old.where("false"), new, ["id"])) == [(2, "B"), (3, "c")]
    twice = spark.createDataFrame([(2, "z", 1), (2, "a", 2)], "id int, v string, ord int")
    assert rows(ST.upsert(old, twice.select("id", "v", "ord"), ["id"], "ord").select("id", "v")) == [(1, "a"), (2, "a")] and rows(ST.upsert(old, twice.drop("ord"), ["id"])) == [(1, "a"), (2, "z")]


def test_unique_keys_and_parents_are_checked(spark):
    old = spark.createDataFrame([("d1", "h1"), ("d2", "h2")], "id string, sha256 string")
    with pytest.raises(Exception, match="taken: sha256"):
        ST.insert(old, spark.createDataFrame([("d3", "h1")], old.schema), ["id"], schema.UNIQUE["documents"]).collect()
    with pytest.raises(Exception, match="taken"):
        ST.insert(old, spark.createDataFrame([("d3", "h3"), ("d3", "h4")], old.schema), ["id"]).collect()
    assert len(ST.insert(old, spark.createDataFrame([("d3", "h3")], old.schema), ["id"], schema.UNIQUE["documents"]).collect()) == 3
    assert len(ST.insert(old, old.where("false"), ["id"]).collect()) == 2
    spans = spark.createDataFrame([("s9", 0)], "sentenceId string, position int")
    with pytest.raises(Exception, match="parent"):
        ST.with_children(old, spans, old, spans, ["id"], ["sentenceId", "position"], "sentenceId")[1].collect()
    with pytest.raises(Exception, match="selected"):
        ST.required(old.where("false").select("id")).collect()
    assert rows(ST.required(old.select("id"))) == [("d1",), ("d2",)]


def test_last_setting_counts_and_writers_check(spark):
    d = spark.createDataFrame([(1, "k", "9"), (2, "k", "10"), (1, "j", "x")], "ord int, key string, value string")
    assert ST.settings_map(d).first()["settings"] == {"k": "10", "j": "x"}
    f = lambda m, p: [tuple(x) for x in spark.range(1).select(ST.translation_settings(F.lit(m), F.lit(p), F.lit(7.0)).alias("x")).first()["x"]]
    assert f(" m ", "a {text}") == [("model", "m"), ("prompt", "a {text}"), ("max_change_ratio", "1.0")]
    for m, p in ((" ", "{text}"), ("m", "none")):
        with pytest.raises(Exception, match="model|prompt"):
            f(m, p)


def test_decisions_by_brute_force(spark):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    r, ss, its, want = random.Random(9), [], [], {}
    for i in range(60):
        orig = "".join(r.choice("abcé ") for _ in range(r.randrange(1, 12))).strip() or "a"
        corr = r.choice([None, None, orig + "x"])
        prop = r.choice([orig, corr or orig, f" {orig}y ", "zzzzzzzzzzzz", "", orig[:-1] + "q"])
        ss.append((f"s{i}", "d", 0, orig, corr))
        its.append((f"s{i}", prop, "t"))
        shown, clean = corr or orig, prop.strip()
        most = max(1, int(max(len(shown), len(clean), 1) * 0.25))
        taken = clean if clean == shown or (clean and edits(shown, clean) <= most) else None
        want[f"s{i}"] = (corr if taken is None else None if taken == orig else taken, taken is None)
    s = spark.createDataFrame(ss, "id string, documentId string, pageNumber int, originalText string, correctedText string")
    got = RC.decided(s, spark.createDataFrame(its, "sentenceId string, proposed string, translatedText string"), F.lit(0.25), F.lit(True))
    assert {x.id: (x.stored, x.review) for x in got.collect()} == want
    c, t, v = RC.decision_rows(got, F.lit(1).cast("bigint"))
    assert v.count() == sum(w[1] for w in want.values()) and c.count() == t.count() == 60


def test_nearest_stroke_by_brute_force(spark):
    r = random.Random(4)
    strokes = [(f"k{i:02}", r.randrange(2), i, [(r.random() * 0.4, r.random() * 0.4) for _ in range(3)]) for i in range(40)]
    touches = [(i, r.randrange(2), r.random() * 0.4, r.random() * 0.4) for i in range(60)]
    want = {}
    for t, page, x, y in touches:
        best = min(((min((a - x) ** 2 + (b - y) ** 2 for a, b in ps), o, k) for k, p, o, ps in strokes if p == page), default=(9, 0, 0))
        if best[0] < ink.NEAR2:
            want[t] = best[2]
    got = ink.nearest(spark.createDataFrame(strokes, "id string, page int, ord int, points array<struct<x:double,y:double>>"), spark.createDataFrame(touches, "touch int, page int, x double, y double"), ["page"])
    assert {x.touch: x.id for x in got.collect()} == want and want


def test_null_conditions_change_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert rows(ST.update(d, F.col("v") == "x", id=F.lit(9))) == [(1, None), (9, "x")]
    assert len(ST.delete(d, F.col("v") == "x").collect()) == 1


def test_compare_and_set(spark):
    d = spark.createDataFrame([(1, "QUEUED"), (2, "READY")], "id int, status string")
    new, n = ST.compare_and_set(d, F.lit(True), "status", "QUEUED", "INDEXING")
    assert rows(new) == [(1, "INDEXING"), (2, "READY")] and n.first()["changed"] == 1


def test_cascade_follows_the_declared_references(spark):
    t = {
        "documents": spark.createDataFrame([("d1",), ("d2",)], "id string"),
        "sentences": spark.createDataFrame([("s1", "d1"), ("s2", "d2")], "id string, documentId string"),
        "translations": spark.createDataFrame([("s1",), ("s2",)], "sentenceId string"),
        "document_tags": spark.createDataFrame([("d1", "t"), ("d2", "t")], "documentId string, tagId string"),
        "vocabulary": spark.createDataFrame([("w", "s1")], "id string, sourceSentenceId string"),
    }
    out = ST.cascade_delete(t, "documents", spark.createDataFrame([("d1",)], "id string"))
    assert {k: len(v.collect()) for k, v in out.items()} == {"documents": 1, "sentences": 1, "translations": 1, "document_tags": 1, "vocabulary": 1}


def test_replace_page_keeps_old_sentences_and_reset_wipes(spark):
    block = lambda *r: spark.createDataFrame(list(r), "documentId string, pageNumber int, position int")
    t = {
        "documents": spark.createDataFrame([("d", "READY", 5, "x")], "id string, status string, processedPages int, errorMessage string"),
        "page_layout_blocks": block(("d", 0, 0), ("d", 0, 1), ("d", 1, 0)), "page_evidence": spark.createDataFrame([], "documentId string, pageNumber int"),
        "pages": spark.createDataFrame([("d", 0, "a")], "documentId string, pageNumber int, source string"),
        "sentences": spark.createDataFrame([("s1", "d", 0), ("s2", "d", 0)], "id string, documentId string, pageNumber int"),
    }
    page = spark.createDataFrame([("d", 0, "b")], "documentId string, pageNumber int, source string")
    out = ST.replace_page(t, page, {"page_layout_blocks": block(("d", 0, 7)), "page_evidence": t["page_evidence"], "sentences": t["sentences"].where("id = 's1'")})
    assert len(out["page_layout_blocks"].collect()) == 2 and rows(out["pages"]) == [("d", 0, "b")] and len(out["sentences"].collect()) == 2
    out = ST.reset_index(t, spark.createDataFrame([("d",)], "id string"))
    got = out["documents"].first()
    assert (got["status"], got["processedPages"], got["errorMessage"]) == ("QUEUED", 0, None) and not out["sentences"].collect() and not out["pages"].collect()


def test_resolve_reviews(spark):
    reviews = spark.createDataFrame([("s1", "d", "P", "T"), ("s2", "d", "orig", "T2")], "sentenceId string, documentId string, proposedText string, translatedText string")
    accept = spark.createDataFrame([("s1", True), ("s2", True)], "sentenceId string, accept boolean")
    sents = spark.createDataFrame([("s1", "orig", None), ("s2", "orig", "old")], "id string, originalText string, correctedText string")
    trans = spark.createDataFrame([("s1", "x", "y", 5, "CNY", "1", 0)], "sentenceId string, sourceText string, translatedText string, promptTokens int, costCurrency string, costAmount string, updatedAt long")
    left, s, t = ST.resolve_reviews(reviews, accept, sents, trans, F.lit(9).cast("long"))
    assert not left.collect() and rows(s) == [("s1", "orig", "P"), ("s2", "orig", None)]
    assert rows(t) == [("s1", "P", "T", 5, "CNY", "1", 9), ("s2", "orig", "T2", 0, "", "0", 9)]


def test_schema_covers_the_store():
    assert len(schema.TABLES) == 15 and set(schema.KEYS) == set(schema.TABLES)
    assert len(schema.LAYOUT_LABELS) == 25 and all(c in schema.TABLES for c in schema.CASCADES)


def test_migration_fills_defaults(spark):
    got = ST.migrate(spark.createDataFrame([("a", "n")], "id string, name string"), "folders").first()
    assert got["createdAt"] == 0
    doc = ST.migrate(spark.createDataFrame([("a",)], "id string"), "documents").first()
    assert (doc["fullTranslationStatus"], doc["fullTranslationCostAmount"], doc["aiContextSummary"], doc["aiContextStatus"], doc["isTrashed"]) == ("NOT_STARTED", "0", None, "NOT_REQUESTED", False)


def sent(spark, sizes, page=lambda i: i // 3):
    return spark.createDataFrame([(f"s{i:05}", "d", page(i), i, "x" * n, None) for i, n in enumerate(sizes)], "id string, documentId string, pageNumber int, position int, originalText string, correctedText string")


def greedy(sizes, rows_, chars):
    out, i = [], 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and j - i < rows_ and (j == i or n + sizes[j] <= chars):
            n += sizes[j]
            j += 1
        out.append(("d", i, j))
        i = j
    return out


@pytest.mark.parametrize("chunk", [16, 20, 4096])
def test_batches_equal_the_sequential_ones(spark, chunk):
    import random

    r = random.Random(chunk)
    sizes = [r.choice([1, 5, 50, 120]) for _ in range(150)]
    got = RT.greedy_batches(sent(spark, sizes), 16, 200, chunk)
    assert sorted(map(tuple, got.collect())) == greedy(sizes, 16, 200)


def test_batch_limits(spark):
    assert sorted(map(tuple, RT.greedy_batches(sent(spark, [4, 4, 1]), 16, 6).collect())) == [("d", 0, 1), ("d", 1, 3)]
    assert RT.greedy_batches(sent(spark, [1]).where("false")).collect() == []


def test_resume_page(spark):
    def f(c, spans):
        d = spark.createDataFrame([(c, spans)], "c int, x array<struct<first:int,last:int>>")
        return d.select(RT.resume_page(F.col("c"), F.col("x")).alias("r")).first()["r"]

    spans = [(0, 0), (1, 2), (2, 3), (3, 3)]
    assert f(3, spans) == 1 and f(4, spans) == 4 and f(0, []) == 0


def test_context_takes_neighbours_then_related(spark):
    texts = ["alpha lattice one", "none", "query lattice gradient", "none two", "none three", "gradient lattice far", "lattice far", "nothing"]
    d = spark.createDataFrame([(f"s{i}", "d", 0, i, t, None) for i, t in enumerate(texts)], "id string, documentId string, pageNumber int, position int, originalText string, correctedText string")
    got = RT.context_of(d, spark.createDataFrame([("s2",)], "sentenceId string")).first()["context"].split("\n")
    assert got == [f"[p.1] {t}" for t in (*texts[:5], texts[5], texts[6])]


def test_related_in_blocks_as_in_whole(spark):
    rng = random.Random(5)
    words = ["lattice", "gradient", "reservoir", "polymer", "channel", "short"]
    texts = [None if i % 50 == 7 else " ".join(rng.choices(words, k=3)) for i in range(700)]
    s = spark.createDataFrame([("d", f"s{i:03}", i, t) for i, t in enumerate(texts)], "documentId string, id string, ord int, text string")
    asked = {0, 2, 3, 7, 350, 699}
    want = []
    for o in asked:
        keys = set((texts[o] or "").split())
        hits = [(-n, i) for i, t in enumerate(texts) if abs(i - o) > 2 and (n := sum(w in keys for w in (t or "").split()))]
        want += [(f"s{o:03}", i, k + 1) for k, (_, i) in enumerate(sorted(hits)[:3])]
    for block in (3, 300, 8192):
        got = RT.related(s, s.where(F.col("ord").isin(list(asked))), block).select("sentenceId", "ord", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want), block


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_review_gets_its_context(spark):
    from folioflow.plans import catalog

    queue = {r.sentenceId for r in spark.read.parquet(f"{SF}/ai_correction_reviews.parquet").select("sentenceId").distinct().collect()}
    got = [r.sentenceId for r in catalog.queries()["context_retrieval"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == queue


def test_suppression_and_containment(spark):
    b = spark.createDataFrame([(0, 0, 1, 0.9, 0.0, 0.0, 1.0, 1.0), (0, 1, 1, 0.8, 0.0, 0.0, 1.0, 0.9), (0, 2, 2, 0.7, 0.0, 0.0, 1.0, 0.95), (0, 3, 2, 0.6, 0.0, 0.0, 1.0, 1.0)],
                              "page int, ord int, class int, score double, left double, top double, right double, bottom double")
    assert sorted(r.ord for r in B.suppressed(b, ["page"]).collect()) == [0, 2]
    assert sorted(r.ord for r in B.uncontained(b, ["page"], [1]).where("class = 2").collect()) == []
    img = b.withColumn("class", F.lit(14))
    assert sorted(r.ord for r in B.without_page_images(img, ["page"], F.lit(False)).collect()) == [1]  # 0.9 is within the bound of 0.93
    assert len(B.without_page_images(img, ["page"], F.lit(True)).collect()) == 4  # none would be left
    assert len(B.without_page_images(img.where("ord = 0"), ["page"], F.lit(True)).collect()) == 1


def test_erase_splits_strokes(spark):
    s = spark.createDataFrame([("a", [(x / 10, 0.5, 1.0) for x in range(10)]), ("b", [(0.0, 0.0, 1.0), (0.1, 0.0, 1.0)])], "id string, points array<struct<x:double,y:double,pressure:double>>")
    path = F.array(F.struct(F.lit(0.45).alias("x"), F.lit(0.5).alias("y")))
    got = [(r.id, r.fragment, len(r.points)) for r in ink.erased(s, path, F.lit(0.1)).collect()]
    assert got == [("a", 0, 4), ("a", 1, 4)]


def test_replies(spark):
    r = '```json\n{"items":[{"id":"b","corrected_source":" x ","zh_translation":"y"},{"id":"a","corrected_source":"1","zh_translation":"2"}]}\n```'
    d = spark.createDataFrame([("1", ["a", "b"], r), ("2", ["a"], r), ("3", ["a", "b"], "nonsense")], "batch string, ids array<string>, reply string")
    got = {x.batch: x for x in EV.validated_replies(d).collect()}
    assert got["1"].verdict == "OK" and [i["id"] for i in got["1"]["items"]] == ["a", "b"] and got["1"]["items"][1]["corrected"] == "x"
    assert got["2"].verdict == "MISMATCH" and got["3"].verdict == "UNREADABLE"


def test_text_layer(spark):
    j = '{"pages":[{"width":100,"height":100,"lines":[{"text":"ab cd","left":0,"top":0,"right":50,"bottom":10}],"words":[{"text":"cd","left":30,"top":1,"right":50,"bottom":9},{"text":"ab","left":0,"top":1,"right":20,"bottom":9}]}]}'
    pages = EV.text_layer_pages(spark.createDataFrame([("d", j)], "id string, json string").select("id", "json"))
    got = EV.words_of_lines(pages, ["id"]).first()
    assert got["text"] == "ab cd" and [w["text"] for w in got["words"]] == ["ab", "cd"] and got["right"] == 0.5
    with pytest.raises(Exception, match="broken"):
        EV.text_layer_pages(spark.createDataFrame([("d", '{"error":"broken","pages":[]}')], "id string, json string")).collect()


def test_windows(spark):
    f = lambda n: spark.range(1).select(EV.window_starts(F.lit(n)).alias("s")).first()["s"]
    assert f(100) == [0] and f(512) == [0] and f(600) == [0, 88] and f(1024) == [0, 256, 512]
