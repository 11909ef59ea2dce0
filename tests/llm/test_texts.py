import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import broken_pairs as BP, language_id as LI, repeated_lines as RL, same_look as SL, scan_noise as SN, sentence_units as SU, wrong_encoding as WE

from .conftest import SF, needs_data


# ---------------------------------------------------------------- problem 1


def pairs(spark, tables, *texts):
    d = tables(sentences=[{"id": f"s{i}", "originalText": t} for i, t in enumerate(texts)])
    return {(r.row_a, r.row_b) for r in SL.p1_found(spark, d).collect()}


def test_same_look_in_other_characters(spark, tables):
    base = "The model reads naïve text, 64 units."
    same = ["The mоdel reads naı̈ve text, 64 units.".replace("ı̈", "ï"), "The mo​del reads naïve text, 64 units.", "Ｔｈｅ model reads naïve text, 64 units.", "The model reads　naïve  text, 64 units. ", "The model reads naïve te﻿xt, 64 un\xadits."]
    other = ["The MODEL reads naïve text, 64 units.", "The model reads naive text, 64 units.", "The model reads naïve text, 6⁴ units.", "The model reads naïve text, 65 units."]
    got = pairs(spark, tables, base, *same, *other, base, None, "", None)
    inside = {"s0", "s10", *[f"s{i}" for i in range(1, 6)]}
    want = {(a, b) for a in inside for b in inside if a < b and (a, b) != ("s0", "s10")}
    assert got == {("s:" + a, "s:" + b) for a, b in want}
    assert pairs(spark, tables) == set()


def test_cyrillic_and_joiners(spark, tables):
    got = pairs(spark, tables, "Модель снижает ошибку", "Мoдель снижаeт ошибку", "می‌شود", "میشود", "Dupaνahaga モデル", "Dupavahaga モデル", "ｶﾞｲﾄﾞ", "ガイド")
    assert got == {("s:s0", "s:s1"), ("s:s4", "s:s5"), ("s:s6", "s:s7")}


def test_redelivered_rows_and_the_second_field(spark, tables):
    s = {"id": "s1", "originalText": "a te​st"}
    d = tables(sentences=[s, s], ai_correction_reviews=[{"sentenceId": "s1", "pdfOriginalText": "a test"}] * 2)
    assert [(r.row_a, r.row_b) for r in SL.p1_found(spark, d).collect()] == [("r:s1", "s:s1")]


def test_trie_reaches_what_the_plain_distance_allows():
    r = random.Random(1)
    words = ["".join(r.choice("abco") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    trie = SL.Trie(words)

    def dist(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for w in words[:20]:
        t = w.replace("o", "о").replace("a", "а")
        for limit in (0, 1):
            assert set(trie.reach(t, limit)) == {x for x in set(words) if dist(x, w) <= limit}
    assert trie.reach("zzz") == []


@pytest.mark.parametrize("limit", [0, 1])
def test_spellings_in_buckets_as_in_one_trie(spark, limit):
    r = random.Random(limit)
    words = sorted({"".join(r.choice("abcoxe") for _ in range(r.randrange(2, 6))) for _ in range(80)})
    tokens = sorted({"".join({"o": "о", "a": "а", "c": "с", "e": "е", "x": "х"}.get(c, c) if r.random() < 0.6 else c for c in r.choice(words) + r.choice(["", "", "x"])) for _ in range(60)})
    got = SL.spellings(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"), limit, 5).collect()
    trie = SL.Trie(words)
    assert {x.token: x.spelling for x in got} == {t: (trie.reach(t, limit) or [SL.table_form(t)])[0] for t in tokens} and len(got) == len(tokens)


def test_look_alikes_of_more_scripts():
    assert [SL.table_form(SL.by_character(t)) for t in ("𝐓𝐡𝐞", "mօdel", "Ꭺlpha", "ꓔhe", "modeⅼ")] == ["The", "model", "Alpha", "The", "model"]
    assert SL.in_doubt("modeⅼ") and SL.in_doubt("mօdel") and not SL.in_doubt("model") and SL.by_character("naı̈ve") == "naïve"
    assert not SL.in_doubt("хорошо") and not SL.in_doubt("հայերեն")


def test_classes_count_their_texts(spark, tables):
    s = [{"id": f"s{i}", "originalText": t} for i, t in enumerate(["a test", "a te​st", "a test", "other", None, " "])]
    got = {r.row: (r["class"], r.n_texts) for r in SL.p1_classes(spark, tables(sentences=s + s[:1])).collect()}
    assert [got[f"s:s{i}"][1] for i in (0, 1, 2, 3, 5)] == [2, 2, 2, 1, 1] and got["s:s0"][0] == got["s:s1"][0] == got["s:s2"][0] != got["s:s3"][0]


def test_tokens_without_vocabulary_go_by_table():
    assert SL.table_form("pаuse") == "pause" and SL.table_form("мoдель") == "модель"
    assert SL.by_character("x́ ﬁ") == "x́ fi" and SL.by_character("") == ""


# ---------------------------------------------------------------- problem 2


def test_repeated_lines_by_brute_force(spark, tables):
    r = random.Random(2)
    long = "This standing line has far more than forty letters in it, issue {}"
    sents, docs = [], []
    for i in range(24):
        docs.append({"id": f"d{i}", "folderId": ["fa", "fb", None][i % 3]})
        for j in range(4):
            lines = [r.choice([long.format(r.randrange(99)), long.format(3).upper(), "Short line", "One of a kind line with many letters, namely number " + chr(97 + i) * 5, ""]) for _ in range(r.randrange(1, 4))]
            sents.append({"id": f"s{i}_{j}", "documentId": f"d{i}", "pageNumber": 0, "position": j, "originalText": "\n".join(lines) if r.random() > 0.05 else None})
    sents += sents[:10]
    docs += docs[:3]
    folder = {x["id"]: x["folderId"] for x in docs}
    form = lambda x: "".join(c for c in x.upper().lower() if c not in "0123456789").strip()
    seen = {}
    for s in sents:
        for n, x in enumerate((s["originalText"] or "").split("\n")):
            if folder[s["documentId"]] and sum(c.isalpha() for c in x) >= 40:
                seen.setdefault((folder[s["documentId"]], form(x)), {}).setdefault(s["documentId"], set()).add((s["id"], n))
    want = {p for v in seen.values() if len(v) >= 5 for ps in v.values() for p in ps}
    d = tables(sentences=sents, library_documents=docs)
    assert {(x.sentence_id, x.line_no) for x in RL.p2_found(spark, d).collect()} == want and want
    kept = {x.id: x.text for x in RL.without_repeated_lines(spark.read.parquet(f"{d}/sentences.parquet"), spark.read.parquet(f"{d}/library_documents.parquet")).collect()}
    for s in sents:
        if s["originalText"] is not None:
            left = [x for n, x in enumerate(s["originalText"].split("\n")) if (s["id"], n) not in want]
            assert kept[s["id"]] == ("\n".join(left) if left else None)
    lines = RL.line_rows(spark.read.parquet(f"{d}/sentences.parquet"), spark.read.parquet(f"{d}/library_documents.parquet"))
    sizes = lines.select("src", "doc").distinct().groupBy("src").agg(F.count("*").alias("size"))
    share = {(x.src, x.n_docs) for x in RL.frequent_lines(lines, 1, 0.5, sizes).collect()}
    assert share == {(k[0], len(v)) for k, v in seen.items() if len(v) >= 0.5 * len({x for kk, vv in seen.items() if kk[0] == k[0] for x in vv})}
    assert RL.p2_found(spark, tables()).collect() == [] and RL.p2_documents(spark, tables()).collect() == []


# ---------------------------------------------------------------- problem 3


@pytest.fixture(scope="module")
def lexicon():
    words = "the model reads calibrated reservoir open point so far memory system works real each sample needs labels before pruning and post pre training modern corner l’indice co-training".split()
    return SN.Lexicon({w: 1000 for w in words} | {"Each": 500, "The": 900, "rcal": 5}, {("the", "model"): 50, ("open", "point"): 50})


@pytest.mark.parametrize("text, want", [
    ("The mem-\nory system works", "The memory system works"), ("The mem- ory system works", "The memory system works"), ("the cali6rated reservo!r — an operi point", "the calibrated reservoir — an open point"),
    ("Eacb samp1e needs labe1s", "Each sample needs labels"), ("the model\n- 326 -\nreads far", "the model reads far"), ("the model\n12 | Some Title Here\nreads", "the model reads"), ("the rea¬\nl model", "the real model"),
    ("is it rcal", "is it real"), ("the cahbrated model", "the calibrated model"), ("l’indi- ce", "l’indice"), ("co-train- ing works", "co-training works"), ("(cf. real)", None), ("the modern corner", None), ("pre- and post-training", None), ("SAMP1E NEEDS", None), ("H2O 3D 1.5 mоdel", None), ("Bokudebu and Kaletibu", None), ("the model\n\\[x_1\\]\nreads", None), ("", None), ("the model\nreads far", None),
])
def test_noise_is_found_and_repaired(lexicon, text, want):
    noisy, out, _ = SN.examine(text, lexicon)
    assert noisy == (want is not None)
    if want:
        assert out == want


def test_frequent_misreadings_are_no_words(lexicon):
    assert "rcal" not in lexicon.words and lexicon.best("rcal") == "real"
    assert SN.misread_cost("model", "motel") > SN.ACCEPT and SN.misread_cost("model", "rnodel") == pytest.approx(0.3)


def test_deletion_index_finds_what_brute_force_finds():
    r = random.Random(8)
    words = {"".join(r.choice("abcdé") for _ in range(r.choice([3, 5, 8, 20, 34]))): 100 for _ in range(40)}
    lex = SN.Lexicon(words, {})
    def cuts(w):
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        return {w} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
    for w in list(words)[:15]:
        t = w[:1] + r.choice("abx") + w[2:] if len(w) > 4 else w + "b"
        assert lex._near(t) == {x for x in lex.words if cuts(x) & cuts(t)}
    assert lex._near("x" * 5000) == set()


def test_misreadings_are_learned_and_need_context():
    words = "membrane number remember ambient embedding tumble".split()
    rare = {w.replace("mb", "rnb"[0:1] + "h", 1): 1 for w in words}  # mb read as rh, in six words
    lex = SN.Lexicon({w: 1000 for w in words} | {"the": 1000, "works": 1000, "endings": 1000}, {("the", "membrane"): 9, ("the", "number"): 9, ("number", "works"): 9}, rare | {"endingz": 1})
    assert [("mb", "rh")] in lex.learned.values()
    assert lex.repair("merhrane", "the") == "membrane" and lex.repair("merhrane") is None
    assert lex.repair("numher", "the", "works") == "number" and lex.repair("nurnber") == "number" and lex.repair("numqer", "the") is None
    assert lex.repair("numбer", "the", "works") is None and SN.Lexicon({}, {}).repair("word") is None


def test_misreadings_are_learned_from_all_rare_words(spark):
    words = "membrane number remember ambient embedding tumble".split()
    r = random.Random(4)
    coined = {"".join(r.choice("aeioukstvz") for _ in range(9)) for _ in range(60_000)}
    looks = [w.replace("o", "о") for w in "modern corner person common honor motion".split()]  # a Cyrillic letter: problem 1
    texts = [" ".join(words + "modern corner person common honor motion".split())] * 40 + [w.replace("mb", "rh", 1) for w in words] + looks + sorted(coined)
    lex = SN.corpus_lexicon(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert lex.learned == {"h": [("mb", "rh")]}
    some = ["merhrane", "tumbla", "embeding", "x", "qqqq", "rеmember", *sorted(coined)[:50]]
    for n in {len(w) for w in some} - {1}:
        block = [w for w in some if len(w) == n]
        assert lex._near_all(block) == [lex._near(w) for w in block]


def test_running_heads_are_titles_of_the_library(spark, tables):
    s = [{"id": "a", "originalText": "the first part of it\nOn a Robust View\ngoes on here."}, {"id": "b", "originalText": "the first part.\nAn other line\ngoes on."}, {"id": "c", "originalText": None}, {"id": "d", "originalText": ""}]
    d = tables(sentences=s + s[:1], library_documents=[{"id": "x", "title": "On a robust view.pdf"}, {"id": "y", "title": None}], ai_correction_reviews=[{"sentenceId": "a", "parsedText": "one two\n[353]\nthree"}])
    assert sorted((r.field_name, r.sentence_id) for r in SN.p3_found(spark, d).collect()) == [("originalText", "a"), ("parsedText", "a")]
    got = {(r.field_name, r.sentence_id): r.repaired for r in SN.p3_repaired(spark, d).collect()}
    assert got == {("originalText", "a"): "the first part of it goes on here.", ("parsedText", "a"): "one two three"}
    assert SN.p3_found(spark, tables()).collect() == []


# ---------------------------------------------------------------- problem 4


@pytest.mark.parametrize("parts", [
    ["First one holds. ", "Second, by Dr. K. R. Velmar et al., follows at approx. 3.5 units! ", "Third?"], ["After the remark “Is it real? Hardly.” by one reviewer, it works."], ["“Is it stable?” asked a referee in rev. no. 5. ", "Yes."],
    ["“A whole sentence stands here.” ", "“Another one does.” ", "(So does this one.) ", "Good."], ["It works.[12] ", "mRNA counts rose. ", "Then 3 fell."], ["It ends within ±1.8 µm.", "In vol. 4, no. 65, it starts."], ["Trials... ", "Our corpus works, pages, plots, etc. ", "A pause ... and on."],
    ["Siehe z. B. S. 53 ff., dort steht es. ", "Am 80. Mai, also vor ca. 13 Tagen, galt es. ", "Werte über 4,6. ", "Das Modell."], ["Selon M. Quessol et al., c.-à-d. avant, il dépend. ", "Est-ce réel ? ", "Oui."], ["¿Se cumple en la práctica? ", "¿Cuánta memoria necesita la fig. 3? ", "Sí, según el Dr. Hadrune y cols., mucho."],
    ["Модель, т. е. сеть, зависит от рис. 5 и т. д. ", "Каждая проба проверена. ", "В 41 г. и позже."], ["每个样本取决于阈值。", "“真的稳定吗？未必。”", "审稿人问“对吗？不。”之后，模型改善了4.5！", "好。"], ["「本当に安定か？　まさか。」と問われたが、改善する。　", "各試料は安定している。"], ["제안한 방법은 5.1보다 크다. ", "“정말인가? 글쎄.”라는 물음 뒤에도 그렇다."],
    ["كم من الذاكرة يحتاج؟ ", "بعد السؤال «هل هذا صحيح؟ ربما.» من المراجع يعمل. ", "نعم."], ["चित्र 4.5 में, पृ. 7 पर, ऐसा है। ", "डॉ. Velmar आदि।"], ["ตามที่ ดร.Velmarกล่าวตัวอย่างคงตัวร้อยละ 5.4 ของทั้งหมด ", "วิธีนี้ใช้ได้ ", "คลังข้อความดี"], ["Πόση μνήμη θέλει για 74 σελίδες; ", "Κατά τον κ. Ninvaro κ.ά., αρκετή, βλ. σελ. 5."],
])
def test_boundaries(parts):
    text = "".join(parts)
    want, at = [], 0
    for p in parts[:-1]:
        at += len(p)
        want.append(at)
    assert SU.boundaries(text) == want
    assert SU.units(text) == [p.strip() for p in parts]


def test_units_of_edge_cases(spark):
    assert SU.boundaries(None) == SU.boundaries("") == SU.boundaries(" \n ") == SU.boundaries("...") == []
    assert len(SU.units("A fine sentence. " * 5000)) == 5000
    d = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.unit_no, r.unit) for r in SU.unit_rows(d, "id", "t").collect()] == [(1, 0, "A b."), (1, 1, "C d.")]


def test_no_row_with_a_boundary_is_dropped_unread(spark, tables):
    r = random.Random(5)
    alphabet = "aB1 .!?…。;์กขคง)”“\"'[(%\xa0\u3000ๆฯи！？؟۔।፧፨։။។៕Α;—\U0001f600\u200b\u0301\x1c\x85\r\t"
    texts = ["“ฉันมา”\u3000เขาไป", "(ฉันมา”\u3000เขาไป", "សួស្តី។ ☺", "صحيح؟ —", *("".join(r.choices(alphabet, k=r.randint(2, 8))) for _ in range(20_000))]
    want = {(str(i), b) for i, t in enumerate(texts) for b in SU.boundaries(t)}
    assert {i for i, _ in want} >= {"0", "1", "2", "3"}
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    assert {tuple(x) for x in SU.boundary_rows(rows, "id", "t").collect()} == want
    d = tables(sentences=[{"id": str(i), "originalText": t} for i, t in enumerate(texts[:4])])
    assert {tuple(x) for x in SU.p4_found(spark, d).collect()} == {w for w in want if int(w[0]) < 4}


def test_the_filter_before_python_keeps_the_rows_it_kept(spark):
    r = random.Random(7)
    alphabet = SU.END + "aB1 ;\u037eกข)” \xa0\u3000ии模\n\r\t\x1c\x85"
    texts = ["".join(r.choices(alphabet, weights=[1 if c in SU.MARKS else 4 for c in alphabet], k=r.randint(1, 9))) for _ in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = rf"(?s)[{SU.END};\x{{37e}}]\s*\S|^(?=.*\p{{InThai}}).*[\p{{InThai}})”][ \x{{a0}}\x{{3000}}]+\S"
    got = [tuple(x) for x in rows.select(SU.may_divide("t").alias("new"), rows.t.rlike(one).alias("one")).collect()]
    assert all(a == b for a, b in got) and 1000 < sum(a for a, _ in got) < 19_000


# ---------------------------------------------------------------- problem 5


@needs_data
def test_garbled_text_is_found_and_restored(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/sentences.parquet")
    texts = WE.training_texts(rows, "id", "originalText", 4000)
    det = WE.Detector(texts)
    sound = [t for t, bad in zip(texts, det.flags(texts)) if not bad]
    r = random.Random(3)
    chains = [(("utf-8", "latin-1"),), (("utf-8", "cp1252"),), (("utf-8", "cp1251"),), (("utf-8", "mac_roman"),), (("gb18030", "latin-1"),), (("cp1251", "latin-1"),), (("utf-8", "cp1252"),) * 2]
    found = back = n = 0
    for t in r.sample(sound, 150):
        for c in r.sample(chains, 3):
            raw = WE.written(t, c[0][0])
            g = WE.garble(t, c)
            if raw is None or raw.isascii() or g is None or g == t:
                continue
            n += 1
            if det.flags([g])[0]:
                found += 1
                back += det.judge(g)[2] == t
    assert n > 100 and found >= 0.9 * n and back >= 0.8 * n
    assert sum(det.flags(sound)) <= 0.01 * len(sound)


@needs_data
def test_known_characters_come_from_all_rows(spark):
    d = SF.replace("0.001", "0.01")
    rows = list({r.id: r.originalText for r in spark.read.parquet(f"{d}/sentences.parquet").where("originalText is not null").collect()}.values())
    few = WE.Detector(WE.training_texts(spark.read.parquet(f"{d}/sentences.parquet"), "id", "originalText", 1500))
    count = lambda ts: Counter(c for t in ts for c in set(t) if c.isalpha() and c > "\x7f")
    every, sound = count(rows), count(t for t, bad in zip(rows, WE.fitted_detector(spark, d).flags(rows)) if not bad)
    letters = {c for c, n in sound.items() if n >= 5 and n >= 0.5 * every[c]}
    got = WE.all_known(spark.read.parquet(f"{d}/sentences.parquet"), "id", "originalText", few)
    assert letters - few.known and few.known <= got and not letters - got


def test_the_classifier_is_fitted_on_all_rows(spark, tables):
    r = random.Random(6)
    words = {"LATIN": "für größer é5é5 naïve œuvre “done” café— 50€".split(), "CYRILLIC": "модель точка №7 окно шум,да".split(), "CJK": "模型的误差 数据。很小 参见图10 句子".split()}
    texts = sorted({" ".join(["ab", *r.choices(words[g], k=r.randint(1, 6)), "cd"]) for g in ("LATIN", "LATIN", "CYRILLIC", "CJK") for _ in range(6000)})
    assert len(texts) > 10_000
    det = WE.fitted_detector(spark, tables(sentences=[{"id": str(i), "originalText": t} for i, t in enumerate(texts)]))
    sound = [t for t in texts if WE._WIDE.search(t)]
    groups = {g: [t for t in sound if WE.group_of(t) == g] for g in sorted({WE.group_of(t) for t in sound})}
    one = WE.fit_once(spark.createDataFrame([(t,) for t in sound], "t string"), 0.0)
    share = [x / x.sum() for ts in groups.values() for x in [np.bincount(np.concatenate([WE.features(t) for t in ts]), minlength=WE.BUCKETS)]]
    assert det.fitted and one.per_script.shape[1] == len(groups)
    for x in share:
        assert any(np.allclose(x[x > 1e-3], np.exp(c.astype(float))[x > 1e-3], rtol=0.01) for c in one.per_script.T)
    # a class is what the chain makes of all texts that it can garble, scripts alike
    for chain in [(("utf-8", "cp1252"),), (("utf-8", "gb18030"),), (("cp1252", "cp1251"),), (("cp1251", "cp949"),), (("gb18030", "latin-1"),), (("utf-8", "latin-1"), ("utf-8", "cp1252"))]:
        want, able = np.zeros(WE.BUCKETS), {}
        for g, ts in groups.items():
            able[g] = [x for t in ts if (x := WE.garble(t, chain)) is not None and x != t]
        able = {g: x for g, x in able.items() if x}
        for g, w in WE.quotas({g: len(x) for g, x in able.items()}).items():
            want += w * np.bincount(np.concatenate([WE.features(x) for x in able[g]]), minlength=WE.BUCKETS)
        got = np.exp(one.weights[one.column, one.classes.index(chain)].astype(float))
        want += WE.SMOOTH
        live = want > 0.01 * want.max()
        assert np.allclose(got[live], want[live] / want.sum(), rtol=0.01), chain


def test_few_sound_texts_are_judged_one_by_one(monkeypatch):
    r = random.Random(8)
    words = {"LATIN": "für größer naïve œuvre “done” café— 50€ à « déjà »".split(), "CYRILLIC": "модель точка №7 окно шум,да рапира".split(), "CJK": "模型的误差 数据。很小 参见图10 句子é".split(), "THAI": "โมเดล ข้อผิดพลาด ตัวอย่าง".split()}
    sound = sorted({" ".join(["ab", *r.choices(words[g], k=r.randint(1, 6)), "cd\n"]) for g in words for _ in range(400)})
    chains = [(("utf-8", "cp1252"),), (("utf-8", "cp866"),), (("cp1251", "latin-1"),), (("utf-8", "gb18030"),), (("utf-8", "cp1252"),) * 2]
    texts = [*sound, *{x for t in sound[::9] for c in chains if (x := WE.garble(t, c)) is not None}, "plain", "", "a 模 b" + " c" * 30, "\x85é", "x é" * 20_000]
    det = WE.Detector(sound)
    det.first = 0.0  # every text is looked at
    want = [(i, j) for i, t in enumerate(texts) if not t.isascii() and (j := det.judge(t))[0]]
    calls, judge = [], WE.Detector.judge
    monkeypatch.setattr(WE.Detector, "judge", lambda self, t: calls.append(t) or judge(self, t))
    assert [i for i, bad in enumerate(det.flags(texts)) if bad] == [i for i, _ in want] and len(want) > 100
    assert len(set(calls) & set(sound)) < 0.1 * len(sound)
    assert det.found(texts) == want
    t, start, a, z, _ = det._spans(sound)
    got: dict = {}
    for i, x, y in zip(t.tolist(), (a - start).tolist(), (z - start).tolist()):
        got.setdefault(i, {})[x, y] = None
    assert {i: list(v) for i, v in got.items()} == {i: p for i, x in enumerate(sound) if (p := det._parts(x))}


def test_counts_of_left_out_texts_are_taken_off(spark):
    r = random.Random(9)
    words = "für größer “done” café— модель точка №7 окно 模型的误差 参见图10 ·5·6 ▒1".split()
    texts = sorted({x for _ in range(900) if not (x := " ".join(["ab", *r.choices(words, k=r.randint(1, 6))])).isascii()})
    of = lambda ts: WE.Counts(spark.createDataFrame([(t,) for t in ts], "t string"))
    got, want = of(texts), of(texts[::3])
    got.take_off(of([t for i, t in enumerate(texts) if i % 3]))
    masks = {(g, m): n for t in texts[::3] for g, m in [(WE.group_of(t), WE.applicable(t))] for n in [0]}
    for t in texts[::3]:
        masks[WE.group_of(t), WE.applicable(t)] += 1
    assert got.rows == want.rows == masks and got.chars == want.chars and (got.seen == want.seen).all()
    pairs = lambda c: {(list(c.masks)[k >> 42], k & (1 << 42) - 1): n for k, n in zip(*(x.tolist() for x in c.pairs))}
    assert pairs(got) == pairs(want)
    full = lambda c: {k: dict(zip(b.tolist(), n.tolist())) for k, (b, n) in c.words.items() if len(b)}
    assert full(got) == full(want)


def test_chains_invert_strictly():
    for c in ((("utf-8", "cp1252"),), (("cp1251", "koi8_r"),), (("utf-8", "latin-1"), ("utf-8", "latin-1"))):
        t = "Модель"
        assert WE.invert(WE.garble(t, c), c) == t
    assert WE.invert("für", (("utf-8", "latin-1"),)) is None


def test_detector_without_rows(spark, tables):
    d = tables(sentences=[{"id": "a", "originalText": "x � y"}, {"id": "b", "originalText": None}, {"id": "c", "originalText": "für Ã, Â"}, {"id": "d", "originalText": ""}] * 2)
    assert [(r.field_name, r.sentence_id) for r in WE.p5_found(spark, d).collect()] == [("originalText", "a")]
    assert SU.p4_found(spark, d).collect() == []


def test_units_of_every_row(spark, tables):
    stand = "Copyright 12 by the editors of Letters on Slow Glaciers, all rights reserved"
    rows = [("a", "It works. We saw\nit twice. So be it."), ("b", f"The first\n{stand}\npart ends. Then on."), ("c", f"{stand.upper()}\nIt holds"), ("d", "One. Two."), ("e", "x � y. Then z."), ("f", None), ("g", " \n "), ("h", "The error\n\\[x_1\\]\nis low.")]
    rows += [(f"k{i}", stand.replace("12", str(i))) for i in range(5)]
    s = [{"id": k, "documentId": f"d{k}", "originalText": t} for k, t in rows]
    d = tables(sentences=[*s, *s[:4]], library_documents=[{"id": f"d{k}", "folderId": "f"} for k, _ in rows])
    got: dict = {}
    for r in SU.p4_row_units(spark, d).orderBy("sentence_id", "unit_no").collect():
        got.setdefault(r.sentence_id, []).append(r.unit)
        assert r.unit_no == len(got[r.sentence_id]) - 1
    assert {k: v for k, v in got.items() if not k.startswith("k")} == {
        "a": ["It works.", "We saw\nit twice.", "So be it."], "b": ["The first\npart ends.", stand, "Then on."], "c": [stand.upper(), "It holds"], "d": ["One.", "Two."], "e": ["x � y. Then z."], "h": ["The error\n\\[x_1\\]\nis low."]}
    assert SU.p4_row_units(spark, tables()).collect() == []


# ---------------------------------------------------------------- problem 6


def test_nothing_and_copies():
    assert all(map(BP.nothing_in, (None, "", " ​﻿", "—", "[]", "...", '""'))) and not BP.nothing_in("No model")
    q = "The model, so far."
    assert all(BP.is_copy(q, a) for a in (q, q.upper(), f'"{q}"', f"翻译: {q}", f"{q} {q}", f"  {q} ", "Thе model, so far.")) and not BP.is_copy(q, "The model so farther") and not BP.is_copy(None, q) and not BP.is_copy("", "")


def test_arrays_hold_the_same_words_as_the_texts():
    t = BP.Texts(["The model, 12 runs", "", "模型 the  MODEL", "12"])
    assert t.tokens.tolist() == [0, 5, 5, 9, 10] and t.visible.tolist() == [True, False, True, True]
    assert t.word[1] == t.word[8] and t.word[0] == t.word[7] and t.word[3] == t.word[9] and t.word[5] != t.word[6]
    with_copy = BP.Pairs(["The model, so far."] * 3, ["the MODEL so far", "Answer: the model, so far.", "the model so"], BP.np.zeros(3, int), BP.known_words(["a"], 1), BP.Languages([]))
    assert with_copy.copied.tolist() == [True, True, False]


def test_features_come_from_the_whole_answer():
    long = "the model reads " * 300
    known = BP.known_words(["the model reads it well but I cannot help so on"], 1)
    f = lambda x: set(BP.Pairs(["q"], [x], BP.np.zeros(1, int), known, BP.Languages([])).slot.tolist())
    plain, refused = (f(f"{long}{x} so the model reads on and on") for x in ("it well,", "but I cannot help,"))
    assert len(refused - plain) >= 6
    word = "x" * 200
    assert f(f"it {word} on") != f(f"it {word}y on") or word not in known  # a word longer than any window counts as one


def test_refusals_are_composed():
    all_of = BP.refusals()
    assert len(all_of) > 5000 and {k for k, _ in all_of} == set(BP.REFUSALS)


LINES = {
    "en": "The model was tested on noisy pages and it depends on the threshold that we have chosen for every sample of the corpus",
    "de": "Das Modell wurde an verrauschten Seiten geprüft und es hängt von dem Schwellenwert ab, den wir für jede Probe gewählt haben",
    "fr": "Le modèle a été testé sur des pages bruitées et il dépend du seuil que nous avons retenu pour chaque échantillon du corpus",
    "es": "El modelo fue probado con páginas ruidosas y depende del umbral que hemos elegido para cada muestra del corpus según la tabla",
    "zh": "该模型曾在含噪页面上测试，它取决于我们为语料库中每个样本所选的阈值，并且在低温下保持稳定，误差在范围以内，见于多次试验。",
    "ru": "Модель была проверена на зашумлённых страницах и зависит от порога, который мы выбрали для каждой пробы нашего корпуса",
}


def test_languages_are_learned_from_labels():
    rng = random.Random(6)
    mixed = [(k, "\n".join(" ".join(rng.sample(t.split(), len(t.split()))) if k != "zh" else t for _ in range(4))) for k, t in LINES.items() for _ in range(6)]
    wrong = [("ru", LINES["fr"]), ("de", LINES["es"])]  # labels may be wrong
    m = LI.Languages([*mixed, *wrong])
    names, sure = m.name(["We tested the model on every page", "Wir haben die Probe geprüft und gewählt", "il dépend du seuil pour chaque page", "depende del umbral según la tabla", "该模型取决于阈值", "проверена на страницах", "", "Ïðîâåðåíà íà ñòðàíèöàõ ÷òî ìû"])
    assert names == ["en", "de", "fr", "es", "zh", "ru", "", ""] and sure[6] == 0
    assert LI.Languages([]).name(["x"])[0] == [""]


@needs_data
def test_defects_on_held_out_pairs(spark):
    d = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{d}/ai_correction_reviews.parquet")
    model = BP.fitted_model(rows.where("pageNumber % 2 = 0"), spark.read.parquet(f"{d}/documents.parquet"))
    held = [(x.parsedText, x.proposedText, "proposedText") for x in rows.where("pageNumber % 2 = 1").collect() if x.parsedText and x.proposedText]
    whole = [p for p, ok in zip(held, model.sound(held)) if ok]
    r = random.Random(4)
    cut = [(q, a[: int(len(a) * r.uniform(0.3, 0.8))].rstrip(), f) for q, a, f in whole]
    refused = [(q, r.choice(["I'm sorry, but I cannot help with that passage.", "I must ask you to understand that I am unable to do so.", "Je ne peux malheureusement pas vous aider.", "对不起，我不能这样做。"]), f) for q, a, f in whole]
    empty = [(q, r.choice(["no answer", "keine Angabe", "sin respuesta", "(none)", "没有译文"]), f) for q, a, f in whole]
    other = [(q, "仔细来看，模型在低温下保持稳定，见于5次试验。", f) for q, a, f in whole if model.languages.name([q])[0][0] not in ("zh", "")]
    share = lambda rows, want: sum(d == want for d in model.defects(rows)) / len(rows)
    assert share(whole, None) >= 0.97 and share(cut, "TRUNCATED") >= 0.9 and share(refused, "REFUSAL") >= 0.8 and share(other, "WRONG_LANGUAGE") >= 0.9 and share(empty, "EMPTY") >= 0.95
    again = BP.fitted_model(rows.where("pageNumber % 2 = 0").repartition(7), spark.read.parquet(f"{d}/documents.parquet"))
    assert (again.w == model.w).all()


def test_pairs_over_small_tables(spark, tables):
    rows = [{"sentenceId": "s1", "parsedText": "The model works.", "proposedText": None, "translatedText": "The model works."}] * 2
    d = tables(ai_correction_reviews=[*rows, {"sentenceId": "s2", "parsedText": None, "proposedText": "x y z", "translatedText": ""}])
    assert sorted(map(tuple, BP.p6_found(spark, d).collect())) == [("s1", "proposedText", "EMPTY"), ("s1", "translatedText", "COPY"), ("s2", "translatedText", "EMPTY")]
    assert BP.p6_found(spark, tables()).collect() == []


def test_package_lists_its_queries():
    from folioflow import llm

    q = llm.queries()
    assert {f"p{i}" for i in range(1, 10)} == {n.split("_")[0] for n in q} and set(llm.oracle_sql()) <= set(q) and F
