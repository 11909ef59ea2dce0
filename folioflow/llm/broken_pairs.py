"""Problem 6: broken prompt and response pairs.

A multi-label linear classifier (one logistic output per defect) over hashed n-grams of the answer, n-grams of its
end, and features of the pair (containment of the question, languages of both, lengths, shared words). It is trained
on answers of the corpus, taken as sound, and on answers broken on purpose: emptied (words for nothing in
many languages), refused (phrases of `REFUSALS`), copied (with labels, quotes, repetition, letter case), truncated (at any
place, some with a dangling mark) and swapped for an answer in another language. Thresholds are calibrated on held-out pairs.
An answer without any letter or digit is EMPTY by definition; an exact check follows the classifier's COPY.

Languages are told by `language_id`, fitted on the labelled documents. Words that the training answers do not know are one
feature, words shared with the question another, so coined names and cut words need no list of their own. Training takes as
sound only answers that share a rare word with the question, have its language and end like a sentence.

A null answer is EMPTY, as is one without anything visible or with only a mark or word for nothing. A null or empty question makes
no copy and no language to match: then only EMPTY, REFUSAL and TRUNCATED can apply to proposedText. With fewer than
LEAST_PAIRS sound pairs to learn from only COPY and answers without letters or digits are found, besides words for nothing. The
first defect in the order EMPTY, REFUSAL, COPY, TRUNCATED, WRONG_LANGUAGE counts. Redelivered rows count once.

Scale: no shuffle but the distinct of the found rows; the training sample is bounded by `sample` rows; the model has a
fixed size. Features are made for a whole batch at once, as arrays over its code points: a word's hash is a difference of
prefix hashes, so no string is built per feature.
"""

from __future__ import annotations

import random
from collections import Counter
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.language_id import Languages, fitted_languages
from folioflow.llm.same_look import IGNORABLE, by_character, look_table
from folioflow.sources.tables import table

SAMPLE, BITS, EPOCHS, SEED, LEAST_PAIRS, SURE, KNOWN = 3000, 18, 4, 11, 20, 12.0, 3
CHUNK_CHARS = 400_000
LABELS = ("EMPTY", "REFUSAL", "COPY", "TRUNCATED", "WRONG_LANGUAGE")
FIELDS = ("proposedText", "translatedText")

# Words that stand for nothing, words of "no answer" by language, labels before an answer, and refusals.
NOTHING = "null none nil n/a na nan nothing empty blank tbd todo undefined missing n.a. void 无 空 空白 无内容 没有内容 未提供 暂无 没有 不详 不适用 無 なし 該当なし 無し 없음 нет пусто keine kein leer nichts aucun aucune néant vide rien ninguno ninguna nada vacío nenhum nenhuma vazio niente nessuno vuoto geen niets leeg ไม่มี لا هیچ ندارد κανένα κενό τίποτα रिक्त".split()
NO_ANSWER = {
    "no not any without": "answer text translation output content response result data value source correction information comment reply",
    "keine kein ohne": "Angabe Antwort Übersetzung Ausgabe Daten Text Inhalt Korrektur Werte Angaben",
    "aucun aucune sans pas de": "réponse traduction texte contenu donnée résultat sortie correction",
    "sin ningún ninguna no hay": "respuesta traducción texto contenido datos resultado salida corrección",
    "sem nenhum nenhuma não há": "resposta tradução texto conteúdo dados resultado saída correção",
    "без нет": "ответа перевода текста данных результата содержания исправления",
    "无 没有 暂无 未提供": "答案 译文 翻译 内容 结果 文本 回答 数据",
    "該当 回答 訳文": "なし 無し ありません",
    "없는 없음 무": "답변 번역 내용 결과 텍스트",
    "χωρίς καμία": "απάντηση μετάφραση κείμενο περιεχόμενο",
    "لا بدون لا يوجد": "جواب ترجمة نص محتوى نتيجة شيء",
    "بدون هیچ": "پاسخ ترجمه متن محتوا نتیجه",
    "कोई नहीं कुछ नहीं": "उत्तर अनुवाद पाठ सामग्री",
    "ไม่มี": "คำตอบ คำแปล ข้อความ เนื้อหา ข้อมูล",
}
LABEL_WORDS = ("Translation", "Answer", "Corrected", "Correction", "Output", "Result", "Source", "Text", "Rewrite", "翻译", "译文", "答", "答案", "修正", "Übersetzung", "Antwort", "Traduction", "Réponse", "Traducción", "Respuesta", "Tradução", "Resposta", "Перевод", "Ответ", "訳", "回答", "번역", "답변", "Here is the text", "原文", "Sure, here it is")
#: Refusals by language: openings, what is not done, to what, and reasons; one of each makes a refusal.
REFUSALS = {
    "en": (
        ["I'm sorry, but", "I am sorry,", "Sorry,", "My apologies, but", "Apologies,", "Unfortunately,", "Unfortunately", "Regrettably,", "I'm afraid", "As a language model,", "As an AI", "As an assistant,", "", ""],
        ["I can't", "I cannot", "I am unable to", "I'm not able to", "I won't be able to", "I am not allowed to", "I must decline to", "I have to refuse to", "I will not", "I would rather not", "I may not", "it is not possible for me to"],
        ["help with this", "help with rewriting that", "assist with your request", "answer this question", "translate this sentence", "rewrite the passage", "correct this text", "process this content", "provide that text", "produce a translation for you", "verify this", "complete the request", "change it", "comply", "respond to a request like this", "give a correction here"],
        ["", "", "", "because it goes against my guidelines", "as it would break the rules", "since it falls outside my scope", "because it is beyond what I may answer", "for policy reasons", "so it stays as it is", "under my policies"],
    ),
    "en2": (["", "Sorry,", "Unfortunately"], ["no answer", "no translation", "no correction", "no help", "nothing"], ["can be given", "can be offered here", "is possible for this request", "can be provided"], ["", "because my guidelines forbid it", "since the request is not permitted", "as this falls outside what I do", "and I have to decline"]),
    "zh": (["抱歉，", "对不起，", "很抱歉，", "很遗憾，", "不好意思，", "作为人工智能，", "身为语言模型，", "根据规定，", ""], ["我无法", "我不能", "我没有办法", "我不便", "恕我无法", "恕我不能", "我只能拒绝", "我必须拒绝", "我帮不了您"], ["翻译这句", "回答这个问题", "处理该请求", "提供译文", "给出翻译", "完成这一请求", "修改此内容", "协助您", "作答"], ["", "", "，请换一个问题再试", "，这超出了我可以处理的范围", "，因为违反准则", "，敬请谅解"]),
    "de": (["Leider", "Tut mir leid, aber", "Es tut mir leid, aber", "Als Sprachmodell", "Bedauerlicherweise"], ["kann ich", "darf ich", "möchte ich"], ["dabei nicht helfen", "diese Anfrage nicht bearbeiten", "den Text nicht korrigieren", "diesen Satz nicht übersetzen", "darauf nicht antworten"], ["", "", "und muss ablehnen"]),
    "fr": (["Je suis désolé, mais", "Désolé,", "Je regrette, mais", "Malheureusement,", "En tant que modèle de langue,"], ["je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "je refuse de"], ["vous aider", "traiter cette demande", "corriger ce texte", "traduire cette phrase", "répondre à cela"], ["", "", "car cela dépasse mes règles"]),
    "es": (["Lo siento, pero", "Lamentablemente", "Disculpe,", "Como modelo de lenguaje,"], ["no puedo", "no me es posible", "no estoy autorizado a", "debo negarme a"], ["ayudar con esto", "procesar esta solicitud", "traducir la frase", "corregir el fragmento", "responder"], ["", "", "por mis normas"]),
    "pt": (["Lamento, mas", "Infelizmente", "Desculpe,", "Como modelo de linguagem,"], ["não posso", "não consigo", "não me é possível", "tenho de recusar"], ["ajudar com isso", "atender a este pedido", "traduzir a frase", "corrigir o trecho", "responder"], ["", "", "pelas minhas regras"]),
    "ru": (["Извините, но", "К сожалению,", "Простите,", "Как языковая модель,"], ["я не могу", "мне нельзя", "я вынужден отказаться"], ["помочь", "выполнить этот запрос", "исправить текст", "перевести предложение", "ответить"], ["", "", "по правилам"]),
    "ja": (["申し訳ありませんが、", "申し訳ございませんが、", "すみません、", "言語モデルとして、", "恐れ入りますが、"], ["お手伝い", "処理", "対応", "翻訳", "回答", "修正"], ["できません", "いたしかねます", "することはできません"], [""]),
    "ko": (["죄송하지만", "죄송합니다,", "유감스럽게도", "언어 모델로서"], ["이 요청은", "이 글은", "이 내용은"], ["처리할 수 없습니다", "도와드릴 수 없습니다", "번역할 수 없습니다", "답변할 수 없습니다", "거절해야 합니다"], [""]),
    "ar": (["عذرا،", "آسف،", "للأسف", "بصفتي نموذجا لغويا"], ["لا أستطيع", "لا يمكنني", "يجب أن أرفض"], ["المساعدة في هذا النص", "ترجمة هذا المحتوى", "تنفيذ هذا الطلب", "الإجابة"], [""]),
    "fa": (["متأسفم،", "ببخشید،", "متأسفانه"], ["نمی‌توانم", "اجازه ندارم"], ["در این مورد کمک کنم", "این متن را اصلاح کنم", "این درخواست را انجام دهم"], [""]),
    "el": (["Λυπάμαι, αλλά", "Δυστυχώς", "Συγγνώμη,"], ["δεν μπορώ να", "αδυνατώ να"], ["βοηθήσω με αυτό", "διορθώσω αυτό το κείμενο", "απαντήσω", "επεξεργαστώ αυτή την πρόταση"], [""]),
    "hi": (["माफ़ कीजिए,", "क्षमा करें,", "खेद है,"], ["मैं इसमें", "मैं इस पाठ में", "मैं इस अनुरोध में"], ["मदद नहीं कर सकता", "सहायता नहीं कर सकता", "उत्तर नहीं दे सकता"], [""]),
    "th": (["ขออภัย", "ขอโทษ", "เสียใจ"], ["ฉันไม่สามารถ", "ไม่อาจ"], ["ช่วยเรื่องนี้ได้", "แก้ไขข้อความนี้ได้", "แปลข้อความนี้ได้", "ดำเนินการตามคำขอนี้ได้"], [""]),
}
UNSPACED = ("zh", "ja", "th")

_VISIBLE = regex.compile(r"[\p{L}\p{N}]")
_GONE = regex.compile(f"[{IGNORABLE}]+")
_ASKS = regex.compile(r"[?？؟;][\s\p{P}]*$")
_LATIN = regex.compile(r"\p{Latin}{4,}")
_NEITHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_LABEL = regex.compile(r"^\s*[*#>\"'“「《]*\s*[\p{L}\p{M} ,’'()（）-]{1,40}\s*[*]*\s*[:：]\s*", regex.S)
_MARKS, _CLOSE, _DOTS = ".!?。！？।؟۔…", "\"'”’»」』)）]】", "…"
#: What has to be brought into one writing before single characters can be compared.
_COMPLEX = regex.compile("[\u0300-\u036f\u0653-\u0655\u093c\u1100-\u11ff\u3099\u309a\ufb00-\ufb06\uff01-\uffee\u3131-\u318e\u2126\u212a\u212b\u2103\u2109ßŉǰΐΰև\u1e96-\u1e9e\u1f50-\u1fff" + IGNORABLE + "]")


def visible(text: str) -> str:
    return (text if text.isascii() else _GONE.sub("", text)).strip()


def nothing_in(text: str | None) -> bool:
    """Null, or nothing to be seen but marks."""
    return text is None or not _VISIBLE.search(visible(text))


@lru_cache(maxsize=1)
def _looks() -> dict[int, str]:
    return str.maketrans(look_table())


def bare(text: str) -> str:
    """Letters and digits alone, case folded, in one writing."""
    return _NEITHER.sub("", by_character(text).casefold().translate(_looks()))


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer is the question itself, apart from case, spacing, quotes, a label before it, or repetition."""
    if not question:
        return False
    q = bare(question)
    if len(q) < 3:
        return False
    for a in dict.fromkeys((answer, _LABEL.sub("", answer, count=1))):
        a = bare(a)
        if a and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
            return True
    return False


# ---------------------------------------------------------------- texts as arrays

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
LETTER, ALONE, DIGIT, OTHER = 1, 2, 3, 4


def mix(x, salt: int):
    """A well spread 64-bit value of 64-bit values."""
    h = (x + np.uint64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)) * _K1
    return (h ^ (h >> np.uint64(31))) * _K2


def rising(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a number, modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def tables_of_characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code point -> (class, folded letter, letter or digit in one writing or 0, kind of mark: 1 ends, 2 closes, 3 dot)."""
    import unicodedata

    top, looks = 0x30000, look_table()
    kind, fold, letter, mark = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint64), np.zeros(0x110000, np.uint64), np.zeros(0x110000, np.uint8)
    alone = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
    for i in range(top):
        c = chr(i)
        g = unicodedata.category(c)
        if c.isspace():
            kind[i] = 0
        elif alone.match(c):
            kind[i] = ALONE
        elif g[0] in "LM":
            kind[i] = LETTER
        elif g[0] == "N":
            kind[i] = DIGIT
        low = c.casefold()
        if len(low) == 1:
            fold[i] = ord(low)
        if kind[i] in (LETTER, ALONE, DIGIT):
            s = looks.get(low, low) if len(low) == 1 else low
            letter[i] = ord(s) if len(s) == 1 else fold[i]
    for c in _MARKS:
        mark[ord(c)] = 3 if c in _DOTS else 1
    for c in _CLOSE:
        mark[ord(c)] = 2
    return kind, fold, letter, mark


class Texts:
    """A batch of texts by code point, with their tokens: letters in a row, digits in a row, any other character alone."""

    def __init__(self, texts: list[str]):
        texts = [by_character(t).casefold() if not t.isascii() and _COMPLEX.search(t) else t for t in texts]
        self.texts, self.n = texts, len(texts)
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.at[1:])
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, fold, letter, mark = tables_of_characters()
        self.points, cls, size = fold[raw], kind[raw], len(raw)
        first = np.zeros(size + 1, bool)
        first[self.at[:-1]] = True
        first = first[:size]
        cut = first.copy()
        cut[1:] |= cls[1:] != cls[:-1]
        cut |= (cls == ALONE) | (cls == OTHER)
        at = np.flatnonzero(cut)
        keep = cls[at] != 0
        ends = np.append(at[1:], size) if len(at) else at
        self.start, self.end, self.cls = at[keep], ends[keep], cls[at[keep]]
        self.text = np.searchsorted(self.at, self.start, "right") - 1
        self.tokens = np.searchsorted(self.start, self.at)  # of each text, first and past last
        self.mark = mark[raw[self.start]] if len(self.start) else np.zeros(0, np.uint8)
        powers = rising(_BASE, size)
        self.inverse = rising(_INVERSE, size)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((self.points + _K2) * powers[:-1], dtype=np.uint64)])
            self.word = np.where(self.cls == DIGIT, np.uint64(7), self.hash(self.start, self.end))
            # letters and digits alone, for copies
            letters = letter[raw]
            on = letters > 0
            self.bare_at = np.concatenate([[0], np.cumsum(on)])[self.at]
            b = letters[on]
            self.bare = np.concatenate([[np.uint64(0)], np.cumsum((b + _K2) * powers[: len(b)], dtype=np.uint64)])

    def hash(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (self.prefix[z] - self.prefix[a]) * self.inverse[a]

    def bare_hash(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (self.bare[z] - self.bare[a]) * self.inverse[a]

    @property
    def visible(self) -> np.ndarray:
        return np.bincount(self.text[self.cls != OTHER], minlength=self.n) > 0


def found_in(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values held."""
    if not len(held):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(held, x), len(held) - 1)
    return held[i] == x


class Pairs:
    """Questions and answers of a batch with the features of each pair."""

    def __init__(self, questions: list[str], answers: list[str], fields: np.ndarray, known: np.ndarray, languages: Languages):
        with np.errstate(over="ignore"):
            self._build(questions, answers, fields, known, languages)

    def _build(self, questions, answers, fields, known, languages) -> None:
        uniq = list(dict.fromkeys(questions))
        place = {q: i for i, q in enumerate(uniq)}
        of = np.array([place[q] for q in questions], np.int64)
        q, a = Texts(uniq), Texts(answers)
        n, self.a = a.n, a
        lang_q, sure_q = languages.name(q.texts)
        lang_a, sure_a = languages.name(a.texts)
        numbers = {k: i + 1 for i, k in enumerate(languages.labels)} | {"": 0}
        lq, la = np.array([numbers[x] for x in lang_q], np.int64)[of], np.array([numbers[x] for x in lang_a], np.int64)
        sq, sa = (np.asarray(sure_q) >= SURE)[of], np.asarray(sure_a) >= SURE
        zh = numbers.get("zh", -1)
        lq, sq = np.where(fields == 1, zh, lq), np.where(fields == 1, zh > 0, sq)
        self.relation = np.where((lq <= 0) | (la == 0), 0, np.where(lq == la, 1, 2))
        self.sure, self.lang_a, self.lang_q = sq & sa, la, lq
        # words of the answer: known, shared with the question, or neither
        pair_q = np.sort(np.unique(mix(q.word, 1) ^ mix(q.text.astype(np.uint64), 2)))
        shared = found_in(mix(a.word, 1) ^ mix(of[a.text].astype(np.uint64), 2), pair_q)
        plain = (a.cls != LETTER) | found_in(a.word, known)
        norm = np.where(plain, a.word, np.where(shared, np.uint64(11), np.uint64(13)))
        rare = (q.cls == LETTER) & ~found_in(q.word, known) & (q.end - q.start >= 3)
        key_a = np.sort(mix(a.word, 1) ^ mix(a.text.astype(np.uint64), 2))
        rq_text, rq_word = q.text[rare], q.word[rare]
        order = np.argsort(rq_text, kind="stable")
        rq_text, rq_word = rq_text[order], rq_word[order]
        lo, hi = np.searchsorted(rq_text, of), np.searchsorted(rq_text, of, "right")
        who = np.repeat(np.arange(n), hi - lo)
        at = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        got = found_in(mix(rq_word[at], 1) ^ mix(who.astype(np.uint64), 2), key_a)
        have, of_q = np.bincount(who[got], minlength=n), np.bincount(who, minlength=n)
        self.names = np.where(of_q == 0, 0, np.where(have == 0, 1, np.where(have < of_q, 2, 3)))
        # the end of the answer: its last token that is no mark, and what marks follow
        idx = np.arange(len(a.word))
        solid = np.full(n, -1, np.int64)
        np.maximum.at(solid, a.text[a.mark == 0], idx[a.mark == 0])
        trail = idx > solid[a.text]
        dots = np.bincount(a.text[trail], weights=((a.points[a.start] == 46) | (a.mark == 3))[trail], minlength=n)
        ell = np.bincount(a.text[trail & (a.mark == 3)], minlength=n)
        ends = np.bincount(a.text[trail & (a.mark != 2)], minlength=n)
        self.ending = np.where(ends == 0, 0, np.where((dots >= 3) | (ell > 0), 2, 1))
        first, has = a.tokens[:-1], solid >= 0
        feats: list[tuple[np.ndarray, np.ndarray]] = []

        def add(rows, values, salt):
            feats.append((np.asarray(rows, np.int64), mix(np.asarray(values).astype(np.uint64), salt)))

        every = np.arange(n)
        add(every, fields, 20)
        add(a.text, norm, 21)
        same = a.text[1:] == a.text[:-1]
        add(a.text[1:][same], (norm[:-1] * _K1 + norm[1:])[same], 22)
        add(every, self.ending, 23)
        tail = norm[np.maximum(solid, 0)] if len(norm) else np.zeros(n, np.uint64)
        roll = np.zeros(n, np.uint64)
        for k in range(4):
            here = has & (solid - k >= first)
            roll[here] = roll[here] * _K1 + norm[solid[here] - k]
            add(every[here], roll[here], 24 + k)
            add(every[here], roll[here] * np.uint64(4) + self.ending[here].astype(np.uint64), 28 + k)
        stop = np.where(has, a.end[np.maximum(solid, 0)] if len(norm) else 0, 0)
        for k in (2, 3, 4, 6):
            here = has & (stop - k >= a.at[:-1])
            add(every[here], a.hash(stop[here] - k, stop[here]), 32 + k)
        lone = np.where(has & (tail == np.uint64(13)), 1, np.where(has & (tail == np.uint64(11)), 2, 0))
        add(every, lone * 64 + la, 40)
        strong = self.relation * 2 + self.sure
        add(every, self.relation, 41)
        add(every, strong, 42)
        add(every, strong * 4 + self.ending, 43)
        add(every, self.ending * 64 + la, 44)
        # how the whole of both compare
        qa, qz, aa, az = q.bare_at[of], q.bare_at[of + 1], a.bare_at[:-1], a.bare_at[1:]
        qn, an = qz - qa, az - aa
        hq = q.bare_hash(qa, qz)
        fits = (qn >= 3) & (an >= qn)
        starts = np.where(fits, a.bare_hash(aa, np.minimum(aa + qn, az)) == hq, False)
        closes = np.where(fits, a.bare_hash(np.maximum(az - qn, aa), az) == hq, False)
        head = np.where((an > 0) & (an < qn), q.bare_hash(qa, np.minimum(qa + an, qz)) == a.bare_hash(aa, az), False)
        exact, times = starts & closes & (an % np.maximum(qn, 1) == 0), np.minimum(an // np.maximum(qn, 1), 3)
        self.copied = starts | closes
        add(every, (exact * 8 + starts * 4 + closes * 2 + head) * 4 + np.where(self.copied, times, 0), 45)
        ratio = np.minimum(12, (6 * an) // np.maximum(qn, 1))
        add(every, (fields * 64 + la) * 16 + ratio, 46)
        add(every, self.names, 47)
        add(every, self.names * 4 + self.ending, 48)
        add(every, (self.names * 4 + self.ending) * 4 + self.relation, 49)
        tokens = np.maximum(np.diff(a.tokens), 1)
        add(every, fields * 16 + (8 * np.bincount(a.text[shared], minlength=n)) // tokens, 50)
        add(every, np.minimum(8, np.diff(a.at) // 12) * 64 + la, 51)
        add(every, np.minimum(6, tokens) * 2 + (an > 20), 52)
        add(every, np.minimum(4, np.bincount(a.text[norm == np.uint64(13)], minlength=n)) * 4 + self.ending, 53)
        rows, values = np.concatenate([f[0] for f in feats]), np.concatenate([f[1] for f in feats]) >> np.uint64(64 - BITS)
        both = np.sort((rows.astype(np.uint64) << np.uint64(BITS)) | values)
        both = both[np.append(True, both[1:] != both[:-1])]
        self.row, self.slot = (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)
        self.size = n
        self.visible = a.visible


def known_words(texts: list[str], least: int = KNOWN) -> np.ndarray:
    """Sorted hashes of the words that stand in enough different texts."""
    with np.errstate(over="ignore"):
        t = Texts(list(dict.fromkeys(texts)))
        each = np.unique(np.stack([t.word[t.cls == LETTER], t.text[t.cls == LETTER].astype(np.uint64)], 1), axis=0)
    words, n = np.unique(each[:, 0], return_counts=True)
    return words[n >= least]


def nothing_phrases() -> list[str]:
    """Answers that stand for nothing, made of the lists."""
    out = list(NOTHING)
    for no, things in NO_ANSWER.items():
        out += [f"{a}{'' if regex.search(r'[\p{Han}\p{Hiragana}\p{Thai}]', b) else ' '}{b}" for a in no.split() for b in things.split()]
        out += [f"{b} {a}" for a in no.split()[-1:] for b in things.split()]
    return out


def refusals() -> list[tuple[str, str]]:
    """(language, refusal): every combination of the lists."""
    out = []
    for lang, parts in REFUSALS.items():
        for words in product(*parts):
            t = ("" if lang in UNSPACED else " ").join(w for w in words if w)
            out.append((lang, t[0].upper() + t[1:] + ("。" if lang in ("zh", "ja") else "।" if lang == "hi" else "" if lang == "th" else ".")))
    return out


class PairModel:
    """The classifier with its thresholds."""

    def __init__(self, pairs: list[tuple[str | None, str | None, str]], languages: Languages | None = None, seed: int = SEED):
        rng = random.Random(seed)
        self.languages = languages or Languages([])
        self.w, self.thresholds, self.quality = np.zeros((1 << BITS, len(LABELS)), np.float32), np.full(len(LABELS), 2.0), {}
        phrases = [*(w for parts in REFUSALS.values() for p in parts for w in p), *nothing_phrases()]
        known = known_words([a for _, a, _ in pairs if a])
        self.common = Counter(w for _, a, _ in pairs if a for w in set(_LATIN.findall(a)))
        self.known = np.union1d(known, known_words(phrases, 1))
        self.nothing = {bare(x) for x in nothing_phrases()}
        whole = [p for p in pairs if p[0] and not nothing_in(p[1]) and bare(p[1]) not in self.nothing]
        self.fitted = False
        ok = self.sound(whole) if whole else []
        good = [p for p, s in zip(whole, ok) if s]
        if len(good) < LEAST_PAIRS:  # too little to learn from
            return
        self.fitted = True
        rng.shuffle(good)
        cut = max(1, len(good) * 4 // 5)
        said = refusals()
        rng.shuffle(said)  # thresholds are set on wordings that the weights have not seen
        self._fit(*self._examples(good[:cut], rng, said[: len(said) * 3 // 4]), seed)
        self._calibrate(*self._examples(good[cut:] or good, rng, said[len(said) * 3 // 4 :]))
        del self.common

    def pairs(self, rows) -> Pairs:
        return Pairs([q or "" for q, _, _ in rows], [visible(a) for _, a, _ in rows], np.array([FIELDS.index(f) for _, _, f in rows], np.int64), self.known, self.languages)

    def sound(self, rows) -> list[bool]:
        """Which answers may teach what sound answers are."""
        p = self.pairs(rows)
        long = np.diff(p.a.at) >= 16
        told = (p.relation == 1) & p.sure if self.languages.labels else np.ones(p.size, bool)
        thai = np.array([t in self.languages.labels and self.languages.labels.index(t) + 1 for t in ("th",)])[0]
        ends = (p.ending == 1) | (p.lang_a == thai if thai else False)
        asks = np.array([bool(_ASKS.search(a)) and not _ASKS.search(q) for q, a, _ in rows])
        good = long & told & ~p.copied & ends & (p.names >= 2) & ~asks
        return good.tolist()

    def _names(self, text: str) -> list[str]:
        """Words of a text that few answers have."""
        return [w for w in _LATIN.findall(text) if self.common[w] < KNOWN]

    def _examples(self, sound, rng, said):
        """Sound pairs and pairs broken on purpose, with their labels."""
        rows, labels = [], []

        def add(q, a, f, *names):
            if a and visible(a):
                rows.append((q, a, f))
                labels.append([n in names for n in LABELS])

        named = self.languages.name([a for _, a, _ in sound])[0]
        asked = self.languages.name([q for q, _, _ in sound])[0]
        by_lang: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, f) in enumerate(sound):
            by_lang.setdefault((f, named[i]), []).append(i)
        proposals = [k for k in by_lang if k[1]]
        empties, refused = nothing_phrases(), {}
        for lang, t in said:
            refused.setdefault(lang, []).append(t)
        tongues = list(refused)
        # rare languages come in several times, each time broken at other places
        often = {k: min(8, 1 + 300 // len(v)) for k, v in by_lang.items()}
        for i, (q, a, f) in [(i, s) for i, s in enumerate(sound) for _ in range(often[s[2], named[i]])]:
            mine = [w for w in self._names(q) if w in a]
            add(q, a, f)
            if mine and rng.random() < 0.15:  # a question whose name was broken or misread
                w = rng.choice(mine)
                k = rng.randrange(1, len(w))
                q = q.replace(w, w[:k] + rng.choice(["\n", "-\n", "- ", "1", "о"]) + w[k:])
                add(q, a, f)
            if f == "proposedText" and not q.isascii() and rng.random() < 0.1:  # a question decoded wrongly tells no language
                add(q.encode("utf-8", "replace").decode(rng.choice(["latin-1", "cp437", "koi8_r"])), a, f)
            t = a.rstrip().rstrip(_CLOSE).rstrip(_MARKS)
            if rng.random() < 0.7:  # complete without its final mark
                add(q, t, f)
            for _ in range(2):
                k = int(len(t) * rng.uniform(0.12, 0.97))
                if k < len(t) - 1 and t[:k].strip():
                    add(q, t[:k].rstrip() + rng.choice(["", "", "", "", "...", "…", " (", "（", " -", ",", " "]), f, "TRUNCATED")
            if rng.random() < 0.5:  # just before the end
                words = t.split(" ")
                if len(words) > 2:
                    add(q, " ".join(words[: -rng.choice([1, 1, 2, 3])]), f, "TRUNCATED")
                elif len(t) > 6:
                    add(q, t[: -rng.choice([2, 3, 4])], f, "TRUNCATED")
            if rng.random() < 0.6:
                near = "zh" if f == "translatedText" else asked[i]
                lang = rng.choice(["en", "en2", *[near if near in refused else "en"] * 2, rng.choice(tongues)])
                r = rng.choice(refused[lang])
                if self._names(q) and rng.random() < 0.25:
                    r += rng.choice([" {}?", " {}.", " ({})"]).format(rng.choice(self._names(q)))
                add(q, r, f, "REFUSAL")
            if rng.random() < 0.4:
                e = rng.choice(empties if rng.random() < 0.5 else NOTHING)
                e = rng.choice([e, e, e.upper(), e.capitalize()])
                add(q, rng.choice(["{}", "{}", "{}.", "({})", "[{}]", "<{}>", '"{}"', "（{}）", "- {} -"]).format(e), f, "EMPTY")
            if rng.random() < 0.5:
                c = q
                c = (c, f'"{c}"', f"{rng.choice(LABEL_WORDS)}: {c}", f"{c} {c}", c.upper() if rng.random() < 0.5 else c.lower(), f"  {c} ")[rng.randrange(6)]
                add(q, c, f, "COPY")
            if rng.random() < 0.9:
                want = "zh" if f == "translatedText" else asked[i]
                other = [k for k in proposals if k[1] != named[i] and k[1] != want]
                if other:
                    j = rng.choice(by_lang[rng.choice(other)])
                    b = sound[j][1]
                    old = [w for w in self._names(sound[j][0]) if w in b]
                    if old and mine:
                        b = b.replace(old[0], mine[0])
                    add(q, b, f, "WRONG_LANGUAGE")
        return self.pairs(rows), np.array(labels, np.float32).reshape(-1, len(LABELS))

    def _fit(self, p: Pairs, y: np.ndarray, seed: int) -> None:
        """Logistic regression by AdaGrad over shuffled batches of sparse rows."""
        rng = np.random.default_rng(seed)
        n, k = 1 << BITS, len(LABELS)
        w, g = np.zeros((n, k), np.float32), np.full((n, k), 1e-4, np.float32)
        starts = np.searchsorted(p.row, np.arange(p.size + 1))
        lens = np.diff(starts)
        for _ in range(EPOCHS):
            order = rng.permutation(p.size)
            for b in range(0, len(order), 256):
                rows = order[b : b + 256]
                own = lens[rows]
                ends = np.cumsum(own)
                idx = p.slot[np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - own), own)]
                z = np.add.reduceat(w[idx], ends - own, axis=0)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32)
                u, inv = np.unique(idx, return_inverse=True)
                each = np.repeat(err, own, axis=0)
                grad = np.stack([np.bincount(inv, weights=each[:, c], minlength=len(u)) for c in range(k)], 1).astype(np.float32) + 1e-5 * w[u]
                g[u] += grad * grad
                w[u] -= 0.25 * grad / np.sqrt(g[u])
        self.w = w

    def scores(self, p: Pairs) -> np.ndarray:
        z = np.stack([np.bincount(p.row, weights=self.w[:, c][p.slot], minlength=p.size) for c in range(len(LABELS))], 1) if p.size else np.zeros((0, len(LABELS)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _calibrate(self, p: Pairs, y: np.ndarray) -> None:
        """Per label the threshold of best F1 on held-out pairs, at the middle of the best stretch."""
        s = self.scores(p)
        for k, name in enumerate(LABELS):
            grid = np.linspace(0.05, 0.95, 91)
            f1 = np.array([2 * float(((s[:, k] >= t) & (y[:, k] > 0)).sum()) / max(1.0, (s[:, k] >= t).sum() + y[:, k].sum()) for t in grid])
            best = np.flatnonzero(f1 >= f1.max() - 1e-3)
            self.thresholds[k] = grid[best[len(best) // 2]]
            self.quality[name] = round(float(f1.max()), 4)
            if name == "COPY" and (y[:, k] > 0).any():  # an exact check follows, so the classifier must only not miss any
                self.thresholds[k] = min(self.thresholds[k], 0.8 * float(np.quantile(s[y[:, k] > 0, k], 0.001)))

    def defects(self, rows) -> list[str | None]:
        """The first defect that applies to each (question, answer, field)."""
        out: list[str | None] = ["EMPTY" if a is None else None for _, a, _ in rows]
        todo, size = [], 0
        for i, (q, a, _) in enumerate(rows):
            if a is not None:
                todo.append(i)
                size += len(q or "") + len(a)
                if size > CHUNK_CHARS:
                    self._judge(rows, todo, out)
                    todo, size = [], 0
        self._judge(rows, todo, out)
        return out

    def _judge(self, rows, todo: list[int], out: list) -> None:
        if not todo:
            return
        mine = [rows[i] for i in todo]
        p = self.pairs(mine)
        s = self.scores(p)
        hit = s >= self.thresholds
        for i, (q, a, _), seen, h, copied, other in zip(todo, mine, p.visible.tolist(), hit.tolist(), p.copied.tolist(), (p.relation == 2).tolist()):
            empty, refusal, copy, truncated, language = h
            if not seen:
                out[i] = "EMPTY"
            elif not self.fitted:
                out[i] = "EMPTY" if bare(a) in self.nothing else "COPY" if copied and is_copy(q, a) else None
            elif empty:
                out[i] = "EMPTY"
            elif refusal and not copy:
                out[i] = "REFUSAL"
            elif copy and is_copy(q, a):
                out[i] = "COPY"
            elif language:
                out[i] = "WRONG_LANGUAGE"
            elif truncated:
                out[i] = "TRUNCATED"


def answer_rows(reviews: DataFrame) -> DataFrame:
    """(sentence_id, field_name, question, answer): both answers of each review."""
    base = [F.col("sentenceId").alias("sentence_id"), F.col("parsedText").alias("question")]
    both = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("answer")) for c in ("proposedText", "translatedText")])
    return reviews.select(*base, F.explode(both).alias("x")).select("sentence_id", "x.field_name", "question", "x.answer")


def fitted_model(reviews: DataFrame, documents: DataFrame | None = None, sample: int = SAMPLE) -> PairModel:
    """The classifier fitted on a bounded sample: about `sample` reviews, the first by a hash of their keys, the same every time."""
    h = F.pmod(F.xxhash64("sentenceId"), F.lit(1 << 30))
    texts = ["sentenceId", "parsedText", "proposedText", "translatedText"]
    share = int(min(1.0, (1.5 * sample + 100) / max(reviews.count(), 1)) * (1 << 30))
    rows = reviews.select(h.alias("h"), *texts).where(F.col("h") < share).distinct().orderBy("h", *texts).limit(sample).collect()
    pairs = [(r.parsedText, r[f], f) for f in FIELDS for r in rows]
    return PairModel(pairs, fitted_languages(documents) if documents is not None else None)


def defect_rows(reviews: DataFrame, model: PairModel) -> DataFrame:
    """(sentence_id, field_name, defect): one row for each defective answer."""
    sent = reviews.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            ids, fields, qs, ans = (batch.column(i).to_pylist() for i in range(4))
            got = m.defects(list(zip(qs, ans, fields)))
            pick = [i for i, d in enumerate(got) if d]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in pick], pa.string()), pa.array([fields[i] for i in pick], pa.string()), pa.array([got[i] for i in pick], pa.string())],
                names=["sentence_id", "field_name", "defect"])

    return answer_rows(reviews).mapInArrow(run, "sentence_id string, field_name string, defect string").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "ai_correction_reviews")
    return defect_rows(reviews, fitted_model(reviews, table(spark, d, "documents")))


QUERIES = {"p6_found": p6_found}
