"""Problem 3: broken prompt and response pairs.

Clauses of a response are tagged answer, refusal, echo, foreign or unfinished by a linear-chain conditional random
field; the share of a response's letters that each tag covers decides its defect, and nothing else does. The field is
trained here, on sequences made from a bounded sample of rows: responses that show no mark of a defect stay answers,
and from them echoes, broken-off texts and foreign texts are composed; refusals are composed from phrases and taken
from the sample. A refusal is told by the words of a clause, whose weights are learned with the rest.

Features are computed in numpy over all clauses of a batch at once.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import ARABIC, CLASS, CLASSES, CYRILLIC, DEVANAGARI, DIGIT, FOLD, HAN, HANGUL, KANA, LATIN, LOWER, OTHER, THAI, Block, chunks
from .crf import Sparse, train_chain, viterbi
from .languages import ASKS_OTHER, WORD_LANGUAGES
from .shared import alnum_key, batches_of, bounded_sample, code_points, columns_of, cut, gram_hashes, mix64

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Rows (those of lowest hash) from which training sequences are made, and rounds of training.
SAMPLE_ROWS, TRAIN_ROUNDS = 2500, 80
#: Clauses that a training sequence has at most (longer ones of the sample aren't trained on); tagging has no such bound.
TRAIN_CLAUSES = 24
#: Composed refusals per language.
COMPOSED_REFUSALS = 120
#: Bits of the filter of endings looked for: 1 MB, whatever the corpus. It only spares counting; counts are exact.
FILTER_BITS = 20
#: Characters of an ending.
ENDING_LENGTH = 5
#: A Han, Kana or Hangul character is common if at least this share of the texts contains it.
COMMON_SHARE = 0.0005
#: Slots of the lexical weights.
LEXICAL_BITS = 20
_ECHO_GRAM = 4

# Answers that only fill the field, without punctuation and case.
FILLERS = set("none null nil na n/a nan tbd todo tba empty blank unknown undefined placeholder answer response output noanswer noresponse pending 无 空 暂无 略 待补充 待定 待填写 没有 未填写 无内容 空白 なし 未記入 keine leer aucun rien vide ninguno vacío нет пусто".split())
_FILLER_KEYS = {alnum_key(f) for f in FILLERS}
_LONGEST_FILLER = max(map(len, _FILLER_KEYS))

# Wording by which refusals of the sample are recognised as such, to be trained on.
REFUSALS = re.compile(
    r"(?i)无法(?:回答|提供|协助|给出|帮助)|不能(?:就此)?(?:作答|回答|提供|给出|帮)|恕(?:我)?(?:不能|难)|不便(?:讨论|回答|透露)|不具备(?:行医|相关)?资格|没有能力给出|超出了?我(?:能|的)|拒绝回答|"
    r"(?:can(?:no|['’])t|cannot|unable to|not able to|won['’]t be able to)\s+(?:\w+\s+){0,2}(?:help|answer|assist|give|provide|offer|advise|discuss)|something i (?:can(?:no|['’])t|cannot)|(?:i must|have to) decline|"
    r"お答え(?:でき|いたしかね|しかね)|差し控え|回答できません|お手伝いできません|(?:dabei|damit|hierbei) kann ich (?:leider )?nicht|leider nicht (?:helfen|beantworten)|keinen medizinischen rat|"
    r"ne peux pas (?:vous )?(?:répondre|aider|donner)|pas possible de (?:donner|répondre)|no puedo (?:\w+ )?(?:ayudar|responder|dar|contestar)|no me es posible|не мог[уе]\s+(?:\w+\s+)?(?:ответить|помочь|дать)|не имею возможности|"
    r"(?:उत्तर|सलाह|मदद) (?:नहीं|देने में असमर्थ)|असमर्थ हूँ|ไม่สามารถ(?:ตอบ|ให้|ช่วย)|لا (?:أستطيع|يمكنني) (?:الإجابة|المساعدة|تقديم)"
)

# Phrases of refusals. Each language has patterns, and the phrases that their letters stand for: d for
# declining, a for an act, t for a thing, o for an opening, c for a closing.
PHRASES = {
    "en": (["{o}{d} {a} {t}.{c}", "{o}{d} {a} {t}{c}", "{t} is something {d} {a}.", "{o}{t} is beyond what I can {a}."],
           {"d": "I can't|I cannot|I'm unable to|I am not able to|I won't be able to|I would rather not|I'd rather not|I prefer not to|I must decline to|I have to refuse to|I'm not in a position to|I do not|I don't|I am not allowed to|I will not|We cannot|It is not possible for me to",
            "a": "answer|help with|discuss|talk about|go into|comment on|give advice on|give medical advice on|assist with|assist you with|say anything about|provide information on|offer an opinion on|respond to|speak about",
            "t": "that|this|it|this question|your question|your request|this request|this topic|this subject|such matters|medical questions|the matter",
            "o": "|I'm sorry, but |Sorry, |Unfortunately, |I apologize, but |As an AI, |As an AI system, |As a language model, |I'm afraid ", "c": "| Please see a doctor.|; please ask a professional.| Please contact your clinic.| Ask me something else."}),
    "zh": (["{o}{d}{a}{t}。{c}", "{o}{t}{d}{a}。{c}", "{o}{t}超出了我能{a}的范围。{c}", "{o}{d}{a}。{c}", "{o}关于{t}，{d}{a}。", "{t}换一个吧，{d}{a}。"],
           {"d": "我无法|无法|我不能|我没法|没法|我不便|不便|恕我不能|恕难|我没有能力|我不愿意|我不会|我不想|我没有资格|我不具备资格|我拒绝|我不方便|我没办法|不能", "a": "回答|作答|讨论|提供建议|给出意见|发表意见|协助|帮忙|评论|透露|解答|回应|谈论|给出医疗建议",
            "t": "这个问题|此类内容|您的请求|您的问题|这个话题|这方面的问题|这类问题|医疗建议|这件事|该问题", "o": "|抱歉，|对不起，|很遗憾，|不好意思，|作为一个语言模型，|作为人工智能，", "c": "|请咨询专业医生。|建议联系当地医院。|请换一个问题。|如有不适请尽快就医。"}),
    "ja": (["{o}{t}には{a}{d}。{c}", "{o}{t}について{a}{d}。{c}", "{o}{t}は{a}{d}。", "{o}{t}に関する{a}{d}。"],
           {"d": "できません|いたしかねます|しかねます|は差し控えます|は差し控えさせていただきます|はできかねます|はご遠慮します|することはできません|したくありません|しないことにしています", "a": "お答え|回答|お手伝い|対応|助言|コメント|説明|お話し", "t": "医療|診断|そのご質問|この質問|この件|この話題|医療上のご相談|その内容|ご要望", "o": "|申し訳ありませんが、|すみません、|残念ながら、|AIとして、", "c": "|医師にご相談ください。|別の質問をお願いします。"}),
    "de": (["{o}{t} {d} nicht {a}.{c}", "{o}{t} {d} leider nicht {a}.{c}", "{t} {d} keine Auskunft geben.{c}", "{o}{t} {d} leider keine Auskunft erteilen.", "{o}ich kann {t} nicht {a}.{c}"],
           {"d": "kann ich|möchte ich|darf ich|werde ich|will ich|können wir|kann ich Ihnen", "a": "beantworten|helfen|sprechen|raten|weiterhelfen|etwas sagen|reden|antworten|diskutieren|beraten|kommentieren", "t": "Darüber|Dazu|Zu diesem Thema|Zu dieser Frage|Zu diesem Punkt|Das|Diese Frage|Dabei|Damit|Hierzu|Ihre Anfrage|Dieses Thema|Hierbei", "o": "|Es tut mir leid, |Leider: |Als KI: |Entschuldigung, ", "c": "| Bitte fragen Sie einen Arzt.| Einen medizinischen Rat gebe ich nicht."}),
    "fr": (["{o}{d} {a} {t}.{c}", "{o}{d} {a} {t}{c}", "{o}{d} donner un avis.{c}"],
           {"d": "je ne peux pas|je ne souhaite pas|je ne suis pas en mesure de|je préfère ne pas|il ne m’est pas possible de|je refuse de|je ne veux pas|je dois renoncer à", "a": "répondre à|vous aider sur|donner d’avis sur|donner un avis sur|donner un conseil médical sur|discuter de|parler de|me prononcer sur|commenter|fournir de conseil sur", "t": "cette question|ce sujet|cela|votre demande|ce point|ces questions", "o": "|Désolé, |Je suis désolé, |Malheureusement, |En tant qu’IA, ", "c": "| Consultez un médecin.| Veuillez poser une autre question."}),
    "es": (["{o}{d} {a} {t}.{c}", "{o}{d} {a} {t}{c}"],
           {"d": "no puedo|no me es posible|prefiero no|no estoy en condiciones de|no quiero|no voy a|debo negarme a|no me corresponde", "a": "responder a|ayudar con|ayudarle con|hablar de|opinar sobre|dar consejos sobre|contestar|comentar", "t": "esa pregunta|este tema|eso|su solicitud|esta cuestión|su pregunta", "o": "|Lo siento, |Lamentablemente, |Disculpe, |Como IA, ", "c": "| Consulte a un médico.| Haga otra pregunta."}),
    "ru": (["{o}{d} {a} {t}.{c}", "{o}на {t} {d} {a}.", "{o}{t} {d} {a}.{c}"],
           {"d": "я не могу|не могу|я не буду|не имею возможности|я не вправе|предпочитаю не|мне не хотелось бы|я отказываюсь|вынужден отказаться", "a": "отвечать на|ответить на|обсуждать|комментировать|давать советы по|помочь с|помогать с|говорить про", "t": "этот вопрос|эту тему|ваш запрос|это|такие вопросы|ваш вопрос", "o": "|Извините, |К сожалению, |Простите, |Как языковая модель, ", "c": "| Обратитесь к врачу.| Задайте другой вопрос."}),
    "hi": (["{o}मैं {t} {a} {d}।{c}", "{o}{t} {a} {d}।"],
           {"d": "नहीं दे सकता|देने में असमर्थ हूँ|नहीं कर सकता|देना संभव नहीं है|नहीं देना चाहता|नहीं कर पाऊँगा", "a": "उत्तर|सलाह|मदद|जानकारी|जवाब|चर्चा|टिप्पणी", "t": "इस प्रश्न का|इस विषय पर|आपके अनुरोध में|इस बारे में|आपके सवाल का", "o": "|क्षमा करें, |खेद है, |माफ़ कीजिए, ", "c": "| कृपया डॉक्टर से मिलें।"}),
    "th": (["{o}{d}{a}{t}", "{o}{t} {d}{a}ได้ {c}"],
           {"d": "ฉันไม่สามารถ|ไม่สามารถ|ขอไม่|ไม่สะดวกที่จะ|เราไม่อาจ|ไม่ขอ", "a": "ตอบ|ให้คำแนะนำ|ช่วยเหลือ|พูดถึง|แสดงความเห็น|ให้ข้อมูล", "t": "คำถามนี้|เรื่องนี้|หัวข้อนี้|คำขอของคุณ|เกี่ยวกับเรื่องนี้", "o": "|ขออภัย |เสียใจด้วย |ขอโทษ ", "c": "|กรุณาปรึกษาแพทย์"}),
    "ar": (["{o}{d} {a} {t}.{c}"],
           {"d": "لا أستطيع|لا يمكنني|أعتذر عن|لا أرغب في|ليس بإمكاني|أرفض", "a": "الإجابة عن|المساعدة في|تقديم المشورة بشأن|مناقشة|التعليق على|الحديث عن", "t": "هذا السؤال|هذا الموضوع|طلبك|ذلك", "o": "|عذرا، |للأسف، |آسف، ", "c": "| يرجى استشارة الطبيب."}),
}

_TERMINAL = set("。！？.!?।؟…～~”」』»）)】]\"")
_STOPS = "。！？.!?।؟;；"
_LABEL_LINE = re.compile(r"[^：:。，,.]{1,12}[：:]\s*[^：:。，,.]{1,14}")
_OPEN_MARKS = set("：:，,、；;（(「『“«/-–—")
_OPEN_ITEM = re.compile(r"\s*(?:[-*•]|\(?\d{1,3}[.)、）])\s*")
_WIDE_LETTERS = re.compile("[⺀-鿿가-힣豈-﫿ｦ-ﾝ]")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_LOOSE = re.compile(r"[\s​]+(?=[!?»：；])")
_TAIL = " \t\r\n　\xa0​﻿…～~*_"

# Kinds of an ending, as feature numbers; 0 is a clause that isn't the last.
STOP, OPEN, LABEL, SHORT, UNSEEN = range(1, 6)
_SHARES = (0.02, 0.12, 0.35, 0.7)  # above UNSEEN: how often the last characters end a sentence elsewhere


def _masked(text: str) -> str:
    return _DIGITS.sub("0", _LOOSE.sub("", text)).lower()


def _ending_keys(text: str) -> np.ndarray:
    """Hashes (64 bits) of all runs of the text that are as long as an ending."""
    return gram_hashes(code_points(text), ENDING_LENGTH).view(np.int64)


def _ending_key(end: str) -> int | None:
    """Key of the ending of a text, from its last sixty characters; None where they are too few."""
    tail = _masked(end)
    if _WIDE_LETTERS.search(tail[-4:]):
        tail = re.sub(r"\s+", "", tail)
    tail = tail[-ENDING_LENGTH:]
    return int(_ending_keys(tail)[0]) if len(tail) == ENDING_LENGTH else None


def _filter_slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _set(chars) -> np.ndarray:
    """Membership of characters of the basic plane, by code point."""
    out = np.zeros(0x10000, dtype=bool)
    out[list(map(ord, chars))] = True
    return out


def _within(members: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return members[np.minimum(codes, 0xFFFF)]


_STOP_CODES, _LOOSE_CODES = _set(_STOPS), _set("!?»：；")
_SPACE_CODES = _set([chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b"])


def _masked_codes(codes: np.ndarray) -> np.ndarray:
    """What ``_masked`` makes of a text, over code points."""
    nd = CLASS(codes) == DIGIT
    wide = nd & (codes > 0x7F)
    nd[wide] = [chr(c).isdecimal() for c in codes[wide].tolist()]
    inner = np.zeros(len(codes), dtype=bool)
    inner[1:-1] = ((codes[1:-1] == 46) | (codes[1:-1] == 44)) & nd[:-2] & nd[2:]
    run = nd | inner
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = run[1:] & run[:-1]
    space = _within(_SPACE_CODES, codes)
    # The next character that is no space, of each character.
    at = np.where(space, len(codes), np.arange(len(codes)))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    loose = space & (nxt < len(codes)) & _within(_LOOSE_CODES, codes[np.minimum(nxt, len(codes) - 1)])
    out = LOWER(codes)
    out[run] = 48
    return out[~(again | loose)]


def count_endings(batches, wanted: np.ndarray):
    """Partial counts (kind, key, total, ended); 'e': five characters that pass the filter of wanted ones, and how often a
    stop (in Thai a blank) follows them; 'c': at 0 the number of texts, at c the texts that contain the East Asian
    character c."""
    texts, wide = 0, np.zeros(0x10000, dtype=np.int64)
    names = ["kind", "key", "total", "ended"]
    for b in batches:
        held = [t for column in batches_of(b, b.schema.names) for t in column if t]
        texts += len(held)
        for lo, hi in chunks(list(map(len, held))):
            block = Block(held[lo:hi])
            east = (block.codes > 0x2E7F) & (block.codes < 0xFF00)
            own, of = block.codes[east].astype(np.uint16), block.row[east]
            order = np.argsort(own, kind="stable")  # a radix sort; texts stay in order within a character
            own, of = own[order], of[order]
            wide += np.bincount(own[np.concatenate(([True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])))] if len(own) else own, minlength=0x10000)
            joined = _masked_codes(block.codes)
            if len(joined) < ENDING_LENGTH + 2:
                continue
            keys = gram_hashes(joined, ENDING_LENGTH).view(np.int64)[:-1]
            after, last = joined[ENDING_LENGTH:], joined[ENDING_LENGTH - 1 : -1]
            stop = _within(_STOP_CODES, after) | ((last >= 0xE00) & (last < 0xE80) & ((after == 32) | (after == 10)))
            passed = wanted[_filter_slots(keys)]
            keys, at = np.unique(keys[passed], return_inverse=True)
            total, ended = np.bincount(at, minlength=len(keys)), np.bincount(at[stop[passed]], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(["e"] * len(keys), pa.string()), *(pa.array(x.astype(np.int64)) for x in (keys, total, ended))], names)
    at = np.flatnonzero(wide)
    keys, n = np.concatenate(([0], at)), np.concatenate(([texts], wide[at]))
    yield pa.RecordBatch.from_arrays([pa.array(["c"] * len(keys)), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array([0] * len(keys), pa.int64())], names)


# --- features of clauses -------------------------------------------------------------------------------------------
_SPLITS, _STAYS, _ODD_CODES = _set("。！？!?।؟"), _set("”」』»）)】。！？!?…"), _set("\ufffd‡√≈∂∏" + "".join(map(chr, range(0x80, 0xA0))))
_EAST = (HAN, KANA, HANGUL)
_SPACED = np.isin(np.arange(CLASSES), (LATIN, CYRILLIC, DEVANAGARI, ARABIC, OTHER, DIGIT))
_JOINED = np.isin(np.arange(CLASSES), (HAN, KANA, HANGUL, THAI))
# Languages: the class of the script (Han is Chinese, Kana Japanese); languages in Latin letters come after those.
_LATIN_LANGUAGES = ("en", "de", "fr", "es")
_LATIN_FIRST, _LATIN_ANY = CLASSES, CLASSES + len(_LATIN_LANGUAGES)
_POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(31, 0x9E3779B97F4A7C15, dtype=np.uint64))))
#: Feature columns and how many values each has.
_WIDTHS = {"bias": 1, "echo": 15, "relation": 20, "odd": 2, "size": 5, "place": 4, "ending": 11}
_OFFSETS = dict(zip(_WIDTHS, np.cumsum([0, *_WIDTHS.values()])))
FEATURES = sum(_WIDTHS.values())
_SIZES = (4, 8, 12, 24)


def _word_hashes(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``first`` (of their first 32 letters)."""
    inside = np.repeat(first, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    place = inside - np.repeat(first, length)
    value = np.where(place < 32, codes[inside].astype(np.uint64) * _POWERS[np.minimum(place, 31)], np.uint64(0))
    return mix64(np.add.reduceat(value, np.cumsum(length) - length)) if len(first) else np.zeros(0, np.uint64)


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    words = sorted(w for w in WORD_LANGUAGES if w.isalpha())
    codes = code_points("".join(words))
    length = np.array(list(map(len, words)))
    h = _word_hashes(codes, np.cumsum(length) - length, length)
    order = np.argsort(h)
    votes = np.array([[lang in WORD_LANGUAGES[w] for lang in _LATIN_LANGUAGES] for w in words])
    return h[order], votes[order]


_WORD_HASHES, _WORD_VOTES = _word_table()


class Words:
    """Words of a block: runs of letters of scripts that space them; the segment of each, and its hash."""

    def __init__(self, folded: np.ndarray, classes: np.ndarray, segment: np.ndarray):
        letter = _SPACED[classes]
        begin = letter & ~np.concatenate(([False], letter[:-1]))
        self.first = np.flatnonzero(begin)
        end = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False])))
        self.segment, self.hash = segment[self.first], _word_hashes(folded, self.first, end - self.first + 1)
        self.latin = classes[self.first] == LATIN


def _languages(classes: np.ndarray, segment: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(language, share of other scripts' letters) of each segment; 0 if it can't be told. Latin letters weigh 0.4."""
    counts = np.bincount(segment * CLASSES + classes, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    counts[:, 0] = counts[:, DIGIT] = 0
    latin = counts[:, LATIN].copy()
    counts[:, LATIN] *= 0.4
    japanese = counts[:, KANA] * 4 > counts[:, HAN]
    counts[:, KANA] += np.where(japanese, counts[:, HAN], 0)
    counts[:, HAN] = np.where(japanese, 0, counts[:, HAN])
    total = counts.sum(axis=1)
    top = counts.argmax(axis=1)
    rest = 1 - counts[np.arange(n), top] / np.maximum(total, 1e-9)
    at = np.searchsorted(_WORD_HASHES, words.hash)
    at[at == len(_WORD_HASHES)] = 0
    known = words.latin & (_WORD_HASHES[at] == words.hash) if len(at) else np.zeros(0, bool)
    votes = np.zeros((n, len(_LATIN_LANGUAGES)))
    for k in range(len(_LATIN_LANGUAGES)):
        votes[:, k] = np.bincount(words.segment[known], weights=_WORD_VOTES[at[known], k], minlength=n)
    best = np.sort(votes, axis=1)
    clear = best[:, -1] > best[:, -2]
    spoken = np.bincount(words.segment[words.latin], minlength=n) >= 3  # fewer words without a function word can be a name
    language = np.where(total == 0, 0, np.where(top != LATIN, top, np.where(clear, _LATIN_FIRST + votes.argmax(axis=1), np.where(spoken & (latin > 0), _LATIN_ANY, 0))))
    return language, rest


def _relations(own: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """0 unknown, 1 the same language, 2 another in the same letters, 3 another in another script."""
    latin = lambda x: x >= _LATIN_FIRST
    any_ = (own == _LATIN_ANY) | (asked == _LATIN_ANY)
    other = np.where(latin(own) & latin(asked), np.where(any_, 0, 2), 3)
    return np.where((own == 0) | (asked == 0), 0, np.where(own == asked, 1, other))


def _cover(letters, row, clause, asked, asked_row, q: int, clauses: int) -> np.ndarray:
    """Share of each clause's runs of q letters that the question of its row has too; -1 where it has no run."""
    def keyed(x, r):
        h = gram_hashes(x, q)
        ok = r[: len(h)] == r[q - 1 :]
        r = r[: len(h)]
        return mix64(h ^ (r.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))), ok

    if len(letters) < q:
        return np.full(clauses, -1.0)
    own, ok = keyed(letters, row)
    ok &= clause[: len(own)] == clause[q - 1 :]
    theirs, fine = keyed(asked, asked_row) if len(asked) >= q else (np.zeros(0, np.uint64), np.zeros(0, bool))
    theirs = np.sort(theirs[fine])
    own, at = own[ok], clause[: len(own)][ok]
    hit = np.zeros(len(own), dtype=bool)
    if len(theirs):
        place = np.searchsorted(theirs, own)
        hit = theirs[np.minimum(place, len(theirs) - 1)] == own
    total = np.bincount(at, minlength=clauses)
    return np.where(total > 0, np.bincount(at[hit], minlength=clauses) / np.maximum(total, 1), -1.0)


@dataclass
class Clauses:
    """The clauses with letters of several responses, in order."""

    row: np.ndarray  # response of each
    start: np.ndarray  # first character in the response
    letters: np.ndarray
    weight: np.ndarray  # letters, those of the Latin alphabet, which say less each, at 0.4
    features: np.ndarray  # one number per feature column
    lexical: Sparse
    odd: np.ndarray
    relation: np.ndarray
    lengths: np.ndarray  # clauses of each response


class Marks:
    """Features of the clauses of responses, from the corpus counts."""

    def __init__(self, share: dict[int, float], rare: np.ndarray):
        self.share = share  # of the endings of the sample; those of other answers come with their rows
        self.rare = rare  # East Asian characters that few texts have

    def ending(self, answer: str, share: float | None = None) -> int:
        """How the response's end looks: a stop, open, or how often its last characters end a sentence elsewhere."""
        shown = answer.rstrip(_TAIL.replace("～", "").replace("~", "").replace("…", ""))
        if shown[-1:] in ("～", "~"):
            return STOP
        bare = answer.rstrip(_TAIL)
        if not bare or bare[-1] in _OPEN_MARKS:
            return OPEN
        line = bare[max(bare.rfind("\n"), bare.rfind("\r")) + 1 :]
        if max(line.rfind("("), line.rfind("（")) > max(line.rfind(")"), line.rfind("）")) or (len(line) < 12 and _OPEN_ITEM.fullmatch(line)):
            return OPEN
        if bare[-1] in _TERMINAL:
            return STOP
        if len(line) < 32 and _LABEL_LINE.fullmatch(line.strip()):
            return LABEL
        key = _ending_key(bare[-60:])
        if key is None:
            return SHORT
        s = self.share.get(key, -1.0) if share is None else share
        if shown[-1:] == "…" and s > 0.2:
            return STOP
        return UNSEEN if s < 0 else UNSEEN + 1 + int(np.searchsorted(_SHARES, s, side="right"))

    def clauses(self, questions: list[str], answers: list[str], shares: list[float] | None = None) -> Clauses:
        block, asked = Block(answers), Block(questions)
        codes, row = block.codes, block.row
        classes, folded = CLASS(codes), FOLD(codes)
        alnum = classes > 0
        # Clauses end after a stop without closing marks behind it, before a blank after a full stop, and at line ends.
        split = np.zeros(len(codes), dtype=bool)
        blank = (codes == 32) | (codes == 0xA0)
        stop = _within(_SPLITS, codes)
        split[1:] = (stop[:-1] & ~_within(_STAYS, codes[1:])) | (codes[:-1] == 10) | (codes[:-1] == 13)
        full = np.flatnonzero((codes[1:-2] == 46) & alnum[:-3] & blank[2:-1]) + 1
        split[full + 1] = (classes[full - 1] != DIGIT) | (alnum[np.minimum(full + 2, len(codes) - 1)] & (classes[np.minimum(full + 2, len(codes) - 1)] != DIGIT))
        clause = np.cumsum(split)
        size = np.bincount(clause[alnum], minlength=int(clause[-1]) + 1 if len(clause) else 0)
        number = np.cumsum(size > 0) - 1
        n = int((size > 0).sum())
        clause = number[clause]  # characters before the first clause with letters may get -1: they have no letters
        first = np.flatnonzero(alnum & ~np.concatenate(([False], alnum[:-1])))
        first = first[np.concatenate(([True], clause[first][1:] != clause[first][:-1]))] if len(first) else first
        size, of_row = size[size > 0], row[first]
        letters, own_row, own = folded[alnum], row[alnum], clause[alnum]
        q_classes = CLASS(asked.codes)
        q_alnum = q_classes > 0
        q_folded = FOLD(asked.codes)
        cover = _cover(letters, own_row, own, q_folded[q_alnum], asked.row[q_alnum], _ECHO_GRAM, n)
        tiny = cover < 0
        if tiny.any():  # clauses too short for that are held against the question by pairs of letters
            some, ask = tiny[own], np.isin(asked.row, of_row[tiny]) & q_alnum
            cover = np.where(tiny, _cover(letters[some], own_row[some], own[some], q_folded[ask], asked.row[ask], 2, n), cover)
        words, q_words = Words(folded, classes, clause), Words(q_folded, q_classes, asked.row)
        q_lang, _ = _languages(q_classes, asked.row, q_words, len(questions))
        by_row = Words.__new__(Words)
        by_row.segment, by_row.hash, by_row.latin = row[words.first], words.hash, words.latin
        lang, rest = _languages(classes, row, by_row, len(answers))
        c_lang, _ = _languages(classes[alnum], own, words, n)
        # Where one script has nearly all letters, its clauses share the language; else each clause is looked at.
        mixed = (lang == 0) | (rest > 0.25)
        c_lang = np.where(mixed[of_row], c_lang, lang[of_row])
        odd_code = _within(_ODD_CODES, codes)
        accented = (codes >= 0xC0) & (codes <= 0xFF)  # three such letters in a row belong to no text in Latin letters
        if len(codes) > 2:
            odd_code[:-2] |= accented[:-2] & accented[1:-1] & accented[2:]
        odd_code[:-1] |= ((codes[:-1] == 0x951F) & (codes[1:] == 0x65A4)) | ((codes[:-1] >= 0xC0) & (codes[:-1] <= 0xFF) & (codes[1:] >= 0xA1) & (codes[1:] <= 0xBF))
        east = np.isin(classes, _EAST)
        rare = np.bincount(clause[east & self.rare[np.minimum(codes, 0xFFFF)]], minlength=n)
        odd = (np.bincount(clause[odd_code & (clause >= 0)], minlength=n) > 0) | (rare > np.maximum(2, 0.2 * np.bincount(clause[east], minlength=n)))
        relation = np.where(odd, 0, _relations(c_lang, q_lang[of_row]))
        lengths = np.bincount(of_row, minlength=len(answers))
        last = np.zeros(n, dtype=bool)
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        begins = np.concatenate(([True], of_row[1:] != of_row[:-1])) if n else np.zeros(0, bool)
        sizes = np.searchsorted(_SIZES, size, side="right")
        ending = np.zeros(n, dtype=np.int64)
        ending[last] = [self.ending(answers[r], None if shares is None else shares[r]) for r in of_row[last].tolist()]
        echo = np.where(cover < 0, 7, np.where(cover >= 0.98, 6, np.minimum((np.maximum(cover, 0) * 6).astype(np.int64), 5)))
        columns = {"bias": np.zeros(n), "echo": np.minimum(echo + 7 * (size < 12), 14), "relation": relation * 5 + sizes, "odd": odd, "size": sizes, "place": begins + 2 * last, "ending": ending}
        features = np.stack([_OFFSETS[k] + columns[k].astype(np.int64) for k in _WIDTHS], axis=1) if n else np.zeros((0, len(_WIDTHS)), np.int64)
        return Clauses(of_row, first - block.starts[of_row], size, size - 0.6 * np.bincount(clause[classes == LATIN], minlength=n), features, self._lexical(folded, classes, clause, words, n), odd, relation, lengths)

    def _lexical(self, folded, classes, clause, words: Words, n: int) -> Sparse:
        """Words and pairs of words, and runs of two and three letters where scripts don't space words."""
        m = np.uint64(0x94D049BB133111EB)
        next_ = words.segment[1:] == words.segment[:-1]
        found = [(words.segment, words.hash), (words.segment[:-1][next_], mix64(words.hash[:-1][next_] * m + words.hash[1:][next_]))]
        joined = _JOINED[classes]
        c = folded.astype(np.uint64)
        two = joined[:-1] & joined[1:] & (clause[:-1] == clause[1:]) if len(c) > 1 else np.zeros(0, bool)
        at = np.flatnonzero(two)
        pair = (c[at] << np.uint64(21)) | c[at + 1]
        found.append((clause[at], mix64(pair * m)))
        three = at[np.concatenate((at[1:] == at[:-1] + 1, [False]))] if len(at) else at
        found.append((clause[three], mix64((((c[three] << np.uint64(21)) | c[three + 1]) * m) ^ (c[three + 2] * np.uint64(0x9E3779B97F4A7C15)))))
        item = np.concatenate([x for x, _ in found])
        slot = (np.concatenate([h for _, h in found]) >> np.uint64(64 - LEXICAL_BITS)).astype(np.int64)
        order = np.argsort(item, kind="stable")
        item, slot = item[order], slot[order]
        many = np.bincount(item, minlength=n)
        # Long clauses have many words: their weights count by the root of their number, so that length decides nothing.
        return Sparse(item, slot, n, 1 << LEXICAL_BITS, 1 / np.sqrt(np.maximum(many, 1))[item])


# --- training ----------------------------------------------------------------------------------------------------------
def composed_refusals(lang: str, n: int, rnd: random.Random) -> list[str]:
    """Refusals put together from the phrases of a language."""
    patterns, parts = PHRASES[lang]
    parts = {k: v.split("|") for k, v in parts.items()}
    out = []
    for _ in range(n):
        text = rnd.choice(patterns).format(**{k: rnd.choice(parts.get(k, [""])) for k in "datoc"})
        out.append(text[:1].upper() + text[1:])
    return out


_PARTS = re.compile(r"(?<=[。！？!?।])(?![”」』»）)】。！？!?…])|(?<=[^\W\d]\.)\s+|\n")
_LANGUAGE_OF = {HAN: "zh", KANA: "ja", CYRILLIC: "ru", DEVANAGARI: "hi", THAI: "th", ARABIC: "ar"} | {_LATIN_FIRST + k: x for k, x in enumerate(_LATIN_LANGUAGES)}


def _training(rows: list[tuple[str, str]], marks: Marks) -> tuple[Clauses, np.ndarray, int]:
    """Clauses and labels of composed sequences, and how many sequences those are."""
    rows = [(q, a) for q, a in rows if alnum_key(a)]
    rnd = random.Random(7)
    c = marks.clauses([q for q, _ in rows], [a for _, a in rows])
    weight = lambda of: np.bincount(c.row, weights=c.letters * of, minlength=len(rows))
    total = np.maximum(weight(np.ones(len(c.row))), 1)
    echo = np.isin(c.features[:, 1] - _OFFSETS["echo"], (4, 5, 6, 11, 12, 13))
    strange = weight((c.relation >= 2) | c.odd) > 0
    final = np.zeros(len(rows), dtype=np.int64)
    final[c.row] = c.features[:, -1] - _OFFSETS["ending"]  # the last clause's is set last
    refused = np.array([REFUSALS.search(a) is not None for _, a in rows], dtype=bool)
    whole = np.isin(final, (STOP, LABEL, UNSEEN + 4, UNSEEN + 5))
    clean = np.flatnonzero(~strange & ~refused & whole & (weight(echo) <= 0.3 * total) & (c.lengths > 0))
    seeds = [rows[i][1] for i in np.flatnonzero(refused & (c.lengths <= 3))]
    asked = marks.clauses([""] * len(rows), [q for q, _ in rows])
    block = Block([q for q, _ in rows])
    classes, folded = CLASS(block.codes), FOLD(block.codes)
    langs, _ = _languages(classes, block.row, Words(folded, classes, block.row), len(rows))
    by_lang = {x: [i for i in clean if langs[i] == x] for x in sorted(set(langs[clean].tolist())) if x}
    composed = {x: composed_refusals(_LANGUAGE_OF[x], COMPOSED_REFUSALS, rnd) for x in sorted(_LANGUAGE_OF)}
    made: list[tuple[str, str, int, int]] = []  # question, answer, label before and from a place
    cuts: list[int] = []
    whole_parts: list[int] = []

    def add(q, a, label, head=0, head_label=ANSWER):
        made.append((q, a, label, (head, head_label)))

    for k, i in enumerate(clean.tolist()):
        q, a = rows[i]
        add(q, a, ANSWER)
        if k % 2:  # a short answer
            short = [p for p in _PARTS.split(a) if p and alnum_key(p)]
            add(q if k % 4 == 1 else "", rnd.choice(short), ANSWER)
            whole_parts.append(len(made) - 1)
        if k % 4 == 0:  # an answer to no question
            add("", a, ANSWER)
        kind = k % 6
        if kind == 0 and asked.lengths[i]:
            if k % 12:  # a question of one clause
                q = next((p for p in _PARTS.split(q) if p and len(p) > 8), q)
            add(q, rnd.choice([q, f"Q: {q}", f"问题：{q}", f"{q}\n{q}", q.rstrip("?？.。!！") + ("。" if langs[i] in (HAN, KANA) else "."), q.upper(), "“" + q + "”"]), ECHO)
        elif kind == 1 and asked.lengths[i]:  # the question restated, then answered
            add(q, f"{q}\n{a}", ANSWER, len(q) + 1, ECHO)
        elif kind in (2, 3) and len(a) > 12:
            at = 6 + rnd.randrange(len(a) - 6)
            if a[:at].rstrip()[-1:] not in _TERMINAL:
                cuts.append(len(made))
                add(q, a[:at], ANSWER)
        elif kind == 4 and langs[i]:
            others = [x for x in by_lang if x != langs[i] and not {x, int(langs[i])} <= {_LATIN_ANY, *range(_LATIN_FIRST, _LATIN_ANY)}] + [x for x in by_lang if x != langs[i] and _LATIN_ANY not in (x, langs[i])]
            if others:
                b = rows[rnd.choice(by_lang[rnd.choice(others)])][1]
                add(q, b if k % 12 < 8 else next((p for p in _PARTS.split(b) if p and len(p) > 5), b), FOREIGN)
        elif kind == 5 or not langs[i]:
            pool = composed.get(int(langs[i])) or composed[_LATIN_FIRST]
            add(q, rnd.choice(pool), REFUSAL)
            if k % 12 == 5:
                add(q, rnd.choice(pool) + (" " if langs[i] not in (HAN, KANA, THAI) else "") + rnd.choice(pool), REFUSAL)
    for i in np.flatnonzero(weight(c.odd) > 0).tolist():  # garbled texts are answers
        if not refused[i]:
            add(*rows[i], ANSWER)
    for s in seeds:
        for _ in range(3):
            add("", s, REFUSAL)
    for lang, x in composed.items():  # languages that the sample lacks, too
        for s in x[:60]:
            add(rows[rnd.choice(by_lang[lang])][0] if lang in by_lang else "", s, REFUSAL)
    if not made:
        return c, np.zeros(0, np.int64), 0
    m = marks.clauses([q for q, *_ in made], [a for _, a, *_ in made])
    label = np.array([x for _, _, x, _ in made])
    head, head_label = np.array([h for *_, (h, _) in made]), np.array([y for *_, (_, y) in made])
    labels = np.where(m.start < head[m.row], head_label[m.row], label[m.row])
    lasts = np.cumsum(m.lengths) - 1
    keep = (m.lengths > 0) & (m.lengths <= TRAIN_CLAUSES)
    # A cut just where sentences end elsewhere can't be told from a whole text: neither answers nor unfinished.
    ends = np.zeros(len(made), dtype=np.int64)
    ends[m.row] = m.features[:, -1] - _OFFSETS["ending"]
    for k in cuts:
        if m.lengths[k]:
            labels[lasts[k]] = UNFINISHED
            keep[k] &= ends[k] not in (STOP, LABEL, UNSEEN + 5)
    for k in whole_parts:
        keep[k] &= ends[k] in (STOP, LABEL, UNSEEN + 5)
    return _only(m, keep), labels[keep[m.row]], int(keep.sum())


def _only(c: Clauses, keep: np.ndarray) -> Clauses:
    """The clauses of some of the responses."""
    inside = keep[c.row]
    number, row = np.cumsum(inside) - 1, np.cumsum(keep) - 1
    lex = inside[c.lexical.item]
    lexical = Sparse(number[c.lexical.item[lex]], c.lexical.feat[lex], int(inside.sum()), c.lexical.features, c.lexical.value[lex])
    return Clauses(row[c.row[inside]], c.start[inside], c.letters[inside], c.weight[inside], c.features[inside], lexical, c.odd[inside], c.relation[inside], c.lengths[keep])


def train(rows: list[tuple[str, str]], marks: Marks):
    """(feature weights, transitions, lexical weights) of the field."""
    c, labels, n = _training(rows, marks) if rows else (None, None, 0)
    if not n:
        return np.zeros((FEATURES, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), np.zeros(1 << LEXICAL_BITS)
    k = c.features.shape[1]
    feats = Sparse(np.repeat(np.arange(len(c.features)), k), c.features.reshape(-1), len(c.features), FEATURES)
    # Words that stand in a refusal have weights, learned from refusals and answers; all others have none.
    lex = c.lexical
    active = np.unique(lex.feat[labels[lex.item] == REFUSAL])
    at = np.minimum(np.searchsorted(active, lex.feat), max(len(active) - 1, 0))
    held = active[at] == lex.feat if len(active) else np.zeros(len(lex.feat), dtype=bool)
    words = Sparse(lex.item[held], at[held], lex.items, len(active), lex.value[held])
    free = np.ones((FEATURES, len(LABELS)))
    free[_OFFSETS["echo"] :, REFUSAL] = 0  # neither length nor place nor language makes a refusal, only its words
    w, transitions, x = train_chain(feats, labels, c.lengths, FEATURES, len(LABELS), lexical=(words, REFUSAL), rounds=TRAIN_ROUNDS, free=free)
    table = np.zeros(1 << LEXICAL_BITS, dtype=np.float32)
    table[active] = x
    return w, transitions, table


def tagged(marks: Marks, model, questions: list[str], answers: list[str], shares: list[float] | None):
    """(clauses, label of each, letters by label of each response)."""
    w, transitions, lexical = model
    c = marks.clauses(questions, answers, shares)
    scores = w[c.features].sum(axis=1)
    scores[:, REFUSAL] += c.lexical.scores(lexical)
    labels = viterbi(scores, c.lengths, transitions) if len(scores) else np.zeros(0, np.int64)
    cover = np.bincount(c.row * len(LABELS) + labels, weights=c.weight, minlength=len(answers) * len(LABELS)).reshape(-1, len(LABELS))
    return c, labels, cover / np.maximum(cover.sum(axis=1, keepdims=True), 1)


def defects_of(c: Clauses, labels: np.ndarray, cover: np.ndarray, questions: list[str]) -> list[str | None]:
    """The defect of each response by the coverage of its labels. Mostly garbled responses have none."""
    n = len(questions)
    garbled = np.bincount(c.row, weights=c.letters * c.odd, minlength=n) >= 0.5 * np.maximum(np.bincount(c.row, weights=c.letters, minlength=n), 1)
    final, odd_end = np.full(n, -1), np.zeros(n, dtype=bool)
    final[c.row], odd_end[c.row] = labels, c.odd
    asked = Block(questions)
    asked = np.bincount(asked.row[CLASS(asked.codes) > 0], minlength=n)
    said = np.bincount(c.row, weights=c.letters, minlength=n)
    out: list[str | None] = [None] * n
    for k in np.flatnonzero((cover[:, ANSWER] < 1) & (c.lengths > 0)).tolist():
        s = cover[k]
        if s[ECHO] >= 0.85 and said[k] >= 0.5 * asked[k]:  # a few words that the question has too are no copy of it
            out[k] = "copy"
        elif s[REFUSAL] >= 0.5:
            out[k] = "refusal"
        elif garbled[k]:
            continue
        elif s[FOREIGN] >= 0.5 and not ASKS_OTHER.search(questions[k]):
            out[k] = "other_language"
        elif final[k] == UNFINISHED and not odd_end[k]:
            out[k] = "truncated"
    return out


def pair_defects(pairs: DataFrame) -> DataFrame:
    """Rows (tbl, row_id, field_name, defect, coverage) of the defective responses of pairs
    (tbl, row_id, field_name, question, answer).

    coverage: shares of the response's letters by clause tag. A null, blank or filler answer is ``empty``; an answer
    to a null or empty question can't be a copy or in another language. Null ids are left out, a row delivered twice
    counts once, answers are read whole, an empty table gives no rows."""
    sc = pairs.sparkSession.sparkContext
    rows = pairs.where("row_id IS NOT NULL").select("tbl", "row_id", "field_name", "question", "answer")
    sample = bounded_sample(rows.where("question IS NOT NULL AND answer IS NOT NULL"), ["tbl", "row_id", "field_name"], SAMPLE_ROWS, of=pairs).select("question", "answer").collect()
    # Training cuts the sample's texts anywhere.
    masked = [_masked(t) for r in sample for t in (r.question, r.answer)]
    sampled = np.unique(np.concatenate([np.zeros(0, dtype=np.int64)] + [_ending_keys(x) for t in masked for x in (t, re.sub(r"\s+", "", t)) if len(x) >= ENDING_LENGTH]))
    # Endings are counted exactly, but only those that an answer without a stop (or one cut for training) ends with.
    end = F.right(F.rtrim("answer", F.lit(_TAIL)), F.lit(60))
    is_open = F.coalesce((end != "") & ~F.right(end, F.lit(1)).isin(sorted(_TERMINAL)), F.lit(False))
    tail_key = F.arrow_udf(lambda ends: pa.array([_ending_key(e) for e in ends.to_pylist()], pa.int64()), "long")
    opened = rows.where(is_open).withColumn("key", tail_key(end))
    wanted = np.zeros(1 << FILTER_BITS, dtype=bool)
    # Bounded by the filter.
    wanted[columns_of(opened.where("key IS NOT NULL").select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("slot")).distinct())["slot"]] = True
    wanted[_filter_slots(sampled)] = True
    filters = sc.broadcast((wanted, sampled))
    counted = cut(rows.select("question", "answer").mapInArrow(lambda batches: count_endings(batches, filters.value[0]), "kind string, key long, total long, ended long").groupBy("kind", "key").agg(F.sum("total").alias("total"), F.sum("ended").alias("ended")))
    shares = counted.where("kind = 'e' AND total >= 3").select("key", F.expr("ended / total").alias("share"))

    def of_sample(batches):
        for b in batches:
            yield b.filter(pa.array(np.isin(b.column(0).to_numpy(), filters.value[1])))

    # Bounded by the sample, and by the characters of Unicode.
    own = columns_of(shares.mapInArrow(of_sample, "key long, share double"))
    chars = columns_of(counted.where("kind = 'c'").select("key", "total"))
    least = max(2.0, COMMON_SHARE * float(chars["total"][chars["key"] == 0].sum()))
    rare = np.zeros(0x10000, dtype=bool)
    rare[[int(c) for c, n in zip(chars["key"], chars["total"]) if c and n < least]] = True
    marks = Marks(dict(zip(own["key"].tolist(), own["share"].tolist())), rare)
    model = sc.broadcast((marks, train([(r.question, r.answer) for r in sample], marks)))

    def tag(batches):
        marks, weights = model.value
        for b in batches:
            tbl, ids, fields, qs, answers, ends = batches_of(b, ["tbl", "row_id", "field_name", "question", "answer", "share"])
            qs, answers = [q or "" for q in qs], [a or "" for a in answers]
            out = []
            for lo, hi in chunks([len(q) + len(a) for q, a in zip(qs, answers)]):
                c, labels, cover = tagged(marks, weights, qs[lo:hi], answers[lo:hi], ends[lo:hi])
                letters = np.bincount(c.row, weights=c.letters, minlength=hi - lo)
                for k, defect in enumerate(defects_of(c, labels, cover, qs[lo:hi])):
                    if not letters[k] or letters[k] <= _LONGEST_FILLER and alnum_key(answers[lo + k]) in _FILLER_KEYS:
                        out.append((lo + k, "empty", None))
                    elif defect:
                        out.append((lo + k, defect, cover[k].tolist()))
            at, defects, coverage = zip(*out) if out else ((), (), ())
            at = list(at)
            yield pa.RecordBatch.from_arrays([pa.array([tbl[k] for k in at], pa.string()), pa.array([ids[k] for k in at], pa.int64()), pa.array([fields[k] for k in at], pa.string()), pa.array(list(defects), pa.string()), pa.array(list(coverage), pa.list_(pa.float64()))], ["tbl", "row_id", "field_name", "defect", "coverage"])

    names = ["tbl", "row_id", "field_name", "question", "answer"]
    # Rows with an open end fetch the share of their ending; no group of rows of one ending is gathered (AQE splits it).
    with_share = opened.join(shares, "key", "left").select(*names, F.coalesce("share", F.lit(-1.0)).alias("share"))
    with_share = with_share.unionByName(rows.where(~is_open).select(*names, F.lit(-1.0).alias("share")))
    return with_share.mapInArrow(tag, "tbl string, row_id long, field_name string, defect string, coverage array<double>").dropDuplicates(["tbl", "row_id", "field_name"])
