"""Script and language of short texts, by letters and by function words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Function words of the languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the of is and to in for with was than at on when should a by are has from it then does why again this that have not can be or my your what how after before if no you we they which but will would could i'm there",
    "de": "der die das und ist bei wird nach für gilt als den oft zu ein eine nicht am wie warum vor ich fast allen vom lag dem des im mit auf von sich auch kann soll sind war haben wenn oder aber noch nur mein meine einen einer eines",
    "fr": "le la les et est de du des une un à être pas en au il que ne par sur chez pourquoi après contre ou dans pour avec aux ce cette qui se son sa ses mais plus sont faut peut je mon ma mes depuis avant",
    "es": "el la los las de en para con se por qué no una del y al si que conviene aparece debe hace un es su sus lo como más pero o son está tiene desde mi cuando antes sin sobre hay puede",
}
WORD_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _word in _list.split():
        WORD_LANGUAGES[_word] = (*WORD_LANGUAGES.get(_word, ()), _lang)

# Requests for an answer in a named language, or for a translation.
ASKS_OTHER = re.compile(
    r"(?i)翻译|译成|译为|用(?:英|德|法|日|俄|中|西班牙|阿拉伯|泰|印地)[文语]|translat|(?:answer|reply|respond|write|say)[^.!?]{0,30} in (?:english|german|french|spanish|chinese|russian|japanese|thai|hindi|arabic)|"
    r"übersetz|auf (?:deutsch|englisch|französisch|spanisch|chinesisch|russisch)|tradui|en (?:anglais|allemand|français|espagnol|chinois)|traduc|traduz|en (?:inglés|alemán|francés|español|chino)|перевед|перевод|по-(?:английски|немецки|французски|русски)|на (?:английск|немецк|французск|русск)|翻訳|訳して|(?:英|独|仏|中国|日本)語(?:で|に)|अनुवाद|แปล|ترجم"
)


_LETTERS = {"ja": re.compile("[ぁ-ヿ]"), "zh": re.compile("[㐀-鿿]"), "ko": re.compile("[가-힣]"), "ru": re.compile("[Ѐ-ӿ]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]"), "ar": re.compile("[؀-ۿ]")}
_FULL = re.compile("[Ａ-Ｚａ-ｚ]")
_WORD = re.compile(r"[^\W\d_]+(?:’[^\W\d_]+)?")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def scripts(text: str) -> dict[str, float]:
    """Letters by script; those of the Latin alphabet, which say less each, at 0.4."""
    n: dict[str, float] = {}
    if not text.isascii():
        for lang, letters in _LETTERS.items():
            if letters.search(text):
                n[lang] = len(letters.findall(text))
        if _FULL.search(text):
            text = unicodedata.normalize("NFKC", text)
    if latin := len(_LATIN.findall(text)):
        n["latin"] = 0.4 * latin
    return n


def language(text: str, n: dict[str, float] | None = None) -> str:
    """Language of most of the letters; '' if it can't be told."""
    n = dict(scripts(text) if n is None else n)
    if not n:
        return ""
    if "ja" in n and n["ja"] * 4 > n.get("zh", 0):
        n["ja"] += n.pop("zh", 0)
    top = max(n, key=lambda k: (n[k], k))
    if top != "latin":
        return top
    if not text.isascii() and _FULL.search(text):
        text = unicodedata.normalize("NFKC", text)
    votes: Counter = Counter()
    for w in _WORD.findall(text.lower()):
        if w in WORD_LANGUAGES:
            votes.update(WORD_LANGUAGES[w])
    if not votes:
        return ""
    (best, k), *rest = votes.most_common(2)
    return best if not rest or rest[0][1] < k else ""
