"""Problem 9: sentence boundaries across languages and scripts.

A pushdown automaton reads a text line by line. One stack holds the open list levels (their indents, marks and last
numbers), which say whether a number that begins a line counts an item; within a line another holds the open
quotations and brackets (only those that are closed again on the line), and states say how an open quotation was
introduced. Full stops are weighed by a trie of abbreviations; every script has its own terminators; Thai, which has
none, is cut at the spaces between clauses.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batches_of

# Quotation marks and brackets, by opening mark.
PAIRS = {"“": "”", "‘": "’", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "{": "}", "〔": "〕"}
QUOTES = set("“‘„«‹「『")
CLOSING = set("”’»›」』》〉)）]］】}〕\"'“")
# Sentence terminators besides the full stop of Latin, Cyrillic and Arabic text.
TERMINATORS = set("。！？!?।॥؟۔．｡…‼⁇⁈⁉")

# Abbreviations that are followed by more of the sentence.
INNER = """
mr mrs ms dr prof st. no nos fig figs sect sec ch vol pp p approx vs e.g i.e cf attn ref resp est ca al
herr fr hr nr abb bzw z.b z d.h d u.a vgl evtl ggf inkl max min tab kap bd
m mme mlle p.ex ex env c.-à-d art chap éd tél av bd pl réf
sr sra srta dra aprox p.ej ej dpto fig núm pág véase tel av avda ud uds
т.е т рис нед чел ул д кв г стр см табл им проф акад пр корп обл р тел ср напр руб тыс млн
डॉ मि.ग्रा मि.ली कि.ग्रा से.मी मि श्री सं
د ص ط أ م
""".split()
# Abbreviations that may also end a sentence; a capital letter after them begins a new one.
EITHER = """
a.m p.m etc inc ltd jr sr co ave st rd apt usw u.s.w др т.д т.п пр гг вв ср e.t.c мин сек ч мг мл см
""".split()
# Months that follow an ordinal number with a full stop.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()


def _trie(words: list[str], kind: str, root: dict) -> dict:
    """Words spelled backwards, from the full stop to the left."""
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node.setdefault("", kind)
    return root


_ABBREVIATIONS = _trie(INNER, "inner", _trie(EITHER, "either", {}))
_EVENT = re.compile("[" + re.escape("".join(set(PAIRS) | CLOSING | TERMINATORS | {"."}) ) + "]|(?<=[฀-๿])[  　\t]+(?=[฀-๿])")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_MARKER = re.compile(r"[\s　]*(?:[-*•·]\s*|[(（]?\s*(?:\d{1,4}|[A-Za-z]|[ivxIVX]{1,5}|[一二三四五六七八九十]{1,3})\s*(?:[.)）、．](?!\d))\s*|[①-⑳]\s*)+")
_NUMBER = re.compile(r"\d+")
#: Numbers that a list may leave out and go on.
SKIPPED = 50
_WIDE = re.compile("[⺀-鿿豈-﫿＀-￯　-〿]")
_BLANK = " \t 　     ​﻿"
#: Thai words that go on with the clause after a space.
_THAI_CONTINUES = re.compile("(?:และ|หรือ|แต่|เพราะ|โดย|ซึ่ง|ที่|จึง|ว่า|ๆ|ฯ)")
_MAIL = re.compile(r"[\w.+-]*[@＠]")
_COLON = set(":：﹕")


def _matched(line: str, events: list[tuple[int, str]]) -> dict[int, int]:
    """Opening position to closing position of the quotations and brackets that the line closes again."""
    stack: list[tuple[int, str]] = []
    pairs: dict[int, int] = {}
    straight = -1
    for i, c in events:
        if c == '"':
            if straight < 0:
                straight = i
            else:
                pairs[straight] = i
                stack = [s for s in stack if s[0] < straight]
                straight = -1
        elif stack and c in PAIRS[stack[-1][1]] and not (c == "’" and line[i + 1 : i + 2].isalpha()):
            pairs[stack.pop()[0]] = i
        elif c in PAIRS:
            stack.append((i, c))
        elif c in CLOSING and c not in "'’“":
            for k in range(len(stack) - 1, -1, -1):  # marks left open inside are dropped
                if c in PAIRS[stack[k][1]]:
                    pairs[stack[k][0]] = i
                    del stack[k:]
                    break
    return pairs


class Levels:
    """The open list levels of a text, outermost first: (indent, form of the mark, last number or None)."""

    def __init__(self):
        self.stack: list[tuple[int, str, int | None]] = []

    def body(self, line: str) -> int:
        """Where the words of the line begin: behind its list marks, or at 0. Opens, continues and closes levels.

        A mark of up to two digits, letters or signs always counts; a longer number (it may be a year) only where it goes
        on with an open level's numbers."""
        indent = len(line) - len(line.lstrip(" \t　"))
        marker = _MARKER.match(line)
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        if not marker or marker.end() >= len(line) or not marker[0].strip():
            return 0
        mark = marker[0].strip()
        digits = _NUMBER.search(mark)
        number = int(digits[0]) if digits else None
        form = mark if number is None else "number"  # whatever its brackets and stops, a list goes on
        here = next((x for x in reversed(self.stack) if x[1] == form), None)
        if number is not None and len(digits[0]) > 2 and (here is None or here[2] is None or not here[2] < number <= here[2] + SKIPPED + 1):
            return 0
        while self.stack and self.stack[-1][0] >= indent and self.stack[-1][1] != form:
            self.stack.pop()
        if self.stack and self.stack[-1][:2] == (indent, form):
            self.stack.pop()
        self.stack.append((indent, form, number))
        return marker.end()


def _abbreviation(line: str, i: int, start: int) -> str | None:
    """'inner' or 'either' if a known abbreviation ends at the full stop at i; also initials of names."""
    node, k, found = _ABBREVIATIONS, i - 1, None
    while k >= start:
        c = line[k].lower()
        if c in _BLANK and k > start and line[k - 1] == "." and "." in node:  # "z. B." as "z.b."
            k -= 1
            continue
        node = node.get(c)
        if node is None:
            break
        if "" in node and (k == start or not (line[k - 1].isalnum() or line[k - 1] in "-'’")):
            found = node[""]
        k -= 1
    if found is None and i > start and line[i - 1].isupper() and line[i - 1].isalpha() and not _WIDE.match(line[i - 1]) and (i - 1 == start or (line[i - 2] in _BLANK and not line[i - 3 : i - 2].isdigit()) or line[i - 2] in ".(“«„\""):
        return "inner"
    return found


def _stop_ends(line: str, i: int, start: int) -> bool:
    """Whether the full stop at i ends the sentence that begins at start."""
    n = len(line)
    if i + 1 >= n:
        return True
    nxt = line[i + 1]
    prev = line[i - 1] if i > start else ""
    if nxt == "." or (nxt.isdigit() and (prev.isdigit() or prev == "" or prev.isalpha() and not _WIDE.match(prev))):
        return False
    if nxt not in _BLANK and _MAIL.match(line, i + 1):
        return False
    if prev and "ऀ" <= prev <= "ॿ" and nxt not in _BLANK:
        return False
    kind = _abbreviation(line, i, start)
    if kind == "inner":
        return False
    if _WIDE.match(nxt) and nxt not in "，、；：,)）":
        return True
    if prev and _WIDE.match(prev):
        return nxt not in "，、；："
    j = i + 1
    while j < n and (line[j] in CLOSING and line[j] not in "“'" or line[j] in _BLANK):
        j += 1
    if j >= n:
        return True
    after = line[j]
    if j == i + 1:  # nothing between: a host, a version, or a missing space
        if after.isupper() and line[j + 1 : j + 2].isupper() and prev.isupper() and line[i - 2 : i - 1].isupper():
            return True
        return (after.isupper() and prev.islower() and (j + 1 < n and (line[j + 1].islower() or line[j + 1] in _BLANK))) or after in "¿¡“„«" and prev.isalnum() or (after.isupper() and (prev.isdigit() or not prev.isalnum() or prev.isupper()) and prev != "." and j + 1 < n and line[j + 1].islower())
    if prev == "." and after.islower():
        return False
    if prev.isdigit():
        m = re.compile(r"[^\W\d_]+").match(line, j)
        word = re.compile(r"(?:^|[^\d.,])(\d{1,2})$").search(line, max(start, i - 4), i)
        if m and word and m[0].lower() in MONTHS:
            return False
    if kind == "either" or line[max(start, i - 3) : i].lower() == "str":
        return after.isupper() or after in QUOTES or after in "¿¡"
    return not (after.islower() or after in ",;:，；、")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points; blank stretches belong to none."""
    out: list[tuple[int, int]] = []

    def emit(a: int, z: int) -> None:
        while a < z and (text[a].isspace() or text[a] in "​﻿"):
            a += 1
        while z > a and (text[z - 1].isspace() or text[z - 1] in "​﻿"):
            z -= 1
        if z > a:
            out.append((a, z))

    levels = Levels()
    for m in _LINE.finditer(text):
        base, line = m.start(), m[0]
        events = [(e.start(), e[0]) for e in _EVENT.finditer(line)]
        pairs = _matched(line, [e for e in events if e[1] in PAIRS or e[1] in CLOSING])
        body = levels.body(line)
        begin, first, skip = 0, body, body  # begin of the sentence, of its words, and where reading goes on
        for i, c in events:
            if i < skip:
                continue
            if i in pairs:
                close = pairs[i]
                skip = close + 1
                if c in QUOTES or c == '"':
                    end = _quotation_ends(line, i, close, first)
                    if end:
                        emit(base + begin, base + end)
                        begin = first = skip = end
                continue
            if c == ".":
                if not _stop_ends(line, i, first):
                    continue
            elif c[0] in _BLANK:
                if i <= first or _THAI_CONTINUES.match(line, i + len(c)):
                    continue
            elif c in TERMINATORS:
                if c == "…" and not _WIDE.match(line[i + 1 : i + 2] or "。") and not (line[i + 1 :].lstrip()[:1] or "A").isupper():
                    continue
                if c == "…" and line[i + 1 : i + 2] not in ("", "”", "」") and not line[i - 1 : i] in TERMINATORS:
                    continue
            else:
                continue
            end = i + len(c) if c[0] not in _BLANK else i
            while end < len(line) and (line[end] in TERMINATORS or line[end] in CLOSING and line[end] not in "“'" and end not in pairs or line[end] == "." and not line[end + 1 : end + 2].isdigit()):
                end += 1
            if line[end : end + 1] and line[end] in "，、；,;":
                continue
            emit(base + begin, base + end)
            begin = first = skip = end
        emit(base + begin, base + len(line))
    return out


def _quotation_ends(line: str, i: int, close: int, first: int) -> int:
    """Position after the sentence if a quotation that closes at ``close`` ends it, else 0."""
    inside = line[i + 1 : close].rstrip(_BLANK)
    k = i - 1
    while k >= first and line[k] in _BLANK:
        k -= 1
    introduced = k >= first and line[k] in _COLON
    j = close + 1
    while j < len(line) and line[j] in _BLANK:
        j += 1
    if not inside or inside[-1] not in TERMINATORS and inside[-1] != ".":
        return 0
    if j >= len(line):
        return 0
    after = line[j]
    if after in "，、；,;—–-" or after in TERMINATORS or after == "." or after.islower():
        return 0
    if introduced:
        return close + 1
    if k < first:  # the quotation comes first: what follows attributes it, unless it begins with a capital letter
        return close + 1 if after.isupper() and j > close + 1 else 0
    return close + 1 if after.isupper() and j > close + 1 else 0


def split_sentences(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, start_at, end_at) of texts (doc_id, text): 0-based code points, end after the last character.

    Null ids, null, empty and blank texts have no sentences; a row delivered twice counts once; a text is read whole
    and line by line, so its length doesn't matter; an empty table gives none."""

    def split(batches):
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(*batches_of(b, ["doc_id", "text"])):
                for a, z in sentences(t):
                    ids.append(i)
                    starts.append(a)
                    ends.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], ["doc_id", "start_at", "end_at"])

    return texts.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(split, "doc_id long, start_at long, end_at long")
