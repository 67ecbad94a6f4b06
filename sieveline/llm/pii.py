"""Problem 4: personal information in free text.

A skip-chain conditional random field labels tokens (none, e-mail, telephone number, identity number, address, name).
Its tokens are those of the passages around every place that has the shape of a mention; neighbours in a passage are
chained by transitions, and distant tokens of a text that are equal or similar share a potential that wants equal
labels. Loopy belief propagation passes messages over both until they agree. A place is a mention if its tokens' marginals
say so. The field is trained here by the likelihood of a bounded sample's texts: places whose context leaves no doubt
are observed, all others are summed over.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codes import chunks
from .crf import FeatureIndex, Sparse
from .shared import batches_of, bounded_sample, code_points

#: Rows (those of lowest hash) on which the field is trained, steps of training, and rounds of messages in a step.
SAMPLE_ROWS, STEPS, STEP_ROUNDS = 4000, 50, 3
#: Rounds of loopy belief propagation when labelling, and damping of its messages.
ROUNDS, DAMPING = 14, 0.2
#: Mean marginal probability from which a place is a mention.
ACCEPT = 0.5
#: Tokens of context on either side of a place.
CONTEXT = 4

KINDS = ["", "email", "phone", "id_number", "address", "person_name"]
_LABEL = {k: i for i, k in enumerate(KINDS)}
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

#: Where training starts and what it is drawn to: weights of a place's features for its kind against none.
PRIOR = {"place": 2.5, "against": -8.0, "unchecked": -1.5, "no-cue": -0.7, "cue": 1.5, "behind": 1.0, "name-no-cue": -4.5, "common": -4.0, "institution": -3.0, "part": 2.0, "repeat": 1.0}
#: Weight of a context token for none, of equal neighbouring labels, and of the same kind at linked tokens.
PRIOR_CONTEXT, PRIOR_SAME, PRIOR_LINK = 3.0, 0.5, 5.0

# One character for one, so that offsets hold: full-width forms, blanks and dashes.
_PLAIN = {0xFF01 + k: 0x21 + k for k in range(94)} | dict.fromkeys(map(ord, "\xa0　    \t"), " ") | dict.fromkeys(map(ord, "‐‑‒–—−"), "-")

_B, _E = r"(?<![0-9A-Za-z.\-])", r"(?![0-9A-Za-z]|[-.]\d)"
_AT, _DOT = r"(?:\s?@\s?|\s?[\[(（]\s?at\s?[\])）]\s?)", r"(?:\.|\s?[\[(（]\s?dot\s?[\])）]\s?)"
_CN_DIGIT = "一二三四五六七八九〇零"
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_TITLE = r"(?!(?:Mme|Mlle|Frau|Herrn?|Mrs?|Ms|Miss|Dr|Prof|Sra?|Dra|Please)\b)"
_N = rf"{_TITLE}[{_UP}][{_LOW}]+(?:[-’'][{_UP}][{_LOW}]+)*"
_NAME = rf"{_N}(?:, {_N}(?: [{_UP}]\.)?|(?: [{_UP}]\.){{0,2}} {_N}(?: {_N})?)"
_RU = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_HAN = "[一-鿿]"

# Kinds of streets and settlements in the shape of addresses.
_EN_STREET = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Hill|Row|Close|Drive|Dr|Way|Place|Square|Terrace|Crescent|Gardens|Mews|Walk|Boulevard|Blvd"
_FR_STREET = "rue|avenue|boulevard|allée|place|chemin|impasse|quai|cours|route|square"
_ES_STREET = "Calle|Avenida|Avda\\.|Plaza|Paseo|Camino|Ronda|Travesía|C/"
_DE_STREET = "str\\.|straße|strasse|weg|gasse|platz|allee|ufer|ring|damm"
_RU_STREET = "ул\\.|улица|просп\\.|пр\\.|проспект|пер\\.|переулок|наб\\.|бульвар|шоссе"
_CN_STREET = "路|街|巷|大道|胡同|村|弄|里弄|新村|小区"

SHAPES: list[tuple[str, str, str]] = [
    ("email", "mail", rf"{_B}[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9-]*[A-Za-z]{{2,}})+"),
    ("id_number", "id-cn", rf"{_B}[1-9]\d{{5}}([- ]?)(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\1\d{{3}}[\dXx]{_E}"),
    ("id_number", "id-us", rf"{_B}\d{{3}}([- ])\d{{2}}\1\d{{4}}{_E}"),
    ("id_number", "id-uk", rf"{_B}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D](?![0-9A-Za-z])"),
    ("phone", "cn-mobile", rf"{_B}(?:(?:\+|00)86[- ]?)?1[3-9]\d([- ]?)\d{{4}}\1\d{{4}}{_E}"),
    ("phone", "cn-spelled", rf"(?<![{_CN_DIGIT}])[一][{_CN_DIGIT}]{{10}}(?![{_CN_DIGIT}])"),
    ("phone", "cn-line", rf"{_B}(?:\(0\d{{2,3}}\) ?|0\d{{2,3}}[- ])\d{{7,8}}{_E}"),
    ("phone", "us", rf"{_B}(?:\+1[ -]?)?(?:\(\d{{3}}\) ?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}{_E}"),
    ("phone", "uk", rf"{_B}(?:\+44 ?(?:\(0\) ?)?7\d{{3}}|07\d{{3}})[ -]?\d{{3}}[ -]?\d{{3}}{_E}"),
    ("phone", "de", rf"{_B}(?:\+49 ?(?:\(0\) ?)?\d{{2,4}}|0\d{{2,4}})[ /-]\d{{4,8}}(?:[ -]\d{{1,4}})?{_E}"),
    ("phone", "fr", rf"{_B}(?:\+33 ?(?:\(0\) ?)?\d|0\d)(?:[ .-]?\d{{2}}){{4}}{_E}"),
    ("phone", "plus", rf"{_B}\+\d{{1,3}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,6}}{_E}"),
    ("phone", "spaced", rf"{_B}1(?:[ -]\d){{10}}{_E}"),
    ("address", "cn-street", rf"(?:{_HAN}{{2,3}}(?:省|自治区))?(?:{_HAN}{{2,3}}[市州])?(?:{_HAN}{{2,3}}[区县旗])?(?:{_HAN}{{2,3}}[镇乡])?{_HAN}{{2,4}}(?:{_CN_STREET})\d{{1,4}}[号弄组巷栋](?:之\d+)?(?:\d{{1,4}}[号栋幢座组单元室楼层]+)*"),
    ("address", "ja-block", rf"{_HAN}{{2,4}}?[都道府県]{_HAN}{{1,4}}?[市区郡町村][一-鿿ぁ-ヶ]{{1,8}}\d{{1,3}}丁目\d{{1,4}}(?:[-番]\d{{1,4}})*号?"),
    ("address", "en-street", rf"(?<![0-9A-Za-z])(?:(?:Flat|Apt\.?|Unit|Suite) \d{{1,4}}[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{_EN_STREET})\b\.?(?:, (?:Apt\.?|Flat|Unit|Suite|No\.) ?\d{{1,4}}[A-Za-z]?)?(?:, [A-Z][a-z]+(?:[ -][A-Z][a-z]+)*)?"),
    ("address", "fr-street", rf"(?<![0-9A-Za-z])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:{_FR_STREET}) [^,\n\d]{{2,40}}, \d{{5}} {_N}"),
    ("address", "de-street", rf"(?<![0-9A-Za-z{_UP}{_LOW}])[{_UP}][{_UP}{_LOW}-]*(?:{_DE_STREET}) \d{{1,4}}(?: ?[a-z]\b)?, \d{{5}} [{_UP}][{_LOW}]+"),
    ("address", "es-street", rf"(?<![0-9A-Za-z])(?:{_ES_STREET}) [^,\n\d]{{2,40}} \d{{1,4}}(?:, \d{{1,3}}\.?[ºª°]? ?[A-Z]?)?, [{_UP}][{_LOW}]+(?: (?:de |del )?[{_UP}][{_LOW}]+)*"),
    ("address", "ru-street", rf"(?:{_RU_STREET}) {_RU}(?: {_RU})?, д\. ?\d{{1,4}}[а-я]?(?:, (?:корп|стр)\. ?\d+)?(?:, кв\. ?\d{{1,4}})?"),
    ("person_name", "latin-name", rf"(?<![0-9A-Za-z{_UP}{_LOW}]){_NAME}(?![{_UP}{_LOW}])"),
    ("person_name", "ru-name", rf"(?<![А-Яа-яЁё]){_RU} {_RU}(?:ич|вна)?(?![А-Яа-яЁё])"),
    ("person_name", "zh-name", rf"家属(?P<m>{_HAN}{{2,4}}?)(?=留下|提供|来|签|[，。,.])"),
    ("person_name", "zh-name", rf"患者(?P<m>{_HAN}{{2,4}}?)(?=自述|自诉|主诉|来院|反映|[，,]?住)"),
    ("person_name", "zh-name", rf"(?:医师|大夫|医生)(?P<m>{_HAN}{{2,4}}?)(?=建议|认为|表示|签|[，。,.])"),
    ("person_name", "zh-name", rf"(?:联系人(?:为|是|:)|收件人|转给|我叫|名叫|姓名:?|署名)(?P<m>{_HAN}{{2,4}}?)(?=看看|看|吧|[^一-鿿]|$)"),
    ("person_name", "zh-name", rf"[\dXx]\((?P<m>{_HAN}{{2,4}})(?=\))"),
    ("person_name", "zh-name", rf"[，。、:；](?P<m>{_HAN}{{2,4}})(?=先生|女士|小姐)"),
    ("person_name", "ja-name", r"(?:患者|担当の|医師|看護師|主治医の|氏名は)(?P<m>[一-鿿][一-鿿ヶ々]{0,3}(?: [一-鿿ぁ-ヶ]{1,4})?)(?=は夜間|は|が|まで|に|さん|様|氏|、|。)"),
]
_SHAPES = [(kind, name, re.compile(shape)) for kind, name, shape in SHAPES]

# Words before a mention that speak for its kind, and words that speak against any.
CUES = {
    "email": r"(?i)信至|发到|邮箱|邮件|质问|質問は|write to|e-?mail|reached|at |from|Rückfragen|Écrivez|Escriba|присылайте|пишите",
    "phone": r"(?i)\bring |电话|号码|手机|打|致电|联系|お電話|電話|call|phone|reached on|tel|unter|joindre|llame|al |звоните|номеру|number is",
    "id_number": r"(?i)证件号|身份证|身份核验|证号|number is|file is|lautet|registrado|noté est|versichertennummer|numéro|número|номер|番号|identity|\bid\b|passport",
    "address": r"寄到|住址|地址|住在|送到|家住|検査結果は|住所|送付|lives at|report goes to|address|geht an|wohnt|envoyé au|habite|enviará a|vive en|domicilio|адресу|проживает",
    "person_name": r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Dra|M|Mme|Mlle|Frau|Herr|Herrn)\.?\s$|attn\.?:?\s$|ask for\s$|[Mm]y name is\s$|where is\s$|спросите, где\s$|(?:доктор|врач|пациент|пациентка|г-жа|г-н)\s$|家属$|患者$|医师$|医生$|大夫$|联系人(?:为|是|:)?$|收件人$|转给$|我叫$|名叫$|姓名$|[\dXx]\($|担当の$|医師$|看護師$|主治医の$",
}
_CUES = {k: re.compile(v) for k, v in CUES.items()}
_AFTER = {"person_name": re.compile(r"^\s?(?:lives|signed|留下|自述|自诉|建议|看看|先生|女士|\)|まで|は夜間|さん|様|氏|au \+?\d|unter \+?\d|al \+?[\d(]|and my number)"), "phone": re.compile(r"^(?:找我|和邮箱|dès|mañana|an\b|and ask|, спросите|\s?\)|。)")}
_AGAINST = re.compile(r"(?i)(?:批号|批准文号(?:末段)?|编号|序列号|订单号|单号|型号|流水号|登记号|注册号|文号末段|lot|serial|form|batch|model|order|device|ref|no|version|charge|gerät|lote|серия|партия|ロット|製造番号)[.:：#]?\s?(?:[\d-]*)$")
# Capitalised words that aren't names: signs, institutions, openings of sentences, ordinary nouns.
_NOT_NAME = re.compile(
    r"\b(?:The|This|That|When|Why|Does|Doses|See|Fig|Sect|Notes|Living|Check|Ward|Moreover|Readers|Anyone|Changes|Some|Someone|Please|Copies|You|Your|Start|Then|Keep|Do|In|On|Of|For|If|It|As|And|My|No|Yes|Clinic|Hospital|Institute|University|Centre|Center|Road|Street|Lane|Court|Row|Hill|Ave|Apt|Flat|Lot|Serial|Form|Bei|Bitte|Laut|Warum|Steigt|Für|Danach|Die|Der|Das|Am|Mai|Abb|Fall|Nach|Im|Le|La|Les|Si|Sur|Chez|Pourquoi|Nous|Commencez|Veuillez|Un|Une|Une|L|El|En|Para|Por|Luego|Primero|Llame|Calle|Dpto|Mrs|Mr|Ms|Dr|Mme|Sra|Sr|Frau|Herr)\b"
)


@dataclass
class Place:
    """A stretch of a text that has the shape of a mention."""

    start: int
    end: int
    kind: str
    shape: str
    features: list[str]
    sure: int | None = None  # 1 or 0 where the context leaves no doubt
    p: float = 0.0


_INSTITUTION = re.compile(r"\s?(?:Clinic|Hospital|Institute|University|Centre|Center|Foundation|Trust|College|School|sign|test|syndrome|disease|Klinik|Zeichen|signe|signo|hospital|clínica|clinique|симптом|больниц|医院|诊所|征)")


def _id_check(digits: str) -> bool:
    """Check digit of an eighteen-character identity number (ISO 7064 MOD 11-2)."""
    return "10X98765432"[sum(int(d) * 2 ** (17 - k) for k, d in enumerate(digits[:17])) % 11] == digits[17].upper()


# What every text of a shape holds, derived from the shape: digits at least, and one of the literals.
_DIGITS_OF = {
    "id-cn": 17, "id-us": 9, "id-uk": 6, "cn-mobile": 11, "cn-line": 10, "us": 10, "uk": 11, "de": 7, "fr": 10, "plus": 3, "spaced": 11,
    "cn-street": 1, "ja-block": 2, "en-street": 1, "fr-street": 6, "de-street": 6, "es-street": 1, "ru-street": 1,
}
_LITERALS_OF = {"mail": ("@", "at"), "plus": ("+",), "cn-street": tuple("路街巷道同村弄区"), "ja-block": ("丁目",), "ru-street": ("д.",)}
_DIGIT = re.compile(r"\d")


_CN_LEAD = re.compile("(?:请)?(?:寄到|送到|寄往|送往|住址为|住址是|住址|地址为|地址是|地址|家住|住在|位于|现住|搬到|来自|送至|寄至)$")


def _cn_start(plain: str, a: int, z: int) -> int:
    """First character of a Chinese address: after the last leading verb that the shape has swallowed."""
    for k in range(min(z, a + 8), max(-1, a - 1), -1):
        if _CN_LEAD.search(plain[max(0, k - 5) : k]):
            return k
    return a


_PLAIN_CODES = np.arange(0x10000, dtype=np.uint32)
_PLAIN_CODES[list(_PLAIN)] = [c if isinstance(c, int) else ord(c) for c in _PLAIN.values()]


def plain_texts(texts: list[str]) -> list[str]:
    """The texts with full-width forms, blanks and dashes made plain, character by character."""
    out = []
    for lo, hi in chunks(list(map(len, texts))):
        codes = code_points("".join(texts[lo:hi]))
        whole = np.where(codes > 0xFFFF, codes, _PLAIN_CODES[np.minimum(codes, 0xFFFF)]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        at = 0
        for t in texts[lo:hi]:
            out.append(whole[at : at + len(t)])
            at += len(t)
    return out


def propose(plain: str) -> list[Place]:
    """Every place of a plain text, in order."""
    digits = len(_DIGIT.findall(plain))
    out: list[Place] = []
    for kind, shape, pattern in _SHAPES:
        if digits < _DIGITS_OF.get(shape, 0) or (shape in _LITERALS_OF and not any(map(plain.__contains__, _LITERALS_OF[shape]))):
            continue
        for m in pattern.finditer(plain):
            a, z = m.span("m" if "m" in pattern.groupindex else 0)
            if shape == "cn-street":
                a = _cn_start(plain, a, z)
            before, after = plain[max(0, a - 24) : a], plain[z : z + 16]
            cue = _CUES[kind].search(before[-6:] if shape == "cn-street" else before) is not None
            behind = kind in _AFTER and _AFTER[kind].match(after) is not None
            against = _AGAINST.search(before) is not None
            names = ["place", f"shape-{shape}"]
            if kind == "person_name":
                names.append("name-cue" if cue or behind else "name-no-cue")
                common = shape == "latin-name" and _NOT_NAME.search(plain[a:z]) is not None
                if common:
                    names.append("common")
                if _INSTITUTION.match(after):
                    names.append("institution")
            else:
                names.append("cue" if cue else "no-cue")
                common = False
            if cue:
                names.append(f"{kind}-cue")
            if behind:
                names += ["behind", f"{kind}-behind"]
            if against:
                names.append("against")
            if shape == "id-cn":
                names.append("checked" if _id_check(re.sub(r"[- ]", "", m[0])) else "unchecked")
            if against or common:
                sure = 0
            elif kind == "person_name":
                sure = 1 if (cue or behind) and "institution" not in names else None
            else:
                sure = 1 if cue and (behind or kind != "phone") else None
            out.append(Place(a, z, kind, shape, names, sure))
    if out:
        _again(plain, out)
        out.sort(key=lambda x: (x.start, -x.end))
    return out


def _again(plain: str, out: list[Place]) -> None:
    """Adds the other places where a cued name stands, whole or in part."""
    named = [x for x in out if x.kind == "person_name" and "name-cue" in x.features]
    wanted = {plain[x.start : x.end]: "repeat" for x in named if x.end - x.start > 1}
    for x in named:
        if plain[x.start].isalpha() and not _WIDE.match(plain[x.start]):
            for part in _WORD.findall(plain[x.start : x.end]):
                if len(part) > 2:
                    wanted.setdefault(part, "part")
    if not wanted:
        return
    taken = sorted((x.start, x.end) for x in out)
    starts = [a for a, _ in taken]
    reach = list(np.maximum.accumulate([z for _, z in taken]))
    new: list[tuple[int, int, str]] = []
    pattern = re.compile("|".join(map(re.escape, sorted(wanted, key=len, reverse=True))))
    for m in pattern.finditer(plain):
        a, z = m.span()
        if not _WIDE.match(plain[a]) and (plain[a - 1 : a].isalnum() or plain[z : z + 1].isalnum()):
            continue
        k = bisect_left(starts, z)  # places that begin before the end; the farthest that one of them reaches
        if k and reach[k - 1] > a:
            continue
        new.append((a, z, wanted[m[0]]))
    for a, z, how in new:
        names = ["place", "name-no-cue", how]
        if _INSTITUTION.match(plain[z : z + 16]):
            names.append("institution")
        out.append(Place(a, z, "person_name", how, names))


_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[⺀-鿿぀-ヿ가-힣]")
_TOKEN = re.compile(r"[⺀-鿿぀-ヿ가-힣]|[^\W\d_⺀-鿿぀-ヿ가-힣]+|\d+|[^\w\s]|_")


def _class_of(token: str) -> str:
    if token[0].isdigit():
        return f"digits{min(len(token), 12)}"
    if token.isalpha():
        return "han" if _WIDE.match(token) else "upper" if token.isupper() and len(token) > 1 else "capital" if token[0].isupper() else "lower"
    return "mark"


@dataclass
class Passages:
    """The tokens of several texts' passages: a graph for the field."""

    features: list[list[str]] = field(default_factory=list)
    allowed: list[tuple[int, ...]] = field(default_factory=list)  # labels that training allows; () is any
    chain: list[tuple[int, int]] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)
    places: list[list[tuple[Place, range]]] = field(default_factory=list)  # of each text, with their tokens

    def add(self, plain: str) -> None:
        places = propose(plain)
        self.places.append([])
        if not places:
            return
        # Passages: places and their context, joined where they meet.
        spans: list[list[int]] = []
        for x in places:
            a, z = max(0, x.start - 24), min(len(plain), x.end + 24)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        k = 0
        same = defaultdict(list)
        for a, z in spans:
            tokens = [(a + m.start(), a + m.end(), m[0]) for m in _TOKEN.finditer(plain[a:z])]
            mine = []
            while k < len(places) and places[k].start < z:
                mine.append(places[k])
                k += 1
            starts = [t[0] for t in tokens]
            held: list[list[Place]] = [[] for _ in tokens]
            near = np.zeros(len(tokens) + 1, dtype=bool)
            ranges = []
            for x in mine:
                lo, hi = bisect_left(starts, x.start), bisect_left(starts, x.end)
                ranges.append((lo, hi))
                x.features += [f"word-before-{tokens[lo - 1][2].lower()}" if lo else "word-before", f"word-after-{tokens[hi][2].lower()}" if hi < len(tokens) else "word-after"]
                near[max(0, lo - CONTEXT) : hi + CONTEXT] = True
                for t in range(lo, hi):
                    held[t].append(x)
            number, last = {}, None
            for t, (_, _, word) in enumerate(tokens):
                if not near[t]:
                    last = None
                    continue
                node = number[t] = len(self.features)
                cls = _class_of(word)
                low = word.lower()
                names = [f"{'in' if held[t] else 'by'}-{cls}"]
                allowed: tuple[int, ...] = (0,)
                if held[t]:
                    kinds = {_LABEL[x.kind] for x in held[t]}
                    sures = {(_LABEL[x.kind], x.sure) for x in held[t]}
                    for x in held[t]:
                        names += [f"{n}|{x.kind}" for n in x.features]
                    if any(v == 1 for _, v in sures):
                        allowed = tuple({k2 for k2, v in sures if v == 1})
                    elif all(v == 0 for _, v in sures):
                        allowed = (0,)
                    else:
                        allowed = (0, *kinds)
                    if len(low) > 1 and cls in ("capital", "upper") or len(low) > 5 and cls.startswith("digits"):
                        same[low[:5] if len(low) > 5 and cls != "digits" else low].append(node)
                else:
                    names += ["context", f"word-{low}"]
                self.features.append(names)
                self.allowed.append(allowed)
                if last is not None:
                    self.chain.append((last, node))
                last = node
            for x, (lo, hi) in zip(mine, ranges):
                if hi > lo:
                    self.places[-1].append((x, range(number[lo], number[hi - 1] + 1)))
                    if x.kind == "person_name" and _WIDE.match(plain[x.start]):  # names of scripts without words, as wholes
                        same["=" + plain[x.start : x.end]].append(number[lo])
        # A chain through equal and similar tokens: the number of links is linear.
        for group in same.values():
            self.links += [(i, j) for i, j in zip(group, group[1:]) if j - i > 1]


@dataclass
class Field:
    index: FeatureIndex
    weights: np.ndarray
    transitions: np.ndarray
    link: float


def _potentials(transitions: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    same = np.eye(len(KINDS))
    same[0, 0] = 0  # that two tokens are no mention says nothing of either
    return np.exp(np.clip(transitions, -8, 8)), np.exp(link * same)


class Graph:
    """Messages over the chain and link edges of a set of tokens, all edges at once."""

    def __init__(self, chain: list[tuple[int, int]], links: list[tuple[int, int]], n: int):
        self.n, self.n_chain = n, len(chain)
        e = np.array(chain + links, dtype=np.int64).reshape(-1, 2)
        self.a, self.b = e[:, 0], e[:, 1]
        self.to = np.concatenate((self.b, self.a))
        self.order = np.argsort(self.to, kind="stable")
        self.sorted_to = self.to[self.order]
        self.log = np.zeros((2 * len(e), len(KINDS)))  # messages to b, then to a

    def _beliefs(self, unary: np.ndarray) -> np.ndarray:
        out = unary.copy()
        if len(self.to):
            first = np.flatnonzero(np.concatenate(([True], self.sorted_to[1:] != self.sorted_to[:-1])))
            out[self.sorted_to[first]] += np.add.reduceat(self.log[self.order], first, axis=0)
        return out

    def run(self, unary: np.ndarray, transitions: np.ndarray, link: float, rounds: int):
        """(marginals of the tokens, expected transitions, expected agreement of links)."""
        t, s = _potentials(transitions, link)
        m, c = len(self.a), self.n_chain
        for _ in range(rounds if m else 0):
            belief = self._beliefs(unary)
            out = belief[np.concatenate((self.a, self.b))] - np.concatenate((self.log[m:], self.log[:m]))
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.concatenate((out[:c] @ t, out[c:m] @ s, out[m : m + c] @ t.T, out[m + c :] @ s))
            new = np.log(np.maximum(new / new.sum(axis=1, keepdims=True), 1e-30))
            self.log = DAMPING * self.log + (1 - DAMPING) * new
        belief = self._beliefs(unary)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if not m:
            return p, np.zeros_like(t), 0.0
        left, right = belief[self.a] - self.log[m:], belief[self.b] - self.log[:m]
        left, right = (np.exp(x - x.max(axis=1, keepdims=True)) for x in (left, right))
        z = np.einsum("ei,ij,ej->e", left[:c], t, right[:c])
        expected = np.einsum("ei,ej->ij", left[:c] / np.maximum(z, 1e-300)[:, None], right[:c]) * t
        agree = (left[c:] * right[c:])[:, 1:].sum(axis=1) * np.exp(link)
        total = np.einsum("ei,ij,ej->e", left[c:], s, right[c:])
        return p, expected, float((agree / np.maximum(total, 1e-300)).sum())


def train(texts: list[str]) -> Field:
    """The field of greatest likelihood of the observed labels, drawn to the prior; unobserved labels are summed over:
    the gradient is what is expected with the observed labels held, less what is expected without them."""
    passages = Passages()
    for t in plain_texts(texts):
        passages.add(t)
    index = FeatureIndex()
    counts = defaultdict(int)
    for names in passages.features:
        for x in names:
            counts[x] += 1
    rare = {x for x, k in counts.items() if k < 3 and x.startswith("word-")}  # words met once or twice say nothing
    flat = [index([x for x in names if x not in rare]) for names in passages.features]
    for kind in KINDS[1:]:
        for shape in [*(s for k, s, _ in SHAPES if k == kind), "repeat", "part"]:
            index([f"shape-{shape}|{kind}"])
        for name in PRIOR:
            index([f"{name}|{kind}"])
    index(["context"])
    index.freeze()
    prior = np.zeros((len(index), len(KINDS)))
    for name, i in index.ids.items():
        feature, _, kind = name.partition("|")
        if kind and feature in PRIOR:
            prior[i, _LABEL[kind]] = PRIOR[feature]
        elif kind and feature.startswith("shape-"):
            prior[i] = np.where(np.arange(len(KINDS)) == 0, 0.0, np.where(np.arange(len(KINDS)) == _LABEL[kind], 0.0, -1.0))
    prior[index.ids["context"], 0] = PRIOR_CONTEXT
    t0 = PRIOR_SAME * np.eye(len(KINDS))
    w, t, link = prior.copy(), t0.copy(), PRIOR_LINK
    n = len(flat)
    if not n:
        return Field(index, w, t, link)
    lengths = np.fromiter(map(len, flat), np.int64, n)
    feats = Sparse(np.repeat(np.arange(n), lengths), np.concatenate([np.asarray(f, dtype=np.int64) for f in flat]), n, len(index))
    barred = np.full((n, len(KINDS)), -30.0)
    for i, labels in enumerate(passages.allowed):
        barred[i, list(labels)] = 0.0
    free, held = (Graph(passages.chain, passages.links, n) for _ in range(2))
    moments = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(t), np.zeros_like(t))]
    texts_n = max(1, sum(map(bool, passages.places)))
    for step in range(1, STEPS + 1):
        unary = feats.scores(w)
        p, et, el = free.run(unary, t, link, STEP_ROUNDS)
        q, ct, cl = held.run(unary + barred, t, link, STEP_ROUNDS)
        for x, g, x0, (m, v) in ((w, feats.gradient(q - p), prior, moments[0]), (t, ct - et, t0, moments[1])):
            g = g / texts_n - 2e-3 * (x - x0)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        link = float(np.clip(link + 0.5 * ((cl - el) / texts_n - 2e-3 * (link - PRIOR_LINK)), 0.0, 8.0))
    return Field(index, w, t, link)


def label(texts: list[str], model: Field, *, links: bool = True) -> list[list[Place]]:
    """The mentions of each text, none overlapping another. ``links``: whether distant tokens pass messages."""
    passages = Passages()
    for t in plain_texts(texts):
        passages.add(t)
    n = len(passages.features)
    if not n:
        return [[] for _ in texts]
    flat = [model.index(names) for names in passages.features]
    lengths = np.fromiter(map(len, flat), np.int64, n)
    feats = Sparse(np.repeat(np.arange(n), lengths), np.concatenate([np.asarray(f, dtype=np.int64) for f in flat]), n, len(model.weights))
    p, _, _ = Graph(passages.chain, passages.links if links else [], n).run(feats.scores(model.weights), model.transitions, model.link, ROUNDS)
    out = []
    for places in passages.places:
        for x, tokens in places:
            x.p = float(p[tokens.start : tokens.stop, _LABEL[x.kind]].mean())
        taken: list[tuple[int, int]] = []
        chosen = []
        for x, _ in sorted(places, key=lambda y: (-(y[0].end - y[0].start), -y[0].p, y[0].start)):
            if x.p < ACCEPT:
                continue
            k = bisect_left(taken, (x.start, x.end))
            if (k and taken[k - 1][1] > x.start) or (k < len(taken) and taken[k][0] < x.end):
                continue
            taken.insert(k, (x.start, x.end))
            chosen.append(x)
        out.append(sorted(chosen, key=lambda x: x.start))
    return out


def personal_information(texts: DataFrame) -> DataFrame:
    """Rows (tbl, row_id, mentions, redacted) of the texts (tbl, row_id, text) that hold personal information.

    mentions: array of (kind, start_at, end_at) in 0-based code points; redacted: the text with a typed placeholder
    for each, otherwise unchanged. Null and empty texts and null ids are left out, a row delivered twice counts once,
    texts are read whole, an empty table gives none."""
    sc = texts.sparkSession.sparkContext
    rows = texts.where("row_id IS NOT NULL AND text IS NOT NULL").select("tbl", "row_id", "text")
    sample = [r.text for r in bounded_sample(rows, ["tbl", "row_id"], SAMPLE_ROWS, of=texts).select("text").collect()]
    model = sc.broadcast(train(sample))

    def find(batches):
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())]))
        for b in batches:
            out = []
            tbl, ids, held = batches_of(b, ["tbl", "row_id", "text"])
            for k in range(0, len(held), 1000):
                for j, found in enumerate(label(held[k : k + 1000], model.value), k):
                    if found:
                        parts, last, t = [], 0, held[j]
                        for x in found:
                            parts += (t[last : x.start], PLACEHOLDERS[x.kind])
                            last = x.end
                        out.append((tbl[j], ids[j], [{"kind": x.kind, "start_at": x.start, "end_at": x.end} for x in found], "".join(parts) + t[last:]))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), kinds, pa.string()))], ["tbl", "row_id", "mentions", "redacted"])

    return rows.mapInArrow(find, "tbl string, row_id long, mentions array<struct<kind:string,start_at:long,end_at:long>>, redacted string").dropDuplicates(["tbl", "row_id"])
