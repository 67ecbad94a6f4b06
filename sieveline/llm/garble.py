"""Problem 1: text that was decoded with a wrong character encoding.

1. Document frequencies of characters and frequencies of neighbouring characters are counted over the whole corpus.
2. Stretches that turn into frequent characters when re-encoded by a wrong codec and decoded by the right one become
   candidates. Each is restored on trial and its sentence joined with clean near-twins: sentences of the same text
   once non-ASCII characters are stripped (and digits masked), aligned run by run. A codec pair is learned if its restored
   runs equal the aligned ones more often than chance lets them, which is measured by joining the same runs with
   other sentences' stripped texts.
3. Runs of uncommon characters that no codec explains are aligned with the runs of clean twins character by character;
   characters that nearly always lie on one character of another script are learned as a map.
4. Learned pairs and the map are applied to every record; a pair without twins of its own only if a learned one shares a codec with
   it, and only where far more likely text results. What carries the marks of a lossy decoding is reported as not
   recoverable.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import gram_filter
from .codes import CLASS
from .shared import batches_of, code_points, columns_of, cut

#: A character is common if at least this share of the texts with non-ASCII characters contains it.
COMMON_SHARE = 0.004
#: In small corpora, texts that must contain it.
LEAST_TEXTS = 6
#: A codec pair is learned if as many aligned twins as it has would come by chance with less than this probability.
CHANCE = 1e-4
#: Log likelihood that a restored stretch must gain under a learned pair, and under one without twins.
GAIN_LEARNED, GAIN_OTHER = 4.0, 14.0
#: A text is evidently garbled if so many bytes, and this share of all, are UTF-8 under a wrong codec.
EVIDENT_BYTES, EVIDENT_SHARE = 4, 0.95
#: A character map is learned for a character with so many aligned twins, of which this share agree.
MAP_TWINS, MAP_SHARE = 5, 0.9
#: Letters of a run, distinct uncommon characters in it and their share, from which a run that no codec explains is aligned.
UNKNOWN_LETTERS, UNKNOWN_DISTINCT, UNKNOWN_SHARE = 4, 3, 0.5
#: Lengths of runs that are told apart when twins are looked for.
LENGTHS = 4096
#: Slots of the sketch of neighbouring characters: 8 MB, whatever the corpus.
PAIR_BITS = 21
#: Log likelihood of one pair of neighbours in ordinary text.
_PER_CHARACTER = -7.0


def _single_byte(name: str) -> dict[int, str]:
    """Characters that the codec yields, to the Latin-1 character of their byte; undefined bytes stand for themselves."""
    table = {c: None for c in range(0x80, 0x100)}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(name))] = chr(byte)
        except UnicodeDecodeError:
            table[byte] = chr(byte)
    return {k: v if v is not None else "?" for k, v in table.items()}


def _latin() -> dict[int, str]:
    return {c: chr(c) for c in range(0x80, 0x100)} | {k: v for k, v in _single_byte("cp1252").items() if k > 0xFF}


_TABLES = {"latin": _latin(), **{n: _single_byte(n) for n in ("cp1251", "koi8_r", "mac_roman", "cp866", "cp437", "cp1250")}}
_WIDE = ("gb18030", "cp932", "big5", "cp949")

_CYRILLIC = ("cp1251", "koi8_r")
#: Characters beside letters of Cyrillic that show a trial of a single-byte codec to be worth while.
_SIGNS = {n: {chr(c) for c in table if not 0x400 <= c < 0x500 or c in range(0x402, 0x410)} for n, table in _TABLES.items()}

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
_STRETCH = {
    "utf-8": _UTF8,
    "gbk": re.compile(rb"(?:[\x81-\xfe][\x80-\xfe]){2,}"),
    "cp932": re.compile(rb"(?:[\x81-\x9f\xe0-\xef][\x80-\xfc]|[\xa1-\xdf]){4,}"),
    "cp1251": re.compile(rb"[\xa8\xb8\xc0-\xff]{2,}"),
    "koi8_r": re.compile(rb"[\xa3\xb3\xc0-\xff]{2,}"),
}
#: (wrong codec, right codec): the family from which pairs are inferred.
PAIRS = [
    *((w, "utf-8") for w in (*_TABLES, *_WIDE)),
    ("latin", "gbk"), ("latin", "cp1251"), ("latin", "koi8_r"), ("latin", "cp932"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "gbk"), ("mac_roman", "gbk"),
    ("cp949", "gbk"), ("big5", "gbk"), ("cp932", "gbk"), ("gb18030", "cp932"), ("gb18030", "big5"), ("gb18030", "cp949"), ("big5", "cp932"), ("cp949", "cp932"),
]

_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"\d+")
#: What parts the sentences that are aligned with each other.
_UNIT_MARKS = "\n。！？!?"
_UNIT = re.compile(f"[{_UNIT_MARKS}]")
#: What the lead byte and the next byte of a UTF-8 character become under Latin, Cyrillic and Macintosh codecs.
_LEAD_AND_TRAIL = re.compile("[Â-ô][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[В-Яа-п][\xa0-\xbfЂ-ЏђёѓєѕіїјљњћќўџҐґ‘’“”„†‡•–—…‰‹›€™№]|[√‡‚≈ƒ¬Œœ][^\x00-\x7f]")
_ODD_CASE = re.compile("[А-ЯЁ]{4}|[а-яё][А-ЯЁ]")
#: Lossy decoding: the replacement character, and its own bytes read as other encodings.
_LOST = re.compile("�|锟斤拷?|斤拷|ï¿½|п»Ѕ|пїЅ|嚙踝蕭?")


_TRIED = pa.list_(pa.struct([("pair", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("new", pa.string()), ("gain", pa.float64())]))


def _to_bytes(run: str, wrong: str) -> bytes:
    if wrong in _TABLES:
        return run.translate(_TABLES[wrong]).encode("latin-1", "replace")
    return run.encode(wrong, "replace")


@dataclass
class Alphabet:
    """Corpus statistics: how many of the texts hold a character, and log shares of neighbouring characters."""

    texts: int
    df: dict[str, int]
    pairs: np.ndarray

    def __post_init__(self):
        least = max(LEAST_TEXTS, COMMON_SHARE * self.texts)
        self.common = {c for c, n in self.df.items() if n >= least} | {chr(c) for c in range(0x80)}
        self.log = np.log((self.pairs + 0.1) / (self.pairs.sum() + 1)).astype(np.float32)
        self.pairs = None
        self.cache = {}

    def fluency(self, text: str) -> float:
        """Log likelihood of the text's neighbouring characters."""
        return float(self.log[_pair_slots(code_points(text))].sum())

    def known(self, text: str) -> float:
        return sum(map(self.common.__contains__, text)) / len(text)

    def suspicious(self, text: str) -> bool:
        return _LOST.search(text) is not None or not self.common.issuperset(text) or _ODD_CASE.search(text) is not None or _LEAD_AND_TRAIL.search(text) is not None


def _pair_slots(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint64)
    return (((c[:-1] << np.uint64(21)) | c[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


# What the lead bytes of UTF-8 become under the codecs that are most often taken for it.
_EVIDENCE = [("latin", re.compile("[\xc2-\xf4]")), ("gb18030", re.compile("[㐀-鿿]")), ("cp1251", re.compile("[Ѐ-ӿ]"))]


def evident(text: str) -> bool:
    """Whether nearly all of the text's non-ASCII characters are UTF-8 read by one wrong codec: such a text is garbled
    whatever the corpus is like, so its characters must not become common ones, however many texts are like it."""
    run = "".join(_RUN.findall(text))
    for wrong, lead in _EVIDENCE:
        if not lead.search(run):
            continue
        raw = _to_bytes(run, wrong)
        if len(raw) >= EVIDENT_BYTES and sum(len(m[0]) for m in _UTF8.finditer(raw)) >= EVIDENT_SHARE * len(raw):
            return True
    return False


def alphabet_counts(batches):
    """Partial counts of one partition, of texts that aren't evidently garbled: ('t', 0, texts), ('c', code point, texts
    with it), ('p', slot of the sketch, occurrences)."""
    texts, df, pairs = 0, Counter(), np.zeros(1 << PAIR_BITS, dtype=np.int64)
    for b in batches:
        held = [t for t in batches_of(b, ["text"])[0] if t and not t.isascii() and not evident(t)]
        texts += len(held)
        for t in held:
            # Lossy marks, however frequent, make no character common.
            df.update(set(_LOST.sub("", t) if _LOST.search(t) else t))
        if held:
            pairs += np.bincount(_pair_slots(code_points("\n".join(held))), minlength=len(pairs))
    at = np.flatnonzero(pairs)
    kinds = ["t"] + ["c"] * len(df) + ["p"] * len(at)
    items = np.concatenate(([0], np.fromiter(map(ord, df), np.int64, len(df)), at))
    counts = np.concatenate(([texts], np.fromiter(df.values(), np.int64, len(df)), pairs[at]))
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(items.astype(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "item", "n"])


def _decode(raw: bytes, wrong: str, right: str) -> str | None:
    """The bytes in the right encoding; where they were garbled twice in the same way, undone twice."""
    try:
        text = raw.decode(right)
    except UnicodeDecodeError:
        return None
    if right == "utf-8" and wrong in _TABLES and not text.isascii():
        again = _to_bytes(text, wrong)
        if _UTF8.fullmatch(again):
            return again.decode("utf-8", "replace")
        runs = _RUN.findall(text)
        if runs and all(_UTF8.fullmatch(_to_bytes(r, wrong)) for r in runs):
            return _RUN.sub(lambda m: _to_bytes(m[0], wrong).decode("utf-8", "replace"), text)
    return text


def _wide_stretches(run: str, wrong: str, right: str, common: set[str], cache: dict):
    """Both codecs give one character for two bytes: stretches that begin and end with an uncommon character and
    become common ones throughout."""
    known = cache.setdefault((wrong, right), {})

    def restored(c: str) -> str | None:
        if c not in known:
            raw = c.encode(wrong, "replace")
            try:
                new = raw.decode(right) if len(raw) == 2 else ""
            except UnicodeDecodeError:
                new = ""
            known[c] = new if new and all(x in common for x in new) else None
        return known[c]

    i = 0
    while i < len(run):
        if run[i] in common or restored(run[i]) is None:
            i += 1
            continue
        j = last = i + 1
        while j < len(run) and restored(run[j]) is not None:
            j += 1
            if run[j - 1] not in common:
                last = j
        yield i, last, "".join(map(restored, run[i:last]))
        i = j


def _stretches(run: str, wrong: str, right: str, common: set[str], cache: dict):
    """(start, end, restored) in characters of the run."""
    if wrong in _WIDE and right != "utf-8":
        yield from _wide_stretches(run, wrong, right, common, cache)
        return
    raw = _to_bytes(run, wrong)
    for m in _STRETCH[right].finditer(raw):
        if wrong in _TABLES:
            lo, hi, b = m.start(), m.end(), m[0]
            if right == "gbk" and len(b) % 2:
                b, hi = b[:-1], hi - 1
            text = _decode(b, wrong, right)
            if text is None and right in ("gbk", "cp932"):
                text = b.decode(right, "replace")
        else:
            try:
                lo = len(raw[: m.start()].decode(wrong))
            except UnicodeDecodeError:  # it starts inside a character
                continue
            hi, text = lo + len(m[0].decode(wrong, "ignore")), _decode(m[0], wrong, right)
        if text and hi > lo:
            yield lo, hi, text


def candidates(text: str, abc: Alphabet):
    """(pair number, start, end, restored, gain) of stretches that restoring turns into common characters and that
    then fit better between their neighbours; gain is the difference of log likelihoods."""
    for m in _RUN.finditer(text):
        run = m[0]
        odd = {c for c in run if c not in abc.common}
        cased = _ODD_CASE.search(run) is not None
        wide = any("\u2e7f" < c and not "！" <= c <= "～" for c in odd)
        lead = _LEAD_AND_TRAIL.search(run) is not None
        trial = {w: wide for w in _WIDE} | {w: lead or not odd.isdisjoint(signs) for w, signs in _SIGNS.items()}
        for k, (wrong, right) in enumerate(PAIRS):
            if not (cased if wrong in _CYRILLIC and right in _CYRILLIC else trial[wrong]):
                continue
            for lo, hi, new in _stretches(run, wrong, right, abc.common, abc.cache):
                if abc.known(new) < 0.75 or (len(new) < 4 and not abc.common.issuperset(new)):
                    continue
                a, z = m.start() + lo, m.start() + hi
                left, right_char = text[a - 1] if a else "\n", text[z] if z < len(text) else "\n"
                gain = abc.fluency(left + new + right_char) - abc.fluency(left + text[a:z] + right_char)
                if len(new) < z - a:  # fewer neighbours by themselves are likelier
                    gain += (z - a - len(new)) * _PER_CHARACTER
                if gain > 0:
                    yield k, a, z, new, gain


def _stripped(unit: str) -> str:
    """The sentence without non-ASCII characters (a mark stands where a run of them was), digits masked."""
    return _DIGITS.sub("0", _RUN.sub("\x01", unit))


def _slot(stripped: str, place: int, run: str) -> int:
    """Hash of a run, its place in its sentence, and the sentence's stripped text."""
    return xxhash.xxh3_64_intdigest(f"{stripped}\x00{place}\x00{run}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _slots(text: str):
    """Slots of all non-ASCII runs of a clean text."""
    for unit in _UNIT.split(text):
        if not unit.isascii():
            stripped = _stripped(unit)
            for k, run in enumerate(_RUN.findall(unit)):
                yield _slot(stripped, k, run)


def _restored_runs(text: str, lo: int, hi: int, new: str) -> list[tuple[str, int, str]]:
    """(stripped sentence, place, run) of the runs that hold what a stretch becomes when it is restored on trial."""
    a, after = max(text.rfind(c, 0, lo) for c in _UNIT_MARKS) + 1, _UNIT.search(text, hi)
    z = after.start() if after else len(text)
    whole, at, out = text[a:lo] + new + text[hi:z], 0, []
    for unit in _UNIT.split(whole):
        if at < lo - a + len(new) and at + len(unit) > lo - a:
            stripped = _stripped(unit)
            out += [(stripped, k, m[0]) for k, m in enumerate(_RUN.finditer(unit)) if at + m.start() < lo - a + len(new) and at + m.end() > lo - a]
        at += len(unit) + 1
    return out


def unknown_runs(text: str, common: set[str]):
    """(key, run) of the runs that are mostly of uncommon characters; the key says what a twin of it must have: the stripped
    sentence, the place and the length."""
    for unit in _UNIT.split(text):
        found = [(k, run) for k, run in enumerate(_RUN.findall(unit)) if len(run) >= UNKNOWN_LETTERS and _mostly_unknown(run, common)]
        if found:
            stripped = _stripped(unit)
            yield from ((_slot(stripped, k, str(len(run))), run) for k, run in found)


def _mostly_unknown(run: str, common: set[str]) -> bool:
    odd = [c for c in run if c not in common]
    return len(odd) >= UNKNOWN_SHARE * len(run) and len(set(odd)) >= UNKNOWN_DISTINCT


def mapped(text: str, learned: dict[int, str], abc: "Alphabet") -> tuple[str, int]:
    """(text with the runs that the map explains put right, their number)."""
    n = 0

    def put_right(m: re.Match) -> str:
        nonlocal n
        run = m[0]
        if len(run) < UNKNOWN_LETTERS or not _mostly_unknown(run, abc.common) or any(ord(c) not in learned for c in run if c not in abc.common):
            return run
        new = run.translate(learned)
        left, right = text[m.start() - 1 : m.start()] or "\n", text[m.end() : m.end() + 1] or "\n"
        if abc.fluency(left + new + right) - abc.fluency(left + run + right) < GAIN_LEARNED:
            return run
        n += 1
        return new

    return _RUN.sub(put_right, text), n


def _aligned_characters(held: DataFrame, texts: DataFrame, abc) -> dict[int, str]:
    """The learned character map: code point to character. Twins that disagree about a run are no twins; a character of
    the same script is no garbling of another. At most one row per character of Unicode is fetched."""
    unknown = held.where("row_id IS NOT NULL").select(F.explode(F.arrays_zip("keys", "runs")).alias("z")).select("z.keys", "z.runs").distinct().toDF("key", "run")
    # Which keys and lengths are looked for: a filter of fixed size, and lengths up to LENGTHS (longer ones all).
    lengths = np.zeros(LENGTHS + 1, dtype=bool)
    lengths[[r.n for r in unknown.select(F.least(F.length("run"), F.lit(LENGTHS)).alias("n")).distinct().collect()]] = True
    taken = texts.sparkSession.sparkContext.broadcast((gram_filter(unknown, "key"), lengths))

    def clean(batches):
        slots, wanted = taken.value
        bits, common = int(math.log2(len(slots))), abc.value.common
        for b in batches:
            keys, runs = [], []
            for t in batches_of(b, ["text"])[0]:
                if t.isascii():
                    continue
                for unit in _UNIT.split(t):
                    if len(unit) < UNKNOWN_LETTERS or unit.isascii():
                        continue
                    stripped = None
                    for k, run in enumerate(_RUN.findall(unit)):
                        if not wanted[min(len(run), LENGTHS)]:
                            continue
                        if stripped is None:
                            stripped = _stripped(unit)
                        key = _slot(stripped, k, str(len(run)))
                        if slots[(key & (2**64 - 1)) >> (64 - bits)] and common.issuperset(run):
                            keys.append(key)
                            runs.append(run)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.string())], ["key", "twin"])

    twins = texts.select("text").mapInArrow(clean, "key long, twin string").groupBy("key").agg(F.min("twin").alias("twin"), F.max("twin").alias("other")).where("twin = other")
    pairs = unknown.join(twins.hint("merge"), "key").select("run", "twin")

    def characters(batches):
        for b in batches:
            n = Counter(x for run, twin in zip(*batches_of(b, ["run", "twin"])) for x in set(zip(run, twin)))
            yield pa.RecordBatch.from_arrays([pa.array([ord(x) for x, _ in n], pa.int64()), pa.array([y for _, y in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["was", "now", "n"])

    counted = pairs.mapInArrow(characters, "was long, now string, n long").groupBy("was", "now").agg(F.sum("n").alias("n"))
    best = counted.groupBy("was").agg(F.sum("n").alias("total"), F.max(F.struct("n", "now")).alias("best")).where((F.col("best.n") >= MAP_TWINS) & (F.col("best.n") >= MAP_SHARE * F.col("total")))
    out = {}
    for r in best.collect():
        was, now = int(r.was), r.best.now
        if now in abc.value.common and CLASS(np.array([was]))[0] != CLASS(np.array([ord(now)]))[0]:
            out[was] = now
    return out


def learned_pairs(counts: dict[int, tuple[int, int]], chance: tuple[int, int]) -> set[int]:
    """The pairs whose aligned twins aren't chance. counts: (tried slots, of which have a twin) of each pair; chance: the
    same of all pairs' runs under other sentences' stripped texts."""
    rate = (chance[1] + 0.5) / (chance[0] + 100)  # where chance was hardly tried, one in two hundred
    out = set()
    for k, (tried, equal) in counts.items():
        mean, tail = tried * rate, 1.0
        if equal > mean:
            # The probability of as many or more, by the Poisson law: its terms from the first one on, each less than the
            # one before. The first is taken by its logarithm, as exp(-mean) is zero in large corpora.
            n, term = equal, math.exp(equal * math.log(mean) - mean - math.lgamma(equal + 1))
            tail = 0.0
            while term > 1e-3 * CHANCE * (1 - mean / (n + 1)) and tail < CHANCE:
                tail += term
                n += 1
                term *= mean / n
        if equal and tail < CHANCE:
            out.add(k)
    return out


def related(learned: set[int]) -> set[int]:
    """The pairs that share their wrong or their right codec with a learned one."""
    wrong, right = {PAIRS[k][0] for k in learned}, {PAIRS[k][1] for k in learned}
    return {k for k, (w, r) in enumerate(PAIRS) if w in wrong or r in right}


def restore(text: str, tried: list[tuple], learned: set[int], others: set[int]) -> tuple[str, int, bool]:
    """Of the candidates: (text with the accepted stretches restored, their number, whether lossy marks remain)."""
    found = sorted(((k in learned, gain, hi - lo, -k, lo, hi, new) for k, lo, hi, new, gain in tried if k in learned and gain >= GAIN_LEARNED or k in others and gain >= GAIN_OTHER), reverse=True)
    taken: list[tuple[int, int, str]] = []
    for *_, lo, hi, new in found:
        if all(hi <= a or lo >= z for a, z, _ in taken):
            taken.append((lo, hi, new))
    out, last = [], 0
    for lo, hi, new in sorted(taken):
        out += (text[last:lo], new)
        last = hi
    fixed = "".join(out) + text[last:]
    return fixed, len(taken), _LOST.search(text) is not None or "\ufffd" in fixed


def garbled(texts: DataFrame) -> DataFrame:
    """Rows (tbl, row_id, restored, stretches, lost) of texts (tbl, row_id, text) with a wrongly decoded stretch.

    restored: the text with every recoverable stretch put right; stretches: how many those are; lost: whether a part
    can't be recovered. Rightly encoded foreign letters are left alone. Null and empty texts and null ids are no
    cases, repeated deliveries of a row come out once, whole texts of any length are read, an empty table gives none."""
    sc = texts.sparkSession.sparkContext
    texts = texts.where("row_id IS NOT NULL AND text IS NOT NULL").select("tbl", "row_id", "text")
    # Bounded by the characters of Unicode and by the slots of the sketch.
    stats = columns_of(texts.select("text").mapInArrow(alphabet_counts, "kind string, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n")))
    pairs = np.zeros(1 << PAIR_BITS, dtype=np.float32)
    of = {k: stats["kind"] == k for k in "tcp"}
    pairs[stats["item"][of["p"]]] = stats["n"][of["p"]]
    df = {chr(c): int(n) for c, n in zip(stats["item"][of["c"]], stats["n"][of["c"]]) if c > 0x7F}
    abc = sc.broadcast(Alphabet(int(stats["n"][of["t"]].sum()), df, pairs))

    def suspects(batches):
        for b in batches:
            out, clean, before = [], set(), None
            for tbl, i, t in zip(*batches_of(b, ["tbl", "row_id", "text"])):
                if t.isascii():
                    continue
                if not abc.value.suspicious(t):
                    clean.update(_slots(t))
                    continue
                tried = [c for c in candidates(t, abc.value) if c[4] >= GAIN_LEARNED]
                unknown = [] if tried or _LOST.search(t) else list(unknown_runs(t, abc.value.common))
                if tried or unknown or _LOST.search(t):
                    slots = []
                    for k, lo, hi, new, _ in tried:
                        for stripped, n, run in _restored_runs(t, lo, hi, new):
                            slots.append((_slot(stripped, n, run), k))
                            if before not in (None, stripped):  # what chance gives: the run under another stripped sentence
                                slots.append((_slot(before, n, run), -1))
                            before = stripped
                    out.append((tbl, i, t, [dict(zip(("pair", "lo", "hi", "new", "gain"), c)) for c in tried], [s for s, _ in slots], [k for _, k in slots], [k for k, _ in unknown], [r for _, r in unknown]))
            out.append((None, None, None, None, list(clean), None, None, None))
            types = (pa.string(), pa.int64(), pa.string(), _TRIED, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["tbl", "row_id", "text", "tried", "slots", "kinds", "keys", "runs"])

    # Suspects with their candidates, and (without a row_id) the slots of clean texts, each once in a batch.
    held = cut(texts.mapInArrow(suspects, "tbl string, row_id long, text string, tried array<struct<pair:int,lo:int,hi:int,new:string,gain:double>>, slots array<long>, kinds array<int>, keys array<long>, runs array<string>"))
    clean = held.where("row_id IS NULL").select(F.explode("slots").alias("slot")).distinct()
    held = held.where("row_id IS NOT NULL")
    # A sentence that stands in many texts costs one row on either side.
    tried = held.select(F.explode(F.arrays_zip("slots", "kinds")).alias("z")).select("z.slots", "z.kinds").distinct().toDF("slot", "pair")
    twins = tried.join(clean.withColumn("twin", F.lit(1)).hint("merge"), "slot", "left").groupBy("pair").agg(F.count("*").alias("tried"), F.count("twin").alias("equal"))
    counts = {r.pair: (r.tried, r.equal) for r in twins.collect()}  # one row per codec pair
    own = learned_pairs({k: v for k, v in counts.items() if k >= 0}, counts.get(-1, (0, 0)))
    learned = sc.broadcast((own, related(own), _aligned_characters(held, texts, abc)))

    def apply(batches):
        for b in batches:
            out = []
            for tbl, i, t, tried in zip(*batches_of(b, ["tbl", "row_id", "text", "tried"])):
                own, others, characters = learned.value
                fixed, n, lost = restore(t, [tuple(c.values()) for c in tried], own, others)
                if characters and not n and not lost:
                    fixed, n = mapped(t, characters, abc.value)
                if n or lost:
                    out.append((tbl, i, fixed, n, lost))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["tbl", "row_id", "restored", "stretches", "lost"])

    return held.select("tbl", "row_id", "text", "tried").mapInArrow(apply, "tbl string, row_id long, restored string, stretches int, lost boolean").dropDuplicates(["tbl", "row_id"])
