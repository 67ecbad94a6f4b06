import json
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import crf, crosssplit, formatdup, garble, leak, mixing, packing, pairs, pii, queries, topics
from sieveline.llm.languages import language
from sieveline.llm.sentences import Levels, sentences, split_sentences
from sieveline.llm.shared import alnum_key, code_points, gram_hashes, gram_hashes_many




def clashing(df, *names):
    """The frame with extra columns, some named like an operator's own."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_gram_hashes_agree():
    texts = ["abcdefg", "ab", "", "xabcdey", "中文字符测试"]
    row, pos, h = gram_hashes_many(texts, 3)
    want = [(i, p, int(x)) for i, t in enumerate(texts) for p, x in enumerate(gram_hashes(code_points(t), 3))]
    assert list(zip(row.tolist(), pos.tolist(), h.tolist())) == want


def test_alnum_key():
    for t in ["Ａ b-Ç", "Straße", "½ x", "", None, "x" * 10000 + "。"]:
        want = "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())
        assert alnum_key(t) == want


def _plain(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())


def test_format_duplicates_against_brute_force(spark):
    rnd = random.Random(1)
    base = [("What helps?", None, "Eat less salt."), ("怎么办？", "", "低盐饮食。"), ("x", "y", "z"), ("", "", "")]
    rows = []
    for i in range(120):
        q, e, a = base[i % 4] if i % 3 else (f"q{i}", None, f"a{i}")
        rows.append((i, rnd.choice([q, q.upper(), q.replace(" ", "  ")]), e, rnd.choice([a, a + "!", a.lower()])))
    rows += [rows[5], (None, "a", "b", "c"), (900, None, None, None), (901, "y", "x", "z")]
    df = spark.createDataFrame(rows, "rid long, q string, e string, a string")
    got = {(r.id, r.keep_id, r.copies) for r in formatdup.format_duplicates(clashing(df, "id", "key", "n"), "rid", ["q", "e", "a"]).collect()}
    groups = defaultdict(set)
    for i, *f in rows:
        if i is not None:
            groups[tuple(map(_plain, f))].add(i)
    assert got == {(i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert formatdup.format_duplicates(df.limit(0), "rid", ["q", "e", "a"]).count() == 0


def test_invariants_hold_under_formatting():
    texts = ["Crème brûlée, 3×!", "한국어 문장", "カタカナ ﾀﾞ", "ﬁne Straße", "İstanbul ½", "देवनागरी लिपि", "𝐁old 𠀀", "", "e\u0301a", "ไทย กำ"]
    forms = [lambda t: t, str.upper, lambda t: unicodedata.normalize("NFD", t), lambda t: unicodedata.normalize("NFKC", t), lambda t: " ".join(t) if t.isascii() else t + "。 ", str.casefold]
    for t in texts:
        for f in forms:
            if alnum_key(f(t)) == alnum_key(t):
                a, b = (formatdup.invariants([[("x", v)]]) for v in (t, f(t)))
                assert a[0][0] == b[0][0] and a[1][0] == b[1][0], (t, f(t))
    n, h = formatdup.invariants([[("x", "ab"), ("y", None)], [("x", "ba")], [("y", "ab")], [("x", "a"), ("y", "b")], []])
    assert n.tolist() == [2, 2, 2, 2, 0] and h[0] == h[1] and len(set(h.tolist())) == 4


def test_format_duplicates_of_json(spark):
    lines = ['{"a":"x","b":""}', '{ "b":"" , "a":"X!"}', '{"a":"x"', "null", "[1]", "", None, '{"a":"x","c":null}', '{"a":1}', '{"a":"1"}']
    df = spark.createDataFrame(list(enumerate(lines)), "i long, p string")
    got = {(r.id, r.keep_id) for r in formatdup.format_duplicates(df, "i", ["p"], payload=True).collect()}
    assert got == {(0, 0), (1, 0), (7, 0), (8, 8), (9, 8)}


GOOD = ["Der Läufer mißt täglich den Blutdruck über zwölf Tage.", "Für Mütter gilt: weniger Salz für die Füße.", "Zwölf Prüfer grüßen müde Läufer mit Öl.", "血压在正常范围内，一般每三个月复查一次。", "护士叮嘱先记录体温，两天后再看血钾。", "Показатель калия снизился за время лечения.", "L’été dernier, la fièvre légère a été soignée."]


@pytest.mark.parametrize("wrong, right", [("latin-1", "utf-8"), ("gb18030", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "gbk"), ("koi8_r", "cp1251")])
def test_garbled_is_found_and_restored(spark, wrong, right):
    texts = [(f"{t} {n}", 0) for n in range(40) for t in GOOD]
    bad = {}
    for n, t in enumerate(GOOD):
        try:
            g = f"{t} {n + 7}".encode(right).decode(wrong)
        except UnicodeError:
            continue
        if g != f"{t} {n + 7}":
            bad[1000 + n] = (g, f"{t} {n + 7}")
    rows = [("t", i, t) for i, (t, _) in enumerate(texts)] + [("t", i, g) for i, (g, _) in bad.items()]
    rows += [("t", 5000, None), ("t", 5001, ""), ("t", 5002, "The chart key uses Ã, Â and ¤ as column marks."), ("t", 5003, "lost � sign"), ("t", None, "x"), rows[-1]]
    df = clashing(spark.createDataFrame(rows, "tbl string, row_id long, text string"), "slot", "pair")
    got = {r.row_id: r for r in garble.garbled(df).collect()}
    assert 5003 in got and got[5003].lost
    assert not set(got) - set(bad) - {5003}
    assert bad and set(bad) <= set(got)
    if wrong == "latin-1":
        assert all(got[i].restored == want for i, (_, want) in bad.items())


def test_frequent_lossy_marks_stay_garbled(spark):
    rows = [("t", i, f"{t} {i}") for i, t in enumerate(GOOD * 6)]
    rows += [("t", 1000 + i, f"Zwölf Prüfer grüßen {mark} {i}") for i, mark in enumerate(["\ufffd", "锟斤拷锟斤拷", "ï¿½", "嚙踝蕭"] * 10)]
    got = {r.row_id: r.lost for r in garble.garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert got == {1000 + i: True for i in range(40)}


@pytest.mark.parametrize("wrong", ["latin-1", "gb18030", "cp1251"])
def test_a_third_of_all_texts_may_be_garbled(spark, wrong):
    rows, bad = [], {}
    for n in range(60):
        for k, t in enumerate(GOOD):
            t, i = f"{t} {n}", n * 10 + k
            try:
                g = t.encode("utf-8").decode(wrong) if n % 3 == 0 else t
            except UnicodeError:
                g = t
            if g != t:
                bad[i] = t
            rows.append(("t", i, g))
    got = {r.row_id: r.restored for r in garble.garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert set(got) == set(bad) and len(bad) >= 40
    assert sum(got[i] == t for i, t in bad.items()) >= 0.75 * len(bad)  # the rest is found, but restored in part


def test_characters_are_learned_where_no_codec_is_known(spark):
    """Greek read as Latin-1 (no listed pair): learned from twins, then applied to a text without one."""
    assert not any("iso8859_7" in x or "cp1253" in x for x in garble.PAIRS)
    words = ["πονοκέφαλος", "πυρετός", "αιμορραγία", "κούραση", "ναυτία", "βήχας", "δύσπνοια", "ζάλη", "χάπι", "ξηρότητα", "φλεγμονή", "ψωρίαση"]
    w = lambda n: words[n % 12]
    clean = [f"{w(n)} 12 mg, {w(n + 1)}; {'x' * (n % 40)} {w(n + 2)} and {w(n + 3)}, {w(n + 4)} {'y' * (n // 40)}" for n in range(400)]
    garble_it = lambda t: t.encode("iso8859_7").decode("latin-1")
    bad = {1000 + n: clean[n] for n in range(12)} | {5000: f"nothing like it: {words[0]} {words[3]} {words[6]}"}
    rows = [("t", n, t) for n, t in enumerate(clean)] + [("t", i, garble_it(t)) for i, t in bad.items()]
    rows += [("t", 10000 + n, f"{t} {n}") for n, t in enumerate(GOOD * 500)]
    got = {r.row_id: r.restored for r in garble.garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert set(got) <= set(bad) and got.get(5000) == bad[5000]
    assert sum(got.get(i) == t for i, t in bad.items()) >= 0.8 * len(bad)


def test_pairs_are_learned_by_rate_against_chance():
    assert garble.learned_pairs({0: (50, 5), 1: (50, 0)}, (1000, 0)) == {0}
    assert garble.learned_pairs({0: (10**9, 300)}, (10**9, 290)) == set()  # as often as chance, however often
    assert garble.learned_pairs({0: (10**9, 900)}, (10**9, 290)) == {0}
    # So large a corpus that exp(-mean) is zero: still learned if more than chance gives, not if as many.
    assert garble.learned_pairs({0: (200_000, 5000), 1: (200_000, 2010), 2: (200_000, 1500)}, (100_000, 1000)) == {0}
    assert garble.learned_pairs({0: (200_000, 100_000)}, (0, 0)) == {0}
    assert garble.learned_pairs({0: (1, 1)}, (0, 0)) == set()
    k = garble.PAIRS.index(("latin", "utf-8"))
    assert garble.PAIRS.index(("cp1250", "utf-8")) in garble.related({k}) and garble.PAIRS.index(("big5", "gbk")) not in garble.related({k})


def test_twins_are_sentences_stripped_of_other_characters():
    clean, bad = "Größe: 12 cm, Gefäß\nx", "Mehr! GrÃ¶ÃŸe: 7 cm, Gefäß"
    lo = bad.index("Ã")
    runs = garble._restored_runs("x\n" + bad[6:], 2 + lo - 6, 6 + lo - 6, "öß")
    assert {garble._slot(*x) for x in runs} <= set(garble._slots(clean)) and [r for *_, r in runs] == ["öß"]
    spanning = garble._restored_runs("ab?? 1", 0, 2, "甲。乙")
    assert [r for *_, r in spanning] == ["甲", "乙"]


def test_garbled_of_nothing(spark):
    assert garble.garbled(spark.createDataFrame([], "tbl string, row_id long, text string")).count() == 0


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(80)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 14)))) for i in range(25)] + [(90, None), (91, "?!"), (92, "ab")]
    docs = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(30)]
        if i % 3 == 0:
            s = items[rnd.randrange(25)][1]
            k = rnd.randrange(len(s))
            t.insert(5, s[: k + 1].upper() if i % 2 else s[k:])
        docs.append(("d", i, "-".join(t)))
    docs += [("d", 900, None), ("d", 901, ""), docs[0], ("d", None, "x")]
    d = clashing(spark.createDataFrame(docs, "tbl string, row_id long, text string"), "item_id")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.row_id, r.item_id) for r in leak.leaks(d.where("row_id IS NOT NULL"), t).where("run >= need").collect()}

    def longest(a, b):
        best, prev = 0, [0] * (len(b) + 1)
        for x in a:
            now = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    now[j + 1] = prev[j] + 1
                    best = max(best, now[j + 1])
            prev = now
        return best

    want = {(i, j) for _, i, x in docs if i is not None and x for j, s in items if _plain(s) and 2 * longest(_plain(x), _plain(s)) >= len(_plain(s))}
    assert got == want and want
    assert leak.leaks(d.limit(0), t).count() == 0
    assert leak.leaks(d, t.limit(0)).count() == 0


def _local(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, prev[j - 1] + (2 if x == y else -1), prev[j] - 1, now[-1] - 1))
        best, prev = max(best, *now), now
    return best


def test_smith_waterman():
    a, b = code_points("xxabcdefyy"), code_points("abcxdef")
    assert leak.smith_waterman([a], [a], [0])[0] == 20
    assert leak.smith_waterman([a, b], [b, b], [2, 0]).tolist() == [11, 14]
    rnd = random.Random(5)
    for _ in range(40):
        x, y = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40))) for _ in range(2))
        assert leak.smith_waterman([code_points(x)], [code_points(y)], [rnd.randrange(-3, 4)])[0] == _local(x, y)


def test_rarest_of_windows():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        n = rnd.integers(0, 9, size=int(rnd.integers(1, 40)))
        w = int(rnd.integers(1, len(n) + 1))
        assert set(leak.rarest_of_windows(n, w)) == {int(i + n[i : i + w].argmin()) for i in range(len(n) - w + 1)}


def test_edited_copies_are_aligned(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(14))) for i in range(60)]
    docs, planted = [], set()
    for i in range(240):
        t = [rnd.choice(words) for _ in range(40)]
        if i % 2:
            k, copy = i % 60, list(items[i % 60][1])
            for _ in range(len(copy) // 15):  # an edit every fifteen letters
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], ["z"], [copy[at], "y"]])
            t.insert(9, "".join(copy))
            planted.add((i, k))
        docs.append(("d", i, " ".join(t)))
    got = {(r.row_id, r.item_id) for r in leak.leaks(spark.createDataFrame(docs, "tbl string, row_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and got <= planted, (len(got & planted), len(planted), got - planted)


def _distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return prev[-1]


def test_cross_split_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        t = "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(18, 90)))
        rows.append(("q", i, "train", "s", t))
        x = list(t)
        for _ in range(rnd.randrange(0, 10)):
            k = rnd.randrange(len(x))
            op = rnd.randrange(3)
            x[k : k + 1] = [] if op == 0 else [rnd.choice("xyz")] if op == 1 else [x[k], "w"]
        rows.append(("q", 100 + i, rnd.choice(["valid", "test"]), "s", "".join(x).upper() + "?"))
    rows += [("q", 300, "train", None, rows[0][4]), ("q", 301, "valid", "s", None), ("q", 302, "valid", "s", ""), ("q", None, "valid", "s", rows[0][4]), ("q", 303, "test", "s", "x" * 3000), ("q", 304, "train", "s", "x" * 2990), rows[1]]
    df = clashing(spark.createDataFrame(rows, "tbl string, id long, split string, source string, text string"), "norm", "key")
    members, links = crosssplit.cross_split(df)
    got = {(r.train_id, r.eval_id) for r in crosssplit.overlap_pairs(members, links).collect()}
    use = [(i, s, _plain(t)) for _, i, s, _, t in rows if i is not None and t and len(_plain(t)) >= 20]
    want = {(i, j) for i, s, a in use if s == "train" for j, u, b in use if u != "train" and abs(len(a) - len(b)) <= 0.08 * max(len(a), len(b)) and (len(a) > 1000 or _distance(a, b) <= 0.08 * max(len(a), len(b)))}
    assert got == want and want
    counts = crosssplit.overlap_counts(members, links).agg(F.sum("records").alias("n"), F.sum("near").alias("m")).first()
    assert counts.m <= counts.n
    classes = crosssplit.overlap_classes(members, links).collect()
    by_class = {}
    for i, j in want:
        by_class.setdefault(j, set()).add(i)
    assert {r.class_id for r in classes} <= set(by_class) and sum(r.records for r in classes) == len(by_class)
    m, k = crosssplit.cross_split(df.limit(0))
    assert crosssplit.overlap_pairs(m, k).count() == 0


def test_rarest_windows():
    w = crosssplit.WINDOW
    rnd = np.random.default_rng(6)
    for _ in range(20):
        cost = rnd.integers(0, 9, size=15)
        at = crosssplit.rarest_windows(cost, 2)
        assert at[1] - at[0] >= w and cost[at].sum() == min(cost[a] + cost[b] for a in range(15) for b in range(a + w, 15))
    for n in (20, 21, 33, 60, 100, 511, 512, 513, 2000, 30000):
        wanted, need = crosssplit.windows_wanted(n, 0.08)
        at = crosssplit.rarest_windows(np.zeros(n - w + 1, dtype=np.int64), wanted)
        assert len(at) == wanted and (np.diff(at) >= w).all() and at[-1] + w <= n
        assert need == wanted - crosssplit.edits_allowed(n, 0.08) >= 1


def test_chain_field_learns():
    rnd = random.Random(0)
    feats, labels, lengths = [], [], []
    for _ in range(200):
        n = rnd.randrange(1, 6)
        y = 0
        for _ in range(n):
            y = y if rnd.random() < 0.8 else 1 - y
            labels.append(y)
            feats.append([y if rnd.random() < 0.9 else 1 - y, 2])
        lengths.append(n)
    w, tr = crf.train_chain(feats, np.array(labels), np.array(lengths), 3, 2)
    got = crf.viterbi(crf.emissions(feats, w), np.array(lengths), tr)
    assert (got == np.array(labels)).mean() > 0.88
    assert tr[0, 0] + tr[1, 1] > tr[0, 1] + tr[1, 0]


ANSWERS = ["Take the tablet in the evening and check the pressure after four weeks.", "Eat less salt, drink water often, and measure the weight twice a week.", "The dose is halved after ten days if the cough is gone."]
QUESTIONS = ["My father has had stiff joints for eight weeks; what daily care helps?", "I am 31 and have restless sleep since winter; is it safe to stop the drops?"]


def test_pair_defects(spark):
    rows = []
    for i in range(300):
        rows.append(("t", i, "o", QUESTIONS[i % 2] + f" {i}", f"{ANSWERS[i % 3]} {ANSWERS[(i + 1) % 3]}"))
    rows += [("t", 500 + i, "o", f"孩子咳嗽{i}天，日常应该怎么护理？", "护士叮嘱先记录体温，两天后再看血钾，饮食以低盐清淡为主。请多喝水，并且每天记录体温与血压的变化情况。") for i in range(60)]
    q = QUESTIONS[0]
    cases = {1000: ("", "empty"), 1001: (None, "empty"), 1002: ("N/A", "empty"), 1003: (q, "copy"), 1004: (f"Q: {q.upper()}", "copy"), 1005: ("I'm sorry, but I can't help with that.", "refusal"), 1006: ("护士叮嘱先记录体温，两天后再看血钾，饮食以低盐清淡为主。", "other_language"), 1007: (ANSWERS[0] + " " + ANSWERS[1][:31], "truncated"), 1008: ("Yes.", None), 1009: (f"{q}\n{ANSWERS[0]} {ANSWERS[1]}", None), 1010: (ANSWERS[0] * 400, None)}
    rows += [("t", i, "o", q, a) for i, (a, _) in cases.items()] + [("t", 1011, "o", None, ANSWERS[0]), ("t", None, "o", q, ""), ("t", 1000, "o", q, ""), ("t", 1012, "o", "Translate the sentence into Chinese: drink water.", "请多喝水，并且每天记录体温与血压的变化情况。")]
    rows += [("t", 2000 + i, "o", QUESTIONS[i % 2], x) for i in range(20) for x in ["I'm sorry, but I can't help with that."]]
    df = clashing(spark.createDataFrame(rows, "tbl string, row_id long, field_name string, question string, answer string"), "slot", "defect")
    got = {r.row_id: r.defect for r in pairs.pair_defects(df).collect()}
    for i, (_, want) in cases.items():
        assert got.get(i) == want, (i, got.get(i), want)
    assert not [(i, got[i]) for i in (*range(560), 1011, 1012) if i in got]
    assert pairs.pair_defects(df.limit(0)).count() == 0


def test_personal_information(spark):
    texts = {
        1: ("请联系家属沈岚留下的号码161-7457-9458和邮箱a.b@x.example。", {("person_name", "沈岚"), ("phone", "161-7457-9458"), ("email", "a.b@x.example")}),
        2: ("Mrs. Orrin Quornby lives at Flat 2, 17 Heronsgate Ave., Port Ellery and wrote to q_x [at] a [dot] test.", {("person_name", "Orrin Quornby"), ("address", "Flat 2, 17 Heronsgate Ave., Port Ellery"), ("email", "q_x [at] a [dot] test")}),
        3: ("身份核验：991222-19510628-6273（顾霁月）。批号25933284994的药。", {("id_number", "991222-19510628-6273"), ("person_name", "顾霁月")}),
        4: ("Serial 882663964640520477 matches; 26mg@4h; a positive Marlowick sign; Lot 25181702206.", set()),
        5: ("电话１６３４３３４９７１８。", {("phone", "１６３４３３４９７１８")}),
        6: (None, set()), 7: ("", set()), 8: ("plain text " * 5000, set()),
    }
    rows = [("t", i, t) for i, (t, _) in texts.items()] + [("t", 1, texts[1][0]), ("t", None, "x")]
    df = clashing(spark.createDataFrame(rows, "tbl string, row_id long, text string"), "kind", "mentions")
    got = {r.row_id: r for r in pii.personal_information(df).collect()}
    for i, (t, want) in texts.items():
        found = {(m.kind, t[m.start_at : m.end_at]) for m in got[i].mentions} if i in got else set()
        assert found == want, (i, found)
    out = got[2].redacted
    assert out == "Mrs. [PERSON_NAME] lives at [ADDRESS] and wrote to [EMAIL]."
    assert pii.personal_information(df.limit(0)).count() == 0


def test_endings_are_counted_exactly(spark):
    words = ["".join(chr(0x4E00 + (i * 7919 + k * k * 104729 + i * k * 31) % 20000) for k in range(5)) for i in range(3000)]
    text = "".join(w + ("。" if i % 2 else "") for i, w in enumerate(words))
    wanted = np.ones(1 << pairs.FILTER_BITS, dtype=bool)
    got = {}
    for b in pairs.count_endings([pa.RecordBatch.from_pydict({"answer": [text * 3]})], wanted):
        got.update({r["key"]: (r["total"], r["ended"]) for r in b.to_pylist() if r["kind"] == "e"})
    whole = text * 3
    want = Counter(whole[i : i + 5] for i in range(len(whole) - 4))
    stops = Counter(whole[i : i + 5] for i in range(len(whole) - 5) if whole[i + 5] == "。")
    assert len(want) > 15000 and len(got) == len(want)
    assert {pairs._ending_key(g): (n, stops[g]) for g, n in want.items()} == got


def test_masked_codes_are_the_masked_text():
    texts = ["Take 1.5 mg, or 2,000.25 ?", "A  ! b ： c ;", "ＡＢ１２3.4", "१२ मि", "", "no digits", "12", "x 3,a 4.5.6", "L’été » fin"]
    for t in texts:
        want = pairs._masked(t)
        got = pairs._masked_codes(code_points(t))
        assert "".join(map(chr, got.tolist())) == want, t


def _field():
    rows = [(f"{QUESTIONS[i % 2]} {i}", f"{ANSWERS[i % 3]} {ANSWERS[(i + 1) % 3]}") for i in range(200)]
    rows += [(f"孩子咳嗽{i}天，日常应该怎么护理？", "护士叮嘱先记录体温，两天后再看血钾，饮食以低盐清淡为主。请多喝水，并且每天记录体温。") for i in range(100)]
    rows += [(f"Warum ist mir seit {i} Tagen übel?", "Trinken Sie viel Wasser und messen Sie den Blutdruck am Morgen und am Abend.") for i in range(60)]
    rows += [(f"Почему болит спина уже {i} дней?", "Чаще двигайтесь и пейте воду, а вечером измеряйте давление.") for i in range(60)]
    rows += [(f"How often is it taken after {i} days?", f"Take {i} drops with a glass of water. Ask a nurse if you can not sleep.") for i in range(60)]
    rows += [(f"吃了{i}天药还要注意什么？", "这种药不能与酒同服，无法吞咽时可以掰开。不能空腹服用。") for i in range(60)]
    marks = pairs.Marks({}, np.zeros(0x10000, dtype=bool))
    return marks, pairs.train(rows, marks), rows


# None of these stands in the phrases of training as it is.
UNSEEN_REFUSALS = [
    (QUESTIONS[0], "I would rather not go into that."), (QUESTIONS[1], "That is something I do not discuss."), (QUESTIONS[1], "Sorry, we are not able to speak about medication."),
    ("孩子咳嗽3天，怎么护理？", "这个问题我没法回答。"), ("孩子咳嗽3天，怎么护理？", "很抱歉，关于用药我不方便给出意见。"),
    ("Warum ist mir übel?", "Darüber möchte ich nicht sprechen."), ("Warum ist mir übel?", "Dabei kann ich Ihnen leider nicht weiterhelfen."),
    ("Почему болит спина?", "К сожалению, я не вправе обсуждать лекарства."), ("Почему болит спина?", "Не буду отвечать на такой вопрос."),
]
REAL_ANSWERS = [(QUESTIONS[0], "You should not stop the drops without asking."), (QUESTIONS[1], "Twice a day."), ("孩子咳嗽3天，怎么护理？", "不能饮酒，不能吃辣。"), ("Warum ist mir übel?", "Das liegt am Blutdruck."), ("Почему болит спина?", "Не пейте алкоголь.")]


def test_unseen_refusals_are_told_by_their_words():
    marks, model, _ = _field()
    for rows, want in ((UNSEEN_REFUSALS, "refusal"), (REAL_ANSWERS, None)):
        qs, answers = [q for q, _ in rows], [a for _, a in rows]
        c, labels, cover = pairs.tagged(marks, model, qs, answers, [-1.0] * len(rows))
        got = pairs.defects_of(c, labels, cover, qs)
        assert [g if want else (g if g == "refusal" else None) for g in got] == [want] * len(rows), list(zip(answers, got))


def test_a_batch_and_single_rows_agree():
    marks, model, rows = _field()
    some = rows[::40] + [("", "x. y"), ("q", ""), (QUESTIONS[0], QUESTIONS[0]), ("中文问题？", "A1。\n\n（见")]
    qs, answers = [q for q, _ in some], [a for _, a in some]
    c, labels, cover = pairs.tagged(marks, model, qs, answers, [-1.0] * len(some))
    for k in range(len(some)):
        _, own, share = pairs.tagged(marks, model, [qs[k]], [answers[k]], [-1.0])
        assert labels[c.row == k].tolist() == own.tolist() and np.allclose(cover[k], share[0])


SAMPLES = [
    ("mail", "ab@cd.org"), ("mail", "ab [at] cd [dot] org"), ("id-cn", "11010519491231002X"), ("id-us", "123-45-6789"), ("id-uk", "QQ 89 58 84 D"),
    ("cn-mobile", "13912345678"), ("cn-spelled", "一三九一二三四五六七八"), ("cn-line", "010-1234567"), ("us", "212 555 0126"), ("uk", "07123456789"),
    ("de", "030/1234"), ("fr", "0123456789"), ("plus", "+1 2 3"), ("spaced", "1-3-9-1-2-3-4-5-6-7-8"),
    ("cn-street", "和平路5号"), ("cn-street", "东风胡同12号"), ("cn-street", "阳光小区3栋"), ("ja-block", "東京都港区芝1丁目2"), ("en-street", "7 Elm Avenue"), ("en-street", "7 Elm Drive"),
    ("en-street", "7 Elm Terrace"), ("en-street", "7 Elm Close"), ("fr-street", "9 avenue des Lilas, 00835 Lyon"), ("fr-street", "9 boulevard des Lilas, 00835 Lyon"),
    ("de-street", "Quellgasse 47, 00835 Neustadt"), ("es-street", "Avenida del Sol 5, Madrid"), ("es-street", "Plaza Mayor 5, Madrid"), ("ru-street", "проспект Мира, д. 5"),
    ("latin-name", "Mr. Orrin Quornby"), ("ru-name", "доктор Иван Петров"), ("ru-name", "пациент Иван Петров"), ("zh-name", "家属王小明留下"), ("zh-name", "患者王小明自述"), ("zh-name", "医师王小明建议"),
    ("zh-name", "名叫王小明"), ("zh-name", "署名王小明"), ("zh-name", "5(王小明)"), ("zh-name", "、王小明小姐"), ("ja-name", "看護師田中さん"), ("ja-name", "氏名は田中、"),
]


def test_every_shape_is_proposed_alone():
    assert {shape for shape, _ in SAMPLES} == {shape for _, shape, _ in pii.SHAPES}
    missed = [(shape, t) for shape, t in SAMPLES if not any(f"shape-{shape}" in x.features for x in pii.propose(*pii.plain_texts([t])))]
    assert not missed


def _personal_field():
    texts = ["Mrs. Orrin Quornby lives here. Call +1 555 555 0126 and ask for Odette Tressler.", "A positive Marlowick Sign was seen. Lot 25181702206 is used.", "请联系家属沈岚留下的号码161-7457-9458。", "Herr Jonas Albrecht wohnt Lindenweg 4, 10115 Berlin.", "The Blue Ward was closed. Serial 882663964640520477 matches.", "证件号110105194912310021，批号110105194912310021。", "She lives at 70 Mallow Court, Port Ellery.", "Elle habite au 3 rue des Lilas, 69001 Lyon.", "Vive en Calle del Sol 5, Sevilla.", "Он проживает: ул. Заревая, д. 14, кв. 5."]
    return pii.train(texts * 30)


def test_links_change_labels():
    model = _personal_field()
    alone = "she said that Tamsin Orwelle came, and Tamsin Orwelle left; Orwelle slept well."
    text = f"Mrs. Tamsin Orwelle called; {alone}"
    found = lambda t, **k: [t[m.start : m.end] for m in pii.label([t], model, **k)[0]]
    assert found(alone) == []  # nothing says that it is a name
    assert found(text) == ["Tamsin Orwelle"] * 3 + ["Orwelle"]
    assert found(text, links=False) == ["Tamsin Orwelle"]


def test_places_are_weighed():
    model = _personal_field()
    for t in ("A positive Marlowick Sign was seen.", "Dr. Blue Ward was full.", "批号110105194912310021。"):
        assert pii.propose(t) and pii.label([t], model)[0] == [], t
    for t in ("12 Oak Terrace, Leeds", "14 avenue Victor Hugo, 75016 Paris", "Lindenallee 12, 10115 Berlin", "Plaza Mayor 4, Madrid", "проспект Мира, д. 5, кв. 7"):
        (m,) = pii.label([t], model)[0]
        assert (m.kind, t[m.start : m.end]) == ("address", t)


def test_marginals_of_a_tree_are_exact():
    rnd = np.random.default_rng(3)
    unary, t = rnd.normal(size=(4, 6)), rnd.normal(size=(6, 6))
    p, expected, agree = pii.Graph([(0, 1), (1, 2)], [(2, 3)], 4).run(unary, t, 0.7, 200)
    joint = unary[0][:, None, None, None] + unary[1][None, :, None, None] + unary[2][None, None, :, None] + unary[3] + t[:, :, None, None] + t[None, :, :, None] + 0.7 * np.diag([0, 1, 1, 1, 1, 1])[None, None]
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    for k in range(4):
        assert np.allclose(p[k], joint.sum(axis=tuple(a for a in range(4) if a != k)))
    assert np.allclose(expected, joint.sum(axis=(2, 3)) + joint.sum(axis=(0, 3)))
    assert np.isclose(agree, np.trace(joint.sum(axis=(0, 1))[1:, 1:]))


def test_many_mentions_cost_no_square():
    text = " ".join(f"Mrs. Orrin Quornby, +1 555 555 {k:04d};" for k in range(3000))
    assert len(pii.label([text], _personal_field())[0]) == 6000


@pytest.mark.parametrize("items, capacity, sep", [([(i, 1 + (i * 37) % 90) for i in range(400)] + [(900, 1000), (901, None), (902, 0), (None, 5), (3, 111 - 50)], 100, 1), ([(i, 50) for i in range(99)], 100, 0), ([(1, 7)], 4, 1)])
def test_packing_places_everything_once(spark, items, capacity, sep):
    df = clashing(spark.createDataFrame(items, "id long, length long"), "part", "container")
    placed = packing.pack(df.select("id", "length", "part", "container"), capacity, sep).collect()
    want = defaultdict(int)
    for i, n in items:
        if i is not None and n and n > 0:
            want[i] = max(want[i], n)
    got, boxes = Counter(), defaultdict(list)
    for r in placed:
        got[r.id] += r.length
        boxes[r.container].append(r)
        assert want[r.id] > capacity or r.part == 0
    assert dict(got) == dict(want)
    for rows in boxes.values():
        assert sum(r.length for r in rows) + sep * (len(rows) - 1) <= capacity
        assert len({r.place for r in rows}) == len(rows)
    used = sum(want.values()) + sum(sep * (len(r) - 1) for r in boxes.values())
    if len(items) > 300:
        assert used / (len(boxes) * capacity) > 0.95
    assert packing.pack(df.limit(0), capacity, sep).count() == 0


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(["zh", "en", None]), "t", rnd.randrange(1, 200)) for i in range(3000)] + [(None, "a", "zh", "t", 5), (9001, "a", "zh", "t", 0), (9002, "a", "zh", "t", None), (1, "a", "zh", "t", 5)]
    targets = [(1, "a", 0.5, 1, 0.5), (1, "b", 0.3, 1, 0.5), (1, "c", 0.2, 1, 0.5), (2, "a", 0.2, 3, 1.0), (2, "b", 0.5, 3, 1.0), (2, "c", 0.3, 3, 1.0)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, tokens long"), "slot", "repeats", "h")
    t = spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    m = mixing.mix(d, t)
    rows = m.collect()
    assert all(1 <= r.repeats <= (1 if r.mix_id == 1 else 3) for r in rows)
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    for r in mixing.shares(m, t, d.select("source", "tokens")).collect():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.01)
        assert r.tokens <= r.source_tokens * r.max_repeats
        assert r.shortfall == pytest.approx(max(0, 1 - r.mixture_tokens / r.budget))
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


def test_caps_belong_to_sources(spark):
    docs = [(i, "ab"[i % 2], "en", "t", 10) for i in range(400)]
    targets = [(1, "a", 0.8, 4, 3.0), (1, "b", 0.2, 1, 3.0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, tokens long")
    t = spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    m = mixing.mix(d, t)
    most = {r.source: r.m for r in m.groupBy("source").agg(F.max("repeats").alias("m")).collect()}
    assert most == {"a": 4, "b": 1}
    got = {r.source: r for r in mixing.shares(m, t, d.select("source", "tokens")).collect()}
    assert got["a"].tokens == 8000 and got["b"].tokens == 2000 and got["a"].shortfall == pytest.approx(1 - 10000 / 12000)


def test_cross_split_moves_narrow_rows(spark):
    """Texts of one mould, of which few pairs are near enough: what meets is moved in a few bytes."""
    rnd, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    heads = ["".join(rnd.choice(letters) for _ in range(60)) for _ in range(6)]
    texts = [heads[i % 6] + "".join(rnd.choice(letters) for _ in range(40)) for i in range(1800)]
    rows = [("t", i, "train" if i < 1500 else "test", "s", t) for i, t in enumerate(texts)] + [("t", 5000, "test", "s", texts[3][:-1] + "?!0"), ("u", 5001, "test", "s", texts[4])]
    df = spark.createDataFrame(rows, "tbl string, id long, split string, source string, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    members, links = crosssplit.cross_split(df)
    assert links.count() == 1
    moved = written() - before
    assert moved < 4_000_000, moved


def test_topics_are_fitted_on_all_texts(spark):
    """A twentieth of 8,000 texts has words of its own, in the ids that a sample by lowest hash leaves out."""
    ids = [r.id for r in spark.range(8000).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).collect()]
    late, rnd = set(ids[-400:]), random.Random(4)
    docs = [(i, "en", " ".join(rnd.choice(["oven", "dough", "butter", "flour"] if i in late else ["court", "judge", "appeal", "verdict"]) for _ in range(20))) for i in range(8000)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r.doc_id: r.topic for r in topics.with_topics(df, of=df).collect()}
    assert not {got[i] for i in late} & {got[i] for i in range(8000) if i not in late}
    idf, means, _ = topics.fit(df)
    x = topics.vectors([t for _, _, t in docs]).astype(float)
    assert np.allclose(idf, np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))), atol=1e-5)  # counts over all, not a sample
    assert np.allclose(means["en"], (x * idf).mean(axis=0), atol=1e-5)


def test_topics_come_from_words(spark):
    rnd = random.Random(3)
    fields = [["court", "judge", "appeal", "verdict", "statute"], ["goal", "match", "referee", "striker", "league"], ["flour", "oven", "dough", "butter", "sugar"]]
    docs = [(i, "en", " ".join(rnd.choice(fields[i % 3]) for _ in range(30))) for i in range(300)] + [(900, None, None), (901, "en", "...")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r.doc_id: r.topic for r in topics.with_topics(df, of=df).collect()}
    assert got[900] is None and got[901] is None
    for a in range(3):  # no topic holds two fields
        for b in range(a):
            assert not {got[i] for i in range(300) if i % 3 == a} & {got[i] for i in range(300) if i % 3 == b}


def test_nonnegative_least_squares():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        a, x = rnd.random((12, 6)), np.maximum(rnd.normal(size=6), 0)
        assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x, atol=1e-6)
        b = rnd.normal(size=12)
        y = packing.nonnegative_least_squares(a, b)
        g = a.T @ (b - a @ y)  # at the optimum no gradient points inwards
        assert (y >= 0).all() and (g <= 1e-6).all() and np.allclose(g[y > 1e-9], 0, atol=1e-6)


def test_fill_reports_a_bound(spark):
    placed = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate([60, 60, 60, 30, 30])], "id long, length long"), 100, 1)
    r = packing.fill(placed, 100, 1).first()
    assert (r.containers, r.lower_bound, r.gap) == (3, 3, 0.0)


SENTENCES = [
    ["The dose is approx. 4.5 mg.", "See Fig. 3 for Dr. Lane.", "Stop!"],
    ["“Start now. Then rest, all right?” said the nurse.", "It is 5 p.m."],
    ["The leaflet states: “Keep cool. Do not freeze.”", "Next."],
    ["Bei 21 Personen, d. h. fast allen, half es am 8. Mai.", "„Erst Ruhe. Dann Tee“, sagte sie."],
    ["У 42 чел. калий снизился (см. рис. 2).", "Ул. Заревая, д. 141, кв. 5."],
]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_with_blanks(parts):
    text = " ".join(parts)
    assert [text[a:z] for a, z in sentences(text)] == parts


def test_sentences_without_blanks():
    parts = ["护士叮嘱道：“先抬高下肢。两天后再看，好吗？”", "“耳鸣不一定要用药！”带教老师这样提醒学生。", "范围约3.5 cm×1.2 cm。", "为什么？！"]
    text = "".join(parts)
    assert [text[a:z] for a, z in sentences(text)] == parts
    lines = "标题\n1. 第一条。第二句\r\n\n  A. 选项  "
    assert [lines[a:z] for a, z in sentences(lines)] == ["标题", "1. 第一条。", "第二句", "A. 选项"]
    thai = "ผู้ป่วย 26 คนมีอาการลดลง ไม่ควรใช้ร่วมกัน"
    assert [thai[a:z] for a, z in sentences(thai)] == ["ผู้ป่วย 26 คนมีอาการลดลง", "ไม่ควรใช้ร่วมกัน"]
    assert sentences("") == [] and sentences(" \n\t") == []


def test_list_levels_tell_numbers_of_items():
    levels = Levels()
    lines = ["1. one", "  a) inner", "  b) inner", "2. two", "2024. A year ended it.", "99. far", "100. next", "902. not due", "- sign"]
    assert [levels.body(x) > 0 for x in lines] == [True, True, True, True, False, True, True, False, True]
    text = "99. First. Second.\n100. Third."
    assert [text[a:z] for a, z in sentences(text)] == ["99. First.", "Second.", "100. Third."]
    text = "The war ended in\n1945. Then came peace."
    assert [text[a:z] for a, z in sentences(text)] == ["The war ended in", "1945.", "Then came peace."]


def test_sentences_cover_all_but_blanks(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab. 。！“”\n()A1，") for _ in range(200))) for i in range(50)] + [(90, None), (91, ""), (92, "x" * 100000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "start_at")
    got = defaultdict(list)
    for r in split_sentences(df.select("doc_id", "text")).collect():
        got[r.doc_id].append((r.start_at, r.end_at))
    for i, t in rows:
        spans = sorted(got[i])
        assert all(a < z for a, z in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        inside = set().union(*[range(a, z) for a, z in spans]) if spans else set()
        assert all(t[k].isspace() for k in range(len(t or "")) if k not in inside)


def test_language():
    for t, want in [("Der Wert lag bei 4 und ist gut", "de"), ("Le patient est dans la salle", "fr"), ("今天天气", "zh"), ("今日はよい", "ja"), ("Он не ест", "ru"), ("", ""), ("123", "")]:
        assert language(t) == want


def test_json_payload_fields_sort_by_name():
    assert formatdup._json_fields(json.dumps({"b": "2", "a": "1"})) == [("a", "1"), ("b", "2")]


def test_sentences_leave_out_the_garbled_of_the_whole_corpus(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "One. Two."), (2, "A bad text.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "A bad answer.")], "record_id long, output string").write.parquet(f"{tmp_path}/sft_raw.parquet")
    seen = []

    def found(texts):
        seen.extend(r.tbl for r in texts.select("tbl").distinct().collect())
        return texts.where("text LIKE '%bad%'").select("tbl", "row_id")

    monkeypatch.setattr(queries, "garbled", found)
    assert {r.doc_id for r in queries.p9_found(spark, str(tmp_path)).collect()} == {1}
    assert set(seen) == {"documents", "sft_raw"}
