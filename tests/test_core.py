import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions.normalize import alnum, strip
from sieveline.operators import decontaminate, dedup, evaluate, flags, neardup, reshape, sample, stats, tokens
from sieveline.sources import jsonl, sinks
from sieveline.streaming import stateless


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup_keeps_copy_of_excluded_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, " a "), (3, "b"), (4, "a"), (5, None), (6, None)], "o long, t string").withColumn("reason", F.lit("clash"))
    df = df.drop("reason")
    manual = F.when(F.col("o") == 1, "manual")
    out = dedup.exact_dedup(df, strip(F.col("t")), "o", manual)
    assert rows_of(out, "o", "reason", "detail") == sorted([(1, "manual", None), (2, None, None), (3, None, None), (4, "exact_duplicate", 2), (5, None, None), (6, "exact_duplicate", 5)], key=repr)
    again = dedup.exact_dedup(out.where("reason IS NULL").select("o", "t"), strip(F.col("t")), "o")
    assert again.where("reason IS NOT NULL").count() == 0


def test_first_wins_with_hot_key_and_partitions(spark):
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(600)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "o long, k string")
    want = {}
    for o, k in sorted(data):
        want.setdefault(k, o)
    for n in (1, 5):
        got = {r.k: r.o for r in dedup.first_wins(df.repartition(n), ["k"], ["o"]).where("is_first").collect()}
        assert got == want
    empty = dedup.first_wins(df.limit(0), ["k"], ["o"])
    assert empty.count() == 0


def test_staged_reasons_and_pairs(spark):
    df = spark.createDataFrame([(1, True, False), (2, None, True), (3, False, False)], "i int, a boolean, b boolean")
    out = df.select("i", flags.drop_reason([("a", F.col("a")), ("b", F.col("b"))]).alias("r"))
    assert rows_of(out, "i", "r") == [(1, "a"), (2, "b"), (3, None)]
    p = spark.createDataFrame([("p", "x", "y"), ("p", "y", "x"), ("p", "x", "x"), ("q", "x", "y"), ("p", "x", "y")], "p string, c string, r string")
    assert dedup.reversed_pairs(p, "p", "c", "r").first().reversed_pairs == 1
    e = dedup.excess(p, F.col("p")).first()
    assert (e.records, e.distinct_keys, e.groups, e.excess) == (5, 2, 1, 3)


def test_validation(spark):
    lines = ['{"text":5}', "null", "[1]", "{bad", '{"text":"\\t"}', '{"text":" ok "}', '{"other":"x"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines, 1)], "ord long, line string")
    got = [r.error for r in jsonl.validate_lines(df, ["text"]).orderBy("ord").collect()]
    assert got == ["missing_field", "not_object", "not_object", "bad_json", "blank_field", None, "missing_field"]
    bad = spark.createDataFrame([(i, i > 25) for i in range(1, 31)], "o long, ok boolean")
    r = flags.validation_report(bad, F.col("ok"), "o").first()
    assert (r.valid, r.invalid, r.first_invalid) == (5, 25, list(range(1, 21)))
    turns = spark.createDataFrame([([("human", ""), ("gpt", "x")],), ([("human", "a")],), (None,), ([("human", None), ("gpt", "x")],)], "c array<struct<role:string,value:string>>")
    assert [r[0] for r in turns.select(flags.valid_dialogue(F.col("c"))).collect()] == [True, False, False, False]


def test_flags(spark):
    df = spark.createDataFrame([(1, "电话13812345678。"), (2, "x138123456789"), (3, "http://a"), (4, None), (5, "")], "o long, t string")
    named = flags.flags(F.col("t"))
    got = df.select("o", named["phone_like"].alias("p"), named["url"].alias("u")).orderBy("o").collect()
    assert [(r.p, r.u) for r in got] == [(True, False), (False, False), (False, True), (False, False), (False, False)]
    first = flags.first_per_flag(df, {"any": F.col("o") > 0}, "o", 2).first()
    assert (first.hits, first["first"]) == (5, [1, 2])


def test_jsonl_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"a":"x"}\n\n{"a":1}\n{"a":"ü"}\n', encoding="utf-8")
    got = jsonl.read_jsonl(spark, str(p), ["a"])
    assert rows_of(got, "ord", "error") == sorted([(1, None), (3, "missing_field"), (4, None)], key=repr)
    with pytest.raises(Exception, match="line 3"):
        jsonl.read_jsonl(spark, str(p), ["a"], strict=True).collect()
    out = str(tmp_path / "out")
    good = got.where("error IS NULL")
    sinks.write_jsonl(good, out, ["ord"], F.to_json(F.struct("a")), single=True)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":"x"}', '{"a":"ü"}']
    with pytest.raises(Exception):
        sinks.write_jsonl(good, out, ["ord"], F.to_json(F.struct("a")))
    hashes = sinks.file_hashes(spark, str(p))
    assert hashes.first().sha256 == hashlib.sha256(p.read_bytes()).hexdigest()
    want = spark.createDataFrame([(hashes.first().path, "0" * 64)], "path string, sha256 string")
    assert sinks.hash_gate(hashes, want).count() == 1
    arr = tmp_path / "a.json"
    arr.write_text('[{"a":"1"},{"a":"2"}]')
    assert jsonl.read_json_array(spark, str(arr), "a string").count() == 2
    one = tmp_path / "o.json"
    one.write_text('{"a":"1"}')
    with pytest.raises(ValueError):
        jsonl.read_json_array(spark, str(one), "a string")
    sep = tmp_path / "s.txt"
    sep.write_text("a b\x0bc\nd", encoding="utf-8")
    assert [r.line for r in jsonl.read_lines(spark, str(sep), line_mode="splitlines").orderBy("ord").collect()] == "a b\x0bc\nd".splitlines()


def test_fingerprints_and_package(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "o long, t string")
    assert sinks.ordered_fingerprint(df, ["o"], F.col("t")) == hashlib.sha256(b"a\nb\n\n").hexdigest()
    one = sinks.set_fingerprint(df, F.col("t")).first()
    assert one == sinks.set_fingerprint(df.orderBy(F.desc("o")), F.col("t")).first()
    (tmp_path / "x").write_text("1")
    (tmp_path / "y").write_text("2")
    a = sinks.package(str(tmp_path), ["y", "x"], str(tmp_path / "1.tgz"))
    sinks.package(str(tmp_path), ["x", "y"], str(tmp_path / "2.tgz"))
    assert [m["name"] for m in a] == ["x", "y"]
    assert (tmp_path / "1.tgz").read_bytes() == (tmp_path / "2.tgz").read_bytes()


def test_dense_ordinals(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    got = jsonl.dense_ordinals(df, "k").orderBy("k").collect()
    assert [r.ord for r in got] == list(range(1, 102))
    assert jsonl.dense_ordinals(df.limit(0), "k").count() == 0


def test_substring_hits_against_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice("abc") for _ in range(60))) for i in range(40)] + [(98, None), (99, "")]
    items = [(i, docs[i][1][5 : 5 + n]) for i, n in enumerate((3, 5, 8, 9, 20, 60))] + [(7, ""), (8, None), (9, "zzzzzzzzz")]
    d, t = spark.createDataFrame(docs, "doc_id long, t string"), spark.createDataFrame(items, "item_id long, s string")
    got = rows_of(decontaminate.substring_hits(d, "doc_id", F.col("t"), t, "item_id", F.col("s")), "doc_id", "item_id")
    assert got == sorted(((i, j) for i, x in docs for j, s in items if s and x and s in x), key=repr)


def _cosines(texts):
    from collections import Counter

    grams = [Counter(t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)) for t in texts]
    df = Counter(g for c in grams for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    vec = [{g: n * idf[g] for g, n in c.items()} for c in grams]
    norm = [math.sqrt(sum(w * w for w in v.values())) or 1 for v in vec]
    return lambda i, j: sum(w * vec[j].get(g, 0) for g, w in vec[i].items()) / norm[i] / norm[j]


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(120)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for edits in (1, 3, 8):
            x = list(b)
            for _ in range(edits):
                x[rnd.randrange(len(x))] = rnd.choice("xyz")
            texts.append("".join(x))
    texts += [base[0], base[0].upper(), "ab", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    normal = ["".join(c for c in t.lower() if c.isalnum()) for t in texts]
    reps = {}
    for i, n in enumerate(normal):
        if n:
            reps.setdefault(n, []).append(i)
    sim = _cosines([n for n in normal if n])
    at = {i: k for k, i in enumerate(i for i, n in enumerate(normal) if n)}
    first = sorted(v[0] for v in reps.values())
    want = {(i, j) for i in first for j in first if i < j and sim(at[i], at[j]) >= 0.8}
    documents, links = neardup.near_duplicates(df, "id", alnum(F.col("text")), 0.8)
    assert {(r.class_a, r.class_b) for r in links.collect()} == want and want
    for r in documents.collect():
        cls = reps[normal[r.id]]
        assert r.class_id == cls[0] and r.copies == len(cls)
        assert r.links == sum(cls[0] in p for p in want)
    assert {r.id for r in documents.collect()} == set(at)
    held = spark.createDataFrame([(1, base[3]), (2, "nothing like it at all"), (3, None)], "id long, text string")
    near = neardup.nearest_train(held, "id", alnum(F.col("text")), df, "id", alnum(F.col("text")), 0.8).collect()
    assert [(r.heldout_id, r.train_id) for r in near] == [(1, 12)]
    assert neardup.near_duplicates(df.limit(0), "id", alnum(F.col("text")))[0].count() == 0


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("threshold", [0.7, 0.95])
def test_near_duplicates_shuffle_neither_texts_nor_failing_pairs(spark, threshold, monkeypatch):
    """Texts of one mould: nearly every pair shares a prefix feature, few are links. Blocks are small, so that pairs are
    found across them; a text that is delivered twice counts once."""
    monkeypatch.setattr(neardup, "BLOCK", (70, 50), raising=False)
    monkeypatch.setattr(neardup, "MEETINGS", 500, raising=False)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(60)]
    texts = ["".join(rnd.choice(words) for _ in range(25)) for _ in range(300)]
    texts += [t[:100] + "zq" + t[102:] for t in texts[:9]] + [texts[20]] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[4]], "id long, text string").repartition(3)
    first = {t: i for i, t in reversed(rows)}
    sim = _cosines(texts)
    want = {(i, j) for i in first.values() for j in first.values() if i < j and sim(i, j) >= threshold}
    before = _shuffled(spark)
    documents, links = neardup.near_duplicates(df, "id", F.col("text"), threshold)
    assert {(r.class_a, r.class_b) for r in links.collect()} == want and 2 <= len(want) < 3000
    got = {r.id: (r.class_id, r.copies, r.links) for r in documents.collect()}
    assert documents.count() == len(rows)
    assert got == {i: (first[t], texts.count(t), sum(first[t] in p for p in want)) for i, t in rows}
    assert _shuffled(spark) - before < 4_000_000


def test_hash_sample_ties_and_split(spark):
    df = spark.createDataFrame([(3, "x"), (9, "x"), (5, "y"), (6, None)], "o long, j string")
    got = [r.o for r in sample.hash_sample(df, F.col("j"), 3, "o").collect()]
    assert got.index(9) + 1 == got.index(3) and 6 not in got
    with pytest.raises(ValueError):
        sample.hash_sample(df, F.col("j"), 10, "o", strict=True)
    split = sample.seeded_split(df, F.col("o"), 2, "s")
    assert split.where("split = 'validation'").count() == 2
    assert sorted(sample.shuffled_ordinals(10, 42)) == list(range(10))


def test_reshape(spark):
    df = spark.createDataFrame([(" s ", [["u", "a"]], " q "), (None, None, "q")], "s string, h array<array<string>>, q string")
    m = [r.m for r in df.select(reshape.messages(F.col("s"), F.col("h"), F.col("q")).alias("m")).collect()]
    assert [(x.role, x.content) for x in m[0]] == [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "q")]
    assert [(x.role, x.content) for x in m[1]] == [("user", "q")]
    c = spark.createDataFrame([([("gpt", "a"), ("user", "b")],), ([],), (None,)], "c array<struct<role:string,value:string>>")
    assert [r[0] for r in c.select(reshape.first_turn(F.col("c"), reshape.HUMAN)).collect()] == ["b", "", ""]


def test_tokens(spark):
    assert tokens.step_plan(28946, 2, 4, 0.05) == {"effective_batch": 8, "steps": 3619, "warmup_steps": 181}
    docs = spark.createDataFrame([(i, 300) for i in range(1, 1002)], "ord long, n int")
    s = tokens.packing_stats(docs, "ord", F.col("n")).first()
    assert (s.blocks, s.dropped) == (300_000 // 256 + 1, 300_000 % 256 + 300 % 256)
    small = spark.createDataFrame([(1, 100)], "ord long, n int")
    with pytest.raises(Exception, match="fewer than"):
        tokens.packing_stats(small, "ord", F.col("n")).collect()
    assert tokens.packing_stats(small, "ord", F.col("n"), keep_small=True).first().blocks == 1
    c = tokens.coverage(spark.createDataFrame([(1, 200), (2, 200), (3, 200)], "ord long, n int"), "ord", F.col("n"), cap_blocks=1)
    assert c.first().covered == 2
    t = tokens.truncation_stats(spark.createDataFrame([(300, 500)], "s int, t int"), F.col("s"), F.col("t")).first()
    assert (t.tokens, t.label_tokens, t.truncated) == (192 + 319 + 1, 320, 1)
    blocks = tokens.pack_blocks(spark.createDataFrame([(1, "a" * 300), (2, "b" * 300)], "ord long, t string"), "ord", tokens.code_points(F.col("t"))).orderBy("block").collect()
    assert [len(b.ids) for b in blocks] == [256, 256] and blocks[1].ids[44] == ord("b")


def test_stats(spark):
    v = spark.createDataFrame([(i,) for i in range(15)], "v int")
    assert stats.floor_rank(v, "v", 0.9).first().value == 12
    p = stats.percentiles(v, F.col("v")).first()
    assert p.p90 == pytest.approx(np.percentile(range(15), 90))
    assert stats.floor_rank(v.limit(0), "v", 0.9).first().value is None


def test_evaluate(spark):
    m = spark.createDataFrame([(2, 3), (1, 4), (0, 0), (0, 30)], "l long, r long").select(evaluate.mcnemar(F.col("l"), F.col("r")).alias("p")).collect()
    assert [r.p for r in m] == pytest.approx([1.0, 0.375, 1.0, 2 * 0.5**30])
    s = spark.createDataFrame([({"A": -2.0, "B": -1.0, "C": -1.0, "D": -3.0},)], "s map<string,double>")
    assert s.select(evaluate.best_choice(F.col("s"))).first()[0] == "B"
    x = evaluate.perplexity(spark.createDataFrame([(1.0, 10), (3.0, 30)], "l double, n int"), F.col("l"), F.col("n")).first()
    assert x.loss == 2.5 and x.perplexity == pytest.approx(math.exp(2.5))
    ab = spark.createDataFrame([(0.0, 1e-7, 1, 2, True, False), (0.0, 1.0, 1, 2, True, True)], "a_reward double, b_reward double, a_tokens int, b_tokens int, a_terminated boolean, b_terminated boolean")
    r = evaluate.ab_summary(ab, "a", "b").first()
    assert (r.ties, r.b_wins, r.a_wins, r.b_termination_rate) == (1, 1, 0, 0.5)
    g = spark.createDataFrame([(" ", 0), ("x", 7), ("x", 8), ("x", 19), ("x", 20)], "t string, n int")
    assert [r[0] for r in g.select(evaluate.length_guard(F.col("t"), F.col("n"))).collect()] == [-1.0, -0.4, -0.1, -0.1, 0.0]
    left = spark.createDataFrame([("s", 1, "A", "A"), ("s", 2, "B", "A")], "subject string, id int, gold string, prediction string")
    assert evaluate.paired(left, left, ["subject", "id"]).first().pairs == 2
    with pytest.raises(Exception, match="same questions"):
        evaluate.paired(left, left.limit(1), ["subject", "id"]).collect()
    bad = evaluate.consistency(spark.createDataFrame([(1.0, math.e), (1.0, 3.0), (float("inf"), 1.0)], "l double, p double"), F.col("l"), F.col("p"))
    assert bad.count() == 2
    sc = evaluate.scored(left, ["gold", "prediction"], lambda b: (b.gold == b.prediction).astype(float))
    assert rows_of(sc, "id", "score") == [(1, 1.0), (2, 0.0)]


def test_streaming_is_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text('{"t":"根治"}\n\n{"t":3}\n{"t":"ok www.x"}\n', encoding="utf-8")
    stream = stateless.flagged(stateless.validated(spark.readStream.text(str(src)), ["t"]), "t")
    q = stream.writeStream.format("memory").queryName("flagged").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("flagged"), "t", "error", "excluded") == sorted([("根治", None, False), (None, "missing_field", False), ("ok www.x", None, True)], key=repr)


def test_launcher_flags(spark):
    df = spark.createDataFrame([("run --lr 0.1 --qlora --n=3 --lr 0.2",)], "t string")
    assert df.select(jsonl.launcher_flags(F.col("t"))).first()[0] == {"lr": "0.2", "qlora": "true", "n": "3"}


def test_json_round_trip(tmp_path):
    sinks.write_json({"a": "ü"}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8")) == {"a": "ü"}


def test_running_sums_over_ranges(spark):
    rnd = random.Random(8)
    rows = [(i * 3, rnd.choice([None, *range(20)])) for i in range(300)]
    df = spark.createDataFrame(rows, "o long, v long").repartition(7)
    got = {r.o: r.s for r in jsonl.running_sum(df, "o", "v", "s").collect()}
    total, want = 0, {}
    for o, v in rows:
        total += v or 0
        want[o] = total
    assert got == want
    assert jsonl.running_sum(df.limit(0), "o", "v", "s").count() == 0


def test_packed_blocks_against_a_list(spark):
    rnd = random.Random(9)
    docs = [(i, "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 5, 40, 700])))) for i in range(1, 60)]
    got = {(r.batch, r.block): r.ids for r in tokens.pack_blocks(spark.createDataFrame(docs, "ord long, t string"), "ord", tokens.code_points(F.col("t")), block=32, batch=10).collect()}
    want = {}
    for b in range(6):
        ids = [ord(c) for o, t in docs if (o - 1) // 10 == b for c in t]
        for k in range(len(ids) // 32):
            want[b, k] = ids[32 * k : 32 * k + 32]
    assert got == want


def test_readers_of_splits_results_and_subjects(spark, tmp_path):
    for n, text in (("a", '{"x":"1","y":"2","z":3}\n{"x":"4"}\n'), ("b", '{"y":"5"}\n')):
        (tmp_path / f"{n}.jsonl").write_text(text)
    got = jsonl.read_splits(spark, {n: str(tmp_path / f"{n}.jsonl") for n in "ab"}, ["x", "y"])
    assert got.columns == ["x", "y", "split"] and rows_of(got, "x", "y", "split") == sorted([("1", "2", "a"), ("4", None, "a"), (None, "5", "b")], key=repr)
    (tmp_path / "r.json").write_text('{"eval": {"loss": 2.5, "ok": true, "name": "x"}, "steps": [10, {"n": 3}]}')
    metrics = jsonl.read_results(spark, {"base": str(tmp_path / "r.json")})
    assert rows_of(metrics, "run", "metric", "value") == [("base", "eval.loss", 2.5), ("base", "steps.0", 10.0), ("base", "steps.1.n", 3.0)]
    for subject in ("law", "art"):
        spark.createDataFrame([(1, subject)], "id int, q string").write.parquet(str(tmp_path / "sub" / subject))
    assert rows_of(jsonl.read_subjects(spark, str(tmp_path / "sub")), "id", "q", "subject") == [(1, "art", "art"), (1, "law", "law")]
    assert jsonl.read_subjects(spark, str(tmp_path / "sub"), ["law"]).count() == 1
    df = spark.createDataFrame([(3, True), (1, False), (2, True)], "ord int, ok boolean")
    assert [r.ord for r in jsonl.first_valid(df, F.col("ok"), 1).collect()] == [2] and jsonl.first_valid(df, F.col("ok"), 0).count() == 2
    assert [r.ord for r in sample.head(df, 2, "ord").collect()] == [1, 2] and sample.head(df.limit(0), 2, "ord").count() == 0
    assert jsonl.require_columns(df, "ok") is df
    with pytest.raises(ValueError, match="prompt"):
        jsonl.require_columns(df, "prompt")


def test_identities_copies_and_gates(spark, tmp_path):
    one = spark.createDataFrame([("x", None, 3)], "a string, b string, c int")
    other = spark.createDataFrame([("x", "q", 3)], "a string, b string, c int")
    assert sinks.same_identity(one, one, ["a", "b", "c"]) and not sinks.same_identity(one, other, ["a", "b"])
    assert rows_of(sinks.identity_differences(one, other, ["a", "b", "c"]), "key", "left", "right", "problem") == [("b", None, "q", "values differ")]
    assert sinks.identity_differences(one.limit(0), one, ["a"]).first().problem == "the left side is empty"
    assert sinks.identity_differences(one, one.unionAll(other), ["a"]).first().problem == "the right side has several rows"
    src = tmp_path / "v.jsonl"
    src.write_bytes(b"\xef\xbb\xbfraw\r\n")
    assert sinks.copy_bytes(str(src), str(tmp_path / "w")) == hashlib.sha256(src.read_bytes()).hexdigest()
    assert (tmp_path / "w").read_bytes() == src.read_bytes()
    with pytest.raises(FileExistsError):
        sinks.copy_bytes(str(src), str(tmp_path / "w"))
    hashes = sinks.file_hashes(spark, str(src))
    right = hashes.select("path", "sha256")
    assert sinks.gated(one, hashes, right) is one
    with pytest.raises(ValueError, match="differ"):
        sinks.gated(one, hashes, right.withColumn("sha256", F.lit("0")))
    with pytest.raises(ValueError, match="kept"):
        sinks.require_empty(one, "kept")
    sinks.require_empty(one.limit(0), "kept")
    blocks = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None)], "block int, ids array<int>")
    assert rows_of(sinks.block_hashes(blocks, "ids", ["block"]), "block", "sha256") == [(0, hashlib.sha256(np.array([1, 2], dtype="<i8").tobytes()).hexdigest()), (1, hashlib.sha256(b"").hexdigest()), (2, None)]


def test_manual_exclusion_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "c")], "o long, t string")
    table = spark.createDataFrame([(1, "bad"), (1, "awful"), (9, "gone"), (None, "x"), (2, None)], "ordinal long, reason string")
    assert rows_of(dedup.excluded_by(df, "o", table), "o", "t", "manual") == sorted([(1, "a", "awful"), (2, "a", None), (None, "c", None)], key=repr)


def test_reviews_examples_and_shapes(spark):
    links = spark.createDataFrame([(5, 6, 0.9), (1, 2, 0.99), (1, 9, 0.97)], "class_a long, class_b long, similarity double")
    assert rows_of(neardup.bounded_examples(links, 2), "class_a", "class_b") == [(1, 2), (1, 9)]
    out = spark.createDataFrame([(2, "x"), (2, "y")], "id long, reason string")
    assert rows_of(neardup.review_decisions(links, out), "class_b", "excluded", "decision") == [(2, [2], "excluded"), (6, [], "kept_for_review"), (9, [], "kept_for_review")]
    df = spark.createDataFrame([(1, " ok ", 0.5, "y", 0.25, None)], "id int, a_text string, a_score double, b_text string, b_score double, extra string")
    assert df.select(reshape.completion(F.col("a_text"), "</s>")).first()[0] == "ok</s>"
    assert rows_of(reshape.branches(df, ["id"], ["a", "b"], ["text", "score"]), "id", "branch", "text", "score") == [(1, "a", " ok ", 0.5), (1, "b", "y", 0.25)]
    enc = tokens.with_tokenizer(lambda texts: [[len(w) for w in t.split()] for t in texts])
    assert [r[0] for r in spark.createDataFrame([(1, "a bb"), (2, None)], "i int, t string").orderBy("i").select(enc(F.col("t"))).collect()] == [[1, 2], []]
    assert tokens.extrapolate(10.0, 5, 50) == 100.0
    change = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0)], "a double, b double").select(evaluate.percent_change(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in change] == [50.0, None]
    assert evaluate.text_report({"loss": 1.5}, {"loss": 1.0}).split() == ["loss", "1.5000", "+50.0000%"] and evaluate.text_report({"loss": 1.5}).split() == ["loss", "1.5000"]
    plans = tokens.step_plans(spark.createDataFrame([(28946,)], "n long"), "n", batch=2, accumulation=4, warmup_ratio=0.05).first()
    assert (plans.effective_batch, plans.steps, plans.warmup_steps) == (8, 3619, 181)
    with pytest.raises(Exception, match="no samples"):
        tokens.step_plans(spark.createDataFrame([(0,)], "n long"), "n", batch=2, accumulation=4, warmup_ratio=0.05).collect()


def test_prompt_splits(spark):
    train = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "o long, p string")
    valid = spark.createDataFrame([(i, f"v{i}") for i in range(9, 0, -1)], "o long, p string")
    got = sample.split_prompts(train, valid, F.col("p"), "o", train_size=10, eval_size=3, seed="s")
    want = sorted(range(30), key=lambda i: hashlib.sha256(f"sp{i}".encode()).hexdigest())[:10]
    assert sorted(r.o for r in got.where("split = 'train'").collect()) == sorted(want)
    assert sorted(r.o for r in got.where("split = 'validation'").collect()) == [1, 2, 3]


def test_hot_keys_in_salted_joins(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x") for i in range(300)] + [(900, None, "y")], "i long, k string, v string")
    flagged = decontaminate.overlap_flag(left, F.col("k"), spark.createDataFrame([("hot",), ("hot",), ("",), (None,)], "k string"), F.col("k"), "seen")
    assert flagged.count() == 301 and flagged.where("seen").count() == 200
    scaled = evaluate.group_scaled(left, "k", [F.col("i").cast("double")], [1.0])
    assert scaled.count() == 300 and abs(scaled.where("k = 'hot'").agg(F.avg("advantage")).first()[0]) < 1e-9


def test_streams_deduplicate_within_a_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = ["1,2024-01-01T00:00:00", "1,2024-01-01T00:00:30", "2,2024-01-01T00:01:00"]
    (src / "1.csv").write_text("\n".join(rows))
    stream = stateless.deduplicated(spark.readStream.schema("k string, at timestamp").csv(str(src)), "k", "at", "10 minutes")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("once").collect()) == ["1", "2"]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from sieveline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(name, default):
                    return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.cut_lineage(Frame())
