import unicodedata

from pyspark.sql import functions as F

from sieveline.functions import jsontext
from sieveline.functions.normalize import alnum, collapse, is_blank, nospace, strip

TEXTS = ["Ａé ①-Ⅳ", "Straße", "x y", "\u001cx", "", None, " a　b ", "ﬁ½", "Ünï", "中文，１２"]


def test_normal_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    c = F.col("t")
    rows = df.select("i", alnum(c).alias("n1"), nospace(c).alias("n2"), collapse(c).alias("n3"), strip(c).alias("n4"), is_blank(c).alias("b")).orderBy("i").collect()
    for r, t in zip(rows, TEXTS):
        if t is None:
            assert (r.n1, r.n2, r.n3, r.n4, r.b) == (None, None, "", None, True)
            continue
        k = unicodedata.normalize("NFKC", t)
        assert r.n1 == "".join(x for x in k.lower() if x.isalnum())
        assert r.n2 == "".join(k.split()).casefold()
        assert r.n3 == " ".join(t.split())
        assert r.n4 == t.strip()
        assert r.b == (not t.strip())


def test_json_texts(spark):
    import json

    values = ['a"b\\c', "x\ny\tz\r", "\x01\x1f", "ünï/中", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for spaced in (False, True):
        rows = df.select("i", jsontext.record([("k", F.col("v")), ("n", F.lit(None).cast("string"))], spaced=spaced).alias("j")).orderBy("i").collect()
        want = [json.dumps({"k": v, "n": None}, ensure_ascii=False, separators=(", ", ": ") if spaced else (",", ":")) for v in values]
        assert [r.j for r in rows] == want
