"""Registered queries of the core operators, each beside its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.normalize import alnum, collapse, is_blank, nospace, strip
from ..operators import decontaminate, dedup, evaluate, flags, neardup, reshape, sample, stats, tokens
from ..session import cut_lineage
from ..sources import sinks
from ..sources.jsonl import dense_ordinals, first_valid, validate_lines
from ..sources.sinks import set_fingerprint
from . import sqltext as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _sft(spark, d, **columns):
    """The records, or (record_id, columns): second deliveries fall together, after what is asked of them is computed,
    so that no text is shuffled."""
    t = _t(spark, d, "sft_raw")
    return t.select("record_id", *[c.alias(n) for n, c in columns.items()]).distinct() if columns else t.select("record_id", "source_line", "instruction", "input", "output", "source")


def _pref(spark, d, **columns):
    """As _sft, of the preference records."""
    t = _t(spark, d, "pref_raw")
    return t.select("pref_id", *[c.alias(n) for n, c in columns.items()]).distinct() if columns else t.select("pref_id", "question", "response_chosen", "response_rejected", "system_prompt", "history", "source", "split")


def _user():
    return reshape.user_text(F.col("instruction"), F.col("input"))


def _benchmark(spark, d):
    return _t(spark, d, "mcq").select("item_id", F.col("question").alias("text")).unionByName(_t(spark, d, "heldout_texts").select("item_id", "text"))


SFT = "sft AS (SELECT DISTINCT record_id, source_line, instruction, input, output, source FROM sft_raw)"
PREF = "pref AS (SELECT DISTINCT pref_id, question, response_chosen, response_rejected, system_prompt, history, source, split FROM pref_raw)"
USER = "coalesce(instruction,'') || CASE WHEN coalesce(input,'') <> '' THEN chr(10) || chr(10) || input ELSE '' END"

#: A review's exclusion table (ordinal, reason): the parameter of the manual exclusion queries.
MANUAL = [(3, "quality_review"), (17, "off_scope"), (41, "corrupted_text")]
MANUAL_SQL = "CASE doc_id " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in MANUAL) + " END"


# --- the flagship: normalise, first wins, decontaminate, sample ---------------------------------------------------
_HITS = f"""n AS MATERIALIZED (SELECT doc_id, text, {S.alnum('text')} AS t FROM documents WHERE text IS NOT NULL), i AS MATERIALIZED (SELECT item_id, {S.alnum('text')} AS s FROM (SELECT item_id, question AS text FROM mcq UNION ALL SELECT item_id, text FROM heldout_texts) WHERE text IS NOT NULL),
h AS MATERIALIZED (SELECT n.doc_id, i.item_id FROM n JOIN i ON i.s <> '' AND length(i.s) <= length(n.t) AND contains(n.t, i.s))"""


@query(f"""WITH {_HITS}, f AS (SELECT t, min(doc_id) AS o FROM n GROUP BY t)
SELECT n.doc_id, sha256('42' || n.text) AS sample_hash FROM n JOIN f ON f.t = n.t AND f.o = n.doc_id WHERE n.t <> '' AND n.doc_id NOT IN (SELECT doc_id FROM h) ORDER BY sample_hash, n.doc_id DESC LIMIT 100""")
def corpus_slice(spark, d):
    n = _docs(spark, d).where("text IS NOT NULL").select("doc_id", "text", alnum(F.col("text")).alias("t")).withColumn("k", dedup.digest(F.col("t")))
    n = cut_lineage(n)  # the normal forms are read several times
    hits = decontaminate.substring_hits(n, "doc_id", F.col("t"), _benchmark(spark, d), "item_id", alnum(F.col("text"))).select("doc_id").distinct().withColumn("leak", F.lit(True))
    marked = dedup.first_wins(n, ["k"], ["doc_id"]).join(hits, "doc_id", "left")
    reason = flags.drop_reason([("blank", F.col("t") == ""), ("duplicate", ~F.col("is_first")), ("benchmark", F.col("leak"))])
    return sample.hash_sample(marked.withColumn("reason", reason).where("reason IS NULL"), F.col("text"), 100, "doc_id").select("doc_id", "sample_hash")


# --- ingestion and validity -----------------------------------------------------------------------------------------
_JSON_ERR = """CASE WHEN NOT coalesce(json_valid(payload), false) THEN 'bad_json' WHEN json_type(payload) <> 'OBJECT' THEN 'not_object'
WHEN {missing} THEN 'missing_field' WHEN {blank} THEN 'blank_field' END"""


def _json_err(required, optional=()):
    ty = lambda f: f"coalesce(json_type(payload, '$.{f}'), 'NONE')"
    missing = " OR ".join([*(f"{ty(f)} <> 'VARCHAR'" for f in required), *(f"{ty(f)} NOT IN ('VARCHAR','NONE')" for f in optional)])
    blank = " OR ".join(S.blank(f"json_extract_string(payload, '$.{f}')") for f in required)
    return _JSON_ERR.format(missing=missing, blank=blank)


@query(f"""SELECT kind, coalesce(CASE WHEN kind = 'sft' THEN {_json_err(['instruction', 'output'], ['input'])} ELSE {_json_err(['question', 'response_chosen', 'response_rejected'])} END, 'valid') AS status, count(*) AS n
FROM raw_lines WHERE NOT {S.blank('payload')} GROUP BY ALL""")
def ingest_status(spark, d):
    raw = _t(spark, d, "raw_lines").where(~is_blank(F.col("payload"))).select("line_id", "kind", "payload")
    sft = validate_lines(raw.where("kind = 'sft'"), ["instruction", "output"], ["input"], text="payload").select("kind", "error")
    pref = validate_lines(raw.where("kind <> 'sft'"), ["question", "response_chosen", "response_rejected"], text="payload").select("kind", "error")
    return sft.unionByName(pref).groupBy("kind", F.coalesce("error", F.lit("valid")).alias("status")).agg(F.count("*").alias("n"))


@query(f"""SELECT line_id, {S.strip("json_extract_string(payload, '$.instruction')")} AS instruction, {S.strip("coalesce(json_extract_string(payload, '$.input'), '')")} AS input, {S.strip("json_extract_string(payload, '$.output')")} AS output
FROM raw_lines WHERE kind = 'sft' AND NOT {S.blank('payload')} AND ({_json_err(['instruction', 'output'], ['input'])}) IS NULL""")
def ingest_permissive(spark, d):
    raw = _t(spark, d, "raw_lines").where((F.col("kind") == "sft") & ~is_blank(F.col("payload"))).select("line_id", "payload")
    return validate_lines(raw, ["instruction", "output"], ["input"], text="payload").where("error IS NULL").select("line_id", "instruction", "input", "output")


def _report_sql(table: str, order: str, ok: str) -> str:
    return f"""WITH m AS (SELECT {order} AS o, coalesce({ok}, false) AS ok FROM {table})
SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid, (SELECT coalesce(string_agg(o::VARCHAR, ',' ORDER BY o), '') FROM (SELECT o FROM m WHERE NOT ok ORDER BY o LIMIT 20)) AS first_invalid FROM m"""


def _report(df, ok, order):
    return flags.validation_report(df, ok, order).withColumn("first_invalid", F.array_join(F.transform("first_invalid", lambda x: x.cast("string")), ","))


@query(_report_sql("documents", "doc_id", f"NOT {S.blank('text')}"))
def validation_text(spark, d):
    return _report(_docs(spark, d), flags.valid_text(F.col("text")), "doc_id")


@query(_report_sql("sft_chat", "conv_id", "len(conversations) >= 2 AND len(list_filter(conversations, lambda t: t IS NULL OR t.role IS NULL OR t.value IS NULL)) = 0"))
def validation_dialogue(spark, d):
    return _report(_t(spark, d, "sft_chat"), flags.valid_dialogue(F.col("conversations")), "conv_id")


@query(_report_sql("pref", "pref_id", " AND ".join(f"NOT {S.blank(c)}" for c in ("question", "response_chosen", "response_rejected"))).replace("WITH m", f"WITH {PREF}, m", 1))
def validation_preference(spark, d):
    return _report(_pref(spark, d, ok=flags.valid_preference(F.col("question"), F.col("response_chosen"), F.col("response_rejected"))), F.col("ok"), "pref_id")


_HIST_OK = "(history IS NULL OR len(list_filter(history, lambda h: h IS NULL OR len(h) <> 2 OR len(list_filter(h, lambda x: x IS NULL)) > 0)) = 0)"
_REQ_BAD = " OR ".join(S.blank(c) for c in ("question", "response_chosen", "response_rejected"))


@query(f"""WITH {PREF}, r AS (SELECT CASE WHEN {_REQ_BAD} THEN 'required_fields' WHEN NOT {_HIST_OK} THEN 'history' WHEN contains(question || response_chosen || response_rejected, chr(65533)) THEN 'replacement_char'
WHEN {S.nospace('response_chosen')} = {S.nospace('response_rejected')} THEN 'equal_preference' ELSE 'kept' END AS reason FROM pref) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def preference_validity(spark, d):
    q, c, r = (F.col(x) for x in ("question", "response_chosen", "response_rejected"))
    reason = flags.drop_reason([("required_fields", ~flags.valid_preference(q, c, r)), ("history", ~flags.valid_history(F.col("history"))), ("replacement_char", F.concat(q, c, r).contains("�")), ("equal_preference", nospace(c) == nospace(r))])
    return _pref(spark, d, reason=F.coalesce(reason, F.lit("kept"))).groupBy("reason").agg(F.count("*").alias("n"))


_RE2_PHONE = r"(^|\P{Nd})1[3-9]\p{Nd}{9}(\P{Nd}|$)"
_FLAG_SQL = {n: f"contains(c, chr(65533))" if n == "replacement_character" else f"regexp_matches(c, '{_RE2_PHONE if n == 'phone_like' else p}')" for n, p in flags.PATTERNS.items()}
_COMBINED = f"SELECT record_id, source_line, output, {USER} || chr(10) || coalesce(output,'') AS c FROM sft"


@query(f"WITH {SFT}, x AS ({_COMBINED}) " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (WHERE {p}) AS n FROM x" for n, p in _FLAG_SQL.items()))
def lexical_flag_counts(spark, d):
    named = flags.flags(F.concat(_user(), F.lit("\n"), F.coalesce("output", F.lit(""))))
    return stats.counts(_sft(spark, d, **named), {n: F.col(n) for n in named})


#: A catalogue of patterns that occur in the test tables: the same operators with other rules.
LOCAL = {"mail_address": "@", "lot_number": "批号|Lot ", "six_digits": r"\d{6}", "care_advice": "日常护理|Daily care"}


@query("WITH x AS (SELECT doc_id, text AS c FROM documents), f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, doc_id FROM x WHERE regexp_matches(c, '{p}')" for n, p in LOCAL.items()) + """),
r AS (SELECT flag, doc_id, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS k FROM f)
SELECT flag, count(*) AS hits, string_agg(CASE WHEN k <= 20 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS first FROM r GROUP BY flag""")
def first_lines_per_flag(spark, d):
    named = flags.flags(F.col("text"), flags.Rules(patterns=LOCAL))
    return flags.first_per_flag(_docs(spark, d), named, "doc_id", 20).withColumn("first", F.array_join(F.transform("first", lambda x: x.cast("string")), ","))


@query(f"""WITH {SFT} SELECT count(*) FILTER (WHERE length({S.strip('output')}) < 10) AS answer_under_10, count(*) FILTER (WHERE length({S.strip('output')}) > 4000) AS answer_over_4000,
(SELECT count(*) FROM documents WHERE length(text) < 20) AS text_under_20 FROM sft""")
def length_flags(spark, d):
    n = F.col("n")
    return _sft(spark, d, n=F.length(strip(F.col("output")))).agg(F.count_if(n < 10).alias("answer_under_10"), F.count_if(n > 4000).alias("answer_over_4000")).crossJoin(_docs(spark, d).agg(F.count_if(F.length("text") < 20).alias("text_under_20")))  # one row each


_EXCL = " OR ".join(_FLAG_SQL[n] for n in flags.EXCLUDING)
_ANY = " OR ".join(_FLAG_SQL.values())


@query(f"WITH {SFT}, x AS ({_COMBINED}) SELECT count(*) AS records, count(*) FILTER (WHERE {_ANY}) AS flagged, count(*) FILTER (WHERE {_EXCL}) AS excluded, count(*) FILTER (WHERE ({_ANY}) AND NOT ({_EXCL})) AS review_only FROM x")
def review_and_exclusion(spark, d):
    named = flags.flags(F.concat(_user(), F.lit("\n"), F.coalesce("output", F.lit(""))))
    any_hit, out = F.lit(False), F.lit(False)
    for n, x in named.items():
        any_hit, out = any_hit | x, out | x if n in flags.EXCLUDING else out
    return _sft(spark, d, f=any_hit, e=out).agg(F.count("*").alias("records"), F.count_if("f").alias("flagged"), F.count_if("e").alias("excluded"), F.count_if(F.col("f") & ~F.col("e")).alias("review_only"))


@query(f"""WITH {PREF} SELECT count(*) FILTER (WHERE {S.collapse('response_chosen')} = {S.collapse('response_rejected')}) AS equal_collapsed, count(*) FILTER (WHERE {S.nospace('response_chosen')} = {S.nospace('response_rejected')}) AS equal_nospace FROM pref""")
def equal_pairs(spark, d):
    c, r = F.col("response_chosen"), F.col("response_rejected")
    return _pref(spark, d, a=collapse(c) == collapse(r), b=nospace(c) == nospace(r)).agg(F.count_if("a").alias("equal_collapsed"), F.count_if("b").alias("equal_nospace"))


@query(f"WITH {PREF} SELECT count(*) FILTER (WHERE length(coalesce(question,'')) <= 384 AND length(coalesce(response_chosen,'')) + 1 <= 384 AND length(coalesce(response_rejected,'')) + 1 <= 384) AS within, count(*) AS records FROM pref")
def length_bound(spark, d):
    size = lambda c, eos: F.size(tokens.code_points(F.coalesce(F.col(c), F.lit("")))) + eos
    fits = (size("question", 0) <= 384) & (size("response_chosen", 1) <= 384) & (size("response_rejected", 1) <= 384)
    return _pref(spark, d, fits=fits).agg(F.count_if("fits").alias("within"), F.count("*").alias("records"))


# --- ordered deduplication ------------------------------------------------------------------------------------------
_CPT = f"""c AS (SELECT doc_id, {MANUAL_SQL} AS manual, sha256(coalesce({S.strip('text')}, '')) AS k FROM documents),
f AS (SELECT k, min(doc_id) AS o FROM c WHERE manual IS NULL GROUP BY k),
m AS (SELECT c.doc_id, c.k AS text_sha256, coalesce(c.manual, CASE WHEN c.doc_id <> f.o THEN 'exact_duplicate' END) AS reason, CASE WHEN c.manual IS NULL AND c.doc_id <> f.o THEN f.o END AS detail FROM c LEFT JOIN f ON f.k = c.k)"""


def _clean(spark, d):
    table = spark.createDataFrame(MANUAL, "ordinal long, reason string")
    rows = dedup.excluded_by(_docs(spark, d).select("doc_id", dedup.digest(strip(F.col("text"))).alias("k")), "doc_id", table)
    marked = dedup.first_wins(rows, ["k"], ["doc_id"], among=F.col("manual").isNull())
    duplicate = F.col("manual").isNull() & ~F.col("is_first")
    reason = F.coalesce("manual", F.when(duplicate, "exact_duplicate"))
    return marked.select("doc_id", F.col("k").alias("text_sha256"), reason.alias("reason"), F.when(duplicate, F.col("first_order.doc_id")).alias("detail"))


@query(f"WITH {_CPT} SELECT doc_id, text_sha256, reason, detail FROM m")
def cpt_exact_dedup(spark, d):
    return _clean(spark, d).select("doc_id", "text_sha256", "reason", "detail")


@query(f"WITH {_CPT} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM m GROUP BY 1")
def quarantine_reasons(spark, d):
    return _clean(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_CPT} SELECT row_number() OVER (ORDER BY doc_id) AS output_line, doc_id AS source_line, text_sha256 FROM m WHERE reason IS NULL")
def provenance(spark, d):
    kept = _clean(spark, d).where("reason IS NULL").select("doc_id", "text_sha256")
    return dense_ordinals(kept, "doc_id", "output_line").select(F.col("output_line").cast("long").alias("output_line"), F.col("doc_id").alias("source_line"), "text_sha256")


def _excess_sql(key: str) -> str:
    return f"SELECT coalesce(sum(n),0)::BIGINT AS records, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS groups, coalesce(sum(n) - count(*),0)::BIGINT AS excess FROM (SELECT {key} AS k, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)"


@query(_excess_sql("text"))
def raw_excess(spark, d):
    return dedup.excess(_docs(spark, d).where("text IS NOT NULL"), dedup.digest(F.col("text")))


@query(_excess_sql(S.alnum("text")))
def normalized_excess(spark, d):
    return dedup.excess(_docs(spark, d).where("text IS NOT NULL"), dedup.digest(alnum(F.col("text"))))


_VALID_SFT = f"NOT {S.blank('instruction')} AND NOT {S.blank('output')}"


@query(f"""WITH {SFT}, v AS (SELECT record_id, sha256({S.alnum(f"({USER} || output)")}) AS k FROM sft WHERE {_VALID_SFT})
SELECT record_id, k AS pair_sha256, record_id <> min(record_id) OVER (PARTITION BY k) AS duplicate FROM v""")
def pair_dedup(spark, d):
    v = _sft(spark, d).where(~is_blank(F.col("instruction")) & ~is_blank(F.col("output")))
    v = v.select("record_id", dedup.digest(alnum(F.concat(_user(), F.col("output")))).alias("pair_sha256")).distinct()
    return dedup.first_wins(v, ["pair_sha256"], ["record_id"]).select("record_id", "pair_sha256", (~F.col("is_first")).alias("duplicate"))


@query(f"WITH {SFT}, v AS (SELECT {S.alnum(f'({USER})')} AS k FROM sft WHERE {_VALID_SFT}) SELECT count(*) AS records, (count(*) - count(DISTINCT k)) AS duplicate_prompt_excess FROM v")
def duplicate_prompt_excess(spark, d):
    v = _sft(spark, d).where(~is_blank(F.col("instruction")) & ~is_blank(F.col("output")))
    v = v.select("record_id", dedup.digest(alnum(_user())).alias("k")).distinct()
    return dedup.excess(v, F.col("k")).select("records", F.col("excess").alias("duplicate_prompt_excess"))


_HIST_TEXT = "coalesce(array_to_string(list_transform(history, lambda h: array_to_string(list_transform(h, lambda x: coalesce(x,'')), chr(1))), chr(2)), '')"
_STAGE = f"""s AS (SELECT *, CASE WHEN {_REQ_BAD} OR NOT {_HIST_OK} THEN 'invalid' WHEN contains(question || response_chosen || response_rejected, chr(65533)) THEN 'replacement_char' WHEN {S.nospace('response_chosen')} = {S.nospace('response_rejected')} THEN 'equal_preference' END AS early,
{S.nospace("coalesce(system_prompt,'')")} || chr(3) || {_HIST_TEXT} || chr(3) || {S.nospace('question')} AS k FROM pref),
q AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN pref_id <> min(CASE WHEN early IS NULL THEN pref_id END) OVER (PARTITION BY k) THEN 'duplicate_prompt'
WHEN length(question) > 384 OR length({S.strip('response_chosen')}) + 1 > 384 OR length({S.strip('response_rejected')}) + 1 > 384 THEN 'over_length' END AS reason FROM s)"""


def _staged(spark, d):
    """Survivors and drop reasons of the preference preparation in one plan: keys enter before the length filter."""
    q, c, r = (F.col(x) for x in ("question", "response_chosen", "response_rejected"))
    early = flags.drop_reason([("invalid", ~flags.valid_preference(q, c, r) | ~flags.valid_history(F.col("history"))), ("replacement_char", F.concat(q, c, r).contains("�")), ("equal_preference", nospace(c) == nospace(r))])
    history = F.coalesce(F.array_join(F.transform("history", lambda h: F.array_join(F.transform(h, lambda x: F.coalesce(x, F.lit(""))), "\x01")), "\x02"), F.lit(""))
    key = F.concat(nospace(F.coalesce("system_prompt", F.lit(""))), F.lit("\x03"), history, F.lit("\x03"), nospace(q))
    long = (F.length("question") > 384) | (F.length(strip(c)) + 1 > 384) | (F.length(strip(r)) + 1 > 384)
    rows = _pref(spark, d, early=early, k=dedup.digest(key), long=long)
    marked = dedup.first_wins(rows, ["k"], ["pref_id"], among=F.col("early").isNull())
    return marked.withColumn("reason", F.coalesce("early", flags.drop_reason([("duplicate_prompt", ~F.col("is_first")), ("over_length", F.col("long"))])))


@query(f"WITH {PREF}, {_STAGE} SELECT pref_id, reason FROM q")
def prompt_dedup(spark, d):
    return _staged(spark, d).select("pref_id", "reason")


@query(f"WITH {PREF}, {_STAGE} SELECT coalesce(reason,'kept') AS reason, count(*) AS n FROM q GROUP BY 1")
def preparation_counts(spark, d):
    return _staged(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END"


@query(f"""WITH {PREF}, t AS (SELECT pref_id, split, {_RANK} AS r, sha256({S.collapse('question')} || chr(10) || {S.collapse('response_chosen')} || chr(10) || {S.collapse('response_rejected')}) AS k FROM pref)
SELECT split, count(*) AS records, count(*) FILTER (WHERE first) AS kept FROM (SELECT split, (r, pref_id) = min((r, pref_id)) OVER (PARTITION BY k) AS first FROM t) GROUP BY split""")
def cross_split_dedup(spark, d):
    key = F.concat_ws("\n", *[collapse(F.col(c)) for c in ("question", "response_chosen", "response_rejected")])
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    t = _pref(spark, d, split=F.col("split"), r=rank, k=dedup.digest(key))
    return dedup.first_wins(t, ["k"], ["r", "pref_id"]).groupBy("split").agg(F.count("*").alias("records"), F.count_if("is_first").alias("kept"))


_FIRST = "coalesce(list_filter(conversations, lambda t: t.role IN ('human','user'))[1].value, '')"
_REPLY = "coalesce(list_filter(conversations, lambda t: t.role IN ('gpt','assistant'))[1].value, '')"


@query(f"""WITH f AS (SELECT conv_id, {_FIRST} AS prompt FROM sft_chat), v AS (SELECT conv_id, prompt, {S.nospace('prompt')} AS k FROM f WHERE NOT {S.blank('prompt')})
SELECT conv_id, prompt FROM (SELECT *, min(conv_id) OVER (PARTITION BY k) AS o FROM v) WHERE conv_id = o""")
def first_turn_prompts(spark, d):
    v = _t(spark, d, "sft_chat").select("conv_id", reshape.first_turn(F.col("conversations"), reshape.HUMAN).alias("prompt")).where(~is_blank(F.col("prompt")))
    return dedup.first_wins(v.withColumn("k", dedup.digest(nospace(F.col("prompt")))), ["k"], ["conv_id"]).where("is_first").select("conv_id", "prompt")


_P_KEYS = f"p AS (SELECT {S.nospace('question')} AS q, {S.nospace('response_chosen')} AS c, {S.nospace('response_rejected')} AS r FROM pref WHERE NOT ({_REQ_BAD}))"


def _triples(spark, d):
    q, c, r = (F.col(x) for x in ("question", "response_chosen", "response_rejected"))
    k = {n: dedup.digest(nospace(x)) for n, x in (("q", q), ("c", c), ("r", r))}
    return _pref(spark, d, ok=flags.valid_preference(q, c, r), **k).where("ok")


@query(f"WITH {PREF}, {_P_KEYS} SELECT (count(*) - count(DISTINCT q)) AS prompt_excess, (count(*) - count(DISTINCT (q, c, r))) AS triple_excess FROM p")
def preference_excess(spark, d):
    t = _triples(spark, d)
    return dedup.excess(t, F.col("q")).select(F.col("excess").alias("prompt_excess")).crossJoin(dedup.excess(t, F.sha2(F.concat_ws("\x01", "q", "c", "r"), 256)).select(F.col("excess").alias("triple_excess")))  # one row each


@query(f"WITH {PREF}, {_P_KEYS}, u AS (SELECT DISTINCT * FROM p) SELECT count(*) AS reversed_pairs FROM u a WHERE a.c < a.r AND EXISTS (SELECT 1 FROM u b WHERE b.q = a.q AND b.c = a.r AND b.r = a.c)")
def reversed_preferences(spark, d):
    return dedup.reversed_pairs(_triples(spark, d), "q", "c", "r")


# --- decontamination ------------------------------------------------------------------------------------------------
@query(f"""WITH {SFT}, {PREF}, h AS (SELECT DISTINCT {S.alnum('question')} AS k FROM pref WHERE split <> 'train' AND question IS NOT NULL), b AS (SELECT DISTINCT {S.alnum('question')} AS k FROM mcq),
c AS (SELECT DISTINCT {S.alnum('text')} AS k FROM documents WHERE text IS NOT NULL), s AS (SELECT record_id, {S.alnum(f'({USER})')} AS u, {S.alnum(f"({USER} || coalesce(output,''))")} AS p FROM sft)
SELECT count(*) AS records, count(*) FILTER (WHERE u <> '' AND u IN (SELECT k FROM h)) AS heldout_prompt, count(*) FILTER (WHERE p <> '' AND p IN (SELECT k FROM c)) AS corpus_pair, count(*) FILTER (WHERE u <> '' AND u IN (SELECT k FROM b)) AS benchmark_prompt FROM s""")
def overlap_counts(spark, d):
    key = lambda c: F.when(c == "", "").otherwise(dedup.digest(c))  # noqa: E731  digests, not texts, are joined
    s = _sft(spark, d, u=key(alnum(_user())), p=key(alnum(F.concat(_user(), F.coalesce("output", F.lit(""))))))
    held = _pref(spark, d).where("split <> 'train' AND question IS NOT NULL").select(key(alnum(F.col("question"))).alias("k"))
    docs = _docs(spark, d).where("text IS NOT NULL").select(key(alnum(F.col("text"))).alias("k"))
    bench = _t(spark, d, "mcq").select(key(alnum(F.col("question"))).alias("k"))
    for key, other, name in (("u", held, "h"), ("p", docs, "c"), ("u", bench, "b")):
        s = decontaminate.overlap_flag(s, F.col(key), other, F.col("k"), name)
    return s.agg(F.count("*").alias("records"), F.count_if("h").alias("heldout_prompt"), F.count_if("c").alias("corpus_pair"), F.count_if("b").alias("benchmark_prompt"))


@query(f"WITH {_HITS} SELECT doc_id, item_id FROM h")
def benchmark_substring(spark, d):
    docs = cut_lineage(_docs(spark, d).where("text IS NOT NULL").select("doc_id", alnum(F.col("text")).alias("t")))
    return decontaminate.substring_hits(docs, "doc_id", F.col("t"), _benchmark(spark, d), "item_id", alnum(F.col("text")))


@query(f"""SELECT item_id FROM heldout_texts WHERE split = 'valid' AND {S.alnum('text')} IN (SELECT {S.alnum('text')} FROM documents WHERE text IS NOT NULL)""")
def validation_overlap(spark, d):
    held = _t(spark, d, "heldout_texts").where("split = 'valid'").select("item_id", "text")
    return decontaminate.overlap_flag(held, alnum(F.col("text")), _docs(spark, d).where("text IS NOT NULL"), alnum(F.col("text")), "hit").where("hit").select("item_id")


@query(f"WITH {_CPT} SELECT count(*) AS raw_overlap FROM heldout_texts h WHERE EXISTS (SELECT 1 FROM documents x JOIN m ON m.doc_id = x.doc_id AND m.reason IS NULL WHERE {S.strip('x.text')} = h.text)")
def kept_validation_overlap(spark, d):
    kept = _clean(spark, d).where("reason IS NULL").select("text_sha256").distinct()
    held = _t(spark, d, "heldout_texts").where("text IS NOT NULL").select("item_id", F.sha2("text", 256).alias("text_sha256"))
    return held.join(kept, "text_sha256", "left_semi").agg(F.count("*").alias("raw_overlap"))


@query(f"""WITH {PREF}, t AS (SELECT unnest(conversations) AS c FROM sft_chat), h AS (SELECT DISTINCT {S.nospace('c.value')} AS k FROM t WHERE c.role IN ('human','user') AND c.value IS NOT NULL),
b AS (SELECT DISTINCT {S.nospace('question')} AS k FROM mcq WHERE question IS NOT NULL), q AS MATERIALIZED (SELECT pref_id, split, {S.nospace('question')} AS k FROM pref)
SELECT split, count(*) AS records, count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM h)) AS overlapping, count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM b)) AS benchmark FROM q GROUP BY split""")
def preference_question_overlap(spark, d):
    """Questions that are also a user's turn of any dialogue, and those that are a benchmark question."""
    turns = _t(spark, d, "sft_chat").select(F.explode("conversations").alias("c")).where(F.col("c.role").isin(*reshape.HUMAN) & F.col("c.value").isNotNull())
    flagged = _pref(spark, d, split=F.col("split"), k0=nospace(F.col("question")))
    for other, name in ((turns.select(nospace(F.col("c.value")).alias("k")), "hit"), (_t(spark, d, "mcq").select(nospace(F.col("question")).alias("k")), "bench")):
        flagged = decontaminate.overlap_flag(flagged, F.col("k0"), other, F.col("k"), name)
    return flagged.groupBy("split").agg(F.count("*").alias("records"), F.count_if("hit").alias("overlapping"), F.count_if("bench").alias("benchmark"))


@query(f"WITH {PREF}, {SFT} SELECT count(*) AS shared_prompts FROM (SELECT {S.nospace('question')} AS k FROM pref WHERE question IS NOT NULL INTERSECT SELECT {S.nospace('instruction')} FROM sft WHERE instruction IS NOT NULL)")
def shared_prompts(spark, d):
    keys = lambda df, c: df.where(F.col(c).isNotNull()).select(dedup.digest(nospace(F.col(c))).alias("k"))
    return keys(_pref(spark, d), "question").intersect(keys(_sft(spark, d), "instruction")).agg(F.count("*").alias("shared_prompts"))


# --- near duplicates ----------------------------------------------------------------------------------------------
def _grams_sql(name: str, source: str, n: int) -> str:
    letters = " + ".join(f"unicode(substr(t, p + {k}, 1))::BIGINT * {neardup.FACTORS[k]}" for k in range(n))
    return f"SELECT k, (({letters} + {n * neardup.LENGTH_FACTOR}) % {neardup.PRIME}) % {1 << neardup.FEATURE_BITS} AS f FROM (SELECT k, t, unnest(range(1, length(t) - {n - 2})) AS p FROM {source} WHERE length(t) >= {n})"


def _vectors_sql(name: str, source: str, weights: str) -> str:
    """CTEs of the unit vectors of the texts (k, t) of ``source``: counts of hashed grams by the weights (f, idf)."""
    return f"""{name}_c AS MATERIALIZED (SELECT k, f, count(*) AS n FROM ({_grams_sql(name, source, 3)} UNION ALL {_grams_sql(name, source, 4)}) GROUP BY k, f),
{name}_w AS (SELECT c.k, c.f, c.n * coalesce(w.idf, (SELECT ln((1 + n) / 1.0) + 1 FROM total)) AS w FROM {name}_c c LEFT JOIN {weights} w ON w.f = c.f),
{name} AS MATERIALIZED (SELECT k, f, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_w)"""


def _texts_sql(normal: str, source: str, key: str) -> str:
    """One row (k, t, copies) per normal form, k its smallest id; the idf of hashed grams counts every copy."""
    return f"""x AS MATERIALIZED (SELECT DISTINCT {key} AS id, {normal} AS t FROM {source}), r AS MATERIALIZED (SELECT min(id) AS k, t, count(*) AS copies FROM x WHERE t <> '' AND id IS NOT NULL GROUP BY t),
total AS (SELECT sum(copies) AS n FROM r), r_g AS (SELECT k, f FROM ({_grams_sql('r', 'r', 3)} UNION {_grams_sql('r', 'r', 4)})),
idf AS MATERIALIZED (SELECT f, ln((1 + (SELECT n FROM total)) / (1.0 + sum(copies))) + 1 AS idf FROM r_g JOIN r ON r.k = r_g.k GROUP BY f)"""


def _links_sql(normal: str, source: str, key: str, threshold: float) -> str:
    """All pairs by brute force over shared grams."""
    return f"""WITH {_texts_sql(normal, source, key)}, {_vectors_sql('v', 'r', 'idf')},
links AS MATERIALIZED (SELECT a.k AS class_a, b.k AS class_b, sum(a.w * b.w) AS similarity FROM v a JOIN v b ON b.f = a.f AND a.k < b.k GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {threshold})"""


#: The screen's thresholds, and a lower one at which the test tables hold links.
CORPUS_THRESHOLD, PAIR_THRESHOLD, LOOSE_THRESHOLD = 0.95, 0.97, 0.7
_DOC_LINKS = lambda t: _links_sql(S.alnum("text"), "documents WHERE text IS NOT NULL", "doc_id", t)
_PAIR_LINKS = lambda t: _links_sql(S.alnum(f"({USER} || coalesce(output,''))"), "sft_raw", "record_id", t)
_CLASSES = "SELECT x.id AS {0}, r.k AS class_id, r.copies, coalesce(n.n, 0)::BIGINT AS links FROM x JOIN r ON r.t = x.t LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT class_a AS k FROM links UNION ALL SELECT class_b FROM links) GROUP BY k) n ON n.k = r.k"


def _near_docs(spark, d, threshold):
    documents, links = neardup.near_duplicates(_docs(spark, d), "doc_id", alnum(F.col("text")), threshold)
    return documents.withColumnRenamed("id", "doc_id"), links.withColumn("similarity", F.round("similarity", 9))


@query(f"{_DOC_LINKS(CORPUS_THRESHOLD)} {_CLASSES.format('doc_id')}")
def neardup_classes(spark, d):
    return _near_docs(spark, d, CORPUS_THRESHOLD)[0]


@query(f"{_DOC_LINKS(LOOSE_THRESHOLD)} {_CLASSES.format('doc_id')}")
def neardup_classes_loose(spark, d):
    return _near_docs(spark, d, LOOSE_THRESHOLD)[0]


@query(f"{_DOC_LINKS(LOOSE_THRESHOLD)} SELECT class_a, class_b, round(similarity, 9) AS similarity FROM links")
def neardup_links(spark, d):
    """At the loose threshold: the test tables have no link at 0.95."""
    return _near_docs(spark, d, LOOSE_THRESHOLD)[1]


@query(f"{_DOC_LINKS(LOOSE_THRESHOLD)} SELECT class_a, class_b, round(similarity, 9) AS similarity FROM links ORDER BY class_a, class_b LIMIT 25")
def neardup_examples(spark, d):
    return neardup.bounded_examples(_near_docs(spark, d, LOOSE_THRESHOLD)[1], 25)


@query(f"""{_DOC_LINKS(LOOSE_THRESHOLD)}, e AS (SELECT class_a AS me, class_b AS other, similarity FROM links UNION ALL SELECT class_b, class_a, similarity FROM links),
b AS (SELECT me, other, similarity, row_number() OVER (PARTITION BY me ORDER BY similarity DESC, other) AS n FROM e JOIN r ON r.k = e.me AND r.copies = 1)
SELECT DISTINCT least(me, other) AS id_a, greatest(me, other) AS id_b, round(similarity, 9) AS similarity FROM b WHERE n = 1""")
def neardup_top2(spark, d):
    return neardup.nearest_two(_docs(spark, d), "doc_id", alnum(F.col("text")), LOOSE_THRESHOLD).withColumn("similarity", F.round("similarity", 9))


def _pair_text():
    return alnum(F.concat(_user(), F.coalesce("output", F.lit(""))))


@query(f"""{_PAIR_LINKS(PAIR_THRESHOLD)} {_CLASSES.format('record_id')}""")
def pair_neardup_classes(spark, d):
    """The screen over user text and answer."""
    return neardup.near_duplicates(_sft(spark, d), "record_id", _pair_text(), PAIR_THRESHOLD)[0].withColumnRenamed("id", "record_id")


@query(f"""{_PAIR_LINKS(PAIR_THRESHOLD)} SELECT class_a, class_b, round(similarity, 9) AS similarity FROM links ORDER BY class_a, class_b LIMIT 50""")
def pair_neardup_examples(spark, d):
    return neardup.bounded_examples(neardup.near_duplicates(_sft(spark, d), "record_id", _pair_text(), PAIR_THRESHOLD)[1], 50).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH {_texts_sql(S.alnum('text'), 'documents WHERE text IS NOT NULL', 'doc_id')}, {_vectors_sql('v', 'r', 'idf')},
h AS MATERIALIZED (SELECT item_id AS k, {S.alnum('text')} AS t FROM heldout_texts WHERE text IS NOT NULL), {_vectors_sql('u', 'h', 'idf')},
s AS (SELECT u.k AS heldout_id, v.k AS train_id, sum(u.w * v.w) AS similarity FROM u JOIN v ON v.f = u.f GROUP BY 1, 2 HAVING sum(u.w * v.w) >= {LOOSE_THRESHOLD})
SELECT heldout_id, train_id, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY heldout_id ORDER BY similarity DESC, train_id) AS n FROM s) WHERE n = 1""")
def neardup_heldout(spark, d):
    held = _t(spark, d, "heldout_texts").select("item_id", "text")
    return neardup.nearest_train(held, "item_id", alnum(F.col("text")), _docs(spark, d), "doc_id", alnum(F.col("text")), LOOSE_THRESHOLD).withColumn("similarity", F.round("similarity", 9))


# --- sampling and hashes --------------------------------------------------------------------------------------------
_CANON = "to_json({'input': coalesce(input,''), 'instruction': instruction, 'output': output})::VARCHAR"


def _canonical(spaced=False, order=("input", "instruction", "output")):
    return jsontext.record([(n, F.coalesce(n, F.lit("")) if n == "input" else F.col(n)) for n in order], spaced=spaced)


@query(f"WITH {SFT} SELECT record_id, sha256('42' || {_CANON}) AS sample_hash FROM sft WHERE instruction IS NOT NULL AND output IS NOT NULL ORDER BY sample_hash, record_id DESC LIMIT 200")
def hash_sample(spark, d):
    rows = _sft(spark, d).where("instruction IS NOT NULL AND output IS NOT NULL")
    hashed = rows.select("record_id", F.sha2(F.concat(F.lit("42"), _canonical()), 256).alias("sample_hash")).distinct()
    return hashed.orderBy("sample_hash", F.desc("record_id")).limit(200)


@query(f"WITH {SFT} SELECT record_id, sha256({_CANON}) AS canonical_sha256 FROM sft WHERE instruction IS NOT NULL AND output IS NOT NULL")
def canonical_json_hash(spark, d):
    return _sft(spark, d).where("instruction IS NOT NULL AND output IS NOT NULL").select("record_id", F.sha2(_canonical(), 256).alias("canonical_sha256")).distinct()


@query(f"""WITH {SFT} SELECT record_id, sha256('{{"input": ' || to_json(coalesce(input,''))::VARCHAR || ', "instruction": ' || to_json(instruction)::VARCHAR || ', "output": ' || to_json(output)::VARCHAR || '}}') AS source_sha256 FROM sft WHERE instruction IS NOT NULL AND output IS NOT NULL""")
def source_record_hash(spark, d):
    return _sft(spark, d).where("instruction IS NOT NULL AND output IS NOT NULL").select("record_id", F.sha2(_canonical(spaced=True), 256).alias("source_sha256")).distinct()


_HEX = lambda k: f"coalesce(sum(('0x' || substr(h, {8 * k + 1}, 8))::HUGEINT), 0)::VARCHAR"


@query(f"WITH x AS (SELECT sha256(coalesce(text,'')) AS h FROM documents) SELECT count(*) AS records, sha256({' || chr(58) || '.join(_HEX(k) for k in range(4))}) AS digest FROM x")
def set_digest(spark, d):
    return set_fingerprint(_docs(spark, d), F.col("text"))


@query("""WITH h AS (SELECT conv_id, sha256('7' || conv_id::VARCHAR) AS h FROM sft_chat), c AS (SELECT max(h) AS m FROM (SELECT h FROM h ORDER BY h LIMIT 100))
SELECT conv_id, CASE WHEN h <= (SELECT m FROM c) THEN 'validation' ELSE 'train' END AS split FROM h""")
def seeded_split(spark, d):
    return sample.seeded_split(_t(spark, d, "sft_chat").select("conv_id"), F.col("conv_id"), 100, "7").select("conv_id", "split")


# --- shapes ---------------------------------------------------------------------------------------------------------
@query(f"WITH {SFT} SELECT record_id, 2::BIGINT AS turns, 'human' AS first_from, {USER} AS first_value, 'gpt' AS second_from, output AS second_value FROM sft")
def sharegpt_reshape(spark, d):
    c = reshape.sharegpt(reshape.user_text(F.col("instruction"), F.col("input")), F.col("output"))
    x = _sft(spark, d).select("record_id", c.alias("c")).distinct()  # whole records are the result
    return x.select("record_id", F.size("c").cast("long").alias("turns"), F.col("c")[0]["from"].alias("first_from"), F.col("c")[0]["value"].alias("first_value"), F.col("c")[1]["from"].alias("second_from"), F.col("c")[1]["value"].alias("second_value"))


_M = lambda role, x: f"'<|im_start|>{role}' || chr(10) || {x} || '<|im_end|>' || chr(10)"


@query(f"""WITH {PREF}, s AS (SELECT pref_id, {S.strip("coalesce(system_prompt,'')")} AS sys, history, {S.strip('question')} AS q FROM pref WHERE question IS NOT NULL)
SELECT pref_id, CASE WHEN sys <> '' THEN {_M('system', 'sys')} ELSE '' END || coalesce(array_to_string(list_transform(history, lambda h: {_M('user', "coalesce(h[1],'')")} || {_M('assistant', "coalesce(h[2],'')")}), ''), '') || {_M('user', 'q')} || '<|im_start|>assistant' || chr(10) AS prompt FROM s""")
def preference_prompts(spark, d):
    m = reshape.messages(F.col("system_prompt"), F.col("history"), F.col("question"))
    return _pref(spark, d).where("question IS NOT NULL").select("pref_id", reshape.render(m).alias("prompt")).distinct()


@query(f"""SELECT item_id, '{reshape.CHOICE_HEADING}' || chr(10) || '{reshape.CHOICE_QUESTION}' || question || chr(10) || 'A. ' || choice_a || chr(10) || 'B. ' || choice_b || chr(10) || 'C. ' || choice_c || chr(10) || 'D. ' || choice_d || chr(10) || '{reshape.CHOICE_ANSWER}' AS prompt FROM mcq""")
def choice_prompts(spark, d):
    return _t(spark, d, "mcq").select("item_id", reshape.choice_prompt(F.col("question"), [F.col(f"choice_{x}") for x in "abcd"]).alias("prompt"))


@query(f"SELECT conv_id, {_FIRST} AS prompt, {_REPLY} AS reply FROM sft_chat")
def first_turns(spark, d):
    c = F.col("conversations")
    return _t(spark, d, "sft_chat").select("conv_id", reshape.first_turn(c, reshape.HUMAN).alias("prompt"), reshape.first_turn(c, reshape.ASSISTANT).alias("reply"))


# --- tokens and packing (one token per code point, and an end mark) ----------------------------------------------------
_DENSE = "k AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS o FROM documents WHERE text IS NOT NULL AND text <> '')"
_BATCHED = f"{_DENSE}, z AS (SELECT (o - 1) // 1000 AS b, o, length(text) + 1 AS s FROM k), p AS (SELECT b, count(*) AS n, sum(s) AS t FROM z GROUP BY b)"


def _kept(spark, d):
    return dense_ordinals(_docs(spark, d).where("text IS NOT NULL AND text <> ''").select("doc_id", "text"), "doc_id")


def _packing_sql(kept: str) -> str:
    return f"WITH {_BATCHED}, q AS (SELECT *, {kept} AS kept FROM p) SELECT sum(n)::BIGINT AS documents, sum(t)::BIGINT AS tokens, sum(ceil(kept / 256))::BIGINT AS blocks, sum(t - kept)::BIGINT AS dropped FROM q"


@query(_packing_sql("(t // 256) * 256"))
def packing_stats(spark, d):
    return tokens.packing_stats(_kept(spark, d), "ord", F.length("text") + 1)


@query(_packing_sql("CASE WHEN t >= 256 THEN (t // 256) * 256 ELSE t END"))
def packing_audit(spark, d):
    return tokens.packing_stats(_kept(spark, d), "ord", F.length("text") + 1, keep_small=True)


@query(f"""WITH {_BATCHED}, q AS (SELECT b, CASE WHEN t >= 256 THEN (t // 256) * 256 ELSE t END AS kept FROM p), r AS (SELECT b, kept, coalesce(sum(kept) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
u AS (SELECT b, greatest(0, least(kept, 1000 * 256 - before)) AS budget FROM r), v AS (SELECT b, coalesce(sum(s) OVER (PARTITION BY b ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM z)
SELECT count(*) FILTER (WHERE pos < budget) AS covered FROM v JOIN u ON u.b = v.b""")
def packing_coverage(spark, d):
    return tokens.coverage(_kept(spark, d), "ord", F.length("text") + 1, cap_blocks=1000)


@query(f"""WITH {_DENSE}, w AS (SELECT (o - 1) // 1000 AS batch, string_agg(text || chr(4), '' ORDER BY o) AS a FROM k GROUP BY 1), n AS (SELECT batch, a, unnest(range(length(a) // 256)) AS block FROM w)
SELECT batch, block, list_sum(list_transform(string_split(substr(a, block * 256 + 1, 256), ''), lambda x: unicode(x)))::BIGINT AS id_sum FROM n""")
def packed_blocks(spark, d):
    ids = F.concat(tokens.code_points(F.col("text")), F.array(F.lit(4)))
    blocks = tokens.pack_blocks(_kept(spark, d), "ord", ids)
    return blocks.select("batch", F.col("block").cast("long").alias("block"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


_Q = lambda c, p: ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {p}{n}" for n, q in stats.PERCENTILES)


@query(f"""WITH {SFT}, l AS (SELECT length({USER}) AS s, length(coalesce(output,'')) AS t FROM sft), c AS (SELECT s, t, floor(512 * s / (s + t)) AS cs, floor(512 * t / (s + t)) - 1 AS ct FROM l WHERE s + t > 0),
r AS (SELECT least(s, cs) + least(t, greatest(0, ct)) + 1 AS n, least(t, greatest(0, ct)) + 1 AS m, (s > cs OR t > ct) AS cut FROM c)
SELECT count(*) AS samples, sum(n)::BIGINT AS tokens, sum(m)::BIGINT AS label_tokens, count(*) FILTER (WHERE cut) AS truncated, round(count(*) FILTER (WHERE cut) / count(*) * 100, 6) AS truncated_percent, {_Q('n', 'input_')}, {_Q('m', 'label_')} FROM r""")
def truncation_stats(spark, d):
    s = tokens.truncation_stats(_sft(spark, d, s=F.length(_user()), t=F.length(F.coalesce("output", F.lit("")))), F.col("s"), F.col("t"))
    return s.select("samples", "tokens", "label_tokens", "truncated", *[F.round(c, 6).alias(c) for c in s.columns[4:]])


@query("WITH n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) SELECT n AS samples, 8::BIGINT AS effective_batch, ceil(n / 8)::BIGINT AS steps, ceil(ceil(n / 8) * 0.05)::BIGINT AS warmup_steps FROM n")
def step_plan(spark, d):
    n = _docs(spark, d).where("text IS NOT NULL").agg(F.count("*").alias("samples"))
    return tokens.step_plans(n, "samples", batch=2, accumulation=4, warmup_ratio=0.05)


# --- profiles -------------------------------------------------------------------------------------------------------
@query(f"SELECT lang, count(*) AS n, {_Q('length(text)', '')} FROM documents WHERE text IS NOT NULL GROUP BY lang")
def length_percentiles(spark, d):
    x = _docs(spark, d).where("text IS NOT NULL").withColumn("v", F.length("text"))
    return stats.percentiles(x, F.col("v"), by=["lang"]).select("lang", "n", *[F.round(n, 6).alias(n) for n, _ in stats.PERCENTILES])


_CTX = "length(coalesce(system_prompt,'')) + coalesce(list_sum(list_transform(flatten(history), lambda x: length(coalesce(x,'')))), 0) + length(coalesce(question,'')) + greatest(length(coalesce(response_chosen,'')), length(coalesce(response_rejected,'')))"


@query(f"""WITH {PREF}, c AS (SELECT split, ({_CTX})::BIGINT AS n, length(response_chosen) AS a, length(response_rejected) AS b FROM pref)
SELECT round(avg(a), 6) AS mean_chosen, round(avg(b), 6) AS mean_rejected, round(median(n), 6) AS p50, max(n) AS longest, count(*) FILTER (WHERE a > b) AS chosen_longer FROM c""")
def preference_profile(spark, d):
    n = stats.context_length(F.col("system_prompt"), F.col("history"), F.col("question"), F.col("response_chosen"), F.col("response_rejected")).cast("long")
    x = _pref(spark, d, n=n, a=F.length("response_chosen"), b=F.length("response_rejected"))
    return x.agg(F.round(F.avg("a"), 6).alias("mean_chosen"), F.round(F.avg("b"), 6).alias("mean_rejected"), F.round(F.median("n"), 6).alias("p50"), F.max("n").alias("longest"), F.count_if(F.col("a") > F.col("b")).alias("chosen_longer"))


@query(f"WITH {PREF}, c AS (SELECT ({_CTX})::BIGINT AS n FROM pref) SELECT list_sort(list(n))[(floor((count(*) - 1) * 0.9) + 1)::BIGINT] AS value FROM c")
def floor_rank_p90(spark, d):
    n = stats.context_length(F.col("system_prompt"), F.col("history"), F.col("question"), F.col("response_chosen"), F.col("response_rejected")).cast("long")
    return stats.floor_rank(_pref(spark, d, n=n), "n", 0.9)


@query("SELECT coalesce(source, '') AS source, count(*) AS n, count(text) AS with_text, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def source_counts(spark, d):
    return _docs(spark, d).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"))


# --- evaluation: predictions, scores and losses are derived from hashes of the keys -----------------------------------
_H = lambda *parts: "('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 6))::BIGINT"


def _hash(*parts):
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6), 16, 10).cast("long")


def _score_sql(model):
    return {c: f"-({_H('item_id::VARCHAR', repr(model), repr(c))} % 50) / 10.0" for c in "ABCD"}


def _pred_sql(model):
    s = _score_sql(model)
    g = f"greatest({', '.join(s.values())})"
    return "CASE " + " ".join(f"WHEN {s[c]} = {g} THEN '{c}'" for c in "ABCD") + " END"


def _predictions(spark, d, model):
    scores = F.create_map(*[x for c in "ABCD" for x in (F.lit(c), -(_hash(F.col("item_id").cast("string"), F.lit(model), F.lit(c)) % 50) / 10.0)])
    return _t(spark, d, "mcq").select("subject", "id", "item_id", F.col("answer").alias("gold"), evaluate.best_choice(scores).alias("prediction"))


@query(f"SELECT item_id, {_pred_sql('a')} AS prediction FROM mcq")
def choice_predictions(spark, d):
    return _predictions(spark, d, "a").select("item_id", "prediction")


_ACC = f"s AS (SELECT subject, count(*) FILTER (WHERE answer = {_pred_sql('a')}) AS correct, count(*) AS total FROM mcq GROUP BY subject)"


@query(f"WITH {_ACC} SELECT subject, correct, total, round(correct / total, 6) AS accuracy FROM s")
def subject_accuracy(spark, d):
    return evaluate.accuracy(_predictions(spark, d, "a"), "subject", "gold", "prediction").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_ACC} SELECT sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(sum(correct) / sum(total), 6) AS micro, round(avg(correct / total), 6) AS macro FROM s")
def micro_macro(spark, d):
    m = evaluate.micro_macro(evaluate.accuracy(_predictions(spark, d, "a"), "subject", "gold", "prediction"))
    return m.select("correct", "total", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query(f"""WITH x AS (SELECT answer = {_pred_sql('a')} AS l, answer = {_pred_sql('b')} AS r FROM mcq), c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE l AND r) AS both, count(*) FILTER (WHERE l AND NOT r) AS left_only, count(*) FILTER (WHERE r AND NOT l) AS right_only FROM x)
SELECT *, round(least(1.0, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1), lambda i: exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))))), 9) AS p_value FROM c""")
def paired_mcnemar(spark, d):
    return evaluate.paired(_predictions(spark, d, "a"), _predictions(spark, d, "b"), ["subject", "id"]).withColumn("p_value", F.round("p_value", 9))


@query(f"WITH x AS (SELECT (length(text) - 1) AS n, ({_H('doc_id::VARCHAR', repr('loss'))} % 4000) / 1000.0 AS l FROM documents WHERE length(text) > 1) SELECT sum(n)::BIGINT AS predicted_tokens, round(sum(l * n) / sum(n), 6) AS loss, round(exp(sum(l * n) / sum(n)), 5) AS perplexity FROM x")
def perplexity_weighted(spark, d):
    x = _docs(spark, d).where("length(text) > 1").select((F.length("text") - 1).alias("n"), ((_hash(F.col("doc_id").cast("string"), F.lit("loss")) % 4000) / 1000.0).alias("l"))
    p = evaluate.perplexity(x, F.col("l"), F.col("n"))
    return p.select("predicted_tokens", F.round("loss", 6).alias("loss"), F.round("perplexity", 5).alias("perplexity"))


def _ab(spark, d):
    key = F.col("pref_id").cast("string")
    cols = {}
    for b, text in (("a", "response_rejected"), ("b", "response_chosen")):
        cols[f"{b}_reward"] = (_hash(key, F.lit(b)) % 200) / 100.0
        cols[f"{b}_tokens"] = F.length(F.coalesce(text, F.lit("")))
        cols[f"{b}_terminated"] = F.coalesce(F.col(text).rlike("[。.!！?？]\\z"), F.lit(False))
    return _pref(spark, d, **cols)


_AB = "ab AS (SELECT pref_id, " + ", ".join(f"({_H('pref_id::VARCHAR', repr(b))} % 200) / 100.0 AS {b}_reward, length(coalesce({t},'')) AS {b}_tokens, coalesce(regexp_matches({t}, '[。.!！?？]\\z'), false) AS {b}_term" for b, t in (("a", "response_rejected"), ("b", "response_chosen"))) + " FROM pref)"


@query(f"""WITH {PREF}, {_AB} SELECT count(*) AS samples, round(avg(a_reward),6) AS a_reward_mean, round(avg(b_reward),6) AS b_reward_mean, round(avg(b_reward - a_reward),6) AS reward_delta_mean, count(*) FILTER (WHERE b_reward - a_reward > 1e-6) AS b_wins, count(*) FILTER (WHERE abs(b_reward - a_reward) <= 1e-6) AS ties,
count(*) FILTER (WHERE b_reward - a_reward < -1e-6) AS a_wins, round(avg(a_tokens),6) AS a_mean_tokens, round(avg(b_tokens),6) AS b_mean_tokens, round(avg(a_term::INT),6) AS a_termination_rate, round(avg(b_term::INT),6) AS b_termination_rate FROM ab""")
def ab_summary(spark, d):
    s = evaluate.ab_summary(_ab(spark, d), "a", "b")
    exact = ("samples", "b_wins", "ties", "a_wins")
    return s.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in s.columns])


@query(f"WITH {PREF}, {_AB} SELECT round(avg((b_reward > a_reward)::INT), 6) AS accuracy, round(avg(b_reward - a_reward), 6) AS margin FROM ab")
def preference_metrics(spark, d):
    m = evaluate.preference_metrics(_ab(spark, d), F.col("b_reward"), F.col("a_reward"))
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("margin", 6).alias("margin"))


@query(f"WITH {PREF} SELECT CASE WHEN {S.blank('response_chosen')} THEN -1.0 WHEN length(response_chosen) < 8 THEN -0.4 WHEN length(response_chosen) < 20 THEN -0.1 ELSE 0.0 END::DOUBLE AS guard, count(*) AS n FROM pref GROUP BY 1")
def length_guard(spark, d):
    return _pref(spark, d, guard=evaluate.length_guard(F.col("response_chosen"), F.length("response_chosen"))).groupBy("guard").agg(F.count("*").alias("n"))


_REWARD = f"({_H('pref_id::VARCHAR', repr('b'))} % 200) / 100.0 + 0.1 * (CASE WHEN {S.blank('response_chosen')} THEN -1.0 WHEN length(response_chosen) < 8 THEN -0.4 WHEN length(response_chosen) < 20 THEN -0.1 ELSE 0.0 END)"
_ADVANTAGE = "round(CASE WHEN n > 1 AND sd > 1e-12 THEN (x - m) / sd ELSE 0 END, 6) AS advantage"


def _rewards(spark, d, **columns):
    key = F.col("pref_id").cast("string")
    return _pref(spark, d, r0=(_hash(key, F.lit("b")) % 200) / 100.0, r1=evaluate.length_guard(F.col("response_chosen"), F.length("response_chosen")), **columns)


@query(f"""WITH {PREF}, r AS MATERIALIZED (SELECT pref_id, {S.nospace("coalesce(question, '')")} AS k, {_REWARD} AS x FROM pref), g AS (SELECT k, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM r GROUP BY k)
SELECT pref_id, round(x, 6) AS reward, {_ADVANTAGE} FROM r JOIN g ON g.k = r.k""")
def group_advantage(spark, d):
    """Rewards scaled within the prompt."""
    x = _rewards(spark, d, k=dedup.digest(nospace(F.coalesce("question", F.lit("")))))
    return evaluate.group_scaled(x, "k", [F.col("r0"), F.col("r1")], [1.0, 0.1]).select("pref_id", F.round("reward", 6).alias("reward"), F.round("advantage", 6).alias("advantage"))


@query(f"""WITH {PREF}, r AS MATERIALIZED (SELECT pref_id, split AS k, {_REWARD} AS x FROM pref), g AS (SELECT k, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM r GROUP BY k)
SELECT pref_id, round(x, 6) AS reward, {_ADVANTAGE} FROM r JOIN g ON g.k = r.k""")
def split_advantage(spark, d):
    """Rewards scaled within the split: groups of a third of all rows and more."""
    return evaluate.group_scaled(_rewards(spark, d, k=F.col("split")), "k", [F.col("r0"), F.col("r1")], [1.0, 0.1]).select("pref_id", F.round("reward", 6).alias("reward"), F.round("advantage", 6).alias("advantage"))


# --- readers' limits, fingerprints, identities, branches and scores: the operators that the queries above leave out --------
@query("SELECT conv_id FROM sft_chat WHERE coalesce(len(conversations) >= 2 AND len(list_filter(conversations, lambda t: t IS NULL OR t.role IS NULL OR t.value IS NULL)) = 0, false) ORDER BY conv_id LIMIT 50")
def first_valid_dialogues(spark, d):
    chat = _t(spark, d, "sft_chat").select("conv_id", flags.valid_dialogue(F.col("conversations")).alias("ok"))
    return first_valid(chat, F.col("ok"), 50, "conv_id").select("conv_id")


@query(f"""WITH p AS (SELECT conv_id, split, {_FIRST} AS prompt FROM sft_chat), t AS (SELECT conv_id, 'train' AS split FROM p WHERE split = 'train' ORDER BY sha256('11' || prompt), conv_id LIMIT 100), v AS (SELECT conv_id, 'validation' AS split FROM p WHERE split = 'valid' ORDER BY conv_id LIMIT 40)
SELECT * FROM t UNION ALL SELECT * FROM v""")
def prompt_splits(spark, d):
    """The training prompts of lowest seeded hash, and the head of the validation prompts in their order."""
    p = _t(spark, d, "sft_chat").select("conv_id", F.col("split").alias("s"), reshape.first_turn(F.col("conversations"), reshape.HUMAN).alias("prompt"))
    part = lambda s: p.where(F.col("s") == s).drop("s")
    return sample.split_prompts(part("train"), part("valid"), F.col("prompt"), "conv_id", train_size=100, eval_size=40, seed="11").select("conv_id", "split")


@query("SELECT count(*) AS records, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY item_id)) AS fingerprint FROM heldout_texts")
def ordered_fingerprint(spark, d):
    """The order-dependent hash of a held-out set, which is serial by nature: its rows stream through the driver."""
    held = _t(spark, d, "heldout_texts").select("item_id", "text")
    return held.agg(F.count("*").alias("records")).withColumn("fingerprint", F.lit(sinks.ordered_fingerprint(held, ["item_id"], F.col("text"))))


@query("""WITH i AS (SELECT split, count(*) AS records, max(length(text)) AS longest, count(DISTINCT lang) AS langs FROM heldout_texts GROUP BY split), v AS (SELECT * FROM i WHERE split = 'valid'), t AS (SELECT * FROM i WHERE split = 'test')
SELECT key, l AS left, r AS right, 'values differ' AS problem FROM (SELECT unnest(['records', 'longest', 'langs']) AS key, unnest([v.records, v.longest, v.langs])::VARCHAR AS l, unnest([t.records, t.longest, t.langs])::VARCHAR AS r FROM v, t) WHERE l IS DISTINCT FROM r""")
def identity_differences(spark, d):
    side = lambda s: _t(spark, d, "heldout_texts").where(F.col("split") == s).agg(F.count("*").alias("records"), F.max(F.length("text")).alias("longest"), F.countDistinct("lang").alias("langs"))
    return sinks.identity_differences(side("valid"), side("test"), ["records", "longest", "langs"])


_LE = "printf('%02x%02x%02x0000000000', unicode(c) % 256, (unicode(c) // 256) % 256, unicode(c) // 65536)"


@query(f"""WITH {_DENSE}, w AS (SELECT (o - 1) // 1000 AS batch, string_agg(text || chr(4), '' ORDER BY o) AS a FROM k GROUP BY 1), n AS (SELECT batch, a, unnest(range(length(a) // 256)) AS block FROM w)
SELECT batch, block, sha256(unhex(array_to_string(list_transform(string_split(substr(a, block * 256 + 1, 256), ''), lambda c: {_LE}), ''))) AS sha256 FROM n""")
def packed_block_hashes(spark, d):
    ids = F.concat(tokens.code_points(F.col("text")), F.array(F.lit(4)))
    blocks = tokens.pack_blocks(_kept(spark, d), "ord", ids).withColumn("block", F.col("block").cast("long"))
    return sinks.block_hashes(blocks, "ids", ["batch", "block"])


@query(f"""{_DOC_LINKS(LOOSE_THRESHOLD)}, e AS (SELECT unnest([{', '.join(str(k) for k, _ in MANUAL)}]) AS id) SELECT class_a, class_b, CASE WHEN class_a IN (SELECT id FROM e) OR class_b IN (SELECT id FROM e) THEN 'excluded' ELSE 'kept_for_review' END AS decision FROM links""")
def neardup_decisions(spark, d):
    excluded = spark.createDataFrame(MANUAL, "id long, reason string")
    return neardup.review_decisions(_near_docs(spark, d, LOOSE_THRESHOLD)[1], excluded).select("class_a", "class_b", "decision")


@query(f"""WITH {PREF} SELECT pref_id, 'chosen' AS branch, sha256({S.strip('response_chosen')} || '</s>') AS completion_sha256, length(response_chosen) AS chars FROM pref UNION ALL SELECT pref_id, 'rejected', sha256({S.strip('response_rejected')} || '</s>'), length(response_rejected) FROM pref""")
def response_branches(spark, d):
    """Both responses of a record as rows, each with its end mark."""
    wide = {}
    for b in ("chosen", "rejected"):
        text = F.col(f"response_{b}")
        wide |= {f"{b}_completion_sha256": F.sha2(reshape.completion(text, "</s>"), 256), f"{b}_chars": F.length(text).cast("long")}
    return reshape.branches(_pref(spark, d, **wide), ["pref_id"], ["chosen", "rejected"], ["completion_sha256", "chars"])


@query(f"""WITH {PREF} SELECT source, round((avg(length(response_chosen)) / avg(length(response_rejected)) - 1) * 100, 6) AS percent FROM pref GROUP BY source""")
def length_change(spark, d):
    x = _pref(spark, d, source=F.col("source"), a=F.length("response_rejected"), b=F.length("response_chosen")).groupBy("source").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return x.select("source", F.round(evaluate.percent_change(F.col("a"), F.col("b")), 6).alias("percent"))


_RUN = f"SELECT doc_id, ({_H('doc_id::VARCHAR', repr('loss'))} % 4000) / 1000.0 AS l, {_H('doc_id::VARCHAR', repr('ppl'))} % 9 AS k FROM documents"


@query(f"WITH x AS ({_RUN}), y AS (SELECT doc_id, l, CASE WHEN k = 0 THEN exp(l) * 1.01 WHEN k = 1 THEN NULL ELSE exp(l) END AS p FROM x) SELECT doc_id FROM y WHERE p IS NULL OR abs(exp(l) - p) > 1e-6 * greatest(abs(p), exp(l))")
def inconsistent_perplexities(spark, d):
    key = F.col("doc_id").cast("string")
    x = _docs(spark, d).select("doc_id", ((_hash(key, F.lit("loss")) % 4000) / 1000.0).alias("l"), (_hash(key, F.lit("ppl")) % 9).alias("k"))
    x = x.withColumn("p", F.when(F.col("k") == 0, F.exp("l") * 1.01).when(F.col("k") != 1, F.exp("l")))
    return evaluate.consistency(x, F.col("l"), F.col("p")).select("doc_id")


@query(f"WITH {PREF} SELECT pref_id, round((length(coalesce(response_chosen, '')) + 1.0) / (length(coalesce(question, '')) + 1.0), 6) AS score FROM pref")
def scored_responses(spark, d):
    """The scoring protocol: a function from a batch of inputs to a column of numbers."""
    rows = _pref(spark, d, q=F.length(F.coalesce("question", F.lit(""))), r=F.length(F.coalesce("response_chosen", F.lit(""))))
    return evaluate.scored(rows, ["q", "r"], lambda b: (b.r + 1.0) / (b.q + 1.0)).select("pref_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, length(text)::BIGINT AS ids, CASE WHEN text = '' THEN NULL ELSE unicode(text)::BIGINT END AS first_id FROM documents WHERE text IS NOT NULL")
def tokenized(spark, d):
    """A tokenizer is a batch encoder behind a column function."""
    ids = tokens.with_tokenizer(lambda texts: [list(map(ord, t)) for t in texts])
    x = _docs(spark, d).where("text IS NOT NULL").select("doc_id", ids(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("ids"), F.get("x", F.lit(0)).cast("long").alias("first_id"))
