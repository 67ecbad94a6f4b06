"""Readers for line-delimited JSON, JSON arrays and Parquet by subject; strict and permissive validation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import is_blank, strip
from ..session import cut_lineage

LINE_MODES = {"universal": None, "lf": "\n"}
#: Line ends besides \n and \r that ``splitlines`` mode cuts at.
SPLITLINES = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def dense_ordinals(df: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """1-based ordinals in the order of a column, without one task seeing all rows.

    Rows are range-partitioned and sorted; each partition's count gives the next one's offset (as many counts as
    partitions reach the driver). The ranges are checkpointed, as bounds drawn anew could differ. Nulls come first;
    ties of ``order`` get ordinals in no stated order."""
    by = cut_lineage(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(order)).sortWithinPartitions(order))
    tagged = by.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = {r["_p"]: r["n"] for r in tagged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    table = df.sparkSession.createDataFrame(list(offsets.items()), "_p int, _o long")  # one row per partition
    return tagged.join(F.broadcast(table), "_p").withColumn(name, F.col("_o") + F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33) + 1).drop("_p", "_m", "_o")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over the rows up to their own in the order of a unique column.

    Rows are range-partitioned; the total of each range (one number per partition reaches the driver) is where the next
    one starts. Null values count 0."""
    by = cut_lineage(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(order)).withColumn("_p", F.spark_partition_id()))
    totals = {r["_p"]: r["n"] for r in by.groupBy("_p").agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(totals):
        starts.append((p, total))
        total += totals[p]
    table = df.sparkSession.createDataFrame(starts, "_p int, _o long")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return by.withColumn("_s", own).join(F.broadcast(table), "_p").withColumn(name, F.col("_s") + F.col("_o")).drop("_p", "_s", "_o")


def read_lines(spark: SparkSession, path: str, *, line_mode: str = "universal") -> DataFrame:
    """(ord, line) of one text file, ordinals from 1 and blank lines counted.

    One file is read in splits whose order is that of their offsets. ``splitlines`` also cuts at rarer line ends."""
    if line_mode not in (*LINE_MODES, "splitlines"):
        raise ValueError(f"line_mode must be one of {[*LINE_MODES, 'splitlines']}")
    if line_mode == "splitlines":
        whole = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", f"(?:{SPLITLINES})$", ""))
        return whole.select(F.posexplode(F.split("value", SPLITLINES)).alias("p", "line")).select((F.col("p") + 1).cast("long").alias("ord"), "line")
    sep = LINE_MODES[line_mode]
    lines = spark.read.text(path, lineSep=sep) if sep else spark.read.text(path)
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"))
    return _number(lines)


def _number(lines: DataFrame) -> DataFrame:
    tagged = lines.withColumn("_m", F.monotonically_increasing_id())
    counts = tagged.groupBy("block").agg(F.count("*").alias("n"), F.min("_m").alias("first")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r.block):
        offsets.append((r.block, total - r["first"]))
        total += r.n
    table = lines.sparkSession.createDataFrame(offsets, "block long, _o long")  # one row per split of the file
    return tagged.join(F.broadcast(table), "block").select((F.col("_o") + F.col("_m") + 1).cast("long").alias("ord"), "line")


def _text_field(value: Column, name: str) -> Column:
    """The field as text if it is a JSON string, else null: numbers aren't coerced."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def validate_lines(lines: DataFrame, required: list[str], optional: list[str] = (), *, text: str = "line") -> DataFrame:
    """The lines with their fields as columns and ``error``: bad_json, not_object, missing_field or blank_field, else null.

    Required fields are JSON strings with a non-blank text; optional ones are strings or absent (then '')."""
    parsed = lines.withColumn("_v", F.try_parse_json(text))
    kind = F.schema_of_variant("_v")
    fields = {n: _text_field(F.col("_v"), n) for n in [*required, *optional]}
    present = {n: F.try_variant_get(F.col("_v"), f"$.{n}", "variant") for n in optional}
    error = F.when(F.col("_v").isNull(), "bad_json").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "not_object")
    missing, blank = F.lit(False), F.lit(False)
    for n in required:
        missing, blank = missing | fields[n].isNull(), blank | is_blank(fields[n])
    for n in optional:
        missing = missing | (fields[n].isNull() & present[n].isNotNull())
    error = error.when(missing, "missing_field").when(blank, "blank_field")
    out = parsed.withColumns({n: strip(fields[n]) if n in required else strip(F.coalesce(fields[n], F.lit(""))) for n in fields} | {"error": error})
    return out.drop("_v")


def read_jsonl(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), *, strict: bool = False, line_mode: str = "universal") -> DataFrame:
    """Validated records of a file. Blank lines are skipped but numbered. Strict: the first faulty line raises, with
    its number; permissive: the faulty lines stay, with ``error`` set and their fields as far as they go."""
    rows = validate_lines(read_lines(spark, path, line_mode=line_mode).where(~is_blank(F.col("line"))), required, optional)
    if strict:
        check = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("ord").cast("string"), F.lit(": "), F.col("error")))).otherwise(F.lit(True))
        rows = rows.where(check)
    return rows


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file that is one JSON array, or else one object per line; other roots raise."""
    head = spark.read.text(path, wholetext=True).select(F.schema_of_variant(F.try_parse_json("value")).alias("kind")).first()
    if head is None or head.kind is None:
        return spark.read.schema(schema).json(path)
    if not head.kind.startswith("ARRAY"):
        raise ValueError(f"{path}: expected a list of records, found {head.kind.split('<')[0].lower()}")
    return spark.read.schema(schema).json(path, multiLine=True)


def read_subjects(spark: SparkSession, root: str, subjects: list[str] | None = None) -> DataFrame:
    """Parquet files root/<subject>/*.parquet with the subject as a column; all subjects, or the named ones."""
    paths = [f"{root}/{s}/*.parquet" for s in subjects] if subjects else [f"{root}/*/*.parquet"]
    return spark.read.parquet(*paths).withColumn("subject", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_splits(spark: SparkSession, paths: dict[str, str], keep: list[str]) -> DataFrame:
    """Records of several JSONL files (split name to path) as texts of the kept columns, and ``split``. Other columns are
    never parsed into the result; a kept column that a record lacks is null."""
    schema, out = ", ".join(f"`{c}` string" for c in keep), None
    for name, path in paths.items():
        part = spark.read.schema(schema).json(path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (run, metric, value) of nested result documents, one JSON object per file: every number, named by its path
    with dots; truth values and texts are no metrics, an array's members are named by their place from 0."""
    out = None
    for name, path in paths.items():
        doc = spark.read.text(path, wholetext=True).select(F.lit(name).alias("run"), F.col("value").alias("doc"))
        out = doc if out is None else out.unionByName(doc)
    return out.select("run", F.explode(_metrics("doc")).alias("metric", "value"))


@F.udf(T.MapType(T.StringType(), T.DoubleType()))
def _metrics(text: str) -> dict[str, float]:
    found: dict[str, float] = {}

    def walk(x, at: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{at}.{k}" if at else k)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(v, f"{at}.{k}" if at else str(k))
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            found[at] = float(x)

    walk(json.loads(text), "")
    return found


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame, if it has the columns; else an error that names those it lacks."""
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {lacking}; there are {df.columns}")
    return df


def first_valid(df: DataFrame, valid: Column, n: int, order: str = "ord") -> DataFrame:
    """The first n valid rows in order; all of them for n <= 0."""
    rows = df.where(valid)
    return rows.orderBy(order).limit(n) if n > 0 else rows


def launcher_flags(text: Column) -> Column:
    """Map of --flag to value in a launcher script; a flag without value maps to 'true', the last of a name counts."""
    found = F.regexp_extract_all(text, F.lit(r"--([A-Za-z][\w-]*)(?:[ =]+(?!-)([^\s`\\]+))?"), F.lit(0))
    entries = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"--([A-Za-z][\w-]*)", 1).alias("k"), F.coalesce(F.nullif(F.regexp_extract(s, r"--[\w-]+[ =]+(.+)$", 1), F.lit("")), F.lit("true")).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


__all__ = ["dense_ordinals", "first_valid", "launcher_flags", "read_json_array", "read_jsonl", "read_lines", "read_results", "read_splits", "read_subjects", "require_columns", "running_sum", "validate_lines"]
