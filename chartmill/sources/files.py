"""JSONL, JSON, TSV, CSV, TOML, text and KEY=VALUE files: strict and lenient readers, and sinks."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tomllib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Prompt(NamedTuple):
    system: str
    user: str


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that all machines share.

    Unset is an error but where all runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        base = tempfile.mkdtemp(prefix="chartmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/chartmill/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_scratch() -> None:
    """Remove what stands under paths that scratch gave; results that still read it must be written before."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        while _scratch:
            spark, name = _scratch.pop()
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def version_key(name: Column) -> Column:
    """Sorts names as text does, but numbers in them by their value: shard_2 before shard_10."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = lambda x: F.lpad(F.regexp_replace(x, "^0+", ""), 20, "0")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), padded(x)).otherwise(x)), "")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_text(spark: SparkSession, path: str, missing_ok: bool = False) -> str:
    """One whole file; a missing one is empty or an error, as asked."""
    if missing_ok and (not path or not exists(spark, path)):
        return ""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, objects_only: bool = True, numbered: bool = False) -> DataFrame:
    """Rows of a JSON Lines file by an explicit schema; blank lines are skipped.

    strict raises on a line that is not JSON, naming it, and with objects_only on one that is not
    an object; otherwise such lines are left out. numbered adds line_no, from 1, and errors name it:
    that takes a pass over the lines before.
    """
    if numbered:
        lines = with_line_numbers(spark, path).select(F.trim("value").alias("line"), "file", (F.col("line_no") + 1).alias("line_no"))
    else:
        lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.lit(None).cast("bigint").alias("line_no"))
    parsed = lines.filter("line <> ''").withColumn("v", F.try_parse_json("line"))
    bad = F.col("v").isNull()
    if objects_only:
        bad = bad | ~F.startswith(F.col("line"), F.lit("{"))
    if strict:
        where = F.concat(F.col("file"), F.coalesce(F.concat(F.lit(" line "), F.col("line_no").cast("string")), F.lit("")))
        lines = parsed.withColumn("ok", F.when(bad, F.raise_error(F.concat(F.lit("not a JSON row in "), where, F.lit(": "), F.substring("line", 1, 80))).cast("boolean")).otherwise(True)).filter("ok")
    else:
        lines = parsed.filter(~bad)
    told = ["line_no", "row.*"] if numbered else ["row.*"]
    return lines.select("line_no", F.from_json("line", schema).alias("row")).select(*told)


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, without gaps), file and value of a file, or of a folder's files in version order.

    The lines of a block, which one task reads, are numbered as they are read; what stands before a
    block follows from the sizes of all blocks, a row for each. Lines are neither sorted nor moved.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.text(path).select(meta("file_path").alias("path"), meta("file_name").alias("file"), meta("file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"), "value")
    blocks = lines.groupBy("path", "file", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    bases, total = [], 0
    for r in blocks.withColumn("named", version_key(F.col("file"))).orderBy("named", "path", "begin").collect():
        bases.append((r["path"], r["begin"], r["first"], r["n"], total))
        total += r["n"]
    known = spark.createDataFrame(bases, "path string, begin bigint, first bigint, n bigint, before bigint")
    within = F.col("place") - F.col("first")
    changed = F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("path"))).cast("bigint")
    line_no = F.when((within >= 0) & (within < F.col("n")), F.col("before") + within).otherwise(changed)
    return lines.join(F.broadcast(known), ["path", "begin"]).select(line_no.alias("line_no"), "file", "value")


def merged_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """place (from 0) and value of the lines of all files of a pattern, one file after the other in version order."""
    return with_line_numbers(spark, pattern).select(F.col("line_no").alias("place"), "value")


def read_fold_map(spark: SparkSession, base: str, key: str = "id") -> DataFrame:
    """Each id and the fold whose JSON Lines file, in a folder fold=..., holds it; an id in two folds raises."""
    told = read_partitions(spark, base, "fold=*", schema=f"{key} string").groupBy(key).agg(F.min("fold").alias("fold"), F.max("fold").alias("other"))
    one = F.when(F.col("fold") != F.col("other"), F.raise_error(F.concat(F.lit("in two folds: "), F.col(key))).cast("int")).otherwise(F.col("fold"))
    return told.select(key, one.cast("int").alias("fold"))


def read_done_ids(spark: SparkSession, path: str, key: str = "id", strict: bool = False) -> DataFrame:
    """Distinct ids already written; a missing file has none. Lenient reading skips damaged lines."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return read_jsonl(spark, path, f"{key} string", strict=strict).filter(F.col(key).isNotNull()).distinct()


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str, keep_empty: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated rows with a header; the named columns read an empty cell as empty text."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.na.fill("", list(keep_empty)) if keep_empty else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_partitions(spark: SparkSession, base: str, pattern: str, fmt: str = "json", schema: str | None = None) -> DataFrame:
    """Files under seed=.../fold=... folders, with those as columns."""
    reader = spark.read.option("basePath", base)
    return (reader.schema(schema) if schema else reader).format(fmt).load(f"{base}/{pattern}")


def read_registry(spark: SparkSession, runs: dict[str, list[str]], schema: str) -> DataFrame:
    """Predictions of all runs whose files are there, with their condition."""
    out = None
    for condition, paths in runs.items():
        for path in paths:
            if exists(spark, path):
                part = read_jsonl(spark, path, schema).withColumn("condition", F.lit(condition))
                out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no run has its files")
    return out


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=VALUE lines; later ones win."""
    rows = spark.read.text(path).filter(F.contains("value", F.lit("="))).collect()  # a settings file
    return dict(r["value"].strip().split("=", 1) for r in rows)


def prompt_user(text: str) -> str:
    """The user part of a prompt file, also of one that is not sound TOML: its quoted block then."""
    try:
        return parse_prompt(text).user
    except (tomllib.TOMLDecodeError, ValueError):
        found = re.search(r"^\s*user\s*=\s*(\"{3}|'{3})(.*?)\1", text, re.M | re.S)
        if not found or not found[2].strip():
            raise ValueError("no user prompt") from None
        return found[2].rstrip()


def parse_prompt(text: str) -> Prompt:
    """System and user prompt of a TOML text; both must be there."""
    data = tomllib.loads(text)
    for name in ("system", "user"):
        if not isinstance(data.get(name), str) or not data[name].strip():
            raise ValueError(f"no {name} prompt")
    return Prompt(data["system"].rstrip(), data["user"].rstrip())


def prompt_keys(user: str) -> list[str]:
    """Keys that a prompt's user part lists, one per header line."""
    found = re.findall(r"^\s*-\s*JSONキー:\s*(\S+)\s*$", user, re.M)
    if not found:
        raise ValueError("the prompt lists no keys")
    return sorted(set(found))


def prompt_candidates(user: str) -> dict[str, list[str]]:
    """Candidate lists of a prompt's keys; a list may run over several lines and use curly quotes."""
    out: dict[str, list[str]] = {}
    for section in re.split(r"(?m)^(?=\s*-\s*JSONキー:)", user):
        head = re.match(r"\s*-\s*JSONキー:\s*(\S+)", section)
        _, mark, rest = section.partition("候補値:")
        if not head or not mark:
            continue
        depth, end = 0, len(rest)
        for i, c in enumerate(rest):
            depth += (c == "[") - (c == "]")
            if c == "]" and depth == 0:
                end = i + 1
                break
        text = "".join(x.strip() for x in rest[:end].splitlines()).translate(str.maketrans("“”‘’", "\"\"''"))
        values = [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", text)]
        if text.lstrip().startswith("[") and values:
            out[head[1]] = [v.strip() for v in values if v.strip()]
    return out


def schema_candidates(text: str) -> dict[str, list[str]]:
    """Candidate lists of a value schema document."""
    keys = json.loads(text).get("keys")
    if not isinstance(keys, dict):
        raise ValueError("the value schema has no keys")
    return {k: [str(v).strip() for v in rule["allowed_values"] if str(v).strip()] for k, rule in keys.items() if isinstance(rule, dict) and isinstance(rule.get("allowed_values"), list)}


def load_candidates(schema_text: str | None = None, user: str | None = None) -> tuple[dict[str, list[str]], str]:
    """(candidates, where from): a value schema comes before a prompt."""
    if schema_text is not None:
        return schema_candidates(schema_text), "schema"
    if user is not None:
        return prompt_candidates(user), "prompt"
    raise ValueError("neither a value schema nor a prompt")


def read_contexts(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """path, text of context files of any pattern, once each and by path; JSON files are laid out over lines."""

    def laid_out(path: str, text: str) -> str:
        if path.lower().endswith(".json"):
            return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        return text.rstrip()

    raw = spark.read.text(patterns, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").dropDuplicates(["path"]).orderBy("path")
    return raw.select("path", F.udf(laid_out, "string", useArrow=True)("path", "value").alias("text"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, one file per task, committed as a whole; nulls are left out as absent."""
    df.write.mode(mode).json(path)


def write_tsv(df: DataFrame, path: str, digits: int = 6, mode: str = "overwrite") -> None:
    """Tab-separated text with a header and floats to fixed digits."""
    told: list[Column] = [F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    df.select(*told).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def document_json(df: DataFrame) -> str:
    """A one-row result as an indented JSON document."""
    return json.dumps(df.first().asDict(recursive=True), ensure_ascii=False, indent=2, default=str)


def write_document(df: DataFrame, path: str) -> str:
    """Write a one-row result, such as a run's metrics, as an indented JSON document; gives its text."""
    text = document_json(df)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_report(df: DataFrame, path: str, by: list[str], digits: int = 6) -> None:
    """A report table in the order of its columns `by`, as tab-separated text."""
    write_tsv(df.orderBy(*by), path, digits)


def sorted_by_numeric_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows by the id's number; an id that is missing or no number raises. A range shuffle, spilled as needed."""
    number = F.expr(f"try_cast(`{key}` as bigint)")
    bad = F.raise_error(F.concat(F.lit("no numeric id: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("bigint")
    return df.withColumn("_number", F.coalesce(number, bad)).orderBy("_number").drop("_number")


def replace_sorted(df: DataFrame, path: str, key: str = "id") -> None:
    """Write rows in order beside the old folder, then put it in its place.

    The old folder is moved aside before, and deleted only once the new one stands: at every moment
    one of the two is whole. A folder moved aside by a run that was cut off is put back first.
    """
    spark = df.sparkSession
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, aside, new = of(path), of(f"{path}.old"), of(f"{path}.new")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    restore_replaced(spark, path)
    write_jsonl(sorted_by_numeric_id(df, key), f"{path}.new")
    if fs.exists(here) and not fs.rename(here, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, here):
        fs.rename(aside, here)
        raise OSError(f"{path} can't be replaced")
    fs.delete(aside, True)


def restore_replaced(spark: SparkSession, path: str) -> None:
    """Put back what replace_sorted had moved aside when it was cut off."""
    if exists(spark, f"{path}.old"):
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(of(path)):  # the new one stood already
            fs.delete(of(f"{path}.old"), True)
        else:
            fs.rename(of(f"{path}.old"), of(path))
