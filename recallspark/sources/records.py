"""The record log: JSON lines of calls and what was observed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from recallspark.functions.batches import in_slices
from recallspark.functions.documents import redact_object
from recallspark.functions.shell import sha256, stable_json

LOG_NAME = "tool_calls.jsonl"
BROKEN = "Invalid JSON"
#: whole_key stands for a record_key that is missing.
RECORD = (
    "error string, is_object boolean, record_key string, whole_key string, execution_source string, source_is_text boolean, legacy_fields boolean, tool_name string, "
    "tool_input string, tool_response string, started_at string, ended_at string, source_record string"
)


def _record(line: str) -> dict:
    out: dict = dict.fromkeys(x.split()[0] for x in RECORD.split(", "))
    try:
        source = json.loads(line)
    except ValueError as e:
        return {**out, "error": str(e), "is_object": False}
    out["is_object"] = isinstance(source, dict)
    if not out["is_object"]:
        return out
    text = lambda k: source[k] if isinstance(source.get(k), str) else None
    part = lambda k: stable_json(source[k]) if isinstance(source.get(k), dict) else None
    origin = source.get("execution_source")
    call = source.get("tool_input")
    kept = {k: v for k, v in source.items() if k not in ("tool_input", "tool_response")}
    kept |= {"tool_input": redact_object(call)} if isinstance(call, dict) else {}
    kept |= {"execution_source": "tool", "origin_record_key": str(source.get("origin_record_key") or source.get("record_key") or "")}
    return out | {
        "record_key": str(source["record_key"]) if source.get("record_key") else None, "whole_key": None if source.get("record_key") else sha256(json.dumps(source, sort_keys=True)),
        "execution_source": None if origin is None else origin if isinstance(origin, str) else repr(origin), "source_is_text": isinstance(origin, str),
        "legacy_fields": all(isinstance(source.get(k), str) for k in ("record_key", "started_at", "ended_at")), "tool_name": text("tool_name"),
        "tool_input": part("tool_input"), "tool_response": part("tool_response"), "started_at": text("started_at"), "ended_at": text("ended_at"), "source_record": stable_json(kept),
    }


def parsed(line: Column) -> Column:
    kind = to_arrow_type(StructType.fromDDL(RECORD))

    @F.arrow_udf(RECORD)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_slices(((lines,) for lines in batches), lambda x: _record(x or "null"), kind)

    return parse(line)


def log_path(path: str, spark: SparkSession) -> str:
    """The log itself, where path is the folder that holds it."""
    jvm = spark.sparkContext._jvm
    inside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{LOG_NAME}")
    fs = inside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path.rstrip('/')}/{LOG_NAME}" if fs.exists(inside) else path


def records_of(lines: DataFrame, fail_fast: bool = True) -> DataFrame:
    """Records of a column value of lines, with seq, their order. Blank lines and values that are no objects are left out.

    A line that is no JSON stops the job (broken_line tells which it was), or, if not fail_fast, is left out as well.
    """
    rows = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(F.monotonically_increasing_id().alias("seq"), parsed(F.col("value")).alias("r"))
    if fail_fast:
        broken = F.raise_error(F.concat(F.lit(f"{BROKEN}: "), F.col("r.error")))
        rows = rows.where(F.when(F.col("r.error").isNotNull(), broken.cast("boolean")).otherwise(F.col("r.is_object")))
    return rows.where("r.is_object").select("seq", "r.*").drop("error", "is_object")


def read_records(spark: SparkSession, path: str, fail_fast: bool = True) -> DataFrame:
    """The records of a log, or of the log in a folder, with source_path."""
    at = log_path(path, spark)
    return records_of(spark.read.text(at), fail_fast).withColumn("source_path", F.lit(at))


def broken_line(spark: SparkSession, path: str) -> str | None:
    """Where a log's first line stands that is no JSON, and why it is none: path:number: reason. For the way out of a failed job only, as it reads the log twice."""
    at = log_path(path, spark)
    rows = spark.read.text(at).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    bad = rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select("part", "id", parsed(F.col("value")).alias("r")).where("r.error is not null")
    first = bad.orderBy("id").select("part", "id", "r.error").first()
    if first is None:
        return None
    before = rows.where(F.col("part") < first["part"]).count()
    return f"{at}:{before + (first['id'] & (1 << 33) - 1) + 1}: {first['error']}"
