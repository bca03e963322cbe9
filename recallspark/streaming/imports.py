"""Import of logs as they grow, and decisions on streams of calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recallspark.operators import ingest
from recallspark.operators.exact import exact_call, with_facts
from recallspark.operators.ranking import first_per_group
from recallspark.sources.embedders import Embedder
from recallspark.sources.records import parsed
from recallspark.sources.tables import SnapshotTable, exact_table, semantic_table


def lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the lines of logs that appear in a folder, with the file of each."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumn("source_path", F.input_file_name())


def distinct_records(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The records of a stream of lines with ended_at as event time; a record_key that comes again within the delay is dropped."""
    rows = stream.select(parsed(F.col("value")).alias("r")).where("r.is_object").select("r.*").withColumn("at", F.coalesce(F.try_to_timestamp("ended_at"), F.current_timestamp()))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["record_key"])


def _records(batch: DataFrame) -> DataFrame:
    """Records of a batch of lines with their order and file; a line that is no JSON is a record with the error of reading it."""
    rows = batch.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("seq"), "source_path", parsed(F.col("value")).alias("r"))
    return rows.where("r.is_object or r.error is not null").select("seq", "source_path", "r.*").drop("is_object")


Report = Callable[[int, dict], None]


def _import(judge: Callable[[DataFrame], DataFrame], entries: Callable[[DataFrame], DataFrame], table: Callable[[SparkSession], SnapshotTable], call: str, report: Report | None):
    """What a batch goes through: judged, added as a delta, reported with the number of broken lines."""

    def write(batch: DataFrame, number: int) -> None:
        rows = _records(batch)
        judged = judge(rows.where("error is null").drop("error"))
        table(batch.sparkSession).append(entries(judged))
        if report is not None:
            report(number, ingest.report(judged, call) | {"broken_lines": rows.where("error is not null").count()})

    return write


def import_exact(stream: DataFrame, table_path: str, checkpoint: str, scope: str = "local", trust_legacy: bool = False, report: Report | None = None) -> DataStreamWriter:
    """A writer that adds each batch of lines to the exact index as a delta; running a batch twice changes nothing.

    report gets each batch's number and report, with the lines that were no JSON counted as broken_lines.
    """
    write = _import(lambda rows: ingest.exact_records(rows, scope, trust_legacy), ingest.exact_entries, lambda spark: exact_table(spark, table_path), "exact", report)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def import_semantic(stream: DataFrame, table_path: str, checkpoint: str, embedder: Embedder, scope: str, trust_legacy: bool = False, report: Report | None = None) -> DataStreamWriter:
    """As import_exact, for the semantic index; each text is embedded once."""
    entries = lambda judged: ingest.semantic_entries(judged, embedder)
    write = _import(lambda rows: ingest.semantic_records(rows, scope, trust_legacy), entries, lambda spark: semantic_table(spark, table_path), "semantic", report)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def decisions(events: DataFrame, entries: DataFrame, scope: str = "local", limit: int = 20) -> DataFrame:
    """A stream of events (query_id, tool_name, tool_input, now) with reusable and record_key: a stream-static join on the key.

    As in the matching of batches, a key's history is its newest entries, successful ones first, cut to limit; the first
    of it decides that is successful, replayable and fresh at the event's own time.
    """
    calls = exact_call(with_facts(events, scope, parts=("key",))).select("query_id", "now", "exact.exact_key", "exact.replayable")
    history = first_per_group(entries, ["exact_key"], [F.desc("success"), F.desc("ended_at"), F.asc("record_key")], limit, "place").where("success and replayable")
    by_key = history.groupBy("exact_key").agg(F.array_sort(F.collect_list(F.struct("place", "record_key", "expires_at_epoch"))).alias("history"))
    found = calls.join(by_key, "exact_key", "left")
    fresh = F.get(F.filter("history", lambda e: e["expires_at_epoch"] > F.col("now")), F.lit(0))["record_key"]
    ok = F.coalesce(F.col("replayable"), F.lit(False)) & fresh.isNotNull()
    return found.select("query_id", ok.alias("reusable"), F.when(ok, fresh).alias("record_key"))
