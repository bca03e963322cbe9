"""Index tables as snapshots of Parquet: readers see whole versions, writers replace them at once."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.operators.semantic import METADATA

EXACT_ENTRY = (
    "record_key string, source_path string, cache_scope string, key_version string, exact_key string, tool_name string, action_kind string, operation_kind string, "
    "canonical_json string, freshness_class string, ttl_seconds long, replayable boolean, replay_policy string, policy_reason string, started_at string, ended_at string, "
    "observed_at_epoch long, expires_at_epoch long, success boolean, status_reason string, tool_input string, tool_response string, response_text string, "
    "response_sha256 string, source_record string, imported_at timestamp"
)
SEMANTIC_ENTRY = (
    "cache_scope string, record_key string, source_path string, semantic_version string, tool_name string, action_kind string, operation_kind string, semantic_text string, "
    f"metadata {METADATA}, embedding_provider string, embedding_index string, embedding array<float>, dimensions int, freshness_class string, ttl_seconds long, started_at string, "
    "ended_at string, observed_at_epoch long, expires_at_epoch long, success boolean, status_reason string, tool_input string, tool_response string, response_text string, "
    "response_sha256 string, imported_at timestamp"
)
EXACT_KEYS, SEMANTIC_KEYS = ("record_key",), ("cache_scope", "record_key", "embedding_provider", "embedding_index")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, and all run in one process, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    at = tempfile.mkdtemp(prefix="recallspark-")
    atexit.register(shutil.rmtree, at, True)
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


#: What a table's layout is called; a table of another layout is refused by readers and made anew by writers.
EXACT_LAYOUT, SEMANTIC_LAYOUT = "exact-v5", "semantic-v3"
#: Deltas that a table has at most before they are merged.
MOST_DELTAS = 8


class StaleTable(ValueError):
    """A table of another layout than the engine's: it has to be rebuilt."""


class SnapshotTable:
    """A table at a path. Each write makes folders of data and then a numbered pointer that lists them; the highest pointer is the table.

    The first folders hold each key once; those after them are deltas, of which a later one replaces keys of those before.
    A job that fails before its pointer leaves the table as it was. One writer at a time: a second one's pointer of the
    same number fails. Files are for their owner only where the file system has modes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], layout: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.keys, self.layout, self.partition_by, self.sort_by = spark, path.rstrip("/"), schema, keys, layout, partition_by, sort_by
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _pointers(self) -> list[str]:
        if not self._fs.exists(self._at("_pointers")):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("_pointers")))

    def _state(self, pointer: str) -> dict:
        stream = self._fs.open(self._at(f"_pointers/{pointer}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "{}")
        finally:
            stream.close()

    def _current(self) -> dict:
        """The highest pointer's state. FileNotFoundError if there is none, StaleTable if it is of another layout."""
        pointers = self._pointers()
        if not pointers:
            raise FileNotFoundError(f"no table at {self.path}")
        state = self._state(pointers[-1])
        if state.get("layout") != self.layout:
            raise StaleTable(f"the table at {self.path} is of layout {state.get('layout')}, not {self.layout}; rebuild it")
        return state

    def exists(self) -> bool:
        return bool(self._pointers())

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """The current snapshot; an error if there is none. Nothing is made by reading."""
        state = self._current()
        rows = reduce(DataFrame.unionByName, map(self._part, state["whole"]))
        if not state["deltas"]:
            return rows
        rows = rows.withColumn("__age", F.lit(0))
        for k, name in enumerate(state["deltas"]):
            rows = rows.unionByName(self._part(name).withColumn("__age", F.lit(k + 1)))
        return self._last(rows, "__age")

    def _last(self, rows: DataFrame, order: str) -> DataFrame:
        """Of rows with one key the last in order."""
        last = Window.partitionBy(*self.keys).orderBy(F.desc(order))
        return rows.withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last", order)

    def _known(self) -> dict:
        """The state that a write starts from: nothing where there is no table, or one of another layout."""
        try:
            return self._current()
        except (FileNotFoundError, StaleTable):
            return {"whole": [], "deltas": []}

    def _write(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at("_pointers"))
        self._mode(self._at(""), "700")
        rows = rows.select(*(x.split()[0] for x in self.spark.createDataFrame([], self.schema).columns))
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.sort_by)  # so that a look-up reads few row groups
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        files = self._fs.listFiles(self._at(name), True)
        while files.hasNext():
            self._mode(files.next().getPath(), "600")
        return name

    def _mode(self, path, mode: str) -> None:
        self._fs.setPermission(path, self._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))

    def _point(self, whole: list[str], deltas: list[str]) -> None:
        pointers = self._pointers()
        number = int(pointers[-1].split(".")[0]) + 1 if pointers else 1
        path = self._at(f"_pointers/{number:08d}.{uuid.uuid4().hex}")
        if any(int(p.split(".")[0]) >= number for p in self._pointers()):
            raise RuntimeError(f"another writer has changed the table at {self.path}")
        stream = self._fs.create(path, False)
        stream.write(bytearray(json.dumps({"layout": self.layout, "whole": whole, "deltas": deltas}).encode()))
        stream.close()
        self._mode(path, "600")

    def replace(self, rows: DataFrame) -> None:
        self._point([self._write(rows)], [])

    def rebuild(self, rows: DataFrame, slice_: Column, order: str = "seq") -> None:
        """Replaces the rows of slice_ by rows, and rows with their keys; of rows with one key the last in order stays.

        rows are computed once, as they are written; what is kept of the table is told from what was written.
        """
        known = self._known()
        new = self._write(self._last(rows, order))
        if not known["whole"]:
            return self._point([new], [])
        kept = self.read().where(~F.coalesce(slice_, F.lit(False))).join(self._part(new).select(*self.keys), list(self.keys), "left_anti")
        self._point([self._write(kept), new], [])

    def append(self, rows: DataFrame, order: str = "seq") -> None:
        """Adds rows as a delta, in work that does not depend on the table's size; of rows with one key the last in order stays. Deltas are merged as they become many."""
        known = self._known()
        new = self._write(self._last(rows, order))
        if not known["whole"]:
            return self._point([new], [])
        self._point(known["whole"], [*known["deltas"], new])
        if len(known["deltas"]) >= MOST_DELTAS:
            self.replace(self.read())

    def vacuum(self, keep: int = 2) -> None:
        """Removes the data of all snapshots but the last ones, and what failed writes left."""
        pointers = self._pointers()
        states = [self._state(p) for p in pointers[-keep:]]
        named = {n for s in states for n in [*s.get("whole", []), *s.get("deltas", [])]}
        for x in self._fs.listStatus(self._at("")):
            name = x.getPath().getName()
            if name.startswith("data-") and name not in named:
                self._fs.delete(x.getPath(), True)
        for p in pointers[:-keep]:
            self._fs.delete(self._at(f"_pointers/{p}"), False)


def exact_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, EXACT_ENTRY, EXACT_KEYS, EXACT_LAYOUT, sort_by=("exact_key",))


def semantic_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, SEMANTIC_ENTRY, SEMANTIC_KEYS, SEMANTIC_LAYOUT, ("cache_scope", "embedding_index", "operation_kind"))
