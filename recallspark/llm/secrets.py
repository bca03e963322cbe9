"""Secret scans over all versions of files, with an incremental ledger of blobs. DataFrame operations only.

A version's text is named by its SHA-256. The ledger holds, for each blob and version of a rule, the spans found (none is
a result, too). A scan finds the blobs that some rule's current version has not seen, reads the text of one version for
each, writes its findings as a new batch of the ledger, and joins the ledger's findings back to all paths.

Every shuffle has small rows but one: the texts of the versions that stand for unseen blobs are found by a join on blob
and path together, so copies of one blob spread over all tasks and only one of them is scanned. If few blobs are new, the
engine broadcasts them under its own size limit and no text moves at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import salted_join


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule; pattern finds matches, leftmost and without overlaps; a match whose group is shorter
    than least characters is dropped. base rules are the scan's contract; the others add to it."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed. A run of the characters of access or hex that is too short can't hold a match
#: of sufficient length, so their least length is part of the pattern; assign drops after matching, as a short match hides what it covers.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("known_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_SPANS = "array<struct<start:long,end:long>>"
_LEDGER = f"blob string, found array<struct<rule:string,spans:{_SPANS}>>"
#: Matches whose lengths are summed up at once.
_PART = 64


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an array (a variable), part by part: work in proportion to its length times _PART, and no shuffle."""
    zero = F.lit(0).cast("bigint")
    nothing = lambda start: F.struct(start.alias("total"), F.array().cast("array<bigint>").alias("sums"))
    last = F.floor((F.size(lengths) - 1) / _PART).cast("int")

    def sums(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, zero, lambda s, x: s + x))
        starts = F.aggregate(whole, nothing(zero), lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["sums"], F.array(s["total"])).alias("sums")))["sums"]
        ends = lambda p, start: F.aggregate(p, nothing(start), lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["sums"], F.array(s["total"] + x)).alias("sums")))["sums"]
        return F.flatten(F.zip_with(parts, starts, ends))

    return _let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(lengths, i * _PART + 1, _PART)), sums)


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text, in order; positions are characters, and end is exclusive."""
    length = lambda x: F.length(x).cast("bigint")

    def spans(x: Column) -> Column:
        # the text after the last match has no match of its own
        lengths = F.zip_with(F.slice(x["between"], 1, F.size(x["whole"])), x["whole"], lambda g, m: length(g) + length(m))
        each = F.zip_with(_let(lengths, _running), x["whole"], lambda end, m: F.struct((end - length(m)).alias("start"), end.alias("end")))
        if not rule.least:
            return each
        judged = F.zip_with(each, x["judged"], lambda s, j: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(j).alias("n")))
        return F.transform(F.filter(judged, lambda s: s["n"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    parts = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"), F.split(text, rule.pattern, -1).alias("between")]
    parts += [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("judged")] if rule.least else []
    return F.when(text.rlike(rule.pattern), _let(F.struct(*parts), spans)).otherwise(F.array().cast(_SPANS))


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) for each row of blobs (blob, text, todo: names of the rules to apply): the spans of each of its rules."""
    found = F.array(*(F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules))
    return blobs.select("blob", F.filter(found, lambda x: x.isNotNull()).alias("found"))


class BlobLedger:
    """A ledger at a path that all executors reach.

    Batches are Parquet folders with names of their own, so a batch that a failed job left unfinished is in nobody's way
    and is not read, and scans at the same time do not collide; what two of them find twice is one finding.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _batches(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(n for n in names if n.startswith("batch-") and done(n))

    def entries(self) -> DataFrame:
        """(blob, found): a row for each blob of each batch."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(*(f"{self.path}/{b}" for b in batches))

    @staticmethod
    def versions(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.select(F.col(path_col).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))

    def unseen(self, versions: DataFrame) -> DataFrame:
        """(blob, first path, todo): the blobs that some rule has not seen, and which rules."""
        blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
        rules = F.array(*(F.lit(r.name) for r in self.rules))
        if not self._batches():
            return blobs.withColumn("todo", rules)
        seen = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found.rule"))).alias("seen"))
        todo = F.when(F.col("seen").isNull(), rules).otherwise(F.array_except(rules, F.col("seen")))
        return blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, docs: DataFrame, path_col: str = "path", text_col: str = "text") -> None:
        """Scans what is unseen in docs, a row for each version, and adds a batch with the findings.

        A null text is an empty one; versions with equal texts, and repeated rows, are one blob; of its versions the one
        with the smallest path is read. A very long text is one row of one task.
        """
        versions = self.versions(docs, path_col, text_col)
        todo = self.unseen(versions).select(F.col("blob").alias("new"), F.col("path").alias("at"), "todo")
        # the null path, if it stands for a blob, is a value like others here
        texts = versions.join(todo, (F.col("blob") == F.col("new")) & F.col("path").eqNullSafe(F.col("at"))).select("blob", "text", "todo")
        # a row that is repeated was read twice, with one finding
        found = find_spans(texts, self.rules).groupBy("blob").agg(F.first("found").alias("found"))
        found.write.mode("errorifexists").parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def _current(self) -> DataFrame:
        """(blob, kind, rank, base, start, end): the spans found by the rules' current versions, each once."""
        rule = F.col("f.rule")
        of = lambda value: F.create_map(*(F.lit(x) for k, r in enumerate(self.rules) for x in (r.name, value(k, r))))[rule]
        each = self.entries().select("blob", F.explode("found").alias("f")).where(rule.isin(*(r.name for r in self.rules)) & (F.size("f.spans") > 0))
        each = each.select("blob", of(lambda _, r: r.kind).alias("kind"), of(lambda k, _: k).alias("rank"), of(lambda _, r: r.base).alias("base"), F.explode("f.spans").alias("s"))
        return each.select("blob", "kind", "rank", "base", "s.start", "s.end").distinct()

    def findings(self, docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """(path, kind, start, end): the spans of all versions of docs by the rules' current versions, for every path that holds the blob. Repeated rows are repeated."""
        spans = self._current().groupBy("blob").agg(F.collect_list(F.struct("kind", "start", "end")).alias("all"))
        versions = self.versions(docs, path_col, text_col).select("path", "blob")
        return salted_join(versions, spans, "blob").select("path", F.inline("all"))

    def report(self, docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """(path, n_<kind> of the base rules..., base, spans): a row for each row of docs; base and spans list kind:start:end by start, then kind as listed.

        A null or empty text has no spans; null and repeated paths are kept as they are; other columns are not read.
        """
        base = [r for r in self.rules if r.base]
        counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in base]
        row = F.struct("start", "rank", "end", "kind")
        listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
        found = self._current().groupBy("blob").agg(*counts, listed(F.collect_list(F.when(F.col("base"), row))).alias("base"), listed(F.collect_list(row)).alias("spans"))
        versions = self.versions(docs, path_col, text_col).select("path", "blob")
        filled = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in base]
        return salted_join(versions, found, "blob", "left").select("path", *filled, *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")))
