"""Near-duplicates by SimHash fingerprints, joined with Golay-code keys.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits. If two fingerprints differ in 2 bits at most, then for
one segment of the cycle 1-2, 2-3, 3-1 the first is equal and the second differs in one bit at most. Two words of 23 bits
that differ in one bit share a codeword of the binary Golay code within distance 4 of both: a word lies within 3 of
exactly one codeword, and where that distance is 3, five more codewords lie at distance 4. So each fingerprint has 1 or 6
keys for each pair of segments, made of the first segment and a codeword index of the second: 33 or 34 bits that say
where to look. Fingerprints with a common key are joined and verified; only distinct fingerprints take part, each of
which has at most 2,080 others within 2 bits, so the links stay in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import Scratch, connected_components, of_texts, releasing, small_batches

SHINGLE, SEED, RADIUS = 3, 42, 2
_SHIFTS, _WIDTHS = (0, 22, 43), (22, 21, 21)
#: Generator polynomial of the [23, 12, 7] code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_POLYNOMIAL = 0b101011100011


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number; that of a text without words is 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]])
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number each of whose 64 bits is set if it is in more than half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(1)
def _near_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to 4 in its coset (1 or 6; -1: none), and the syndromes of the 23 single bits."""
    bit = []
    for k in range(23):
        x = 1 << k
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= _POLYNOMIAL << (j - 11)
        bit.append(x)
    table, n = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= bit[p]
            table[syndrome, n[syndrome]] = sum(1 << p for p in places)
            n[syndrome] += 1
    return table, np.array(bit, np.int64)


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all Golay codewords within distance 4 of words of 23 bits: 6 columns, -1 where there is none."""
    table, bit = _near_patterns()
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for k in range(23):
        syndrome ^= np.where(words >> k & 1, bit[k], 0)
    patterns = table[syndrome]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)  # the code is systematic in its upper 12 bits


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of fingerprints (unsigned)."""
    parts = [(fingerprints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(_SHIFTS, _WIDTHS, strict=True)]
    rows, found = [], []
    for k in range(3):
        index = codeword_indices(parts[(k + 1) % 3])
        row, column = np.nonzero(index >= 0)
        rows.append(row)
        found.append(k << 40 | parts[k][row] << 12 | index[row, column])
    return np.concatenate(rows), np.concatenate(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed number. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return of_texts(rows).mapInArrow(releasing(run), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b for all pairs of fingerprints (column fp, each once) that differ in RADIUS bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row].view(np.int64))], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return a.hint("merge").join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable by links, the row's own included.

    Null ids take part with their texts but never name a component (null if a component has no other id). Null and empty
    texts share the fingerprint 0. A very long text has one fingerprint like any other; a bit set in just half of the
    shingles (a tie) is 0. Repeated rows are repeated. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, shingle))
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = connected_components(scratch, links(distinct))
    grouped = distinct.join(near.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = scratch.keep(grouped)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.keep(grouped.join(least, "component").select("fp", "component_id"), grouped, distinct)
    return rows.hint("merge").join(named, "fp").select("doc_id", "fp", "component_id")
