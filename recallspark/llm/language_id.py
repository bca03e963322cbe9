"""Language identification with bit-sliced Bloom filters of letter n-grams.

One table of slots holds a bitmask of languages in each slot; a language's filter is its bit over all slots. An n-gram
selects a few slots, and the conjunction of their masks names all languages that (may) contain it at once. Over a text,
the popcounts by language are corrected for each filter's rate of false positives; the largest decides.

The filters are learned from a bounded sample of labelled rows: PER_LANGUAGE rows of a language, one for each slot of a
hash of id and text, and of each the first SAMPLE_CHARS characters of its letters (runs of others are one space). Filters
have a fixed size for each language. Prediction reads whole texts in the scan's own tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from recallspark.llm.common import Scratch, of_texts, releasing, small_batches

SIZES = (3, 4)
PER_LANGUAGE, SAMPLE_CHARS = 512, 16_000
#: n-grams of a language that its filter holds at most, and slots; two slots an n-gram.
TOP, SLOT_BITS = 20_000, 19
#: An n-gram is a language's own if its share there is at least so much of its largest share in any language.
OWN_SHARE = 0.1
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts and the row of each. Texts are lower-cased and runs of other characters than letters count as one space, which an n-gram may hold at either end only."""
    lower = [(x or "").lower() for x in texts]
    n = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    points = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    row = np.repeat(np.arange(len(lower), dtype=np.int32), n)
    row = np.concatenate([row[:1], row])[keep] if len(row) else np.zeros(1, np.int32)
    letter = letter[keep]
    code = np.where(letter, points[keep], 32).astype(np.uint64)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(32)
    hashes, rows = [], []
    for size in SIZES:
        m = len(code) - size + 1
        if m <= 0:
            continue
        inner = letter[1 : 1 + m].copy()
        for k in range(2, size - 1):
            inner &= letter[k : k + m]
        at = np.flatnonzero(inner)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += code[at + k]
        h ^= h >> np.uint64(29)
        hashes.append(h)
        rows.append(row[at + 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class LanguageFilters:
    """languages in order; planes of slots with the bits of eight languages each; the rate of false positives of each language."""

    languages: list[str]
    planes: np.ndarray
    false_rate: np.ndarray
    slot_bits: int = SLOT_BITS

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slot_bits: int = SLOT_BITS) -> LanguageFilters:
        languages = sorted(grams)
        planes = np.zeros((-(-len(languages) // 8), 1 << slot_bits), np.uint8)
        for k, name in enumerate(languages):
            for slots in cls._slots(grams[name].astype(np.uint64), slot_bits):
                planes[k // 8][slots] |= np.uint8(1 << k % 8)
        fill = np.array([((planes[k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
        return cls(languages, planes, fill**2, slot_bits)

    @staticmethod
    def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return hashes & mask, (hashes >> np.uint64(64 - bits)) ^ ((hashes >> np.uint64(20)) & mask)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, `und` for one without a letter (or if no language was learned), and the part of its n-grams that the language's filter explains."""
        hashes, rows = _grams(texts)
        total = np.bincount(rows, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        first, second = self._slots(hashes, self.slot_bits)
        counts = []
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        for plane in self.planes:
            found = plane[first] & plane[second]
            counts.append(np.bincount(rows.astype(np.int64) * 256 + found, minlength=len(texts) * 256).reshape(-1, 256) @ bits)
        counts = np.concatenate(counts, axis=1)[:, : len(self.languages)]
        share = (counts / np.maximum(total, 1)[:, None] - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = share.argmax(axis=1)  # ties: the first name
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist(), strict=True)], np.where(total > 0, score, 0.0)


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, chars: int, scratch: Scratch) -> DataFrame:
    """(lang, text): at most per_language rows of each language, whatever ids or rows are repeated, with at most so many characters each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("order", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    slots = rows.groupBy("lang", F.pmod("order", F.lit(per_language)).alias("slot")).agg(F.min("order").alias("order"))
    slots = scratch.keep(slots)  # its size is known to the engine then, which broadcasts it if that is small
    letters = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, chars)
    found = rows.join(slots, ["lang", "order"], "leftsemi").select("lang", "order", letters.alias("text"))
    return found.dropDuplicates(["lang", "order"]).select("lang", "text")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
    chars: int = SAMPLE_CHARS, top: int = TOP, slot_bits: int = SLOT_BITS,
) -> LanguageFilters:
    """Filters of the languages that label rows of docs; rows with a null id, text or label are not learned from.

    The sample's bound is per_language * chars for each language; repeated rows count once, and of a very long text a part
    is taken. Shares of n-grams are computed by the engine; the driver gets what the filters hold, top n-grams of a
    language, ties in order of their hashes.
    """
    scratch = Scratch(docs.sparkSession, "language-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            names = batch.column("lang").to_pylist()
            hashes, row = _grams(batch.column("text").to_pylist())
            known = sorted(set(names))
            of = np.array([known.index(x) for x in names], np.int64)[row]
            for k, name in enumerate(known):
                gram, n = np.unique(hashes[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = sampled(docs, id_col, text_col, lang_col, per_language, chars, scratch)
    counts = scratch.keep(of_texts(rows).mapInArrow(releasing(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.withColumn("largest", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= OWN_SHARE * F.col("largest"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = shares.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram").toArrow()
    names, grams = best.column("lang").to_numpy(zero_copy_only=False), best.column("gram").to_numpy().view(np.uint64)
    scratch.drop(counts)
    return LanguageFilters.build({name: grams[names == name] for name in sorted(set(names.tolist()))}, slot_bits)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns lang_pred and score (after prefix); columns that have these names already are replaced.

    Null and empty texts and those without a letter get `und` and 0. Languages that explain equal parts of a text are a tie
    that the first name wins. Every row is judged on its own whole text, however long: repeated rows get the same
    answer, and ids are not looked at.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: 2**SLOT_BITS bytes for each eight languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col, 1 << 20):
            lang, score = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return of_texts(docs).mapInArrow(releasing(run), schema)


def in_training(id_col: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, mod 3, is not 1. A null id is among the held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))
