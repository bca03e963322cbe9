"""Exact removal of passages that repeat from documents with smaller ids, with a count-min prefilter.

A window is so many consecutive words of one document. Documents are dealt out once, by a hash of id and text, to buckets of
a few MB; the passes below all read that one exchange of the texts, so it is shuffled once.

1. Each bucket makes a count-min sketch of its windows: for each row of the sketch the cells its windows fall in, counting
   documents up to 2. The sketch is as wide as the input asks for (LOAD windows a cell), sparse, sorted, and cut into blocks of
   cells; a block of all buckets' sketches is merged in one task, which tells each bucket which of its cells count 2 or
   more. Nothing is broadcast and nothing saturates: width, blocks and buckets grow with the input.
2. The least count over the rows never falls below the true count, so windows in several documents are never lost. Each
   bucket sends only the windows estimated repeated, with 128-bit hashes of their words and its smallest id for each. They
   are grouped exactly (a window has a row for each bucket at most, however many documents hold it); a bucket gets back
   the windows that start in a smaller document, and drops the words that these cover.

Documents that equal one with a smaller id as a whole send no windows: all of theirs repeat. Two different windows are
taken for one only if two independent 64-bit hashes agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recallspark.llm.common import Scratch, of_texts, release_memory, salted_join, text_bytes
from recallspark.llm.words import mix, run_hashes, word_hashes, words_at

WINDOW = 13
BUCKET_BYTES, BLOCK_WINDOWS = 4 << 20, 4_000_000
#: Rows of the sketch and windows a cell: about (1 - exp(-LOAD)) ** DEPTH of the windows that occur once are estimated repeated.
DEPTH, LOAD = 2, 0.25
#: Bytes a word takes on average at least, to size the sketch.
WORD_BYTES = 6

_U = np.uint64


class Windows:
    """The windows of a bucket's documents: word bounds, the first word and the document of each window, and its hashes."""

    def __init__(self, texts: pa.Array, size: int, skip: np.ndarray, second: bool):
        self.data, self.offsets = text_bytes(texts)
        self.starts, self.ends, self.row = words_at(self.data, self.offsets)
        n = max(0, len(self.row) - size + 1)
        use = (self.row[:n] == self.row[size - 1 :][:n]) & ~skip[self.row[:n]]
        self.first = np.flatnonzero(use)
        self.doc = self.row[self.first]
        self.h1 = self._hashes(0, size)
        self.h2 = self._hashes(1, size) if second else None

    def _hashes(self, which: int, size: int) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, _U)
        return run_hashes(word_hashes(self.data, self.starts, self.ends, which), self.first, size, which)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return mix(hashes + _U(row) * _U(0xD1342543DE82EF95)) >> _U(64 - bits)


def encode_cells(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2 ** 32 as compressed differences."""
    import zstandard

    gaps = np.diff(cells, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def decode_cells(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def sketch_row(hashes: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct cells of windows, one for each document that has it, and which of them count several pairs."""
    cells = np.sort(_cells(hashes, row, bits))
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    at = np.flatnonzero(new)
    return cells[at], np.diff(at, append=len(cells)) > 1


def distinct_pairs(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The hashes in order, each once for every document that has it."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new]


_SIDE = "bucket int, part int, layer int, data binary, h1 long, h2 long, least long, doc long"
_SKETCH = "bucket int, part int, layer int, data binary, several binary"


def _skipped(ids: pa.Array, texts: pa.Array, side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a bucket that send no windows (null ids, and whole copies), and the whole copies: ids with the SHA-256 of the text that the side table names (part -1)."""
    flags = side.filter(pc.equal(side.column("part"), -1))
    null = ids.is_null().to_numpy(zero_copy_only=False)
    copies = np.zeros(len(ids), bool)
    if flags.num_rows:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = set(zip(flags.column("doc").to_pylist(), flags.column("data").to_pylist(), strict=True))
        data, at = text_bytes(texts)
        for k in np.flatnonzero(np.isin(known, flags.column("doc").to_numpy()) & ~null).tolist():
            copies[k] = (int(known[k]), hashlib.sha256(data[at[k] : at[k + 1]]).digest()) in named
    return copies | null, copies


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, load: float = LOAD,
    bucket_bytes: int = BUCKET_BYTES, block_windows: int = BLOCK_WINDOWS, prefix: str = "",
) -> DataFrame:
    """docs with the columns n_words, n_removed and kept_text (after prefix); columns of these names are replaced.

    kept_text has the words that no repeated window covers, joined by single spaces. Ids are integers. A null text has no
    words; a null id neither repeats others nor is repeated; rows with the same id do not repeat each other, whether their
    texts are equal (a repeated row) or not. Of documents that hold a window the smallest id keeps it, so there are no
    ties. A very long text is one document in one bucket. Row order is free.
    """
    names = [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept_text")]
    docs = docs.drop(*names)
    columns = docs.columns
    at_id, at_text = columns.index(id_col), columns.index(text_col)
    home = "__bucket" + "_" * max(map(len, columns))  # no other column has this name

    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.xxhash64(F.col(id_col).cast("long"), text)  # neither an id nor a text that many rows have falls in one bucket
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    brief = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc"), place.alias("place"), F.unhex(F.sha2(text, 256)).alias("same"), F.octet_length(text).alias("n")))
    total = brief.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bits = max(8, math.ceil(math.log2(max(2, total / WORD_BYTES / load))))
    low_bits = min(bits, max(8, math.ceil(math.log2(block_windows / load))))  # cells in a block

    bucket = F.pmod(place, F.lit(buckets)).cast("int")
    dealt = of_texts(docs).select(bucket.alias(home), *(F.col(f"`{c}`") for c in columns))

    known = brief.where("doc is not null").select("doc", "place", "same")
    repeated = known.groupBy("same").agg(F.min("doc").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    copies = salted_join(known, repeated, "same").where("doc > least")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("least", "long"))]
    owner = F.pmod("place", F.lit(buckets)).cast("int").alias("bucket")
    flags = scratch.keep(copies.select(owner, F.lit(-1).alias("part"), F.lit(0).alias("layer"), F.col("same").alias("data"), *nothing, "doc").distinct(), brief)

    def _ids(own: pa.Table) -> np.ndarray:
        return _column(own, columns[at_id]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def sketches(_, own: pa.Table, side: pa.Table) -> pa.Table:
        skip, _ = _skipped(_column(own, columns[at_id]), _column(own, columns[at_text]), side)
        w = Windows(_column(own, columns[at_text]), window, skip, False)
        out: dict[str, list] = {k: [] for k in ("bucket", "part", "layer", "data", "several")}
        if len(w.h1):
            hashes = distinct_pairs(w.h1, _ids(own)[w.doc])
            name = own.column(home)[0].as_py()
            for layer in range(depth):
                cells, several = sketch_row(hashes, layer, bits)
                part = (cells >> _U(low_bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)], strict=True):
                    row = (name, int(part[a]), layer, encode_cells((cells[a:b] & _U((1 << low_bits) - 1)).astype(np.int64)), np.packbits(several[a:b]).tobytes() if several[a:b].any() else None)
                    for k, x in zip(out, row, strict=True):
                        out[k].append(x)
        release_memory()
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "part", "layer") else pa.binary()) for k, v in out.items()})

    def merge(table: pa.Table) -> pa.Table:
        each = [decode_cells(x) for x in table.column("data").to_pylist()]
        count = np.zeros(1 << low_bits, np.uint8)  # up to 2
        for cells, several in zip(each, table.column("several").to_pylist(), strict=True):
            add = np.ones(len(cells), np.uint8)
            if several is not None:
                add += np.unpackbits(np.frombuffer(several, np.uint8), count=len(cells))
            count[cells] = np.minimum(count[cells] + add, 2)
        masks = []
        for cells in each:
            mask = count[cells] > 1
            masks.append(np.packbits(mask).tobytes() if mask.any() else None)
        keep = pa.array([m is not None for m in masks])
        del each, count
        release_memory()
        nulls = pa.nulls(table.num_rows, pa.int64())
        out = [table.column("bucket"), table.column("part"), table.column("layer"), pa.array(masks, pa.binary()), nulls, nulls, nulls, nulls]
        return pa.table(out, names=["bucket", "part", "layer", "data", "h1", "h2", "least", "doc"]).filter(keep)

    def candidates(_, own: pa.Table, side: pa.Table) -> pa.Table:
        skip, _ = _skipped(_column(own, columns[at_id]), _column(own, columns[at_text]), side)
        w = Windows(_column(own, columns[at_text]), window, skip, True)
        told = side.filter(pc.greater_equal(side.column("part"), 0))
        masks = {(p, k): x for p, k, x in zip(told.column("part").to_pylist(), told.column("layer").to_pylist(), told.column("data").to_pylist(), strict=True)}
        likely = np.full(len(w.h1), bool(masks))
        for layer in range(depth if masks else 0):
            of = _cells(w.h1, layer, bits)
            cells, back = np.unique(of, return_inverse=True)
            part = (cells >> _U(low_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            hot = np.zeros(len(cells), bool)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)], strict=True):
                if (x := masks.get((int(part[a]), layer))) is not None:
                    hot[a:b] = np.unpackbits(np.frombuffer(x, np.uint8), count=b - a)
            likely &= hot[back]
        h1, h2 = w.h1[likely].view(np.int64), w.h2[likely].view(np.int64)
        doc = _ids(own)[w.doc[likely]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h1)) - 1 if len(at) else at
        name = own.column(home)[0].as_py()
        del w
        release_memory()
        return pa.table({"bucket": pa.array(np.full(len(at), name), pa.int32()), "h1": h1[at], "h2": h2[at], "low": doc[at], "high": doc[last]})

    def keep(_, own: pa.Table, side: pa.Table) -> pa.Table:
        ids = _column(own, columns[at_id])
        skip, copies = _skipped(ids, _column(own, columns[at_text]), side)
        w = Windows(_column(own, columns[at_text]), window, skip, True)
        told = side.filter(pc.equal(side.column("part"), -2))
        h1, h2, least = (told.column(c).to_numpy() for c in ("h1", "h2", "least"))
        covered = np.zeros(len(w.row) + 1, np.int64)
        if len(h1):
            order = np.lexsort((h2, h1))
            h1, h2, least = h1[order], h2[order], least[order]
            mine = w.h1.view(np.int64)
            at = np.searchsorted(h1, mine)
            doc = _ids(own)[w.doc]
            hit = np.zeros(len(mine), bool)
            while True:  # windows whose first hash is shared by several
                on = (at < len(h1)) & (h1[np.minimum(at, len(h1) - 1)] == mine)
                if not on.any():
                    break
                j = np.minimum(at, len(h1) - 1)
                hit |= on & (h2[j] == w.h2.view(np.int64)) & (least[j] < doc)
                at = np.where(on, at + 1, len(h1))
            np.add.at(covered, w.first[hit], 1)
            np.add.at(covered, w.first[hit] + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        n_words = np.bincount(w.row, minlength=len(ids))
        gone |= (copies & (n_words >= window))[w.row]
        n_gone = np.bincount(w.row, weights=gone, minlength=len(ids)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        data, texts = memoryview(w.data), []
        for k in range(len(ids)):
            a, b = first[k], first[k + 1]
            if n_gone[k] == n_words[k]:
                texts.append(b"")
            elif not n_gone[k]:
                texts.append(b" ".join(bytes(data[w.offsets[k] : w.offsets[k + 1]]).split()))
            else:
                left = ~gone[a:b]
                texts.append(b" ".join([bytes(data[s:e]) for s, e in zip(w.starts[a:b][left].tolist(), w.ends[a:b][left].tolist(), strict=True)]))
        out = own.select([c for c in own.column_names if c != home])
        for name, x in zip(names, (pa.array(n_words, pa.int64()), pa.array(n_gone), pa.array(texts, pa.binary()).cast(pa.string())), strict=True):
            out = out.append_column(name, x)
        del w, texts, data
        release_memory()
        return out

    def by_bucket(side: DataFrame):
        return dealt.groupBy(home).cogroup(side.select("bucket", "part", "layer", "data", "h1", "h2", "least", "doc").groupBy("bucket"))

    sketch = by_bucket(flags).applyInArrow(sketches, _SKETCH)
    masks = sketch.groupBy("part", "layer").applyInArrow(merge, _SIDE)
    found = by_bucket(masks.union(flags.select(*masks.columns))).applyInArrow(candidates, "bucket int, h1 long, h2 long, low long, high long")
    same = Window.partitionBy("h1", "h2")
    repeats = found.withColumn("least", F.min("low").over(same)).where("least < high")
    null = [F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("doc")]
    told = repeats.select("bucket", F.lit(-2).alias("part"), F.lit(0).alias("layer"), "h1", "h2", "least", *null).select(*masks.columns)
    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], LongType())]).add(names[2], "string")
    return by_bucket(told.union(flags.select(*masks.columns))).applyInArrow(keep, schema)
