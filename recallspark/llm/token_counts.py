"""Token counts of whole texts by a SentencePiece model, without making the ids of a text.

A text's pre-tokens are counted, the pieces of each distinct pre-token are counted once by the library, and a document's
count is the sum over its own frequencies joined to these. No piece of the vocabulary holds a space after another
character or a line feed, so no merge crosses the cuts made here; the operator checks this of the model and, where it does
not hold, takes whole texts as they are.

The join is a skew join. Pre-tokens that a sample shows to be frequent, KNOWN_MOST at most, are its hot keys: their counts
go to all tasks as a table of bounded size, where they are added up at once. The frequencies of all others are shuffled
to the distinct pre-tokens, each counted in one place, and their sums back to the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import Scratch, of_texts, releasing, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: One text in so many is looked at for frequent pre-tokens; the most frequent ones, so many at most, are those of the table.
SAMPLE, KNOWN_MOST = 4, 300_000

_SPACE, _MARK = " ", "▁"
_PRE_TOKENS = re.compile(r" +[^ \n]*|\n[^ \n]*")
_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Cuts texts into pre-tokens and counts the pieces of these."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces) and self._as_expected()

    def _as_expected(self) -> bool:
        """Whether the model puts a mark before a text, keeps all spaces and changes no other character."""
        tries = ("a", " a", "a  b", "a ", "\na", "a\n b", " \n ")
        return all(self.model.encode(x) and sum(self.count(p) * n for p, n in self.frequencies(x).items()) == len(self.model.encode(x, num_threads=1)) for x in tries)

    @staticmethod
    def frequencies(text: str) -> Counter:
        return Counter(_PRE_TOKENS.findall(_SPACE + text.replace(_MARK, _SPACE))) if text else Counter()

    def count(self, pre_token: str) -> int:
        if pre_token[0] == _SPACE:  # the library puts a mark before its input; it stands for this space
            return len(self.model.encode(pre_token[1:], num_threads=1)) if len(pre_token) > 1 else 1
        return len(self.model.encode(pre_token, num_threads=1)) - 1  # without the mark before a line feed

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        return sum(self.count(p) * n for p, n in self.frequencies(text).items()) if self.cuts else len(self.model.encode(text, num_threads=1))


def counter(model: str) -> PieceCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(tokenizer_path(model))
    return _counters[model]


def counted(pre_tokens: DataFrame, model: str) -> DataFrame:
    """(p, pieces) for each row (p) of pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            p = batch.column("p")
            yield pa.RecordBatch.from_arrays([p, pa.array([own.count(x) for x in p.to_pylist()], pa.int32())], ["p", "pieces"])

    return pre_tokens.select("p").mapInArrow(releasing(run), "p string, pieces int")


def frequent(texts: DataFrame, model: str, sample: int, most: int) -> dict[str, int]:
    """The pieces of the pre-tokens that are in most texts of a sample, at most so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in small_batches(batches, "text"):
            found: Counter = Counter()
            for x in batch.column("text").to_pylist() if own.cuts else ():
                found.update(own.frequencies(x).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["p", "n"])

    some = of_texts(texts).where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(releasing(run), "p string, n long")
    best = some.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(most)
    found = counted(best, model).toArrow()
    return dict(zip(found.column("p").to_pylist(), found.column("pieces").to_pylist(), strict=True))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = 4096, sample: int = SAMPLE, known_most: int = KNOWN_MOST,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: the UTF-8 bytes and the pieces of the whole text.

    A null or empty text has none of either; a very long one is cut like any other. A null doc_id stays null; repeated
    rows are repeated, each counted by itself; other columns are not read. The counts are those of the library without
    begin and end tokens. Which of equally frequent pre-tokens are in the table changes no count.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent(rows, model, sample, known_most))  # known_most entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = counter(model), shared.value
        for batch in small_batches(batches, "text"):
            sums, ends, tokens, times = [], [0], [], []
            for x in batch.column("text").to_pylist():
                total = 0 if own.cuts else own(x)
                for p, n in own.frequencies(x).items() if own.cuts else ():
                    if (pieces := known.get(p)) is not None:
                        total += pieces * n
                    else:
                        tokens.append(p)
                        times.append(n)
                sums.append(total)
                ends.append(len(tokens))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int32())], ["p", "n"]))
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()), rest]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "known", "rest"])

    kind = dict(rows.dtypes)["doc_id"]
    each = scratch.keep(of_texts(rows).mapInArrow(releasing(run), f"row long, doc_id {kind}, n_bytes long, known long, rest array<struct<p:string,n:int>>"))
    rest = each.select("row", F.inline("rest"))
    pieces = counted(rest.select("p").distinct(), model)
    sums = rest.hint("merge").join(pieces, "p").groupBy("row").agg(F.sum(F.col("n").cast("long") * F.col("pieces")).alias("others"))
    out = each.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    n_tokens = F.col("known") + F.coalesce("others", F.lit(0))
    return out.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
