"""SentencePiece encoding and decoding in numpy, many words at once.

A text is cut where no piece can cross (before a run of spaces and around a line feed), and each distinct word is encoded once.
Words of equal length form a matrix and advance together. The hash of any substring follows from one running sum over
the row; it is looked up in the sorted keys of the pieces, and a hit is compared character by character.

- best_paths: the Viterbi search of unigram models. At each end position the candidates are the pieces that end there,
  longest first; vectorised maxima of path scores store the start of the best one as backpointer. Scores add up in single
  precision and ties go to the longer last piece, as in the library.
- merged: the merges of BPE models. In each step every word merges the pair of neighbours that makes the piece with the
  highest score, leftmost first, as the library does. A best path is not in general what these merges give, so a BPE
  model's own ids come from here.

Characters without a piece become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import Numbers, of_texts, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: A worker's table of words starts anew beyond so many; that bounds memory and changes no result.
MAX_WORDS = 600_000
#: Longer words go one by one; cells of a matrix of words at most.
LONG, CELLS = 64, 1 << 20

_MARK, _SPACE = "▁", " "
_WORDS = re.compile(r"▁+[^▁\n]*|\n+|[^▁\n]+")
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
#: Low bits of a key that a first look goes by.
_LOW = np.uint64((1 << 20) - 1)
_vocabularies: dict[str, "Vocabulary"] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Vocabulary:
    """The pieces of a model: sorted keys of their characters, scores and ids; its way of encoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.names[i][3:5], 16)] = i
        self.bytes_of = {int(i): b for b, i in enumerate(self.byte_ids.tolist()) if i != self.unknown}
        self.longest = max(len(self.names[i]) for i in plain)
        keys = self._hash_of([self.names[i] for i in plain])
        order = np.argsort(keys)
        self.keys, ids = keys[order], np.array(plain, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.ids = ids
        self.scores = np.array([model.get_score(int(i)) for i in ids], np.float32)
        self.lengths = np.array([len(self.names[i]) for i in ids], np.int64)
        self.spelling = np.zeros((len(ids), self.longest), np.uint32)
        for k, i in enumerate(ids.tolist()):
            self.spelling[k, : len(self.names[i])] = _codes(self.names[i])
        self.maybe = np.zeros(int(_LOW) + 1, bool)
        self.maybe[self.keys & _LOW] = True
        self.gains = np.append(self.scores, np.float32(-np.inf))  # the last one is that of no piece
        self.unknown_score = np.float32(self.scores.min() - np.float32(10))
        spelled = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if model.is_control(i) or model.is_unknown(i) else x.replace(_MARK, _SPACE).encode() for i, x in enumerate(self.names)]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.clear()

    @staticmethod
    def _hash_of(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for k, x in enumerate(texts):
            c = _codes(x).astype(np.uint64)
            out[k] = (_mix(c + np.uint64(1)) * np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(c) - 1), _P)]))[: len(c)]).sum(dtype=np.uint64) + np.uint64(len(c)) if len(c) else 0
        return _mix(out)

    def sums(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the rows' characters, and the inverse powers that bring a difference to position 0."""
        n = rows.shape[1]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _P)]))[:n]
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _PI)]))
        out = np.zeros((len(rows), n + 1), np.uint64)
        np.cumsum(_mix(rows.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=out[:, 1:])
        return out, inverse

    def find(self, rows: np.ndarray, sums: np.ndarray, inverse: np.ndarray, who: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece (its place in the sorted keys, or -1) that is rows[who, start:end], for arrays of these."""
        length = end - start
        key = _mix((sums[who, end] - sums[who, start]) * inverse[start] + length.astype(np.uint64))
        out = np.full(len(key), -1, np.int32)
        hit = np.flatnonzero(self.maybe[key & _LOW])
        at = np.searchsorted(self.keys, key[hit])
        at[at == len(self.keys)] = 0
        same = (self.keys[at] == key[hit]) & (self.lengths[at] == length[hit])
        hit, at = hit[same], at[same]
        same = np.ones(len(hit), bool)
        for k in range(int(length[hit].max(initial=0))):  # character by character
            here = k < length[hit]
            same &= ~here | (rows[who[hit], np.minimum(start[hit] + k, rows.shape[1] - 1)] == self.spelling[at, k])
        out[hit[same]] = at[same]
        return out

    def table(self, rows: np.ndarray) -> np.ndarray:
        """The piece, or -1, of each length (first index) at each start (second) of words of equal length."""
        n, m = rows.shape
        sums, inverse = self.sums(rows)
        out = np.full((min(m, self.longest) + 1, m, n), -1, np.int32)
        for length in range(1, len(out)):
            start = np.repeat(np.arange(m - length + 1), n)
            who = np.tile(np.arange(n), m - length + 1)
            out[length, : m - length + 1] = self.find(rows, sums, inverse, who, start, start + length).reshape(-1, n)
        return out

    def best_paths(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of equal length: for each end position the start of the last piece of the best path there, and that piece (-1: unknown)."""
        longest, m, n = len(table) - 1, *table.shape[1:]
        score = np.full((m + 1, n), -np.inf, np.float32)
        score[0] = 0
        back, piece = np.zeros((m + 1, n), np.int32), np.full((m + 1, n), -1, np.int32)
        for end in range(1, m + 1):
            for length in range(min(end, longest), 0, -1):
                start = end - length
                at = table[length, start]
                gain = self.gains[at]
                path = score[start] + (gain if length > 1 else np.where(at >= 0, gain, self.unknown_score))
                better = path > score[end]
                np.copyto(score[end], path, where=better)
                np.copyto(piece[end], at, where=better)
                back[end][better] = start
        return back.T, piece.T

    def merged(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of words of equal length: the symbols' starts (padded with the length) and their pieces (-1: unknown)."""
        longest, m, n = len(table) - 1, *table.shape[1:]

        def piece_at(who: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits = (b - a <= longest) & (b > a)
            return np.where(fits, table[np.where(fits, b - a, 0), np.minimum(a, m - 1), who], -1)

        starts = np.tile(np.arange(m + 2).clip(max=m), (n, 1))
        pair = np.full((n, m + 1), -np.inf, np.float32)
        if longest > 1:
            pair[:, : m - 1] = self.gains[table[2, : m - 1]].T
        active, place = np.arange(n), np.arange(m + 2)
        while len(active):
            k = pair[active].argmax(axis=1)
            go = pair[active, k] > -np.inf
            active, k = active[go], k[go]
            if not len(active):
                break
            after = place > k[:, None]
            starts[active] = np.take_along_axis(starts[active], np.minimum(place + after, m + 1), axis=1)
            pair[active] = np.take_along_axis(pair[active], np.minimum(place[:-1] + after[:, :-1], m), axis=1)
            for j in (k - 1, k):
                ok = j >= 0
                who, left = active[ok], j[ok]
                real = starts[who, left + 1] < m
                at = piece_at(who, starts[who, left], starts[who, np.minimum(left + 2, m + 1)])
                pair[who, left] = np.where(real, self.gains[at], np.float32(-np.inf))
        a, b = starts[:, :-1], starts[:, 1:]
        piece = np.full(a.shape, -1, np.int32)
        who, col = np.nonzero(a < b)
        piece[who, col] = piece_at(who, a[who, col], b[who, col])
        return starts, piece

    def long_word(self, word: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(end, piece) of the best path and of the merges of one word of any length, with work in proportion to it."""
        m = len(word)
        found: list[list[tuple[int, int]]] = [[] for _ in range(m + 1)]  # by end: (length, piece), longest first
        step = CELLS // 16
        for a in range(0, m, step):
            part = self.table(_codes(word[a : a + step + self.longest])[None, :])[:, :step, 0]
            for length, k in zip(*(x.tolist() for x in np.nonzero(part >= 0)), strict=True):
                found[a + k + length].append((length, int(part[length, k])))
        score, back = [np.float32(0)] * (m + 1), [(0, -1)] * (m + 1)
        for end in range(1, m + 1):
            top = None
            for length, at in sorted(found[end], reverse=True):
                path = score[end - length] + self.scores[at]
                if top is None or path > top:
                    top, back[end] = path, (end - length, at)
            if not any(length == 1 for length, _ in found[end]) and (top is None or score[end - 1] + self.unknown_score > top):
                top, back[end] = score[end - 1] + self.unknown_score, (end - 1, -1)
            score[end] = top
        best, end = [], m
        while end:
            best.append((end, back[end][1]))
            end = back[end][0]

        at = {(end - length, end): p for end in range(1, m + 1) for length, p in found[end]}
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))  # of the symbol that starts here
        stop = [k + 1 for k in range(m)]
        heap = [(-float(self.scores[p]), a, b) for (a, b), p in at.items() if b - a == 2]
        heapq.heapify(heap)
        while heap:
            _, a, b = heapq.heappop(heap)
            mid = stop[a]
            if mid <= a or mid >= m or stop[mid] != b or mid == b:
                continue  # one of the two is part of another symbol by now
            stop[a], stop[mid] = b, -1
            after[a] = b
            if b < m:
                before[b] = a
                if (p := at.get((a, stop[b]))) is not None:
                    heapq.heappush(heap, (-float(self.scores[p]), a, stop[b]))
            if (c := before[a]) >= 0 and (p := at.get((c, b))) is not None:
                heapq.heappush(heap, (-float(self.scores[p]), c, b))
        own, a = [], 0
        while a < m:
            own.append((stop[a], at.get((a, stop[a]), -1)))
            a = stop[a]
        return best[::-1], own

    def _spelled(self, word: str, ends: list[int], pieces: list[int]) -> np.ndarray:
        """Ids of pieces that end at these places of a word; what is unknown is spelled in bytes."""
        out: list[int] = []
        for a, b, p in zip([0, *ends], ends, pieces):
            out += [int(self.ids[p])] if p >= 0 else self.byte_ids[np.frombuffer(word[a:b].encode("utf-8", "replace"), np.uint8)].tolist()
        return np.array(out, np.int64)

    def _ids(self, words: list[str], ends: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has, from matrices of the ends of pieces in order (0: none) and the pieces."""
        used = ends > 0
        flat, n = self.ids[pieces[used]], used.sum(axis=1)
        odd = np.flatnonzero((used & (pieces < 0)).any(axis=1)).tolist()
        if odd:
            each = np.split(flat, np.cumsum(n)[:-1])
            for i in odd:
                each[i] = self._spelled(words[i], ends[i][used[i]].tolist(), pieces[i][used[i]].tolist())
            flat, n = np.concatenate(each), np.array([len(x) for x in each])
        return flat, n

    def learn(self, words: list[str]) -> None:
        """Encodes new words, in which spaces are marks already, in batches of equal length, and numbers them in the order given."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        at, n = np.zeros((2, len(words)), np.int64), np.zeros((2, len(words)), np.int64)
        parts, size = ([], []), [len(self.store[0]), len(self.store[1])]

        def keep(mode: int, who: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
            parts[mode].append(flat)
            n[mode, who] = counts
            at[mode, who] = size[mode] + np.cumsum(counts) - counts
            size[mode] += len(flat)

        k = 0
        while k < len(order):
            m = int(lengths[order[k]])
            if m > LONG:
                for mode, path in enumerate(self.long_word(words[order[k]])):
                    flat = self._spelled(words[order[k]], [e for e, _ in path], [p for _, p in path])
                    keep(mode, order[k : k + 1], flat, np.array([len(flat)]))
                k += 1
                continue
            to = min(int(np.searchsorted(lengths[order], m, side="right")), k + max(1, CELLS // (m * m + 1)))
            who = order[k:to]
            part = [words[i] for i in who.tolist()]
            table = self.table(_codes("".join(part)).reshape(len(part), m))
            back, piece = self.best_paths(table)
            on, end, everyone = np.zeros((len(part), m), np.int64), np.full(len(part), m), np.arange(len(part))
            last = np.full((len(part), m), -1, np.int64)
            while end.any():  # each path back from its end; a piece stands where it ends
                live = everyone[end > 0]
                e = end[live]
                on[live, e - 1], last[live, e - 1] = e, piece[live, e]
                end[live] = back[live, e]
            keep(0, who, *self._ids(part, on, last))
            starts, symbol = self.merged(table)
            keep(1, who, *self._ids(part, np.where(starts[:, :-1] < starts[:, 1:], starts[:, 1:], 0), symbol))
            k = to
        for mode in (0, 1):
            self.n[mode], self.at[mode] = np.concatenate([self.n[mode], n[mode]]), np.concatenate([self.at[mode], at[mode]])
            self.store[mode] = np.concatenate([self.store[mode], *parts[mode]])

    def clear(self) -> None:
        self.words = Numbers()
        none = np.zeros(0, np.int64)
        self.n, self.at, self.store = [none, none], [none, none], [none, none]

    def encode(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """By best paths, and by merges: the ids of all texts, one after the other, and how many each has. A mark stands before a text that isn't empty, and for each space."""
        if len(self.words) > MAX_WORDS:
            self.clear()
        words, counts = [], []
        for x in texts:
            own = _WORDS.findall((_SPACE + x).replace(_SPACE, _MARK)) if x else []
            words += own
            counts.append(len(own))
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            self.learn(self.words.new)
            self.words.new = []
        ends = np.cumsum(np.array(counts, np.int64))
        out = []
        for mode in (0, 1):
            n = self.n[mode][index] if len(index) else index
            after = np.concatenate([[0], np.cumsum(n)])
            flat = self.store[mode][np.repeat(self.at[mode][index] - after[:-1], n) + np.arange(after[-1])] if len(index) else index
            out.append((flat, np.diff(after[ends], prepend=0)))
        return out[0], out[1]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes of ids; marks are spaces, byte pieces their bytes, control pieces nothing."""
        n = self.size[ids]
        after = np.cumsum(n)
        return self.letters[np.repeat(self.first[ids] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the mark before it."""
        text = self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(_SPACE) else text


def vocabulary(model: str) -> Vocabulary:
    if model not in _vocabularies:
        _vocabularies[model] = Vocabulary(tokenizer_path(model))
    return _vocabularies[model]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """For each row: doc_id, n_pieces and ids_crc32 of the best path's ids, n_merged and merged_crc32 of the merges' ids, and
    whether both decode to the text (marks in it read as spaces); on request the ids, too.

    A null or empty text has no ids and decodes to itself. A null doc_id stays null; repeated rows are repeated; other
    columns are not read. crc32 is that of the ids as little-endian unsigned 32-bit numbers.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "n_merged", "merged_crc32", "decodes"] + ["ids", "merged_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            columns, same = [batch.column("doc_id")], np.ones(len(texts), bool)
            wanted = [(_SPACE + x).replace(_MARK, _SPACE).encode() if x else b"" for x in texts]
            lists = []
            for ids, n in own.encode(texts):
                small, ends = ids.astype("<u4"), np.cumsum(n)
                bounds = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                columns += [pa.array(n, pa.int64()), pa.array([zlib.crc32(small[a:b]) for a, b in bounds], pa.int64())]
                lists.append([ids[a:b] for a, b in bounds])
                letters, size = own.decode_bytes(ids), np.concatenate([[0], np.cumsum(own.size[ids])])
                same &= [letters[size[a] : size[b]].tobytes() == w for (a, b), w in zip(bounds, wanted, strict=True)]
            columns.append(pa.array(same, pa.bool_()))
            if with_ids:
                columns += [pa.array(x, pa.list_(pa.int64())) for x in lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{x} long" for x in names[1:5]) + ", decodes boolean" + ", ids array<long>, merged_ids array<long>" * with_ids
    return of_texts(rows).mapInArrow(run, schema)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"))
    return of_texts(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
