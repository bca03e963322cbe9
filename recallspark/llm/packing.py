"""Packing of whole tokenised documents into sequences of a fixed length, with non-negative least squares.

A task tokenises its documents and packs them in blocks of some millions of ids, so memory is bounded, nothing is
shuffled and a lost task is simply run again. In a block, full windows are cut off first. What is left of a document is
cut at a multiple of a unit: a body of 1 to 63 units and a crumb of less than one unit. The histogram of the bodies is
packed as in Krell et al. 2021: all shallow combinations of lengths that fill a window exactly are enumerated, their
repeat counts are solved against the histogram by non-negative least squares and rounded down, and the bodies that are
over and the crumbs are packed greedily: bodies largest first into the fullest sequence with room, crumbs into what room
is left. A last sequence that is not full is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import Numbers, of_texts, releasing, small_batches, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
WINDOW, UNIT, DEPTH, END_ID = 4096, 64, 3, 2
#: Ids that are packed together; some hundreds of windows make the rounding negligible.
BLOCK_IDS = 3_000_000
#: Words, and pre-tokens, that a worker's tables hold at most; beyond that those go that were not met again. It changes no result.
MAX_WORDS = 200_000

#: Words of ASCII signs and of Latin letters that lower-case one by one, and their pre-tokens in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ž]+")
#: A full stop or comma that ends a word of such letters or digits is a pre-token of its own.
_STOP = re.compile(rb"[.,](?:(?<=[a-z0-9].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))(?![^ \t\n\x0b\x0c\r])")
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_word_tables: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of words between ASCII white space, which this kind of tokenizer always splits at.

    A word is encoded when it is new to the table: words of plain letters, digits and signs from the ids of their pre-tokens, of which
    new ones go through the library, many in one call; other words through the library as they are.
    """

    def __init__(self, path: str, end_id: int, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.end_id, self.max_words = end_id, max_words
        vocabulary = self.encoder.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        probe = ["a b", "a\tb", "a\n b", "a\r\x0b\x0cb"]
        self.stops = self._encode("ab. cd, é. 1, e.") == self._encode("ab . cd , é . 1 , e .")
        self.by_word = all(self._encode(x) == self._encode("a") + self._encode("b") for x in probe)
        tries = ("it's", "A1b22", "d'un", "Ünd,", "_a_", "x---", "don't!'s", "#1's")
        self.lowers = self._encode("ABCXYZ Q") == self._encode("abcxyz q")
        self.by_part = all(self._by_parts([x.lower()]) == [np.array(self._encode(x), "<u4").tobytes()] for x in self._reset(tries))

    def _reset(self, found=()):
        self.known = Numbers(1)
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.at, self.n = np.zeros(1, np.int64), np.ones(1, np.int64)  # word 0 is the end of a document
        self.ids = np.array([self.end_id], np.uint32)
        self.met = np.zeros(1, np.int64)
        return found

    def _forget(self) -> None:
        """Keeps the words met more than once since the last time, half of what the table may hold at most, and renumbers them."""
        keep = np.flatnonzero(self.met > 1)
        keep = keep[keep > 0]
        if len(keep) > self.max_words // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: self.max_words // 2]])
        names = list(self.known)
        self.known = Numbers(1)
        self.known.update(zip([names[k - 1] for k in keep.tolist()], range(1, len(keep) + 1), strict=True))
        keep = np.concatenate([[0], keep])
        n = self.n[keep]
        after = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[keep] - (after - n), n) + np.arange(after[-1])]
        self.at, self.n, self.met = after - n, n, np.zeros(len(keep), np.int64)

    def _encode(self, text: str) -> list[int]:
        return self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids  # the same ids, without their places in the text

    def _many(self, parts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Ids of pre-tokens: some hundreds of these, their ids one after the other, and where each one's end."""
        for k in range(0, len(parts), 250):
            part = parts[k : k + 250]
            ids = np.array(self._encode(" ".join(part)), np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1  # the last id of a pre-token closes it
            if len(ends) != len(part):
                each = [self._encode(p) for p in part]
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            yield part, ids, ends

    def _by_parts(self, words: list[str]) -> list[bytes]:
        """Ids of plain words in lower case, as bytes."""
        if len(self.parts) > self.max_words // 4:
            self.older, self.parts = self.parts, {}
        known, older, new = self.parts, self.older, {}
        cut = [_PRE_TOKENS.findall(w) for w in words]
        for parts in cut:
            for p in parts:
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                    else:
                        new[p] = None
        for part, ids, ends in self._many(list(new)):
            data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            known.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))
        return [b"".join([known[p] for p in parts]) for parts in cut]

    def _learn(self, words: list[bytes]) -> None:
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")  # no word holds a space
        one, several, odd = [], [], []
        for k, x in enumerate(texts):
            if self.by_part and x.isascii() and x.isalpha():
                one.append(k)
                continue
            plain = self.by_part and _PLAIN.fullmatch(x) and "<|" not in x
            (odd if not plain else one if x.isalpha() else several).append(k)
        at, n, added, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], len(self.ids)
        done = 0
        for part, ids, ends in self._many([texts[k].lower() for k in one]):
            who = one[done : done + len(part)]
            n[who] = np.diff(ends, prepend=0)
            at[who] = size + ends - n[who]
            added.append(ids)
            size, done = size + len(ids), done + len(part)
        each = [np.frombuffer(x, "<u4") for x in self._by_parts([texts[k].lower() for k in several])]
        each += [np.array(self._encode(texts[k]), np.uint32) for k in odd]
        for k, ids in zip(several + odd, each, strict=True):
            n[k], at[k], size = len(ids), size, size + len(ids)
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, *added, *each]).astype(np.uint32, copy=False)
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and how many each text has."""
        if not self.by_word:
            each = [self._encode((x or b"").decode("utf-8", "replace")) + [self.end_id] for x in texts]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        if len(self.known) > self.max_words:
            self._forget()
        words, counts = [], []
        for x in texts:
            if x and self.lowers and b"<|" not in x:  # special tokens are matched before lower-casing
                x = x.lower()
                if self.stops:
                    x = _STOP.sub(rb" \g<0>", x)
            own = x.split() if x else []  # bytes: ASCII letters and white space only
            words += own
            counts.append(len(own))
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        self.met += np.bincount(found, minlength=len(self.met))
        ends = np.cumsum(np.array(counts, np.int64))
        index = np.insert(found, ends, 0)
        n = self.n[index]
        after = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[index] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
        last = after[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)


def words_of(tokenizer: str, end_id: int) -> WordIds:
    if (tokenizer, end_id) not in _word_tables:
        _word_tables[tokenizer, end_id] = WordIds(tokenizer_path(tokenizer), end_id)
    return _word_tables[tokenizer, end_id]


@lru_cache
def combinations(units: int, depth: int) -> np.ndarray:
    """Every multiset of at most depth lengths from 1 to units - 1 that adds up to units; a row holds how often each length occurs."""
    rows = []

    def extend(parts: list[int], left: int, least: int) -> None:
        if left == 0:
            rows.append(np.bincount(parts, minlength=units))
        elif len(parts) < depth:
            for x in range(least, left + 1):
                if x < units and (x == left or len(parts) + 1 < depth):
                    extend([*parts, x], left - x, x)

    extend([], units, 1)
    return np.array(rows, np.float64).reshape(-1, units)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|: the active-set algorithm of Lawson and Hanson."""
    gram, right = a.T @ a, a.T @ b
    n = len(right)
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, right - gram @ x)
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= tolerance:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (s[at] > 0).all():
                x = s
                break
            bad = at[s[at] <= 0]
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = np.maximum(x + step * (s - x), 0)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def repeats(histogram: np.ndarray, units: int, depth: int) -> np.ndarray:
    """How often each of combinations() is used, never more than the histogram holds: the solution rounded down, then filled up greedily."""
    mixes = combinations(units, depth)
    share = np.floor(nnls(mixes.T, histogram.astype(np.float64)) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    used = np.zeros(len(mixes), np.int64)
    need = mixes.astype(np.int64)
    for k in np.argsort(-share, kind="stable"):
        if share[k] <= 0:
            break
        has = need[k] > 0
        used[k] = min(share[k], int((left[has] // need[k][has]).min()))
        left -= used[k] * need[k]
    return used


def pack(lengths: np.ndarray, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Pieces of documents with so many ids: arrays (document, start, length, sequence, offset), each id in exactly one piece.

    Every sequence is full or as long as a power of two, so none is padded.
    """
    lengths = np.asarray(lengths, np.int64)
    units, full = window // unit, lengths // window
    doc = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)) * window
    out = [(doc, start, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    sequences = len(doc)

    rest = lengths - full * window
    bodies, crumbs = rest // unit, rest % unit
    order = np.argsort(bodies, kind="stable")
    order = order[bodies[order] > 0]
    histogram = np.bincount(bodies[order], minlength=units)
    first = np.cumsum(histogram) - histogram  # of each length in order
    taken = np.zeros(units, np.int64)
    mixes, used = combinations(units, depth).astype(np.int64), repeats(histogram, units, depth)
    for k in np.flatnonzero(used):
        offset = 0
        for size in np.flatnonzero(mixes[k]):
            for _ in range(mixes[k][size]):
                who = order[first[size] + taken[size] : first[size] + taken[size] + used[k]]
                taken[size] += used[k]
                out.append((who, full[who] * window, np.full(len(who), size * unit), sequences + np.arange(used[k]), np.full(len(who), offset * unit)))
                offset += size
        sequences += used[k]

    # what the solution leaves: largest first, into the fullest sequence that has room
    room: list[list[int]] = [[] for _ in range(units + 1)]
    at: list[tuple[int, int, int, int, int]] = []
    filled: dict[int, int] = {}
    for size in range(units - 1, 0, -1):
        for who in order[first[size] + taken[size] : first[size] + histogram[size]].tolist():
            fit = next((r for r in range(size, units) if room[r]), None)
            s, r = (room[fit].pop(), fit) if fit else (sequences + len(filled), units)
            offset = units - r
            at.append((who, int(full[who]) * window, size * unit, s, offset * unit))
            filled[s] = (offset + size) * unit
            if r > size:
                room[r - size].append(s)
    sequences += len(filled)

    # crumbs, cut where a sequence is full: first into what room is left, then into sequences of their own
    open_ = [(s, window - n) for s, n in filled.items() if n < window]
    who = np.flatnonzero(crumbs)
    begin = (full * window + bodies * unit)[who]
    size = crumbs[who]
    # a stream of crumbs that fills the rooms in turn: the pieces are cut at the ends of crumbs and of rooms
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    rooms = np.array([n for _, n in open_], np.int64)
    more = max(0, total - int(rooms.sum()))
    rooms = np.concatenate([rooms, np.full(-(-more // window), window)]).astype(np.int64)
    names = np.concatenate([np.array([s for s, _ in open_], np.int64), sequences + np.arange(-(-more // window))]).astype(np.int64)
    sequences += -(-more // window)
    shut = np.cumsum(rooms)
    cuts = np.unique(np.concatenate([[0], ends, shut[shut < total], [total]])).astype(np.int64)
    left, right = cuts[:-1], cuts[1:]
    crumb, place = np.searchsorted(ends, left, side="right"), np.searchsorted(shut, left, side="right")
    if len(left):
        inside = left - (ends - size)[crumb]
        out.append((who[crumb], begin[crumb] + inside, right - left, names[place], window - rooms[place] + left - (shut - rooms)[place]))
    if at:
        out.append(tuple(np.array(x, np.int64) for x in zip(*at, strict=True)))
    document, start, length, sequence, offset = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))

    # sequences that stay short are dealt anew into full windows and, at the end, powers of two
    total = np.bincount(sequence, weights=length, minlength=sequences).astype(np.int64)
    short = (total < window)[sequence]
    if short.any():
        keep = ~short
        d, s, n = document[short], start[short], length[short]
        ends = np.cumsum(n)
        rest = int(ends[-1])
        sizes = [window] * (rest // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (rest % window) >> b & 1]
        shut = np.cumsum(np.array(sizes, np.int64))
        cuts = np.unique(np.concatenate([[0], ends, shut]))
        left, right = cuts[:-1], cuts[1:]
        piece, place = np.searchsorted(ends, left, side="right"), np.searchsorted(shut, left, side="right")
        inside = left - (ends - n)[piece]
        more = (d[piece], s[piece] + inside, right - left, sequences + place, left - (shut - np.array(sizes))[place])
        document, start, length, sequence, offset = (np.concatenate([x[keep], y]) for x, y in zip((document, start, length, sequence, offset), more, strict=True))
        _, sequence = np.unique(sequence, return_inverse=True)
    return document, start, length, sequence, offset


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW,
    unit: int = UNIT, depth: int = DEPTH, block_ids: int = BLOCK_IDS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and the ids themselves on request.

    A document's ids are those of its whole text followed by end_id; a null or empty text has the end id alone, and a very
    long one is cut into many pieces. Rows with a null or repeated doc_id are packed like any others. Lengths that fit
    equally well are taken in the order of the rows. Other columns are not read. sequence_id is unique over the result, with gaps:
    the task's number, the number of its block and of the sequence in that.
    """
    if window & (window - 1) or window % unit:
        raise ValueError("window must be a power of two and a multiple of unit")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, task, block = words_of(tokenizer, end_id), TaskContext.get().partitionId(), 0

        def packed(keys: list[pa.Array], ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            document, start, length, sequence, offset = pack(n, window, unit, depth)
            order = np.lexsort((start, document))
            document, start, length, sequence, offset = (x[order] for x in (document, start, length, sequence, offset))
            first = (np.cumsum(n) - n)[document] + start
            small = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(small[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            key = pa.chunked_array(keys).combine_chunks().take(pa.array(document))
            name = (task << 40) + (block << 24) + sequence
            columns = [key, start, length, np.array(crc, np.int64), n[document], name, offset]
            columns = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            ends = np.cumsum(length)
            k = 0
            while k < len(name):  # rows with about a million ids
                to = max(k + 1, int(np.searchsorted(ends, ends[k] - length[k] + (1 << 20))))
                part = [x[k:to] for x in columns]
                if with_ids:
                    own = np.repeat(first[k:to] - (ends[k:to] - length[k:to] - (ends[k] - length[k])), length[k:to]) + np.arange(ends[to - 1] - ends[k] + length[k])
                    part.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[k:to] - ends[k] + length[k]]), pa.int32()), pa.array(small[own].astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(part, names)
                k = to

        keys, ids, counts, held = [], [], [], 0
        for batch in small_batches(batches, "text", 2 << 20):
            own, n = words(batch.column("text").to_pylist())
            keys.append(batch.column("doc_id"))
            ids.append(own)
            counts.append(n)
            held += len(own)
            if held >= block_ids:
                yield from packed(keys, np.concatenate(ids), np.concatenate(counts))
                keys, ids, counts, held, block = [], [], [], 0, block + 1
        if keys:
            yield from packed(keys, np.concatenate(ids), np.concatenate(counts))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return of_texts(rows).mapInArrow(releasing(run), f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:7]) + ", ids array<int>" * with_ids)
