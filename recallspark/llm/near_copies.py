"""Near copies by the exact Jaccard similarity of their word shingles.

A text's set holds 64-bit hashes of all runs of SHINGLE words (ASCII letters lower-cased, ASCII white space); a shorter text
is one run. Equal sets count as one. Candidates come from two sides and are verified with their whole sets:

- SimHash: fingerprints of the sets, joined with Golay-code keys as in the module simhash. Most copies with few changes are
  found here, but at a similarity of 4/5 two fingerprints of 64 bits differ in about 10 bits, more than any such keys reach.
- Prefix filtering, which loses nothing: two sets of similarity 4/5 or more have at least 4/5 of the larger one in common,
  so in any order that all sets share, their first n - ceil(4n/5) + 1 members have one in common. The order puts members
  that a sample of the texts shows to be frequent last, which bounds the work, not the result. Of the sets with a common
  member in places that leave room for enough others, each is a candidate with some of them, the pivots, first, so a large
  group of copies costs pairs in proportion to its sets; then all pairs are candidates that are not yet in one component.

Most candidates are unlike, and a whole set is a large thing to send, so a pair first passes a sketch of a bit or two for a
member: the parities of the members in each place of a bitmap. Two of these differ in at most as many places as the sets have
members that are not common, so what differs in too many is no near copy, and nothing is lost.

Verification deals the candidates' sets out to buckets of a few MB. A set that others are compared with goes once to each
bucket that needs it, however many of its partners are there, so a set that half of all others resemble is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm import simhash
from recallspark.llm.common import Scratch, connected_components, of_texts, release_memory, releasing, salted_join, shuffles_removed, small_batches, text_bytes
from recallspark.llm.words import mix, word_hashes, words_at

SHINGLE = 5
#: One text in so many is looked at for frequent members; those in FREQUENT or more of them come last, FREQUENT_MOST at most.
SAMPLE, FREQUENT, FREQUENT_MOST = 16, 3, 100_000
#: Rounds in which sets are compared with pivots after the first, and pivots of a key in these; a bitmap's size; bytes of a bucket of sets.
PIVOT_ROUNDS, PIVOTS, SLOT_BITS, BUCKET_BYTES = 1, 8, 23, 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles in order, text after text, and offsets (rows + 1). A text without words has none."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, row = words_at(data, offsets)
    words = word_hashes(data, starts, ends, 0)
    n_words = np.bincount(row, minlength=len(texts))
    last = np.cumsum(n_words)[row]  # the word after the text's last one
    at = np.arange(len(row))
    at = at[(at + size <= last) | ((n_words[row] < size) & (at == last - n_words[row]))]
    length = np.minimum(last[at] - at, size)
    hashes = length.astype(np.uint64)
    for k in range(size):
        more = mix(hashes * np.uint64(0xD6E8FEB86659FD93) + words[np.minimum(at + k, max(0, len(words) - 1))])
        hashes = np.where(k < length, more, hashes)
    row, hashes = row[at], hashes.view(np.int64)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(texts)))])


def _names(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _lists(hashes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()), mask=None if null is None else pa.array(null))


def _parities(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bitmap for each set, of 64 bits or the power of two that is n or more: the parity of the number of members whose last bits name the place."""
    n = np.diff(offsets)
    size = np.array([max(64, 1 << (k - 1).bit_length()) for k in np.maximum(n, 1).tolist()], np.int64)
    ends = np.cumsum(size)
    place = (hashes & np.repeat(size - 1, n)) + np.repeat(ends - size, n)
    bits = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[a:b] for a, b in zip((ends - size >> 3).tolist(), (ends >> 3).tolist(), strict=True)]


def _differing(a: bytes, b: bytes) -> int:
    """In how many places two such bitmaps differ, the longer one folded to the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = x >> size ^ x & (1 << size) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _frequent(texts: DataFrame) -> np.ndarray:
    """Members that a sample of the texts shows to be frequent, FREQUENT_MOST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            hashes, offsets = shingle_sets(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            names = _names(hashes, offsets)
            _, first = np.unique(names, return_index=True)
            own, n = np.unique(hashes[np.isin(row, first)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n, pa.int64())], ["gram", "n"])

    some = of_texts(texts).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(releasing(run), "gram long, n long")
    found = some.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(FREQUENT_MOST)
    with shuffles_removed(texts.sparkSession):
        return np.sort(found.select("gram").toArrow().column(0).to_numpy().astype(np.int64))


def _heads(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, same, fp, n, sim, bits, head) for each row: its set's name, size, fingerprint and bitmap, and the members of it that no near copy can be without (null where the task has had the set before)."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, had = shared.value, set()
        for batch in small_batches(batches, "text", 1 << 20):
            hashes, offsets = shingle_sets(batch.column("text"))
            n, names = np.diff(offsets), _names(hashes, offsets)
            fresh = np.zeros(len(n), bool)
            for k, name in enumerate(names.tolist()):
                fresh[k] = name not in had
                had.add(name)
            row = np.repeat(np.arange(len(n)), n)
            known = np.searchsorted(late, hashes)
            is_late = late[np.minimum(known, len(late) - 1)] == hashes if len(late) else np.zeros(len(hashes), bool)
            ordered = hashes[np.argsort(2 * row + is_late, kind="stable")]
            take = np.where(fresh & (n > 0), n - (4 * n + 4) // 5 + 1, 0)
            head = ordered[np.arange(len(ordered)) - offsets[row] < take[row]]
            sims = np.array([simhash.majority(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            columns = [batch.column("doc_id"), batch.column("same"), pa.array(names), pa.array(n, pa.int32()), pa.array(sims.view(np.int64)), pa.array(_parities(hashes, offsets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(head, np.concatenate([[0], np.cumsum(take)]), take == 0)], ["doc_id", "same", "fp", "n", "sim", "bits", "head"])

    return of_texts(rows).mapInArrow(releasing(run), f"doc_id {dict(rows.dtypes)['doc_id']}, same long, fp long, n int, sim long, bits binary, head array<long>")


def _enough(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m members with so many in common are similar by 4/5 or more."""
    return 9 * common.cast("long") >= 4 * (n.cast("long") + m.cast("long"))


def _room(a: Column, b: Column) -> Column:
    """Whether two sets (n, pos) with a common member at these places may have enough others after it."""
    return _enough(F.least(a["n"] - a["pos"], b["n"] - b["pos"]), a["n"], b["n"])


def _slots(reps: DataFrame) -> np.ndarray:
    """A bitmap of a fixed size with a bit for the slot of each rep; what shares a slot passes it, too, and goes later."""
    slot = F.pmod(F.col("rep"), F.lit(1 << SLOT_BITS))
    parts = reps.groupBy(F.shiftright(slot, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(slot % (1 << 15)).alias("bits")).collect()
    found = np.zeros(1 << SLOT_BITS, bool)
    for r in parts:
        found[r["part"] << 15 : r["part"] + 1 << 15] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return np.packbits(found)


def _likely(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those pairs (m, p) of names whose sizes and bitmaps don't tell that their sets are no near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "bits", "n_p", "bits_p")), strict=True)
            keep = [9 * min(n, k) >= 4 * (n + k) and 9 * _differing(a, b) <= n + k for n, a, k, b in rows]
            yield batch.select(["m", "p"]).filter(pa.array(keep, pa.bool_()))

    sets = distinct.select("fp", "n", "bits")
    own = sets.join(pairs.select(F.col("m").alias("fp")).distinct(), "fp").withColumnRenamed("fp", "m")
    other = sets.join(pairs.select(F.col("p").alias("fp")).distinct(), "fp").select(F.col("fp").alias("p"), F.col("n").alias("n_p"), F.col("bits").alias("bits_p"))
    return of_texts(salted_join(pairs.hint("merge").join(own, "m"), other, "p")).mapInArrow(releasing(run), "m long, p long")


def _near(scratch: Scratch, pairs: DataFrame, distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """Those pairs (m, p) of names whose sets are near copies."""
    spark = rows.sparkSession
    named = pairs.select(F.col("m").alias("fp")).union(pairs.select(F.col("p").alias("fp"))).distinct()
    reps = scratch.keep(distinct.select("fp", "n", "rep").join(named, "fp"))
    members = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(8 * members / BUCKET_BYTES))
    wanted = spark.sparkContext.broadcast(_slots(reps))
    scratch.drop(reps)
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, had = wanted.value, set()
        for whole in batches:
            slot = whole.column("rep").to_numpy() & ((1 << SLOT_BITS) - 1)
            whole = whole.filter(pa.array((bits[slot >> 3] << (slot & 7).astype(np.uint8) & 128).astype(bool)))
            for batch in small_batches([whole], "text", 1 << 20):
                hashes, offsets = shingle_sets(batch.column("text"))
                names = _names(hashes, offsets)
                fresh = [k for k, x in enumerate(names.tolist()) if not (x in had or had.add(x))]
                data = [hashes[offsets[k] : offsets[k + 1]].tobytes() for k in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(names[fresh], pa.int64()), pa.array(data, pa.binary())], ["fp", "data"])

    dealt = of_texts(rows).select("text", _rep().alias("rep")).mapInArrow(releasing(sets), "fp long, data binary").select(home("fp").alias("bucket"), "fp", "data")
    needs = pairs.select(home("p").alias("bucket"), F.col("p").alias("fp"), home("m").alias("to")).distinct()

    def send(_, own: pa.Table, needs: pa.Table) -> pa.Table:
        found = dict(zip(own.column("fp").to_pylist(), own.column("data").to_pylist(), strict=True))
        data = [found.get(x) for x in needs.column("fp").to_pylist()]
        out = pa.table([needs.column("to"), needs.column("fp"), pa.array(data, pa.binary()), pa.nulls(len(data), pa.int64())], names=["bucket", "fp", "data", "m"])
        return out.filter(pa.array([x is not None for x in data], pa.bool_()))

    def verify(_, own: pa.Table, side: pa.Table) -> pa.Table:
        found = dict(zip(own.column("fp").to_pylist(), own.column("data").to_pylist(), strict=True))
        others, asked = {}, []
        for fp, data, m in zip(*(side.column(c).to_pylist() for c in ("fp", "data", "m")), strict=True):
            if m is None:
                others[fp] = data
            else:
                asked.append((m, fp))
        near = []
        for m, p in asked:
            a, b = np.frombuffer(found[m], np.int64), np.frombuffer(others[p], np.int64)
            common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            if 9 * common >= 4 * (len(a) + len(b)):
                near.append((m, p))
        out = pa.table({"m": pa.array([m for m, _ in near], pa.int64()), "p": pa.array([p for _, p in near], pa.int64())})
        del found, others
        release_memory()
        return out

    by = lambda df: df.groupBy("bucket")
    sent = by(dealt).cogroup(by(needs)).applyInArrow(send, "bucket int, fp long, data binary, m long")
    asked = pairs.select(home("m").alias("bucket"), F.col("p").alias("fp"), F.lit(None).cast("binary").alias("data"), "m")
    return scratch.keep(by(dealt).cogroup(by(sent.union(asked))).applyInArrow(verify, "m long, p long"))


def _rep() -> Column:
    """What stands for a row where one row of each set is chosen."""
    return F.xxhash64("doc_id", "same")


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """(m, p): sets with equal fingerprints, and sets whose fingerprints Golay keys find to be within 2 bits."""
    first = distinct.groupBy("sim").agg(F.min("fp").alias("p"))
    equal = distinct.select("sim", F.col("fp").alias("m")).join(first, "sim").where("m <> p").select("m", "p")
    linked = simhash.links(first.select(F.col("sim").alias("fp")))
    a, b = first.select(F.col("sim").alias("a"), F.col("p").alias("m")), first.select(F.col("sim").alias("b"), "p")
    return equal.union(linked.join(a, "a").join(b, "b").select("m", "p"))


def links(scratch: Scratch, heads: DataFrame, distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """(m, p): pairs of near copies among sets that connect all sets which near copies connect."""
    keyed = heads.where("head is not null").select("fp", "n", F.posexplode("head").alias("pos", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    # a row stops at the first other set
    shared = scratch.keep(a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")), "leftsemi"), heads)
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"))
    met = shared.join(sizes, "key").groupBy("fp").agg((F.sum("size") / F.first("n")).alias("met"))
    open_ = scratch.keep(shared.join(met, "fp").withColumn("component", F.col("fp")), shared)
    near = tested = None
    k, last = 0, False
    while True:
        pairs = _all_pairs(open_) if last else _with_pivots(open_, k)
        if k == 0:
            pairs = pairs.union(by_fingerprint(distinct))
        pairs = pairs.distinct()
        if tested is not None:
            turned = tested.union(tested.select(F.col("p").alias("m"), F.col("m").alias("p")))
            pairs = pairs.join(turned, ["m", "p"], "leftanti")
        pairs = scratch.keep(pairs)
        likely = scratch.keep(_likely(pairs, distinct))
        found = _near(scratch, likely, distinct, rows)
        scratch.drop(likely)
        near, tested = (found, pairs) if near is None else (near.union(found), tested.union(pairs))
        if last:
            return near
        last = k > 0 and found.isEmpty() or k == PIVOT_ROUNDS
        k += 1
        of = connected_components(scratch, near, "m", "p").select(F.col("node").alias("fp"), "component")
        grouped = scratch.keep(open_.drop("component").join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp")), open_)
        ends = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        open_ = scratch.keep(grouped.join(ends, "key", "leftsemi"), grouped)


def _with_pivots(open_: DataFrame, k: int) -> DataFrame:
    """(m, p): each set with the pivots of its keys that are in other components. Of a key's sets those are pivots first that have most keys in common with others, as what all of a group were made from has; then some by chance."""
    row = F.struct("fp", "n", "pos", "component")
    orders = [F.struct(-F.col("met"), "fp")] if k == 0 else [F.xxhash64("fp", "key", F.lit(PIVOTS * k + j)) for j in range(PIVOTS)]
    pivots = open_.groupBy("key").agg(*(F.min_by(row, order).alias(f"p{j}") for j, order in enumerate(orders)))
    pivots = pivots.select("key", F.array(*(F.col(f"p{j}") for j in range(len(orders)))).alias("pivots"))
    other = F.filter("pivots", lambda p: (F.col("component") != p["component"]) & _room(F.struct("n", "pos"), p))
    return open_.join(pivots, "key").select(F.col("fp").alias("m"), F.explode(F.transform(other, lambda p: p["fp"])).alias("p"))


def _all_pairs(open_: DataFrame) -> DataFrame:
    """(m, p): the sets of different components that have a key in common."""
    a, b = open_.alias("a"), open_.alias("b")
    room = _room(F.struct("a.n", "a.pos"), F.struct("b.n", "b.pos"))
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.component") != F.col("b.component")) & room)
    return both.select(F.col("a.fp").alias("m"), F.col("b.fp").alias("p"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp, component, component_id) for each row: component_id is the smallest doc_id reachable by near copies, the row's own included.

    same is xxhash64 of the text; component is the smallest fp so reachable, as several may have one component_id.
    Near copies have sets of shingles with a Jaccard similarity of 0.8 or more; null and empty texts and others without words are copies of
    each other. Null ids take part with their texts but never name a component (null if a component has no other id).
    Repeated rows are repeated. A very long text is one set like any other. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("same"))
    heads = scratch.keep(_heads(rows, _frequent(rows)))
    named = scratch.keep(heads.select("doc_id", "same", "fp"))
    distinct = scratch.keep(heads.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(_rep()).alias("rep"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bits").alias("bits")))
    near = connected_components(scratch, links(scratch, heads, distinct, rows), "m", "p")
    grouped = distinct.select("fp", "least").join(near.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = scratch.keep(grouped)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = scratch.keep(grouped.join(least, "component").select("fp", "component", "component_id"), grouped, distinct)
    return named.hint("merge").join(groups, "fp").select("doc_id", "same", "fp", "component", "component_id")

