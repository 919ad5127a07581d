"""Near copies among many texts: minhash bands find candidates, the multiset Dice of character n-grams decides.

Equal texts are one. A text's n-grams, repeats told apart by their number, are hashed into ``bands * rows`` bins of which each keeps its least hash; texts
that agree in all bins of a band meet in that band's bucket. There the least one leads: those that match it have found their class, the others go on among
themselves until a bucket has no two left. Marks of half a byte rule out most pairs that merely share a band before any text moves. So a bucket takes the turns of
many leaders at once, as long as the pairs left to compare stay a few times its members; the number of rounds follows the logarithm of those, not the leaders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepaudit.functions import multiset
from prepaudit.operators.distributed import broadcast_if_small, settle, store
from prepaudit.operators.forest import mixed

GRAM = 5
BANDS, ROWS = 32, 6
#: A bucket of no more members is finished at once.
SMALL_BUCKET = 32
#: Marks of a text, each one of 15 or none.
MARKS = 1024
#: A similar pair is taken for a different one, by its marks, with a chance below exp(-CERTAIN), about 4 in 10^11.
CERTAIN = 24
#: Pairs of a bucket whose marks are compared at once.
AT_ONCE = 1 << 12


def elements(text: str, n: int) -> np.ndarray:
    """A hash for every n-gram of a text, with equal ones numbered; a shorter text is one element."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = min(n, len(codes))
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        grams = mixed(grams, codes[i:i + len(grams)])
    grams.sort()
    head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return mixed(grams, np.arange(len(grams)) - np.repeat(head, np.diff(np.append(head, len(grams)))))


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """The least element of each of ``size`` bins; an empty bin borrows from the first filled one that a hash of its number names."""
    at = (found % np.uint64(size)).astype(np.int64)
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, at, found)
    filled = np.bincount(at, minlength=size) > 0
    wanting, turn = np.flatnonzero(~filled), 0
    while len(wanting):
        lender = (mixed(wanting, np.uint64(turn)) % np.uint64(size)).astype(np.int64)
        good = filled[lender]
        out[wanting[good]] = out[lender[good]]
        wanting, turn = wanting[~good], turn + 1
    return out


def marks_of(found: np.ndarray) -> bytes:
    """A mark from the least element of each bin, by the first ten bits of its hash, and 0 in an empty bin; two marks to a byte."""
    at = (found >> np.uint64(54)).astype(np.int64)
    least = np.full(MARKS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, found)
    mark = np.where(np.bincount(at, minlength=MARKS) > 0, mixed(least) % np.uint64(15) + np.uint64(1), 0).astype(np.uint8)
    return (mark[::2] | mark[1::2] << 4).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """For rows of marks, as 64-bit words, whether texts of that Dice coefficient agree in so few of them with a chance above exp(-CERTAIN).

    Of the bins that any of two texts fills, they agree in their share of common elements, and by chance in a 15th of the others (Hoeffding's bound).
    """
    def any_bit(x: np.ndarray) -> np.ndarray:
        x = x | x >> np.uint64(2)
        return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    filled, other = any_bit(a | b), any_bit(a ^ b)
    common = least / (2 - least)
    return filled - other >= filled * (common + (1 - common) / 15) - np.sqrt(filled * (CERTAIN / 2))


def _signed(n: int, bands: int, rows: int):
    """A text's buckets, its number of n-grams, and its marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams, marks = [], [], []
            for text in batch.column(1).to_pylist():
                found, value = elements(text, n), np.zeros(bands, np.uint64)
                for column in signature(found, bands * rows).reshape(bands, rows).T:
                    value = mixed(value, column)
                keys.append(mixed(value, np.arange(bands)).view(np.int64).tolist())
                grams.append(max(0, len(text) - n + 1))
                marks.append(marks_of(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.int64()), pa.array(marks, pa.binary())],
                                             ["rep", "keys", "grams", "marks"])
    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows in the order of their buckets, none cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        start = int(np.searchsorted(bucket, bucket[-1]))
        if start or (held and held[-1].column(0)[-1].as_py() != bucket[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(least: float, small: int, room: int):
    """Pairs ``(bucket, rep, leader, last)`` that may be similar, with members in order.

    All of them where a bucket has at most ``small`` members or ``room`` pairs a member, and then ``last`` is null; else those of the first members up
    to ``last``, the one that fills the room.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            bucket, rep, grams = table.column(0).to_numpy(), table.column(1).combine_chunks(), table.column(2).to_numpy().astype(float)
            marks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(3)]).reshape(len(rep), -1)

            def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                fine = 2.0 * np.minimum(grams[i], grams[j]) >= least * (grams[i] + grams[j])
                at = np.flatnonzero(fine)
                for k in range(0, len(at), AT_ONCE):
                    some = at[k:k + AT_ONCE]
                    fine[some] = may_be_similar(marks[i[some]], marks[j[some]], least)
                return fine
            heads = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            sizes = np.diff(heads)
            few = np.repeat(sizes <= small, sizes)
            found, lasts = [], []
            for step in range(1, min(small, int(sizes.max()))):
                i = np.flatnonzero(few[:-step] & (bucket[:-step] == bucket[step:]))
                i = i[alike(i, i + step)]
                found.append((i, i + step, np.full(len(i), -1)))
            for a, b in zip(heads[:-1][sizes > small].tolist(), heads[1:][sizes > small].tolist()):
                some, pairs, last = [], 0, -1
                for p in range(a, b - 1):
                    later = np.arange(p + 1, b)
                    later = later[alike(np.full(len(later), p), later)]
                    some.append((np.full(len(later), p), later))
                    pairs += len(later)
                    if pairs > room * (b - a):
                        last = p
                        break
                found += [(i, j, np.full(len(i), last)) for i, j in some]
            i, j, lasts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(bucket[i]), rep.take(pa.array(j)), rep.take(pa.array(i)), rep.take(pa.array(lasts, mask=lasts < 0))],
                                             ["bucket", "rep", "leader", "last"])
    return run


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets from their matching pairs, ``(leader, rep)`` in order: the least one left leads, and those that match it leave with it."""
    for batch in batches:
        links = []
        for bucket, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            gone = set()
            for pair in pairs:
                if pair["leader"] not in gone and pair["rep"] not in gone:
                    links.append((bucket, pair["rep"], pair["leader"]))
                    # a leader's own pairs come in a row, so leaving at once takes nothing from it
                    gone.add(pair["rep"])
        kind = batch.schema.field(1).type.value_type.field("rep").type
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], k) for i, k in enumerate((pa.int64(), kind, kind))], ["bucket", "rep", "leader"])


def components(links: DataFrame) -> DataFrame:
    """``(id, least)``: the least id that each end of the links ``a``, ``b`` reaches.

    Every vertex points to the least it has seen; rounds of pointing to the target's own target, which halve the way, alternate with a look at
    the neighbours, until nothing changes.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    point = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("least")))
    while True:
        near = both.join(point, both["b"] == point["id"]).groupBy("a").agg(F.min("least").alias("m"))
        closer = point.join(near, point["id"] == near["a"]).select("id", F.least("least", "m").alias("least"), F.col("least").alias("was"))
        jump = closer.select(F.col("id").alias("of"), F.col("least").alias("further"))
        new = settle(closer.join(jump, closer["least"] == jump["of"], "left").select(
            "id", F.least("least", F.coalesce("further", "least")).alias("least"), "was"))
        point = new.select("id", "least")
        if new.filter("least != was").isEmpty():
            return point


def near_classes(df: DataFrame, key: str, text: str, least: float = 0.8, n: int = GRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(<key>, class_id, similarity)`` for every text that some other one is a near copy of; ``class_id`` is the least id of its class.

    Two texts are linked when their Dice coefficient is ``least`` or more, and a class is what hangs together by links.
    ``similarity`` is that to the class's least text; it may fall below ``least`` for a text that got in by others. Candidates come from buckets, so a link may be
    missed: with 32 bands of 6 a pair at 0.8 meets with a chance of about 0.95, one at 0.9 nearly always. Rows that repeat an id count once;
    rows without an id or text, or with an empty one, have no near copies.
    """
    given = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL AND text != ''").dropDuplicates(["id"])
    digest = store(given.select("id", F.sha2("text", 256).alias("digest")))
    copies = digest.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    member = settle(digest.join(copies, "digest").select("id", "rep", "times"))
    texts = store(given.join(member.filter("id = rep").select("id"), "id", "left_semi"))
    kind = df.schema[key].dataType.simpleString()
    signed = store(texts.mapInArrow(_signed(n, bands, rows), f"rep {kind}, keys array<bigint>, grams bigint, marks binary"))
    open_, links, turn = signed.select("rep", F.explode("keys").alias("bucket")), None, 0

    def dice(pairs: DataFrame, one: str, other: str, name: str) -> DataFrame:
        """The coefficient of every different pair. Only texts that are in one are moved, and shuffle files go at once."""
        ids = settle(pairs.select(F.col(one).alias("id")).unionByName(pairs.select(F.col(other).alias("id"))).distinct())
        some = texts.join(broadcast_if_small(ids), "id", "left_semi")
        found = pairs.distinct()
        for side in (one, other):
            found = found.join(some.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text")), side)
        return store(found.select(one, other, multiset.dice_of_grams(F.col(f"{one}_text"), F.col(f"{other}_text"), n).alias(name)))

    def matching(pairs: DataFrame) -> DataFrame:
        return dice(pairs, "rep", "leader", "dice").filter(F.col("dice") >= least).select("rep", "leader")

    while True:
        leaders = open_.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1")
        met = settle(open_.join(leaders, "bucket"))
        if met.isEmpty():
            break
        members = met.join(signed, "rep").select("bucket", "rep", "grams", "marks").repartition("bucket").sortWithinPartitions("bucket", "rep")
        # At first a large bucket asks its least one only, so that many copies of one text list no pairs; then more and more at once.
        pairs = store(members.mapInArrow(_candidates(least, SMALL_BUCKET, 4 ** turn - 1), f"bucket bigint, rep {kind}, leader {kind}, last {kind}"))
        found = pairs.join(matching(pairs.select("rep", "leader")), ["rep", "leader"]).groupBy("bucket").agg(
            F.sort_array(F.collect_list(F.struct("leader", "rep"))).alias("pairs"))
        taken = settle(found.mapInArrow(_turns, f"bucket bigint, rep {kind}, leader {kind}"))
        new = settle(taken.select("rep", "leader").distinct())
        links = new if links is None else links.unionByName(new)
        going = pairs.filter("last IS NOT NULL").groupBy("bucket").agg(F.max("last").alias("last"))
        open_ = settle(met.join(going, "bucket").filter("rep > last").join(taken, ["bucket", "rep"], "left_anti").select("rep", "bucket"))
        turn += 1
    if links is None:
        links = member.select(F.col("rep"), F.col("rep").alias("leader")).limit(0)
    classes = components(links.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    placed = member.join(classes, member["rep"] == classes["id"], "left").select(
        member["id"], member["rep"], F.coalesce("least", "rep").alias("class"), F.col("least").isNotNull().alias("linked"), "times")
    placed = placed.filter("linked OR times > 1")
    # Each different text is compared with its class's least one once.
    other = settle(placed.select("rep", "class").distinct())
    similar = dice(other, "rep", "class", "similarity").select("rep", "similarity")
    return placed.join(similar, "rep").select(F.col("id").alias(key), F.col("class").alias("class_id"), "similarity")
