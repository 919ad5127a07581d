"""Byte strings that repeat across documents, by prefix-free parsing.

A rolling hash runs over every ``KMER`` bytes. The least hash among the places where a string of ``length`` bytes can hold
one is that string's trigger, and neighbouring strings with the same trigger are one phrase. So a text is a sequence of phrases
that overlap by ``length - 1`` bytes, equal strings are cut alike wherever they stand, and each string of
``length`` bytes begins in exactly one phrase and lies wholly in it. The order of the dictionary's suffixes is therefore the order of the
corpus to that depth; of the parse only its first symbol is needed, that is, which documents hold a phrase.

* Texts are dealt into slices by a hash of their id, in one shuffle that every pass reads again.
* Each slice sends every trigger once, with a hash of its phrase and the least id. A trigger with one phrase only is settled by
  the least id over all slices; what no other document holds needs no further work.
* The phrases of the other shared triggers are the dictionary: its suffixes are sorted and neighbours that
  agree in ``length`` bytes share the least id of their phrases.
* Back in their slices, the strings that begin in a lesser document mark their bytes.

A trigger that very many slices hold with different phrases would fill one bucket of the dictionary; from ``hot`` slices on
its phrases are cut into single strings, which are dealt out by their own hash. That changes where they are compared, not what is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.kernel import mix, salts, slices
from prepaudit.llm.shared import read, register

LENGTH = 50
KMER = 26
SLICE_BYTES = 4 * 1024 * 1024
BUCKET_PHRASES = 1 << 18
PARTITION_BYTES = 64 * 1024 * 1024
BLOCK_PHRASES = 1 << 16
HOT_SLICES = 1 << 10
CHUNK_BYTES = 256 * 1024

_BASE = int(salts(1, 97)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = salts(256, 77)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n`` - 1, kept for the next chunk unless the text was a very long one."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


class Phrases:
    """The phrases of a run of texts: trigger, hash, row, first byte and number of strings that begin in it."""

    def __init__(self, trigger, value, row, at, count):
        self.trigger, self.value, self.row, self.at, self.count = trigger, value, row, at, count

    def take(self, which) -> "Phrases":
        return Phrases(self.trigger[which], self.value[which], self.row[which], self.at[which], self.count[which])


class Rolling:
    """Prefix sums of a run of bytes, from which any stretch is hashed at once."""

    def __init__(self, data: np.ndarray):
        self.inverse = powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * powers(_BASE, len(data)), out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length * _STEP)

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def phrases(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, length: int, kmer: int) -> Phrases:
    """Cut the rows of a byte buffer into phrases."""
    sizes = np.diff(offsets)
    strings = np.maximum(sizes - length + 1, 0)
    total = int(strings.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Phrases(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    row = np.repeat(np.arange(len(sizes)), strings)
    at = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(strings) - strings), strings)
    trigger = least_of(rolling.every(kmer), length - kmer + 1)[at]
    opened = np.ones(total, bool)
    opened[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(opened)
    count = np.diff(np.append(head, total))
    start = at[head]
    return Phrases(trigger[head], rolling.stretch(start, start + count + length - 1), row[head], start, count)


def single_strings(found: Phrases, which: np.ndarray, rolling: Rolling, length: int) -> Phrases:
    """Cut the marked phrases into one phrase per string."""
    if not which.any():
        return found
    times = np.where(which, found.count, 1)
    at = np.repeat(found.at, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    split = np.repeat(which, times)
    value, count = np.repeat(found.value, times), np.repeat(found.count, times)
    value[split] = rolling.stretch(at[split], at[split] + length)
    count[split] = 1
    return Phrases(np.repeat(found.trigger, times), value, np.repeat(found.row, times), at, count)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of every value."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def short_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of a hash; of one bucket's triggers a ten-thousandth agree by chance, which costs work only."""
    return bucket_of(hashes, buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])


def _parsed(table: pa.Table, length: int, kmer: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Rolling, Phrases, np.ndarray, np.ndarray]]:
    """Per chunk of a slice: first row, bytes, offsets, rolling hashes, phrases and the ids of all the slice's rows; rows without an id have no phrases."""
    key, text = table.column("id").combine_chunks(), table.column("text").combine_chunks()
    known = np.asarray(key.is_valid())
    ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, end, data, offsets in slices(text, CHUNK_BYTES):
        rolling = Rolling(data)
        found = phrases(data, offsets, rolling, length, kmer)
        if not known[first:end].all():
            found = found.take(known[first + found.row])
        yield first, end, data, offsets, rolling, found, ids


def _sends(length: int, kmer: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("base", pa.int64()), ("width", pa.int32()),
                        ("triggers", pa.binary()), ("values", pa.binary()), ("ids", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [(p.trigger, p.value, ids[first + p.row]) for first, _, _, _, _, p, ids in _parsed(table, length, kmer)]
        if not parts:
            return schema.empty_table()
        trigger, value, ids = (np.concatenate(x) for x in zip(*parts))
        if not len(trigger):
            return schema.empty_table()
        order = np.lexsort((value, trigger))
        trigger, value, ids = trigger[order], value[order], ids[order]
        head = _starts(trigger)
        least, most = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
        low, high = np.minimum.reduceat(value, head), np.maximum.reduceat(value, head)
        # Of several phrases only that is said: 0 within one document, 1 across documents.
        said = np.where(low == high, low & np.uint64(0xFFFFFFFFFFFF) | np.uint64(2), (least != most).astype(np.uint64))
        trigger, base = trigger[head], int(least.min())
        offset = least.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        width = max(1, (int(offset.max()).bit_length() + 7) // 8)
        bucket = bucket_of(trigger, buckets)
        cut = np.append(_starts(bucket), len(bucket))
        rows = [(int(bucket[a]), key[0].as_py(), base, width, packed(trigger[a:b], 4), packed(said[a:b], 6), packed(offset[a:b], width))
                for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


FACTS = "slice bigint, bucket bigint, settled binary, open binary, hot binary"


def _facts(hot: int):
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("settled", pa.binary()), ("open", pa.binary()), ("hot", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select(["slice", "base", "width", "triggers", "values", "ids"]).to_pylist()
        trigger = np.concatenate([unpacked(r["triggers"], 4) for r in rows])
        value = np.concatenate([unpacked(r["values"], 6) for r in rows])
        ids = np.concatenate([(unpacked(r["ids"], r["width"]) + np.uint64(r["base"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64) for r in rows])
        sender = np.repeat(np.arange(len(rows)), [len(r["triggers"]) // 4 for r in rows])
        order = np.argsort(trigger, kind="stable")
        trigger, value, ids, sender = trigger[order], value[order], ids[order], sender[order]
        head = _starts(trigger)
        size = np.diff(np.append(head, len(trigger)))
        low, high, least = np.minimum.reduceat(value, head), np.maximum.reduceat(value, head), np.minimum.reduceat(ids, head)
        many = low < 2
        opened = ((size > 1) & (many | (low != high))) | (high == 1)
        state = np.repeat(np.where(opened, np.where(size >= hot, 2, 1), 0), size)
        tells = (state > 0) | (ids > np.repeat(least, size))
        trigger, sender, state = trigger[tells], sender[tells], state[tells]
        order = np.argsort(sender, kind="stable")
        trigger, sender, state = trigger[order], sender[order], state[order]
        cut = np.append(_starts(sender), len(sender))
        out = [(rows[sender[a]]["slice"], key[0].as_py(), *(packed(trigger[a:b][state[a:b] == s], 4) for s in range(3)))
               for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)
    return run


def _keys(facts: pa.Table, column: str) -> np.ndarray:
    """The short keys of a slice that a column of its facts names, in order."""
    found = [unpacked(raw, 4) | np.uint64(b << 32) for b, raw in zip(facts.column("bucket").to_pylist(), facts.column(column).to_pylist()) if raw]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _dictionary(length: int, kmer: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("groups", pa.binary()), ("values", pa.binary()), ("ids", pa.binary()),
                        ("sizes", pa.binary()), ("bytes", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, facts: pa.Table) -> pa.Table:
        hot, wanted = _keys(facts, "hot"), np.sort(np.concatenate([_keys(facts, "open"), _keys(facts, "hot")]))
        parts = []
        for first, _, data, _, rolling, found, ids in _parsed(table, length, kmer) if len(wanted) else ():
            short = short_key(found.trigger, buckets)
            keep = _among(short, wanted)
            found, short = found.take(keep), short[keep]
            split = _among(short, hot)
            home = np.repeat(np.where(split, 0, bucket_of(found.trigger, buckets).astype(np.int64) + 1), np.where(split, found.count, 1))
            found = single_strings(found, split, rolling, length)
            single = home == 0
            home = np.where(single, bucket_of(found.value, buckets).astype(np.int64), home - 1)
            group = np.where(single, found.value, found.trigger).astype(np.uint32)
            owner = ids[first + found.row]
            order = np.lexsort((owner, found.value))
            order = order[_starts(found.value[order])]
            size = found.count[order] + length - 1
            inside = np.arange(int(size.sum())) + np.repeat(found.at[order] - (np.cumsum(size) - size), size)
            parts.append((home[order], group[order], found.value[order], owner[order], size, data[inside]))
        if not parts:
            return schema.empty_table()
        home, group, value, owner, size, raw = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(size) - size
        order = np.lexsort((owner, value, home))
        order = order[np.append(True, (value[order][1:] != value[order][:-1]) | (home[order][1:] != home[order][:-1]))[:len(order)]]
        home, group, value, owner, size, begin = home[order], group[order], value[order], owner[order], size[order], begin[order]
        cut, out = np.append(_starts(home), len(home)), []
        for a, b in zip(cut[:-1], cut[1:]):
            inside = np.arange(int(size[a:b].sum())) + np.repeat(begin[a:b] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b])
            out.append((int(home[a]), key[0].as_py(), group[a:b].tobytes(), value[a:b].tobytes(), owner[a:b].tobytes(), size[a:b].astype(np.uint32).tobytes(), raw[inside].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 7, schema)], schema=schema)
    return run


def suffix_order(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at ``starts`` by their first ``length`` bytes, and which of them, in that order, differ from the one before."""
    words = []
    for j in range(0, length, 8):
        word = np.zeros(len(starts), np.uint64)
        for t in range(j, min(j + 8, length)):
            word = word << np.uint64(8) | raw[starts + t]
        words.append(word)
    order = np.lexsort(words[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for word in words:
        fresh[1:] |= word[order][1:] != word[order][:-1]
    return order, fresh


def _bytes_of(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All rows of a binary column, one after the other."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def lesser_starts(raw: np.ndarray, value: np.ndarray, owner: np.ndarray, begin: np.ndarray, size: np.ndarray,
                  length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of phrases that begin in a document less than the phrase's own: the phrase's number and the string's place in it.

    ``value``, ``owner``, ``begin`` and ``size`` tell phrases, first byte and length in ``raw``, by value and owner.
    """
    # The dictionary: every phrase once, with the least document that holds it.
    first = _starts(value)
    entry = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value))))
    count = size[first] - length + 1
    upto = np.cumsum(count) - count
    suffix = np.repeat(np.arange(len(first)), count)
    place = np.arange(int(count.sum())) - np.repeat(upto, count)
    ranked, fresh = suffix_order(raw, begin[first][suffix] + place, length)
    group = np.flatnonzero(fresh)
    least = np.empty(len(ranked), np.int64)
    least[ranked] = np.repeat(np.minimum.reduceat(owner[first][suffix][ranked], group), np.diff(np.append(group, len(ranked))))
    many = count[entry]
    mine = np.repeat(np.arange(len(entry)), many)
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    hit = least[upto[entry][mine] + inside] < owner[mine]
    return mine[hit], inside[hit]


def _matches(length: int):
    schema = pa.schema([("slice", pa.int64()), ("values", pa.binary()), ("runs", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        senders = table.column("slice").to_numpy()
        held = [len(x.as_buffer()) // 8 for x in table.column("values")]
        sender = np.repeat(np.arange(len(held)), held)
        group, value = _bytes_of(table.column("groups"), np.uint32), _bytes_of(table.column("values"), np.uint64)
        owner, size = _bytes_of(table.column("ids"), np.int64), _bytes_of(table.column("sizes"), np.uint32).astype(np.int64)
        raw = _bytes_of(table.column("bytes"), np.uint8)
        begin = np.cumsum(size) - size
        order = np.lexsort((owner, value, group))
        group, value, owner, size, begin, sender = (x[order] for x in (group, value, owner, size, begin, sender))
        heads = np.append(_starts(group), len(group))
        found, low = [], 0
        while low < len(group):  # equal strings have one group, so a few groups at a time will do
            high = int(heads[np.searchsorted(heads, min(low + BLOCK_PHRASES, len(group)), "left")])
            mine, inside = lesser_starts(raw, value[low:high], owner[low:high], begin[low:high], size[low:high], length)
            head = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (inside[1:] != inside[:-1] + 1))[:len(mine)])
            last = np.append(head[1:], len(mine))[:len(head)] - 1
            found.append(np.stack([low + mine[head], inside[head], inside[last] + 1]))
            low = high
        # Every sender learns its hits as runs of strings.
        which, start, end = np.concatenate(found, axis=1)
        order = np.argsort(sender[which], kind="stable")
        which, runs = which[order], np.stack([start[order], end[order]], 1).astype(np.uint32)
        cut = np.append(_starts(sender[which]), len(which))
        out = [(int(senders[sender[which[a]]]), value[which[a:b]].tobytes(), runs[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 3, schema)], schema=schema)
    return run


def _kept(length: int, kmer: int, buckets: int, with_text: bool):
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))] + [("kept", pa.binary())] * with_text
    schema = pa.schema(fields)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        facts = told.filter(told.column("bucket").is_valid())
        runs_of = told.filter(told.column("values").is_valid())
        settled, hot = _keys(facts, "settled"), _keys(facts, "hot")
        values = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in runs_of.column("values").to_pylist())])
        runs = np.concatenate([np.zeros((0, 2), np.uint32), *(np.frombuffer(x, np.uint32).reshape(-1, 2) for x in runs_of.column("runs").to_pylist())])
        order = np.argsort(values, kind="stable")
        values, runs = values[order], runs[order].astype(np.int64)
        parsed, firsts = [], [np.zeros(0, np.uint64)]
        owners = [np.zeros(0, np.int64)]
        for first, end, data, offsets, rolling, found, ids in _parsed(table, length, kmer):
            found = single_strings(found, _among(short_key(found.trigger, buckets), hot), rolling, length)
            parsed.append((first, end, data, offsets, found, ids))
            firsts.append(found.value)
            owners.append(ids[first + found.row])
        value, owner = np.concatenate(firsts), np.concatenate(owners)
        order = np.lexsort((owner, value))
        order = order[_starts(value[order])]
        value, owner = value[order], owner[order]  # the slice's phrases with their least document
        key_column = table.column("id").combine_chunks()
        out = []
        for first, end, data, offsets, found, ids in parsed:
            change = np.zeros(len(data) + 1, np.int64)
            whole = _among(short_key(found.trigger, buckets), settled)
            if len(value):
                whole |= owner[np.searchsorted(value, found.value)] < ids[first + found.row]
            np.add.at(change, found.at[whole], 1)
            np.add.at(change, found.at[whole] + found.count[whole] + length - 1, -1)
            low, high = np.searchsorted(values, found.value), np.searchsorted(values, found.value, "right")
            times = np.where(whole, 0, high - low)
            which = np.repeat(np.arange(len(times)), times)
            at = np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)
            np.add.at(change, found.at[which] + runs[at, 0], 1)
            np.add.at(change, found.at[which] + runs[at, 1] + length - 1, -1)
            removed = np.cumsum(change[:-1]) > 0
            # Runs of removed bytes, cut where a text ends.
            edge = removed.copy()
            edge[1:] &= ~removed[:-1]
            begins = offsets[:-1][offsets[:-1] < len(data)]
            edge[begins] = removed[begins]
            starts = np.flatnonzero(edge)
            stop = removed.copy()
            stop[:-1] &= ~removed[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            stop[ends] = removed[ends]
            stops = np.flatnonzero(stop) + 1
            rows, keep = np.searchsorted(starts, offsets), ~removed
            for r in range(end - first):
                a, b = int(offsets[r]), int(offsets[r + 1])
                pairs = np.stack([starts[rows[r]:rows[r + 1]], stops[rows[r]:rows[r + 1]]], 1) - a
                rest = data[a:b] if not len(pairs) else data[a:b][keep[a:b]]
                out.append((key_column[first + r].as_py(), b - a, b - a - len(rest), len(pairs), hashlib.sha256(rest).hexdigest(),
                            pairs.reshape(-1).tolist(), *([rest.tobytes()] if with_text else [])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()
    return run


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int | None = None,
                     slice_bytes: int = SLICE_BYTES, bucket_phrases: int = BUCKET_PHRASES, hot: int = HOT_SLICES,
                     with_text: bool = False) -> DataFrame:
    """``(<key>, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept])`` per row: bytes covered by a repeated string go.

    A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller id, in the texts as given;
    ``spans`` lists first byte and end of each maximal removed run, ``kept`` is the rest. Texts are read as UTF-8 bytes and never run on into the
    next. Hashes have 64 bits; strings of the dictionary are compared byte by byte.

    Null and empty texts count as empty. Rows of one id do not count for each other, whatever their texts. A row without an id
    is returned, loses nothing and takes nothing from others. Other columns are not read; an empty table gives an empty table.
    ``key`` must be an integer.
    """
    kmer = kmer or length // 2 + 1
    cut = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, math.ceil(total / slice_bytes))
    per_phrase = (length - kmer + 2) / 2
    buckets = max(1, math.ceil(total / per_phrase / bucket_phrases))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_BYTES))
    # Every pass reads this one shuffle again.
    texts = cut.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("bigint")).repartition(parts, "slice")
    sends = texts.groupBy("slice").applyInArrow(
        _sends(length, kmer, buckets), "bucket bigint, slice bigint, base bigint, width int, triggers binary, values binary, ids binary")
    facts = sends.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_facts(hot), FACTS).repartition(parts, "slice")
    entries = texts.groupBy("slice").cogroup(facts.groupBy("slice")).applyInArrow(
        _dictionary(length, kmer, buckets), "bucket bigint, slice bigint, groups binary, values binary, ids binary, sizes binary, bytes binary")
    matched = entries.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_matches(length), "slice bigint, values binary, runs binary")
    told = facts.unionByName(matched, allowMissingColumns=True)  # with all columns, so that the shuffle of facts serves twice
    found = texts.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(
        _kept(length, kmer, buckets, with_text),
        "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>" + ", kept binary" * with_text)
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), *found.columns[1:])


REPEATED_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT row, doc_id, len(h) // 2 AS n, unnest(range(0, len(h) // 2, 256)) AS base, substr(h, 2 * base + 1, 610) AS h FROM d),
bytes AS (SELECT row, doc_id, n, base + i AS p, substr(h, 2 * i + 1, 2) AS c, substr(h, 2 * i + 1, 100) AS s
          FROM (SELECT *, unnest(range(least(256, n - base))) AS i FROM parts)),
starts AS (SELECT row, p, n, c, coalesce(n - p >= 50 AND min(doc_id) OVER (PARTITION BY s) < doc_id, false)::INT AS repeated FROM bytes),
marked AS (SELECT row, p, c, max(repeated) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed FROM starts),
edges AS (SELECT *, (removed - lag(removed, 1, 0) OVER (PARTITION BY row ORDER BY p) = 1)::INT AS opens FROM marked),
found AS (SELECT row, sum(removed) AS n_removed, sum(opens) AS n_spans,
                 coalesce(string_agg(c, '' ORDER BY p) FILTER (removed = 0), '') AS kept FROM edges GROUP BY row)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(f.n_removed, 0)::BIGINT AS n_removed, coalesce(f.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(f.kept, ''))) AS kept_sha256
FROM d LEFT JOIN found f ON d.row = f.row
"""


@register("op11_suffix_array_dedup", REPEATED_SQL)
def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_strings(read(spark, folder, "documents")).drop("spans")
