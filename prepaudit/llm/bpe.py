"""Byte-level BPE: words are encoded once by a fold of ranked merges, texts by looking their words up."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from prepaudit.llm.shared import read, register, store

MAP_SLOTS = 4096
FOLD_BYTES = 48
DICTIONARY_WORDS = 1 << 17
COUNTER_WORDS = 1 << 18
CACHE_WORDS = 1 << 17
NO_RANK = 1 << 30
ROWS_AT_A_TIME = 500
BINS_PER_OCTAVE = 8
#: Fixed value: the pattern for which texts may be cut at spaces first, see ``pieces_of``.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _slot(piece: bytes) -> int:
    return zlib.crc32(piece) % MAP_SLOTS


def rank_map(ranks: Mapping[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps from hex to rank, as a map is searched from its start."""
    slots: list[dict[str, int]] = [{} for _ in range(MAP_SLOTS)]
    for piece, rank in ranks.items():
        slots[_slot(piece)][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def piece_array(ranks: Mapping[bytes, int]) -> Column:
    """Hex pieces by rank, as one literal."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def _with(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def fold_word(word: Column, ranks: Column) -> Column:
    """Ids of one word (binary): merge the adjacent pair of least rank, leftmost first, until none has a rank."""
    def rank(piece: Column) -> Column:
        return F.element_at(F.get(ranks, F.pmod(F.crc32(piece), F.lit(MAP_SLOTS)).cast("int")), F.hex(piece))

    def merge(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2),
                            lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))

        def apply(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(F.get(parts, at - 1), F.get(parts, at))
            return F.when(F.array_min(found).isNull(), parts).otherwise(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined),
                         F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))))
        return _with(pairs, apply)

    one_byte = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))
    # The second field tells that nothing was left to merge, so that the rest of the fold costs nothing.
    first = F.struct(one_byte.alias("parts"), (F.octet_length(word) < 2).alias("done"))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(_with(merge(state["parts"]), lambda merged: F.struct(
            merged.alias("parts"),
            ((F.size(merged) < 2) | (F.size(merged) == F.size(state["parts"]))).alias("done"))))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), first, step)["parts"]
    return F.when(rank(word).isNotNull(), F.array(rank(word))).otherwise(F.transform(folded, rank))


def merge_word(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same for words outside the dictionary."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return _merge_long(word, ranks)
    none = len(ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        joined = parts[i] + parts.pop(i + 1)
        parts[i] = joined
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(joined + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + joined, none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """A heap of pairs keeps very long words near-linear."""
    n = len(word)
    parts: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i:i + 2]], i, 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged meanwhile
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heappush(heap, (ranks[pair], i, len(pair)))
        if before[i] >= 0:
            pair = parts[before[i]] + parts[i]
            if pair in ranks:
                heappush(heap, (ranks[pair], before[i], len(pair)))
    return [ranks[p] for p in parts if p is not None]


class Merges:
    """Merges of many words at a time: a rank for each pair of ids, and one step of all words in each round."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = dict(ranks)
        found = sorted((self.ranks[w[:i]] << 32 | self.ranks[w[i:]], rank) for w, rank in self.ranks.items()
                       for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks)
        self.pairs = np.array([k for k, _ in found], np.int64)
        self.rank = np.array([r for _, r in found], np.int64)
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.of_bytes = np.full((256, 256), NO_RANK)
        for w, rank in self.ranks.items():
            if len(w) == 2:
                self.of_bytes[w[0], w[1]] = rank

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), NO_RANK)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank[at], NO_RANK)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of words, as ``merge_word`` gives them."""
        short = [i for i, w in enumerate(words) if 1 < len(w) <= FOLD_BYTES and w not in self.ranks]
        out = [b""] * len(words)
        for i in set(range(len(words))).difference(short):
            out[i] = array("i", merge_word(words[i], self.ranks)).tobytes()
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        data = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        ids = self.bytes[data]
        if (ids < 0).any():
            raise KeyError("a byte without a rank")
        word = np.repeat(np.arange(len(short)), sizes)
        rank = np.full(len(ids), NO_RANK)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.of_bytes[data[inner], data[inner + 1]]
        done = []
        while len(ids):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), heads)
            more = (least >> 32) < NO_RANK
            going = np.repeat(more, np.diff(np.append(heads, len(ids))))
            done.append((word[~going], ids[~going]))
            at = least[more] & 0xFFFFFFFF
            ids[at] = least[more] >> 32
            going[at + 1] = False
            at = (np.cumsum(going) - 1)[at]
            ids, word, rank = ids[going], word[going], rank[going]
            rank[at] = NO_RANK  # what is joined with the word's end has no pair behind it
            for i in (at[at + 1 < len(ids)], at[at > 0] - 1):
                i = i[word[i] == word[i + 1]]
                rank[i] = self.of_pairs(ids[i], ids[i + 1])
        word, flat = (np.concatenate(x) for x in zip(*done))
        flat = flat[np.argsort(word, kind="stable")].astype(np.int32).tobytes()
        edges = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(short)))]) * 4
        for i, low, high in zip(short, edges[:-1].tolist(), edges[1:].tolist()):
            out[i] = flat[low:high]
        return out


#: A space between two other white-space characters: there, cutting at spaces would change the matches.
_RUN = re.compile(r" (?<=\s.)(?=\s)")


def pieces_of(text: str) -> list[str] | None:
    """``text`` cut at spaces, each piece but the first standing for itself behind a space; None if that is not safe.

    A space starts a match, or belongs to a run of white space that ends before it or with it. So the matches
    inside the pieces, in order, are those of the text, unless a space has white space on both sides or is first or last.
    """
    if "  " in text or text[:1] == " " or text[-1:] == " " or _RUN.search(text):
        return None
    return text.split(" ")


def count_words(docs: DataFrame, text: str, pattern: str, spaces: bool = True) -> DataFrame:
    """``(word, n)`` over all texts; each task sums what it has seen before anything moves."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, pieces = regex.compile(pattern).findall, Counter(), Counter()

        def flush():
            while pieces:  # each piece goes as its words come, so both counters are never held whole
                piece, n = pieces.popitem()
                for word in find(" " + piece):
                    seen[word] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             ["word", "n"])
            seen.clear()
            return out
        for batch in batches:
            for body in batch.column(0):
                body = body.as_py() or ""
                cut = pieces_of(body) if spaces else None
                if cut is None:
                    seen.update(find(body))
                else:
                    seen.update(find(cut[0]))
                    pieces.update(cut[1:])
                if len(seen) + len(pieces) > COUNTER_WORDS:
                    yield flush()
        yield flush()
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Pieces(dict):
    """Ids of pieces that are kept, and of others those of the texts at hand."""

    own: Mapping[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.own[piece]


class Vocabulary:
    """Ids (as bytes) of words and of pieces behind a space; a worker keeps the first ``CACHE_WORDS`` pieces that come to its tasks."""

    def __init__(self, words: dict[str, bytes], ranks: Mapping[bytes, int]):
        self.words, self.merges, self.pieces = words, Merges(ranks), Pieces()

    def encode(self, texts: list[str], pattern: str, spaces: bool) -> list[bytes]:
        """Ids of each text: its rarer words are merged together, and pieces that are not kept are encoded once."""
        find, words, kept = regex.compile(pattern).findall, self.words, self.pieces
        cuts = [pieces_of(text) if spaces else None for text in texts]
        heads = [find(text if cut is None else cut[0]) for text, cut in zip(texts, cuts)]
        fresh = list(set().union(*[cut[1:] for cut in cuts if cut is not None]).difference(kept))
        parts = [find(" " + piece) for piece in fresh]
        rare = list({w for part in (heads, parts) for found in part for w in found if w not in words})
        merged = dict(zip(rare, self.merges.ids([w.encode() for w in rare])))

        def joined(found: list[str]) -> bytes:
            return b"".join([words.get(w) or merged[w] for w in found])
        own = kept.own = dict(zip(fresh, map(joined, parts)))
        kept.update(islice(own.items(), max(0, CACHE_WORDS - len(kept))))

        def ids(found: list[str], cut: list[str] | None) -> bytes:
            return joined(found) + b"".join(map(kept.__getitem__, (cut or ())[1:]))
        return list(map(ids, heads, cuts))


def dictionary(words: DataFrame, ranks: Mapping[bytes, int], most: int = DICTIONARY_WORDS) -> DataFrame:
    """``(word, ids)`` of the most frequent words, ``most`` at the utmost: the cut is at a frequency, so nothing is sorted."""
    counted = words.filter(F.octet_length("word") <= FOLD_BYTES).withColumn(
        "bin", F.floor(F.log2("n") * BINS_PER_OCTAVE).cast("int"))
    total, cut = 0, None
    for row in sorted(counted.groupBy("bin").count().collect(), reverse=True):  # some hundred bins
        total += row["count"]
        if total > most:
            break
        cut = row["bin"]
    chosen = counted.filter(F.col("bin") >= cut) if cut is not None else counted.filter(F.lit(False))
    return chosen.select("word", fold_word(F.col("word").cast("binary"), rank_map(ranks)).alias("ids"))


def encode(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, text: str = "text",
           output: str = "ids", most: int = DICTIONARY_WORDS, keep_text: bool = True) -> DataFrame:
    """Add ``output`` (``array<int>``), the ids of each whole text, without special tokens.

    Words are the matches of ``pattern``. They are counted over all texts; the most
    frequent ones become a dictionary by a fold of Spark's higher-order functions over their byte arrays with a literal rank
    map. The dictionary has at most ``most`` words of ``FOLD_BYTES`` bytes each, so its broadcast has a proven bound at any size
    of the corpus. A task encodes each rarer or longer word itself with the same ranks.
    Under ``SPACE_PATTERN`` texts are cut at spaces first and pieces seen before are looked up whole.

    A null or empty text gives an empty array. Rows are kept as they are, repeated or not; an empty
    table gives an empty table. A column already called ``output`` is replaced. Without ``keep_text`` the text is left out of
    the result, so tasks are sent it once and do not send it back.
    """
    spark = docs.sparkSession
    spaces = pattern == SPACE_PATTERN
    known = store(dictionary(store(count_words(docs, text, pattern, spaces)), ranks, most))
    table = known.select("word", "ids").toArrow().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    edges, flat = columns[1].offsets.to_numpy(), columns[1].values.to_numpy().astype(np.int32)
    shared = spark.sparkContext.broadcast(Vocabulary(
        {word: flat[edges[i]:edges[i + 1]].tobytes() for i, word in enumerate(columns[0].to_pylist())}, ranks))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        at = None
        for batch in (b.slice(i, ROWS_AT_A_TIME) for b in batches for i in range(0, b.num_rows, ROWS_AT_A_TIME)):
            at = batch.schema.get_field_index(inner) if at is None else at
            encoded = vocabulary.encode([x or "" for x in batch.column(at).to_pylist()], pattern, spaces)
            bounds = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in encoded], out=bounds[1:])
            column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
            arrays = [c for i, c in enumerate(batch.columns) if i != at] + [column]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(
                [f for i, f in enumerate(batch.schema) if i != at] + [pa.field(output, pa.list_(pa.int32()))]))
    inner = "__text"
    rest_of = [c for c in docs.columns if c != output and (keep_text or c != text)]
    given = docs.select(*[F.col(f"`{c}`") for c in rest_of], F.col(text).cast("string").alias(inner))
    schema = StructType([*given.drop(inner).schema.fields, StructField(output, ArrayType(IntegerType()))])
    return given.mapInArrow(look_up, schema)


def decode(ids: Column, ranks: Mapping[bytes, int]) -> Column:
    """The bytes (binary) of an array of ids: their pieces, one after the other. Null gives null."""
    pieces = piece_array(ranks)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def encoded_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text",
                      keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, and without ``text`` unless ``keep_text``."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = encode(docs, ranks, pattern or public_tokenizers.PATTERN, text, keep_text=keep_text)
    return found.withColumn("decoded", decode(F.col("ids"), ranks))


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = encoded_documents(read(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
