"""Repeated byte strings against a plain search of every string."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepaudit.llm.parsing import Rolling, packed, phrases, repeated_strings, suffix_order, unpacked


def removed(rows, length):
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1 if key is not None else 0):
            first[raw[p:p + length]] = min(key, first.get(raw[p:p + length], key))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1 if key is not None else 0):
            if first[raw[p:p + length]] < key:
                gone[p:p + length] = [True] * length
        starts = [p for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1])]
        ends = [p + 1 for p in range(len(raw)) if gone[p] and (p + 1 == len(raw) or not gone[p + 1])]
        spans = [x for pair in zip(starts, ends) for x in pair]
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((key, len(raw), sum(gone), len(starts), hashlib.sha256(rest).hexdigest(), spans))
    return sorted(out, key=str)


def corpus(length, seed):
    rnd = random.Random(seed)
    pieces = ["ab", "cde", "f", "ghij", "\u00f6", "kl mn", "\u4e16\u754c"]
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, length * 2)))
        if i % 5 == 0 and rows:
            text = text + rows[rnd.randrange(len(rows))][1][:length * 3] + text
        if i % 11 == 0:  # periodic texts of many lengths
            text = "a" * rnd.randint(0, 300) + "xy" * rnd.randint(0, 80)
        rows.append((rnd.randint(-50, 50), text))  # ids repeat
    rows += [(None, rows[3][1]), (None, None), (7, None), (8, ""), (2**60, rows[5][1]), (-2**60, rows[5][1][:70])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("length, kmer", [(8, 5), (12, 7), (50, 26)])
@pytest.mark.parametrize("options", [{}, {"slice_bytes": 500, "bucket_phrases": 50},
                                     {"slice_bytes": 300, "bucket_phrases": 20, "hot": 2}])
def test_every_repeated_string_goes(texts, clashing, length, kmer, options):
    rows = corpus(length, length)
    found = repeated_strings(clashing(texts(rows)).repartition(3), length=length, kmer=kmer, with_text=True, **options).collect()
    assert sorted([tuple(r)[:6] for r in found], key=str) == removed(rows, length)
    for r in found:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_one_string_in_very_many_texts(texts):
    """A passage in all of 400 texts, each with another context: only the first keeps it."""
    passage = "the passage that every one of these documents quotes word for word"
    rows = [(i, f"{i * 7919:x} {passage} {i * 104729:x}") for i in range(400)]
    for hot in (4, 1 << 16):
        found = repeated_strings(texts(rows), slice_bytes=2000, bucket_phrases=500, hot=hot).orderBy("doc_id").collect()
        assert sorted([tuple(r) for r in found], key=str) == removed(rows, 50)
        assert found[0]["n_removed"] == 0 and all(r["n_removed"] >= len(passage) for r in found[1:])


def test_a_very_long_text_and_an_empty_table(texts):
    text = "".join(chr(97 + i * i % 23) for i in range(400_000)) + "z" * 300_000
    rows = [(1, text[1000:90_000]), (2, text), (3, "z" * 49), (4, "z" * 50)]
    found = {r["doc_id"]: r for r in repeated_strings(texts(rows)).collect()}
    assert found[1]["n_removed"] == 0 and found[3]["n_removed"] == 0 and found[4]["n_removed"] == 50
    assert found[2]["n_bytes"] == 700_000 and found[2]["n_removed"] >= 89_000
    assert repeated_strings(texts([])).collect() == []


def test_the_id_keeps_its_type(texts):
    df = texts({1: "x" * 60, 2: "x" * 60}).select(F.col("doc_id").cast("int"), "text")
    assert dict(repeated_strings(df).dtypes)["doc_id"] == "int"


def test_phrases_cover_every_string_once_and_equal_strings_are_cut_alike():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    offsets = np.array([0, 1500, 1500, 1530, 4000])
    found = phrases(data, offsets, Rolling(data), 50, 26)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(found.at, found.count)])
    assert starts.tolist() == [*range(0, 1451), *range(1530, 3951)]
    other = np.concatenate([data[200:400], rng.integers(97, 100, 100).astype(np.uint8)])
    again = phrases(other, np.array([0, 300]), Rolling(other), 50, 26)
    trigger = dict(zip(starts.tolist(), np.repeat(found.trigger, found.count).tolist()))
    assert all(trigger[200 + p] == t for p, t in zip(
        np.concatenate([np.arange(a, a + n) for a, n in zip(again.at, again.count)]).tolist(),
        np.repeat(again.trigger, again.count).tolist()) if p + 50 <= 200)


@pytest.mark.parametrize("length", [5, 8, 19, 50])
def test_suffix_order(length):
    raw = np.random.default_rng(length).integers(97, 99, 700).astype(np.uint8)
    starts = np.random.default_rng(1).permutation(700 - length + 1)
    order, fresh = suffix_order(raw, starts, length)
    found = [raw[s:s + length].tobytes() for s in starts[order]]
    assert found == sorted(found)
    assert fresh.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_packed_round_trip():
    values = np.array([0, 1, 255, 256, 2**24 - 1], np.uint64)
    for width in (3, 4, 8):
        assert unpacked(packed(values, width), width).tolist() == values.tolist()
