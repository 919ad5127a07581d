"""Periodic runs against a plain scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from prepaudit.llm.kernel import mix
from prepaudit.llm.periods import COVER, COVER_PERIOD, Extensions, op12_periodic_runs, periodic_runs, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(words, least=6, exponent=4):
    ends = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                ends.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in ends.items())


def repetitive(rnd, n, letters):
    words = [rnd.choice(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n:
            a, p = rnd.randrange(n), rnd.randint(1, 12)
            words[a:a] = (words[a:a + p] * 50)[:rnd.randint(0, 80)]
    return words


def test_runs_of_random_texts():
    rnd, found = random.Random(1), 0
    for _ in range(150):
        texts = [repetitive(rnd, rnd.randint(0, 120), range(rnd.choice([1, 2, 3, 10]))) for _ in range(rnd.randint(1, 8))]
        flat = mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(7))
        bounds = np.cumsum([0, *map(len, texts)])
        expected = sorted(((i, *r) for i, t in enumerate(texts) for r in scanned(t)), key=lambda r: (r[0], r[1], r[3]))
        assert [tuple(r) for r in runs(flat, bounds).tolist()] == expected
        found += len(expected)
    assert found > 500


@pytest.mark.parametrize("least, exponent", [(3, 3), (10, 5)])
def test_other_lengths_and_exponents(least, exponent):
    rnd = random.Random(2)
    for _ in range(60):
        words = repetitive(rnd, 80, range(2))
        flat = mix(np.array(words, np.uint64))
        expected = [(0, *r) for r in sorted(scanned(words, least, exponent), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in runs(flat, np.array([0, len(words)]), least, exponent).tolist()] == expected


def test_extensions():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, 90)
    text = np.concatenate([base, base, base[:50], rng.integers(0, 2, 200), np.zeros(120, int), [9]]).astype(np.uint64)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
    i, j = i[i != j], j[i != j]
    raw = text.tolist()

    def common(a, b):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n
    assert Extensions(text)(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]
    assert {(a - b) % COVER_PERIOD for a in COVER for b in COVER} == set(range(COVER_PERIOD))


def described(key, text, tail=True):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if tail and n and key is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = scanned(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def odd_texts():
    rnd, rows = random.Random(6), []
    for i in range(300):
        words = repetitive(rnd, rnd.randint(0, 90), ["a", "B", "b", "\u00e9t\u00e9", "\u4e16", "x,", "\u00a0"])
        rows.append((i, "".join(w + rnd.choice([" ", "\t", "\n", "  ", "\x0b"]) for w in words)))
    rows += [(None, "la " * 40), (None, None), (1000, None), (1001, ""), (1002, " \n "), (7, "z " * 100), (7, "z " * 100),
             (1003, "one " * 5), (1004, "one " * 6), (1005, "a b " * 3), (1006, "a b " * 4 + "a"), (-3, "w " * 9 + "v")]
    return rows


def test_query_against_plain_scan(spark, texts, clashing, tmp_path):
    rows = odd_texts()
    clashing(texts(rows)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((described(*r) for r in rows), key=str)


def test_given_documents_against_plain_scan(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in op12_periodic_runs(spark, folder).collect()]
    assert sorted(found) == sorted(described(*r) for r in rows)
    assert any(r[1] for r in found)


def test_collapsed_text_and_empty_table(texts):
    rows = [(1, "so " + "ha " * 20 + "end"), (2, "a b c " * 30)]
    found = {r["doc_id"]: r for r in periodic_runs(texts(rows), with_text=True).collect()}
    assert bytes(found[1]["collapsed"]) == b"so ha end" and bytes(found[2]["collapsed"]) == b"a b c"
    assert [tuple(x) for x in found[2]["runs"]] == [(0, 90, 3)] and found[1]["n_words"] == 22
    assert periodic_runs(texts([])).collect() == []


def test_a_very_long_text(texts):
    words = [f"w{i * i % 1009}" for i in range(60_000)]  # a period of 1009 words, 59 times
    row = periodic_runs(texts([(1, " ".join(words)), (2, "q " * 200_000)])).orderBy("doc_id").collect()
    assert [tuple(x) for x in row[0]["runs"]] == [(0, 60_000, 1009)] and [tuple(x) for x in row[1]["runs"]] == [(0, 200_000, 1)]
