from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from prepaudit.llm import jaccard, kernel, lines, passages
from tests.llm import brute


def some_texts(seed, n=120):
    """Families of near copies, texts that share a passage, and texts of their own."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "é", "😀", "A", "a"]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    rows, base = {}, []
    for i in range(n):
        if i % 6 == 0:
            base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 12, 60, 150]))]
        copy = list(base)
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            if copy:
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        if i % 5 == 0:
            copy += passage
        rows[i] = draw.choice([" ", "\n", "  "]).join(copy)
    return rows | {1000: None, 1001: "", 1002: " \n ", 1003: "one", 1004: "ONE", 1005: "two words", 1006: "x " * 30_000,
                   1007: "x " * 30_000 + "y"}


@pytest.mark.parametrize("width, least", [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (1, Fraction(1, 2))])
def test_components_match_brute_force(texts, clashing, width, least):
    rows = some_texts(width)
    found = jaccard.near_copies(clashing(texts(rows)), width=width, least=least, share=1)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    want = brute.components(rows.items(), width, least.numerator, least.denominator)
    assert got == {i: (len(brute.shingles(t, width)), want[i]) for i, t in rows.items()}


def test_members_of_one_group_that_do_not_all_link(texts):
    """Equal size and prefix, but only some are similar: the others are compared with each other as well."""
    draw = random.Random(2)
    rows = {}
    for i in range(40):
        own = [f"z{(i % 4)}v{j}" for j in range(60)]
        own[draw.randrange(60)] = "z9"
        rows[i] = " ".join(["a1 a2 a3"] + own)
    found = jaccard.near_copies(texts(rows), width=1, least=Fraction(8, 10), share=1)
    want = brute.components(rows.items(), 1, 8, 10)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_a_large_family_of_near_copies_lists_few_pairs(texts, monkeypatch):
    """What is verified grows with the family, not with its pairs, and texts that only share its words stay apart."""
    draw, asked, verify = random.Random(5), [], jaccard.verify
    rows = {}
    for i in range(400):
        own = [f"z{j}" for j in range(60)]
        own[draw.randrange(60)] = f"own{i}"
        rows[i] = " ".join(own[:30] + [f"far{i}v{j}" for j in range(30)] if i % 20 == 0 else own)

    def counted(candidates, *options):
        asked.append(candidates.count())
        return verify(candidates, *options)
    monkeypatch.setattr(jaccard, "verify", counted)
    found = jaccard.near_copies(texts(rows), width=1, least=Fraction(8, 10))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute.components(rows.items(), 1, 8, 10)
    assert sum(asked) < 20 * len(rows)


def test_sketches_differ_no_more_than_the_sets():
    draw = np.random.default_rng(3)
    values, bounds = kernel.row_sets(draw.integers(0, 2**64, 9000, dtype=np.uint64), np.array([0, 0, 2000, 2000, 5000, 9000]))
    found = np.stack(jaccard.sketches(values, bounds), axis=1)
    want = np.zeros((5, 512), np.uint8)
    for row in range(5):
        for v in values[bounds[row]:bounds[row + 1]].tolist():
            want[row, v % 512] ^= 1
    assert (np.packbits(want, axis=1).view(np.int64) == found).all()
    assert all((x == 0).all() for x in jaccard.sketches(np.zeros(0, np.uint64), np.zeros(1, np.int64)))


def test_repeated_and_missing_ids(texts):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(5, long), (5, long), (None, long), (7, long + " end"), (9, "own words here")]
    found = jaccard.near_copies(texts(rows), width=3, least=Fraction(9, 10))
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=repr) == [
        (5, 5), (5, 5), (7, 5), (9, 9), (None, None)]
    assert jaccard.near_copies(texts([])).count() == 0
    kept = jaccard.one_of_each(texts(rows), width=3, least=Fraction(9, 10)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [5, 5, 9, None]


def test_words_are_cut_and_hashed_alike():
    texts = ["Ab  cd\n\tab", "", None, "é😀 AB", "x" * 5000 + " q"]
    found = [list(w[b[i]:b[i + 1]]) for _, _, w, b in kernel.texts_to_words(pa.array(texts), 4) for i in range(len(b) - 1)]
    assert [len(f) for f in found] == [len(brute.words(t)) for t in texts]
    assert found[0][0] == found[0][2] == found[3][1] and found[0][1] != found[0][0]


def test_packed_order_equals_lexsort():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**64, 5000, dtype=np.uint64)
    values[::7] = values[0]
    rows, level = np.sort(draw.integers(0, 50, 5000)), draw.integers(0, 256, 5000)
    assert (values[kernel.ordered(values, rows, level)] == values[np.lexsort((values, level, rows))]).all()
    close = np.arange(5000, dtype=np.uint64)
    assert (close[kernel.ordered(close[::-1].copy(), rows)] == np.lexsort((close[::-1], rows))).all()


def brute_lines(rows, least_words=3, num=8, den=10):
    seen, gone = [], set()
    for key, text in sorted(r for r in rows if r[0] is not None):
        for i, line in enumerate((text if text is not None else "").split("\n")):
            s = frozenset(brute.words(line))
            if len(s) >= least_words:
                if any(brute.similar(s, t, num, den) for t in seen):
                    gone.add((key, i))
                seen.append(s)
    return gone


@pytest.mark.parametrize("hot", [2, 512])
def test_later_lines_match_brute_force(texts, clashing, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(80)] + ["the"] * 20
    base = [[draw.choice(vocabulary) for _ in range(draw.choice([2, 4, 9, 25]))] for _ in range(25)]

    def line():
        copy = list(draw.choice(base))
        if draw.random() < 0.5:
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        return " ".join(copy)
    rows = [(i, "\n".join(line() for _ in range(draw.randrange(6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, "a b c d " * 20_000 + "\n\nz y x w")]
    found = lines.later_lines(clashing(texts(rows)))
    got = {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line) for r in found.collect()}
    assert set(got) == brute_lines(rows)
    place = dict(rows)
    for (key, at), (kept, kept_at) in got.items():
        assert (kept, kept_at) < (key, at)
        assert brute.similar(frozenset(brute.words(place[key].split("\n")[at])),
                             frozenset(brute.words(place[kept].split("\n")[kept_at])), 8, 10)


def test_short_lines_that_repeat_go_in_the_query(spark, texts, tmp_path):
    rows = [(1, "Les.\n\nYes no"), (2, "les.\n\nno YES\nown"), (3, "Les.\nLes. Les."), (4, "a b c d"), (5, "a b c d e\nx y z")]
    texts(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line) for r in lines.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == brute_lines(rows, least_words=1) == {(2, 0), (2, 2), (3, 0), (3, 1), (5, 0)}


def test_neighbours_of_a_word_in_many_slices(spark):
    """One word that most postings share is cut into slices; each posting still meets the one before it and the first."""
    rows = [(7 if i % 10 else i, 9 + i % 2, 0, i * 7919 % 1009, 0, 0, (i % 300, i)) for i in range(1000)]
    rows = [(w, n, at, d, b1, b2, first) for w, n, at, d, b1, b2, first in rows]
    df = spark.createDataFrame(rows, "word int, n int, at int, d1 bigint, b1 bigint, b2 bigint, first struct<id:bigint,line:int>")
    groups, want = {}, set()
    for w, n, _, d, _, _, first in sorted(rows, key=lambda r: (r[6], r[3])):
        mine = groups.setdefault((w, n), [])
        want |= {(x, d) for x in (mine[:1] + mine[-1:])}
        mine.append(d)
    got = lines.neighbours(df, Fraction(8, 10))
    assert {(r.a, r.b) for r in got.collect()} == want
    assert "Window" in str(got._jdf.queryExecution().optimizedPlan()) and all(
        "slice" in part for part in str(got._jdf.queryExecution().optimizedPlan()).split("windowspecdefinition(")[1:])


def test_lines_are_taken_out(texts):
    df = texts({1: "a b c\nown line here", 2: "x\na b c\ny\n", 3: None})
    gone = lines.later_lines(df)
    assert [(r.doc_id, r.line, r.kept_doc_id, r.kept_line) for r in gone.collect()] == [(2, 1, 1, 0)]
    out = {r.doc_id: r.text for r in lines.without_lines(df, gone).collect()}
    assert out == {1: "a b c\nown line here", 2: "x\ny\n", 3: None}
    assert lines.later_lines(texts([])).count() == 0


def test_shingles_of_all_texts_are_counted(spark, texts):
    """The order of shingles follows their counts over every text, not over some of them."""
    rows = {i: f"a b c w{i} x{i}" for i in range(500)}
    steps = jaccard.common_shingles(texts(rows).selectExpr("doc_id AS id", "text"), 3, jaccard.COMMON_SHINGLES)
    assert np.flatnonzero(steps).size == 1 and steps.max() == int(np.log2(500) * jaccard.BINS_PER_OCTAVE)
    with pytest.raises(ValueError):
        jaccard.near_copies(texts(rows), share=8)


def test_seeds_are_sorted_by_row_and_hash_with_places_in_order():
    draw = np.random.default_rng(4)
    for most in (4, 2**64 - 1):  # small hashes agree in the bits that fit
        values, rows = draw.integers(0, most, 5000, dtype=np.uint64), np.sort(draw.integers(0, 50, 5000))
        assert (passages.by_row(values, rows) == np.lexsort((values, rows))).all()
    assert not len(passages.by_row(np.zeros(0, np.uint64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("window", [1, 2, 6])
def test_minimizers_are_the_first_least_of_each_window(window):
    draw = np.random.default_rng(window)
    bounds = np.append(0, np.cumsum(draw.integers(0, 12, 60)))
    hashes = draw.integers(0, 5, bounds[-1], dtype=np.uint64)
    want = set()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for at in range(low, max(high - window + 1, low + (high > low))):
            want.add(min(range(at, min(at + window, high)), key=lambda i: (hashes[i], i)))
    assert passages.minimizers(hashes, bounds, window).tolist() == sorted(want)
