from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa

from prepaudit.llm import decontaminate, licenses, passages
from tests.llm import brute


def score(equal):
    """Greatest sum of +1 and -2 over a run, by trying all."""
    best = 0
    for i in range(len(equal)):
        total = 0
        for j in range(i, len(equal)):
            total += 1 if equal[j] else -2
            best = max(best, total)
    return best


def brute_hits(rows, items):
    found = {}
    for key, text in rows.items():
        w = brute.words(text)
        for item, source in items.items():
            s = brute.words(source)
            if len(s) < decontaminate.LEAST_WORDS:
                continue
            best = max((score([w[i] == s[i - d] for i in range(max(0, d), min(len(w), len(s) + d))])
                        for d in range(-len(s) + 1, len(w))), default=0)
            if best >= min(decontaminate.LEAST_SCORE, len(s)):
                found[key, item] = best
    return found


def test_masks_meet_every_overlap_with_few_substitutions():
    """Any run that scores enough with up to four substitutions holds a place where some mask sees equal words only."""
    for wrong, length in ((0, 10), (1, 13), (2, 16), (3, 19), (4, 22)):
        for places in itertools.combinations(range(1, length - 1), wrong):
            equal = [i not in places for i in range(length)]
            assert any(all(equal[s + j] for j, c in enumerate(m) if c == "1")
                       for m in decontaminate.MASKS for s in range(length - len(m) + 1))


def test_overlaps_match_brute_force(texts, clashing, spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 8, 14, 30]))) for i in range(25)}
    rows = {}
    for i in range(60):
        w = [draw.choice(vocabulary) for _ in range(draw.randrange(60))]
        if i % 2:
            inner = draw.choice(list(items.values())).upper().split()
            for _ in range(draw.choice([0, 1, 2])):
                inner[draw.randrange(len(inner))] = "other"
            w[5:5] = inner
        rows[i] = " ".join(w)
    rows |= {900: None, 901: "", 902: "w1 " * 40_000, 903: items[24] + " " + items[23]}
    bench = spark.createDataFrame(list(items.items()) + [(None, None), (77, "")], "item_id long, text string")
    for block in (1 << 23, 400):
        marked = decontaminate.mark(clashing(texts(rows)).drop("hits"), bench, block_bytes=block)
        got = {(r.doc_id, int(h.item)): h.n_matched - 2 * (h.n_words - h.n_matched) for r in marked.collect() for h in r.hits}
        want = brute_hits({k: t for k, t in rows.items() if k != 902}, items)
        assert {k: s for k, s in got.items() if k[0] != 902} == want
    kept = {r.doc_id for r in decontaminate.without_benchmark(texts(rows), bench).collect()}
    assert kept >= {900, 901} and not kept & {k for k, _ in want}
    assert decontaminate.mark(texts([]), bench).count() == 0
    assert decontaminate.mark(texts({1: "a b c d e f"}), bench.limit(0)).first().hits == []


def test_own_licence_and_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "p/LICENSE", mit + "."), (2, "p/a/x", prose), (3, "p/a/b/y", prose + "\n# " + gpl.upper() + "\n" + prose),
            (4, "p/a/b/z", None), (5, "q/x", prose), (6, "q/r/NOTICE", gpl), (7, "q/r/s/t/u", ""), (8, None, prose), (9, "top", prose),
            (9, "top", prose)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'x' AS own_scores", "1 AS holder")
    got = [(r.doc_id, r.own_license, r.license, r.license_folder) for r in licenses.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "MIT", "MIT", None), (2, None, "MIT", "p"), (3, "GPL-3.0", "GPL-3.0", None), (4, None, "MIT", "p"),
        (5, None, None, None), (6, "GPL-3.0", "GPL-3.0", None), (7, None, "GPL-3.0", "q/r"), (8, None, None, None),
        (9, None, None, None), (9, None, None, None)], key=repr)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_texts_headers_and_wrapped_notices(spark):
    """A whole licence text makes a licence file; a header with one, a wrapped notice and one inside a paragraph are found."""
    whole = licenses.whole_texts()
    prose = " ".join(f"word{i}" for i in range(400))
    notice = licenses.TEMPLATES["MPL-2.0"].split()
    rows = [("m/LICENSE", "Copyright (c) 2020 A. Person\n\n" + whole["MIT"]), ("m/a/x", prose),
            ("g/COPYING", whole["GPL-3.0"]), ("g/y", prose), ("a/z", prose),
            ("a/code", "\n".join("# " + line for line in whole["BSD-3-Clause"].splitlines()) + "\n" + prose + prose),
            ("w/wrapped", prose + "\n" + "\n".join(" ".join(notice[i:i + 4]) for i in range(0, len(notice), 4)) + "\n" + prose),
            ("w/inside", prose + " " + licenses.TEMPLATES["Apache-2.0"] + " " + prose), ("w/q", prose)]
    got = {r.path: (r.own_license, r.license, r.license_folder) for r in
           licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"m/LICENSE": ("MIT", "MIT", None), "m/a/x": (None, "MIT", "m"), "g/COPYING": ("GPL-3.0", "GPL-3.0", None),
                   "g/y": (None, "GPL-3.0", "g"), "a/code": ("BSD-3-Clause", "BSD-3-Clause", None), "a/z": (None, None, None),
                   "w/wrapped": ("MPL-2.0", "MPL-2.0", None), "w/inside": ("Apache-2.0", "Apache-2.0", None), "w/q": (None, None, None)}


def test_cosine_is_that_of_the_definition():
    known = licenses.Templates({"a": "x y y", "b": "z"})
    known.weigh(np.array([1, 0, 2])[np.argsort(np.argsort(known.terms))] * 0 + 1, 9)
    text = ["x y y", "x y q"]
    import pyarrow as pa
    _, _, words, _, bounds = next(licenses._lines(pa.array(["\n".join(text)])))
    best, score = known.cosines(words, bounds)
    idf, unseen = np.log(10 / 2) + 1, np.log(10) + 1
    other = (idf * idf + 2 * idf * idf) / (np.sqrt(5) * idf * np.sqrt(2 * idf**2 + unseen**2))
    assert best.tolist() == [0, 0] and np.allclose(score, [1, other])


def brute_chain(points, kmer, cost):
    points = sorted(set(points))
    best = []
    for i, (a, o) in enumerate(points):
        best.append(kmer + max([0] + [best[j] - cost * ((a - x - kmer) + (o - y - kmer)) - 0 for j, (x, y) in enumerate(points[:i])
                                      if x < a and y < o and best[j] - cost * ((a - x) + (o - y) - 2 * kmer) > 0]))
    return max(best)


def test_chains_match_quadratic_search():
    draw = random.Random(6)
    for _ in range(200):
        points = [(draw.randrange(60), draw.randrange(60)) for _ in range(draw.randrange(1, 25))]
        found = passages.chain(points, 8, 0.1)
        assert sorted(p for c in found for p in c) == sorted(set(points))
        for c in found:
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))
        top = found[0]
        total = 8 * len(top) - sum(0.1 * ((b[0] - a[0]) + (b[1] - a[1]) - 16) for a, b in zip(top, top[1:]))
        assert abs(total - brute_chain(points, 8, 0.1)) < 1e-9


def test_repeated_passages_are_found(texts, clashing):
    draw = random.Random(9)
    def prose(n):
        return [f"w{draw.randrange(5000)}" for _ in range(n)]
    long, fuzzy, twin = prose(80), prose(120), prose(300)
    bent = list(fuzzy)
    for i in (25, 60, 61, 95):
        bent[i] = "changed"
    del bent[40]
    rows = {1: prose(100) + long + prose(50), 2: long + prose(10), 3: prose(200) + long, 4: prose(40) + fuzzy + prose(40),
            5: bent + prose(100), 6: twin, 7: twin, 8: prose(400), 9: prose(30) + long[:40] + prose(30), 10: prose(3)}
    rows = {k: " ".join(w) for k, w in rows.items()} | {11: None, 12: "", 13: "same " * 20_000}
    found = passages.repeated_passages(clashing(texts(list(rows.items()) + [(None, rows[1])])))
    got = {r.doc_id: (r.start_word, r.end_word, r.partner_id, r.first_copy) for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert got[1] == (100, 180, 2, True) and got[2] == (0, 80, 1, False) and got[3] == (200, 280, 1, False)
    assert got[6] == (0, 300, 7, True)
    assert got[4][0] <= 45 and got[4][1] >= 155 and got[5][0] <= 5 and got[5][1] >= 114
    assert passages.repeated_passages(texts([])).count() == 0


def test_minimizers_are_shared():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([draw.integers(0, 2**63, 30).astype(np.uint64), a[50:80]])
    at = passages.minimizers(np.concatenate([a, b, a[:5]]), np.array([0, 200, 260, 265]), 16)
    first, second = set(a[at[at < 200]]), set(b[at[(at >= 200) & (at < 260)] - 200])
    assert len(first & second) >= 1 and ((at >= 260).sum() == 1)
    assert (np.diff(at[at < 200]) <= 16).all()


def test_passages_with_many_substitutions_are_found(texts):
    """Sixty shared words with another word in every twelfth place: every pair is compared."""
    draw = random.Random(21)
    def prose(n):
        return [f"w{draw.randrange(50_000)}" for _ in range(n)]
    rows = {}
    for i in range(40):
        shared = prose(72)
        bent = [f"other{i}" if j % 12 == 11 else w for j, w in enumerate(shared)]
        rows[2 * i], rows[2 * i + 1] = " ".join(prose(30) + shared + prose(30)), " ".join(prose(20) + bent + prose(40))
    found = {r.doc_id for r in passages.repeated_passages(texts(rows)).collect()}
    assert found == set(rows)


def test_passage_quoted_in_parts_before_is_found(texts):
    """Its seeds have their first places in many texts; the two that hold all of it still meet, and so do later places in a text."""
    draw = random.Random(22)
    def prose(n):
        return [f"w{draw.randrange(50_000)}" for _ in range(n)]
    whole = prose(60)
    rows = {i: " ".join(prose(20) + whole[4 * i:4 * i + 11] + prose(20)) for i in range(13)}
    rows |= {50: " ".join(prose(10) + whole + prose(10)), 60: " ".join(prose(30) + whole + prose(30) + whole)}
    spans = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(texts(rows)).collect()}
    assert spans == {(50, 10, 70), (60, 30, 90), (60, 120, 180)}


def test_passage_is_found_though_quotes_lie_between(texts):
    """The first text and the text before hold parts only; with many quotes its seeds are held by more texts than meet each other."""
    draw = random.Random(23)
    def prose(n):
        return [f"w{draw.randrange(50_000)}" for _ in range(n)]
    whole = prose(60)
    for quotes in (1, 40):
        rows = {50_000: " ".join(prose(10) + whole + prose(10)), 190_000: " ".join(prose(30) + whole + prose(5))}
        for before in rows.copy():
            for i in range(15 * quotes):
                rows[before - 1 - i] = " ".join(prose(20) + whole[i % 15 * 3:i % 15 * 3 + 17] + prose(20))
        spans = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(texts(rows)).collect()}
        assert spans == {(50_000, 10, 70), (190_000, 30, 90)}


def test_fuzzy_passage_is_found_though_quotes_lie_between(texts):
    draw = random.Random(24)
    def prose(n):
        return [f"w{draw.randrange(50_000)}" for _ in range(n)]
    whole = prose(72)
    bent = [f"other{j}" if j % 12 == 11 else w for j, w in enumerate(whole)]
    rows = {50: " ".join(prose(10) + whole + prose(10)), 190: " ".join(prose(30) + bent + prose(5))}
    for before in rows.copy():
        for i in range(6):
            rows[before - 1 - i] = " ".join(prose(20) + whole[12 * i:12 * i + 11] + prose(20))
    assert {r.doc_id for r in passages.repeated_passages(texts(rows)).collect()} == {50, 190}


def test_points_in_one_line_are_one_chain():
    draw = random.Random(25)
    rows = []
    for _ in range(400):
        at, shift = draw.randrange(50), draw.randrange(50)
        points = []
        for _ in range(draw.randrange(1, 12)):
            at += draw.choice([0, 1, 3, 6, 20, 34, 35, 36, 60]) if draw.random() < 0.3 else draw.randrange(1, 30)
            shift += draw.random() < 0.05
            points.append((at, at + shift))
        rows.append(draw.sample(points, len(points)))
    bounds = np.cumsum([0] + [len(r) for r in rows])
    found, edges, whole = passages.straight(bounds, *np.array([p for r in rows for p in r]).T)
    assert 50 < whole.sum() < 350
    for i, row in enumerate(rows):
        points = list(map(tuple, found[edges[i]:edges[i + 1]].tolist()))
        assert points == sorted(set(row))
        if whole[i]:
            assert passages.chain(row) == [points]


def test_rows_whose_seed_comes_again_are_kept_across_batches():
    seeds = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(seeds[i:i + size], pa.int64())], ["seed"]) for i in range(0, 10, size)]
        assert [x for b in passages._shared(iter(batches)) for x in b.column(0).to_pylist()] == [1, 2, 2, 4, 4, 4, 6, 6]
