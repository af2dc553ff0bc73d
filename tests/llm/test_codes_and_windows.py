"""Vector codes, hard negatives and repeated passages against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, vector_codes
from plumbline.llm.hard_negatives import first_in_windows, mine_hard_negatives
from plumbline.llm.substring_dedup import intervals, remove_repeated_passages, word_hashes, window_keys
from plumbline.llm.vector_codes import codebook_rows, encode, nearest, train_codebooks

R = random.Random(5)


# ---- vector codes


def plain_nearest(part, book):
    return min((sum((int(x) - int(y)) ** 2 for x, y in zip(part, entry)), e) for e, entry in enumerate(book))


@pytest.mark.parametrize("bundle", [1, 3, 256])
@pytest.mark.parametrize("spread", [2, 40, 2**30])
def test_trie_finds_the_nearest_entry(monkeypatch, bundle, spread):
    monkeypatch.setattr(vector_codes, "BUNDLE", bundle)
    rng = np.random.default_rng(bundle + spread)
    parts = np.unique(rng.integers(-spread, spread, (200, 4)), axis=0)
    book = rng.integers(-spread, spread, (7, 4))
    book[5] = book[2]  # a tie goes to the lower index
    codes, distances = nearest(parts, book)
    want = [plain_nearest(p, book) for p in parts]
    assert [(int(d), int(c)) for c, d in zip(codes, distances)] == want
    assert 5 not in codes


def plain_codes(rows, scale, parts, entries, rounds):
    """rows of (id, vector), all of the same length."""
    x = {i: [math.floor(scale * c) for c in v] for i, v in rows}
    size = len(next(iter(x.values()))) // parts
    cut = {i: [v[k * size : (k + 1) * size] for k in range(parts)] for i, v in x.items()}
    books = [[cut[i][k] for i in sorted(x)[:entries]] for k in range(parts)]
    for _ in range(rounds):
        for k in range(parts):
            at = {}
            for i in x:
                at.setdefault(plain_nearest(cut[i][k], books[k])[1], []).append(cut[i][k])
            books[k] = [[sum(c) // len(at[e]) for c in zip(*at[e])] if e in at else old for e, old in enumerate(books[k])]
    out = {}
    for i in x:
        found = [plain_nearest(cut[i][k], books[k]) for k in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return books, out


def test_codes_equal_brute_force(spark):
    base = [[R.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [c + R.choice([0, 0, R.gauss(0, 0.2)]) for c in R.choice(base)], "x") for i in range(300)]
    rows += [(1000 + i, base[0], "y") for i in range(200)]  # a hot vector
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").repartition(7)
    books = train_codebooks(df, scale=64, parts=4, entries=16, rounds=3)
    want_books, want = plain_codes([r[:2] for r in rows], 64, 4, 16, 3)
    assert [b.tolist() for b in books] == want_books
    assert len(codebook_rows(books)) == 4 * 16 * 2
    got = encode(df, books, scale=64).collect()
    assert {r["id"]: (r["code"], r["error"]) for r in got} == want and len(got) == 500
    assert {r["source"]["code"] for r in got} == {"x", "y"}  # an own column of a clashing name


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, [1.0, nan]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0, 4.0]),
        (None, [5.0, 5.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [-inf, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = train_codebooks(df, scale=10, parts=2, entries=3, rounds=1)
    got = Counter((r["id"], r["code"], r["error"]) for r in encode(df, books, scale=10).collect())
    # the entries start alike (ids 1, 8 and 8); only the first is ever used, and after a round it is the mean of all four rows
    assert [b.tolist() for b in books] == [[[20], [10], [10]], [[27], [20], [20]]]
    assert got[(8, "0101", 0)] == 2 and got[(None, "0000", 30**2 + 23**2)] == 1
    assert {i for i, _, _ in got} == {1, 6, 7, None, 8}
    assert {(i, c, e) for i, c, e in got if i in (6, 7)} == {(6, None, None), (7, None, None)}
    empty = df.filter("vec_id = 6")
    assert encode(empty, train_codebooks(empty, parts=2)).select("id", "code").collect() == [(6, None)]
    assert encode(df.limit(0), books).count() == 0 and train_codebooks(df.limit(0))[0].size == 0


# ---- hard negatives


@pytest.mark.parametrize("spread", [3, 300])
@pytest.mark.parametrize("sizes", [(4096, 64, 64), (16, 3, 4)])
def test_windows_fill_as_by_brute_force(monkeypatch, spread, sizes):
    for name, value in zip(("INDEX_ROWS", "INDEX_ANCHORS", "PROBE"), sizes):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(spread)
    for dims in (0, 1, 20):
        anchors, rows = rng.integers(-spread, spread + 1, (9, dims)), rng.integers(-spread, spread + 1, (150, dims))
        rows[::7] = 0
        rows[1::5] //= 10
        anchors[3] = 0
        ids = rng.permutation(150) // 2  # some ids repeat
        allowed = rng.random((9, 150)) < 0.7
        owner = np.repeat(np.arange(9), 4)
        scores = anchors @ rows.T
        high = np.array([np.inf if w % 4 == 0 else rng.integers(scores[o].min() - 2, scores[o].max() + 3) for w, o in enumerate(owner)])
        low = np.array([-np.inf if w % 4 == 0 else h - rng.integers(-1, 2 + 3 * spread * spread) for w, h in enumerate(high)])
        w, r, score = first_in_windows(anchors, rows, ids, allowed, owner, low, high, 5)
        got = {}
        for a, b, s in zip(w, r, score):
            assert scores[owner[a], b] == s and allowed[owner[a], b]
            got.setdefault(a, []).append((-s, ids[b]))
        for a, o in enumerate(owner):
            fit = sorted((-scores[o, b], ids[b]) for b in range(150) if allowed[o, b] and low[a] <= scores[o, b] <= high[a])[:5]
            assert got.get(a, []) == fit, (dims, a)


def plain_negatives(rows, every, positives, negatives, low, high, scale):
    rows = {(i, lab, tuple(math.floor(scale * c) for c in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for a in rows:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))
        alike = [b for b in rows if len(b[2]) == len(a[2]) and b != a]
        for p in sorted((b for b in alike if b[1] == a[1]), key=lambda b: (-score(b), b[0]))[:positives]:
            fit = [b for b in alike if b[1] != a[1] and low * score(p) <= 100 * score(b) <= high * score(p)]
            for rank, b in enumerate(sorted(fit, key=lambda b: (-score(b), b[0]))[:negatives]):
                out.append((a[0], p[0], rank + 1, b[0], score(p), score(b)))
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    base = [[R.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, R.choice([0, 0, 0, 0, 1, 2]), [c + R.gauss(0, 0.4) for c in R.choice(base)]) for i in range(400)]
    rows += [(400 + i, 0, base[0]) for i in range(60)]  # equal vectors: ties by id
    rows += rows[::20]  # repeated rows
    rows += [(900, 1, [0.0] * 12), (901, 2, [0.0] * 12), (910, 1, None), (911, None, base[1]), (None, 1, base[1]), (920, 1, [float("nan")] * 12)]
    rows += [(930, 1, base[1][:5]), (940, 1, [1.0, None]), (950, 2, []), (951, 1, []), (952, 2, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, rows_per_task=60, anchors_per_task=9).collect()
    want = plain_negatives(rows, 10, 5, 10, 30, 90, 256)
    assert sorted(tuple(r) for r in got) == want and len(want) > 500
    assert mine_hard_negatives(df.limit(0), F.lit(True)).count() == 0


# ---- repeated passages


def plain_passages(rows, width):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_rolling_hashes_and_intervals():
    words = [str(R.randrange(3)).encode() for _ in range(500)]
    hashes = word_hashes(words)
    keys = window_keys(hashes, 4)
    of = {}
    for i, k in enumerate(keys):
        assert of.setdefault(tuple(words[i : i + 4]), k) == k
    assert len(set(of.values())) == len(of) and len(keys) == 497
    hit = np.zeros(40, bool)
    hit[[0, 3, 8, 20, 24]] = True
    starts, ends = intervals(hit, 4)
    assert list(zip(starts, ends)) == [(0, 7), (8, 12), (20, 28)] or list(zip(starts, ends)) == [(0, 12), (20, 28)]


@pytest.mark.parametrize("chunk_windows, bucket_windows", [(50, 40), (2_000_000, 2_000_000)])
def test_passages_equal_brute_force(spark, chunk_windows, bucket_windows):
    vocabulary = ["a", "b", "é", "😀", "Ab"]
    prose = lambda n: R.choice([" ", "\n", " \t "]).join(R.choice(vocabulary) for _ in range(n))
    passages = [prose(R.randint(5, 40)) for _ in range(4)]
    rows = [(i, " ".join([prose(R.randint(0, 12)), R.choice(passages), prose(R.randint(0, 6))])) for i in range(150)]
    rows += [(200 + i, "\x0bone passage that stands in every document of this group " + prose(i % 3)) for i in range(100)]
    rows += [(400, "w " * 3000), (401, "w " * 2000), (402, None), (403, ""), (404, " \n"), (405, "a b"), (None, passages[0]), (None, None)]
    rows += [(3, rows[3][1]), (5, prose(9)), (500, "a b " * 8), (501, "a b " * 7)]
    df = spark.createDataFrame([(*r, "x", {"k": 1}) for r in rows], "doc_id long, text string, kept string, n map<string,int>").repartition(5)
    got = remove_repeated_passages(df, width=6, chunk_windows=chunk_windows, bucket_windows=bucket_windows).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert found == plain_passages(rows, 6)
    assert all(sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_removed"] for r in got)
    assert all(r["source"]["kept"] == "x" and r["source"]["n"] == {"k": 1} for r in got)
    assert remove_repeated_passages(df.limit(0)).count() == 0
