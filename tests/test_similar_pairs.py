"""Similar vectors against brute force: counts, groups, hot families and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators.components import components
from plumbline.operators.similar_pairs import bands_for, similar_vectors


def brute(rows, threshold):
    """rows: (key, vector)."""
    classes = {}
    for k, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            classes.setdefault(tuple(x + 0.0 for x in v), []).append(k)
    vectors, keys = list(classes), list(classes.values())
    links = {i: set() for i in range(len(vectors))}
    for d in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        x = np.array([vectors[i] for i in at])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = np.round(x @ x.T, 12) >= threshold
        for i, j in zip(*np.nonzero(close)):
            if i != j:
                links[at[i]].add(at[j])
    group = {}
    for i in range(len(vectors)):
        if i in group:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        group |= dict.fromkeys(seen, min(min(keys[j]) for j in seen))
    return {
        (min(keys[i]), len(keys[i]), len(links[i]), sum(len(keys[j]) for j in links[i]), group[i]) for i in range(len(vectors))
    }


@pytest.mark.parametrize("cell_rows", [60, 4096])
def test_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(cell_rows)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(300)]
    centre = rng.standard_normal(24)
    rows += [(1000 + i, (centre + 0.25 * rng.standard_normal(24)).tolist()) for i in range(400)]  # a hot family, many near the border
    for f in range(30):  # small families and chains
        at = rng.standard_normal(24)
        for i in range(4):
            rows.append((2000 + 10 * f + i, at.tolist()))
            at = at + 0.3 * rng.standard_normal(24)
    rows += [(5000 + i, rows[3][1]) for i in range(50)]  # exact copies
    rows += [(6000, None), (6001, [0.0] * 24), (6002, [float("nan")] * 24), (6003, [1.0, None]), (6004, []), (6005, [2.0, 1.0]), (6006, [4.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {tuple(r) for r in similar_vectors(df, "k", "v", 0.92, cell_rows=cell_rows).collect()}
    want = brute(rows, 0.92)
    assert len(got) == len(want) and got - want == want - got == set(), (len(got), len(want), sorted(got - want)[:3], sorted(want - got)[:3])
    assert sum(r[2] for r in want) > 10_000  # links that no row stands for
    assert similar_vectors(df.limit(0), "k", "v").count() == 0


def test_bands_keep_the_chance_of_a_miss():
    for n in (10, 10**5, 10**9):
        for threshold in (0.8, 0.92, 0.999, 1.0):
            bits, bands = bands_for(n, threshold, 1e-6)
            same = 1 - np.arccos(threshold) / np.pi
            assert (1 - min(same**bits, 1 - 1e-12)) ** bands <= 1e-6 * 1.001 and bits <= 30


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(999, 999)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
