"""Hard negatives against a plain Python version, and the residue products against Python's integers."""

import math
import random

import numpy as np
import pytest

from riskflow.llm import hard_negatives as hn


def reference(rows):
    v = []
    for i, label, x in dict.fromkeys((i, lab, None if x is None else tuple(x)) for i, lab, x in rows):
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for a in v:
        if a[0] % 100:
            continue
        score = lambda r: sum(p * q for p, q in zip(a[2], r[2], strict=False))  # noqa: B023, E731
        best = lambda rows, n: sorted(rows, key=lambda r: (-score(r), r[0]))[:n]
        for pos in best([r for r in v if r[1] == a[1] and r is not a], 5):
            s = score(pos)
            found = best([r for r in v if r[1] != a[1] and 30 * s <= 100 * score(r) <= 90 * s], 10)
            out += [(a[0], pos[0], k, r[0], s, score(r)) for k, r in enumerate(found, 1)]
    return sorted(out)


def vectors(n, dim, spread, seed=1):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, rnd.randint(0, 9), [float(np.float32(spread * (m + rnd.gauss(0, 0.4)))) for m in mids[i % 4]]) for i in range(n)]
    for i in range(20, 60):  # a vector shared by many rows: ties
        rows[i] = (i, rows[i][1], rows[20][2])
    return rows


def mined(spark, rows):
    extra = [(i, lab, x, 1.0, 2, "a", 3) for i, lab, x in rows]
    df = spark.createDataFrame(extra, "vec_id long, label int, embedding array<float>, score double, rank int, mark string, anchor_id int").repartition(5)
    got = hn.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread", [0.1, 5000.0])
def test_equal_to_plain_python(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "CELLS", 40 * 6)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    monkeypatch.setattr(hn, "GROUP", 3)
    rows = vectors(430, 6, spread)
    rows += [rows[100], rows[100], rows[33], (None, 1, [0.1] * 6), (500, None, [0.1] * 6), (600, 2, None), (700, 2, [0.1, None, 0.1, 0.1, 0.1, 0.1]),
             (800, 2, [math.inf] + [0.1] * 5), (801, 2, [math.nan] + [0.1] * 5), (900, 3, []), (901, -4, [0.2 * spread] * 6), (903, -4, [0.1 * spread] * 6)]
    want = reference(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, [1.0])]) == []


def test_unequal_lengths(spark):
    rows = [(i, i % 3, [1.0] * (1 + i % 4)) for i in range(120)]
    assert mined(spark, rows) == reference(rows)


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [3e7, 3e7]), (1, 1, [1e30, 1.0])])


def test_residue_products():
    rnd = np.random.default_rng(4)
    for size, dim in ((300, 64), (2**15, 2500), (2**30, 3)):
        a, r = rnd.integers(-size, size, (5, dim)), rnd.integers(-size, size, (7, dim))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in r] for p in a]
        bound = max(int(sum(int(x) ** 2 for x in v)) for v in [*a, *r])
        assert hn.scores(a, r, bound).tolist() == want
    edge = np.array([[2**31 - 1, 2**15]])
    assert hn.scores(edge, -edge, 2**62).tolist() == [[-(2**31 - 1) ** 2 - 2**30]]
    assert hn.scores(np.zeros((2, 0), int), np.zeros((3, 0), int), 1).tolist() == [[0] * 3] * 2


def test_first_places_with_ties():
    s = np.array([[3, 5, 5, 1, 5]])
    for bound in (10, 2**61):
        assert hn._first(s, 3, bound)[0].tolist() == [[1, 2, 4]]
        assert hn._first(s, -1, bound)[0].tolist() == [[1, 2, 4, 0, 3]]
        assert hn._first(s[:, :2], 4, bound)[1].tolist() == [[5, 3]]
