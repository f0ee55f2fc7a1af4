"""Whitening and hard negatives beside plain versions."""

import math

import numpy as np
import pytest

from reqsift.llm import negatives, whitening
from reqsift.llm.vectors import products

SCHEMA = "vec_id long, label long, embedding array<float>, x string, n string"


def rows_of(seed, count, size, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((labels, size))
    out = []
    for i in range(count):
        label = int(rng.integers(labels))
        vector = middle[label] + 0.8 * rng.standard_normal(size)
        out.append((i, label, [float(np.float32(c)) for c in vector], "a", "b"))
    # copies, and rows that take no part
    out += [(1000 + i, r[1], r[2], "a", "b") for i, r in enumerate(out[:10])]
    out += [
        (2000, 1, None, "", ""), (2001, 1, [float("nan")] * size, "", ""), (2002, 1, [None] * size, "", ""),
        (2003, 1, [float("inf")] + [0.0] * (size - 1), "", ""), (2004, 1, [1.0], "", ""), (2005, 1, [], "", ""),
    ]
    return out


def whole(vector):
    return [math.floor(256 * c) for c in vector]


@pytest.mark.parametrize("size", [1, 3, 12])
def test_whitening_equals_a_plain_version(table, size):
    rows = rows_of(size, 120, size)
    got = whitening.whitened(table(rows, SCHEMA)).collect()
    taken = [(r[0], whole(r[2])) for r in rows if r[0] < 2000 or (size == 1 and r[0] == 2004)]
    fit = np.array(sorted({tuple(x) for _, x in taken}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    most = min(4, size)
    assert len(got) == len(taken) * most
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for vec_id, x in taken:
        for c in range(most):
            (r,) = by_row[vec_id, c + 1]
            assert r.n == n
            assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
            assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9
            assert r.identity_error < 1e-9
            want = (np.array(x) - sums / n) @ vectors[:, c] / math.sqrt(values[c])
            sign = signs.setdefault(c, 1 if want * r.whitened >= 0 else -1)
            assert abs(sign * r.whitened - want) < 1e-8


def test_whitening_of_equal_and_of_no_vectors(table):
    equal = [(i, 0, [0.5, 0.25], "", "") for i in range(4)]
    assert whitening.whitened(table(equal, SCHEMA)).collect() == []
    assert whitening.whitened(table([(1, 0, None, "", "")], SCHEMA)).collect() == []
    assert whitening.whitened(table([], SCHEMA)).columns[:2] == ["vec_id", "component"]
    # one direction of variance, ids null and repeated, -0.0, and numbers past a long
    some = [(None, 0, [1.0, -0.0], "", ""), (1, 0, [2.0, 0.0], "", ""), (1, 0, [2.0, 0.0], "", "")]
    got = whitening.whitened(table(some, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 9))) for r in got) == [
        (0, 1, 2, 1.0), (1, 1, 2, 1.0), (1, 1, 2, 1.0),
    ]
    huge = [(1, 0, [3e38, 1.0], "", ""), (2, 0, [-3e38, 2.0], "", "")]
    got = whitening.whitened(table(huge, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_inertia_and_contours_find_all_eigenvalues():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 16):
        for kind in range(4):
            a = rng.standard_normal((size, size + 2))
            a = a @ a.T
            if kind == 1:
                a = np.eye(size) * 3
            if kind == 2:
                b = rng.standard_normal((size, 1))
                a = b @ b.T
            values = np.linalg.eigvalsh(a)
            shift = rng.uniform(-1, values.max() + 1)
            assert whitening.above(a, shift) == (values > shift).sum()
            found, vectors = whitening.principal(a, 4)
            rank = (values > 1e-9 * values.sum()).sum()
            assert np.allclose(found, values[::-1][: min(4, rank)], rtol=1e-9)
            assert np.abs(a @ vectors - vectors * found).max(initial=0) < 1e-10 * values.max()


def plain_negatives(rows, anchors, positives=5, negatives_=3):
    least = {}
    for r in rows:
        if r[0] is None or r[1] is None or not r[2] or any(c is None or not math.isfinite(c) for c in r[2]):
            continue
        row = (r[1], whole(r[2]))
        least[r[0]] = min(least.get(r[0], row), row)
    usual = max((len(v[1]), v) for v in least.values())[0] if least else 0
    least = {i: v for i, v in least.items() if len(v[1]) == usual}
    out = []
    for a, (label, x) in least.items():
        if not anchors(a):
            continue
        score = lambda i: sum(p * q for p, q in zip(x, least[i][1]))
        order = sorted((i for i in least if i != a), key=lambda i: (-score(i), i))
        for p in [i for i in order if least[i][0] == label][:positives]:
            fits = lambda i: 50 * score(p) <= 100 * score(i) <= 95 * score(p)
            for rank, i in enumerate([i for i in order if least[i][0] != label and fits(i)][:negatives_], 1):
                out.append((a, p, rank, i, score(p), score(i)))
    return sorted(out)


@pytest.mark.parametrize("seed,size,block", [(1, 2, 40), (2, 6, 1000), (3, 16, 25)])
def test_negatives_equal_a_plain_version(table, seed, size, block):
    rows = rows_of(seed, 200, size)
    rows += [(None, 1, [1.0] * size, "", ""), (3000, None, [1.0] * size, "", ""), (3001, 2, [0.0] * size, "", "")]
    rows += [(5, 3, [0.5] * size, "", ""), (4000, 0, [-1.0] * size, "", ""), (4000, 0, [-1.0] * size, "", "")]
    stored = table(rows, SCHEMA)
    got = negatives.mined(stored, stored.filter("vec_id % 5 = 0"), block=block)
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_of_little(table):
    none = table([], SCHEMA)
    assert negatives.mined(none, none).collect() == []
    one = table([(50, 1, [1.0, 2.0], "", "")], SCHEMA)
    assert negatives.mined(one, one).collect() == []


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-400, 400, (60, 8))
    x[3], x[4] = 0, x[5]
    units = np.linalg.qr(rng.standard_normal((8, 3)))[0].T

    class Some(negatives.Rows):
        def __init__(self, x):
            self.ids, self.x, self.norm = np.arange(len(x)), x, np.linalg.norm(x, axis=1)
            cosine = x / np.maximum(self.norm, 1e-9)[:, None] @ units.T
            self.angles = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)

    low, high = negatives.bounds(Some(x), Some(x))
    score = x @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low).mean() < 2 * (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)).mean()
    big = np.array([[2**40, 2**20], [2**62, 2**62]])
    assert products(big, big).tolist() == [2**63 - 1, 2**63 - 1]
    assert products(big[:1], np.array([[3, 5]])).tolist() == [3 * 2**40 + 5 * 2**20]
