"""Whitening and near copies of embeddings against numpy."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from webtraj.llm import pivots, whitening

ROWS = "vec_id long, embedding array<float>, label int, `key` string, id string, n_links string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "kept", "kept", "kept") for i, v, l in rows], ROWS)


def clustered(seed, spreads, groups=30, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 8))):
            rows.append(base + rng.standard_normal(dim) * rng.choice(spreads))
        if g % 5 == 0:
            rows.append(base * 3)
    big = rng.standard_normal(dim)
    rows += [big + rng.standard_normal(dim) * spreads[-1] for _ in range(700)]
    return [[float(np.float32(x)) for x in r] for r in rows]


def brute_links(rows, threshold=0.98):
    unit, links, head = {}, [0] * len(rows), list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v) / np.linalg.norm(v)
    places = sorted(unit)
    for n, a in enumerate(places):
        for b in places[n + 1:]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                head[high] = low
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least.get(find(k)) if k in unit else i) for k, (i, _, _) in enumerate(rows)]


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    vectors = clustered(3, [0.0, 0.005, 0.01])
    rows = [(i, v, i % 3 // 2) for i, v in enumerate(vectors)]
    out = sorted(tuple(r) for r in pivots.near_vectors(frame(spark, rows)).collect())
    want = brute_links(rows)
    assert [(i, n, c) for i, n, c, _ in out] == want
    assert all(kept == (i == c) for i, _, c, kept in out)
    assert sum(n for _, n, _ in want) > 10_000


def test_loose_groups_lose_next_to_nothing(spark):
    """Groups as wide as the threshold, where the index is allowed to miss one pair in a thousand."""
    rows = [(i, v, 0) for i, v in enumerate(clustered(4, [0.14, 0.2, 0.1]))]
    out = sorted(tuple(r) for r in pivots.near_vectors(frame(spark, rows)).collect())
    want = brute_links(rows)
    assert all(got[1] <= brute[1] for got, brute in zip(out, want))
    assert sum(r[1] for r in out) >= 0.998 * sum(r[1] for r in want) > 100_000


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        w = rng.standard_normal(64)
        w -= (w @ a) * a
        w /= np.linalg.norm(w)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (a * 0.9802 + w * math.sqrt(1 - 0.9802 ** 2)).tolist(), 1)]
    out = {r["vec_id"]: r for r in pivots.near_vectors(frame(spark, rows)).collect()}
    found = sum(out[2 * k + 1]["component_id"] == 2 * k for k in range(400))
    assert found >= 0.99 * 400
    assert all(r["n_links"] <= 1 for r in out.values())


def test_copies_and_unusable_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [2.0, 0.001], 1), (4, [1.0, 0.0], 2), (6, [1.0, 0.0], None),
            (7, None, 1), (8, [], 1), (10, [0.0, 0.0], 1), (11, [float("nan"), 1.0], 1), (12, [float("inf"), 1.0], 1), (13, [None, 1.0], 1),
            (14, [1.0, 0.0, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [1e-30, 0.0], 1), (None, [0.0, -1.0], 1), (None, None, 1)]
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    out = sorted([tuple(r) for r in pivots.near_vectors(frame(spark, rows)).collect()], key=key)
    assert [r[:3] for r in out] == sorted(brute_links(rows), key=key)
    assert [r[3] for r in out] == [r[0] is not None and r[0] == r[2] for r in out]


def test_no_vectors(spark):
    assert pivots.near_vectors(frame(spark, [])).collect() == []
    alone = pivots.near_vectors(frame(spark, [(1, None, 1), (2, [0.0], None)])).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_forest_spans_what_is_linked():
    rng = np.random.default_rng(1)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    rows, columns = pivots.forest(near, True)
    assert rows is columns or (rows == columns).all()
    reach = np.linalg.matrix_power((near | np.eye(60, dtype=bool)).astype(float), 60) > 0
    assert (rows == reach.argmax(1)).all()


# ---- whitening ----------------------------------------------------------------------------------

def integers(vectors):
    return np.floor(64 * np.array(vectors, dtype=np.float64))


def checked(spark, vectors, components=32):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, components=components)
    rows = sorted(whitening.whiten(df, model).collect())
    x = integers(vectors)
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    e, u = e[::-1], u[:, ::-1]
    k = len(model.eigenvalues)
    assert k == min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    np.testing.assert_allclose(model.explained, e[:k] / e.sum(), rtol=1e-9)
    np.testing.assert_allclose((model.vectors ** 2).sum(0), np.ones(k), rtol=1e-14)
    got = np.array([r["whitened"] for r in rows]).reshape(len(rows), k)
    if k:
        np.testing.assert_allclose(got.T @ got / len(got), np.eye(k), atol=1e-9)
        assert model.identity_error < 1e-9
    s = [int(v) for v in x.sum(0)]
    assert [int(r["deviation"]) for r in rows] == [sum((len(x) * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    return model, got, c, e, u


def test_components_equal_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) / 8).tolist()
    model, got, c, e, u = checked(spark, vectors)
    sign = np.sign((u * model.vectors).sum(0))
    np.testing.assert_allclose(model.vectors, u * sign, atol=1e-10)
    np.testing.assert_allclose(got, c @ (u * sign) / np.sqrt(e), atol=1e-8)
    assert checked(spark, vectors, 5)[0].explained == model.explained[:5]


def test_equal_and_vanishing_eigenvalues(spark):
    corners = [[x, y, z, 0.5, 0.0] for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 2.0)]
    model = checked(spark, corners)[0]
    assert len(model.eigenvalues) == 3 and model.explained == [pytest.approx(4 / 6), pytest.approx(1 / 6), pytest.approx(1 / 6)]
    assert abs(model.vectors[:, 1] @ model.vectors[:, 2]) < 1e-15
    assert checked(spark, [[1.0, 2.0]] * 4)[0].eigenvalues == []
    assert checked(spark, [[0.25]])[0].n == 1


def test_eigenvalues_closer_than_doubles_see(spark):
    big = [[x * 2.0 ** 24, y * 2.0 ** 24] for x in (-1, 1) for y in (-1, 1)]
    model = checked(spark, [*big, [2.0 ** -6, 0.0]])[0]
    assert model.eigenvalues[0] > model.eigenvalues[1]
    assert abs(abs(model.vectors[0, 0]) - 1) < 1e-12


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.5]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]),
            (7, [float("-inf"), 0.0]), (8, [-3.0, 0.25])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, id string, whitened string")
    model = whitening.fit(df)
    out = whitening.whiten(df, model).collect()
    assert model.n == 4 and sorted(str(r["vec_id"]) for r in out) == ["1", "1", "8", "None"]
    none = df.where("vec_id = 2")
    assert whitening.whiten(none, whitening.fit(none)).collect() == []


def test_exact_parts(spark):
    rng = np.random.default_rng(4)
    for largest in (5, 1 << 19, 1 << 33, whitening.LARGEST):
        rows = rng.integers(-largest, largest + 1, (50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j])) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(rows).tolist() == want
    # (x - 3)^2 (x - 5) x
    f, different = whitening.characteristic(spark, np.array([[3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]], dtype=object))
    assert f == [0, -45, 39, -11, 1] and different == 3
    assert [(float(r), m) for r, m in whitening.real_roots(f, different, 9)] == [(5.0, 1), (pytest.approx(3), 2)]
    found = whitening.null_vectors([[2, 1], [1, 2]], Fraction(3), 1)
    np.testing.assert_allclose(found, [[math.sqrt(0.5)] * 2], rtol=1e-15)
    assert Decimal(1) and next(whitening.primes_below(100)) == 97
