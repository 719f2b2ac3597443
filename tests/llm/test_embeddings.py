"""Whitening, exact top-k and k-means over embeddings against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from duskwatch.llm import clustering, exact_search, whitening
from duskwatch.llm.integer_vectors import products

SCHEMA = "vec_id bigint, embedding array<float>"
INF, NAN = float("inf"), float("nan")


def vectors(count: int, dim: int, seed: int = 3) -> list[list[float]]:
    draw = np.random.default_rng(seed)
    spread = np.linspace(1.0, 0.3, dim)
    return (draw.standard_normal((count, dim)) * spread).astype(np.float32).tolist()


def floors(rows, scale):
    return np.array([[math.floor(scale * float(np.float32(v))) for v in row] for row in rows], np.int64)


def odd_rows(dim: int) -> list[tuple]:
    return [(901, None), (902, [None] * dim), (903, [NAN] * dim), (904, [INF] + [0.0] * (dim - 1)), (905, []), (906, [1.0])]


# --- whitening ----------------------------------------------------------------


def whitened(spark, rows, schema=SCHEMA, **options):
    found = whitening.whiten(spark.createDataFrame(rows, schema), **options).collect()
    return {(r.vec_id, r.component): r for r in found}, found


def test_whitening_matches_dense_eigenvectors(spark):
    """Copies do not count in the fit and are projected like the rest."""
    usual = vectors(300, 12)
    rows = list(enumerate(usual)) + [(1000 + i, usual[0]) for i in range(150)] + [(7, usual[7]), (None, usual[9])] + odd_rows(12)
    found, all_rows = whitened(spark, rows)
    assert len(all_rows) == 4 * (300 + 150 + 2)
    x = floors(usual, 256)
    assert len(np.unique(x, axis=0)) == 300
    sums, centred = x.sum(axis=0), x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / 300)
    for c in range(4):
        e, v = values[-1 - c], directions[:, -1 - c]
        mine = np.array([found[i, c + 1].whitened for i in range(300)])
        truth = centred @ v / math.sqrt(e)
        sign = np.sign(mine @ truth)
        np.testing.assert_allclose(mine, sign * truth, atol=1e-9)
        assert found[1005, c + 1].whitened == found[0, c + 1].whitened
        assert found[0, c + 1].explained == pytest.approx(e / values.sum(), rel=1e-9)
    gap = 300 * x.astype(object) - sums
    assert [int(found[i, 1].deviation) for i in range(300)] == [int(s) for s in (gap * gap).sum(axis=1)]
    assert all(r.n == 300 and r.identity_error < 1e-9 for r in all_rows)


def test_whitening_finds_repeated_eigenvalues(spark):
    """Unit steps along every axis: all eigenvalues but one are equal."""
    dim = 6
    rows = [(i, [float(i == j) for j in range(dim)]) for i in range(dim)]
    found, all_rows = whitened(spark, rows, components=5)
    assert all(r.explained == pytest.approx(0.2, rel=1e-9) and r.identity_error < 1e-9 for r in all_rows)


def test_whitening_without_variance_or_rows(spark):
    _, same = whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert [(r.vec_id, r.component, r.n, r.whitened, r.explained) for r in sorted(same)] == [
        (i, c, 1, None, None) for i in (1, 2) for c in (1, 2)
    ]
    _, line = whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    assert [(r.component, r.whitened is None, r.explained) for r in line if r.vec_id == 1] == [(1, False, 1.0), (2, True, 0.0)]
    assert whitened(spark, [])[1] == [] and whitened(spark, odd_rows(3)[:5])[1] == []


def test_whitening_keeps_other_columns(spark):
    rows = [(i, v, "z", i) for i, v in enumerate(vectors(20, 3))]
    frame = spark.createDataFrame(rows, "n string, embedding array<float>, z string, vec_id bigint".replace("n string", "n bigint"))
    out = whitening.whiten(frame)
    assert out.columns == ["embedding", "z", "vec_id", *whitening.ADDED]
    assert {(r.n, r.z) for r in out.collect()} == {(20, "z")}


def test_whitening_of_huge_entries(spark):
    """Entries beyond 64 bits become the largest integer, so the last two vectors are one."""
    rows = [(i, [3e30 * i, -3e30]) for i in range(3)]
    _, found = whitened(spark, rows)
    assert len(found) == 6 and all(r.n == 2 for r in found)


# --- exact search -------------------------------------------------------------


def brute_top(queries, rows, k):
    out = []
    for qid, q in queries:
        scored = sorted(
            (-sum(a * b for a, b in zip(q, x)), i is None, i or 0) for i, x in rows if i != qid and len(x) == len(q)
        )
        out += [(qid, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def searched(spark, queries, rows, **options):
    found = exact_search.top_k(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("bins,group_values", [(128, 1 << 22), (8, 150)])
def test_search_matches_brute_force(spark, bins, group_values):
    """Many copies tie at and above the kth score; one of them is a query; groups of few queries."""
    usual = vectors(120, 6)
    rows = [(i * 50 - 1000, v) for i, v in enumerate(usual)] + [(10_000 + 7 * i, usual[3]) for i in range(60)]
    rows += [(None, usual[3]), (None, usual[5]), (4, usual[5]), (4, usual[5])]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0] + [(20_000, [0.0] * 6)]
    whole = [(i, list(map(int, x))) for i, x in zip([r[0] for r in rows], floors([r[1] for r in rows], 1024))]
    asked = [(i, list(map(int, x))) for i, x in zip([r[0] for r in queries], floors([r[1] for r in queries], 1024))]
    found = searched(spark, queries + queries[:3] + odd_rows(6)[:4], rows + odd_rows(6), bins=bins, group_values=group_values)
    assert found == brute_top(asked, whole, 10)


def test_search_of_short_and_empty_tables(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])]
    assert searched(spark, rows[:1], rows) == [(100, 1, 1, 1024 * 1024), (100, 2, 2, -1024 * 1024)]
    assert searched(spark, rows[:1], rows[:1]) == []
    assert searched(spark, rows[:1], []) == [] and searched(spark, [], rows) == []


def test_search_at_the_ends_of_the_id_range(spark):
    ends = [(-(1 << 63), [1.0]), ((1 << 63) - 1, [1.0]), (0, [1.0]), (None, [1.0])]
    found = searched(spark, [(0, [1.0])], ends, k=2)
    assert [(r[1], r[2]) for r in found] == [(1, -(1 << 63)), (2, (1 << 63) - 1)]


def test_products_are_exact_whatever_their_size():
    draw = np.random.default_rng(0)
    for top in (1 << 10, 1 << 29, 1 << 40):
        a, b = draw.integers(-top, top, (5, 7)), draw.integers(-top, top, (4, 7))
        exact = a.astype(object) @ b.T.astype(object)
        assert products(a, b).tolist() == np.clip(exact, -(1 << 63), (1 << 63) - 1).tolist()


# --- clustering ---------------------------------------------------------------


def lloyd(rows, k, rounds, seed="2"):
    """Plain rounds over integer vectors, in Python integers."""
    rank = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in rank[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [
            [sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)
        ]
    placed = [(i, *nearest(x)) for i, x in rows]
    inertia = {}
    for _, d, j in placed:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in placed], key=str)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_match_plain_rounds(spark, k):
    """Copies, ties on a coarse grid and odd rows; bounds spare most distances."""
    draw = np.random.default_rng(k)
    grid = (draw.integers(-3, 4, (400, 4)) / 2 + np.repeat(draw.integers(-20, 20, (8, 4)), 50, axis=0)).tolist()
    rows = list(enumerate(grid)) + [(1000 + i, grid[5]) for i in range(130)] + [(3, grid[3])]
    whole = [(i, list(map(int, x))) for (i, _), x in zip(rows, floors([r[1] for r in rows], 256))]
    frame = spark.createDataFrame(rows + odd_rows(4), SCHEMA).repartition(3)
    report = {}
    found = clustering.cluster(frame, k=k, rounds=5, dim=4, report=report)
    assert sorted(map(tuple, found.collect()), key=str) == lloyd(whole, k, 5)
    assert report["possible"] == len(rows) * k * 6
    assert k < 40 or report["evaluated"] < report["possible"] / 2


def test_bounds_hold_over_many_rounds(spark):
    rows = list(enumerate(vectors(200, 3)))
    whole = [(i, list(map(int, x))) for (i, _), x in zip(rows, floors([r[1] for r in rows], 1000))]
    found = clustering.cluster(spark.createDataFrame(rows, SCHEMA), k=12, rounds=12, dim=3, scale=1000)
    assert sorted(map(tuple, found.collect()), key=str) == lloyd(whole, 12, 12)


def test_clusters_of_few_or_huge_or_no_vectors(spark):
    few = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 0.0])]
    found = clustering.cluster(spark.createDataFrame(few, SCHEMA), dim=2, rounds=2).collect()
    assert sorted((str(r.vec_id), r.distance) for r in found) == [("1", 0), ("2", 0), ("None", 0)]
    assert clustering.cluster(spark.createDataFrame([], SCHEMA), dim=2).collect() == []
    huge = [(i, [1e15 * i, 0.0]) for i in range(6)]
    assert len(clustering.cluster(spark.createDataFrame(huge, SCHEMA), k=2, dim=2).collect()) == 6
