from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mooring.functions.vectors import distance_matrix
from mooring.operators import render as R
from mooring.operators import search as S


def problem(seed, n, weight=0.02, penalty=0.01, dim=5):
    g = np.random.default_rng(seed)
    rho = g.random(n)
    return S.Problem(distance_matrix(g.normal(size=(n, dim))), rho / rho.sum(), g.integers(1, 90, n) / 1000, weight, penalty)


def test_objective_of_hand_made_distances():
    d = np.array([[0, 0.9, 1], [0.9, 0, 1], [1, 1, 0]])
    p = S.Problem(d, np.array([0.49, 0.49, 0.02]), np.zeros(3))
    assert p.objective([0, 1])["total"] == pytest.approx(0.02) and p.objective([0, 2])["total"] == pytest.approx(0.441)
    assert p.objective([])["total"] == np.inf
    for bad in ([0, 0], [3]):
        with pytest.raises(ValueError):
            p.objective(bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 5))
def test_exact_search_is_the_best_combination(seed, n, k):
    p = problem(seed, n + 3)
    sample = np.arange(n) + 2
    anchors, exact, count = S.exact(p, sample, k)
    kk = min(k, n)
    every = {c: round(p.objective(c, sample)["total"], S.DECIDE) for c in combinations(sample.tolist(), kk)}
    assert exact and count == len(every) and tuple(anchors) == min(every, key=lambda c: (every[c], c))
    assert p.objective(S.greedy(p, sample, kk), sample)["total"] >= every[tuple(anchors)] - 1e-8


def test_exact_search_ties_and_cap():
    p = S.Problem(np.ones((4, 4)) - np.eye(4), np.full(4, 0.25), np.zeros(4))
    assert S.exact(p, range(4), 2)[0] == [0, 1]
    with pytest.raises(ValueError):
        S.exact(p, range(4), 2, max_combinations=5)
    assert S.exact(p, range(4), 2, 5, require_exact=False) == ([0, 1], False, 6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 14), st.integers(1, 4), st.integers(0, 4))
def test_refinement_never_worsens_and_history_falls(seed, n, k, iterations):
    p = problem(seed, n)
    g = np.random.default_rng(seed)
    start, pool = g.permutation(n)[:min(k, n)].tolist(), np.flatnonzero(g.random(n) < 0.7)
    got = S.refine(p, start, pool, iterations)
    assert got.after["total"] <= got.before["total"] and len(got.anchors) == len(start) == len(set(got.anchors))
    assert got.history == sorted(got.history, reverse=True) and len(got.history) <= iterations + 1
    assert got.accepted == (got.after["total"] < got.before["total"])
    assert sum(got.cluster_sizes) == (n if iterations else 0)
    assert set(got.anchors) <= set(pool.tolist()) | set(start)


def test_refinement_moves_to_the_centre_and_stops():
    x = np.array([0.0, 0.1, 1.0, 1.1])
    p = S.Problem(np.abs(x[:, None] - x[None, :]), np.array([0.4, 0.3, 0.2, 0.1]), np.zeros(4))
    got = S.refine(p, [1, 3], range(4), 2)
    assert got.anchors == [0, 2] and got.accepted and len(got.history) == 3 and got.history[-1] == pytest.approx(0.04)
    flat = S.refine(S.Problem(np.zeros((3, 3)), np.full(3, 1 / 3), np.zeros(3)), [1, 2], range(3), 3)
    assert not flat.accepted and flat.history == [0, 0]


def test_node_and_token_budgets():
    rho = np.array([0.2, 0.2, 0.9, 0.8])
    d = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :]) / 10
    order = R.turn_order("global_top_rho", [0, 1], d, rho)
    assert order == [0, 1, 2, 3]
    assert R.take(order, [0, 1], [1, 1, 10, 1], 3, None) == [0, 1, 3]  # the large one is passed over, not the end
    assert R.take(order, [0, 1], [1, 1, 10, 1], 100, 1) == [0, 1]  # anchors are never refused
    assert R.take(order, [0, 1], [1, 1, 10, 1], 100, 0) == order
    assert R.turn_order("anchor_only", [2, 2, 0], d, rho) == [2, 0]
    with pytest.raises(ValueError):
        R.turn_order("none", [0], d, rho)


def test_cells_and_nearest_come_before_the_rest():
    d = np.ones((6, 6)) * 0.9
    d[:3, :3] = d[3:, 3:] = 0.1
    np.fill_diagonal(d, 0)
    rho = np.array([0.05, 0.50, 0.10, 0.05, 0.45, 0.15])
    assert R.turn_order("cell_top_rho", [0, 3], d, rho)[:4] == [0, 3, 1, 4]
    assert R.turn_order("nearest", [0, 3], d, rho, evidence=1)[:4] == [0, 3, 1, 4]


def test_distances_of_zero_and_broken_vectors():
    d = distance_matrix(np.array([[1.0, 0], [0, 0], [2.0, 0], [-1.0, 0]]))
    assert d[0, 1] == pytest.approx(0.5) and d[0, 2] == 0 and d[0, 3] == pytest.approx(1) and (np.diag(d) == 0).all()
    assert distance_matrix(np.eye(2), "cosine")[0, 1] == 1
    with pytest.raises(ValueError):
        distance_matrix(np.array([[np.nan, 1.0]]))


def test_distances_are_checked():
    from mooring.functions.vectors import checked_distances

    d = distance_matrix(np.eye(3))
    assert checked_distances(d) is d
    for bad in (np.zeros((2, 3)), -np.eye(2), np.array([[0.0, 1], [2, 0]]), np.array([[0.0, np.nan], [np.nan, 0]])):
        with pytest.raises(ValueError):
            checked_distances(bad)
