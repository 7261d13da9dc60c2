import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mooring.operators import orphans
from mooring.operators.orphans import orphan_references

MONTH = 30 * 86_400_000_000


def brute(refs, parents):
    out = set()
    for k, at, b in refs:
        if k is not None and not any(at is not None and p == k and s is not None and s <= at and (u is None or at < u) for p, s, u in parents):
            out.add((b,))
    return out


def run(spark, refs, parents, **options):
    left = spark.createDataFrame([(*r, 1) for r in refs], "key string, at long, batch string, block int")
    right = spark.createDataFrame([(*p, "z") for p in parents], "key string, since long, until long, batch string")
    got = [tuple(r) for r in orphan_references(left, right, ["batch"], **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(seed, n, keys=12, parents=40):
    r = random.Random(seed)
    t = lambda: r.randrange(6) * MONTH + r.choice([0, 1, r.randrange(MONTH)])
    refs = [(r.choice(["hot", f"k{r.randrange(keys)}", None]), r.choice([t(), t(), None]), f"b{r.randrange(n)}") for _ in range(n)]
    lives = [(r.choice(["hot", f"k{r.randrange(keys)}", None]), r.choice([t(), t(), None]), r.choice([None, t(), t()])) for _ in range(parents)]
    return refs + refs[:20], lives + lives[:10]


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    refs, parents = sample(seed, 300)
    assert run(spark, refs, parents) == brute(refs, parents)


@pytest.mark.parametrize("rows", [15, 40])
def test_ranges_are_cut_at_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_ROWS", rows)
    refs, parents = sample(7, 400, keys=30, parents=150)
    assert run(spark, refs, parents, range_rows=rows) == brute(refs, parents)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([10, 5_000, 40_000]), st.sampled_from([10, 5_000, 40_000]), st.sampled_from([60_000, 300_000]))
def test_bitmaps_are_sets(seed, n, m, top):
    g = np.random.default_rng(seed)
    a, b = g.integers(0, top, n), g.integers(0, top, m)
    left = orphans.Bitmap(a).and_not(orphans.Bitmap(b)).values()
    assert left.tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert all(part.nbytes <= 8192 for part in orphans.Bitmap(a).parts.values())


def test_edges_of_life_times(spark):
    parents = [("a", 10, 20), ("a", 20, 30), ("b", 5, 5), ("c", 0, None), ("d", 9, 3)]
    refs = [("a", 9, "before"), ("a", 10, "first"), ("a", 20, "joint"), ("a", 29, "last"), ("a", 30, "end"), ("b", 5, "empty"), ("c", 10**15, "open"), ("d", 5, "turned"), ("e", 1, "absent")]
    assert {b for b, in run(spark, refs, parents)} == {"before", "end", "empty", "turned", "absent"}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, 2)]) == set()
    assert run(spark, [("a", 1, "x"), (None, 1, "y")], []) == {("x",)}
