import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from mooring.llm import topn

SCHEMA = "g string, item string, s double, grp string, score string"


def brute(rows, n):
    best = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, float("-inf")))
    return {(g, i, s) for g, items in best.items() for i, s in sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n]}


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in topn.top_n_per_group(df, "g", "item", "s", n).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force_with_dirt_ties_and_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", *"abcdef", None]), r.choice([f"é{r.randrange(40)}", f"n{r.randrange(60)}", None]),
             r.choice([None, float("nan"), -1.0, 0.0, -0.0, 0.5, r.random(), float("inf")])) for _ in range(3000)]
    rows += rows[:200]
    for n in (1, 5):
        assert run(spark, rows, n) == brute(rows, n)


def test_small_buffers_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    rows = [(f"g{r.randrange(50)}", f"n{r.randrange(30)}", r.randrange(6) / 2) for _ in range(4000)]
    table = pa.table({"grp": [x[0] for x in rows], "item": [x[1] for x in rows], "score": [x[2] for x in rows]})
    monkeypatch.setattr(topn, "PENDING_ROWS", 100)
    monkeypatch.setattr(topn, "KEPT_ROWS", 60)
    parts = list(topn._heap(3, grouped=False)(iter(table.to_batches(max_chunksize=37))))
    merged = pa.Table.from_batches(parts).sort_by("grp")
    final = pa.Table.from_batches(list(topn._heap(3, grouped=True)(iter(merged.to_batches(max_chunksize=41)))))
    assert {tuple(d.values()) for d in final.to_pylist()} == brute(rows, 3)
    assert final.num_rows == len(brute(rows, 3))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("wxyz"), st.integers(0, 3).map(float)), max_size=30), st.integers(1, 4), st.integers(1, 29))
def test_partial_heaps_merge_exactly(rows, n, cut):
    def table(part):
        return pa.table({"grp": [r[0] for r in part], "item": [r[1] for r in part], "score": [r[2] for r in part]}, pa.schema([("grp", "string"), ("item", "string"), ("score", "float64")]))

    both = pa.concat_tables([topn._shrink(table(rows[:cut]), n), topn._shrink(table(rows[cut:]), n)])
    assert {tuple(d.values()) for d in topn._shrink(both, n).to_pylist()} == brute(rows, n)


def test_empty_table_and_bad_n(spark):
    assert run(spark, [], 5) == set()
    with pytest.raises(ValueError):
        run(spark, [], 0)
