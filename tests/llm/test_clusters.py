import numpy as np
import pytest

from mooring.llm import clusters

SCHEMA = "id string, vec array<double>, rep string, cell string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def sample(seed, centres=30, size=8, dim=24, spread=0.05, crowd=0):
    g = np.random.default_rng(seed)
    middle = unit(g.normal(size=(centres, dim)))
    x = np.concatenate([middle[i] + spread * g.normal(size=(g.integers(1, size), dim)) for i in range(centres)])
    if crowd:
        x = np.concatenate([x, middle[0] + 0.03 * g.normal(size=(crowd, dim))])
    # a chain whose ends are not alike
    a, b = unit(g.normal(size=(2, dim)))
    x = np.concatenate([x, [np.cos(t) * a + np.sin(t) * (b - (a @ b) * a) / np.linalg.norm(b - (a @ b) * a) for t in np.arange(0, 1.5, 0.35)]])
    return x * g.uniform(0.1, 9, size=(len(x), 1))


def brute(rows, threshold=0.9):
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for i, x in good:
        for j, y in good:
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold - 1e-12:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    groups = {}
    for i in list(up):
        groups.setdefault(root(i), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if len(g) > 1}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = clusters.clusters(df, "id", "vec", 0.9, **options).collect()
    assert len(got) == len({x["id"] for x in got})
    return got


def test_matches_brute_force_with_dirt(spark):
    x = sample(1)
    rows = [(f"n{k:03}", [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [("short", [1.0, 2.0]), ("short2", [1.1, 2.0]), ("null", None), ("empty", []), ("zero", [0.0] * 24), ("nan", [float("nan")] * 24), ("hole", [None] + [1.0] * 23),
             (None, rows[0][1]), ("copy", rows[7][1]), ("copy2", rows[7][1]), rows[4], ("n004", rows[90][1]), ("tiny", [v * 1e-200 for v in rows[9][1]])]
    got = run(spark, rows)
    want = brute([r for r in rows if r[0] != "tiny"])
    assert {(r["cluster_id"], r["id"]) for r in got if r["id"] != "tiny"} == want


def described(rows, threshold=0.9):
    """Of every id of a cluster: the number of ids alike to it, and whether none of them is denser."""
    names = sorted(i for i, _ in rows)
    x = unit(np.array([v for _, v in sorted(rows)], float))
    near = x @ x.T >= threshold - 1e-12
    np.fill_diagonal(near, False)
    density = near.sum(1)
    beaten = near & ((density[None, :] > density[:, None]) | ((density[None, :] == density[:, None]) & (np.arange(len(x))[None, :] < np.arange(len(x))[:, None])))
    return {names[k]: (int(density[k]), not beaten[k].any()) for k in range(len(x)) if density[k]}


@pytest.mark.parametrize("options", [{"part_bytes": 24 * 2 * 30}, {"part_bytes": 24 * 2 * 6}, {"part_rows": 25}])
def test_parts_give_what_whole_tasks_give(spark, options):
    rows = [(f"n{k:03}", v.tolist()) for k, v in enumerate(sample(2, crowd=120))] + [("copy", sample(2, crowd=120)[40].tolist())]
    assert clusters.depth_of(24, len(rows), 3, 24 * 2 * 30) == 1 < clusters.depth_of(24, len(rows), 3, 24 * 2 * 6)
    got = run(spark, rows, **options)
    assert {(r["cluster_id"], r["id"]) for r in got} == brute(rows)
    assert {r["id"]: (r["density"], r["is_peak"]) for r in got} == described(rows)


def test_densities_of_blocks_above_2048_rows(spark):
    # a crowd whose vectors are mostly, but not all, alike, and loose clusters beside it
    x = np.concatenate([sample(9, crowd=0), unit(np.eye(24)[0] + 0.062 * np.random.default_rng(9).normal(size=(3000, 24)))])
    rows = [(f"n{k:04}", v.tolist()) for k, v in enumerate(x)]
    want = described(rows)
    crowd = [d for i, (d, _) in want.items() if int(i[1:]) >= len(x) - 3000]
    assert max(crowd) > 2048 and min(crowd) < 0.7 * max(crowd)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    for options in ({}, {"part_rows": 1000}):
        got = clusters.clusters(df, "id", "vec", 0.9, **options).collect()
        assert {r["id"]: (r["density"], r["is_peak"]) for r in got} == want
    relevance = spark.createDataFrame([(i, float(k % 5)) for k, (i, _) in enumerate(rows)], "id string, relevance double")
    summary = {r["cluster_id"]: r for r in clusters.describe_clusters(clusters.clusters(df, "id", "vec", 0.9), relevance, 3).collect()}
    members = {}
    for r in got:
        members.setdefault(r["cluster_id"], []).append(r["id"])
    best = dict(map(tuple, relevance.collect()))
    for c, ids in members.items():
        assert summary[c]["typical"] == sorted(ids, key=lambda i: (-want[i][0], -best[i], i))[:3]
        assert summary[c]["size"] == len(ids) and summary[c]["peaks"] == sum(want[i][1] for i in ids)


def linked(n, a, b):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        p, q = sorted((root(i), root(j)))
        parent[q] = p
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    return {(f"{g[0]:04}", f"{i:04}") for g in groups.values() for i in g if len(g) > 1}


@pytest.mark.parametrize("crowd,full", [(0, 64), (400, 64), (400, 10**6)])
def test_tasks_connect_what_is_alike(monkeypatch, crowd, full):
    monkeypatch.setattr(clusters, "FULL_ROWS", full)
    monkeypatch.setattr(clusters, "INNER_MISS", 1e-6)
    monkeypatch.setattr(clusters, "TILE", 3000)
    x = unit(sample(3, centres=60, crowd=crowd)).astype(np.float32)
    a, b = clusters._task_links(x, 0.9, 0, 3)
    assert linked(len(x), a, b) == brute([(f"{k:04}", v.tolist()) for k, v in enumerate(x.astype(float))], 0.9)
    assert (np.einsum("ij,ij->i", x[a], x[b]) >= 0.9 - 1e-5).all() and len(a) < (3 if full < len(x) else 1) * len(x)


def pairs_at(seed, n, dim, low, high):
    """n random pairs with cosines from low to high: row 2k belongs to row 2k + 1."""
    g = np.random.default_rng(seed)
    x = unit(g.normal(size=(n, dim)))
    e = g.normal(size=(n, dim))
    e = unit(e - (e * x).sum(1, keepdims=True) * x)
    c = g.uniform(low, high, size=(n, 1))
    return np.stack([x, c * x + (1 - c**2) ** 0.5 * e], 1).reshape(2 * n, dim)


def test_tasks_of_other_rotations_miss_other_pairs(monkeypatch):
    monkeypatch.setattr(clusters, "FULL_ROWS", 512)
    x = pairs_at(11, 2500, 48, 0.903, 0.91).astype(np.float32)
    missed = []
    for spin in range(clusters.rotations(48, 0.9, 1e-4, 3)):
        a, b = clusters._task_links(x, 0.9 - clusters.ROUNDING, spin, 3)
        found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        missed.append({k for k in range(0, len(x), 2) if (k, k + 1) not in found})
    assert max(map(len, missed)) <= 3 * clusters.INNER_MISS * 2500
    assert not set.intersection(*missed)


@pytest.mark.parametrize("full", [512, 10**6])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, full):
    monkeypatch.setattr(clusters, "FULL_ROWS", full)
    x = pairs_at(12, 12_000, 16, 0.9001, 0.92)
    df = spark.createDataFrame([(f"{k:05}", v.tolist(), "x", "y") for k, v in enumerate(x)], SCHEMA)
    got = {r["id"]: r["cluster_id"] for r in clusters.clusters(df, "id", "vec", 0.9).collect()}
    lost = [k for k in range(0, len(x), 2) if got.get(f"{k:05}", 0) != got.get(f"{k + 1:05}", 1)]
    assert len(lost) <= 3


def test_each_length_has_its_own_number_of_rotations(spark):
    few, many = clusters.rotations(2, 0.9, 1e-4, 3), clusters.rotations(384, 0.9, 1e-4, 3)
    assert few < many
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)] + [(9, [1.0] + [0.0] * 383)], "rep long, vec array<double>")
    got = vectors.mapInArrow(clusters._cells(0.9, 1e-4, 3, {2: 1, 384: 1}), "dim int, spin int, cell long, rep long, vec binary").groupBy("dim").agg({"spin": "max"}).collect()
    assert dict(map(tuple, got)) == {2: few - 1, 384: many - 1}


def test_summary_names_dense_and_relevant_members(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.05]), ("c", [1.0, -0.05]), ("far", [0.0, 1.0]), ("far2", [0.0, 1.0]), ("alone", [-1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    relevance = spark.createDataFrame([("b", 0.2), ("b", 0.9), ("c", float("nan")), ("a", None), ("far2", 1.0)], "id string, relevance double")
    got = {r["cluster_id"]: (r["size"], r["typical"]) for r in clusters.describe_clusters(clusters.clusters(df, "id", "vec"), relevance, 2).collect()}
    assert got == {"a": (3, ["b", "a"]), "far": (2, ["far2", "far"])}


def test_empty_table(spark):
    assert run(spark, []) == []
