"""Similarity clusters of embeddings by density peaks over blocked neighbour joins.

Two records are alike if their vectors have one length and a cosine of at least the
threshold.  Equal vectors are collapsed first.  Then:

1. *Blocks.*  Each vector is turned by a few fixed random rotations.  Under each, it is
   put into the cells of its ``probes`` largest coordinates (with their signs), or of
   combinations of several rotations' where a table is so large that one rotation's cells
   would not fit a task.  The number of rotations is chosen for each length of vectors, so
   that ``miss`` bounds the chance that a pair exactly at the threshold is compared under
   none of them; closer pairs are missed far more rarely.  A cell with more rows than a task
   holds is cut into parts, and every pair of its parts is a task of its own.  A task joins
   its rows by matrix products in 32 bits.  Of the pairs that may be alike it hands on as
   few as keep its connected rows connected, and it doesn't compare rows that are connected
   already, so a dense crowd costs little.  What is connected over all tasks is a block: no
   two records of different blocks are alike.
2. *Densities.*  The rows of a block are joined with each other by 64-bit products.  A
   record's density is the number of other records alike to it.
3. *Peaks.*  Each record points to its nearest denser alike record (of equally dense ones
   that of smaller id counts as denser); those without one are peaks, and following the
   pointers labels every record with its peak.
4. *Joined peaks.*  Peaks whose followers are alike across labels belong together when
   clusters are to be maximal connected sets.

Blocks of more than PART_ROWS vectors are cut into parts as well, every pair of which is a
task, twice: for the densities, and then for the pointers.  Results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.llm.components import connected_components
from mooring.shared import materialise, release

#: Bytes of the 16-bit vectors of one part of a cell; a task holds two parts at most.
PART_BYTES = 32 << 20
#: Rows above which a task turns its rows once more before it compares them.
FULL_ROWS = 32_768
#: Vectors of one part of a block.
PART_ROWS = 16_384
#: A bound on the error of a cosine of 16-bit vectors, and of one of 64-bit vectors.
ROUNDING, EPS = 2e-3, 1e-12
#: The chance that a task that turns its rows again misses a pair at the threshold; the number
#: of rotations makes up for it.
INNER_MISS = 0.005
#: Products that a task holds at once.
TILE = 1 << 20


def rotation(dim: int, number: int) -> np.ndarray:
    """The fixed random rotation ``number`` for vectors of length ``dim``."""
    q, r = np.linalg.qr(np.random.default_rng((dim, number)).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=1024)
def shared_cell_chance(dim: int, cosine: float, probes: int, trials: int = 4000) -> float:
    """The chance that two unit vectors at ``cosine`` share a cell under one rotation."""
    g = np.random.default_rng(7)
    x, e = g.normal(size=(2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(1, keepdims=True) * x
    n = np.linalg.norm(e, axis=1, keepdims=True)
    y = cosine * x + (1 - cosine**2) ** 0.5 * e / np.where(n > 0, n, 1)
    a, b = _top_cells(x, probes), _top_cells(y, probes)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def rotations(dim: int, threshold: float, miss: float, probes: int, depth: int = 1) -> int:
    """How many times ``depth`` rotations bound by ``miss`` the chance that a pair of vectors of
    length ``dim`` at the threshold is never compared.  Tasks of different ones turn large
    inputs differently, so their misses are independent."""
    chance = shared_cell_chance(dim, threshold, probes) ** depth * (1 - INNER_MISS)
    return 1 if chance >= 1 else max(1, ceil(log(miss) / log(1 - chance)))


def depth_of(dim: int, rows: int, probes: int, part_bytes: int = PART_BYTES) -> int:
    """How many coordinates make a cell, so that an average one of ``rows`` vectors fits a part."""
    cells, depth = max(2.0, 2 * dim / min(probes, dim)), 1
    while rows / cells**depth > part_bytes / (2 * dim) and depth < 6:
        depth += 1
    return depth


def _top_cells(turned: np.ndarray, probes: int) -> np.ndarray:
    p = min(probes, turned.shape[1])
    top = np.argpartition(-np.abs(turned), p - 1, axis=1)[:, :p]
    return top * 2 + (np.take_along_axis(turned, top, 1) < 0)


def _cells(threshold: float, miss: float, probes: int, depths: dict[int, int]):
    """(dim, spin, cell, rep, vec16) rows: the cells of each vector, vectors as float16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            lists = batch.column("vec")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = unit(flat[start[rows][:, None] + np.arange(d)]).astype(np.float32)
                small = x.astype(np.float16)
                vec = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * d * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(small).tobytes())])
                depth = depths[d]
                for spin in range(rotations(d, threshold, miss, probes, depth)):
                    each = [_top_cells(x @ rotation(d, spin * depth + t), probes) for t in range(depth)]
                    for places in product(range(each[0].shape[1]), repeat=depth):
                        cell = sum(c[:, p].astype(np.int64) * (2 * d) ** t for t, (c, p) in enumerate(zip(each, places)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), spin, np.int32)), pa.array(cell), pa.array(reps[rows]), vec],
                            names=["dim", "spin", "cell", "rep", "vec"])

    return run


def _cell_counts(threshold: float, miss: float, probes: int, depths: dict[int, int]):
    """(dim, spin, cell, n) per batch: the sizes of the cells without their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cells(threshold, miss, probes, depths)(batches):
            cell, n = np.unique(batch.column("cell").to_numpy(), return_counts=True)
            dim, spin = batch.column("dim")[0].as_py(), batch.column("spin")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), v, np.int32)) for v in (dim, spin)] + [pa.array(cell), pa.array(n)], names=["dim", "spin", "cell", "n"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, however large or small they were."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _roots(up: np.ndarray) -> np.ndarray:
    """Where following ``up`` ends."""
    while (up[up] != up).any():
        up = up[up]
    return up


class Connected:
    """Which of n rows are connected so far, and the links that made them so."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connects a[k] with b[k]; of these links as many are kept as there are sets fewer."""
        x, y = self.label[a], self.label[b]
        up = np.arange(len(self.label))
        while len(apart := np.flatnonzero(x != y)):
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            # every set that isn't the lowest of those it meets joins the lowest one
            high, low = np.maximum(x, y), np.minimum(x, y)
            first = np.lexsort((low, high))
            first = first[np.r_[True, np.diff(high[first]) != 0]]
            up[high[first]] = low[first]
            self.links.append((a[first], b[first]))
            up = _roots(up)
            x, y = up[x], up[y]
        self.label = up[self.label]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(side) for side in zip(*self.links))


def _connect(x: np.ndarray, rows: np.ndarray, low: float, found: Connected) -> None:
    """Connects all of ``rows`` whose cosine is at least ``low``.  Rows are taken by their sets,
    and rows of one set are only compared with those of others."""
    while len(rows) > 1:
        rows = rows[np.argsort(found.label[rows], kind="stable")]
        label = found.label[rows]
        size = max(1, TILE // len(rows))
        own = int(np.searchsorted(label, label[0], side="right"))
        # as many rows of the first set as a tile holds, or else rows of several sets
        take = min(own, 8 * size) if own > size // 2 else min(size, len(rows))
        tile = rows[:take]
        others = rows[own:] if take <= own and own > 1 else rows
        for at in range(0, len(tile) if len(others) else 0, max(1, TILE // max(1, len(others)))):
            part = tile[at:at + max(1, TILE // len(others))]
            hit = np.flatnonzero(x[part] @ x[others].T >= low)
            found.join(part[hit // len(others)], others[hit % len(others)])
        rows = rows[take:]


def _task_links(x: np.ndarray, low: float, spin: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows of a task that may be alike.  Many rows are turned again and
    compared by cells; one task misses a pair by INNER_MISS then, independently of others."""
    n, dim = x.shape
    found = Connected(n)
    if n <= FULL_ROWS:
        _connect(x, np.arange(n), low, found)
        return found.pairs()
    chance = shared_cell_chance(dim, low, probes)
    turns = 1 if chance >= 1 else max(1, ceil(log(INNER_MISS) / log(1 - chance)))
    for turn in range(turns):
        cells = _top_cells(x @ rotation(dim, 1_000_000 + spin * turns + turn), probes)
        for cell in np.unique(cells):
            _connect(x, np.flatnonzero((cells == cell).any(1)), low, found)
    return found.pairs()


def _links_of_task(threshold: float, probes: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(block["rep"].to_numpy(), return_index=True)
        dim = int(block["dim"].iloc[0])
        x = np.frombuffer(b"".join(block["vec"].to_numpy()[first]), np.float16).reshape(len(ids), dim).astype(np.float32)
        a, b = _task_links(x, threshold - ROUNDING, int(block["spin"].iloc[0]), probes)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return run


def distinct_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(members, vectors), both written tables: members has each distinct (id, rep), vectors
    one row (rep, vec) per distinct vector, numbered by rep.  Vectors are told apart by 128
    bits."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        & F.exists("vec", lambda v: v != 0))
    hashed = rows.withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(1), "vec")})
    vectors = materialise(hashed.select("h", "g", "vec").dropDuplicates(["h", "g"]).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    members = hashed.select("id", "h", "g").distinct().join(vectors.select("h", "g", "rep"), ["h", "g"]).select("id", "rep")
    return materialise(members, "members"), vectors.select("rep", "vec")


def candidate_links(vectors: DataFrame, threshold: float, miss: float = 1e-4, probes: int = 3, part_bytes: int = PART_BYTES) -> DataFrame:
    """(a, b), a written table: few links that connect all vectors that may be alike."""
    spark = vectors.sparkSession
    counts = {r["d"]: r["n"] for r in vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    depths = {d: depth_of(d, n, probes, part_bytes) for d, n in counts.items()}
    cells = vectors.mapInArrow(_cells(threshold, miss, probes, depths), "dim int, spin int, cell long, rep long, vec binary")
    # only cells beyond a part are collected, whose number is bounded by the rows over a part's
    sizes = vectors.mapInArrow(_cell_counts(threshold, miss, probes, depths), "dim int, spin int, cell long, n long").groupBy("dim", "spin", "cell").agg(F.sum("n").alias("n"))
    hot = [(*tuple(r)[:3], ceil(r["n"] * 2 * r["dim"] / part_bytes)) for r in sizes.where(F.col("n") * 2 * F.col("dim") > part_bytes).collect()]
    if hot:
        parts = spark.createDataFrame(hot, "dim int, spin int, cell long, parts int")
        cells = cells.join(F.broadcast(parts), ["dim", "spin", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        cells = cells.withColumn("own", own).withColumn("part", F.explode(_pairs_of(F.col("own"), F.col("parts"))))
    else:
        cells = cells.withColumn("part", F.lit(0))
    return materialise(cells.groupBy("dim", "spin", "cell", "part").applyInPandas(_links_of_task(threshold, probes), "a long, b long").distinct(), "links")


def _pairs_of(own, parts):
    """The pairs of parts that a row of part ``own`` is in, as numbers."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own))


def _denser(density: np.ndarray, other: np.ndarray, place: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the columns' rows are denser than the rows', the earlier one of equals."""
    return (other > density) | ((other == density) & (of < place))


def small_blocks(x: np.ndarray, weight: np.ndarray, threshold: float):
    """(density, up, label) of several blocks of one size, x (blocks, rows, dim): the number of
    other records alike, the place of the nearest denser row, and the first row connected."""
    s = x @ x.transpose(0, 2, 1)
    near = s >= threshold - EPS
    n = x.shape[1]
    near[:, np.arange(n), np.arange(n)] = True
    density = (near * weight[:, None, :]).sum(2) - 1
    place = np.broadcast_to(np.arange(n), density.shape)
    above = near & _denser(density[:, :, None], density[:, None, :], place[:, :, None], place[:, None, :])
    up = np.where(above.any(2), np.where(above, s, -2).argmax(2), place)
    label = place
    while ((new := np.where(near, label[:, None, :], n).min(2)) != label).any():
        label = new
    return density, up, label


def large_block(x: np.ndarray, weight: np.ndarray, threshold: float):
    """As small_blocks, for one block, by tiles."""
    n, step = len(x), max(1, TILE // len(x))
    density, up, found = np.zeros(n, np.int64), np.arange(n), Connected(n)
    for at in range(0, n, step):
        near = x[at:at + step] @ x.T >= threshold - EPS
        near[np.arange(len(near)), np.arange(at, at + len(near))] = True
        density[at:at + step] = near @ weight - 1
    place = np.arange(n)
    for at in range(0, n, step):
        s = x[at:at + step] @ x.T
        near = s >= threshold - EPS
        i, j = np.nonzero(near)
        found.join(at + i, j)
        above = near & _denser(density[at:at + step, None], density[None, :], place[at:at + step, None], place[None, :])
        up[at:at + step] = np.where(above.any(1), np.where(above, s, -2).argmax(1), place[at:at + step])
    return density, up, found.label


def _whole_blocks(threshold: float):
    """Densities, peaks and components of blocks, whose rows follow each other in order of
    their names, many blocks at a time."""
    names = ["rep", "density", "peak", "component"]

    def solved(table: pa.Table) -> pa.RecordBatch:
        rep, block, weight = (table[c].to_numpy() for c in ("rep", "block", "weight"))
        lists = pa.concat_arrays(table["vec"].chunks)
        dims = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[first, len(block)])
        density, peak, component = (np.zeros(len(rep), np.int64) for _ in range(3))
        kinds = np.stack([size, dims[first]], 1)
        for n, d in np.unique(kinds, axis=0).tolist():
            of = first[(kinds == (n, d)).all(1)]
            group = max(1, TILE // (n * n)) if n * n <= TILE else 1
            for at in range(0, len(of), group):
                rows = of[at:at + group, None] + np.arange(n)
                x = unit(flat[start[rows][..., None] + np.arange(d)])
                if n * n <= TILE:
                    dense, up, label = small_blocks(x, weight[rows], threshold)
                else:
                    dense, up, label = (v[None] for v in large_block(x[0], weight[rows[0]], threshold))
                while ((more := np.take_along_axis(up, up, 1)) != up).any():
                    up = more
                density[rows] = dense
                peak[rows], component[rows] = (rep[np.take_along_axis(rows, v, 1)] for v in (up, label))
        return pa.RecordBatch.from_arrays([*map(pa.array, (rep, density, peak, component))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= PART_ROWS:
                table = pa.Table.from_batches(held)
                block = table["block"].to_numpy()
                cut = int(np.searchsorted(block, block[-1]))
                if cut:
                    yield solved(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(block) - cut
        if rows:
            yield solved(pa.Table.from_batches(held))

    return run


def _follow(pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """(rep, peak): pointer doubling over (rep, up); roots point to themselves."""
    now = materialise(pointers, "pointers")
    for _ in range(rounds):
        ahead = now.select(F.col("rep").alias("up"), F.col("up").alias("next"))
        was, now = now, materialise(now.select("rep", "up").join(ahead, "up").select("rep", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")), "pointers")
        release(was)
        if now.where("moved").isEmpty():
            return now.select("rep", F.col("up").alias("peak"))
    raise RuntimeError("pointers have a cycle")


def _cut_blocks(rows: DataFrame, sizes: DataFrame, threshold: float, part_rows: int) -> DataFrame:
    """As _whole_blocks for ``rows`` (block, rep, name, weight, vec) of blocks of more than
    part_rows rows, ``sizes`` (block, n): every pair of a block's parts is a task."""
    large = sizes.where(F.col("n") > part_rows).select("block", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))

    def paired(df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        return df.join(F.broadcast(large), "block").withColumn("own", own).withColumn("pair", F.explode(_pairs_of(F.col("own"), F.col("parts"))))

    def sides(t: pd.DataFrame):
        """Rows of the pair's first part against all of its second."""
        x, parts = unit(np.stack(t["vec"])), int(t["parts"].iloc[0])
        i, j = divmod(int(t["pair"].iloc[0]), parts)
        own = t["own"].to_numpy()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        step = max(1, TILE // max(1, len(b)))
        for at in range(0, len(a), step):
            yield a[at:at + step], b, x[a[at:at + step]] @ x[b].T, i != j

    def dense(t: pd.DataFrame) -> pd.DataFrame:
        weight, out = t["weight"].to_numpy(), np.zeros(len(t), np.int64)
        for a, b, s, both in sides(t):
            near = s >= threshold - EPS
            near |= a[:, None] == b[None, :]
            out[a] += near @ weight[b]
            if both:
                out[b] += weight[a] @ near
        return pd.DataFrame({"rep": t["rep"], "density": out})

    def point(t: pd.DataFrame) -> pd.DataFrame:
        rep, density = t["rep"].to_numpy(), t["density"].to_numpy()
        place = np.empty(len(t), np.int64)
        place[np.argsort(t["name"].to_numpy(), kind="stable")] = np.arange(len(t))
        best, up, found = np.full(len(t), -2.0), np.arange(len(t)), Connected(len(t))
        for a, b, s, both in sides(t):
            near = s >= threshold - EPS
            i, j = np.nonzero(near)
            found.join(a[i], b[j])
            for rows, columns, sim, alike in ((a, b, s, near), (b, a, s.T, near.T))[:1 + both]:
                above = alike & _denser(density[rows, None], density[None, columns], place[rows, None], place[None, columns])
                sim = np.where(above, sim, -2)
                at = sim.argmax(1)
                value = sim[np.arange(len(rows)), at]
                better = value > best[rows]
                best[rows[better]], up[rows[better]] = value[better], columns[at[better]]
        a, b = found.pairs()
        return pd.DataFrame({"rep": np.r_[rep, rep[a]], "up": np.r_[rep[up], rep[b]], "cosine": np.r_[best, np.zeros(len(a))], "link": np.arange(len(rep) + len(a)) >= len(rep)})

    tasks = paired(rows.select("block", "rep", "weight", "vec")).groupBy("block", "pair")
    density = materialise(tasks.applyInPandas(dense, "rep long, density long").groupBy("rep").agg((F.sum("density") - 1).alias("density")), "density")
    tasks = paired(rows.join(density, "rep")).groupBy("block", "pair")
    found = materialise(tasks.applyInPandas(point, "rep long, up long, cosine double, link boolean"), "found")
    pointers = found.where(~F.col("link")).groupBy("rep").agg(F.max_by("up", "cosine").alias("up"))
    links = found.where("link")
    component = connected_components(links, "rep", "up").select(F.col("node").alias("rep"), "component")
    return _follow(pointers).join(density, "rep").join(component, "rep", "left").select("rep", "density", "peak", F.coalesce("component", "rep").alias("component"))


def density_peaks(vectors: DataFrame, names: DataFrame, threshold: float, miss: float = 1e-4, part_bytes: int = PART_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(rep, density, peak, component), a written table, for every vector with another one in
    its block; a component is a maximal set of vectors connected by likeness, made of one or
    more peaks' followers.  ``names`` (rep, name, weight) has each vector's smallest id and
    number of ids."""
    links = candidate_links(vectors, threshold, miss, part_bytes=part_bytes)
    blocks = materialise(connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("block")), "blocks")
    rows = blocks.join(vectors, "rep").join(names, "rep").select("block", "rep", "name", "weight", "vec")
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    result = "rep long, density long, peak long, component long"
    large = sizes.where(F.col("n") > part_rows)
    if large.isEmpty():
        return materialise(rows.repartition("block").sortWithinPartitions("block", "name").mapInArrow(_whole_blocks(threshold), result), "peaks")
    rows = materialise(rows, "rows")
    # blocks of more rows than a part are few
    small = rows.join(F.broadcast(large.select("block")), "block", "left_anti")
    whole = small.repartition("block").sortWithinPartitions("block", "name").mapInArrow(_whole_blocks(threshold), result)
    return materialise(whole.unionByName(_cut_blocks(rows, large, threshold, part_rows)), "peaks")


def clusters(df: DataFrame, key: str, vector: str, threshold: float = 0.9, miss: float = 1e-4, part_bytes: int = PART_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """One row (cluster_id, id, density, is_peak, size) per id that is alike to another id, step
    by step; cluster_id is the cluster's smallest id, density the number of other records (ids
    with their vectors) alike to it.  An id is a peak if none of them is denser, or as dense
    with a smaller id.

    Null ids, null and empty vectors, vectors of zeros and those with null, NaN or infinite
    elements take no part.  Vectors of different lengths are never alike.  Ids with equal
    vectors form a cluster even if no other vector is near.  An id with several vectors
    connects them and has the largest of their densities.  Repeated rows count once; an
    empty table gives no rows; other columns are ignored.
    """
    members, vectors = distinct_vectors(df, key, vector)
    names = members.groupBy("rep").agg(F.min("id").alias("name"), F.count("*").alias("weight"))
    peaks = density_peaks(vectors, names, threshold, miss, part_bytes, part_rows)
    labelled = (members.join(names, "rep").join(peaks, "rep", "left")
                .select("id", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("density", F.col("weight") - 1).alias("density"),
                        ((F.coalesce("peak", "rep") == F.col("rep")) & (F.col("id") == F.col("name"))).alias("is_peak")))
    labelled = materialise(labelled, "labelled")
    # ids with several vectors join their components; usually there are none
    split = labelled.groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("id")
    if not split.isEmpty():
        own = labelled.join(split, "id", "left_semi").select("id", "component").distinct()
        low = own.groupBy("id").agg(F.min("component").alias("low"))
        more = connected_components(own.join(low, "id"), "component", "low").select(F.col("node").alias("component"), F.col("component").alias("root"))
        labelled = labelled.join(more, "component", "left").withColumn("component", F.coalesce("root", "component"))
    per_id = labelled.groupBy("component", "id").agg(F.max("density").alias("density"), F.max("is_peak").alias("is_peak"))
    sizes = per_id.groupBy("component").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return per_id.join(sizes, "component").select("cluster_id", "id", "density", "is_peak", F.col("n").alias("size"))


def describe_clusters(found: DataFrame, relevance: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, peaks, typical) per cluster of ``found``: its most typical members
    are its densest ones, the higher best relevance (id, relevance) and then the smaller
    id deciding ties.  At most ``typical`` rows of a cluster and task are shuffled."""
    best = relevance.where(F.col("relevance").isNotNull() & ~F.isnan("relevance")).groupBy("id").agg(F.max("relevance").alias("relevance"))
    rows = found.join(best, "id", "left").withColumn("r", F.coalesce("relevance", F.lit(float("-inf"))))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("density"), F.desc("r"), "id")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    named = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).getField("id").alias("typical"))
    totals = found.groupBy("cluster_id").agg(F.max("size").alias("size"), F.sum(F.col("is_peak").cast("int")).alias("peaks"))
    return totals.join(named, "cluster_id").select("cluster_id", "size", "peaks", "typical")
