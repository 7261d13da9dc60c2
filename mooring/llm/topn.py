"""Top N items in every group: a bounded heap per group, merged like a partial aggregate.

Each input task keeps, per group, only its N best distinct items.  That state is
mergeable: an item among the group's overall N best beats all but N-1 others, hence
is among the N best of any task that saw its best score.  So at most N rows per
group and task are shuffled, however many rows a hot group has, and the same heap
merges them after the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task buffers before it shrinks its heaps, and kept rows at which it hands them on.
PENDING_ROWS, KEPT_ROWS = 1 << 18, 1 << 17


def _shrink(table: pa.Table, n: int) -> pa.Table:
    """The n best distinct items of each group of ``table`` (columns grp, item, score)."""
    best = table.group_by(["grp", "item"]).aggregate([("score", "max")]).rename_columns(["grp", "item", "score"])
    best = best.sort_by([("grp", "ascending"), ("score", "descending"), ("item", "ascending")])
    codes = best["grp"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    group = codes.indices.to_numpy(zero_copy_only=False)
    if not len(group):
        return best
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return best.filter(pa.array(rank < n))


def _heap(n: int, grouped: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a task's rows.  ``grouped``: rows of a group are neighbours, so every
    group but the last is complete once rows of another follow, and can be let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        schema = None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            rows += batch.num_rows
            if rows < PENDING_ROWS:
                continue
            kept = _shrink(pa.Table.from_batches(held), n)
            if grouped:
                last = kept["grp"][-1].as_py()
                first_of_last = kept["grp"].index(last).as_py()
                yield from kept.slice(0, first_of_last).cast(schema).to_batches()
                kept = kept.slice(first_of_last)
            elif kept.num_rows > KEPT_ROWS:
                yield from kept.cast(schema).to_batches()
                kept = kept.slice(0, 0)
            held, rows = kept.cast(schema).to_batches(), kept.num_rows
        if held:
            yield from _shrink(pa.Table.from_batches(held), n).cast(schema).to_batches()

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best distinct items of each group, as (group, item, score, rank).

    An item counts with its highest score in the group; ties go to the smaller item by
    its bytes.  Rows whose group, item or score is null, or whose score is NaN, don't
    count; a group without any other row is absent.  Repeated rows count once.  Groups
    with fewer than ``n`` items come out whole; an empty table gives no rows.  Other
    columns, whatever their names, are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    # "+ 0.0" makes -0.0 equal to 0.0 in sorting
    rows = df.select(
        F.col(group).cast("string").alias("grp"),
        F.col(item).cast("string").alias("item"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("score"),
    ).where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    schema = "grp string, item string, score double"
    partial = rows.mapInArrow(_heap(n, grouped=False), schema)
    merged = partial.repartition("grp").sortWithinPartitions("grp").mapInArrow(_heap(n, grouped=True), schema)
    return merged.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score))
