"""References whose parent is absent at their time, by compressed bitmaps.

References are first reduced to one row per key and period (month of the reference's
time) with the first and the last time asked for, so a hot key is a few rows.  Those rows
and the parents' life times are cut into key ranges, as many as their number asks for, each
a task's.  There keys are dictionary-encoded to dense integers, and for every period two
compressed bitmaps are made: of the keys that are referenced, and of those with a parent
alive from the first to the last of these times.  Reference AND NOT parent leaves the keys
that may lack one; only those bits are decoded.  Their references are found again by key
and period and held against the life times that touch the period's times.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.shared import materialise

#: Rows (keys by period, and life times) of one key range.
RANGE_ROWS = 200_000
FOREVER = np.iinfo(np.int64).max
DAY = 86_400_000_000


def micros(at: Column) -> Column:
    """A timestamp's microseconds as shown, whatever its kind and the session's zone."""
    day = F.unix_date(F.to_date(at)).cast("long") * DAY
    return day + (F.hour(at) * 3600 + F.minute(at) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def month_of(at: Column) -> Column:
    """Months since year 0 of microseconds."""
    day = F.date_from_unix_date(((at - F.pmod(at, F.lit(DAY))) / DAY).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


class Bitmap:
    """A set of small integers in containers of 2^16: the sorted low halves of a sparse one, the
    packed bits of a dense one, whichever is smaller."""

    BITS = 1 << 16

    def __init__(self, values: np.ndarray):
        values = np.unique(np.asarray(values, np.int64))
        high = values >> 16
        cuts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(values) else []
        self.parts = {int(high[i]): self._kept((values[i:j] & 0xFFFF).astype(np.uint16)) for i, j in zip(cuts, [*cuts[1:], len(values)])}

    @classmethod
    def _kept(cls, low: np.ndarray) -> np.ndarray:
        if 2 * len(low) <= cls.BITS // 8:
            return low
        marks = np.zeros(cls.BITS, bool)
        marks[low] = True
        return np.packbits(marks)

    @staticmethod
    def _low(part: np.ndarray) -> np.ndarray:
        return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part)).astype(np.uint16)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = Bitmap(np.zeros(0, np.int64))
        for key, mine in self.parts.items():
            theirs = other.parts.get(key)
            if theirs is None:
                left = mine
            elif mine.dtype == theirs.dtype == np.uint8:
                left = self._kept(self._low(mine & ~theirs))
            elif mine.dtype == np.uint16 and theirs.dtype == np.uint8:
                left = mine[(theirs[mine >> 3] >> (7 - (mine & 7)).astype(np.uint8) & 1) == 0]
            else:
                left = self._kept(np.setdiff1d(self._low(mine), theirs, assume_unique=True))
            if len(left):
                out.parts[key] = left
        return out

    def values(self) -> np.ndarray:
        found = [(key << 16) + self._low(part).astype(np.int64) for key, part in sorted(self.parts.items())]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _merged(code: np.ndarray, since: np.ndarray, until: np.ndarray):
    """Life times of each code as disjoint, sorted intervals."""
    order = np.lexsort((since, code))
    code, since, until = code[order], since[order], until[order]
    if not len(code):
        return code, since, until
    first = np.r_[True, code[1:] != code[:-1]]
    # running maximum of the ends within a code: ranks keep codes apart
    rank = np.argsort(np.argsort(until, kind="stable"), kind="stable") + np.cumsum(first) * len(code)
    best = np.maximum.accumulate(rank)
    end = np.sort(until, kind="stable")[best - np.cumsum(first) * len(code)]
    new = first | np.r_[True, since[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(code) - 1]
    return code[new], since[new], end[last]


def suspects(code: np.ndarray, month: np.ndarray, low: np.ndarray, high: np.ndarray, p_code: np.ndarray, since: np.ndarray, until: np.ndarray):
    """Of the rows (code, month, low, high), those that no life time covers from low to high:
    (rows, start, stop), the life times from start to stop of the merged ones being those
    that touch a row's times; and the merged life times."""
    p_code, since, until = _merged(p_code, since, until)
    times = np.unique(np.r_[since, until, low, high])
    width = len(times) + 1
    at = lambda c, t: c * width + np.searchsorted(times, t)
    begun = np.searchsorted(at(p_code, since), at(code, low), side="right")
    before = np.maximum(begun - 1, 0)
    if len(p_code):
        covered = (begun > 0) & (p_code[before] == code) & (until[before] > high)
    else:
        covered = np.zeros(len(code), bool)
    rows = []
    for period in np.unique(month):
        own = np.flatnonzero(month == period)
        left = Bitmap(code[own]).and_not(Bitmap(code[own[covered[own]]])).values()
        rows.append(own[np.isin(code[own], left)])
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    stop = np.searchsorted(at(p_code, since), at(code[rows], high[rows]), side="right")
    start = np.searchsorted(at(p_code, until), at(code[rows], low[rows]), side="right")
    return rows, np.minimum(start, stop), stop, since, until


LIVES = pa.list_(pa.struct([("since", pa.int64()), ("until", pa.int64())]))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suspects of a task's keys, which come in order, whole keys at a time."""
    held: list[pa.RecordBatch] = []

    def found(table: pa.Table) -> pa.RecordBatch:
        keys = table["key"].combine_chunks().dictionary_encode()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        code = keys.indices.to_numpy().astype(np.int64)
        low, high = table["low"].to_numpy(), table["high"].to_numpy()
        life = pc.is_null(table["month"]).to_numpy()
        month = table["month"].fill_null(0).to_numpy()
        ask = np.flatnonzero(~life)
        rows, start, stop, since, until = suspects(code[ask], month[ask], low[ask], high[ask], code[life], low[life], high[life])
        size = stop - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lives = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([pa.array(since[at]), pa.array(until[at])], ["since", "until"]))
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[ask][rows])), pa.array(month[ask][rows], pa.int32()), lives], names=["key", "month", "lives"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= RANGE_ROWS:
            table = pa.Table.from_batches(held)
            cut = table["key"].index(table["key"][-1]).as_py()
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if held:
        yield found(pa.Table.from_batches(held))


def orphan_references(refs: DataFrame, parents: DataFrame, payload: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct ``payload`` rows of ``refs`` (key string, at long, payload) for which no row of
    ``parents`` (key string, since long, until long) has since <= at < until.

    A null until is open-ended, a null since never alive; a null key in ``refs`` refers to
    nothing and gives no row, a null ``at`` is always an orphan.  A payload comes out if any
    of its references is an orphan.  Repeated rows and overlapping or repeated life times
    count once.  Empty tables are allowed on either side; other columns are ignored.
    """
    names = [f"_p{i}" for i in range(len(payload))]
    rows = refs.where("key is not null").select(F.col("key").alias("_key"), F.col("at").alias("_at"), *(F.col(c).alias(n) for c, n in zip(payload, names)))
    rows = rows.withColumn("_month", month_of(F.col("_at")))
    asked = rows.where("_at is not null").groupBy("_key", "_month").agg(F.min("_at").alias("low"), F.max("_at").alias("high"))
    lives = parents.where("key is not null and since is not null").groupBy("key", "since").agg(F.max(F.coalesce("until", F.lit(int(FOREVER)))).alias("until")).where("until > since")
    keyed = materialise(asked.select(F.col("_key").alias("key"), F.col("_month").alias("month"), "low", "high").unionByName(
        lives.select("key", F.lit(None).cast("int").alias("month"), F.col("since").alias("low"), F.col("until").alias("high"))), "keyed")
    ranges = max(1, ceil(keyed.count() / range_rows))
    left = materialise(keyed.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(
        _ranges, "key string, month int, lives array<struct<since:long,until:long>>"), "suspects")
    # nothing is partitioned by hand here, so a hot key's references can be split by the join
    again = rows.join(left, (F.col("_key") == F.col("key")) & (F.col("_month") == F.col("month")))
    dead = again.where(~F.exists("lives", lambda p: (p["since"] <= F.col("_at")) & (F.col("_at") < p["until"])))
    untimed = rows.where("_at is null")
    return dead.select(*names).unionByName(untimed.select(*names)).distinct().toDF(*payload)
