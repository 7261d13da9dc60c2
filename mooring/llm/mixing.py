"""Mixing sources to target weights by distributed prefix sums.

Records get hash-random keys.  Within a source they are ordered by key, without sorting
a whole source in one place: the key names one of the source's ranges, of which there are
as many as its number of records asks for; the ranges' sums are added up first, and each
range then adds its own records.  A source's budget is cut at its place in that order; what
exceeds the source's size is filled by repeating it whole, up to its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of one range, whose sums one task adds up.
RANGE_ROWS = 50_000


def random_key(key: str, seed: int) -> Column:
    """A whole number in [0, 2^52) from a hash of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")


def prefix_sums(df: DataFrame, group: str, key: str, size: str, seed: int = 0) -> DataFrame:
    """``df`` with ``before``: the sum of the sizes of the group's records that precede a
    record in the random order of the seed, and ``whole``: the group's total.  The groups
    must be few enough for one row of each to be broadcast."""
    totals = df.groupBy(group).agg(F.ceil(F.count("*") / RANGE_ROWS).alias("_ranges"), F.sum(size).alias("whole"))
    rows = df.withColumn("_rand", random_key(key, seed)).join(F.broadcast(totals), group)
    rows = rows.withColumn("_range", F.floor(F.col("_rand") / float(1 << 52) * F.col("_ranges")).cast("int")).drop("_ranges")
    ranges = rows.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))  # one row for RANGE_ROWS records
    along = Window.partitionBy(group).orderBy("_range")
    offsets = ranges.select(group, "_range", (F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy(group, "_range").orderBy("_rand", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_before", F.sum(size).over(inside) - F.col(size))
    return summed.join(offsets, [group, "_range"]).withColumn("before", F.col("_before") + F.col("_offset")).drop("_rand", "_range", "_before", "_offset")


def _budgets(targets: DataFrame, sizes: DataFrame, total: int | str | None) -> DataFrame:
    """Per mix and source: budget, full epochs and what the last, partial one takes."""
    t = targets.select("mix_id", "source", "target_share", "max_repeats").join(sizes, "source", "left").withColumn("whole", F.coalesce("whole", F.lit(0)))
    mix = Window.partitionBy("mix_id")
    if total == "reachable":
        most = F.min(F.when(F.col("target_share") > 0, F.col("max_repeats") * F.col("whole") / F.col("target_share"))).over(mix)
    else:
        most = F.sum("whole").over(mix) if total is None else F.lit(total)
    want = F.col("target_share") * most
    t = t.withColumn("budget", F.least(want, (F.col("max_repeats") * F.col("whole")).cast("double"))).withColumn("wanted", want)
    epochs = F.when(F.col("whole") > 0, F.floor(F.col("budget") / F.col("whole"))).otherwise(0).cast("int")
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("whole"))


def mix(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for ``docs`` (source, doc_id, tokens) and ``targets`` (mix_id, source,
    target_share, max_repeats), which must be small: one row per mix and source.

    A mix's total size is ``total`` tokens, or all tokens of its sources; then a source whose
    cap binds gives less than its share, the others' budgets stay as they are, and so their
    actual shares end above their targets.  ``total="reachable"`` takes the largest size at
    which no cap binds, so that every share is met: 0 if a source with a share has none.  Each source's
    budget is its share of that, at most max_repeats times what it has.  chosen has
    (mix_id, source, doc_id, tokens, repeats); a record at the cut is taken if at least
    half of it lies within the budget, so a source misses its budget by half a record at
    most.  shares reports, per mix and source, wanted and chosen tokens and the actual
    share of the mix.  Sources that lack documents come out with what they have, even
    none.  Records with null source or id or without tokens are never chosen; records of
    one id are separate records; a mix without any tokens has null shares.
    """
    if targets.count() > 100_000:
        raise ValueError("targets must be a small table")
    wanted = F.broadcast(targets.select("source").distinct())
    rows = docs.select("source", "doc_id", "tokens").where("source is not null and doc_id is not null and tokens > 0").join(wanted, "source", "left_semi")
    placed = prefix_sums(rows, "source", "doc_id", "tokens", seed)
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("whole"))
    budgets = _budgets(targets, sizes, total)
    take = F.col("epochs") + F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    chosen = (placed.drop("whole").join(F.broadcast(budgets), "source").withColumn("repeats", F.least(take, "max_repeats").cast("int"))
              .where("repeats > 0").select("mix_id", "source", "doc_id", "tokens", "repeats"))
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("docs"), F.max("repeats").alias("most_repeats"))
    shares = (budgets.join(got, ["mix_id", "source"], "left")
              .select("mix_id", "source", "target_share", "max_repeats", F.col("whole").alias("available_tokens"), F.round("wanted", 3).alias("wanted_tokens"),
                      F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")))
    everything = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return chosen, shares.withColumn("actual_share", F.when(everything > 0, F.col("tokens") / everything))
