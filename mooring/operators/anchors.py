"""Relational forms of the anchor operators: distances, objective, cells, fill orders.

They keep one row per node.  A query's anchors, k at most, travel as one short array, so
nothing is joined pairwise; only the exact search of one or two anchors and the distance
relation itself pair a query's nodes, whose number the universe's cap bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.functions import vectors as V
from mooring.operators.universe import first_in_group

DECIDE = 9


def with_units(universe: DataFrame) -> DataFrame:
    """``unit``: the embedding divided by its length; ``cost``: tokens in thousands."""
    return universe.withColumns({"unit": V.unit(F.col("embedding")), "cost": F.col("tokens") / 1000.0})


def unit_distance(x: Column, y: Column, metric: str = "angular") -> Column:
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(V.dot(x, y), V.PLACES)))
    return F.acos(cos) / F.lit(V.np.pi) if metric == "angular" else 1 - cos


def pair_distances(universe: DataFrame, metric: str = "angular") -> DataFrame:
    """(query_id, i, j, d) for i < j.  Zero vectors have cosine 0 with every other."""
    rows = with_units(universe).select("query_id", "idx", "unit")
    a = rows.select("query_id", F.col("idx").alias("i"), F.col("unit").alias("u"))
    b = rows.select("query_id", F.col("idx").alias("j"), F.col("unit").alias("v"))
    return a.join(b, "query_id").where("i < j").select("query_id", "i", "j", unit_distance(F.col("u"), F.col("v"), metric).alias("d"))


def top_rho(universe: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, idx): the k eligible nodes of largest mass, lower index on ties."""
    return first_in_group(universe.where("eligible"), ["query_id"], [F.desc("rho"), F.asc("idx")], k, "pos", "idx").select("query_id", "pos", "idx")


def anchored(universe: DataFrame, anchors: DataFrame, metric: str = "angular") -> DataFrame:
    """The universe with ``near`` (distance to the nearest anchor), ``cell`` (its position, the
    first on ties) and ``to`` (the distances to all anchors by position)."""
    rows = with_units(universe)
    own = rows.select("query_id", "idx", "unit", "cost").join(anchors, ["query_id", "idx"])
    lists = own.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "idx", "unit", "cost"))).alias("anchors"))
    to = F.transform("anchors", lambda a: F.round(
        F.when(a["idx"] == F.col("idx"), F.lit(0.0)).otherwise(unit_distance(F.col("unit"), a["unit"], metric)), DECIDE))
    near = F.array_min(F.col("to"))
    # from here on anchors are known by position, index and cost, without their vectors
    return (rows.join(lists, "query_id").withColumn("to", to).withColumn("anchors", F.transform("anchors", lambda a: a.dropFields("unit")))
            .withColumn("near", near).withColumn("cell", (F.array_position("to", near) - 1).cast("long")))


def objective(rows: DataFrame, token_weight: float, anchor_penalty: float) -> DataFrame:
    """(query_id, coverage, token_penalty, anchor_penalty, total) of anchored rows."""
    cover = rows.groupBy("query_id").agg(F.sum(F.col("rho") * F.col("near")).alias("coverage"), F.first("anchors").alias("a"))
    tokens = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["cost"]) * token_weight
    return (cover.select("query_id", "coverage", tokens.alias("token_penalty"), (F.size("a") * F.lit(anchor_penalty)).alias("anchor_penalty"))
            .withColumn("total", F.col("coverage") + F.col("token_penalty") + F.col("anchor_penalty")))


def cell_sizes(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, pos, size): nodes per anchor, empty cells included."""
    counts = rows.groupBy("query_id", F.col("cell").alias("pos")).agg(F.count("*").alias("size"))
    return anchors.join(counts, ["query_id", "pos"], "left").select("query_id", "pos", F.coalesce("size", F.lit(0)).alias("size"))


def refine_step(rows: DataFrame, metric: str, token_weight: float) -> DataFrame:
    """(query_id, pos, old_idx, new_idx): each cell's eligible node of least in-cell cost, the
    lowest index on ties; a cell without one keeps its anchor."""
    inside = rows.select("query_id", "cell", "idx", "unit", "rho", "cost", "eligible")
    other = inside.select("query_id", "cell", F.col("idx").alias("v"), F.col("unit").alias("w"), F.col("rho").alias("mass"))
    d = F.round(F.when(F.col("idx") == F.col("v"), F.lit(0.0)).otherwise(unit_distance(F.col("unit"), F.col("w"), metric)), DECIDE)
    costs = (inside.where("eligible").join(other, ["query_id", "cell"]).groupBy("query_id", "cell", "idx")
             .agg(F.sum(F.col("mass") * d).alias("c"), F.first("cost").alias("cost")))
    best = costs.groupBy("query_id", F.col("cell").alias("pos")).agg(
        F.min_by("idx", F.struct(F.round(F.col("c") + token_weight * F.col("cost"), DECIDE), "idx")).alias("best"))
    old = rows.select("query_id", F.explode("anchors").alias("a")).select("query_id", F.col("a.pos").alias("pos"), F.col("a.idx").alias("old_idx")).distinct()
    return old.join(best, ["query_id", "pos"], "left").select("query_id", "pos", "old_idx", F.coalesce("best", "old_idx").alias("new_idx"))


def exact_search(samples: DataFrame, k: int, metric: str, token_weight: float, anchor_penalty: float) -> DataFrame:
    """(query_id, sample, a, b, total): the best one or two anchors of every sample by the
    sample's own objective, as joins; b is null for one.  The first pair wins ties."""
    if k not in (1, 2):
        raise ValueError("larger k are searched by arrays")
    keys = ["query_id", "sample"]
    rows = with_units(samples).select(*keys, "idx", "unit", "rho", "cost")
    v = rows.select(*keys, F.col("idx").alias("v"), F.col("unit").alias("w"), F.col("rho").alias("mass"))
    a = rows.select(*keys, F.col("idx").alias("a"), F.col("unit").alias("ua"), F.col("cost").alias("ca"))
    dist = a.join(v, keys).select(*keys, "a", "ca", "v", "mass", F.round(
        F.when(F.col("a") == F.col("v"), F.lit(0.0)).otherwise(unit_distance(F.col("ua"), F.col("w"), metric)), DECIDE).alias("d"))
    if k == 1:
        sums = dist.groupBy(*keys, "a").agg(F.sum(F.col("mass") * F.col("d")).alias("c"), F.first("ca").alias("t"))
        sums = sums.withColumn("b", F.lit(None).cast("long"))
    else:
        # per anchor, its distances as one array in the sample's order: pairs are joined once, not per node
        arrays = dist.groupBy(*keys, "a").agg(F.sort_array(F.collect_list(F.struct("v", "mass", "d"))).alias("x"), F.first("ca").alias("t"))
        b = arrays.select(*keys, F.col("a").alias("b"), F.col("x").alias("y"), F.col("t").alias("tb"))
        least = F.aggregate(F.zip_with("x", "y", lambda p, q: p["mass"] * F.least(p["d"], q["d"])), F.lit(0.0), lambda s, z: s + z)
        sums = arrays.join(b, keys).where("a < b").select(*keys, "a", "b", least.alias("c"), (F.col("t") + F.col("tb")).alias("t"))
    total = F.round(F.col("c") + token_weight * F.col("t") + anchor_penalty * k, DECIDE)
    best = F.min(F.struct(total.alias("total"), "a", "b")).alias("best")
    return sums.groupBy(*keys).agg(best).select(*keys, "best.a", "best.b", "best.total")


def fill_place(gamma: float) -> Column:
    """A node's place when room is filled by score: mass less gamma times distance."""
    score = F.round(F.col("rho") - gamma * F.col("near"), DECIDE)
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.desc(F.round("rho", DECIDE)), "near", "idx"))


def cell_best(rows: DataFrame) -> DataFrame:
    """(query_id, pos, idx): each cell's node of largest mass, then least distance and index."""
    place = F.row_number().over(Window.partitionBy("query_id", "cell").orderBy(F.desc(F.round("rho", DECIDE)), "near", "idx"))
    return rows.withColumn("_p", place).where("_p = 1").select("query_id", F.col("cell").alias("pos"), "idx")


def nearest_per_anchor(rows: DataFrame, count: int) -> DataFrame:
    """(query_id, pos, place, idx): the nodes nearest to each anchor, itself included."""
    every = rows.select("query_id", "idx", "rho", F.posexplode("to").alias("pos", "d"))
    place = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("d", F.desc(F.round("rho", DECIDE)), "idx"))
    return every.withColumn("place", place.cast("long")).where(F.col("place") <= count).select("query_id", F.col("pos").cast("long").alias("pos"), "place", "idx")


def nearest_in_window(rows: DataFrame, evidence: int) -> DataFrame:
    """As nearest_per_anchor, but only among a window of nodes cut by distance and index."""
    width = max(4 * evidence, evidence + 1)
    every = rows.select("query_id", "idx", "rho", F.posexplode("to").alias("pos", "d"))
    cut = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("d", "idx"))
    place = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("d", F.desc(F.round("rho", DECIDE)), "idx"))
    return (every.withColumn("_c", cut).where(F.col("_c") <= width).withColumn("place", place.cast("long")).where(F.col("place") <= evidence + 1)
            .select("query_id", F.col("pos").cast("long").alias("pos"), "place", "idx"))
