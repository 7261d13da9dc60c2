"""Scoring predictions against gold ids: one metric row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.operators.universe import query_nodes
from mooring.plans.retrieval import gold_of
from mooring.shared import materialise

SIDES = {"context": "context_node_ids", "anchor": "anchors"}


def last_predictions(predictions: DataFrame, order: list[Column]) -> DataFrame:
    """One row per query: the last one in ``order``."""
    place = Window.partitionBy("query_id").orderBy(*order)
    return predictions.where("query_id is not null").withColumn("_p", F.row_number().over(place)).where("_p = 1").drop("_p")


def finite(x: Column) -> Column:
    """The value as a double; null if it is none, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _diagnostic(df: DataFrame, name: str) -> Column:
    """A field of the diagnostics, null where the predictions have none."""
    schema = df.schema["diagnostics"].dataType if "diagnostics" in df.columns else None
    return F.col(f"diagnostics.{name}") if schema is not None and name in schema.fieldNames() else F.lit(None)


def query_scores(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per query of ``examples`` with its recall, hit, precision and F1 for context
    and anchors, sizes and tokens.

    ``predictions`` has one row per query.  A query without one scores as an empty
    prediction.  Without gold, recall, hit and F1 are null and precision is 0 if anything
    is selected; with nothing selected, precision and F1 are null.  Repeated ids count
    once in hits and precision, each time in sizes.  anchor_node_ids go before anchor_ids.
    """
    gold = gold_of(examples)
    order = F.min("ord") if "ord" in examples.columns else F.lit(0)
    queries = examples.where("query_id is not null").groupBy("query_id").agg(order.cast("long").alias("_place"))
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    keyed = predictions.withColumns({
        "_found": F.lit(True),
        "anchors": F.coalesce(*(F.col(c) for c in ("anchor_node_ids", "anchor_ids") if c in predictions.columns))})
    rows = queries.join(keyed, "query_id", "left").join(sizes, "query_id", "left")
    rows = rows.withColumns({"golds": F.coalesce("golds", F.lit(0)), "missing_prediction": F.col("_found").isNull(), "missing_anchor_key": F.col("anchors").isNull()})
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in SIDES.values()})
    for side, column in SIDES.items():
        ids = rows.select("query_id", F.explode(F.array_distinct(column)).alias("node_id"))
        hits = ids.join(gold, ["query_id", "node_id"]).groupBy("query_id").agg(F.count("*").alias(f"{side}_hits"))
        rows = rows.join(hits, "query_id", "left").withColumn(f"{side}_hits", F.coalesce(f"{side}_hits", F.lit(0)))
        known, distinct = F.col("golds") > 0, F.size(F.array_distinct(column))
        recall = F.when(known, F.col(f"{side}_hits") / F.col("golds"))
        precision = F.when(distinct > 0, F.col(f"{side}_hits") / distinct)
        rows = rows.withColumns({f"{side}_recall": recall, f"{side}_precision": precision, f"{side}_hit": F.when(known, (F.col(f"{side}_hits") > 0).cast("double"))})
        p, r = F.col(f"{side}_precision"), F.col(f"{side}_recall")
        rows = rows.withColumn(f"{side}_f1", F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)))
        rows = rows.withColumn(f"{side}_size", F.size(column).cast("double"))
    tokens = query_nodes(examples).select("query_id", "node_id", "tokens")
    shown = rows.select("query_id", F.explode("context_node_ids").alias("node_id")).join(tokens, ["query_id", "node_id"])
    counted = shown.groupBy("query_id").agg(F.sum("tokens").cast("double").alias("_tokens"))
    rows = rows.join(counted, "query_id", "left")
    return rows.withColumn("context_tokens", F.coalesce(finite(_diagnostic(rows, "final_context_tokens")), F.col("_tokens"), F.lit(0.0)))


#: Ranges in which values are counted, each in a task of its own.
RANGES = 512


def counts_before(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (value, n), one row per value, with ``before``: the sum of n of all smaller
    values.  Values lie in RANGES ranges between approximate quantiles; the ranges' sums are
    added up first (RANGES + 1 rows), and each range then adds its own rows."""
    steps = F.percentile_approx(value, F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10_000)
    bounds = counts.agg(F.array_distinct(F.coalesce(steps, F.array().cast("array<double>"))).alias("_bounds"))  # one row of RANGES numbers
    rows = counts.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    sums = rows.groupBy("_range").agg(F.sum("n").alias("_sum"))
    every = sums.agg(F.map_from_entries(F.collect_list(F.struct("_range", "_sum"))).alias("_sums"))  # one row of RANGES numbers
    inside = F.sum("n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ahead = F.aggregate(F.map_entries("_sums"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] < F.col("_range"), e["value"]).otherwise(0))
    offsets = sums.join(F.broadcast(every)).select("_range", ahead.alias("_ahead"))
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").select(value, "n", (F.col("_inside") + F.col("_ahead")).alias("before"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row (spearman, reason): Pearson's correlation of mid-ranks; null with a reason for
    fewer than two pairs or a constant side.  Ranks come from counts of distinct values, see
    counts_before."""
    clean = materialise(pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"), "pairs")

    def ranked(column: str) -> DataFrame:
        counts = counts_before(materialise(clean.groupBy(column).agg(F.count("*").alias("n")), "counts"), column)
        return counts.select(column, (F.col("before") + (F.col("n") - 1) / 2).alias(f"r{column}"))

    joined = clean.join(ranked("x"), "x").join(ranked("y"), "y")
    sums = joined.agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("c"))
    reason = (F.when(F.col("n") < 2, "need at least two objective/support pairs").when(F.col("lx") == F.col("hx"), "objective values are constant")
              .when(F.col("ly") == F.col("hy"), "support values are constant"))
    return sums.select(F.when(reason.isNull(), F.col("c")).alias("spearman"), reason.alias("reason"))


def _flag(df: DataFrame, name: str) -> Column:
    """A budget flag as 1 or 0: as given, else from the limits, else null."""
    given = _diagnostic(df, name).cast("boolean").cast("double")
    if name == "node_budget_satisfied":
        limit = _diagnostic(df, "max_context_nodes").cast("double")
        derived = F.when(limit > 0, (F.col("context_size") <= limit).cast("double"))
    else:
        limit, used = _diagnostic(df, "max_context_tokens").cast("double"), _diagnostic(df, "final_context_tokens").cast("double")
        derived = (used <= limit).cast("double")
    return F.coalesce(given, derived)


def evaluate(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """The metric row.  ``predictions`` has one row per query (see last_predictions).  Rates of
    accepted refinements and of non-empty anchors divide by all queries; latency and
    objectives average over the values present; run settings are those of the first query
    that has one, in the order of the examples' ``ord``, if they have it, and of their ids."""
    rows = query_scores(examples, predictions)
    optional = [c for s in SIDES for c in (f"{s}_precision", f"{s}_f1")] + ["context_recall_per_node", "context_recall_per_1k_tokens", "anchor_recall_per_anchor"]
    number = lambda c: finite(F.col(c)) if c in rows.columns else F.lit(None).cast("double")
    rows = rows.withColumns({
        "context_recall_per_node": F.col("context_recall") / F.greatest("context_size", F.lit(1.0)),
        "context_recall_per_1k_tokens": F.col("context_recall") / F.greatest(F.col("context_tokens") / 1000, F.lit(1e-12)),
        "anchor_recall_per_anchor": F.col("anchor_recall") / F.greatest("anchor_size", F.lit(1.0)),
        "_before": number("objective_before_refinement"), "_after": number("objective_after_refinement"), "_latency": number("latency_ms"),
        "_node_flag": _flag(rows, "node_budget_satisfied"), "_token_flag": _flag(rows, "token_budget_satisfied"),
        "_accepted": F.coalesce(_diagnostic(rows, "refinement_accepted").cast("boolean"), F.lit(False))})
    # from here on numbers and settings are enough; scores are made once for all that follows
    lists = [*SIDES.values(), "anchor_ids", "anchor_node_ids"]
    rows = materialise(rows.drop(*lists), "scores")
    settings = {n: F.min_by(_diagnostic(rows, n).cast(t), F.when(_diagnostic(rows, n).isNotNull(), F.struct("_place", "query_id"))).alias(n) for n, t in (
        ("retrieval_variant", "string"), ("renderer", "string"), ("relevance_mode", "string"), ("k", "int"), ("k_max", "int"), ("max_context_nodes", "int"), ("max_context_tokens", "int"))}
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    share = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    summary = rows.agg(
        F.count("*").alias("num_queries"), *settings.values(),
        *(mean(f"{s}_{m}", f"mean_{s}_{m}") for s in SIDES for m in ("recall", "hit")), *(F.avg(c).alias(f"mean_{c}") for c in optional),
        F.count_if("missing_prediction").alias("missing_prediction_count"), F.count_if("missing_anchor_key").alias("missing_anchor_key_count"),
        share(F.col("anchor_size") > 0, "anchor_non_empty_ratio"), mean("context_size", "avg_context_size"), mean("context_tokens", "avg_context_tokens"),
        F.avg("_node_flag").alias("context_node_budget_satisfied_rate"), F.avg("_token_flag").alias("context_token_budget_satisfied_rate"),
        mean("_latency", "avg_latency_ms"), mean("_before", "objective_before_refinement_mean"), mean("_after", "objective_after_refinement_mean"),
        share(F.col("_accepted"), "refinement_accept_rate"))
    rho = spearman(rows.select("_after", "context_recall"), "_after", "context_recall")
    out = summary.crossJoin(F.broadcast(rho))  # one row each
    nullable = [f"mean_{c}" for c in optional] + ["context_node_budget_satisfied_rate", "context_token_budget_satisfied_rate"]
    reasons = F.map_filter(F.create_map(*(x for c in nullable for x in (F.lit(f"{c}_reason"), F.when(F.col(c).isNull(), "no computable query values"))),
                                        F.lit("objective_support_spearman_reason"), F.col("reason")), lambda k, v: v.isNotNull())
    return out.withColumn("diagnostics", reasons).withColumnRenamed("spearman", "objective_support_spearman").drop("reason")
