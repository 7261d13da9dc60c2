"""Query-local candidate sets: decoded nodes, relevance, mass cutoff, relevance mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.config import Config
from mooring.functions import text as T
from mooring.shared import materialise

SMOOTHING = 1e-8
#: The most rows per group for which Spark cuts groups before their shuffle (the default of
#: spark.sql.optimizer.windowGroupLimitThreshold), and the parts of a group beyond that.
GROUP_LIMIT, PARTS = 1000, 64


def first_in_group(df: DataFrame, group: list[str], order: list, n: int, place: str, spread: str) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, with their 0-based ``place``.

    Up to GROUP_LIMIT the optimiser cuts every group inside the tasks before the shuffle.
    Beyond, groups are first cut in PARTS parts by a hash of ``spread``, so that no task sorts
    a whole hot group; the first n of a group are among the first n of its parts.
    """
    rows = df
    if n > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(spread), F.lit(PARTS))
        rows = (df.withColumn("_part", part).withColumn(place, F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
                .where(F.col(place) <= n).drop("_part", place))
    # the bare row number is what the optimiser recognises
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n)
    return rows.withColumn(place, (F.col(place) - 1).cast("long"))


def query_nodes(examples: DataFrame) -> DataFrame:
    """One row per distinct (query, node) over all rows of ``examples``.

    A node's relevance is its highest known one (NaN and negative count as 0), 1.0 if none
    is known; token_count falls back to the text's words; text, title, type and embedding
    are those of any occurrence that has one (the largest, for a definite result).  Null
    query and node ids give no row.  ``subject`` (see records.with_subject) is kept if the
    examples have it.
    """
    own = ["subject"] if "subject" in examples.columns else []
    rows = examples.select("query_id", "query", *own, F.explode("nodes").alias("n")).where("query_id is not null and n.node_id is not null")
    known = F.when(F.col("n.relevance").isNotNull(), F.greatest(F.nanvl(F.col("n.relevance"), F.lit(0.0)), F.lit(0.0)))
    merged = rows.groupBy("query_id", F.col("n.node_id").alias("node_id")).agg(
        F.max("query").alias("query"), *(F.max(c).alias(c) for c in own), F.coalesce(F.max(known), F.lit(1.0)).alias("score"), F.max("n.text").alias("text"),
        F.max("n.metadata.title").alias("title"), F.max("n.node_type").alias("node_type"),
        F.coalesce(F.max("n.is_anchor_candidate"), F.lit(True)).alias("candidate"), F.max("n.token_count").cast("long").alias("tokens"),
        F.max("n.embedding").alias("embedding"))
    tokens = F.when(F.coalesce("tokens", F.lit(0)) != 0, F.col("tokens")).otherwise(T.word_count(F.col("text")))
    return merged.withColumns({"tokens": F.greatest(F.lit(1), tokens), "node_type": F.coalesce("node_type", F.lit("chunk")), "dim": F.coalesce(F.size("embedding"), F.lit(0))})


def with_embedding(nodes: DataFrame) -> DataFrame:
    """Nodes whose embedding has their query's largest length; others can't be compared."""
    widest = nodes.groupBy("query_id").agg(F.max("dim").alias("_widest"))
    return nodes.join(widest, "query_id").where((F.col("dim") == F.col("_widest")) & (F.col("dim") > 0)).drop("_widest", "dim")


def mass_cutoff(nodes: DataFrame, max_nodes: int, min_mass: float) -> DataFrame:
    """The nodes of highest score, through the one whose running sum reaches ``min_mass`` of
    the query's total, at most ``max_nodes``; ``idx`` is the place, 0 first.

    Equal scores go by node_id.  If no score of a query is positive, all count as 1.  The
    running sum is made over max_nodes rows of a query: see first_in_group.
    """
    totals = nodes.groupBy("query_id").agg(F.sum("score").alias("_total"), F.count("*").alias("_count"))
    top = first_in_group(nodes, ["query_id"], [F.desc("score"), F.asc("node_id")], max_nodes, "idx", "node_id").join(totals, "query_id")
    flat = F.col("_total") <= 0
    mass = F.when(flat, F.lit(1.0)).otherwise(F.col("score"))
    before = F.sum(mass).over(Window.partitionBy("query_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - mass
    share = F.round(before / F.when(flat, F.col("_count").cast("double")).otherwise(F.col("_total")), 9)
    return top.withColumn("_share", share).where(F.col("_share") < min_mass).drop("_total", "_count", "_share")


def relevance(mode: str, subject: Column | None = None) -> Column:
    """The score that a relevance mode gives a node of the universe; ``subject`` is null where a
    query has none."""
    if mode == "current":
        return F.col("score")
    if mode == "title_aware":
        return T.title_aware(F.col("query"), F.col("title"), F.col("text"))
    return T.subject_title(F.col("query"), F.col("title"), F.col("text"), F.lit(None).cast("string") if subject is None else subject)


def with_rho(universe: DataFrame, mode: str = "current", subject: Column | None = None) -> DataFrame:
    """The relevance mass: smoothed scores that sum to 1 within a query."""
    if subject is None and "subject" in universe.columns:
        subject = F.col("subject")
    score = F.greatest(F.nanvl(relevance(mode, subject), F.lit(0.0)), F.lit(0.0)) + SMOOTHING
    return universe.withColumn("_s", score).withColumn("rho", F.col("_s") / F.sum("_s").over(Window.partitionBy("query_id"))).drop("_s")


def with_candidates(universe: DataFrame, node_types: tuple[str, ...]) -> DataFrame:
    """``eligible``: whether a node may be an anchor; all may where none qualifies."""
    fits = F.col("candidate") & (F.col("node_type").isin(*node_types) if node_types else F.lit(True))
    some = F.max(fits).over(Window.partitionBy("query_id"))
    return universe.withColumn("eligible", F.when(some, fits).otherwise(F.lit(True)))


def merged_nodes(examples: DataFrame) -> DataFrame:
    """query_nodes as a written table: lengths, totals and ranks then read only the columns
    they need, and texts and vectors are shuffled once.  Runs may share it."""
    return materialise(query_nodes(examples), "nodes")


def build_universe(nodes: DataFrame, config: Config, subject: Column | None = None) -> DataFrame:
    """The whole candidate set of every query, from its merged nodes: see the steps above."""
    u, s = config.universe, config.search
    top = mass_cutoff(with_embedding(nodes), u.max_nodes, u.min_relevance_mass)
    return with_candidates(with_rho(top, s.relevance_mode, subject), u.anchor_node_types)


def sampling_chance(universe: DataFrame, uniform_mix: float) -> DataFrame:
    """``chance`` of each eligible node to be drawn first: its mass mixed with a uniform share."""
    w = Window.partitionBy("query_id")
    rows = universe.where("eligible")
    return rows.withColumn("chance", (1 - uniform_mix) * F.col("rho") / F.sum("rho").over(w) + uniform_mix / F.count("*").over(w))


def uniform(sample: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of query, node, sample and seed."""
    digest = F.md5(F.concat_ws("|", "query_id", "node_id", sample.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def draw_key(sample: Column, seed: int) -> Column:
    """Weighted sampling without replacement takes the smallest of these keys: exponential
    variates from ``uniform``, the same in any partitioning."""
    return -F.log(uniform(sample, seed)) / F.col("chance")


def weighted_samples(universe: DataFrame, config: Config, k: int | None = None, seed: int | None = None) -> DataFrame:
    """(query_id, sample, idx, node_id, ...) for every node that each sample draws.  Only a
    sample's size, not the candidate set, leaves a task."""
    s = config.search
    k = s.k if k is None else k
    size = max(k, min(s.sample_size_cap, s.sample_size_per_k * k))
    drawn = sampling_chance(universe, s.sample_uniform_mix).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(s.num_samples - 1))))
    drawn = drawn.withColumn("_key", draw_key(F.col("sample"), config.experiment.seed if seed is None else seed))
    place = F.row_number().over(Window.partitionBy("query_id", "sample").orderBy("_key", "idx"))
    return drawn.withColumn("_place", place).where(F.col("_place") <= size).drop("_key", "_place")
