"""Whole retrieval runs: examples to anchors, contexts and diagnostics.

The candidate set, relevance and its mass, and eligibility are relational.  Each query
then is one row that holds its candidate set (the universe's cap bounds it), and one
Arrow pass samples, searches, refines and renders, without a further shuffle.  Only
indices, masses, sizes and vectors go into it; texts don't.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mooring.config import Config
from mooring.functions.vectors import checked_distances, distance_matrix
from mooring.operators import render as R
from mooring.operators import search as S
from mooring.operators.universe import build_universe, merged_nodes, uniform
from mooring.sources.records import with_subject

OBJECTIVE = "struct<total:double,coverage:double,token_penalty:double,anchor_penalty:double>"
DIAGNOSTICS = (
    "retrieval_variant:string,renderer:string,relevance_mode:string,k:int,k_max:int,selected_k:int,num_universe_nodes:int,"
    "num_anchor_candidates:int,num_samples:int,sample_sizes:array<int>,selected_sample_index:int,phase1_exact:boolean,"
    f"phase1_num_combinations:array<bigint>,sample_objective:{OBJECTIVE},full_validation_objective:{OBJECTIVE},"
    f"refinement_before:{OBJECTIVE},refinement_after:{OBJECTIVE},refinement_accepted:boolean,refinement_history:array<double>,"
    "cluster_sizes:array<int>,fallback_used:boolean,max_context_nodes:int,max_context_tokens:int,final_context_nodes:int,"
    "final_context_tokens:bigint,node_budget_satisfied:boolean,token_budget_satisfied:boolean,node_budget_exceeded_by_anchors:boolean,"
    "context_budget_policy:string,max_context_nodes_less_than_k:boolean,adaptive_k_score:double")
KERNEL = ("query_id string, anchor_node_ids array<string>, anchor_ids array<string>, context_node_ids array<string>, "
          "objective_before_refinement double, objective_after_refinement double, exact_phase1 boolean, "
          f"diagnostics struct<{DIAGNOSTICS}>, latency_ms double")
#: The label that results carry whatever the renderer (fixed value).
POLICY = "anchors_then_cell_top_rho_then_score_fill"


def draw(uniform: np.ndarray, chance: np.ndarray, size: int) -> list[np.ndarray]:
    """Weighted samples without replacement, each sorted, from one row of uniform numbers (see
    universe.uniform) a sample: the ``size`` smallest of their exponential keys."""
    order = np.arange(len(chance))
    return [np.sort(np.lexsort((order, key))[:size]) for key in -np.log(uniform) / chance]


def seeds(c: Config) -> list[int]:
    """The seeds of a run's draws: one for a fixed k, else one for each k from 1 to k_max."""
    s, seed = c.search, c.experiment.seed
    if s.retrieval_variant == "top_rho":
        return []
    return [seed + 1009 * k for k in range(1, s.k_max + 1)] if s.auto_k or s.retrieval_variant == "adaptive_k" else [seed]


def search_once(q: dict[str, Any], c: Config, k: int, turn: int = 0) -> dict[str, Any]:
    """One query's result for a fixed k; ``turn`` is the place of its seed among ``seeds``."""
    s, p = c.search, q["problem"]
    candidates = np.flatnonzero(q["eligible"])
    k = min(k, len(candidates))
    samples: list[np.ndarray] = []
    found: list[tuple[list[int], bool, int]] = []
    chosen = sampled = None
    if s.retrieval_variant == "top_rho":
        anchors = candidates[np.lexsort((candidates, -p.rho[candidates]))][:k].tolist()
        full = p.objective(anchors)
        done = S.unrefined(p, anchors, full)
    else:
        mass = p.rho[candidates]
        chance = (1 - s.sample_uniform_mix) * mass / mass.sum() + s.sample_uniform_mix / len(mass)
        size = min(len(candidates), max(k, min(s.sample_size_cap, s.sample_size_per_k * k)))
        if size == len(candidates):  # every draw takes them all
            samples = [candidates] * s.num_samples
        else:
            samples = [candidates[x] for x in draw(q["uniform"][turn, :, candidates].T, chance, size)]
        known: dict[bytes, tuple] = {}
        for x in samples:
            if x.tobytes() not in known:
                hit = S.exact(p, x, k, s.max_exact_combinations, s.require_exact_sample_search)
                known[x.tobytes()] = (hit, p.objective(hit[0], x), p.objective(hit[0]))
        found, within, over_all = (list(v) for v in zip(*(known[x.tobytes()] for x in samples)))
        judged = within if s.retrieval_variant == "sample_only" else over_all
        chosen = int(np.argmin([round(o["total"], S.DECIDE) for o in judged]))
        anchors, sampled, full = found[chosen][0], within[chosen], over_all[chosen]
        if s.retrieval_variant in ("sample_only", "sample_full_validation"):
            done = S.unrefined(p, anchors, full)
        else:
            done = S.refine(p, anchors, candidates, s.refinement_iters)
    order = R.turn_order(c.renderer, done.anchors, p.d, p.rho, s.evidence_per_anchor, s.renderer_gamma)
    context = R.take(order, done.anchors, q["tokens"], s.max_context_tokens, s.max_context_nodes)
    used = int(sum(max(1, int(q["tokens"][i])) for i in context))
    exact = all(f[1] for f in found)
    limit = s.max_context_nodes or 0
    names = [q["ids"][i] for i in done.anchors]
    return {
        "query_id": q["query_id"], "anchor_node_ids": names, "anchor_ids": names, "context_node_ids": [q["ids"][i] for i in context],
        "objective_before_refinement": done.before["total"], "objective_after_refinement": done.after["total"], "exact_phase1": exact,
        "diagnostics": {
            "retrieval_variant": s.retrieval_variant, "renderer": c.renderer, "relevance_mode": s.relevance_mode, "k": k, "k_max": s.k_max, "selected_k": k,
            "num_universe_nodes": len(p.rho), "num_anchor_candidates": len(candidates), "num_samples": len(samples),
            "sample_sizes": [len(x) for x in samples], "selected_sample_index": chosen, "phase1_exact": exact,
            "phase1_num_combinations": [f[2] for f in found], "sample_objective": sampled, "full_validation_objective": full,
            "refinement_before": done.before, "refinement_after": done.after, "refinement_accepted": done.accepted,
            "refinement_history": done.history, "cluster_sizes": done.cluster_sizes, "fallback_used": not exact,
            "max_context_nodes": s.max_context_nodes, "max_context_tokens": s.max_context_tokens, "final_context_nodes": len(context),
            "final_context_tokens": used, "node_budget_satisfied": not limit or len(context) <= limit,
            "token_budget_satisfied": used <= s.max_context_tokens, "node_budget_exceeded_by_anchors": bool(limit and len(set(names)) > limit),
            "context_budget_policy": POLICY, "max_context_nodes_less_than_k": bool(limit and limit < k), "adaptive_k_score": None,
        },
    }


def search(q: dict[str, Any], c: Config) -> dict[str, Any]:
    """One query's result: a fixed k, or the best of 1 to k_max, the smaller on ties."""
    s = c.search
    adaptive = s.retrieval_variant == "adaptive_k"
    if not adaptive and not s.auto_k:
        return search_once(q, c, s.k)
    best, least = None, np.inf
    for k in range(1, min(s.k_max, len(q["ids"])) + 1):
        result = search_once(q, c, k, k - 1)
        score = result["objective_after_refinement"] + (s.lambda_k * len(result["anchor_node_ids"]) if adaptive else 0)
        if round(score, S.DECIDE) < round(least, S.DECIDE):
            best, least = result, score
    if adaptive:
        best["diagnostics"] |= {"selected_k": len(best["anchor_node_ids"]), "adaptive_k_score": least}
    return best


def _kernel(c: Config):
    schema, turns = to_arrow_schema(StructType.fromDDL(KERNEL)), len(seeds(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                started = time.perf_counter()
                nodes = pa.array(batch.column("nodes").slice(row, 1).flatten())
                field = lambda f: nodes.field(f)  # noqa: E731, B023
                vectors = field("embedding")
                n = len(nodes)
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                tokens = field("tokens").to_numpy()
                problem = S.Problem(checked_distances(distance_matrix(x, c.distance.metric)), field("rho").to_numpy(), np.maximum(1, tokens) / 1000.0, c.search.token_weight, c.search.anchor_penalty)
                q = {"query_id": batch.column("query_id")[row].as_py(), "ids": field("node_id").to_pylist(), "tokens": tokens,
                     "eligible": field("eligible").to_numpy(zero_copy_only=False), "problem": problem,
                     "uniform": field("uniform").flatten().to_numpy(zero_copy_only=False).reshape(n, turns, -1).transpose(1, 2, 0) if turns else None}
                out.append(search(q, c) | {"latency_ms": round((time.perf_counter() - started) * 1000, 3)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def gold_of(examples: DataFrame) -> DataFrame:
    """(query_id, node_id): each query's distinct gold ids over all its rows."""
    return (examples.select("query_id", F.explode("gold_node_ids").alias("node_id"))
            .where("query_id is not null and node_id is not null").distinct())


def support(results: DataFrame, gold: DataFrame, column: str, prefix: str) -> DataFrame:
    """Per query: distinct ids of ``column`` that are gold, and the number of gold ids.  Joined
    by (query, node), so a query with very many gold ids is no single row."""
    ids = results.select("query_id", F.explode(F.array_distinct(column)).alias("node_id"))
    hits = ids.join(gold, ["query_id", "node_id"]).groupBy("query_id").agg(F.count("*").alias(f"{prefix}_hits"))
    return hits


def nested(universe: DataFrame, config: Config) -> DataFrame:
    """(query_id, nodes): one row per query, its candidate set ordered by index, each node with
    the uniform numbers of its draws, seed by seed and sample by sample."""
    draws = [uniform(F.lit(sample), seed) for seed in seeds(config) for sample in range(config.search.num_samples)]
    return universe.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("idx", "node_id", "rho", "tokens", "eligible", F.col("embedding").cast("array<double>").alias("embedding"), F.array(*draws).cast("array<double>").alias("uniform")))).alias("nodes"))


def retrieve(examples: DataFrame, config: Config, subject: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """One result row per query that has a node with an embedding; see README for the columns.

    Rows of one query are merged first, so delivered repetitions don't matter.  Results
    don't depend on the order or partitioning of the input: draws are keyed by query, node
    and seed.  ``limit_queries`` keeps the first queries by id.  ``nodes`` may be the examples'
    merged nodes, if several runs share them.  The subject of the diagnostic mode is the
    examples' own (see records.with_subject) unless ``subject`` names another column.
    """
    if config.experiment.limit_queries:
        first = examples.select("query_id").where("query_id is not null").distinct().orderBy("query_id").limit(config.experiment.limit_queries)
        examples = examples.join(first, "query_id", "left_semi")
        nodes = nodes.join(first, "query_id", "left_semi") if nodes is not None else None
    # searching is most of the work: queries are spread over all tasks, not coalesced by their bytes
    tasks = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results = nested(build_universe(merged_nodes(with_subject(examples)) if nodes is None else nodes, config, subject), config).repartition(tasks, "query_id").mapInArrow(_kernel(config), KERNEL)
    gold = gold_of(examples)
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    scored = results.join(support(results, gold, "context_node_ids", "c"), "query_id", "left").join(sizes, "query_id", "left")
    recall = F.when(F.col("golds") > 0, F.coalesce("c_hits", F.lit(0)) / F.col("golds"))
    return scored.select(
        "query_id", "anchor_node_ids", "anchor_ids", "context_node_ids", "objective_before_refinement", "objective_after_refinement",
        recall.alias("support_recall"), F.when(F.col("golds") > 0, (F.coalesce("c_hits", F.lit(0)) > 0).cast("double")).alias("support_hit"),
        "exact_phase1", "diagnostics", "latency_ms")
