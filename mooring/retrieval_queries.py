"""Queries of the retrieval operators over the test tables, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooring.config import Config, Search
from mooring.functions import text as T
from mooring.operators import anchors as A
from mooring.operators import render as R
from mooring.operators import universe as U
from mooring.plans import evaluation as E
from mooring.plans import preparation as P
from mooring.plans.retrieval import retrieve
from mooring.shared import materialise
from mooring.sources.records import validate

DEFAULT = Config()
#: A small budget, so that budgets bind.
COMPACT = Config(search=Search(max_context_nodes=8, max_context_tokens=512))
K, WEIGHT, PENALTY, EVIDENCE = 3, 0.03, 0.01, 2


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return U.query_nodes(_read(spark, sf, "examples"))


def _universe(spark: SparkSession, sf: str) -> DataFrame:
    return U.build_universe(U.merged_nodes(_read(spark, sf, "examples")), DEFAULT)


def _r(x, places: int = 6):
    return F.round(x, places)


def lexical_overlap_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nodes of every query that share most of its words."""
    rows = _nodes(spark, sf).select("query_id", "node_id", T.overlap(F.col("query"), F.col("text")).alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "node_id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= 5).select("query_id", "node_id", "place", _r("s").alias("overlap"))


def title_match_class(spark: SparkSession, sf: str) -> DataFrame:
    """How a node's title matches its query."""
    return _nodes(spark, sf).select("query_id", "node_id", T.normalised(F.col("title")).alias("title"), T.title_match(F.col("query"), F.col("title")).alias("score"))


def _mass(spark: SparkSession, sf: str, mode: str, subject: bool = False) -> DataFrame:
    examples = _read(spark, sf, "examples")
    nodes = U.merged_nodes(examples.withColumn("subject", F.col("answer")) if subject else examples)
    cut = U.mass_cutoff(U.with_embedding(nodes), DEFAULT.universe.max_nodes, DEFAULT.universe.min_relevance_mass)
    return U.with_rho(cut, mode).select("query_id", "idx", "node_id", _r("rho", 9).alias("rho"))


def relevance_mass_current(spark: SparkSession, sf: str) -> DataFrame:
    return _mass(spark, sf, "current")


def title_aware_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _mass(spark, sf, "title_aware")


def subject_title_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _mass(spark, sf, "diagnostic_subject_title", subject=True)


def universe_mass_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Every query's candidate set."""
    nodes = U.with_embedding(U.merged_nodes(_read(spark, sf, "examples")))
    return U.mass_cutoff(nodes, DEFAULT.universe.max_nodes, DEFAULT.universe.min_relevance_mass).select("query_id", "idx", "node_id", "score", "tokens")


def candidate_filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Which nodes may be anchors, if only sentences may."""
    return U.with_candidates(_universe(spark, sf), ("sentence",)).select("query_id", "idx", "eligible")


def sample_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return U.sampling_chance(_universe(spark, sf), DEFAULT.search.sample_uniform_mix).select("query_id", "idx", _r("chance", 9).alias("chance"))


def weighted_samples(spark: SparkSession, sf: str) -> DataFrame:
    return U.weighted_samples(_universe(spark, sf), DEFAULT).select("query_id", F.col("sample").cast("long").alias("sample"), "idx", "node_id")


def _distances(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    return A.pair_distances(materialise(_universe(spark, sf).select("query_id", "idx", "embedding", "tokens"), "universe"), metric).select("query_id", "i", "j", _r("d", 6 if metric == "angular" else 9).alias("d"))


def angular_distance(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a query's candidate set."""
    return _distances(spark, sf, "angular")


def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf, "cosine")


def top_rho_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_rho(_universe(spark, sf), K)


def _anchored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    universe = materialise(_universe(spark, sf), "universe")
    first = A.top_rho(universe, K)
    return A.anchored(universe, first), first


def objective_given_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The objective of the top-mass anchors."""
    rows = A.objective(_anchored(spark, sf)[0], WEIGHT, PENALTY)
    return rows.select("query_id", *(_r(c, 9).alias(c) for c in ("coverage", "token_penalty", "anchor_penalty", "total")))


def assign_nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return _anchored(spark, sf)[0].select("query_id", "idx", "cell", _r("near").alias("d"))


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return A.cell_sizes(*_anchored(spark, sf))


def cell_top_rho_pick(spark: SparkSession, sf: str) -> DataFrame:
    return A.cell_best(_anchored(spark, sf)[0])


def nearest_per_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest_per_anchor(_anchored(spark, sf)[0], EVIDENCE + 1)


def score_fill_order(spark: SparkSession, sf: str) -> DataFrame:
    return _anchored(spark, sf)[0].select("query_id", "idx", A.fill_place(0.5).cast("long").alias("place"))


def refine_one_step(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's best anchor for the top-mass start."""
    return A.refine_step(_anchored(spark, sf)[0], "angular", WEIGHT)


def _exact(spark: SparkSession, sf: str, k: int) -> DataFrame:
    samples = materialise(U.weighted_samples(_universe(spark, sf), DEFAULT, k), "samples")
    found = A.exact_search(samples, k, "angular", WEIGHT, PENALTY)
    return found.select("query_id", F.col("sample").cast("long").alias("sample"), "a", "b", "total")


def exact_k1_search(spark: SparkSession, sf: str) -> DataFrame:
    return _exact(spark, sf, 1)


def exact_k2_search(spark: SparkSession, sf: str) -> DataFrame:
    return _exact(spark, sf, 2)


def _context(spark: SparkSession, sf: str, renderer: str) -> DataFrame:
    s = COMPACT.search
    # every step of a render reads these rows, so they are made once
    rows = materialise(_anchored(spark, sf)[0].select("query_id", "idx", "node_id", "tokens", "rho", "anchors", "to", "near", "cell"), "anchored")
    return R.contexts(rows, renderer, s.max_context_tokens, s.max_context_nodes, EVIDENCE)


def render_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of the top-mass anchors of every query."""
    rows, first = _anchored(spark, sf)
    shown = first.join(rows.select("query_id", "idx", "node_id", "title", "text"), ["query_id", "idx"])
    lists = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "title", "text"))).alias("nodes"))
    return lists.select("query_id", R.context_text(F.col("nodes")).alias("text"))


def _run(spark: SparkSession, sf: str, config: Config) -> DataFrame:
    examples = _read(spark, sf, "examples")
    if config.search.relevance_mode == "diagnostic_subject_title":  # the answer stands in for the subject, which the table hasn't
        examples = examples.withColumn("subject", F.col("answer"))
    rows = retrieve(examples, config)
    d = "diagnostics"
    return rows.select("query_id", "anchor_node_ids", "context_node_ids", _r("objective_before_refinement").alias("before"), _r("objective_after_refinement").alias("after"),
                       _r("support_recall").alias("support_recall"), "support_hit", "exact_phase1", F.col(f"{d}.num_universe_nodes").cast("long").alias("nodes"),
                       F.col(f"{d}.final_context_tokens").alias("tokens"), F.col(f"{d}.selected_k").cast("long").alias("k"))


def retrieval_top_rho(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run without search: anchors of largest mass, context by score, recall and hit."""
    return _run(spark, sf, COMPACT.with_search(retrieval_variant="top_rho"))


RUNS = {
    "retrieval_sample_only": {"retrieval_variant": "sample_only", "k": 2},
    "retrieval_full_validation": {"retrieval_variant": "sample_full_validation", "k": 2},
    "retrieval_refine": {"retrieval_variant": "sample_full_validation_refine"},
    "retrieval_refine_cell": {"retrieval_variant": "sample_full_validation_refine_cell_renderer"},
    "retrieval_title_aware": {"relevance_mode": "title_aware", "renderer": "nearest"},
    "retrieval_subject_title": {"relevance_mode": "diagnostic_subject_title", "k": 2},
    "retrieval_adaptive_k": {"retrieval_variant": "adaptive_k", "lambda_k": 0.01},
    "retrieval_auto_k": {"auto_k": True},
    "retrieval_greedy": {"max_exact_combinations": 10, "require_exact_sample_search": False},
}


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per query: the table has no order, so the slowest row stands for the last."""
    by = [F.desc_nulls_last(c) for c in ("latency_ms", "objective_after_refinement", "objective_before_refinement", "support_recall")]
    return E.last_predictions(_read(spark, sf, "predictions"), by)


def prediction_last_row(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("query_id", "latency_ms", "objective_after_refinement")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.query_scores(_read(spark, sf, "examples"), _predictions(spark, sf))


def context_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("query_id", *(_r(f"context_{m}").alias(m) for m in ("recall", "hit", "precision", "f1", "size", "tokens")))


def anchor_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("query_id", *(_r(f"anchor_{m}").alias(m) for m in ("recall", "hit", "precision", "f1", "size")))


METRICS = tuple(f"mean_{s}_{m}" for s in ("context", "anchor") for m in ("recall", "hit", "precision", "f1")) + (
    "mean_context_recall_per_node", "mean_context_recall_per_1k_tokens", "mean_anchor_recall_per_anchor", "anchor_non_empty_ratio", "avg_context_size", "avg_context_tokens",
    "avg_latency_ms", "objective_before_refinement_mean", "objective_after_refinement_mean", "refinement_accept_rate", "objective_support_spearman")


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The metric row of the stored predictions."""
    row = E.evaluate(_read(spark, sf, "examples"), _predictions(spark, sf))
    return row.select("num_queries", "missing_prediction_count", "missing_anchor_key_count", *(_r(m).alias(m) for m in METRICS))


def objective_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of latency and support recall of the stored predictions."""
    return E.spearman(_predictions(spark, sf), "latency_ms", "support_recall").select(_r("spearman").alias("spearman"), "reason")


def validate_counts_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, queries, and distinct embedding lengths."""
    return validate(_read(spark, sf, "examples")).withColumnsRenamed({"num_examples": "num_rows", "embedding_dims": "dims"})


def qa_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's answer and all possible ones."""
    return P.answers(_read(spark, sf, "qa")).select("id", "answer", "answers")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    qa = _read(spark, sf, "qa").where("id is not null").dropDuplicates(["id"])
    return P.gold_alignment(qa, P.corpus_documents(_read(spark, sf, "corpus")))


def gold_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each supporting paragraph's corpus document."""
    return _gold(spark, sf)


def gold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Supporting paragraphs and those without a document."""
    return _gold(spark, sf).agg(F.count("*").alias("total_gold"), F.count_if(F.col("how") == "missing").alias("missing_gold"))


def _top(spark: SparkSession, sf: str, n: int) -> DataFrame:
    qa = _read(spark, sf, "qa").where("id is not null").dropDuplicates(["id"])
    docs = materialise(P.corpus_documents(_read(spark, sf, "corpus")), "docs")
    return P.tfidf_top(qa.select("id", F.coalesce("question", F.lit("")).alias("question")), docs, n)


def tfidf_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 documents of highest TF-IDF cosine for every question."""
    return _top(spark, sf, 10).select("id", "node_id", _r("sim").alias("sim"), "place")


def universe_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Ten candidates and the gold documents of every question, at most ten but for gold."""
    return P.merged_universe(_top(spark, sf, 10), _gold(spark, sf), 10).select("id", "node_id", "is_gold", "place")


def prepared_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples made from questions and corpus, without vectors."""
    rows = P.prepare(_read(spark, sf, "qa"), _read(spark, sf, "corpus"), "prepared", 10, max_features=None)
    return rows.select("query_id", "query", "answer", F.transform("nodes", lambda n: n["node_id"]).alias("node_ids"), "gold_node_ids", F.size("nodes").cast("long").alias("nodes"))


def latent_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Every corpus document's vector: its number of elements and its length."""
    docs = materialise(P.corpus_documents(_read(spark, sf, "corpus")), "docs")
    qa = _read(spark, sf, "qa").where("id is not null").dropDuplicates(["id"]).select(F.coalesce("question", F.lit("")).alias("question"))
    vectors = P.latent_vectors(docs, 32, questions=qa, rounds=3)
    return vectors.select("node_id", F.size("embedding").cast("long").alias("elements"), _r(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("length"))


_FUNCTIONS = (
    retrieval_top_rho, lexical_overlap_topn, title_match_class, title_aware_mass, subject_title_mass, universe_mass_cutoff, relevance_mass_current, candidate_filter_fallback,
    sample_probabilities, weighted_samples, angular_distance, cosine_distance, top_rho_anchors, objective_given_anchors, exact_k1_search, exact_k2_search, assign_nearest_anchor,
    cluster_sizes, cell_top_rho_pick, nearest_per_anchor, score_fill_order, refine_one_step, render_text, prediction_last_row, context_metrics, anchor_metrics, eval_summary,
    objective_spearman, validate_counts_dims, qa_answers, gold_alignment, gold_counts, tfidf_topn, universe_merge, prepared_examples, latent_lengths)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
QUERIES |= {f"render_{r}": partial(_context, renderer=r) for r in ("anchor_only", "global_top_rho", "nearest", "cell_top_rho", "old")}
QUERIES |= {name: partial(_run, config=COMPACT.with_search(**values)) for name, values in RUNS.items()}
