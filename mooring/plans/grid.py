"""Configuration grids and their summaries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.config import Config, load_config
from mooring.operators.universe import merged_nodes
from mooring.plans.evaluation import evaluate
from mooring.plans.retrieval import retrieve
from mooring.shared import materialise
from mooring.sources.records import describe_run, with_subject

# A summary's columns in order, those that other tools read first, then our own.
COLUMNS = (
    "dataset", "variant", "retrieval_variant", "renderer", "relevance_mode", "k", "k_max", "max_context_nodes", "max_context_tokens",
    "mean_context_recall", "mean_context_precision", "mean_context_f1", "mean_context_hit", "mean_anchor_recall", "mean_anchor_precision", "mean_anchor_f1", "mean_anchor_hit",
    "avg_context_size", "avg_context_tokens", "mean_context_recall_per_node", "avg_latency_ms", "objective_before_refinement_mean", "objective_after_refinement_mean",
    "refinement_accept_rate", "objective_support_spearman", "context_node_budget_satisfied_rate", "context_token_budget_satisfied_rate", "missing_prediction_count",
    "missing_anchor_key_count", "anchor_non_empty_ratio", "mean_context_recall_per_1k_tokens",
    "run_name", "configured_renderer", "configured_k", "num_samples", "sample_size_per_k", "num_queries", "mean_anchor_recall_per_anchor")


def config_paths(folder: str | None, dataset: str, files: list[str] | None = None) -> list[Path]:
    """The folder's configurations for a dataset (and sensitivity ones), in any letter case, or
    all if none is named so; then ``files``.  Each path counts once."""
    every = sorted(Path(folder).glob("*.yaml")) if folder else []
    own = [p for p in every if p.stem.lower().startswith((dataset.lower(), "sensitivity_"))]
    paths = list(dict.fromkeys([*(own or every), *map(Path, files or ())]))
    if not paths:
        raise ValueError("a grid needs a folder of configurations or some of their files")
    return paths


def run_grid(examples: DataFrame, configs: dict[str, Config], dataset: str = "") -> DataFrame:
    """One metric row per configuration.  Each run's results are written once; settings are
    given as configured and as in effect."""
    out: DataFrame | None = None
    nodes = merged_nodes(with_subject(examples))
    for name, c in configs.items():
        results = materialise(retrieve(examples, c, nodes=nodes), "results")
        s = c.search
        row = evaluate(examples, results).withColumns({
            "dataset": F.lit(dataset), "variant": F.lit(name), "run_name": F.lit(name), "configured_renderer": F.lit(s.renderer), "configured_k": F.lit(s.k), "num_samples": F.lit(s.num_samples), "sample_size_per_k": F.lit(s.sample_size_per_k)})
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no configuration")
    return out.select(*COLUMNS)


def run_folder(spark: SparkSession, examples: DataFrame, folder: str | None, dataset: str, output: str, files: list[str] | None = None) -> DataFrame:
    """Runs every configuration (see config_paths) and writes ``<output>/<name>/metrics.json``."""
    rows = materialise(run_grid(examples, {p.stem: load_config(p) for p in config_paths(folder, dataset, files)}, dataset), "grid")
    for r in rows.collect():  # one row per configuration file
        describe_run(r.asDict(), f"{output}/{r['run_name']}/metrics.json")
    return rows


def summarise(spark: SparkSession, folder: str) -> DataFrame:
    """The metric files under ``folder`` as rows, sorted by run; missing values are null, a
    missing dataset is the folder's name, a missing variant that of the run's folder."""
    rows = spark.read.option("multiLine", True).json(f"{folder}/*/metrics.json").withColumn("_run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    known = {"dataset": F.lit(Path(folder).name), "variant": F.col("_run")}
    kept = [F.coalesce(*([F.col(c)] if c in rows.columns else []), known.get(c, F.lit(None))).alias(c) for c in COLUMNS]
    return rows.orderBy("_run").select(*kept)


def write_summary(summary: DataFrame, csv: str, markdown: str) -> None:
    """The summary as one CSV file and one Markdown table; nulls are empty."""
    rows = summary.toPandas()  # one row per run
    Path(csv).parent.mkdir(parents=True, exist_ok=True)
    rows.to_csv(csv, index=False)
    text = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    text += ["| " + " | ".join("" if v is None or v != v else str(v) for v in r) + " |" for r in rows.itertuples(index=False)]
    Path(markdown).write_text("\n".join(text) + "\n", encoding="utf-8")
