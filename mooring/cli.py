"""Command line: run, eval, validate-data, prepare, grid, summary."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from mooring.config import load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mooring")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "run": ("config", "input", "output"), "eval": ("input", "predictions", "output"), "validate-data": ("input",),
        "prepare": ("qa", "corpus", "output", "dataset"), "grid": ("input", "output", "dataset"), "summary": ("runs", "csv", "markdown"),
    }.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(f"--{a}", required=True)
        if name in ("run", "eval", "validate-data", "grid"):
            c.add_argument("--limit", type=int)
        if name == "grid":
            c.add_argument("--configs", "--config-dir", help="a folder of configurations")
            c.add_argument("--config-files", nargs="*", help="further configurations")
        if name == "prepare":
            c.add_argument("--limit", type=int)
            c.add_argument("--max-nodes", type=int, default=600)
            c.add_argument("--embedding-dim", type=int, default=128)
            c.add_argument("--max-features", type=int, default=50_000)
    return p


def main(argv: list[str] | None = None) -> int:
    from dataclasses import replace

    from mooring.plans import evaluation, grid, preparation, retrieval
    from mooring.sources import records

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("mooring").getOrCreate()
    if a.command == "run":
        c = load_config(a.config)
        limit = a.limit if a.limit is not None else c.experiment.limit_queries
        c = replace(c, experiment=replace(c.experiment, limit_queries=None))
        records.write_json_lines(retrieval.retrieve(records.read_examples(spark, a.input, limit), c), a.output)
    elif a.command == "eval":
        row = evaluation.evaluate(records.read_examples(spark, a.input, a.limit, numbered=True), records.read_predictions(spark, a.predictions)).first()
        records.describe_run(row.asDict(recursive=True), a.output)
    elif a.command == "validate-data":
        row = records.validate(records.read_examples(spark, a.input, a.limit)).first()
        if not row["num_examples"]:
            raise ValueError("no examples")
        print(json.dumps(row.asDict()))
    elif a.command == "prepare":
        read = lambda path: spark.read.parquet(path) if path.endswith(".parquet") else records.read_json_list(spark, path)
        qa, corpus = preparation.numbered(read(a.qa), read(a.corpus), a.dataset)
        if a.limit is not None:
            qa = qa.orderBy("ord").limit(a.limit)
        if a.max_nodes < 1:
            raise preparation.RawDataError("--max-nodes must be at least 1")
        docs = preparation.corpus_documents(corpus)
        vectors = preparation.latent_vectors(docs, a.embedding_dim, a.max_features, questions=qa)
        records.write_json_lines(preparation.prepare(qa, corpus, a.dataset, a.max_nodes, vectors, a.max_features), a.output)
        row = vectors.select("embedding").first()
        print(json.dumps(preparation.prepared_summary(qa, docs, a.dataset, a.max_nodes, row and len(row[0])) | {"output_path": a.output}))
    elif a.command == "grid":
        grid.run_folder(spark, records.read_examples(spark, a.input, a.limit), a.configs, a.dataset, a.output, a.config_files)
    else:
        grid.write_summary(grid.summarise(spark, a.runs), a.csv, a.markdown)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
