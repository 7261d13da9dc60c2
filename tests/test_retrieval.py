import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.config import Config, Experiment, Search, Universe, load_config, parse_config
from mooring.operators import anchors as A
from mooring.operators import render as R
from mooring.operators import universe as U
from mooring.plans import evaluation as E
from mooring.plans.grid import run_grid, summarise, write_summary
from mooring.plans.retrieval import retrieve
from mooring.sources import records

# A small query-local set (fixed values): id, relevance, vector, tokens.
NODES = [("c1", 0.98, [1.0, 0.0, 0.0], 8), ("c2", 0.88, [0.85, 0.15, 0.0], 8), ("c3", 0.76, [0.65, 0.35, 0.0], 8), ("c4", 0.42, [0.45, 0.55, 0.0], 7),
         ("n1", 0.05, [0.0, 0.0, 1.0], 6), ("n2", 0.03, [0.0, 0.1, 0.9], 6)]
SMOKE = Config(universe=Universe(200, 0.995), search=Search(k=2, k_max=3, sample_size_per_k=6, sample_size_cap=12, token_weight=0.01, max_context_tokens=300))


def line(**more):
    nodes = [{"node_id": f"q1_{i}", "text": f"text {i}", "relevance": r, "embedding": v, "token_count": t, "metadata": {"title": i}} for i, r, v, t in NODES]
    return {"query_id": "q1", "query": "What is connected?", "nodes": nodes, "gold_node_ids": ["q1_c1", "q1_c2", "q1_c3"], "answer": "x"} | more


def examples(spark, *lines):
    return records.examples(spark.createDataFrame([(json.dumps(x) if not isinstance(x, str) else x,) for x in lines], "line string"))


def test_smoke_run(spark):
    r = retrieve(examples(spark, line()), SMOKE).first()
    assert r["anchor_node_ids"] == r["anchor_ids"] == ["q1_c1", "q1_c3"]
    assert r["context_node_ids"] == [f"q1_{x}" for x in ("c1", "c3", "c2", "c4", "n1", "n2")]
    assert r["objective_after_refinement"] == pytest.approx(0.045261713, abs=1e-8)
    d = r["diagnostics"]
    assert (d["num_universe_nodes"], d["cluster_sizes"], d["refinement_accepted"], d["final_context_tokens"]) == (6, [3, 3], False, 43)
    assert d["full_validation_objective"]["coverage"] == pytest.approx(0.045101713, abs=1e-8)
    assert r["support_recall"] == 1 and r["support_hit"] == 1 and r["exact_phase1"] and len(d.asDict()) == 31


@pytest.mark.parametrize("variant", ["top_rho", "sample_only", "sample_full_validation", "sample_full_validation_refine", "sample_full_validation_refine_cell_renderer", "adaptive_k"])
def test_variants(spark, variant):
    c = SMOKE.with_search(retrieval_variant=variant, max_context_nodes=4, lambda_k=0.01)
    r = retrieve(examples(spark, line(), line(query_id="q2", gold_node_ids=[])), c).orderBy("query_id").collect()
    assert [x["query_id"] for x in r] == ["q1", "q2"] and r[1]["support_recall"] is None
    assert len(r[0]["context_node_ids"]) == 4 and r[0]["objective_after_refinement"] <= r[0]["objective_before_refinement"]
    assert (r[0]["diagnostics"]["adaptive_k_score"] is not None) == (variant == "adaptive_k")
    assert r[0]["context_node_ids"][:len(r[0]["anchor_ids"])] == r[0]["anchor_ids"]


def test_results_do_not_depend_on_order_or_partitions(spark):
    lines = [line(query_id=f"q{k}", nodes=line()["nodes"][k % 3:]) for k in range(8)]
    runs = []
    for n, rows in ((1, lines), (5, lines[::-1] + lines[:2])):
        got = retrieve(examples(spark, *rows).repartition(n), SMOKE).drop("latency_ms").orderBy("query_id").collect()
        runs.append(got)
    assert runs[0] == runs[1] and len(runs[0]) == 8
    limited = retrieve(examples(spark, *lines), Config(Experiment(limit_queries=3), SMOKE.universe, SMOKE.distance, SMOKE.search))
    assert sorted(r["query_id"] for r in limited.collect()) == ["q0", "q1", "q2"]


@pytest.mark.parametrize("renderer", ["old", "anchor_only", "nearest", "cell_top_rho", "global_top_rho"])
def test_relational_and_kernel_contexts_agree(spark, renderer):
    import random

    r = random.Random(4)
    nodes = [{"node_id": f"n{i:02}", "text": "t", "relevance": r.choice([0.1, 0.5, r.random()]), "embedding": [r.gauss(0, 1) for _ in range(4)], "token_count": r.randrange(1, 30)} for i in range(30)]
    ex = examples(spark, line(nodes=nodes))
    c = Config(search=Search(retrieval_variant="sample_full_validation", k=3, renderer=renderer, max_context_nodes=9, max_context_tokens=100))
    got = retrieve(ex, c).first()
    u = U.build_universe(U.merged_nodes(ex), c)
    places = {i: k for k, i in enumerate(got["anchor_ids"])}
    first = u.where(u.node_id.isin(*places)).select("query_id", "idx", "node_id")
    first = spark.createDataFrame([(x["query_id"], places[x["node_id"]], x["idx"]) for x in first.collect()], "query_id string, pos long, idx long")
    rows = A.anchored(u, first)
    assert R.contexts(rows, renderer, 100, 9).first()["context_node_ids"] == got["context_node_ids"]
    assert A.objective(rows, 0.03, 0.0).first()["total"] == pytest.approx(got["objective_after_refinement"], abs=1e-9)
    assert sorted(x["size"] for x in A.cell_sizes(rows, first).collect()) == sorted(got["diagnostics"]["cluster_sizes"])


def test_aliases_defaults_and_truth(spark):
    nodes = [{"id": 7, "content": "three little words", "score": None, "embedding": [1, 2], "type": None}, {"node_id": "", "chunk_id": "c", "query_score": 0.5, "embedding": [1, 0], "is_anchor_candidate": None, "tokens": 0},
             {"node_id": "d", "relevance": -1, "score": 9, "embedding": [0, 1], "is_anchor_candidate": "false", "node_type": "sentence", "token_count": 4}]
    r = examples(spark, {"qid": 5, "question": "why", "nodes": [], "chunks": nodes, "support_ids": ["a", "a", 3]}, "").first()
    assert (r["query_id"], r["query"], r["gold_node_ids"]) == ("5", "why", ["a", "3"])
    a, b, c = r["nodes"]
    assert (a["node_id"], a["text"], a["relevance"], a["node_type"], a["token_count"], a["is_anchor_candidate"]) == ("7", "three little words", 1.0, "None", 3, True)
    assert (b["node_id"], b["relevance"], b["node_type"], b["token_count"], b["is_anchor_candidate"]) == ("c", 0.5, "chunk", 1, False)
    assert (c["relevance"], c["is_anchor_candidate"], c["node_type"], c["token_count"]) == (-1.0, True, "sentence", 4)


@pytest.mark.parametrize("bad", [{"nodes": []}, {"query_id": 0}, {"query": None, "question": None}, {"nodes": [{"embedding": [1.0]}]}, {"nodes": [{"id": "a"}]},
                                 {"nodes": [{"id": "a", "embedding": [1.0]}, {"id": "b", "embedding": [1.0, 2.0]}]}, "{broken"])
def test_bad_lines_fail(spark, bad):
    with pytest.raises(Exception):
        examples(spark, bad if isinstance(bad, str) else line(**bad)).collect()


def test_evaluation_numbers(spark):
    ex = examples(spark, line(), line(query_id="q2", gold_node_ids=[]), line(query_id="q3"))
    preds = spark.createDataFrame([("q1", ["q1_c1", "q1_c2", "q1_n1"], ["q1_c1", "q1_n1"], 0.5, 0.4, 10.0), ("q2", ["q1_c1"], None, None, float("nan"), None)],
                                  "query_id string, context_node_ids array<string>, anchor_ids array<string>, objective_before_refinement double, objective_after_refinement double, latency_ms double")
    scores = {r["query_id"]: r for r in E.query_scores(ex, preds).collect()}
    q = scores["q1"]
    assert [round(q[f"context_{m}"], 4) for m in ("recall", "precision", "f1")] == [0.6667] * 3
    assert [round(q[f"anchor_{m}"], 4) for m in ("recall", "precision", "f1")] == [0.3333, 0.5, 0.4] and q["context_tokens"] == 22
    assert scores["q2"]["context_precision"] == 0 and scores["q2"]["context_f1"] is None and scores["q3"]["context_recall"] == 0 and scores["q3"]["context_precision"] is None
    r = E.evaluate(ex, preds).first()
    assert (r["num_queries"], r["missing_prediction_count"], r["missing_anchor_key_count"]) == (3, 1, 2)
    assert r["mean_context_recall"] == pytest.approx(1 / 3) and r["mean_context_precision"] == pytest.approx(1 / 3) and r["avg_latency_ms"] == 10 and r["objective_after_refinement_mean"] == pytest.approx(0.4)
    assert r["objective_support_spearman"] is None and r["diagnostics"]["objective_support_spearman_reason"].startswith("need at least two")
    assert r["context_node_budget_satisfied_rate"] is None and len(r.asDict()) == 33 - 1


def test_spearman(spark):
    rows = [(1.0, 9.0), (2.0, 9.0), (2.0, 5.0), (3.0, 4.0), (5.0, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert E.spearman(df, "a", "b").first()["spearman"] == pytest.approx(-0.9210526, abs=1e-6)
    assert E.spearman(df.where("a = 2"), "a", "b").first()["reason"] == "objective values are constant"
    assert E.spearman(df.limit(0), "a", "b").first()["spearman"] is None


def test_files_grid_and_summary(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(line(query_id=f"q{k}")) for k in range(3)) + "\n\n")
    ex = records.read_examples(spark, str(tmp_path / "in.jsonl"))
    assert records.validate(ex).first().asDict() == {"num_examples": 3, "num_queries": 3, "embedding_dims": [3]}
    with pytest.raises(ValueError):
        records.read_examples(spark, str(tmp_path / "in.jsonl"), 0)
    records.write_json_lines(retrieve(ex, SMOKE), str(tmp_path / "out"))
    back = records.read_predictions(spark, str(tmp_path / "out"))
    assert E.evaluate(ex, back).first()["k"] == 2
    rows = run_grid(ex, {"b": SMOKE, "a": SMOKE.with_search(retrieval_variant="top_rho")})
    for r in rows.collect():
        records.describe_run(r.asDict(), str(tmp_path / "runs" / r["run_name"] / "metrics.json"))
    table = summarise(spark, str(tmp_path / "runs"))
    assert [(r["run_name"], r["renderer"], r["configured_renderer"]) for r in table.collect()] == [("a", "global_top_rho", "old"), ("b", "old", "old")]
    write_summary(table, str(tmp_path / "s.csv"), str(tmp_path / "s.md"))
    assert len((tmp_path / "s.md").read_text().splitlines()) == 4


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("experiment:\n  seed: 7\nuniverse:\n  anchor_node_types: [chunk]\nother_name:\n  k: 2\n")
    c = load_config(tmp_path / "c.yaml")
    assert (c.experiment.seed, c.universe.anchor_node_types, c.search.k, c.search.k_max) == (7, ("chunk",), 2, 4)
    assert parse_config({"search": None}) == Config() == parse_config(None)
    for bad in ({"other": {}}, {"search": {"x": 1}}, {"search": {"k": 0}}, {"search": {"renderer": "x"}}, {"universe": {"min_relevance_mass": 0}}, {"distance": {"metric": "l2"}}, {"experiment": {"limit_queries": 0}},
                {"search": {"max_context_nodes": 2, "strict_context_budget": True}}):
        with pytest.raises(ValueError):
            parse_config(bad)
    with pytest.warns(UserWarning):
        parse_config({"search": {"max_context_nodes": 2}})
    with pytest.raises(TypeError):
        parse_config({"search": [1]})


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    from mooring.streaming import retrieve_stream

    ex = examples(spark, line(), line(query_id="q2"))
    ex.write.parquet(str(tmp_path / "in"))
    q = retrieve_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), SMOKE)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch", "latency_ms").orderBy("query_id").collect()
    assert got == retrieve(ex, SMOKE).drop("latency_ms").orderBy("query_id").collect()


def test_best_k_greedy_and_title_runs(spark):
    import random

    from mooring.functions.vectors import distance_matrix
    from mooring.operators.search import Problem, greedy

    r = random.Random(8)
    nodes = [{"node_id": f"n{i:02}", "text": f"word{i} what", "relevance": round(0.9 - i / 50, 2), "embedding": [r.gauss(0, 1) for _ in range(4)], "token_count": 5,
              "metadata": {"title": "connected" if i == 7 else f"title{i}"}} for i in range(12)]
    ex = examples(spark, line(nodes=nodes))
    base = Config(universe=Universe(12, 1.0), search=Search(k=2, sample_size_per_k=20))
    each = {k: retrieve(ex, base.with_search(k=k)).first()["objective_after_refinement"] for k in (1, 2, 3, 4)}
    best = retrieve(ex, base.with_search(auto_k=True)).first()
    assert best["objective_after_refinement"] == pytest.approx(min(each.values())) and best["diagnostics"]["k"] == min(each, key=each.get)
    penal = retrieve(ex, base.with_search(retrieval_variant="adaptive_k", lambda_k=0.05)).first()["diagnostics"]
    assert penal["adaptive_k_score"] == pytest.approx(min(v + 0.05 * k for k, v in each.items()))
    rows = U.build_universe(U.merged_nodes(ex), base).orderBy("idx").collect()
    p = Problem(distance_matrix(np.array([x["embedding"] for x in rows])), np.array([x["rho"] for x in rows]), np.full(len(rows), 0.005), 0.03, 0.0)
    quick = retrieve(ex, base.with_search(retrieval_variant="sample_full_validation", max_exact_combinations=5, require_exact_sample_search=False)).first()
    assert quick["anchor_ids"] == [rows[i]["node_id"] for i in greedy(p, range(len(rows)), 2)] and not quick["exact_phase1"] and quick["diagnostics"]["fallback_used"]
    titled = retrieve(ex, base.with_search(retrieval_variant="top_rho", k=1, relevance_mode="title_aware")).first()
    assert titled["anchor_ids"] == ["n07"]


def test_a_querys_subject_is_found_in_its_record(spark, tmp_path):
    cases = {"top": {"s_wiki_title": "The Rankin", "subj": "x"}, "second": {"s_wiki_title": None, "subj": "The Rankin"}, "nested": {"metadata": {"subj": "the RANKIN!"}},
             "number": {"subj": 12}, "empty": {"subj": ""}, "none": {"metadata": {"subj": None}}, "hidden": {"s_wiki_title": None, "metadata": {"s_wiki_title": "The Rankin"}}}
    nodes = [{"node_id": n, "text": "t", "embedding": [1.0, k], "metadata": {"title": t}} for k, (n, t) in enumerate([("a", "The Rankin"), ("b", "12"), ("c", "")])]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(line(query_id=q, query="who", nodes=nodes) | more) for q, more in cases.items()))
    ex = records.read_examples(spark, str(tmp_path / "in.jsonl"))
    assert {r["query_id"]: r["subject"] for r in ex.collect()} == {"top": "The Rankin", "second": "The Rankin", "nested": "the RANKIN!", "number": "12", "empty": "", "none": None, "hidden": None}
    c = Config(universe=Universe(9, 1.0), search=Search(retrieval_variant="top_rho", k=1, relevance_mode="diagnostic_subject_title"))
    first = {r["query_id"]: r["anchor_ids"][0] for r in retrieve(ex, c).collect()}
    assert {q for q, a in first.items() if a == "a"} == {"top", "second", "nested", "empty", "none", "hidden"} and first["number"] == "b"
    kept = ex.selectExpr("query_id", "query", "nodes", "gold_node_ids", "named_struct('subj', cast(null as string), 'metadata', named_struct('s_wiki_title', subject)) as metadata")
    assert {r["query_id"]: r["subject"] for r in records.with_subject(kept).collect()} == {r["query_id"]: r["subject"] for r in ex.collect()}


def test_limits_and_places_pass_over_blank_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n \n" + "\n\n".join(json.dumps(line(query_id=f"q{k}")) for k in range(6)))
    got = records.read_examples(spark, str(tmp_path / "in.jsonl"), 3).collect()
    assert [(r["query_id"], r["ord"]) for r in got] == [("q0", 2), ("q1", 4), ("q2", 6)]
    (tmp_path / "bad.jsonl").write_text(json.dumps(line()) + "\n" + json.dumps({"query_id": "x", "query": "y"}))
    with pytest.raises(Exception, match="no nodes in line 2"):
        records.read_examples(spark, str(tmp_path / "bad.jsonl"), 5).collect()
    every = records.read_examples(spark, str(tmp_path / "in.jsonl"), numbered=True)
    assert [(r["query_id"], r["ord"]) for r in every.orderBy("ord").collect()] == [(f"q{k}", 2 + 2 * k) for k in range(6)]
    # run settings are the first query's in the file that has one
    pred = spark.createDataFrame([("q4", ["x"], (4,)), ("q2", ["x"], (2,)), ("q0", ["x"], (None,))], "query_id string, anchor_ids array<string>, diagnostics struct<k:int>").withColumn("context_node_ids", F.col("anchor_ids"))
    turned = every.withColumn("ord", -F.col("ord"))
    assert E.evaluate(every, pred).first()["k"] == 2 and E.evaluate(turned, pred).first()["k"] == 4
    rows = spark.range(1000, numPartitions=7)
    assert all(r["ord"] == r["id"] for r in records.with_ordinal(rows).collect())


def test_groups_are_cut_before_they_are_shuffled(spark):
    nodes = spark.range(5000).selectExpr("concat('q', id div 5000) as query_id", "concat('n', id) as node_id", "cast(id % 97 as double) as score", "'t' as text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(U.mass_cutoff(nodes, 600, 0.98))
    assert "WindowGroupLimit" in plan(A.top_rho(nodes.selectExpr("query_id", "true as eligible", "score as rho", "node_id as idx"), 3))
    want = sorted([(-(k % 97), f"n{k}") for k in range(5000)])
    for n in (10, 1500):
        got = U.first_in_group(nodes, ["query_id"], [F.desc("score"), F.asc("node_id")], n, "p", "node_id").orderBy("p").collect()
        assert [(-r["score"], r["node_id"]) for r in got] == want[:n] and [r["p"] for r in got] == list(range(n))


def test_ranks_by_ranges(spark):
    import random

    r = random.Random(5)
    rows = [(float(k * k), r.randint(1, 4)) for k in r.sample(range(3000), 1500)]
    got = {x["v"]: x["before"] for x in E.counts_before(spark.createDataFrame(rows, "v double, n long"), "v").collect()}
    ahead = 0
    for v, n in sorted(rows):
        assert got[v] == ahead
        ahead += n
    assert len(got) == 1500 and E.counts_before(spark.createDataFrame([], "v double, n long"), "v").count() == 0


def test_grid_paths(tmp_path):
    from mooring.plans.grid import config_paths

    for n in ("PopQA_a", "Sensitivity_b", "other"):
        (tmp_path / f"{n}.yaml").write_text("")
    assert [p.stem for p in config_paths(str(tmp_path), "popqa", [str(tmp_path / "other.yaml"), str(tmp_path / "PopQA_a.yaml")])] == ["PopQA_a", "Sensitivity_b", "other"]
    assert [p.stem for p in config_paths(str(tmp_path), "none")] == ["Sensitivity_b"]
    with pytest.raises(ValueError):
        config_paths(None, "popqa")
