import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from mooring.plans import preparation as P

DOC = "node_id string, title string, text string, added_at timestamp, removed_at timestamp"


def brute_top(questions, docs, n):
    def terms(t):
        w = [x for x in re.findall(r"[^\W]{2,}", t.lower()) if x not in P.STOP_WORDS]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    rows = {("d", i): terms(t) for i, t in docs} | {("q", i): terms(t) for i, t in questions}
    df = Counter(t for r in rows.values() for t in r)
    w = {}
    for k, r in rows.items():
        v = {t: c * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, c in r.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        w[k] = {t: x / norm for t, x in v.items()}
    out = {}
    for i, _ in questions:
        sims = [(-round(s, 9), d) for d, _ in docs if (s := sum(x * w["d", d].get(t, 0) for t, x in w["q", i].items())) >= 0]
        out[i] = [d for _, d in sorted(sims)[:n]]
    return out


def test_top_documents_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "DOC_POSTINGS", 60)
    monkeypatch.setattr(P, "QUESTION_POSTINGS", 30)
    r = random.Random(2)
    words = [f"w{i}" for i in range(25)] + ["the", "river"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(f"d{i:02}", text(r.choice([0, 2, 9]))) for i in range(50)] + [("same1", "w1 w2"), ("same2", "w1 w2")]
    questions = [(f"q{i}", text(3)) for i in range(12)] + [("empty", "")]
    d = spark.createDataFrame([(i, "t", t, None, None) for i, t in docs], DOC)
    q = spark.createDataFrame(questions, "id string, question string")
    got = defaultdict(dict)
    for row in P.tfidf_top(q, d, 4).collect():
        got[row["id"]][row["place"]] = row["node_id"]
    want = brute_top(questions, docs, 4)
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_prepare(spark):
    corpus = spark.createDataFrame([("x:0", "A", "alpha river town", None, None), ("x:1", "B", "beta hill", None, None), ("x:2", "B", "beta mill", None, None), ("x:2", "B", "beta mill", None, None), ("x:3", "", "", None, None), (None, "Z", "z", None, None)], DOC)
    qa = spark.createDataFrame([
        ("q1", "alpha river", "obj", None, '["one", "two", "obj"]', [("B", "beta mill", True), ("A", "other text", True), ("C", "none", True), ("A", "alpha river town", False)]),
        ("q2", None, None, "final", "bare", None), ("q3", "zzz", "", None, None, []), (None, "x", None, None, None, None)],
        "id string, question string, obj string, final_answer string, possible_answers string, paragraphs array<struct<title string, text string, is_supporting boolean>>")
    gold = {(r["id"], r["pos"]): (r["node_id"], r["how"]) for r in P.gold_alignment(qa, P.corpus_documents(corpus)).collect()}
    assert gold == {("q1", 0): ("x:2", "exact"), ("q1", 1): ("x:0", "title"), ("q1", 2): (None, "missing")}
    answers = {r["id"]: (r["answer"], r["answers"]) for r in P.answers(qa).collect()}
    assert answers == {"q1": ("obj", ["obj", "one", "two"]), "q2": ("final", ["final", "bare"]), "q3": (None, []), None: (None, [])}
    rows = {r["query_id"]: r for r in P.prepare(qa, corpus, "x", 2).collect()}
    assert [n["node_id"] for n in rows["q1"]["nodes"]] == ["x:0", "x:2"] and rows["q1"]["gold_node_ids"] == ["x:2", "x:0"]
    assert rows["q1"]["nodes"][1]["relevance"] == 1e-12 and rows["q1"]["nodes"][0]["token_count"] == 3 and rows["q1"]["metadata"]["num_gold_nodes"] == 2


def test_merge_never_drops_gold(spark):
    top = spark.createDataFrame([("q", f"n{i}", 1 - i / 10, i + 1) for i in range(5)], "id string, node_id string, sim double, place long")
    gold = spark.createDataFrame([("q", "g1"), ("q", "n4"), ("q", "n4"), ("q", None)], "id string, node_id string")
    order = lambda cap: [r["node_id"] for r in P.merged_universe(top, gold, cap).orderBy("place").collect()]
    assert order(4) == ["n4", "g1", "n0", "n1"] and order(1) == ["n4", "g1"] and order(9) == ["n0", "n1", "n2", "n3", "n4", "g1"]


def test_latent_vectors_keep_similarities(spark):
    texts = ["red fox runs", "red fox sleeps", "blue whale swims deep", "blue whale sings"]
    d = spark.createDataFrame([(f"d{i}", "t", t, None, None) for i, t in enumerate(texts)], DOC)
    v = {r["node_id"]: np.array(r["embedding"]) for r in P.latent_vectors(d, 2).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    assert v["d0"] @ v["d1"] > 0.9 > 0.5 > v["d0"] @ v["d2"]


def test_latent_vectors_take_all_terms_and_give_every_document_one(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:02}", " ".join(r.choice(words) for _ in range(8))) for i in range(30)] + [("stop", "the of"), ("empty", "")]
    asked = [f"{r.choice(words)} {r.choice(words)}" for _ in range(9)]
    d = spark.createDataFrame([(i, "t", t, None, None) for i, t in docs], DOC)
    q = spark.createDataFrame([(t,) for t in asked], "question string")
    v = {x["node_id"]: np.array(x["embedding"]) for x in P.latent_vectors(d, 5, None, questions=q, rounds=40).collect()}
    assert set(v) == {i for i, _ in docs} and not v["stop"].any() and not v["empty"].any()

    def terms(t):
        w = [x for x in t.split() if x not in P.STOP_WORDS]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    every = [terms(t) for _, t in docs] + [terms(t) for t in asked]
    df = Counter(t for x in every for t in x)
    names = sorted(df)
    m = np.array([[x[t] * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t in names] for x in every])
    m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))[:len(docs)]
    want = m @ np.linalg.svd(m)[2][:5].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = np.stack([v[i] for i, _ in docs])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_raw_lists_are_numbered_and_checked(spark):
    import pytest

    qa = spark.createDataFrame([(None, "a?", None), ("x", None, "b?"), (None, "c?", None)], "_id string, query string, question string").coalesce(1)
    docs = spark.createDataFrame([("t", "", "c"), ("", "u", None)], "title string, text string, content string").coalesce(1)
    q, d = P.numbered(qa, docs, "set")
    assert [(r["id"], r["question"]) for r in q.orderBy("ord").collect()] == [("0", "a?"), ("x", "b?"), ("2", "c?")]
    assert [(r["node_id"], r["text"]) for r in d.orderBy("ord").collect()] == [("set:doc:0", "c"), ("set:doc:1", "u")]
    with pytest.raises(P.RawDataError):
        P.numbered(qa, docs.limit(0), "set")
    with pytest.raises(Exception, match="no question in item 0"):
        P.numbered(qa.withColumn("query", F.lit(None).cast("string")).drop("question"), docs, "set")[0].collect()
    with pytest.raises(Exception, match="neither title nor text in document 1"):
        P.numbered(qa, docs.withColumn("text", F.lit("")), "set")[1].collect()
