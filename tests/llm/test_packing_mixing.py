import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import mixing, packing
from mooring.llm.mixing import mix, prefix_sums
from mooring.llm.tokens import encoding, with_tokens


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, near string, plan_id string")


def sample(seed, n):
    r = random.Random(seed)
    topics = [[f"{t}word{k}" for k in range(30)] for t in "abcdef"]
    return [(k, " ".join(r.choice(r.choice(topics[k % 6:][:1])) for _ in range(r.choice([1, 5, 20, 60, 200, 900])))) for k in range(n)]


def test_every_text_is_packed_once_and_whole_unless_too_large(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rows = sample(1, 150) + [(900, None), (901, ""), (None, "lost"), (902, "repeated text"), (903, "repeated text")]
    plans = spark.createDataFrame([("s", 64), ("l", 700), ("none", None), ("zero", 0)], "plan_id string, capacity_tokens long")
    got = packing.pack(docs(spark, rows), plans).collect()
    size = {i: len(encoding().encode_ordinary(t)) for i, t in rows if i is not None and t}
    for plan, capacity in (("s", 64), ("l", 700)):
        mine = [g for g in got if g["plan_id"] == plan]
        boxes, pieces = defaultdict(int), defaultdict(list)
        for g in mine:
            boxes[g["container_id"]] += g["tokens"]
            pieces[g["id"]].append((g["piece"], g["tokens"]))
        assert max(boxes.values()) <= capacity
        assert set(pieces) == set(size)
        for i, p in pieces.items():
            p.sort()
            assert [x for x, _ in p] == list(range(-(-size[i] // capacity))) and sum(t for _, t in p) == size[i]
            assert all(t == capacity for _, t in p[:-1])
        assert len(boxes) <= -(-sum(size.values()) // capacity) + 6 * 4
    assert {g["plan_id"] for g in got} == {"s", "l"}
    report = {r["plan_id"]: r["fill_percent"] for r in packing.packing_report(packing.pack(docs(spark, rows), plans), plans).collect()}
    assert report["s"] > 90


def index_of(texts, mean):
    """An index of texts whose words are numbered, with exact document frequencies."""
    words = sorted({w for t in texts for w in t.split()})
    frequency = np.array([sum(w in t.split() for t in texts) for w in words], np.float32)
    lengths = np.array([len(t.split()) for t in texts])
    return packing.Index(np.array([words.index(w) for t in texts for w in t.split()], int), lengths, frequency, mean, len(texts))


def test_scores_are_bm25():
    texts = ["red fox", "red red dog", "", "blue dog runs far away"]
    mean = np.mean([2, 3, 0, 5])
    index = index_of(texts, mean)

    def brute(seed, d):
        total = 0.0
        for w in set(texts[seed].split()):
            tf, df, n = texts[d].split().count(w), sum(w in t.split() for t in texts), len(texts[d].split())
            total += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) if tf else 0
        return total

    for s in range(4):
        assert np.allclose(index.scores(s), [brute(s, d) for d in range(4)], rtol=1e-5)


def test_terms_and_their_frequencies(spark):
    rows = [(k, f"Every text has word{k % 3} été_{k % 2} x x") for k in range(12)] + [(20, "--"), (21, "每个 text")]
    table = packing.encoded(docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("text").alias("txt")), "/opt/tokenizers")
    encode = encoding().encode_ordinary
    kept = {r["id"]: np.frombuffer(r["tokens"], np.uint16).tolist() for r in table.collect()}
    assert kept == {k: encode(t) for k, t in rows}
    found, mean, n = packing._frequencies(table, encoding().n_vocab)
    want = Counter(t for tokens in kept.values() for t in set(tokens))
    assert n == len(rows) and mean == np.mean([len(t) for t in kept.values()])
    assert {int(t): int(found[t]) for t in np.flatnonzero(found)} == want


def test_neighbours_of_the_seed_come_first():
    index = index_of(["a b c d e f", "x y z", "a b c", "p q r", "d e f"], 4)
    boxes = packing.fill(np.array([6, 3, 3, 3, 3]), 12, index)
    assert sorted(d for d, _, _ in boxes[0]) == [0, 2, 4]


def test_room_goes_to_the_largest_that_fit():
    g = np.random.default_rng(3)
    for _ in range(30):
        sizes = g.integers(0, 30, 80)
        boxes = packing.fill(sizes, 20, index_of([f"w{k}" for k in range(80)], 1))
        rest, used = {k: int(n) % 20 or min(int(n), 20) for k, n in enumerate(sizes) if n}, set()
        for box in [b for b in boxes if b[0][2] < 20 or len(b) > 1 or sizes[b[0][0]] <= 20]:
            room = 20
            for d, _, tokens in box:
                fits = [(n, k) for k, n in rest.items() if k not in used and n <= room]
                assert (tokens, d) == max(fits) and tokens == rest[d]
                used.add(d)
                room -= tokens
            assert not [1 for k, n in rest.items() if k not in used and n <= room]
        assert used == set(rest)


def fills(spark, rows, capacity):
    plans = spark.createDataFrame([("p", capacity)], "plan_id string, capacity_tokens long")
    got = packing.pack(docs(spark, rows), plans)
    size = {i: len(encoding().encode_ordinary(t)) for i, t in rows}
    assert {r["id"]: r["tokens"] for r in got.collect()} == size and got.count() == len(rows)
    boxes = [r["n"] for r in got.groupBy("container_id").agg({"tokens": "sum"}).toDF("c", "n").collect()]
    assert max(boxes) <= capacity
    return sum(boxes) / capacity / len(boxes) * 100


def test_copies_and_room_of_other_shards_fill_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    monkeypatch.setattr(packing, "RANGE_DOCS", 80)
    small = [(5000 + k, f"s{k} t{k % 7}") for k in range(1500)]
    half = max(len(encoding().encode_ordinary(t)) for _, t in small) * 11
    copies = [(1000 + k, "red " * half) for k in range(120)]
    assert fills(spark, small + copies, 2 * half - 4) > 90
    # not copies, but all near each other
    near = [(2000 + k, "red " * half + f"blue{k % 10}") for k in range(120)]
    assert fills(spark, small + near, 2 * half - 4) > 90


def test_dissolving_keeps_capacity_and_never_adds_containers():
    g = np.random.default_rng(4)
    for _ in range(50):
        tokens = g.integers(1, 40, size=200)
        box, used = np.zeros(200, int), [0]
        for d, t in enumerate(tokens):
            if used[-1] + t > 64 - 20 * (len(used) % 2):
                used.append(0)
            used[-1] += t
            box[d] = len(used) - 1
        after = packing.dissolve(box, tokens, 64)
        assert np.bincount(after, tokens).max() <= 64
        assert len(np.unique(after)) < len(np.unique(box))


def test_packing_an_empty_table(spark):
    plans = spark.createDataFrame([("s", 64)], "plan_id string, capacity_tokens long")
    assert packing.pack(docs(spark, []), plans).count() == 0
    assert packing.pack(docs(spark, [(1, None)]), plans).count() == 0


def test_tokens_of_whole_texts(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "x " * 50_000)]
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(docs(spark, rows), "text").collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: len(encoding().encode_ordinary("x " * 50_000))}


TARGET = "mix_id string, source string, target_share double, max_repeats int"


def sized(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "source string, doc_id long, tokens long, mix_id string, before int")


def test_budgets_caps_and_actual_shares(spark):
    r = random.Random(9)
    rows = [("big" if k % 10 else "small", k, r.randrange(1, 60)) for k in range(3000)] + [(None, 1, 5), ("big", None, 5), ("big", 7000, 0), ("other", 1, 9)]
    targets = [("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("n", "small", 0.9, 20), ("n", "absent", 0.1, 2), ("p", "absent", 1.0, 1)]
    chosen, shares = mix(sized(spark, rows), spark.createDataFrame(targets, TARGET))
    picks = chosen.collect()
    have = Counter()
    for s, i, t in rows:
        if s and i is not None:
            have[s] += t
    got, most = Counter(), Counter()
    for p in picks:
        got[p["mix_id"], p["source"]] += p["tokens"] * p["repeats"]
        most[p["mix_id"], p["source"]] = max(most[p["mix_id"], p["source"]], p["repeats"])
    assert len({(p["mix_id"], p["source"], p["doc_id"]) for p in picks}) == len(picks)
    assert not {p["source"] for p in picks} & {"other", None}
    totals = {"m": have["big"] + have["small"], "n": have["small"], "p": 0}
    for m, s, share, cap in targets:
        assert abs(got[m, s] - min(share * totals[m], cap * have[s])) <= 30
        assert most[m, s] <= cap
    table = {(x["mix_id"], x["source"]): x for x in shares.collect()}
    assert set(table) == {(m, s) for m, s, _, _ in targets}
    for (m, s), x in table.items():
        whole = sum(v for (mm, _), v in got.items() if mm == m)
        assert x["tokens"] == got[m, s] and x["actual_share"] == (pytest.approx(got[m, s] / whole) if whole else None)


def test_choice_is_random_but_repeatable_and_any_partitioning_gives_it(spark):
    rows = [("s", k, 10) for k in range(500)]
    targets = spark.createDataFrame([("m", "s", 0.5, 1), ("m", "t", 0.5, 1)], TARGET)
    runs = [sorted(r["doc_id"] for r in mix(sized(spark, rows).repartition(n), targets, seed=s)[0].collect()) for n, s in ((1, 0), (7, 0), (3, 1))]
    assert runs[0] == runs[1] != runs[2] and 245 <= len(runs[0]) <= 255 and runs[0] != list(range(len(runs[0])))


def test_prefix_sums(spark):
    rows = sized(spark, [("ab"[k % 2], k, k % 7) for k in range(400)])
    for s in "ab":
        got = sorted((r["before"], r["tokens"], r["whole"]) for r in prefix_sums(rows, "source", "doc_id", "tokens").where(f"source = '{s}'").collect())
        at = 0
        for before, tokens, whole in sorted(got, key=lambda x: (x[0], x[1])):
            assert before == at
            at += tokens
        assert at == got[0][2]


def test_mixing_empty_tables(spark):
    none = spark.createDataFrame([], TARGET)
    assert mix(sized(spark, []), none)[1].count() == 0
    chosen, shares = mix(sized(spark, []), spark.createDataFrame([("m", "s", 1.0, 2)], TARGET))
    assert chosen.count() == 0 and [r["tokens"] for r in shares.collect()] == [0]


def test_ranges_follow_the_number_of_records(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows = [("big", k, k % 7 + 1) for k in range(400)] + [("small", 1000 + k, 5) for k in range(3)]
    got = mixing.prefix_sums(spark.createDataFrame(rows, "source string, doc_id long, tokens long"), "source", "doc_id", "tokens", 3).collect()
    for source in ("big", "small"):
        mine = sorted((r for r in got if r["source"] == source), key=lambda r: r["before"])
        ahead = 0
        for r in mine:
            assert r["before"] == ahead
            ahead += r["tokens"]
        assert all(r["whole"] == ahead for r in mine)


def test_the_largest_mix_that_meets_all_shares(spark):
    table = spark.createDataFrame([("a", k, 1) for k in range(1000)] + [("b", 5000 + k, 1) for k in range(50)], "source string, doc_id long, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.8, 1), ("m", "b", 0.2, 2), ("n", "a", 0.5, 1), ("n", "none", 0.5, 9)], "mix_id string, source string, target_share double, max_repeats int")
    shares = {(r["mix_id"], r["source"]): r for r in mix(table, targets, "reachable")[1].collect()}
    assert shares["m", "b"]["tokens"] == 100 and shares["m", "a"]["tokens"] == 400 and abs(shares["m", "a"]["actual_share"] - 0.8) < 1e-9
    assert shares["n", "a"]["tokens"] == 0 and shares["n", "a"]["actual_share"] is None
