import random
import re

from mooring.llm import neardup
from mooring.llm.components import connected_components

SCHEMA = "id string, txt string, rep string, slots string"
WORDS = [f"w{i}" for i in range(60)]


def pairs_of(text):
    w = [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if x]
    return frozenset(zip(w, w[1:]))


def brute(rows, t):
    sets = {(i, x): pairs_of(x) for i, x in rows if i is not None and x is not None}
    out = set()
    for (i, _), a in sets.items():
        for (j, _), b in sets.items():
            if i < j and a and b and len(a & b) >= t * len(a | b) - 1e-12:
                out.add((i, j))
    return out


def rows_of(r, n):
    rows = []
    for k in range(n):
        if rows and r.random() < 0.6:
            words = r.choice(rows)[1]
            words = (words or "a b").split()
            for _ in range(r.randrange(4)):
                at = r.randrange(len(words) + 1)
                words[at:at + r.randrange(2)] = [r.choice(WORDS)] * r.randrange(2)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 3, 8, 30, 80])))
        rows.append((f"n{k}", r.choice([text, text, text.upper(), text.replace(" ", ", ", 1)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "r", "s") for x in rows], SCHEMA)


def test_pairs_match_brute_force(spark):
    r = random.Random(3)
    rows = rows_of(r, 150)
    rows += [("n1", None), (None, "a b c"), ("copy1", rows[5][1]), ("copy2", rows[5][1]), rows[3], ("long", "x y " * 20_000), ("long2", "x y " * 20_001), ("", "p q r"), ("z", "p q r")]
    for t in (0.6, 0.8):
        got = [tuple(x) for x in neardup.near_duplicate_pairs(frame(spark, rows), "id", "txt", t).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, t)


def test_groups_are_components_and_every_text_has_one(spark):
    rows = rows_of(random.Random(4), 120) + [("dup", "one two three"), ("dup2", "one two three")]
    up = {i: i for i, x in rows if x and pairs_of(x)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute(rows, 0.6):
        x, y = sorted((root(a), root(b)))
        up[y] = x
    groups = {}
    for i in up:
        groups.setdefault(root(i), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g}
    got = neardup.near_duplicate_groups(frame(spark, rows), "id", "txt", 0.6).collect()
    assert {(x["group_id"], x["id"]) for x in got} == want and len(got) == len(want)


def test_a_list_in_most_texts_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_TEXTS", 10)
    r = random.Random(6)
    # short texts: their indexed part holds the word pair that nearly all of them share
    rows = [(f"n{k}", f"the common {r.choice(WORDS[:6])} {r.choice(WORDS[:6])}") for k in range(150)] + rows_of(r, 40)
    got = [tuple(x) for x in neardup.near_duplicate_pairs(frame(spark, rows), "id", "txt", 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.3)
    _, sets = neardup.text_classes(frame(spark, rows), "id", "txt")
    kinds = "position long, byte byte, part int, rep long, size int, pos int, indexed boolean, map0 long, map1 long"
    made = sets.mapInArrow(neardup._postings(neardup._sketch(sets), 0.3), kinds).collect()
    lists = {}
    for x in made:
        lists.setdefault((x["position"], x["byte"]), []).append(x)
    hot = max(lists.values(), key=len)
    parts = {x["part"] for x in hot}
    assert len(parts) > 3 and len({x["rep"] for x in hot}) * len(parts) == len(hot)
    own = [x["rep"] for x in hot if x["indexed"]]
    assert len(own) == len(set(own)) and max(sum(x["indexed"] for x in hot if x["part"] == p) for p in parts) <= 12


def test_a_positional_byte_is_a_word_pair(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("a b",), ("b a",), ("A, b",)], "t string").select(neardup.word_pairs(F.col("t")).alias("s"), F.xxhash64(F.lit("a"), F.lit("b")).alias("h")).collect()
    assert one[0]["s"] == one[2]["s"] == [one[0]["h"]] != one[1]["s"]


def test_empty_tables(spark):
    assert neardup.near_duplicate_pairs(frame(spark, []), "id", "txt").count() == 0
    assert neardup.near_duplicate_groups(frame(spark, []), "id", "txt").count() == 0


def test_components_of_a_long_path_a_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(7, 7), (None, 3), (2, 1), (50, 51), (50, 51)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}, 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
