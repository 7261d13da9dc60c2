import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mooring.llm import lookalike as L

SCHEMA = "id long, txt string, look string, stored string, one string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def plain():
    return L.rewriter(L.Classes(L.look_alikes()).rewriting({chr(c): 1000 for c in range(32, 127)}))


SAME = [("café", "café"), ("Peter", "Рeter"), ("Peter", "Ｐｅｔｅｒ"), ("a b", "a b"), ("a b", "a b"), ("co-op", "co‑op"), ("office", "oﬃce"), ("office", "oﬀice"),
        ("office", "ofﬁce"), ("office", "оffіⅽе"), ("zero", "ze​ro﻿"), ("soft", "so­ft"), ("ガ", "ｶﾞ"), ("wait...", "wait…"), ("é", "e​́"), ("ё", "ë"), ("K2", "K2"),
        ("MIX", "МΙХ"), ("Θoς", "Θος"), ("ạ̈", "ạ̈")]
DIFFERENT = [("cafe", "café"), ("Peter", "peter"), ("m2", "m²"), ("a b", "a\nb"), ("a b", "a  b"), ("1", "l"), ("0", "O"), ("か", "が"), ("o", "ø"), ("и", "й"), ("ο", "ό"), ("rn", "m"), ("ß", "ss"), ("oe", "œ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert plain()(a) == plain()(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert plain()(a) != plain()(b)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abeофοﬁﬀﬃi ѕ̣́​­Ａぱﾊﾟ² \n…."), max_size=30))
def test_rewriting_is_idempotent_and_sees_through_decomposition(text):
    rewrite = plain()
    once = rewrite(text)
    assert rewrite(once) == once
    assert rewrite(unicodedata.normalize("NFD", text)) == once


def test_representatives_follow_frequency_and_classes_are_transitive():
    c = L.Classes([("a", "x"), ("x", "q"), ("ff", "F"), ("f", "φ"), ("", "z")])
    assert c.rewriting({"q": 5, "a": 2, "φ": 3}) == {"a": "q", "x": "q", "f": "φ", "F": "φφ", "ff": "φφ", "z": ""}


def test_greedy_longest_patterns():
    assert L.rewriter({"ab": "1", "abc": "2", "c": "3"})("ababcc") == "123"


def test_pairs_and_classes(spark):
    r = random.Random(5)
    swap = {"a": "аａ", "e": "е", "o": "оοօ", "i": "іⅰ", " ": "  ", "-": "‑"}
    rows = []
    for base in ["the old mill - a note", "abc", "x" * 5000 + " oo", "héé", "naïve site"]:
        for _ in range(6):
            rows.append((len(rows), "".join(r.choice(swap[c]) if c in swap and r.random() < 0.2 else c for c in base)))
    rows += [(100, None), (101, ""), (102, "​"), (103, "﻿"), (None, "abc"), rows[3], (104, "ABC")]
    rewrite = plain()
    texts = {(i, t) for i, t in rows if i is not None and t}
    want = {(i, j) for i, a in texts for j, b in texts if i < j and a != b and rewrite(a) == rewrite(b)}
    got = [tuple(x) for x in L.look_alike_pairs(frame(spark, rows), "id", "txt").collect()]
    assert set(got) == want and len(got) == len(want) and (102, 103) in want
    classes = {x["id"]: x["class_id"] for x in L.look_alike_classes(frame(spark, rows), "id", "txt").collect()}
    for i, a in texts:
        assert classes[i] == min(j for j, b in texts if rewrite(a) == rewrite(b))
    kept = L.one_form(frame(spark, rows), "txt").collect()
    assert len(kept) == len(rows) and {x["one_form"] for x in kept if x["txt"] is None} == {None}
    with pytest.raises(ValueError):
        L.one_form(frame(spark, rows), "txt", "one")


def test_empty_table(spark):
    assert L.look_alike_pairs(frame(spark, []), "id", "txt").count() == 0
    assert L.look_alike_classes(frame(spark, []), "id", "txt").count() == 0
