import json
import random

import pytest

from mooring.operators.flatten import child_rows, flatten_lists, query_rows


def brute(rows):
    out = set()

    def unwrap(v):
        if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
            try:
                return json.loads(v, parse_int=str, parse_float=str)
            except ValueError:
                return v
        return v

    def pick(o, names):
        for n in names:
            v = unwrap(o.get(n))
            if v is not None and v != "" and v != []:
                return v
        return None

    listed = lambda v: [] if v is None else v if isinstance(v, list) else [v]
    for key, line in rows:
        try:
            o = json.loads(line or "", parse_int=str, parse_float=str)
        except ValueError:
            continue
        if not isinstance(o, dict):
            continue
        for pos, n in enumerate(listed(pick(o, ("nodes", "chunks")))):
            n = unwrap(n)
            if not isinstance(n, dict):
                continue
            name = pick(n, ("node_id", "id", "chunk_id"))
            if name is not None:
                out.add((key, "node", pos, name))
            m = unwrap(n.get("metadata"))
            if isinstance(m, dict) and m.get("title"):
                out.add((key, "title", pos, m["title"]))
        for pos, g in enumerate(listed(pick(o, ("gold_node_ids", "support_node_ids", "support_ids")))):
            if g:
                out.add((key, "gold", pos, g))
    return out


LINES = [
    '{"nodes":[{"node_id":"a","metadata":{"title":"T"}},null,{"id":7},{"node_id":"","chunk_id":"c","metadata":{"title":""}}],"gold_node_ids":["a",null,3]}',
    '{"nodes":[],"chunks":{"id":"single","metadata":"{\\"title\\": \\"in text\\"}"},"support_ids":"g1"}',
    '{"nodes":"[{\\"node_id\\": \\"x\\", \\"metadata\\": {\\"section\\": {\\"title\\": \\"deep\\"}}}]","gold_node_ids":"[\\"p\\", \\"q\\"]"}',
    '{"nodes":null,"chunks":["{\\"id\\": \\"wrapped\\"}"],"gold_node_ids":[],"support_node_ids":12,"support_ids":["no"]}',
    '{"metadata":{"nodes":[{"node_id":"not me"}]},"nodes":[{"title":"not a title","node_id":"n"}]}',
    '{"nodes":[{"node_id":"cut"', '[{"nodes":[{"node_id":"list"}]}]', '{"nodes":[{"node_id":"two"}]} {"a":1}', '{"nodes":[{"node_id":"tail"}]} x', "null", "", "   ", None, "#header", "{}",
    '  {"nodes" : [ {"chunk_id" : "spaces"} ] }  ', '{"nodes":[{"node_id":"ünï ☃","metadata":{"title":"\\u00e9\\n"}}]}', '{"nodes":[{"node_id":"dup"},{"node_id":"dup"}],"gold_node_ids":["a","a"]}',
]


def test_dirty_lines(spark):
    rows = list(enumerate(LINES))
    df = spark.createDataFrame([(k, x, "r", "c") for k, x in rows], "line_no long, line string, record string, child_key string")
    got = [tuple(r) for r in child_rows(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    parents = {r["line_no"]: (r["nodes"], r["golds"]) for r in query_rows(df).collect()}
    assert parents[0] == (4, 3) and parents[14] == (0, 0) and 5 not in parents


def test_many_batches_keep_parents_and_places(spark):
    r = random.Random(1)
    rows = [(k, json.dumps({"nodes": [r.choice([None, {"id": f"{k}-{j}", "metadata": {"title": r.choice(["t", "", None])}}]) for j in range(r.randrange(40))], "gold_node_ids": [str(j) for j in range(r.randrange(5))]})) for k in range(400)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(x) for x in child_rows(spark.createDataFrame(rows, "line_no long, line string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows)


def test_lists_of_any_table(spark):
    df = spark.createDataFrame([(1, "x", ["a", None, ""], [("k",)]), (2, "y", None, []), (3, None, ["b"], None)], "n int, s string, l array<string>, t array<struct<f:string>>")
    got = {tuple(r) for r in flatten_lists(df, ["n", "s"], {"plain": ("l", None), "field": ("t", "f")}).collect()}
    assert got == {(1, "x", "plain", 0, "a"), (3, None, "plain", 0, "b"), (1, "x", "field", 0, "k")}


@pytest.mark.parametrize("line", [[], [(1, None)]])
def test_empty_tables(spark, line):
    assert child_rows(spark.createDataFrame(line, "line_no long, line string")).count() == 0


def test_no_level_is_parsed_twice(spark):
    lines = spark.createDataFrame([(1, "{}")], "line_no long, line string")
    for made in (child_rows(lines), query_rows(lines)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 8
