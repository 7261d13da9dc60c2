"""Nested records to flat child tables by Arrow buffers.

JSON text is decoded by Spark's own parser into typed lists, aliases and all, without
Python.  The lists then reach Arrow as offsets and child arrays, and a child table is
read off them: the child array itself, each child's parent index (from the offsets),
its place (its own index less the parent's offset) and the parent's keys (a take by
parent index).  No row is looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field aliases, first one first (fixed values of the record format).
NODE_KEYS = ("node_id", "id", "chunk_id")
NODE_LISTS = ("nodes", "chunks")
GOLD_LISTS = ("gold_node_ids", "support_node_ids", "support_ids")
QUERY_KEYS = ("query_id", "qid", "id")
QUERY_TEXTS = ("query", "question")
NODE_TEXTS = ("text", "content")


def flatten_lists(df: DataFrame, keys: list[str], children: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(keys..., child_table, pos, child_key): one row per child whose key is not null.

    ``children`` maps a child table's name to (list column, field of its structs, or None
    if the list holds the keys themselves).  pos is the 0-based place in the list; null
    children and children with a null or empty key give no row but keep their place.  A
    null or empty list, and an empty table, give no rows.  Key columns keep their types;
    other columns are ignored.
    """
    lists = sorted({column for column, _ in children.values()})
    key_type = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {key_type[k]}" for k in keys), "child_table string", "pos bigint", "child_key string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (column, field) in children.items():
                array = batch.column(column)
                parent = pc.list_parent_indices(array)
                child = pc.list_flatten(array)
                value = child if field is None else child.field(field)
                # nulls of a struct hide its fields' values
                there = pc.and_(child.is_valid(), pc.fill_null(pc.not_equal(value, ""), False))
                lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.arange(len(child)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                parent = parent.filter(there)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(parent) for k in keys), pa.repeat(pa.scalar(name, pa.string()), len(parent)),
                     pa.array(place).filter(there), value.filter(there).cast(pa.string())],
                    names=[*keys, "child_table", "pos", "child_key"])

    return df.select(*keys, *lists).mapInArrow(run, schema)


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "") | text.rlike(r"^\s*\[\s*\]\s*$")


def first_of(record: Column, names: tuple[str, ...]) -> Column:
    """The first alias that is neither null, an empty string nor an empty list."""
    return F.coalesce(*(F.when(~_blank(record[n]), record[n]) for n in names))


def as_list(text: Column) -> Column:
    """JSON text of a list as its elements' texts; anything else as a list of one."""
    items = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    return F.when(text.isNotNull(), F.coalesce(items, F.array(text)))


def _fields(*names: str) -> str:
    return ", ".join(f"{n} string" for n in names)


def decode_records(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with the parsed ``record``, ``node_list`` (array of struct key, title and the
    node's texts) and ``gold_list`` (array of string), for lines that are one complete JSON
    object; other lines are dropped.

    Lists and objects inside strings are parsed as well; a single object or value counts as
    a list of one; numbers and booleans become their text.  Every level is parsed by a
    projection of its own, so no text of it is parsed twice.
    """
    top = _fields(*NODE_LISTS, *GOLD_LISTS, *QUERY_KEYS, *QUERY_TEXTS, "answer")
    node = _fields(*NODE_KEYS, *NODE_TEXTS, "metadata")
    # the parser stops at the end of the object, so the rest of the line is judged as part of a list
    whole = F.col(line).rlike(r"^\s*\{") & (F.json_array_length(F.concat(F.lit("["), F.col(line), F.lit("]"))) == 1)
    record, nodes, golds, named = (F.col(c) for c in ("record", "node_list", "gold_list", "_named"))
    rows = df.where(whole).withColumn("record", F.from_json(F.col(line), top, {"mode": "PERMISSIVE"}))
    rows = rows.withColumns({"node_list": first_of(record, NODE_LISTS), "gold_list": first_of(record, GOLD_LISTS)})
    rows = rows.withColumns({"node_list": as_list(nodes), "gold_list": as_list(golds)})
    rows = rows.withColumns({
        "node_list": F.transform(nodes, lambda e: F.from_json(e, node)),
        "_named": F.transform(golds, lambda e: F.when(e.rlike(r"^\s*\{"), F.from_json(e, node)))})
    rows = rows.withColumn("_titles", F.transform(nodes, lambda n: F.from_json(n["metadata"], _fields("title"))["title"]))

    def flat(n: Column, title: Column) -> Column:
        return F.when(n.isNotNull(), F.struct(first_of(n, NODE_KEYS).alias("key"), F.when(title != "", title).alias("title"), first_of(n, NODE_TEXTS).alias("text")))

    gold = F.zip_with(golds, named, lambda e, n: F.coalesce(F.when(n.isNotNull(), first_of(n, NODE_KEYS)), e))
    return rows.withColumns({"node_list": F.zip_with(nodes, F.col("_titles"), flat), "gold_list": gold}).drop("_named", "_titles")


def _only(df: DataFrame, key: str, line: str) -> DataFrame:
    # under names of our own, which no other column can have
    return df.select(F.col(key).alias("_key"), F.col(line).alias("_line"))


def child_rows(df: DataFrame, key: str = "line_no", line: str = "line") -> DataFrame:
    """The child rows ``node``, ``title`` and ``gold`` of records as JSON text: see
    decode_records and flatten_lists.  Null, blank, cut-off and non-object lines give nothing."""
    rows = decode_records(_only(df, key, line), "_line").select("_key", "node_list", "gold_list")
    children = {"node": ("node_list", "key"), "title": ("node_list", "title"), "gold": ("gold_list", None)}
    return flatten_lists(rows, ["_key"], children).withColumnRenamed("_key", key)


def query_rows(df: DataFrame, key: str = "line_no", line: str = "line") -> DataFrame:
    """(key, query_id, query, answer, nodes, golds): the parent table, with the lists' lengths."""
    rows = decode_records(_only(df, key, line), "_line")
    record = F.col("record")
    return rows.select(F.col("_key").alias(key), first_of(record, QUERY_KEYS).alias("query_id"), first_of(record, QUERY_TEXTS).alias("query"), record["answer"].alias("answer"),
                       F.coalesce(F.size("node_list"), F.lit(0)).cast("long").alias("nodes"), F.coalesce(F.size("gold_list"), F.lit(0)).cast("long").alias("golds"))
