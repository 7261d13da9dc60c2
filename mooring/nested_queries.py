"""Queries of the nested-record and reference operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.operators import flatten
from mooring.operators.orphans import micros, orphan_references


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows of every raw line."""
    return flatten.child_rows(spark.read.parquet(f"{sf}/examples_raw.parquet"))


def p4_parents(spark: SparkSession, sf: str) -> DataFrame:
    """The parent table: one row per line that is a JSON object."""
    return flatten.query_rows(spark.read.parquet(f"{sf}/examples_raw.parquet"))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/examples.parquet").select("query_id", "batch", micros(F.col("ingested_at")).alias("at"), "nodes.node_id")
    return rows.select("query_id", "batch", "at", F.explode("node_id").alias("node_id")).where("node_id is not null")


def _pair_key():
    """One string per (query, node): the length keeps the two apart."""
    return F.concat(F.length("query_id"), F.lit(":"), F.col("query_id"), F.col("node_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Node references without a live corpus row, gold references to nodes not listed by then."""
    listed = _listed(spark, sf)
    lives = spark.read.parquet(f"{sf}/corpus.parquet").select(
        F.col("node_id").alias("key"), micros(F.col("added_at")).alias("since"), micros(F.col("removed_at")).alias("until"))
    payload = ["batch", "query_id", "node_id"]
    nodes = orphan_references(listed.select(F.col("node_id").alias("key"), "at", *payload), lives, payload)
    gold = (spark.read.parquet(f"{sf}/examples.parquet")
            .select("query_id", "batch", micros(F.col("ingested_at")).alias("at"), F.explode("gold_node_ids").alias("node_id"))
            .where("node_id is not null").withColumn("key", F.coalesce(_pair_key(), F.concat(F.lit("?:"), F.col("node_id")))))
    from_then = listed.where("query_id is not null").groupBy("query_id", "node_id").agg(F.min("at").alias("since"))
    shown = from_then.select(_pair_key().alias("key"), "since", F.lit(None).cast("long").alias("until"))
    golds = orphan_references(gold.select("key", "at", *payload), shown, payload)
    return (nodes.select(F.lit("node").alias("ref_field"), *payload)
            .unionByName(golds.select(F.lit("gold").alias("ref_field"), *payload)))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references, distinct nodes among them and queries that have any, per field and batch."""
    return p5_found(spark, sf).groupBy("ref_field", "batch").agg(
        F.count("*").alias("orphans"), F.countDistinct("node_id").alias("node_ids"), F.countDistinct("query_id").alias("queries"))


QUERIES = {f.__name__: f for f in (p4_found, p4_parents, p5_found, p5_report)}


def _unwrapped(x: str) -> str:
    """A list or object inside a string as itself."""
    return (f"(CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[\\[{{]') AND json_valid({x} ->> '$')"
            f" THEN json({x} ->> '$') ELSE {x} END)")


def _first(obj: str, names: tuple[str, ...]) -> str:
    def one(name: str) -> str:
        x = _unwrapped(f"json_extract({obj}, '$.{name}')")
        return (f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' OR (json_type({x}) = 'VARCHAR' AND ({x} ->> '$') = '')"
                f" OR (json_type({x}) = 'ARRAY' AND json_array_length({x}) = 0) THEN NULL ELSE {x} END")
    return f"coalesce({', '.join(map(one, names))})"


def _elements(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END)"


_RECORDS = f"""
    records AS (SELECT line_no, json(line) AS j FROM examples_raw WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
    lists AS (SELECT line_no, j, {_first('j', flatten.NODE_LISTS)} AS nl, {_first('j', flatten.GOLD_LISTS)} AS gl FROM records),
    taken AS (SELECT line_no, j, {_elements('nl')} AS nodes, {_elements('gl')} AS golds FROM lists),
    node_rows AS (SELECT line_no, {_unwrapped('e')} AS n, pos FROM (SELECT line_no, unnest(nodes) AS e, generate_subscripts(nodes, 1) - 1 AS pos FROM taken)),
    gold_rows AS (SELECT line_no, e, pos FROM (SELECT line_no, unnest(golds) AS e, generate_subscripts(golds, 1) - 1 AS pos FROM taken)),
    children AS (
        SELECT line_no, 'node' AS child_table, pos, {_first('n', flatten.NODE_KEYS)} ->> '$' AS child_key FROM node_rows
        UNION ALL SELECT line_no, 'title', pos, json_extract({_unwrapped("json_extract(n, '$.metadata')")}, '$.title') ->> '$' FROM node_rows
        UNION ALL SELECT line_no, 'gold', pos, CASE WHEN json_type(e) = 'NULL' THEN NULL ELSE e ->> '$' END FROM gold_rows)"""

_ORPHANS = """
    listed AS (SELECT query_id, batch, ingested_at, unnest(nodes).node_id AS node_id FROM examples),
    golds AS (SELECT query_id, batch, ingested_at, unnest(gold_node_ids) AS node_id FROM examples),
    shown AS (SELECT query_id, node_id, min(ingested_at) AS since FROM listed WHERE node_id IS NOT NULL GROUP BY 1, 2),
    orphans AS (
        SELECT DISTINCT 'node' AS ref_field, batch, query_id, node_id FROM listed l
        WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus c WHERE c.node_id = l.node_id AND c.added_at <= l.ingested_at
                                                  AND (c.removed_at IS NULL OR l.ingested_at < c.removed_at))
        UNION ALL
        SELECT DISTINCT 'gold', g.batch, g.query_id, g.node_id FROM golds g LEFT JOIN shown s ON s.query_id = g.query_id AND s.node_id = g.node_id
        WHERE g.node_id IS NOT NULL AND (s.since IS NULL OR g.ingested_at IS NULL OR s.since > g.ingested_at))"""

ORACLES = {
    "p4_found": f"WITH {_RECORDS} SELECT line_no, child_table, pos, child_key FROM children WHERE child_key <> ''",
    "p4_parents": f"""WITH {_RECORDS}
SELECT line_no, {_first('j', flatten.QUERY_KEYS)} ->> '$' AS query_id, {_first('j', flatten.QUERY_TEXTS)} ->> '$' AS query,
       json_extract(j, '$.answer') ->> '$' AS answer, len(nodes) AS nodes, len(golds) AS golds FROM taken""",
    "p5_found": f"WITH {_ORPHANS} SELECT ref_field, batch, query_id, node_id FROM orphans",
    "p5_report": f"""WITH {_ORPHANS} SELECT ref_field, batch, count(*) AS orphans, count(DISTINCT node_id) AS node_ids,
       count(DISTINCT query_id) AS queries FROM orphans GROUP BY 1, 2""",
}
