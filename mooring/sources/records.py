"""Decoding of JSON lines with their aliases, defaults and Python-like truth values.

Lines are parsed once, to VARIANT, which keeps apart a missing key and an explicit null;
everything else is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooring.functions.text import word_count
from mooring.operators.flatten import GOLD_LISTS, NODE_KEYS, NODE_LISTS, NODE_TEXTS, QUERY_KEYS

RELEVANCE_KEYS, TYPE_KEYS, TOKEN_KEYS = ("relevance", "score", "query_score"), ("node_type", "type"), ("token_count", "tokens")


def get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Whether a VARIANT is true as Python sees it: not missing, null, false, 0, or empty."""
    k = kind_of(v)
    text = F.to_json(v)
    return F.when(v.isNull() | F.is_variant_null(v), False).otherwise(
        ~(text.isin("false", '""', "[]", "{}") | (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(1.0)) == 0) & ~k.isin("STRING", "BOOLEAN")))


def first_truthy(v: Column, keys: tuple[str, ...]) -> Column:
    """The first alias whose value is truthy, as VARIANT."""
    return F.coalesce(*(F.when(truthy(get(v, k)), get(v, k)) for k in keys))


def first_present(v: Column, keys: tuple[str, ...]) -> Column:
    """The first alias that is present at all, an explicit null included."""
    return F.coalesce(*(get(v, k) for k in keys))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


#: Keys of a query's subject, the first one first (fixed values).
SUBJECT_KEYS = ("s_wiki_title", "subj")


def metadata_value(v: Column, key: str) -> Column:
    """A key of a record, else of its object ``metadata``, as VARIANT; a key that is present at
    the top counts there even if it is null."""
    return F.coalesce(get(v, key), get(v, f"metadata.{key}"))


def subject(v: Column) -> Column:
    """A record's subject as text, null if it has none: a null value is passed over, an empty
    text is a subject."""
    def text(key: str) -> Column:
        found = metadata_value(v, key)
        return F.when(~F.is_variant_null(found), F.coalesce(as_text(found), F.to_json(found)))

    return F.coalesce(*map(text, SUBJECT_KEYS))


def with_subject(examples: DataFrame) -> DataFrame:
    """``examples`` with the column ``subject``, if they have one: their own column, or the
    fields s_wiki_title and subj of the struct ``metadata`` or of its struct ``metadata``."""
    if "subject" in examples.columns or "metadata" not in examples.columns:
        return examples

    def fields(kind, path: str) -> dict[str, str]:
        names = kind.fieldNames() if hasattr(kind, "fieldNames") else []
        inner = fields(kind["metadata"].dataType, f"{path}.metadata") if "metadata" in names else {}
        return inner | {n: f"{path}.{n}" for n in names if n in SUBJECT_KEYS}

    found = fields(examples.schema["metadata"].dataType, "metadata")
    columns = [F.col(found[k]).cast("string") for k in SUBJECT_KEYS if k in found]
    return examples.withColumn("subject", F.coalesce(*columns)) if columns else examples


def with_ordinal(df: DataFrame, name: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """``df``, a plain scan, with each row's 0-based place, dense over all its tasks.

    Rows are counted by task, or by the columns ``by``, whose order is then the order; a
    task's own counter does the rest, so only one row a task goes through one place.
    """
    counter = F.monotonically_increasing_id()
    rows = df.withColumns({"_ord_id": counter, "_ord_at": F.struct(*map(F.col, by)) if by else F.spark_partition_id()})
    starts = rows.groupBy("_ord_at").agg(F.min("_ord_id").alias("_ord_first"), F.count("*").alias("_ord_n"))
    offset = F.sum("_ord_n").over(Window.orderBy("_ord_at")) - F.col("_ord_n")  # one row a task or split
    starts = starts.withColumn("_ord_offset", offset).select("_ord_at", "_ord_first", "_ord_offset")
    return rows.join(F.broadcast(starts), "_ord_at").withColumn(name, F.col("_ord_id") - F.col("_ord_first") + F.col("_ord_offset")).drop("_ord_id", "_ord_at", "_ord_first", "_ord_offset")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord): the lines of text files with their places, files in the order of their paths."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return with_ordinal(lines, "ord", ("_file", "_start")).drop("_file", "_start")


def blank_line(line: str) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " ")) == ""


def node(v: Column) -> Column:
    """One node of the record format as a struct; an error names what is wrong with it."""
    key = as_text(first_truthy(v, NODE_KEYS))
    text = F.coalesce(as_text(first_truthy(v, NODE_TEXTS)), F.lit(""))
    relevance, kind = first_present(v, RELEVANCE_KEYS), first_present(v, TYPE_KEYS)
    tokens = F.try_variant_get(first_truthy(v, TOKEN_KEYS), "$", "bigint")
    flag = get(v, "is_anchor_candidate")
    vector = get(v, "embedding", "array<double>")
    return F.struct(
        F.when(key.isNull() & v.isNotNull(), F.raise_error(F.lit("a node has no id"))).otherwise(key).alias("node_id"),
        text.alias("text"),
        F.when(kind.isNull(), "chunk").when(F.is_variant_null(kind), "None").otherwise(as_text(kind)).alias("node_type"),
        F.when(relevance.isNull() | F.is_variant_null(relevance), 1.0).otherwise(F.try_variant_get(relevance, "$", "double")).alias("relevance"),
        F.when((F.coalesce(F.size(vector), F.lit(0)) <= 0) & v.isNotNull(), F.raise_error(F.concat(F.lit("no embedding in node "), F.coalesce(key, F.lit("?"))))).otherwise(vector).alias("embedding"),
        F.coalesce(tokens, word_count(text)).cast("int").alias("token_count"),
        F.when(flag.isNull(), True).otherwise(truthy(flag)).alias("is_anchor_candidate"),
        F.struct(F.coalesce(get(v, "metadata.title", "string"), get(v, "title", "string")).alias("title"), F.lit(None).cast("bigint").alias("corpus_index"),
                 get(v, "metadata.dataset", "string").alias("dataset")).alias("metadata"))


def examples(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of the record format as examples, each with its ``subject`` if it has one.  Blank
    lines are skipped; a line that can't be parsed, has no id, query or nodes, or mixes
    embedding lengths, fails the job, and a column ``ord`` then gives its number."""
    # the optimiser may look into a row before the filter does, so blank lines parse to null and raise nothing
    blank = blank_line(line)
    rows = lines.where(~blank).withColumn("v", F.parse_json(F.when(~blank, F.col(line))))
    v = F.col("v")
    query = F.coalesce(as_text(first_truthy(v, ("query",))), as_text(get(v, "question")), as_text(get(v, "query")))
    key = as_text(first_truthy(v, QUERY_KEYS))
    listed = F.try_variant_get(first_truthy(v, NODE_LISTS), "$", "array<variant>")
    gold = F.try_variant_get(first_truthy(v, GOLD_LISTS), "$", "array<string>")
    place = F.concat(F.lit(" in line "), (F.col("ord") + 1).cast("string")) if "ord" in lines.columns else F.lit("")
    fail = lambda bad, what, ok: F.when(bad & v.isNotNull(), F.raise_error(F.concat(F.lit(what), place, F.lit(": "), F.substring(line, 1, 80)))).otherwise(ok)
    made = rows.select(
        *[c for c in lines.columns if c != line],
        fail(key.isNull(), "no query id", key).alias("query_id"), fail(query.isNull(), "no query", query).alias("query"),
        fail(F.coalesce(F.size(listed), F.lit(0)) <= 0, "no nodes", F.transform(listed, node)).alias("nodes"),
        F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))).alias("gold_node_ids"), as_text(get(v, "answer")).alias("answer"), subject(v).alias("subject"))
    mixed = F.exists("nodes", lambda n: F.size(n["embedding"]) != F.size(F.col("nodes")[0]["embedding"]))
    return made.withColumn("nodes", F.when(mixed, F.raise_error(F.concat(F.lit("embeddings of several lengths in "), "query_id"))).otherwise(F.col("nodes")))


def read_examples(spark: SparkSession, path: str, limit: int | None = None, numbered: bool = False) -> DataFrame:
    """Examples from JSON lines, or from Parquet of the same shape.  ``numbered`` gives their
    places in the files as ``ord``, for which the files are read twice.  ``limit`` keeps the
    first examples, blank lines not counted, is numbered, and must be at least 1."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        rows = with_ordinal(rows) if numbered or limit else rows
        return rows.orderBy("ord").limit(limit) if limit else rows
    if not numbered and not limit:
        return examples(spark.read.text(path).withColumnRenamed("value", "line"))
    lines = numbered_lines(spark, path)
    return examples(lines.where(~blank_line("line")).orderBy("ord").limit(limit) if limit else lines)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with explicit nulls and unescaped text, replacing what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON lines, one row per query: of several the last line counts."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("n")))
    place = Window.partitionBy("query_id").orderBy(F.desc("_at"))
    return rows.withColumn("query_id", F.col("query_id").cast("string")).withColumn("_p", F.row_number().over(place)).where("_p = 1").drop("_p", "_at")


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.option("multiLine", True).json(path)


def validate(df: DataFrame) -> DataFrame:
    """One row: the number of examples, of their distinct queries, and the distinct embedding
    lengths, in order."""
    lengths = df.select(F.explode("nodes.embedding").alias("e")).select(F.size("e").cast("long").alias("d")).where("d is not null").distinct()
    dims = lengths.agg(F.sort_array(F.collect_list("d")).alias("embedding_dims"))
    counts = df.agg(F.count("*").alias("num_examples"), F.countDistinct("query_id").alias("num_queries"))
    return counts.crossJoin(F.broadcast(dims))  # one row each


def describe_run(row: dict, path: str) -> None:
    """A metric row as indented JSON."""
    import json
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
