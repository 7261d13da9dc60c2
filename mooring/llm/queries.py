"""Queries of the training-data operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.llm import clusters as C
from mooring.llm import lookalike as L
from mooring.llm import neardup as N
from mooring.llm.mixing import mix
from mooring.llm.packing import pack, packing_report
from mooring.llm.tokens import with_tokens
from mooring.llm.topn import top_n_per_group
from mooring.shared import materialise


def _nodes(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """One row per entry of examples.nodes, with only the fields asked for."""
    rows = spark.read.parquet(f"{sf}/examples.parquet").select("query_id", F.explode("nodes").alias("n"))
    return rows.select("query_id", *(F.col(f"n.{f}") for f in fields))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best distinct nodes of every query."""
    rows = _nodes(spark, sf, "node_id", "relevance")
    return top_n_per_group(rows, "query_id", "node_id", "relevance", 5).select("query_id", "node_id")


def p1_top_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best distinct nodes of every query with their scores and places."""
    rows = _nodes(spark, sf, "node_id", "relevance")
    top = top_n_per_group(rows, "query_id", "node_id", "relevance", 10)
    place = F.row_number().over(_order("query_id", F.desc("relevance"), "node_id"))
    return top.withColumn("place", place.cast("long"))


def _order(group: str, *by):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*by)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of node ids whose texts share 0.6 of their word pairs."""
    pairs = N.near_duplicate_pairs(_nodes(spark, sf, "node_id", "text"), "node_id", "text", 0.6)
    return pairs.select(F.col("id_a").alias("node_id_a"), F.col("id_b").alias("node_id_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per node id with the group that its near-duplicates form and its links."""
    groups = N.near_duplicate_groups(_nodes(spark, sf, "node_id", "text"), "node_id", "text", 0.6)
    return groups.select("group_id", F.col("id").alias("node_id"), "links")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.clusters(_nodes(spark, sf, "node_id", "embedding"), "node_id", "embedding", 0.9)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the clusters of node ids with alike embeddings."""
    return _clusters(spark, sf).select("cluster_id", F.col("id").alias("node_id"))


def p3_cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster's size, number of density peaks and three most typical members."""
    relevance = _nodes(spark, sf, "node_id", "relevance").select(F.col("node_id").alias("id"), "relevance")
    return C.describe_clusters(_clusters(spark, sf), relevance)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's container in every plan."""
    docs, plans = _table(spark, sf, "documents"), _table(spark, sf, "pack_plans")
    return pack(docs, plans).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each plan are."""
    docs, plans = _table(spark, sf, "documents"), _table(spark, sf, "pack_plans")
    return packing_report(pack(docs, plans), plans)


def p6_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every plan's containers: all documents with text come out, each piece
    once, none beyond the capacity, and only texts larger than that are split."""
    docs, plans = _table(spark, sf, "documents"), _table(spark, sf, "pack_plans")
    packed = materialise(pack(docs, plans), "packed")
    boxes = packed.groupBy("plan_id", "container_id").agg(F.sum("tokens").alias("used")).join(F.broadcast(plans), "plan_id")
    fits = boxes.groupBy("plan_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    per_doc = packed.groupBy("plan_id", "id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("size")).join(F.broadcast(plans), "plan_id")
    sums = per_doc.groupBy("plan_id").agg(
        F.count("*").alias("documents"), F.count_if((F.col("n") > F.col("pieces")) | (F.col("last") + 1 != F.col("pieces"))).alias("torn"),
        F.count_if(F.col("pieces") != F.ceil(F.col("size") / F.col("capacity_tokens"))).alias("needlessly_split"))
    return sums.join(fits, "plan_id").select("plan_id", "documents", "torn", "needlessly_split", "overfull")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = materialise(with_tokens(_table(spark, sf, "documents").select("doc_id", "source", "text"), "text"), "sizes")
    return mix(sized, _table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents chosen for each mix and how often each is used."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares each mix reaches."""
    return _mix(spark, sf)[1]


def _by_characters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("long").alias("tokens"))
    return mix(docs, _table(spark, sf, "mix_targets"))


def p7_mix_characters(spark: SparkSession, sf: str) -> DataFrame:
    """As p7_mix with sizes in characters, which SQL can count."""
    return _by_characters(spark, sf)[0].withColumnsRenamed({"tokens": "characters"}).withColumn("repeats", F.col("repeats").cast("long"))


def p7_shares_characters(spark: SparkSession, sf: str) -> DataFrame:
    """As p7_shares with sizes in characters."""
    shares = _by_characters(spark, sf)[1]
    return shares.select("mix_id", "source", F.col("available_tokens").alias("available"), F.col("tokens").alias("characters"), "docs",
                         F.col("most_repeats").cast("long").alias("most_repeats"), F.round("actual_share", 6).alias("actual_share"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that read the same but aren't stored alike."""
    pairs = L.look_alike_pairs(_table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_one_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its one form."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return L.one_form(docs, "text").select("doc_id", "one_form")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with the class of texts that read like its own."""
    found = L.look_alike_classes(_table(spark, sf, "documents"), "doc_id", "text")
    return found.select("class_id", F.col("id").alias("doc_id"), "forms", "members")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_top_scores, p2_found, p2_groups, p3_found, p3_cluster_summary, p6_pack, p6_report, p6_whole, p7_mix, p7_shares, p7_mix_characters, p7_shares_characters,
    p8_found, p8_one_form, p8_classes)}

_BEST = """
    SELECT query_id, n.node_id AS node_id, max(n.relevance) AS relevance
    FROM (SELECT query_id, unnest(nodes) AS n FROM examples)
    WHERE query_id IS NOT NULL AND n.node_id IS NOT NULL AND n.relevance IS NOT NULL AND NOT isnan(n.relevance)
    GROUP BY 1, 2"""

_PAIR_SETS = r"""
    texts AS (SELECT DISTINCT n.node_id AS node_id, n.text AS text FROM (SELECT unnest(nodes) AS n FROM examples)
              WHERE n.node_id IS NOT NULL AND n.text IS NOT NULL),
    words AS (SELECT node_id, text, list_filter(string_split_regex(lower(text), '[\s\x1c-\x1f\x{85}\pZ!-/:-@\[-`{-~]+'), lambda w: w <> '') AS w FROM texts),
    sets AS (SELECT node_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM words WHERE len(w) > 1),
    slots AS (SELECT node_id, unnest(s) AS p, len(s) AS size FROM sets),
    shared AS (SELECT a.node_id AS node_id_a, b.node_id AS node_id_b, count(*) AS n, any_value(a.size) AS sa, any_value(b.size) AS sb
               FROM slots a JOIN slots b ON a.p = b.p AND a.node_id < b.node_id GROUP BY 1, 2),
    pairs AS (SELECT DISTINCT node_id_a, node_id_b FROM shared WHERE n >= 0.6 * (sa + sb - n) - 1e-9)"""

_ALIKE = """
    raw AS (SELECT DISTINCT n.node_id AS node_id, n.embedding AS e, len(n.embedding) AS d FROM (SELECT unnest(nodes) AS n FROM examples)
            WHERE n.node_id IS NOT NULL AND len(n.embedding) > 0 AND list_sum(list_transform(n.embedding, lambda x: abs(x))) > 0),
    links AS (SELECT a.node_id AS x, b.node_id AS y FROM raw a JOIN raw b
              ON a.d = b.d AND a.node_id <> b.node_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    found AS (SELECT least(x, min(y)) AS cluster_id, x AS node_id FROM reach GROUP BY x)"""

_MIX = """
    sized AS (SELECT source, doc_id, length(text) AS size, ('0x' || substr(md5('0|' || doc_id), 1, 13))::BIGINT AS h FROM documents
              WHERE source IN (SELECT source FROM mix_targets) AND doc_id IS NOT NULL AND length(text) > 0),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM sized),
    wholes AS (SELECT source, sum(size) AS whole FROM sized GROUP BY 1),
    targets AS (SELECT mix_id, source, target_share, max_repeats, coalesce(whole, 0) AS whole FROM mix_targets LEFT JOIN wholes USING (source)),
    budgets AS (SELECT *, least(target_share * sum(whole) OVER (PARTITION BY mix_id), (max_repeats * whole)::DOUBLE) AS budget FROM targets),
    epochs AS (SELECT *, CASE WHEN whole > 0 THEN floor(budget / whole) ELSE 0 END AS full_times FROM budgets),
    chosen AS (SELECT mix_id, source, doc_id, size::BIGINT AS characters,
                      least(full_times + CASE WHEN before + size / 2.0 <= budget - full_times * whole THEN 1 ELSE 0 END, max_repeats)::BIGINT AS repeats
               FROM placed JOIN epochs USING (source)),
    taken AS (SELECT * FROM chosen WHERE repeats > 0)"""


def _looks_sql() -> str:
    """Texts in one form by translation of composed characters; which member of a class stands
    for it doesn't matter to what is equal, so frequencies aren't needed."""
    import sys
    import unicodedata

    forms = L.Classes(L.look_alikes()).rewriting({})
    if any(len(p) > 1 for p in forms):
        raise ValueError("patterns of several characters can't be translated")
    gone, spelt, single = [], [], []
    for code in (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000):
        char = chr(code)
        form = unicodedata.normalize("NFC", "".join(forms.get(c, c) for c in unicodedata.normalize("NFD", char)))
        if unicodedata.normalize("NFC", char) == char != form:
            (gone if not form else single if len(form) == 1 else spelt).append((char, form))
    text = "nfc_normalize(text)"
    for char, form in spelt:
        text = f"replace({text}, '{char}', '{form}')"
    quoted = lambda s: s.replace("'", "''")
    source, target = "".join(c for c, _ in [*single, *gone]), "".join(f for _, f in single)
    return f"""
    looks AS (SELECT DISTINCT doc_id AS id, text, nfc_normalize(translate({text}, '{quoted(source)}', '{quoted(target)}')) AS look
              FROM documents WHERE doc_id IS NOT NULL AND text <> '')"""


def _one_form_sql() -> str:
    """Texts in one form with the most frequent member of each class, counted over all texts."""
    import sys
    import unicodedata

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    groups = L.Classes(L.look_alikes()).members()
    of = {m: root for root, members in groups.items() for m in members}
    # a class with a string of several characters, or none, is spelt in its parts' classes
    fixed = {root: min((m for m in members if len(m) != 1), key=lambda m: (len(m), m)) for root, members in groups.items() if any(len(m) != 1 for m in members)}
    parts = [(c, n, p) for code in range(sys.maxunicode + 1) if not 0xD800 <= code < 0xE000
             for c in [chr(code)] for d in [unicodedata.normalize("NFD", c)] if unicodedata.normalize("NFC", c) == c and any(x in of for x in d) for n, p in enumerate(d)]
    spelt = [(m, n, p) for m, root in of.items() if len(m) == 1 and root in fixed for n, p in enumerate(fixed[root])]
    rows = lambda t: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else quoted(v) for v in r) + ")" for r in t)
    singles = [(m, quoted(root)) for m, root in of.items() if len(m) == 1 and root not in fixed]
    gone = [(m,) for m, root in of.items() if len(m) == 1 and root in fixed and not fixed[root]]
    return f"""
    parts(c, n, p) AS (VALUES {rows(parts)}), spelt(m, n, p) AS (VALUES {rows(spelt)}), gone(m) AS (VALUES {rows(gone)}), class_of(m, root) AS (VALUES {rows(singles)}),
    chars AS (SELECT doc_id, unnest(string_split(nfc_normalize(text), '')) AS c, generate_subscripts(string_split(nfc_normalize(text), ''), 1) AS place FROM documents WHERE text <> ''),
    pieces AS (SELECT doc_id, place, coalesce(n, 0) AS n, coalesce(p, chars.c) AS m FROM chars LEFT JOIN parts USING (c)),
    often AS (SELECT m, count(*) AS freq FROM pieces GROUP BY 1),
    forms AS (SELECT root, arg_min(m, struct_pack(f := -coalesce(freq, 0), m := m)) AS form FROM class_of LEFT JOIN often USING (m) GROUP BY 1),
    letters AS (SELECT m, form FROM class_of JOIN forms USING (root)),
    spellings AS (SELECT s.m, string_agg(coalesce(l.form, s.p), '' ORDER BY s.n) AS form FROM spelt s LEFT JOIN letters l ON l.m = s.p GROUP BY 1 UNION ALL SELECT m, '' FROM gone),
    forms_of AS (SELECT * FROM letters UNION ALL SELECT * FROM spellings),
    rebuilt AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(form, m), '' ORDER BY place, n)) AS one_form FROM pieces LEFT JOIN forms_of USING (m) GROUP BY 1)"""


def _oracles() -> dict[str, str]:
    return {
        "p8_one_form": f"WITH {_one_form_sql()} SELECT d.doc_id, CASE WHEN text = '' THEN '' ELSE one_form END AS one_form FROM documents d LEFT JOIN rebuilt USING (doc_id)",
        "p6_whole": """
SELECT plan_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS documents, 0::BIGINT AS torn, 0::BIGINT AS needlessly_split, 0::BIGINT AS overfull
FROM pack_plans WHERE capacity_tokens > 0""",
        "p7_mix_characters": f"WITH {_MIX} SELECT mix_id, source, doc_id, characters, repeats FROM taken",
        "p7_shares_characters": f"""
WITH {_MIX}, got AS (SELECT mix_id, source, sum(characters * repeats)::BIGINT AS characters, count(*) AS docs, max(repeats) AS most_repeats FROM taken GROUP BY 1, 2)
SELECT mix_id, source, whole::BIGINT AS available, coalesce(characters, 0)::BIGINT AS characters, coalesce(docs, 0) AS docs, coalesce(most_repeats, 0) AS most_repeats,
    round(coalesce(characters, 0) / nullif(sum(characters) OVER (PARTITION BY mix_id), 0), 6) AS actual_share FROM targets LEFT JOIN got USING (mix_id, source)""",
        "p8_found": f"""
WITH {_looks_sql()}
SELECT DISTINCT a.id AS doc_id_a, b.id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.id < b.id AND a.text <> b.text""",
        "p8_classes": f"""
WITH {_looks_sql()}
SELECT min(id) OVER (PARTITION BY look) AS class_id, id AS doc_id, (SELECT count(DISTINCT text) FROM looks b WHERE b.look = a.look) AS forms, count(*) OVER (PARTITION BY look) AS members FROM looks a""",
        "p1_found": f"""
WITH best AS ({_BEST})
SELECT query_id, node_id FROM best
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, node_id) <= 5""",
        "p1_top_scores": f"""
WITH best AS ({_BEST})
SELECT query_id, node_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, node_id) AS place FROM best
QUALIFY place <= 10""",
        "p2_found": f"WITH {_PAIR_SETS} SELECT node_id_a, node_id_b FROM pairs",
        "p2_groups": f"""
WITH RECURSIVE {_PAIR_SETS},
    links AS (SELECT node_id_a AS x, node_id_b AS y FROM pairs UNION SELECT node_id_b, node_id_a FROM pairs),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
    text_of AS (SELECT s.node_id, t.text FROM sets s JOIN texts t USING (node_id)),
    degree AS (SELECT l.x, count(DISTINCT b.text) AS links FROM links l JOIN text_of a ON a.node_id = l.x JOIN text_of b ON b.node_id = l.y
               WHERE a.text <> b.text GROUP BY l.x)
SELECT coalesce(least(s.node_id, low.y), s.node_id) AS group_id, s.node_id, coalesce(degree.links, 0) AS links
FROM (SELECT DISTINCT node_id FROM sets) s LEFT JOIN low ON low.x = s.node_id LEFT JOIN degree ON degree.x = s.node_id""",
        "p3_cluster_summary": f"""
WITH RECURSIVE {_ALIKE},
    degree AS (SELECT x, count(*) AS density FROM links GROUP BY x),
    beaten AS (SELECT DISTINCT l.x FROM links l JOIN degree a ON a.x = l.x JOIN degree b ON b.x = l.y WHERE b.density > a.density OR (b.density = a.density AND l.y < l.x)),
    best AS (SELECT n.node_id AS node_id, max(n.relevance) AS relevance FROM (SELECT unnest(nodes) AS n FROM examples) WHERE n.relevance IS NOT NULL AND NOT isnan(n.relevance) GROUP BY 1),
    ranked AS (SELECT f.*, beaten.x IS NULL AS peak, count(*) OVER (PARTITION BY cluster_id) AS size,
        row_number() OVER (PARTITION BY cluster_id ORDER BY density DESC, relevance DESC NULLS LAST, f.node_id) AS place
        FROM found f JOIN degree d ON d.x = f.node_id LEFT JOIN best USING (node_id) LEFT JOIN beaten ON beaten.x = f.node_id)
SELECT cluster_id, any_value(size) AS size, count_if(peak)::BIGINT AS peaks, list(node_id ORDER BY place) FILTER (place <= 3) AS typical FROM ranked GROUP BY 1""",
        "p3_found": f"WITH RECURSIVE {_ALIKE} SELECT cluster_id, node_id FROM found",
    }


def __getattr__(name: str):
    """ORACLES is made when it is first asked for: it takes a second to go through all code points."""
    if name != "ORACLES":
        raise AttributeError(name)
    globals()["ORACLES"] = found = _oracles()
    return found
