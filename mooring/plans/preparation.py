"""Raw questions and corpus to examples: answers, TF-IDF candidates, gold alignment, merge."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.functions.text import word_count
from mooring.shared import materialise
from mooring.sources.records import with_ordinal


class RawDataError(ValueError):
    """Raw questions or documents that can't be made into examples."""


#: English function words that carry no weight: a default, every function takes another list.
STOP_WORDS = tuple((
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each else every few for from further had has have having he her here hers him his how i if in into is it its itself just least "
    "less many may me might more most much must my no nor not now of off on once only or other our out over own per same she should since so some such "
    "than that the their them then there these they this those through to too under until up upon us very was we were what when where which while who "
    "whom whose why will with within without would yet you your"
).split())


#: Accented Latin letters and their base letters, by Unicode's decompositions.
ACCENTED = "".join(c for c in map(chr, range(0xE0, 0x250)) if c.islower() and unicodedata.normalize("NFD", c) != c)
BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def listed(x: Column) -> Column:
    """A JSON list's elements, or the bare value, as an array of strings; null and empty give none."""
    parsed = F.when(x.rlike(r"^\s*\["), F.from_json(x, "array<string>"))
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(x)))


def answers(qa: DataFrame) -> DataFrame:
    """``qa`` with ``answer`` (the first given of answer, obj, target, final_answer, else the
    first possible answer) and ``answers`` (it, obj and the possible ones, each once, in order)."""
    given = [F.col(c) for c in ("answer", "obj", "target", "final_answer") if c in qa.columns]
    possible = listed(F.col("possible_answers"))
    first = F.coalesce(*(blank_to_null(g) for g in given), blank_to_null(F.try_element_at(possible, F.lit(1))))
    every = F.concat(F.array(first, F.col("obj") if "obj" in qa.columns else F.lit(None).cast("string")), possible)
    return qa.withColumns({"answer": first, "answers": F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))})


def corpus_documents(corpus: DataFrame) -> DataFrame:
    """(doc, node_id, title, text): one row per node id, the one added first; rows with
    neither title nor text and null ids are left out."""
    rows = corpus.where("node_id is not null").select(
        "node_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "added_at").where("title <> '' or text <> ''")
    best = rows.groupBy("node_id").agg(F.min(F.struct("added_at", "title", "text")).alias("r"))
    return best.select("node_id", "r.title", "r.text")


def gold_alignment(qa: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, pos, node_id, how): each supporting paragraph's document: the smallest id with its
    exact title and text, else the smallest with its title, else none (``missing``)."""
    support = (qa.select("id", F.posexplode("paragraphs").alias("pos", "p")).where("id is not null and p.is_supporting")
               .select("id", F.col("pos").cast("long").alias("pos"), F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.text", F.lit("")).alias("text")))
    # one row per key on the other side, so a hot title can't multiply rows, and the join may split it
    exact = docs.groupBy("title", F.xxhash64("text").alias("h"), "text").agg(F.min("node_id").alias("exact")).drop("h")
    titled = docs.groupBy("title").agg(F.min("node_id").alias("titled"))
    joined = support.join(exact, ["title", "text"], "left").join(titled, "title", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("titled").isNotNull(), "title").otherwise("missing")
    return joined.select("id", "pos", F.coalesce("exact", "titled").alias("node_id"), how.alias("how"))


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words of two or more characters without accents or stop words, and their
    neighbouring pairs."""
    folded = F.translate(F.lower(text), ACCENTED, BASE)
    words = F.filter(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    pairs = F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(words, pairs)


def tfidf(texts: DataFrame, key: str, text: str, max_features: int | None = None) -> DataFrame:
    """(key, term, number, w): smooth TF-IDF, ln((1+n)/(1+df))+1 times the count, rows of length
    1; number is the term's own.  ``max_features`` keeps the most frequent terms, the smaller
    one on ties."""
    rows = texts.select(F.col(key).alias("key"), F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    counts = materialise(rows.groupBy("key", "term").agg(F.count("*").alias("tf")), "terms")
    n = texts.count()
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    df = materialise(df.select("term", "df", F.monotonically_increasing_id().alias("number")), "vocabulary")
    weighted = counts.join(df, "term").select("key", "term", "number", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return weighted.select("key", "term", "number", (F.col("w") / norm).alias("w"))


#: Postings of the documents and of the questions that meet in one task.
DOC_POSTINGS, QUESTION_POSTINGS = 4_000_000, 2_000_000


def _block_top(n: int):
    """The n best documents of a block for every question of a block, and all that tie with the
    last: postings of a question's terms are added up in one array over the block's documents."""
    import numpy as np
    import pandas as pd

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(d):
            docs, doc = np.unique(d["d"].to_numpy(), return_inverse=True)
            terms, term = np.unique(d["termcode"].to_numpy(), return_inverse=True)
            order = np.argsort(term, kind="stable")
            start = np.searchsorted(term[order], np.arange(len(terms) + 1))
            doc, weight = doc[order], d["wd"].to_numpy()[order]
            q = q.sort_values(["q", "qterm"])
            at = np.minimum(np.searchsorted(terms, q["qterm"].to_numpy()), len(terms) - 1)
            known = terms[at] == q["qterm"].to_numpy()
            asked, wq = q["q"].to_numpy(), q["wq"].to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]), len(asked)]
            for low, high in zip(cuts, cuts[1:]):
                here = np.arange(low, high)[known[low:high]]
                t = at[here]
                size = start[t + 1] - start[t]
                if not size.sum():
                    continue
                rows = np.repeat(start[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                sim = np.bincount(doc[rows], weight[rows] * np.repeat(wq[here], size), len(docs))
                seen = np.flatnonzero(sim > 0)
                rounded = np.round(sim[seen], 9)
                if len(seen) > n:
                    seen = seen[rounded >= np.partition(rounded, -n)[-n]]
                out.append((np.full(len(seen), asked[low]), docs[seen], sim[seen]))
        q, d, sim = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"q": q, "d": d, "sim": sim})

    return run


def tfidf_top(questions: DataFrame, docs: DataFrame, n: int, max_features: int | None = None) -> DataFrame:
    """(id, node_id, sim, place): the n documents of highest TF-IDF cosine for every question
    (one row an id; null ids are left out), fitted on both, equal ones by node_id.  Where fewer than n share a term with a question,
    those of smallest node_id follow with 0, so that every question has n or all documents.

    Blocks of questions meet blocks of documents' postings, and only each block's best leave
    it, so what is shuffled doesn't grow with the number of matching pairs.
    """
    # numbers stand for documents (even), questions (odd) and terms while postings are multiplied
    named = materialise(docs.select("node_id", "text", (F.monotonically_increasing_id() * 2).alias("d")), "named")
    asked = materialise(questions.where("id is not null").select("id", "question", (F.monotonically_increasing_id() * 2 + 1).alias("q")), "asked")
    both = named.select(F.col("d").alias("key"), "text").unionByName(asked.select(F.col("q").alias("key"), F.col("question").alias("text")))
    w = materialise(tfidf(both, "key", "text", max_features).select("key", "number", "w"), "tfidf")
    q = w.where("key % 2 = 1").select(F.col("key").alias("q"), F.col("number").alias("qterm"), F.col("w").alias("wq"))
    d = w.where("key % 2 = 0").select(F.col("key").alias("d"), F.col("number").alias("termcode"), F.col("w").alias("wd"))
    d = d.join(q.select(F.col("qterm").alias("asked")).distinct(), F.col("termcode") == F.col("asked"), "left_semi")
    sizes = dict(map(tuple, w.groupBy((F.col("key") % 2).alias("side")).count().collect()))
    nd, nq = max(8, -(-sizes.get(0, 0) // DOC_POSTINGS)), max(1, -(-sizes.get(1, 0) // QUESTION_POSTINGS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.select("q", "qterm", "wq", F.pmod(F.hash("q"), F.lit(nq)).cast("int").alias("qb"), every(nd).alias("db")).groupBy("qb", "db")
    right = d.select("d", "termcode", "wd", F.pmod(F.hash("d"), F.lit(nd)).cast("int").alias("db"), every(nq).alias("qb")).groupBy("qb", "db")
    sims = left.cogroup(right).applyInPandas(_block_top(n), "q long, d long, sim double")
    # ties at the cut are decided by node_id, so the n best and all that tie with the last go on to be named
    rounded = F.round("sim", 9)
    close = sims.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc(rounded)))).where(F.col("r") <= n).drop("r")
    named = close.join(asked.select("id", "q"), "q").join(named.select("node_id", "d"), "d")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(rounded), "node_id"))
    best = materialise(named.withColumn("place", place).where(F.col("place") <= n).select("id", "node_id", "sim", F.col("place").cast("long").alias("place")), "best")
    # a question lists n at most, so what fills it up is among the first 2 n documents
    first = docs.select("node_id").orderBy("node_id").limit(2 * n).agg(F.sort_array(F.collect_list("node_id")).alias("first"))
    listed = best.groupBy("id").agg(F.collect_list("node_id").alias("listed"))
    short = (asked.select("id").join(listed, "id", "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))
             .where(F.size("listed") < n).join(F.broadcast(first)))  # one row of 2 n ids
    more = short.select("id", F.size("listed").alias("have"), F.posexplode(F.slice(F.array_except("first", "listed"), F.lit(1), F.lit(n) - F.size("listed"))).alias("i", "node_id"))
    return best.unionByName(more.select("id", "node_id", F.lit(0.0).alias("sim"), (F.col("have") + F.col("i") + 1).cast("long").alias("place")))


def merged_universe(top: DataFrame, gold: DataFrame, cap: int) -> DataFrame:
    """(id, node_id, sim, is_gold, place): candidates and gold documents of every question, each
    once.  Over the cap, gold goes first and is never dropped, then the best others."""
    golds = gold.where("node_id is not null").select("id", "node_id").distinct().withColumn("is_gold", F.lit(True))
    rows = top.select("id", "node_id", "sim", "place").join(golds, ["id", "node_id"], "full").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    whole = Window.partitionBy("id")
    counts = rows.withColumns({"n": F.count("*").over(whole), "g": F.sum(F.col("is_gold").cast("int")).over(whole)})
    order = Window.partitionBy("id", "is_gold").orderBy(F.col("place").asc_nulls_last(), "node_id")
    keep = counts.withColumn("r", F.row_number().over(order)).where((F.col("n") <= cap) | F.col("is_gold") | (F.col("r") <= F.lit(cap) - F.col("g")))
    final = Window.partitionBy("id").orderBy(F.when(F.col("n") > cap, ~F.col("is_gold")).otherwise(F.lit(False)), F.col("place").asc_nulls_last(), "node_id")
    return keep.select("id", "node_id", "sim", "is_gold", (F.row_number().over(final) - 1).cast("long").alias("place"))


def prepare(qa: DataFrame, corpus: DataFrame, dataset: str, max_nodes: int = 600, vectors: DataFrame | None = None, max_features: int | None = 50_000) -> DataFrame:
    """Examples of the record format: one row per question with its nodes and gold ids.

    ``vectors`` (node_id, embedding) gives the nodes' embeddings; see latent_vectors.
    Questions with a null id are left out (``numbered`` gives raw ones their place); a null
    question counts as an empty one, whose candidates are the documents of smallest id.
    """
    docs = materialise(corpus_documents(corpus), "docs")
    asked = materialise(answers(qa.where("id is not null").dropDuplicates(["id"])), "qa")
    gold = materialise(gold_alignment(asked, docs), "gold")
    rows = merged_universe(tfidf_top(asked.select("id", "question"), docs, max_nodes, max_features), gold, max_nodes).join(docs, "node_id")
    rows = rows.join(vectors, "node_id", "left") if vectors is not None else rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    node = F.struct("place", "node_id", "text", F.lit("chunk").alias("node_type"), F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(1e-12)).alias("relevance"), "embedding",
                    word_count(F.col("text")).cast("int").alias("token_count"), F.lit(True).alias("is_anchor_candidate"),
                    F.struct("title", F.lit(None).cast("bigint").alias("corpus_index"), F.lit(dataset).alias("dataset")).alias("metadata"))
    nodes = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(node)), lambda s: s.dropFields("place")).alias("nodes"))
    golds = gold.where("node_id is not null").groupBy("id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"])).alias("gold_node_ids"))
    return (asked.join(nodes, "id").join(golds, "id", "left").select(
        F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"), "nodes", F.coalesce("gold_node_ids", F.array().cast("array<string>")).alias("gold_node_ids"), "answer",
        F.struct(F.lit(dataset).alias("dataset"), F.col("answers").alias("possible_answers"), F.col("id").alias("raw_id"), F.coalesce(F.size("gold_node_ids"), F.lit(0)).alias("num_gold_nodes")).alias("metadata")))


def prepared_summary(qa: DataFrame, docs: DataFrame, dataset: str, max_nodes: int, dim: int | None) -> dict:
    """Counts that describe a prepared set: its questions, documents, vectors' length, and
    supporting paragraphs with those that no document matches."""
    asked = qa.where("id is not null").dropDuplicates(["id"])
    gold = gold_alignment(asked, docs).agg(F.count("*").alias("total"), F.count_if(F.col("how") == "missing").alias("missing")).first()
    return {"dataset": dataset, "num_examples": asked.count(), "num_corpus_docs": docs.count(), "embedding_dim_actual": dim, "max_nodes_per_query": max_nodes,
            "total_support_paragraphs_seen": gold["total"], "missing_support_paragraphs": gold["missing"]}


#: Bytes of the block of vectors that a power iteration of latent_vectors broadcasts.
BASIS_BYTES = 512 << 20


def latent_vectors(docs: DataFrame, dim: int = 128, max_features: int | None = 50_000, seed: int = 13, questions: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """(node_id, embedding): rows of length 1 in the space of the largest ``dim`` singular
    vectors of the documents' TF-IDF matrix, found by subspace iteration over its sparse
    rows.  ``questions`` (question) take part in the terms and their weights.

    A document without any of the terms, or outside that space, gets a vector of zeros.  What is
    sent around in a round is max_features x (dim + 10) numbers and never a Gram matrix.
    """
    import numpy as np
    import pandas as pd

    from mooring.shared import broadcast_array

    texts = docs.select(F.concat(F.lit("d"), "node_id").alias("key"), "text")
    if questions is not None:
        texts = texts.unionByName(questions.select(F.concat(F.lit("q"), F.monotonically_increasing_id().cast("string")).alias("key"), F.col("question").alias("text")))
    w = materialise(tfidf(materialise(texts, "texts"), "key", "text", max_features), "tfidf")
    names = [r[0] for r in w.select("term").distinct().orderBy("term").collect()]  # at most max_features
    spark = docs.sparkSession
    codes = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(names)] or [("", 0)], "term string, j int"))
    rows = w.where("key like 'd%'").join(codes, "term").groupBy(F.substring("key", 2, 1 << 30).alias("node_id")).agg(F.collect_list(F.struct("j", "w")).alias("r"))
    rows = materialise(rows.select("node_id", F.col("r.j").alias("j"), F.col("r.w").alias("w")), "rows")
    n, width = len(names), max(1, min(dim, len(names) - 1, max(2, rows.count() - 1)))
    block = min(n, width + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(1, n), max(1, block))))[0]

    def image(basis):
        """The Gram matrix times the basis: rows times basis, then their transpose."""
        shared, columns = broadcast_array(spark, basis, BASIS_BYTES), basis.shape[1]

        def run(frames):
            out = np.zeros(shared.value.shape)
            for f in frames:
                for j, v in zip(f["j"], f["w"]):
                    j, v = np.asarray(j), np.asarray(v)
                    out[j] += v[:, None] * (v @ shared.value[j])
            at = np.flatnonzero(out.any(1))
            for low in range(0, len(at), 1000):
                yield pd.DataFrame({"j": at[low:low + 1000], "x": list(out[at[low:low + 1000]])})

        def add(f):
            j, at = np.unique(f["j"].to_numpy(), return_inverse=True)
            x = np.zeros((len(j), columns))
            np.add.at(x, at, np.stack(f["x"]))
            return pd.DataFrame({"j": j, "x": list(x)})

        parts = rows.select("j", "w").mapInPandas(run, "j long, x array<double>")
        sums = parts.groupBy((F.col("j") % 64).alias("part")).applyInPandas(add, "j long, x array<double>")
        got = sums.toPandas()
        y = np.zeros(basis.shape)
        if len(got):
            y[got["j"].to_numpy()] = np.stack(got["x"])
        shared.unpersist()
        return y

    for _ in range(rounds if n else 0):
        q = np.linalg.qr(image(q))[0]
    values, turn = np.linalg.eigh(q.T @ image(q)) if n else (np.zeros(1), np.eye(1))
    top = broadcast_array(spark, np.ascontiguousarray((q @ turn[:, ::-1])[:, :width]), BASIS_BYTES)

    def embed(frames):
        for f in frames:
            x = np.array([np.asarray(v) @ top.value[np.asarray(j)] if j is not None and len(j) else np.zeros(width) for j, v in zip(f["j"], f["w"])]).reshape(len(f), width)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"node_id": f["node_id"], "embedding": list(x / np.where(size > 0, size, 1))})

    return docs.select("node_id").join(rows, "node_id", "left").mapInPandas(embed, "node_id string, embedding array<double>")


def numbered(qa: DataFrame, corpus: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Raw question and corpus lists in the columns that the steps above expect, with their
    places ``ord``: aliases are resolved, a question without any id is named by its place,
    documents without ids ``dataset:doc:<place>``.  A question without text, a document
    without title and text, and an empty corpus are errors."""
    def either(df: DataFrame, *names: str) -> Column:
        return F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns), F.lit(None).cast("string"))

    if corpus.isEmpty():
        raise RawDataError("the corpus is empty")
    qa, corpus = with_ordinal(qa), with_ordinal(corpus)
    place = F.col("ord").cast("string")
    question = qa.withColumns({
        "id": F.coalesce(either(qa, "query_id", "qid", "id", "_id"), place),
        "question": F.coalesce(either(qa, "query", "question"), F.raise_error(F.concat(F.lit("no question in item "), place)).cast("string")),
        "possible_answers": F.to_json("possible_answers") if dict(qa.dtypes).get("possible_answers", "").startswith("array") else either(qa, "possible_answers")})
    title, text = either(corpus, "title"), F.coalesce(blank_to_null(either(corpus, "text")), either(corpus, "content"))
    void = (F.coalesce(title, F.lit("")) == "") & (F.coalesce(text, F.lit("")) == "")
    docs = corpus.withColumns({
        "node_id": F.when(void, F.raise_error(F.concat(F.lit("neither title nor text in document "), place)).cast("string")).otherwise(
            either(corpus, "node_id") if "node_id" in corpus.columns else F.concat(F.lit(f"{dataset}:doc:"), place)),
        "title": title, "text": text,
        "added_at": F.col("added_at") if "added_at" in corpus.columns else F.lit(None).cast("timestamp")})
    return question, docs
