"""Filling containers of fixed capacity by lexical retrieval.

Documents are put into shards of bounded size, lexically close ones together: a range
partitioning by two hashed-minimum words and the id, cut into shards of SHARD_DOCS.  Each
shard has a BM25 inverted index over its tokenizer's tokens; document frequencies and lengths are those
of the whole table.  A container is opened with the largest unused document as its seed; the
index returns the seed's unused neighbours, best first, and those that still fit are
taken; what room is left goes to the largest unused documents that fit.  A document
larger than the capacity fills containers of its own and its remainder is packed like a
document.  Shards are independent, so work grows in proportion to the table.

Texts with many copies are spread over all shards, so no shard holds copies only.  Then
the room left anywhere is offered to documents of anywhere: containers are mixed at random
into larger groups, and one whose documents all fit into the room that others of its group
have left is dissolved, those of small documents first.  Rounds with other mixtures follow
until fill stops rising; what comes out of the index together otherwise stays together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.tokens import TOKENIZERS, encoding
from mooring.shared import broadcast_array, materialise, release

#: Documents of one shard, and of one range partition, which is cut into shards.
SHARD_DOCS, RANGE_DOCS = 1500, 12_000
#: Documents of one group of containers that share their room in a round, and the part of the
#: containers that a round must dissolve for another to follow.
MIX_DOCS, RISE = 50_000, 1e-4
#: One document in so many makes a term's list long.
OFTEN = 32
#: BM25's usual parameters.
K1, B = 1.2, 0.75


def _mixed(n: int, seed: int) -> np.ndarray:
    """A fixed random 64-bit number for each of n terms."""
    return np.random.default_rng((7, seed)).integers(np.iinfo(np.int64).min, np.iinfo(np.int64).max, n)


def encoded(rows: DataFrame, folder: str) -> DataFrame:
    """(id, tokens, near, nearer) for ``rows`` (id, txt): every text is tokenised once, its
    tokens kept as whole numbers of 2 or 4 bytes; near and nearer are hashed minima over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoding(folder)
        kind, hashes = _kind(words.n_vocab), [_mixed(words.n_vocab, s) for s in (1, 2)]
        for batch in batches:
            if not batch.num_rows:
                continue
            each = [np.array(words.encode_ordinary(t), kind) for t in batch.column("txt").to_pylist()]
            start = np.cumsum([0, *map(len, each)])
            flat = np.concatenate(each)
            low = [np.minimum.reduceat(h[flat], start[:-1]) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t.tobytes() for t in each], pa.binary()), *map(pa.array, low)], names=["id", "tokens", "near", "nearer"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tokens binary, near long, nearer long")


def _kind(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _read(tokens: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of them, and each row's number of them."""
    length = np.fromiter((len(t) for t in tokens.to_pylist()), np.int64, len(tokens)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(tokens.to_pylist()), kind), length


def _postings(term: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences), by term and document, of documents' terms in a row.  The
    stable sort of small numbers is a radix sort."""
    order = np.argsort(term, kind="stable")
    term, doc = term[order], np.repeat(np.arange(len(length)), length)[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
    return term[first], doc[first], np.diff(np.r_[first, len(term)])


def _frequencies(table: DataFrame, vocabulary: int) -> tuple[np.ndarray, float, int]:
    """Documents per term, mean length in terms and number of documents, over all rows."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            flat, lengths = _read(batch.column(0), kind)
            term, _, _ = _postings(flat, lengths)
            seen += np.bincount(term, minlength=vocabulary)
            docs, length = docs + len(lengths), length + len(flat)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[seen[at], docs, length])], names=["term", "n"])

    sums = dict(map(tuple, table.select("tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()))  # the vocabulary at most
    docs, length = sums.pop(-1, 0), sums.pop(-2, 0)
    found = np.zeros(vocabulary, np.float32)
    found[list(sums)] = list(sums.values())
    return found, length / max(1, docs), docs


class Index:
    """A shard's BM25 inverted index over the terms of its documents: all of them in a row, and
    each document's number.  ``frequency`` is the documents per term, ``mean`` the mean length
    and ``docs`` the number of documents of the whole table."""

    def __init__(self, term: np.ndarray, length: np.ndarray, frequency: np.ndarray, mean: float, docs: int):
        self.n = len(length)
        term, self.doc, tf = _postings(term, length)
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.start = np.r_[starts, len(term)]
        size = np.diff(self.start)
        code = np.repeat(np.arange(len(size)), size)
        df = frequency[term]
        self.weight = np.log1p((docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(mean, 1e-9)))
        # the lists of terms that many documents have are rows of a matrix
        often = size >= max(2, self.n // OFTEN)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.often = np.zeros((int(often.sum()), self.n), np.float32)
        held = often[code]
        self.often[self.row[code[held]], self.doc[held]] = self.weight[held]
        by_doc = np.argsort(self.doc, kind="stable")
        self.of = np.split(code[by_doc], np.cumsum(np.bincount(self.doc, minlength=self.n))[:-1]) if self.n else []
        self.known: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for the seed's terms; plans share them."""
        if seed not in self.known:
            row = self.row[self.of[seed]]
            t = self.of[seed][row < 0]
            size = self.start[t + 1] - self.start[t]
            at = np.repeat(self.start[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rare = np.bincount(self.doc[at], self.weight[at], self.n)
            self.known[seed] = (rare + self.often[row[row >= 0]].sum(0)).astype(np.float32)
        return self.known[seed]


class _Unused:
    """Documents by ascending size; the largest unused one at or below a place is found by
    following pointers past used ones."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.lexsort((np.arange(len(sizes)), sizes))
        self.order = self.order[sizes[self.order] > 0]
        self.place = np.zeros(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.sizes = sizes[self.order].tolist()
        self.down, self.bottom = list(range(len(self.sizes))), 0
        self.free = sizes > 0

    def largest(self, room: int) -> int:
        """The place of the largest unused document of at most ``room``, the last of that size, or -1."""
        at = bisect_right(self.sizes, room) - 1
        path = []
        while at >= 0 and self.down[at] != at:
            path.append(at)
            at = self.down[at]
        for p in path:
            self.down[p] = at
        return at

    def use(self, doc: int) -> None:
        p = int(self.place[doc])
        self.down[p], self.free[doc] = p - 1, False
        while self.bottom < len(self.sizes) and self.down[self.bottom] != self.bottom:
            self.bottom += 1

    def smallest(self) -> float:
        return self.sizes[self.bottom] if self.bottom < len(self.sizes) else float("inf")


def fill(sizes: np.ndarray, capacity: int, index: Index) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (document, piece, tokens), for documents of at least one token."""
    full: list[list[tuple[int, int, int]]] = []
    rest, piece = sizes.copy(), np.zeros(len(sizes), np.int64)
    for d in np.flatnonzero(sizes > capacity).tolist():
        while rest[d] > capacity:
            full.append([(d, int(piece[d]), capacity)])
            rest[d] -= capacity
            piece[d] += 1
    left = _Unused(rest)
    while (top := left.largest(capacity)) >= 0:
        seed = int(left.order[top])
        left.use(seed)
        box, room = [seed], capacity - int(rest[seed])
        if room >= left.smallest():
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & left.free & (rest <= room))
            for d in near[np.argsort(-score[near], kind="stable")].tolist():
                if rest[d] <= room:
                    box.append(d)
                    left.use(d)
                    room -= int(rest[d])
                    if room < left.smallest():
                        break
        while room >= left.smallest():
            d = int(left.order[left.largest(room)])
            box.append(d)
            left.use(d)
            room -= int(rest[d])
        full.append([(d, int(piece[d]), int(rest[d])) for d in box])
    return full


def dissolve(box: np.ndarray, tokens: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each document after those were dissolved whose documents all fit into
    the room of others; documents go where the least room remains."""
    order = np.lexsort((-tokens, box))
    cuts = np.r_[0, np.cumsum(np.bincount(box))]
    used, out = np.bincount(box, tokens).astype(np.int64), box.copy()
    room = (capacity - used).tolist()
    largest = tokens[order[cuts[:-1]]]
    rooms = sorted((r, b) for b, r in enumerate(room) if r > 0)
    free, fed = sum(r for r, _ in rooms), np.zeros(len(used), bool)
    for b in np.lexsort((used, largest)).tolist():
        if fed[b] or not rooms or free - max(0, room[b]) < used[b]:
            continue
        if room[b] > 0:
            del rooms[bisect_left(rooms, (room[b], b))]
        moves: list[tuple[int, int, int]] = []
        for d in order[cuts[b]:cuts[b + 1]].tolist():
            size = int(tokens[d])
            at = bisect_left(rooms, (size, -1))
            if at == len(rooms):
                break
            r, to = rooms.pop(at)
            moves.append((d, to, size))
            room[to] = r - size
            if room[to]:
                insort(rooms, (room[to], to))
        if len(moves) == cuts[b + 1] - cuts[b]:
            free -= max(0, room[b]) + int(used[b])
            for d, to, _ in moves:
                out[d], fed[to] = to, True
            continue
        for d, to, size in reversed(moves):
            if room[to]:
                del rooms[bisect_left(rooms, (room[to], to))]
            room[to] += size
            insort(rooms, (room[to], to))
        if room[b] > 0:
            insort(rooms, (room[b], b))
    return out


def refill(packed: DataFrame, capacities: list[tuple]) -> DataFrame:
    """``packed`` with fewer containers, a written table: rounds of ``dissolve`` over groups
    of MIX_DOCS documents, mixed anew each time.  A container of more documents than a group
    takes no part."""
    spark, now, last, number = packed.sparkSession, materialise(packed, "packed"), None, 0
    of = {plan: capacity for plan, capacity in capacities}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, box = np.unique(table.column("container_id").to_numpy(), return_inverse=True)
        tokens, keep = table.column("tokens").to_numpy(), key[1].as_py() < 0
        after = box if keep else dissolve(box, tokens, of[key[0].as_py()])
        table = table.drop_columns(["part"])
        return table.set_column(table.schema.get_field_index("container_id"), "container_id", pa.array(names[after], pa.string()))

    while True:
        boxes = now.groupBy("plan_id", "container_id").agg(F.count("*").alias("n"))
        sums = boxes.groupBy("plan_id").agg(F.count("*").alias("boxes"), F.sum("n").alias("n"), F.max("n").alias("most")).collect()
        total = sum(r["boxes"] for r in sums)
        if not total or last is not None and last - total <= RISE * last:
            return now
        last, number = total, number + 1
        parts = spark.createDataFrame([(r["plan_id"], -(-r["n"] // MIX_DOCS)) for r in sums], "plan string, parts long")
        mixed = now.join(F.broadcast(parts), F.col("plan_id").eqNullSafe(F.col("plan")))
        part = F.pmod(F.xxhash64("container_id", F.lit(number)), F.col("parts"))
        if any(r["most"] > MIX_DOCS for r in sums):
            large = boxes.where(F.col("n") > MIX_DOCS).select("plan_id", "container_id", F.lit(True).alias("large"))
            mixed = mixed.join(large, ["plan_id", "container_id"], "left")
            part = F.when(F.col("large"), F.lit(-1) - F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(part)
        rows = mixed.select("plan_id", "container_id", "id", "piece", "tokens", part.alias("part"))
        was, now = now, materialise(rows.groupBy("plan_id", "part").applyInArrow(run, packed.schema), "packed")
        release(was)


def pack(docs: DataFrame, plans: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(plan_id, container_id, id, piece, tokens) for ``plans`` (plan_id, capacity_tokens).

    Every text of at least one token comes out once in every plan, or in pieces 0, 1, ...
    if it alone is larger than the capacity; pieces but the last are full.  Null and empty
    texts, null ids, and plans with a null or non-positive capacity give no rows.  Repeated
    rows are packed separately; equal sizes go by the shard's order.  ``plans`` must be
    small (at most 10,000 rows).
    """
    spark = docs.sparkSession
    capacities = [tuple(r) for r in plans.select("plan_id", F.col("capacity_tokens").cast("long")).where("capacity_tokens > 0").limit(10_001).collect()]
    if len(capacities) > 10_000:
        raise ValueError("plans must be a small table")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("txt")).where("id is not null and txt <> ''")
    id_type = rows.schema["id"].dataType.simpleString()
    vocabulary = encoding(folder).n_vocab
    keyed = materialise(encoded(rows, folder), "keyed")
    frequency, mean, n = _frequencies(keyed, vocabulary)
    table = broadcast_array(spark, frequency)
    copies = keyed.groupBy(F.xxhash64("tokens").alias("same")).count().where(F.col("count") > SHARD_DOCS // 4).select("same", F.lit(True).alias("copied"))
    if not copies.isEmpty():
        # copies get random places among the other texts, evenly between quantiles of theirs
        keyed = keyed.withColumn("same", F.xxhash64("tokens")).join(copies, "same", "left")
        steps = [k / 1000 for k in range(1001)]
        at = keyed.where("copied is null").agg(F.percentile_approx("near", steps, 10_000)).first()[0]
        if at:
            spread, k = F.array(*map(F.lit, at)), (F.rand(1) * 1000).cast("int")
            keyed = keyed.withColumn("k", F.when(F.col("copied"), k)).withColumn("near", F.when(F.col("copied"), (
                spread[F.col("k")] + F.rand(2) * (spread[F.col("k") + 1].cast("double") - spread[F.col("k")])).cast("long")).otherwise(F.col("near")))
    placed = (keyed.repartitionByRange(max(1, -(-n // RANGE_DOCS)), "near", "nearer", "id")
              .sortWithinPartitions("near", "nearer", "id").select("id", "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def packed(docs: pa.Table) -> pa.RecordBatch:
            flat, sizes = _read(docs["tokens"], _kind(vocabulary))
            index, ids = Index(flat, sizes, table.value, mean, n), docs["id"].combine_chunks()
            out: tuple[list, ...] = ([], [], [], [], [])
            for plan, capacity in capacities:
                for number, box in enumerate(fill(sizes, capacity, index)):
                    for d, piece, tokens in box:
                        for column, value in zip(out, (plan, f"{task}-{shard}-{number}", d, piece, tokens)):
                            column.append(value)
            plan, box, doc, piece, tokens = (pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())))
            return pa.RecordBatch.from_arrays([plan, box, ids.take(doc), piece, tokens], names=["plan_id", "container_id", "id", "piece", "tokens"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= SHARD_DOCS:
                docs = pa.Table.from_batches(held)
                yield packed(docs.slice(0, SHARD_DOCS))
                held, rows, shard = docs.slice(SHARD_DOCS).to_batches(), rows - SHARD_DOCS, shard + 1
        if rows:
            yield packed(pa.Table.from_batches(held))

    first = placed.mapInArrow(run, f"plan_id string, container_id string, id {id_type}, piece int, tokens long")
    return refill(first, capacities)


def packing_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: containers, their fill in percent of the capacity, whole documents, split ones."""
    boxes = packed.groupBy("plan_id").agg(
        F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.countDistinct("id").alias("documents"),
        F.countDistinct(F.when(F.col("piece") > 0, F.col("id"))).alias("split"))
    room = F.col("containers") * F.col("capacity_tokens")
    return boxes.join(F.broadcast(plans), "plan_id").select("plan_id", "capacity_tokens", "containers", "documents", "split", "tokens", (F.col("tokens") / room * 100).alias("fill_percent"))
