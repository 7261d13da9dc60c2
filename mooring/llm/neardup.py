"""Near-duplicate texts: a byte-position inverted index with count filtering.

A text is the set of its distinct neighbouring word pairs.  Every word pair is hashed
to a *positional byte*: 56 bits of the hash are a position in one very long, sparse byte
string, the other 8 the byte stored there.  Two texts that share a word pair hold the same
byte at the same position, so the number of shared positional bytes is the number of
shared word pairs, unless two word pairs of a pair of texts hash alike (a chance of about
2^-64 for each two).  The inverted index has a list for every (position, byte).

With sizes a and b, a similarity of at least t needs ``need = ceil(t/(1+t)*(a+b))``
shared positional bytes.  That guaranteed minimum drives every step, and none of them
can lose a pair that reaches it:

* index: a text's bytes are ordered, rare ones first (by a count sketch over the whole
  table; any one order is right, a good one is fast).  Of two texts that share ``need``
  bytes, the smaller has one among its first ``a-ceil(2t/(1+t)*a)+1`` and the larger has
  it among its first ``b-ceil(t*b)+1``; only those are indexed and looked up;
* count: at a hit, neither more bytes than follow it in the order nor more than the two
  texts' 128-bit occupancy maps allow can still be shared; pairs below ``need`` go.
  The hits of the others are tallied, and the tally plus what may follow the last hit
  must reach ``need``;
* verify: the surviving pairs' whole sets are intersected.

Equal texts, by 128-bit hashes, are one class from the start and are never paired with each
other in the index, however many there are.  A list that the sketch says may be longer than
LIST_TEXTS is split: each of its parts holds all of its texts, but looks up only its own
share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.llm.components import connected_components
from mooring.shared import broadcast_array, materialise

#: White space and ASCII punctuation, between which the words of a text lie (fixed values).
SEPARATORS = r"[\s\x1c-\x1f\x85\p{Z}!-/:-@\[-`{-~]+"
#: Texts of one list of the index that are looked up in one part of it.
LIST_TEXTS = 4096
#: Floating point must not raise a bound above an exact threshold.
EPS = 1e-9


def word_pairs(text: Column) -> Column:
    """The positional bytes of the distinct ordered pairs of neighbouring words, as position
    times 256 plus byte, in order of their values."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
    return F.array_sort(F.array_distinct(F.filter(pairs, lambda h: h.isNotNull())))


def _sketch(sets: DataFrame) -> np.ndarray:
    """How often the positional bytes of each of 2^16 to 2^22 buckets occur, over all texts.
    The width follows the table's size up to 2^22 (16 MB), so what is broadcast is bounded."""
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.size("slots"))).first()[0] or 0
    width = 1 << int(np.clip(np.ceil(np.log2(max(total, 1) / 16)), 16, 22))
    counts = sets.select(F.explode("slots").alias("s")).groupBy(F.expr(f"cast(s & {width - 1} as int)").alias("bucket")).count()
    table = np.zeros(width, np.uint32)
    for batch in _batches(counts.select("bucket", F.least("count", F.lit(2**32 - 1)).alias("n"))):
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return broadcast_array(spark, table)


def _batches(df: DataFrame) -> list[pa.RecordBatch]:
    return df.toArrow().to_batches()


def _postings(rank, t: float):
    """The indexed part of every text, made of whole batches by array operations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rank.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("slots")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            slot = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((slot, counts[slot & (len(counts) - 1)], row))
            slot, start = slot[order], np.cumsum(size) - size
            pos = np.arange(len(slot)) - start[row]
            mixed = (slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
            bit = np.uint64(1) << (mixed & np.uint64(63))
            full = size > 0
            maps = [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
            for half in (0, 1):
                maps[half][full] = np.bitwise_or.reduceat(np.where((mixed >> np.uint64(6)) == half, bit, np.uint64(0)), start[full]) if len(slot) else 0
            lookup = size - np.ceil(t * size - EPS).astype(np.int64) + 1
            index = size - np.ceil(2 * t / (1 + t) * size - EPS).astype(np.int64) + 1
            keep = np.flatnonzero(pos < lookup[row])
            # a long list has several parts; a text is in all of them and looked up by one
            parts = 1 + counts[slot[keep] & (len(counts) - 1)].astype(np.int64) // LIST_TEXTS
            ids = batch.column("rep").to_numpy()
            own = (ids[row[keep]] % parts)
            keep, own = np.repeat(keep, parts), np.repeat(own, parts)
            part = np.arange(len(keep)) - np.repeat(np.cumsum(parts) - parts, parts)
            r = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[keep] >> 8), pa.array((slot[keep] & 255).astype(np.uint8).view(np.int8)), pa.array(part.astype(np.int32)), pa.array(ids[r]), pa.array(size[r].astype(np.int32)),
                 pa.array(pos[keep].astype(np.int32)), pa.array((pos[keep] < index[r]) & (part == own)), pa.array(maps[0][r].view(np.int64)), pa.array(maps[1][r].view(np.int64))],
                names=["position", "byte", "part", "rep", "size", "pos", "indexed", "map0", "map1"])

    return run


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (rep_a < rep_b, shared, either) of rows of ``sets`` (rep long, slots array<long>
    of distinct values, itself a table that may be read again) that share ``threshold``."""
    t = threshold
    rank = _sketch(sets)
    postings = sets.mapInArrow(
        _postings(rank, t), "position long, byte byte, part int, rep long, size int, pos int, indexed boolean, map0 long, map1 long")
    # a hot list is in parts already; the indexed side ships its own, fewer rows
    a, b = postings.alias("a"), postings.alias("b")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("a.size") + F.col("b.size")) - F.lit(EPS))
    rest = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    apart = F.bit_count(F.col("a.map0").bitwiseXOR(F.col("b.map0"))) + F.bit_count(F.col("a.map1").bitwiseXOR(F.col("b.map1")))
    hits = a.join(
        b,
        (F.col("a.position") == F.col("b.position")) & (F.col("a.byte") == F.col("b.byte")) & (F.col("a.part") == F.col("b.part")) & F.col("a.indexed")
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.rep") < F.col("b.rep"))))
        & (rest >= need) & (apart <= F.col("a.size") + F.col("b.size") - 2 * need)
        & (F.col("a.size") >= F.lit(t) * F.col("b.size") - F.lit(EPS)),
    )
    # a.pos < index length counts only hits that the smaller text's indexed part holds, so
    # what may follow starts at that part's last hit
    tally = hits.groupBy(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).agg(
        F.count("*").alias("hits"), F.min(need).alias("need"),
        F.min(F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))).alias("after"))
    pairs = tally.where("hits + after - 1 >= need").select("x", "y")
    left = sets.select(F.col("rep").alias("x"), F.col("slots").alias("xs"))
    right = sets.select(F.col("rep").alias("y"), F.col("slots").alias("ys"))
    checked = (pairs.join(left, "x").join(right, "y")
               .withColumn("shared", F.size(F.array_intersect("xs", "ys")))
               .withColumn("either", F.size("xs") + F.size("ys") - F.col("shared")))
    return checked.where(F.col("shared") >= F.lit(t) * F.col("either") - F.lit(EPS)).select(
        F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "shared", "either")


def text_classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets), both written tables: members has each distinct (id, rep), sets one
    row (rep, slots) per distinct text of at least two words, numbered by rep.  Texts are
    told apart by 128 bits."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("txt")).where("id is not null and txt is not null")
    hashed = rows.withColumns({"h": F.xxhash64("txt"), "g": F.xxhash64(F.lit(1), "txt")})
    # only hashes are shuffled with the ids; each text is shuffled once per task that holds it
    texts = hashed.select("h", "g", "txt").dropDuplicates(["h", "g"])
    sets = texts.select("h", "g", F.monotonically_increasing_id().alias("rep"), word_pairs(F.col("txt")).alias("slots"))
    sets = materialise(sets.where(F.size("slots") > 0), "sets")
    members = hashed.select("id", "h", "g").distinct().join(sets.select("h", "g", "rep"), ["h", "g"]).select("id", "rep")
    return materialise(members, "members"), sets.select("rep", "slots")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.6) -> DataFrame:
    """All pairs (id_a < id_b) of distinct ids whose texts share ``threshold`` of their word
    pairs: those in both over those in either.

    Null ids and texts and texts of fewer than two words take no part.  An id with several
    texts pairs if any of them does.  Equal texts pair with each other.  Repeated rows
    count once; an empty table gives no rows; other columns are ignored.
    """
    members, sets = text_classes(df, key, text)
    similar = similar_sets(sets, threshold).select("rep_a", "rep_b")
    across = (similar.join(members.select(F.col("id").alias("i"), F.col("rep").alias("rep_a")), "rep_a")
              .join(members.select(F.col("id").alias("j"), F.col("rep").alias("rep_b")), "rep_b"))
    # pairs within a class are wanted only here, where ids are the result
    several = members.groupBy("rep").count().where("count > 1").select("rep")
    same = members.join(several, "rep", "left_semi")
    within = same.select("rep", F.col("id").alias("i")).join(same.select("rep", F.col("id").alias("j")), "rep").where("i < j")
    both = across.select("i", "j").unionByName(within.select("i", "j")).where("i <> j")
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.6) -> DataFrame:
    """One row (group_id, id, links) per id with a text: ids that are connected, step by step,
    by near-duplicate pairs share a group, named by its smallest id.  links counts the
    classes of equal texts that the id's own class is similar to.  Cases as for the pairs;
    an id without a partner is a group of its own, one without two words is left out.
    No pairs within a class are made."""
    members, sets = text_classes(df, key, text)
    similar = materialise(similar_sets(sets, threshold).select("rep_a", "rep_b"), "similar")
    degree = similar.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    # ids with several texts connect their classes
    first = members.groupBy("id").agg(F.min("rep").alias("rep0"))
    bridges = members.join(first, "id").where("rep <> rep0").select(F.col("rep0").alias("rep_a"), F.col("rep").alias("rep_b"))
    comp = connected_components(similar.unionByName(bridges), "rep_a", "rep_b")
    labelled = (members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
                .join(degree, "rep", "left")
                .select("id", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    per_id = labelled.groupBy("id").agg(F.min("component").alias("component"), F.sum("links").alias("links"))
    names = per_id.groupBy("component").agg(F.min("id").alias("group_id"))
    return per_id.join(names, "component").select("group_id", "id", "links")
