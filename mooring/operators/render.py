"""Contexts: which nodes are shown around the anchors, under node and token budgets.

An order names every node's turn: anchors first, then the renderer's picks, then the
rest by score.  A fold takes them in that order, passing over nodes that don't fit (later,
cheaper ones still may) and never refusing an anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.operators import anchors as A


def turn_order(renderer: str, anchors, d: np.ndarray, rho: np.ndarray, evidence: int = 2, gamma: float = 0.0) -> list[int]:
    """Node indices in the order in which a renderer offers them (kernel form)."""
    chosen = list(dict.fromkeys(int(a) for a in anchors))
    if not chosen or renderer == "anchor_only":
        return chosen
    n, idx = len(rho), np.arange(len(rho))
    to = d[:, chosen]
    cell, near, mass = to.argmin(1), to.min(1), np.round(rho, A.DECIDE)
    picks: list[int] = []
    if renderer in ("nearest", "old"):
        for col in to.T:
            pool = idx
            if renderer == "old":
                pool = np.argsort(col, kind="stable")[:max(4 * evidence, evidence + 1)]
            order = pool[np.lexsort((pool, -mass[pool], col[pool]))]
            picks += order[:evidence + 1].tolist()
    elif renderer == "cell_top_rho":
        for pos in range(len(chosen)):
            rows = np.flatnonzero(cell == pos)
            if len(rows):
                picks.append(int(rows[np.lexsort((rows, near[rows], -mass[rows]))[0]]))
    elif renderer != "global_top_rho":
        raise ValueError(f"unknown renderer {renderer!r}")
    fill = np.lexsort((np.arange(n), near, -mass, -np.round(rho - gamma * near, A.DECIDE)))
    return list(dict.fromkeys([*chosen, *picks, *fill.tolist()]))


def take(order, anchors, tokens, max_tokens: int, max_nodes: int | None) -> list[int]:
    """The fold (kernel form); no node limit if ``max_nodes`` is 0 or None."""
    forced, out, used = {int(a) for a in anchors}, [], 0
    for i in order:
        size = max(1, int(tokens[i]))
        if i in forced or ((not max_nodes or len(out) < max_nodes) and used + size <= max_tokens):
            out.append(int(i))
            used += size
    return out


def fold(turns: Column, max_tokens: int, max_nodes: int | None) -> Column:
    """The fold over an ordered array of struct(idx, tokens, forced, node_id), as
    struct(ids, used): relational form."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, t: Column) -> Column:
        fits = s["used"] + t["tokens"] <= max_tokens
        if max_nodes:
            fits = fits & (F.size(s["ids"]) < max_nodes)
        return F.when(t["forced"] | fits, F.struct(F.concat(s["ids"], F.array(t["node_id"])).alias("ids"), (s["used"] + t["tokens"]).alias("used"))).otherwise(s)

    return F.aggregate(turns, start, step)


def turns(rows: DataFrame, renderer: str, evidence: int = 2, gamma: float = 0.0) -> DataFrame:
    """(query_id, idx, step): every node's turn under a renderer; ``rows`` are anchored."""
    first = rows.select("query_id", F.explode("anchors").alias("a")).select("query_id", F.col("a.idx").alias("idx"), F.col("a.pos").alias("pos")).distinct()
    parts = [first.select("query_id", "idx", F.struct(F.lit(0).alias("phase"), F.col("pos").alias("pos"), F.lit(0).cast("long").alias("place")).alias("step"))]
    picks = {"cell_top_rho": lambda: A.cell_best(rows).withColumn("place", F.lit(0).cast("long")),
             "nearest": lambda: A.nearest_per_anchor(rows, evidence + 1), "old": lambda: A.nearest_in_window(rows, evidence)}
    if renderer in picks:
        parts.append(picks[renderer]().select("query_id", "idx", F.struct(F.lit(1).alias("phase"), "pos", "place").alias("step")))
    if renderer != "anchor_only":
        parts.append(rows.select("query_id", "idx", F.struct(F.lit(2).alias("phase"), F.lit(0).cast("long").alias("pos"), A.fill_place(gamma).cast("long").alias("place")).alias("step")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "idx").agg(F.min("step").alias("step"))


def contexts(rows: DataFrame, renderer: str, max_tokens: int, max_nodes: int | None, evidence: int = 2, gamma: float = 0.0) -> DataFrame:
    """(query_id, context_node_ids, tokens): relational form of turn_order and take.  One array
    per query holds its turns; the universe's cap bounds it."""
    order = turns(rows, renderer, evidence, gamma)
    named = order.join(rows.select("query_id", "idx", "node_id", "tokens"), ["query_id", "idx"])
    lists = named.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("step", "idx", "tokens", (F.col("step.phase") == 0).alias("forced"), "node_id"))).alias("turns"))
    return lists.select("query_id", fold(F.col("turns"), max_tokens, max_nodes).alias("c")).select(
        "query_id", F.col("c.ids").alias("context_node_ids"), F.col("c.used").alias("tokens"))


def context_text(nodes: Column) -> Column:
    """Blocks of rank, title (or id), id and text of an array of struct(node_id, title, text)."""
    def block(n: Column, i: Column) -> Column:
        title = F.when(F.coalesce(n["title"], F.lit("")) != "", n["title"]).otherwise(n["node_id"])
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), title, F.lit("\nnode_id: "), n["node_id"], F.lit("\n"), F.coalesce(n["text"], F.lit("")))

    return F.array_join(F.transform(nodes, block), "\n\n")
