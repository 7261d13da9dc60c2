"""Anchor search on one query's matrices: objective, exact and greedy search, refinement.

Everything here works on arrays of one candidate set, whose size the universe's cap
bounds; the plans call it once per query row inside Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np

#: What an objective must improve by to count.
MARGIN = 1e-12
#: Decimal places by which totals are compared, so that ties are ties in any engine.
DECIDE = 9


@dataclass(frozen=True)
class Problem:
    """A query's distances, relevance mass, token costs, and the weights of the penalties."""

    d: np.ndarray
    rho: np.ndarray
    cost: np.ndarray
    token_weight: float = 0.0
    anchor_penalty: float = 0.0

    def objective(self, anchors, rows=None) -> dict[str, float]:
        """Coverage, penalties and their total, over all nodes or only ``rows``."""
        a = np.asarray(anchors, int)
        if not len(a):
            return {"total": np.inf, "coverage": np.inf, "token_penalty": 0.0, "anchor_penalty": 0.0}
        if len(np.unique(a)) != len(a):
            raise ValueError("anchors must be distinct")
        if a.min() < 0 or a.max() >= len(self.rho):
            raise ValueError("anchor out of range")
        r = slice(None) if rows is None else np.asarray(rows, int)
        coverage = float(self.rho[r] @ self.d[r][:, a].min(1))
        tokens = float(self.token_weight * self.cost[a].sum()) if self.token_weight > 0 else 0.0
        size = self.anchor_penalty * len(a)
        return {"total": coverage + tokens + size, "coverage": coverage, "token_penalty": tokens, "anchor_penalty": size}


def assign(anchors, d: np.ndarray) -> np.ndarray:
    """Each node's nearest anchor by position, the first one on ties."""
    return d[:, np.asarray(anchors, int)].argmin(1)


def exact(p: Problem, sample, k: int, max_combinations: int = 1_000_000, require_exact: bool = True):
    """(anchors, exact, combinations): the best k of the sample by the sample's own objective,
    the first in lexicographic order on ties; greedy beyond the cap unless exactness is
    required."""
    s = np.asarray(sample, int)
    k = min(k, len(s))
    total = comb(len(s), k)
    if total > max_combinations:
        if require_exact:
            raise ValueError(f"{total} combinations exceed {max_combinations}")
        return greedy(p, s, k), False, total
    d, rho = p.d[np.ix_(s, s)], p.rho[s]
    price = p.token_weight * p.cost[s] if p.token_weight > 0 else np.zeros(len(s))
    n = len(s)
    if k == 1:
        tails, near, worth, starts = np.arange(n)[:, None], d.T, price, [0]
    else:
        # the last two members are scored together: pairs in order, and where those begin
        # whose first member is at least i
        i, j = np.triu_indices(n, 1)
        tails, near, worth = np.stack([i, j], 1), np.minimum(d[i], d[j]), price[i] + price[j]
        starts = np.searchsorted(i, np.arange(n + 1))
    # what a head can reach at best: every node as near as it or any later node is, and the
    # cheapest tail; heads are tried in that order, until none can reach what is found
    width = max(0, k - 2)
    heads = np.array(list(combinations(range(n), width)), int).reshape(comb(n, width), width)
    nodes = np.full((len(heads), n), np.inf)
    for column in heads.T:
        np.minimum(nodes, d[column], out=nodes)
    after = heads[:, -1] + 1 if width else np.zeros(len(heads), int)
    later = np.vstack([np.minimum.accumulate(d[::-1], 0)[::-1], np.full(n, np.inf)])
    spent = price[heads].sum(1) + p.anchor_penalty * k
    reach = np.minimum(nodes, later[after])
    bound = np.round(np.where(np.isfinite(reach), reach, 0) @ rho + spent + worth.min(), DECIDE)
    best, found, place = np.inf, None, -1
    for h in np.argsort(bound, kind="stable").tolist():
        if bound[h] > best:
            break
        at = int(starts[after[h]]) if k > 1 else 0
        if at == len(tails):
            continue
        score = np.round(np.minimum(near[at:], nodes[h]) @ rho + (worth[at:] + spent[h]), DECIDE)
        m = int(score.argmin())
        # the first combination wins ties, whichever head was tried first
        if score[m] < best or (score[m] == best and h < place):
            best, found, place = score[m], [*heads[h], *tails[at + m]], h
    return [int(x) for x in s[found]], True, total


def greedy(p: Problem, sample, k: int) -> list[int]:
    """Adds the candidate that lowers the sample's objective most, k times; the lowest index
    wins ties; sorted."""
    s = np.asarray(sample, int)
    near, chosen = np.full(len(s), np.inf), []
    price = p.token_weight * p.cost[s] if p.token_weight > 0 else np.zeros(len(s))
    d = p.d[np.ix_(s, s)]
    for _ in range(min(k, len(s))):
        score = np.round(p.rho[s] @ np.minimum(near[:, None], d) + price, DECIDE)
        score[chosen] = np.inf
        i = int(score.argmin())
        chosen.append(i)
        near = np.minimum(near, d[:, i])
    return sorted(int(x) for x in s[chosen])


@dataclass
class Refined:
    anchors: list[int]
    before: dict[str, float]
    after: dict[str, float]
    accepted: bool = False
    history: list[float] = field(default_factory=list)
    cluster_sizes: list[int] = field(default_factory=list)


def unrefined(p: Problem, anchors, objective: dict[str, float]) -> Refined:
    sizes = np.bincount(assign(anchors, p.d), minlength=len(anchors)).tolist()
    return Refined(list(anchors), objective, objective, False, [objective["total"]], sizes)


def _best_inside(p: Problem, anchors, cell: np.ndarray, eligible: np.ndarray) -> list[int]:
    """The anchors after one move.  Every node is priced as its own cell's anchor at once; then
    each position, in order, takes its cell's cheapest eligible node that no position holds,
    the lowest index on ties.  What it gives up is free for later positions; a position whose
    cell offers nothing stays."""
    mass = np.zeros((len(anchors), len(p.rho)))
    mass[cell, np.arange(len(cell))] = p.rho
    price = np.round(mass @ p.d + max(0.0, p.token_weight) * p.cost, DECIDE)
    held = np.zeros(len(p.rho), bool)
    held[anchors] = True
    moved = np.array(anchors)
    for pos in range(len(moved)):
        held[moved[pos]] = False
        offer = np.where(eligible & ~held & (cell == pos), price[pos], np.inf)
        if np.isfinite(offer.min()):
            moved[pos] = offer.argmin()
        held[moved[pos]] = True
    return moved.tolist()


def refine(p: Problem, anchors, candidates, iterations: int = 1) -> Refined:
    """Moves every anchor to its cell's best candidate as long as the objective falls.
    cluster_sizes are those of the last assignment made, none without iterations."""
    start = list(dict.fromkeys(int(a) for a in anchors))
    eligible = np.zeros(len(p.rho), bool)
    eligible[np.asarray(candidates, int)] = True
    #: every state reached, each better than the one before
    trail, sizes, settled = [(start, p.objective(start))], [], not start
    while not settled and len(trail) <= iterations:
        (here, value), n = trail[-1], len(start)
        cell = assign(here, p.d)
        sizes = np.bincount(cell, minlength=n).tolist()
        there = _best_inside(p, here, cell, eligible)
        worth = p.objective(there)
        settled = worth["total"] >= value["total"] - MARGIN
        if not settled:
            trail.append((there, worth))
    totals = [value["total"] for _, value in trail]
    last, value = trail[-1]
    stalled = totals[-1:] if settled and start else []
    return Refined(last, trail[0][1], value, len(trail) > 1, totals + stalled, sizes)
