"""Plain-Python oracles of the metric definitions (written for the tests from
hit positions; lists in, numbers out)."""

from __future__ import annotations

import itertools
import math


def _hit_ranks(ranked, flaws):
    """1-based ranks whose item is labelled (membership, duplicates ignored)."""
    labelled = set(flaws)
    return [k for k, item in enumerate(ranked, start=1) if item in labelled]


def top_x_accuracy(ranked, flaws, x):
    return int(any(k <= x for k in _hit_ranks(ranked, flaws)))


def top_x_precision(ranked, flaws, x):
    return len([k for k in _hit_ranks(ranked, flaws) if k <= x]) / x


def top_x_recall(ranked, flaws, x, guard=True):
    top = len([k for k in _hit_ranks(ranked, flaws) if k <= x])
    if not flaws:
        return 0 if guard else float("nan")
    return top / len(flaws)


def rr(ranked, flaws, x):
    top = [k for k in _hit_ranks(ranked, flaws) if k <= x]
    return 1 / top[0] if top else 0


def ap(ranked, flaws, x):
    top = [k for k in _hit_ranks(ranked, flaws) if k <= x]
    return sum(j / k for j, k in enumerate(top, start=1)) / len(top) if top else 0


def ar(ranked, flaws, x):
    top = [k for k in _hit_ranks(ranked, flaws) if k <= x]
    if not top or not flaws:
        return 0
    return sum(j / len(flaws) for j in range(1, len(top) + 1)) / len(top)


def ifa(ranked, flaws):
    hits = _hit_ranks(ranked, flaws)
    return hits[0] - 1 if hits else len(ranked)


def effort_lines_order(hits_in_order, total_flaws, total_loc, x=20):
    """hits_in_order: 0/1 per inspected line in the global order."""
    if total_flaws == 0:
        return 1.0
    need = max(1, (x / 100) * total_flaws)
    running = list(itertools.accumulate(hits_in_order))
    reached = [p for p, c in enumerate(running, start=1) if c >= need]
    return (reached[0] if reached else len(hits_in_order)) / total_loc


def recall_lines_order(hits_in_order, total_flaws, total_loc, x=1):
    budget = math.ceil(max(1, (x / 100) * total_loc))
    return sum(hits_in_order[:budget]) / total_flaws


def wilcoxon_exact_greater(d):
    """P(W+ >= observed) by enumerating sign assignments (small n, no ties)."""
    import itertools
    d = [v for v in d if v != 0]
    ranks = {v: i + 1 for i, v in enumerate(sorted(abs(x) for x in d))}
    w = sum(ranks[abs(v)] for v in d if v > 0)
    n = len(d)
    cnt = 0
    for signs in itertools.product([0, 1], repeat=n):
        if sum(r for r, s in zip(range(1, n + 1), signs) if s) >= w:
            cnt += 1
    return w, cnt / 2 ** n



