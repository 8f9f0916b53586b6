"""A configuration program over a histogram of lengths, for packing bins of one capacity.

A configuration is a multiset of lengths that fits into a bin. The program asks for
the least total amount of configurations that cover the histogram, amounts being
fractions at first. Multiplicative weights solve it: a length weighs its size times a
factor that falls exponentially with the share of its demand that is covered, a
knapsack dynamic program over the capacity prices all configurations at these weights,
and those near the optimum price get a small amount each. Weights divided by the
optimum price are a solution of the dual program, so every step gives a lower bound
for the number of bins.

Amounts are then rounded: whole parts first, then one more copy of each, by the size
of the fraction left, where demand allows. What that leaves is packed best-fit.

Everything here works on the histogram, which has at most ``capacity`` entries,
so neither time nor memory grow with the number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np

STEPS = 30
#: The share of a configuration's scarcest demand that one step covers with it.
SHARE = 0.1
#: How fast a length loses weight as its demand is covered.
RATE = 2.0
#: How far below the optimum price a configuration may be.
NEAR = 0.02

Plan = list[tuple[dict[int, int], int]]


def _knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Greatest weight of each capacity, and the index of the last length in it (-1: none)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        fits = int(np.searchsorted(lengths, c, "right"))
        gains = best[c - lengths[:fits]] + weights[:fits]
        k = int(gains.argmax())
        if gains[k] > best[c - 1]:
            best[c], last[c] = gains[k], k
        else:
            best[c], last[c] = best[c - 1], -2
    return best, last


def _configuration(
    first: int, lengths: np.ndarray, left: np.ndarray, last: np.ndarray, capacity: int
) -> Counter[int]:
    """The best configuration that holds length ``first`` (an index), within what is left."""
    taken: Counter[int] = Counter({first: 1})
    room = capacity - int(lengths[first])
    c = room
    while c > 0 and last[c] != -1:
        k = int(last[c])
        if k == -2:
            c -= 1
            continue
        if taken[k] < left[k]:
            taken[k] += 1
            room -= int(lengths[k])
        c -= int(lengths[k])
    # Copies beyond the demand leave a gap; the longest lengths that fit fill it.
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right")) - 1
        while k >= 0 and taken[k] >= left[k]:
            k -= 1
        if k < 0:
            break
        n = min(room // int(lengths[k]), int(left[k]) - taken[k])
        taken[k] += n
        room -= n * int(lengths[k])
    return taken


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing by counts: bins of equal content are one entry."""
    bins: list[tuple[Counter[int], int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        gaps = sorted(g for g, ids in by_gap.items() if ids and g >= size)
        heapq.heapify(gaps)
        while n and gaps:
            gap = gaps[0]
            if not by_gap[gap]:
                heapq.heappop(gaps)
                continue
            content, copies = bins[at := by_gap[gap].pop()]
            each = min(gap // size, max(1, n // copies))
            used = min(copies, n // each)
            if used < copies:
                bins[at] = (content, copies - used)
                by_gap[gap].append(at)
            else:
                bins[at] = (content, 0)
            rest = gap - each * size
            bins.append((content + Counter({k: each}), used))
            by_gap.setdefault(rest, []).append(len(bins) - 1)
            if rest >= size:
                heapq.heappush(gaps, rest)
            n -= used * each
        if n:
            each = capacity // size
            for content, copies in ((each, n // each), (n % each, 1)):
                if content and copies:
                    bins.append((Counter({k: content}), copies))
                    by_gap.setdefault(capacity - content * size, []).append(len(bins) - 1)
    return [({int(lengths[k]): n for k, n in c.items()}, copies) for c, copies in bins if copies]


def fractional(
    lengths: np.ndarray, demand: np.ndarray, capacity: int
) -> tuple[list[Counter[int]], np.ndarray, float]:
    """Configurations (of indices into ``lengths``), their amounts, and the lower bound.

    The amounts hold as many tokens as the demand does; a length may be covered somewhat
    more or less than once.
    """
    covered = np.zeros(len(lengths))
    found: dict[frozenset, int] = {}
    contents: list[Counter[int]] = []
    amounts: list[float] = []
    bound = 0.0
    for _ in range(STEPS):
        weights = lengths * np.exp(-RATE * covered)
        best, last = _knapsack(lengths, weights, capacity)
        bound = max(bound, float(weights @ demand) / best[capacity])
        price = weights + best[capacity - lengths]
        near = np.flatnonzero(price >= (1 - NEAR) * best[capacity])
        for first in near[np.argsort(covered[near], kind="stable")].tolist():
            content = _configuration(first, lengths, demand, last, capacity)
            amount = SHARE * min(demand[k] / n for k, n in content.items())
            for k, n in content.items():
                covered[k] += amount * n / demand[k]
            at = found.setdefault(frozenset(content.items()), len(contents))
            if at == len(contents):
                contents.append(content)
                amounts.append(0.0)
            amounts[at] += amount
    held = float((covered * demand) @ lengths)
    scale = float(demand @ lengths) / held if held else 0.0
    return contents, np.array(amounts) * scale, bound


def _rounded(
    contents: list[Counter[int]], amounts: np.ndarray, left: np.ndarray
) -> list[tuple[Counter[int], int]]:
    """Whole copies within ``left``, which is reduced by them."""
    whole = np.floor(amounts)
    # First the whole parts, the largest first; then what was cut off.
    order = np.argsort(-whole, kind="stable"), np.argsort(whole - amounts, kind="stable")
    plan = []
    for copies, at in [(whole, order[0]), (np.ones(len(whole)), order[1])]:
        for i in at.tolist():
            content = contents[i]
            n = min(int(copies[i]), *(int(left[k]) // m for k, m in content.items()))
            if n > 0:
                for k, m in content.items():
                    left[k] -= n * m
                plan.append((content, n))
    return plan


def solve_with_bound(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """Configurations and their numbers of copies, and the least number of bins possible.

    The plan holds each item of the histogram, which maps lengths (1 to ``capacity``) to
    how many items have them, once. An empty histogram gives an empty plan.
    """
    plan: Plan = []
    demand = {n: k for n, k in histogram.items() if k > 0}
    if demand and (min(demand) < 1 or max(demand) > capacity):
        raise ValueError(f"a length is not within 1 to {capacity}")
    full = demand.pop(capacity, 0)
    if full:
        plan.append(({capacity: 1}, full))
    if not demand:
        return plan, full
    lengths = np.array(sorted(demand), np.int64)
    left = np.array([demand[n] for n in lengths.tolist()], np.int64)
    contents, amounts, bound = fractional(lengths, left.copy(), capacity)
    rounded = _rounded(contents, amounts, left)
    plan += [({int(lengths[k]): n for k, n in c.items()}, copies) for c, copies in rounded]
    return plan + _best_fit(lengths, left, capacity), full + math.ceil(bound - 1e-6)


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan of :func:`solve_with_bound`."""
    return solve_with_bound(histogram, capacity)[0]
