"""Strata and draws for the second phase, from a pilot sample.

Everything here works on at most ``intervals`` rows of prefix statistics, so it
is numpy on the driver. Positions are ranks; a stratum is a rank range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from driftgauge.conf import AqpConf
from driftgauge.operators.samplers import Stratum

#: No stratum gets fewer draws, as a single one has no variance.
LEAST_DRAWS = 2
#: Draws of the whole pilot that each stratum's variance is mixed with.
PRIOR_DRAWS = 30


@dataclass(frozen=True)
class PrefixStats:
    """Pilot statistics at the cut points: ``cuts`` are k+1 ranks, the others cumulative sums at each cut."""

    cuts: np.ndarray
    m: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray

    @classmethod
    def from_cells(cls, cuts, m, sx, sxx) -> PrefixStats:
        run = lambda a: np.concatenate([[0.0], np.cumsum(np.asarray(a, float))])
        return cls(np.asarray(cuts, np.int64), run(m), run(sx), run(sxx))

    @property
    def cells(self) -> int:
        return len(self.cuts) - 1

    def weight(self, i: int, j: int) -> int:
        return int(self.cuts[j] - self.cuts[i])

    def sigma(self, i: int, j: int) -> float:
        """Standard deviation of a draw's value (before weighting) in cells i..j-1.

        The variance is drawn towards that of the whole pilot as by
        ``PRIOR_DRAWS`` draws of it: few draws without a hit are no proof that
        a stratum is empty.
        """
        whole = self._variance(0, self.cells)
        n = self.m[j] - self.m[i]
        return math.sqrt((n * self._variance(i, j) + PRIOR_DRAWS * whole) / (n + PRIOR_DRAWS))

    def _variance(self, i: int, j: int) -> float:
        n = self.m[j] - self.m[i]
        if n < 2:
            return 0.0
        s, ss = self.sx[j] - self.sx[i], self.sxx[j] - self.sxx[i]
        return max(0.0, (ss - s * s / n) / (n - 1))


def cut_points(lo: int, hi: int, intervals: int) -> list[int]:
    """At most ``intervals`` + 1 distinct ranks from lo to hi."""
    k = max(1, min(intervals, hi - lo))
    return sorted({lo + (hi - lo) * i // k for i in range(k + 1)})


def _spread(weights: list[float], total: int, floors: list[int]) -> list[int]:
    """Whole shares of a total by weight: at least the floors, at most the total if the floors fit into it."""
    base = sum(weights)
    if total <= sum(floors):
        return [min(f, total // max(1, len(floors))) for f in floors]
    raw = [total * w / base if base > 0 else total / len(weights) for w in weights]
    out = [max(f, int(r)) for f, r in zip(floors, raw, strict=True)]
    order = sorted(range(len(out)), key=lambda k: raw[k] - out[k])
    over, k = sum(out) - total, 0
    while over > 0 and k < len(order):  # floors took more than their share: the largest give it back
        largest = max(range(len(out)), key=lambda i: out[i] - floors[i])
        step = min(over, out[largest] - floors[largest])
        if step <= 0:
            break
        out[largest] -= step
        over -= step
        k += 1
    short = total - sum(out)
    for i in reversed(order[-short:] if short > 0 else []):
        out[i] += 1
    return out


def strata_of(bounds: list[int], draws: list[int]) -> list[Stratum]:
    return [Stratum(k, lo, hi, n) for k, (lo, hi, n) in enumerate(zip(bounds[:-1], bounds[1:], draws, strict=True)) if hi > lo]


def uniform(lo: int, hi: int, draws: int) -> list[Stratum]:
    return [Stratum(0, lo, hi, draws)]


def equal(lo: int, hi: int, draws: int, strata: int) -> list[Stratum]:
    """Strata of equal weight, the same number of draws in each."""
    bounds = cut_points(lo, hi, max(1, min(strata, draws // LEAST_DRAWS)))
    k = len(bounds) - 1
    return strata_of(bounds, _spread([1.0] * k, draws, [min(LEAST_DRAWS, draws)] * k))


def neyman(stats: PrefixStats, bounds: list[int], draws: int, cost: float = 1.0) -> list[Stratum]:
    """Draws in proportion to weight times standard deviation, over the root of a draw's cost."""
    weights = [stats.weight(i, j) * stats.sigma(i, j) / math.sqrt(cost) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return strata_of([int(stats.cuts[b]) for b in bounds], _spread(weights, draws, [min(LEAST_DRAWS, draws)] * len(weights)))


def best_bounds(stats: PrefixStats, strata: int, penalty: float = 0.0) -> list[int]:
    """Cell bounds of at most ``strata`` strata that minimise sum(W sigma) + penalty for each stratum.

    With Neyman shares the variance is the square of that sum over the draws.
    """
    k = stats.cells
    cost = np.full((k + 1, k + 1), np.inf)
    for i in range(k):
        for j in range(i + 1, k + 1):
            cost[i, j] = stats.weight(i, j) * stats.sigma(i, j) + penalty
    strata = max(1, min(strata, k))
    best = np.full((strata + 1, k + 1), np.inf)
    source = np.zeros((strata + 1, k + 1), int)
    best[0, 0] = 0.0
    for s in range(1, strata + 1):
        total = best[s - 1][:, None] + cost
        source[s] = total.argmin(axis=0)
        best[s] = total.min(axis=0)
    s = int(best[1:, k].argmin()) + 1
    bounds = [k]
    while s:
        bounds.append(int(source[s, bounds[-1]]))
        s -= 1
    return bounds[::-1]


def size_optimised(stats: PrefixStats, draws: int, conf: AqpConf) -> list[Stratum]:
    """Optimal bounds with Neyman shares; as many strata as the draws allow."""
    return neyman(stats, best_bounds(stats, min(conf.dp_intervals_count, max(1, draws // 50), 20)), draws)


def cost_optimised(stats: PrefixStats, draws: int, conf: AqpConf, draw_cost: float = 1.0) -> list[Stratum]:
    """As :func:`size_optimised`, with a fixed cost for each stratum.

    ``dp_linear_coefficient`` draws are what a stratum costs to set up; a
    stratum has to save as much. ``draw_cost`` is the height of a descent where
    a draw has one; here it is the same for all.
    """
    whole = stats.weight(0, stats.cells) * stats.sigma(0, stats.cells)
    penalty = whole * conf.dp_linear_coefficient / (2.0 * max(draws, 1))
    return neyman(stats, best_bounds(stats, min(conf.dp_intervals_count, max(1, draws // 50), 20), penalty), draws, draw_cost)


def greedy_bounds(stats: PrefixStats, conf: AqpConf) -> list[int]:
    """Split again and again where one cut gains most, while that is over ``subtree_stop_k`` of the whole.

    A part is split only where the pilot has ``subtree_sample_size`` draws in it.
    """
    bounds = [0, stats.cells]
    spread = lambda i, j: stats.weight(i, j) * stats.sigma(i, j)
    whole, found = spread(0, stats.cells), {}

    def cut(i: int, j: int) -> tuple[float, int]:
        if (i, j) not in found:
            few = j - i < 2 or stats.m[j] - stats.m[i] < conf.subtree_sample_size
            found[i, j] = (0.0, i) if few else max((spread(i, j) - spread(i, c) - spread(c, j), c) for c in range(i + 1, j))
        return found[i, j]

    while len(bounds) - 1 < conf.dp_intervals_count:
        gain, c = max(cut(i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True))
        if gain <= conf.subtree_stop_k * whole:
            break
        bounds = sorted([*bounds, c])
    return bounds


def greedy(stats: PrefixStats, draws: int, conf: AqpConf) -> list[Stratum]:
    return neyman(stats, greedy_bounds(stats, conf), draws)


def greedy_dp(stats: PrefixStats, draws: int, conf: AqpConf) -> list[Stratum]:
    """Greedy splits as the cut points of the optimal bounds."""
    bounds = greedy_bounds(stats, conf)
    coarse = PrefixStats(stats.cuts[bounds], stats.m[bounds], stats.sx[bounds], stats.sxx[bounds])
    return neyman(coarse, best_bounds(coarse, max(1, min(draws // 50, 20))), draws)


def allocate(strategy: str, stats: PrefixStats, draws: int, conf: AqpConf) -> list[Stratum]:
    lo, hi = int(stats.cuts[0]), int(stats.cuts[-1])
    if strategy == "uniform":
        return uniform(lo, hi, draws)
    if strategy == "equal":
        return equal(lo, hi, draws, conf.dp_intervals_count)
    return {"size": size_optimised, "cost": cost_optimised, "greedy": greedy, "greedy_dp": greedy_dp}[strategy](stats, draws, conf)


def cap(strata: list[Stratum], remaining: int) -> list[Stratum]:
    """The strata with their draws trimmed in proportion, so that they fit into the budget."""
    total = sum(s.draws for s in strata)
    if total <= remaining:
        return strata
    draws = _spread([float(s.draws) for s in strata], remaining, [0] * len(strata))
    return [Stratum(s.number, s.lo, s.hi, n) for s, n in zip(strata, draws, strict=True)]


def draws_needed(strata: list[Stratum], stats: PrefixStats, z: float, error: float) -> int:
    """Draws for a half-width of ``error`` under Neyman shares of these strata."""
    if error <= 0:
        return 1 << 62
    at = {int(c): k for k, c in enumerate(stats.cuts)}
    spread = sum(s.weight * stats.sigma(at[s.lo], at[s.hi]) for s in strata if s.lo in at and s.hi in at)
    return max(1, math.ceil((z * spread / error) ** 2))
