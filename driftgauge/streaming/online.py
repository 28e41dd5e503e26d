"""Online aggregation: sample in rounds until the half-width is small enough.

1. Split the predicate into a key range and a rest; an empty range ends here.
2. Pick the index: the one named, or the one whose range weighs least.
3. Pilot: draws over the whole range; stop if they do. While no draw has
   counted for anything, further draws over the whole range join the pilot.
4. Prefix statistics of the pilot at a bounded number of ranks.
5. Strata and draws by the strategy in force.
6. Rounds of bounded size, each one Spark job for all strata; after each, the
   estimate over phases and strata, and the stop test.
7. If a round makes the half-width worse, go back to the last good state and go
   on with one stratum, where that is switched on.

An estimate is settled by draws that count for something: as long as an
aggregate (of a group) has none, its 0 has no half-width and does not meet any
target, so that draws go on until the budget is spent.

What reaches the driver is a row of sums for each stratum or cut. Phases weigh
by their draws and strata follow from the pilot, so that half-widths are
approximate.
"""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.conf import AqpConf
from driftgauge.functions.stats import erf_inv
from driftgauge.operators import allocate
from driftgauge.operators.estimators import Agg, combine_phases, stratum_stats
from driftgauge.operators.rank_index import RankIndex
from driftgauge.operators.samplers import Stratum, swr_strata, warn_rejections

_log = logging.getLogger(__name__)
#: Rounds that got worse before the loop goes back.
BAD_ROUNDS = 1
#: Rows of sums (groups times strata) that a round may bring to the driver.
MOST_ROWS = 200_000
#: Below so many draws a pilot is all there is, where ``pswr_to_swr`` is on.
SMALL_PILOT = 1000


@dataclass
class Round:
    phase: int
    strata: int
    draws: int
    accepted: int
    estimate: float
    half_width: float | None
    seconds: float
    kept: bool = True


@dataclass
class AqpResult:
    """Estimates and half-widths by aggregate (and group), and how they came about."""

    names: list[str]
    by: list[str]
    values: dict[tuple, dict[str, tuple[float, float | None]]]
    draws: int
    accepted: int
    key: str
    weight: int
    strategy: str
    rounds: list[Round] = field(default_factory=list)
    strata: list[Stratum] = field(default_factory=list)
    #: whether the watched half-width is on target, in every group that was drawn
    met: bool = False

    def value(self, name: str | None = None, group: tuple = ()) -> tuple[float, float | None]:
        return self.values[group][name or self.names[0]]

    def to_df(self, spark: SparkSession) -> DataFrame:
        fields = [*[f"{b} string" for b in self.by], *[f"{n} double, {n}_half_ci double" for n in self.names], "draws long, accepted long, met boolean"]
        rows = [(*map(str, g), *[x for n in self.names for x in v[n]], self.draws, self.accepted, self.met) for g, v in self.values.items()]
        return spark.createDataFrame(rows, ", ".join(fields))

    #: Promises of a run: see :meth:`facts`.
    PROMISES = ("near_exact", "in_budget", "target_as_told", "strata_cover_range")

    def facts(self, exact: DataFrame, budget: int, rel_error: float, widths: float = 4.0) -> DataFrame:
        """``exact`` (one row of exact values by name) beside what a run promises, none of which depends on the draws.

        ``near_exact``: every exact value lies within so many half-widths of its
        estimate; where nothing counted there is no half-width and no claim.
        ``target_as_told``: ``met`` says what the first half-width says. The last
        round's strata are a partition of the key range.
        """
        row = exact.first()
        spans = sorted((s.lo, s.hi) for s in self.strata)
        joined = all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        told = self.met if not self.weight else self.met == (self.value()[1] is not None and self.value()[1] <= rel_error * abs(self.value()[0]))
        near = all(half is None or abs(row[n] - value) <= widths * half + 0.01 for n in self.names for value, half in [self.value(n)])
        kept = (near, self.draws <= budget, told, not spans or (joined and spans[-1][1] - spans[0][0] == self.weight))
        return exact.select("*", *[F.lit(bool(v)).alias(n) for n, v in zip(self.PROMISES, kept, strict=True)])

    def explain(self) -> str:
        head = f"Sampling: PSWR ({self.draws}) on {self.key}, weight {self.weight}, strategy {self.strategy}, target {'met' if self.met else 'not met'}"
        lines = [f"  phase {r.phase}: {r.strata} strata, {r.draws} draws, {r.accepted} accepted, estimate {r.estimate:.6g}, half-width {'-' if r.half_width is None else format(r.half_width, '.6g')}, {r.seconds:.2f} s{'' if r.kept else ', discarded'}" for r in self.rounds]
        return "\n".join([head, *lines])


class OnlineAggregator:
    """Progressive sampling over one or more candidate indexes of the same table."""

    def __init__(self, indexes: RankIndex | list[RankIndex], conf: AqpConf | None = None):
        self.indexes = indexes if isinstance(indexes, list) else [indexes]
        self.conf = conf or AqpConf()

    def choose(self, ranges: dict[str, tuple]) -> tuple[RankIndex, tuple[int, int]]:
        """The index in use and its ranks."""
        given = self.conf.pswr_chosen_plan_index
        if given >= 0:
            index = self.indexes[given]
            return index, index.bounds(ranges.get(index.key))
        found = [(i, i.bounds(ranges.get(i.key))) for i in self.indexes]
        return min(found, key=lambda x: x[1][1] - x[1][0])

    def run(
        self,
        aggs: dict[str, Agg],
        budget: int,
        n0: int,
        confidence: float = 0.95,
        abs_error: float | None = None,
        rel_error: float | None = None,
        ranges: dict[str, tuple] | None = None,
        predicate: Column | None = None,
        by: list[str] | None = None,
        seed: int = 0,
        extend=None,
        all_equal: bool = False,
    ) -> AqpResult:
        """Estimates of ``aggs``; the first one's half-width is the one that is watched (the widest group's).

        ``extend`` takes the drawn rows and returns them joined with further
        tables, with ``__inv_prob`` and ``__accepted`` adjusted. Where the
        range holds a single key, which ``all_equal`` may also say, there is
        nothing to divide: all rounds are of one phase without strata.
        """
        if (abs_error is None) == (rel_error is None):
            raise ValueError("give exactly one of abs_error and rel_error")
        conf, by, names = self.conf, by or [], list(aggs)
        index, (lo, hi) = self.choose(ranges or {})
        all_equal = all_equal or _single(ranges, index.key)
        strategy = "uniform" if all_equal else conf.strategy
        result = AqpResult(names, by, {}, 0, 0, index.key, hi - lo, strategy)
        if hi <= lo:
            result.values = {} if by else {(): {n: (0.0, None) for n in names}}
            result.met = True  # no row is there: 0 is exact
            return result
        z = math.sqrt(2) * erf_inv(confidence)
        phases: list[dict] = []  # each: draws, {group: {name: (mean, variance, sum of squares)}}

        def sample(strata: list[Stratum], tag: str) -> DataFrame:
            drawn = swr_strata(index, strata, seed, predicate, tag=tag)
            return extend(drawn) if extend else drawn

        def bounded(stats: DataFrame) -> list:
            found = stats.limit(MOST_ROWS + 1).collect() if by else stats.collect()
            if len(found) > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} groups and strata: group by less, or estimate in one phase, whose result stays distributed")
            return found

        def measure(rows: list, strata: list[Stratum]) -> dict:
            n_of = {s.number: s.draws for s in strata}
            out: dict[tuple, dict[str, list[float]]] = {}
            for r in rows:
                at = out.setdefault(tuple(r[b] for b in by), {n: [0.0, 0.0, 0.0] for n in names})
                n = n_of[r.stratum]
                for name in names:
                    s, ss = r[f"{name}__s"] or 0.0, r[f"{name}__ss"] or 0.0
                    at[name][0] += s / n
                    at[name][1] += max(0.0, ss - s * s / n) / (n * (n - 1)) if n > 1 else math.inf
                    at[name][2] += ss
            return {"draws": sum(n_of.values()), "groups": out}

        def combined() -> dict[tuple, dict[str, tuple[float, float]]]:
            groups = {g for p in phases for g in p["groups"]}
            return {g: {name: together([(*p["groups"].get(g, {}).get(name, (0.0, 0.0, 0.0)), p["draws"]) for p in phases]) for name in names} for g in groups}

        def together(parts: list[tuple[float, float, float, int]]) -> tuple[float, float]:
            mean, var, _ = combine_phases([(m, v, n) for m, v, _, n in parts])
            return mean, var if any(ss > 0 for _, _, ss, _ in parts) else math.inf  # zeros alone tell nothing of the spread

        def width() -> tuple[float, float | None]:
            values = combined()
            if not values:
                return 0.0, None
            known = [v[names[0]] for v in values.values() if not math.isinf(v[names[0]][1])]
            if not known:
                return max((v[names[0]][0] for v in values.values()), key=abs), None
            worst = max(known, key=lambda v: v[1])
            return worst[0], z * math.sqrt(worst[1])

        def enough() -> bool:
            for v in combined().values():
                mean, var = v[names[0]]
                if math.isinf(var) or z * math.sqrt(var) > (abs_error if abs_error is not None else rel_error * abs(mean)):
                    return False
            return bool(combined())

        def unknown() -> bool:
            """Whether a group (or all of the sample) has had no draw that counts."""
            return any(math.isinf(v[names[0]][1]) for v in combined().values()) or not combined()

        def take(strata: list[Stratum], tag: str, phase: int) -> None:
            began = time.monotonic()
            rows = bounded(stratum_stats(sample(strata, tag), aggs, by))
            phases.append(measure(rows, strata))
            accepted = sum(r["__accepted_n"] or 0 for r in rows)
            result.draws += phases[-1]["draws"]
            result.accepted += accepted
            result.rounds.append(Round(phase, len(strata), phases[-1]["draws"], accepted, *width(), time.monotonic() - began))

        pilot = max(2, min(budget, n0 if conf.initial_phase_sample_size < 0 else conf.initial_phase_sample_size))
        cuts = allocate.cut_points(lo, hi, conf.dp_intervals_count)
        k = len(cuts) - 1
        # prefix statistics watch the first aggregate over all groups, without the weight
        m, sx, sxx = np.zeros(k), np.zeros(k), np.zeros(k)

        def explore(n: int, tag: str, phase: int) -> None:
            """Draws over the whole range: their sums by cut cell give the phase and the prefix statistics in one job."""
            began = time.monotonic()
            whole = [Stratum(0, lo, hi, n)]
            drawn = sample(whole, tag).withColumn("__cell", F.floor((F.col("rank") - F.lit(cuts[0])) * k / F.lit(hi - lo)).cast("int"))
            cells = bounded(stratum_stats(drawn, aggs, [*by, "__cell"]))
            merged: dict[tuple, dict] = {}
            for r in cells:
                key = (*(r[b] for b in by), r.stratum)
                at = merged.setdefault(key, {b: r[b] for b in by} | {"stratum": r.stratum} | {f"{name}__{x}": 0.0 for name in names for x in ("s", "ss")})
                for name in names:
                    at[f"{name}__s"] += r[f"{name}__s"] or 0.0
                    at[f"{name}__ss"] += r[f"{name}__ss"] or 0.0
                c = min(max(r["__cell"], 0), k - 1)
                sx[c] += (r[f"{names[0]}__s"] or 0.0) / (hi - lo)
                sxx[c] += (r[f"{names[0]}__ss"] or 0.0) / (hi - lo) ** 2
            m[:] += [n * (b - a) / (hi - lo) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            phases.append(measure([_Row(r) for r in merged.values()], whole))
            accepted = sum(r["__accepted_n"] or 0 for r in cells)
            result.draws += n
            result.accepted += accepted
            result.rounds.append(Round(phase, 1, n, accepted, *width(), time.monotonic() - began))

        explore(pilot, "pilot", 1)
        warn_rejections(result.accepted, pilot)
        small = conf.pswr_to_swr and pilot < SMALL_PILOT
        if small:
            strategy = result.strategy = "uniform"
        stats = allocate.PrefixStats.from_cells(cuts, m, sx, sxx)
        phase, bad = 2, 0
        while not enough() and result.draws < budget:
            left = budget - result.draws
            if not sxx.any() and left >= 2:  # nothing met so far: no ground for strata
                explore(min(max(2, conf.progressive_round_size), left), f"phase{phase}", phase)
                stats = allocate.PrefixStats.from_cells(cuts, m, sx, sxx)
                phase += 1
                continue
            mean, last = width()
            target = abs_error if abs_error is not None else rel_error * abs(mean)
            strata = allocate.allocate(strategy, stats, min(conf.progressive_round_size, budget - result.draws), conf)
            need = left if unknown() else allocate.draws_needed(strata, stats, z, target)
            # a quarter of what there is at least: where the statistics promise too much, rounds stay few
            n = max(2 * len(strata), min(conf.progressive_round_size, max(need, result.draws // 4), budget - result.draws))
            strata = allocate.cap(allocate.allocate(strategy, stats, n, conf), budget - result.draws)
            strata = [s for s in strata if s.weight > 0]
            if not strata or any(s.draws < 2 for s in strata):  # a stratum without draws would be left out of the estimate
                if budget - result.draws < 2:
                    break
                strata = allocate.uniform(lo, hi, min(n, budget - result.draws))
            take(strata, f"phase{phase}", 1 if all_equal else phase)
            result.strata = [] if all_equal else strata
            _, now = width()
            if conf.enable_pswr_switch_to_uniform and strategy != "uniform" and last is not None and (now is None or now > last):
                bad += 1
                if bad >= BAD_ROUNDS:  # back to the last good state; its draws are spent all the same
                    phases.pop()
                    result.rounds[-1].kept = False
                    strategy = result.strategy = "uniform"
            phase += 1
        result.met = enough()
        if conf.tablesample_swr_ask_for_samples_attempted:
            _log.info("N=%d", result.draws)
        result.values = {g: {n: (v[n][0], None if math.isinf(v[n][1]) else z * math.sqrt(v[n][1])) for n in names} for g, v in combined().items()}
        if not by and not result.values:
            result.values = {(): {n: (0.0, None) for n in names}}
        return result


def _single(ranges: dict[str, tuple] | None, key: str) -> bool:
    """Whether the range holds one whole number, or one value and no more."""
    low, high = (ranges or {}).get(key) or (None, None)
    if low is None or high is None:
        return False
    return high == low + 1 if isinstance(low, int) else isinstance(low, str) and high == low + "\0"


class _Row(dict):
    """A dict that is read like a row."""

    __getattr__ = dict.__getitem__
