"""Settings of the approximate engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class AqpConf:
    """All session settings, with their defaults; :meth:`check` holds their ranges.

    ``default_sample`` is the planner's row guess for a sampler of unknown size.
    """

    enable_new_agg_impl: bool = False
    tablesample_swr_ask_for_samples_attempted: bool = False
    pswr_chosen_plan_index: int = -1
    enable_pswr: bool = False
    initial_phase_sample_size: int = -1
    dp_intervals_count: int = 100
    dp_linear_coefficient: float = 100.0
    optimization_strategy: int = 1
    batch_sampling: bool = False
    subtree_sample_size: int = 30
    subtree_stop_k: float = 0.004
    batch_sampling_dp: bool = False
    pswr_tree: bool = False
    pswr_to_swr: bool = False
    enable_pswr_switch_to_uniform: bool = False
    progressive_round_size: int = 100_000
    error_mode: str = "absolute"
    default_sample: int = 1000

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        least = {
            "pswr_chosen_plan_index": -1,
            "initial_phase_sample_size": -1,
            "dp_intervals_count": 1,
            "dp_linear_coefficient": 0,
            "optimization_strategy": -1,
            "subtree_sample_size": 1,
            "subtree_stop_k": 0,
            "progressive_round_size": 1,
        }
        for name, low in least.items():
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}")
        if self.error_mode not in ("absolute", "relative"):
            raise ValueError("error_mode is absolute or relative")

    def set(self, **values) -> AqpConf:
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **values)

    @classmethod
    def from_session(cls, spark, prefix: str = "aqp.") -> AqpConf:
        """Settings given as ``spark.conf`` keys, such as ``aqp.dp_intervals_count``."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(prefix + f.name, None)
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() in ("true", "on", "1") if kind is bool else kind(raw)
        return cls(**found)

    @property
    def strategy(self) -> str:
        """The allocation strategy that the switches name."""
        if self.batch_sampling:
            return "greedy_dp" if self.batch_sampling_dp else "greedy"
        if self.optimization_strategy == 3:
            return "equal"
        if self.optimization_strategy == 2:
            return "size"
        if self.optimization_strategy == 1 and self.dp_intervals_count > 1:
            return "cost"
        return "uniform"
