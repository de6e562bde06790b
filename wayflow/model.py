"""Schemas and options shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields

from wayflow.functions import scalar

EDGES = "edge_id int, src int, dst int, fft bigint, cap int"
TRIPS = "trip_id int, origin int, destination int, depart bigint"
ROUTES = "run_id bigint, trip_id int, depart bigint, edges array<int>"
TRAJECTORY = "run_id bigint, trip_id int, pos int, edge_id int, enter bigint, exit bigint, last boolean"


@dataclass(frozen=True)
class TrafficOptions:
    alpha: int = 15
    beta: int = 4
    max_time: int = 0
    min_bpr_capacity: int = 0
    release_last_edge: bool = False
    tie_order: str = "id"  # or "heap16": the order of a 16-ary heap that knows no ids

    def delay(self, fft: int, cap: int, flow: int) -> int:
        if flow <= cap or cap <= self.min_bpr_capacity:
            return fft
        extra = -(-fft * self.alpha * flow**self.beta // (100 * cap**self.beta))
        total = min(fft + extra, scalar.MAX_LONG)
        return min(total, self.max_time) if self.max_time > 0 else total

    def column(self, fft, cap, flow):
        return scalar.bpr(fft, cap, flow, self.alpha, self.beta, self.max_time, self.min_bpr_capacity)


@dataclass(frozen=True)
class AlgorithmOptions:
    max_iterations: int = 5
    lambda_percent: int = 45
    gamma: int = 50
    candidate_theta: int = 80
    impact_weight: int = 15
    reroute_congestion_gate: int = 50
    theta_percentile: int = 90
    conflict_threshold: int = 70
    delta_compress: int = 1200
    anchor_window: int = 1200
    anchor_threshold: int = 20
    baseline_fraction: int = 30
    random_seed: int = 0
    delta_initial: int = 1200
    min_slot_width: int = 600
    eta: int = 60  # known to parameter files, of no effect
    enable_timing_log: bool = False


#: Keys of parameter files where they differ from the field's name, and the fields that are percentages (fixed values).
KEYS = {"lambda": "lambda_percent", "max_time": "max_time", "baseline_fraction_to_reroute": "baseline_fraction", "baseline_random_seed": "random_seed", "timing_log": "enable_timing_log"}
#: Keys that belong to other readers of the same file.
OTHERS = {"graph_path", "coordinates_path", "queries_path", "svp_k", "svp_theta", "release_last_edge", "tie_order"}
PERCENT = {"alpha", "lambda_percent", "gamma", "candidate_theta", "impact_weight", "reroute_congestion_gate", "theta_percentile", "conflict_threshold", "anchor_threshold", "baseline_fraction"}


def options_from(parameters: dict[str, str], kind: type):
    """Options with those fields replaced that the parameter file names. A key that no reader of such files knows is an error."""
    own = {f.name: f for f in fields(kind)}
    known = {f.name for k in (TrafficOptions, AlgorithmOptions) for f in fields(k)} | KEYS.keys() | OTHERS
    if lost := sorted(parameters.keys() - known):
        raise ValueError(f"unknown keys: {', '.join(lost)}")
    given = {}
    for key, text in parameters.items():
        name = KEYS.get(key, key)
        if name in own:
            default = own[name].default
            given[name] = scalar.parse_percent(text) if name in PERCENT else scalar.parse_bool(text) if isinstance(default, bool) else scalar.parse_integer(text) if isinstance(default, int) else text
    return kind(**given)
