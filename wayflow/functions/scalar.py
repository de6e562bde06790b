"""Scalar functions: delay models, ratios, percentiles, normalisation, parsing. Columns in, columns out, all inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1
IMPACT_CAP = MAX_LONG // 4


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def bpr(fft, cap, flow, alpha: int = 15, beta: int = 4, max_time: int = 0, min_capacity: int = 0) -> Column:
    """Delay of an edge in whole seconds: free flow up to capacity, beyond it plus the rounded-up penalty. Exact: decimals, no powers of doubles.

    Clamped to the largest long; ``max_time`` > 0 caps the congested branch only; capacities up to ``min_capacity`` never congest.
    """
    fft, cap, flow = (_c(x).cast("bigint") for x in (fft, cap, flow))

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(a.cast("decimal(38,0)"), b.cast("decimal(19,0)"))

    num, den = times(fft, F.lit(alpha)), F.lit(100).cast("decimal(38,0)")
    for _ in range(beta):
        num, den = times(num, flow), times(den, cap)
    most = F.lit(MAX_LONG).cast("decimal(38,0)")
    # num is null where it is beyond 38 digits; the quotient is compared as double first, so that the exact division cannot overflow
    huge = num.isNull() | (num.cast("double") / den.cast("double") > 9.0e18)
    penalty = F.when(huge, most).otherwise(F.call_function("div", num + den - 1, den).cast("decimal(38,0)"))
    total = F.least(fft.cast("decimal(38,0)") + penalty, most).cast("bigint")
    if max_time > 0:
        total = F.least(total, F.lit(max_time).cast("bigint"))
    return F.when((flow <= cap) | (cap <= min_capacity), fft).otherwise(total)


def soft_bpr(fft, cap, flow, alpha: int = 15, beta: int = 4, min_capacity: int = 0) -> Column:
    """The same law without its step and rounding."""
    fft, cap, flow = (_c(x).cast("double") for x in (fft, cap, flow))
    return F.when(cap <= min_capacity, fft).otherwise(fft + fft * alpha / 100 * F.pow(flow / cap, F.lit(float(beta))))


def ratio_key(flow, cap) -> Column:
    """Load in millionths, whole; capacities below 1 count as 1."""
    return F.call_function("div", _c(flow).cast("bigint") * 1_000_000, F.greatest(F.lit(1).cast("bigint"), _c(cap).cast("bigint")))


def ratio_key_or_max(flow, cap) -> Column:
    """The variant that calls an edge without capacity infinitely loaded."""
    return F.when(_c(cap) <= 0, F.lit(MAX_LONG)).otherwise((_c(flow).cast("double") * 1e6 / _c(cap)).cast("bigint"))


def percentile_index(n, p) -> Column:
    """Ascending index of the order statistic used throughout: clamp(p) * (n - 1) div 100."""
    return F.call_function("div", F.greatest(F.lit(0), F.least(F.lit(100), _c(p))).cast("bigint") * (_c(n).cast("bigint") - 1), F.lit(100).cast("bigint"))


def excess(flow, cap) -> Column:
    flow, cap = _c(flow).cast("double"), _c(cap).cast("double")
    return F.when(flow > cap, (flow - cap) / cap).otherwise(0.0)


def saturating_add(a, b, cap: int = IMPACT_CAP) -> Column:
    total = _c(a).cast("decimal(38,0)") + _c(b).cast("decimal(38,0)")
    return F.least(F.greatest(total, F.lit(0).cast("decimal(38,0)")), F.lit(cap).cast("decimal(38,0)")).cast("bigint")


def scale_percent(x, percent: int, cap: int = IMPACT_CAP) -> Column:
    """floor(x * percent / 100), saturating."""
    scaled = F.call_function("div", _c(x).cast("decimal(38,0)") * percent, F.lit(100).cast("decimal(38,0)"))
    return F.least(F.greatest(scaled.cast("bigint"), F.lit(0).cast("bigint")), F.lit(cap))


def scale_percent_rounded(x, percent: int) -> Column:
    """The slot variant: rounds half away from zero and saturates at the largest long."""
    scaled = F.floor((_c(x).cast("decimal(38,0)") * percent * 2 + 100) / 200)
    return F.least(scaled.cast("decimal(38,0)"), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("bigint")


def log_share(x, clip) -> Column:
    """log1p(min(x, clip)) / log1p(clip) in 0..1, all 0 where there is nothing to clip at."""
    x, clip = F.greatest(_c(x).cast("double"), F.lit(0.0)), _c(clip).cast("double")
    return F.when(clip <= 0, 0.0).otherwise(F.log1p(F.least(x, clip)) / F.log1p(clip))


def gate(load, gate_percent: int) -> Column:
    """0 below the gate, growing to 1 at full load; a gate below 0 or from 100 on is none."""
    if not 0 <= gate_percent < 100:
        return F.lit(1.0)
    g = gate_percent / 100
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(load) - g) / (1 - g)))


def buckets(enter, exit_, step: int) -> Column:
    """Numbers of the time buckets a stay touches; a stay lasts a second at least."""
    last = F.greatest(_c(exit_), _c(enter) + 1) - 1
    return F.sequence(F.floor(_c(enter) / step).cast("bigint"), F.floor(last / step).cast("bigint"))


def slot_of(t, width: int) -> Column:
    return F.when(_c(t) <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", _c(t).cast("bigint"), F.lit(width).cast("bigint")))


def cell_price(volume, cap, lam: float, horizon: float, edges: float) -> Column:
    """Price of a (edge, step) cell: exponential in its volume."""
    return F.pow(1 + 1 / (2 * lam * _c(cap)), _c(volume).cast("double")) / (2 * horizon * edges * _c(cap))


def cell_bound(cap) -> Column:
    return F.exp(F.lit(0.5)) / _c(cap)


def edge_score(distance_scaled, flow_scaled, alpha: int = 50) -> Column:
    """1 + the blend of distance and flow, both whole and scaled to a million."""
    return 1 + F.call_function("div", alpha * _c(distance_scaled) + (100 - alpha) * _c(flow_scaled), F.lit(100).cast("bigint"))


def order_score(degree, max_degree, flow_norm, beta: float = 0.5) -> Column:
    return (1 - beta) * _c(degree) / _c(max_degree) + beta * (1 - _c(flow_norm))


def safe_ratio(a, b, scale: float = 100.0) -> Column:
    """a / b * scale, null where b is 0."""
    return _c(a) / F.nullif(_c(b).cast("double"), F.lit(0.0)) * scale


def per(a, b) -> Column:
    """a / b, where b counts as 1 at least."""
    return _c(a) / F.greatest(_c(b), F.lit(1))


def place_of(value, order: list[str]) -> Column:
    """Place of a label in a fixed order, for sorting; labels that are not in it come last."""
    out = F.lit(len(order))
    for k, label in reversed(list(enumerate(order))):
        out = F.when(_c(value) == label, k).otherwise(out)
    return out


def dataset_group(dataset) -> Column:
    """The family of an experiment's data set name; other names stand for themselves."""
    d = _c(dataset)
    hop = F.regexp_extract(d, r"^(Hop\d+Rep\d+)-\d+$", 1)
    real = F.regexp_extract(d, r"^((?:BJ|MH)RealRep\d+)-\d+$", 1)
    return F.when(hop != "", hop).when(real != "", real).otherwise(d)


def dataset_parts(dataset) -> Column:
    """(hop, rep, seed); hop is -1 for real data; null for other names."""
    d = _c(dataset)
    pattern = r"^(?:Hop(\d+)Rep|(?:BJ|MH)RealRep)(\d+)-(\d+)$"
    hop = F.regexp_extract(d, pattern, 1)
    part = lambda k: F.regexp_extract(d, pattern, k).try_cast("int")
    return F.when(d.rlike(pattern), F.struct(F.coalesce(F.nullif(hop, F.lit("")).try_cast("int"), F.lit(-1)).alias("hop"), part(2).alias("rep"), part(3).alias("seed")))


def finite(text) -> Column:
    """Text as a finite double, else null."""
    v = _c(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


#: Formats tried in turn (fixed values); a trailing Z or offset is dropped first.
TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm")


def parsed_time(text) -> Column:
    bare = F.regexp_replace(F.trim(_c(text)), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in TIMES), bare.try_cast("timestamp"))


def rescaled(t, first, last, window: int) -> Column:
    """Linear rescale of departures into 0..window with banker's rounding; a span of 0 gives 0."""
    t, first, last = (_c(x).cast("double") for x in (t, first, last))
    return F.when(last <= first, F.lit(0).cast("bigint")).otherwise(F.rint((t - first) * window / (last - first)).cast("bigint"))


def interpolated(x, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the anchors, constant beyond the outermost."""
    x = _c(x)
    out = F.when(x <= anchors[0][0], float(anchors[0][1]))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(float(anchors[-1][1]))


def hash_order(key, seed: int) -> Column:
    """A reproducible random order: sampling, shuffling and slicing sort by it."""
    return F.xxhash64(F.lit(seed), _c(key))


def parse_percent(text: str) -> int:
    """With a point two decimals are kept ('0.15' is 15); without, 0 and 1 are fractions and larger numbers percent."""
    text = text.strip()
    if "." in text:
        whole, _, part = text.partition(".")
        return int(whole or 0) * 100 + int((part + "00")[:2])
    n = int(text)
    return n * 100 if n <= 1 else n


def parse_integer(text: str) -> int:
    """The whole number a text begins with ('4.0' is 4)."""
    return int(re.match(r"\s*[-+]?\d+", text)[0])


def parse_bool(text: str) -> bool:
    return text.strip() in {"1", "true", "True", "yes", "on"}


def column_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())
