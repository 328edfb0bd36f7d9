"""Row-level functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column | str, fill: float = 0.0) -> Column:
    """Coerced to double; what isn't a number becomes fill."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(fill)).otherwise(x)


def label(c: str) -> Column:
    """Coerced to 0..1; null counts 0."""
    return F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(F.col(c).try_cast("int"), F.lit(0))))


def mass_residual(demand: Column, flow: Column, n: Column) -> Column:
    f = flow * F.greatest(n, F.lit(1))
    return F.abs(demand - f) / (F.abs(demand) + F.abs(f) + 1e-9) * 2


def expected_ratio(normals: DataFrame) -> DataFrame:
    """(ratio): median of pressure deviation over flow deviation, clipped; 1.0 when empty."""
    r = F.least(F.lit(1e6), F.greatest(F.lit(0.0), F.col("pressure_std") / (F.col("flow_std") + 1e-9)))
    return normals.agg(F.coalesce(F.median(r), F.lit(1.0)).alias("ratio"))


def energy_residual(pressure_std: Column, flow_std: Column, ratio: Column) -> Column:
    own = pressure_std / (flow_std + 1e-9)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.abs(own - ratio) / (ratio + 1e-9)))


def with_plausibility(df: DataFrame, ratio: float | Column) -> DataFrame:
    """Adds mass, energy, violation (pressure beyond 10..105) and plausibility = exp(-mass - energy), 0 for a violation."""
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    out = df.withColumn("mass", mass_residual(F.col("demand_sum"), F.col("flow_abs_mean"), F.col("observed_count"))).withColumn("energy", energy_residual(F.col("pressure_std"), F.col("flow_std"), ratio))
    out = out.withColumn("violation", ((F.col("pressure_min") < 10) | (F.col("pressure_max") > 105)).cast("int"))
    return out.withColumn("plausibility", F.exp(-F.col("mass") - F.col("energy")) * (1 - F.col("violation")))


def triage_features(df: DataFrame) -> DataFrame:
    """Adds pressure_range, head_gap, demand_flow_ratio, pressure_flow_ratio, coverage-adjusted residuals and interactions."""
    cover = F.greatest(F.col("sensor_coverage"), F.lit(1e-6))
    return df.withColumns({
        "pressure_range": F.col("pressure_max") - F.col("pressure_min"),
        "head_gap": F.col("pressure_mean") - F.col("pressure_min"),
        "demand_flow_ratio": F.col("demand_sum") / F.greatest(F.abs(F.col("flow_abs_mean")), F.lit(1e-6)),
        "pressure_flow_ratio": F.col("pressure_std") / F.greatest(F.col("flow_std"), F.lit(1e-9)),
        "mass_by_coverage": F.col("mass") / cover,
        "energy_by_coverage": F.col("energy") / cover,
        "score_by_plausibility": F.col("base_score") * F.col("plausibility"),
        "score_by_mass": F.col("base_score") * F.col("mass"),
    })


def heuristic_triage_score() -> Column:
    return 0.45 * F.col("base_score") + 0.25 * F.col("plausibility") - 0.15 * F.col("mass") - 0.10 * F.col("energy") + 0.05 * F.col("sensor_coverage")


def triage_bucket(base: Column, plausibility: Column) -> Column:
    return F.when((base >= 0.5) & (plausibility >= 0.5), "likely_physical").when(base >= 0.5, "suspicious_implausible").otherwise("likely_false_alarm")


def pipe_resistance(length: Column, roughness: Column, diameter: Column) -> Column:
    """10.67 L / (C^1.852 D^4.87): missing or zero D counts 0.001, C 100, with floors 1e-6 and 1e-3."""
    d = F.greatest(F.coalesce(F.nullif(diameter, F.lit(0.0)), F.lit(0.001)), F.lit(1e-6))
    c = F.greatest(F.coalesce(F.nullif(roughness, F.lit(0.0)), F.lit(100.0)), F.lit(1e-3))
    return 10.67 * length / (F.pow(c, F.lit(1.852)) * F.pow(d, F.lit(4.87)))


def effective_duration(d: Column) -> Column:
    return F.when(d <= 0, 86400).otherwise(d)


def effective_step(s: Column) -> Column:
    return F.when((s <= 0) | (s > 3600), 3600).otherwise(s)


def event_window(duration: Column, step: Column, r1: Column | None = None, r2: Column | None = None) -> Column:
    """struct(start, end): fixed at one and two thirds, or sampled by r1, r2 in 0..1; end is always after start."""
    if r1 is None or r2 is None:
        start = F.floor(duration / 3)
        return F.struct(start.alias("start"), F.greatest(start + 1, F.floor(duration * 2 / 3)).alias("end"))
    most = F.greatest(step, F.floor(duration / 2))
    start = F.least(F.floor(step + r1 * (most - step)), F.greatest(F.lit(0), duration - step))
    length = F.floor(duration / 6 + r2 * (duration / 3 - duration / 6))
    return F.struct(start.alias("start"), F.greatest(start + 1, F.least(start + length, duration)).alias("end"))


def unit_hash(*parts: Column) -> Column:
    """A uniform number in 0..1 from the first eight hex digits of an md5, equal in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def demand_multiplier(demand: Column, *parts: Column) -> Column:
    """Normal(1, 0.2) clipped to 0.5..2 by hash (Box-Muller) where demand is positive, else 1."""
    u, v = F.greatest(unit_hash(*parts, F.lit("u")), F.lit(1e-12)), unit_hash(*parts, F.lit("v"))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return F.when(demand > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1 + 0.2 * z))).otherwise(1.0)


def emitter_coefficient(area: Column) -> Column:
    return 0.75 * area * math.sqrt(2 * 9.81)


def sigmoid_score(error: Column, threshold: Column) -> Column:
    return 1 / (1 + F.exp(-(error - threshold) / F.greatest(threshold, F.lit(1e-9))))


def net_seed(seed: Column, net: Column, salt: Column) -> Column:
    return F.pmod(seed.cast("long") * 1000003 + F.crc32(net) + salt, F.lit((1 << 31) - 1))
