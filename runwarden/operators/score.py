"""Severity of detections, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities by class and subclass (null subclass: any), caps and floors.
S_TYPE = {
    ("D_exec", "undeclared"): 1.00,
    ("D_hash", "modified"): 1.00,
    ("D_load", "undeclared"): 0.85,
    ("D_write", None): 0.80,
    ("D_hash", "relocated"): 0.70,
    ("D_cap", None): 0.60,
    ("D_net", None): 0.55,
    ("D_exec", "outside_closure"): 0.25,
    ("D_load", "outside_closure"): 0.25,
}
UNKNOWN, BINDING, WEAK_CAP, BEHAVIOUR_CAP = 0.5, 60, 34, 59
FLOORS = ((80, "critical"), (60, "high"), (35, "medium"))


def s_type(cls: Column, sub: Column) -> Column:
    out = F.lit(UNKNOWN)
    for (c, s), v in S_TYPE.items():
        if s is None:
            out = F.when(cls == c, v).otherwise(out)
    for (c, s), v in S_TYPE.items():
        if s is not None:
            out = F.when((cls == c) & (sub == s), v).otherwise(out)
    return out


def rho(declared: Column, package: Column, depth: Column) -> Column:
    return F.when(~declared, 1.0).when(package.isNull() | depth.isNull() | (depth < 0), 0.5).otherwise(depth / (depth + 1.0))


def kappa(privileged: Column, run_as_root: Column, bound: Column) -> Column:
    """Without a binding, root; an explicit null is not root."""
    return F.when(bound & privileged, 1.0).when(~bound | F.coalesce(run_as_root, F.lit(False)), 0.5).otherwise(0.2)


def to_score(s: Column) -> Column:
    return F.floor(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)) + 0.5 + 1e-9).cast("int")


def severity(cls: Column, sub: Column, origin: Column, r: Column, k: Column) -> Column:
    return 0.4 * s_type(cls, sub) + 0.2 * F.when(origin == "AUTHENTICATED", 1.0).otherwise(0.5) + 0.4 * (0.5 * r + 0.5 * k)


def score(cls: Column, sub: Column, s: Column) -> Column:
    weak = cls.isin("D_exec", "D_load") & (sub == "outside_closure")
    return F.when(cls == "binding", BINDING).when(weak, F.least(to_score(s), F.lit(WEAK_CAP))).otherwise(to_score(s))


def behaviour(g: Column, s_c: Column) -> Column:
    return F.least(to_score(0.6 * g + 0.4 * s_c), F.lit(BEHAVIOUR_CAP))


def g_of(detail: Column) -> Column:
    """g parsed from a detail text; 1 if it has none."""
    m = F.regexp_extract(F.coalesce(detail, F.lit("")), r"g_I\s+([0-9]*\.?[0-9]+)", 1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(m.try_cast("double"), F.lit(1.0))))


def bucket(score_col: Column) -> Column:
    out = F.lit("low")
    for floor, name in reversed(FLOORS):
        out = F.when(score_col >= floor, name).otherwise(out)
    return out
