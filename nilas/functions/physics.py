"""Derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.nulls import clip

ICE_DENSITY = 917.0


def speed(u: Column, v: Column) -> Column:
    """Magnitude in single precision, as fields are stored."""
    return F.hypot(u, v).cast("float")


def specific_humidity(dew_point: Column, pressure: Column) -> Column:
    """Saturation humidity at the dew point (K, Pa), by the Magnus form over water."""
    vapour = 611.21 * F.exp(17.502 * (dew_point - 273.16) / (dew_point - 32.19))
    ratio = 287.0597 / 461.5250
    return ratio * vapour / (pressure - (1 - ratio) * vapour)


def rain(total: Column, snow: Column) -> Column:
    return clip(total - snow, 0.0, float("inf"))


def strain(df: DataFrame) -> Column:
    """The first of sigP, hypot(divu, shear) and |shear| that the table can give."""
    have = set(df.columns)
    if "sigP" in have:
        return F.col("sigP")
    if {"divu", "shear"} <= have:
        return F.hypot("divu", "shear")
    return F.abs("shear") if "shear" in have else F.lit(None).cast("double")


def mean_of_known(*values: Column) -> Column:
    """Mean of the values that aren't NULL."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n)


def drag_terms(hi: Column, aice: Column, mag: Column, air: Column, ocean: Column, internal: Column, u: Column) -> dict[str, Column]:
    """Lateral drag, its share of the other stresses, and its power."""
    tau = ICE_DENSITY * hi * aice * mag
    return {"tau_ld_est": tau, "R_ld_budget": tau / (air + ocean + internal + F.lit(1e-12)), "P_ld_est": tau * u}


#: The x and y components of the stresses of the momentum balance.
STRESSES = {"tau_air": "strair", "tau_ocean": "strocn", "tau_internal": "strint", "tau_coriolis": "strcor", "tau_tilt": "strtlt"}


def diagnostic_inputs(name: str) -> list[str]:
    """Columns that a diagnostic term can read; of strain and lateral drag, those that are there."""
    if name in STRESSES:
        return [f"{STRESSES[name]}x", f"{STRESSES[name]}y"]
    kux, kuy = ["KuxE", "KuxN"], ["KuyE", "KuyN"]
    return {
        "ice_speed": ["uvel", "vvel"], "rel_ice_ocean_speed": ["uvel", "vvel", "uocn", "vocn"], "strain_invariant": ["sigP", "divu", "shear"],
        "ld_x_proxy": kux, "ld_y_proxy": kuy, "ld_mag_proxy": [*kux, *kuy], "tau_ld_est": ["hi", *kux, *kuy], "P_ld_est": ["hi", "uvel", "vvel", *kux, *kuy],
        "R_ld_budget": ["hi", *kux, *kuy, *[f"{STRESSES[n]}{c}" for n in ("tau_air", "tau_ocean", "tau_internal") for c in "xy"]],
    }[name]


def diagnostic(name: str, have: set[str]) -> Column:
    """A diagnostic term of the momentum balance from the columns that are there; without its inputs, an error."""
    wanted = diagnostic_inputs(name)
    x, y = [F.col(c).cast("double") for c in wanted if c.startswith("Kux") and c in have], [F.col(c).cast("double") for c in wanted if c.startswith("Kuy") and c in have]
    missing = [c for c in wanted if c not in have and c[:3] not in ("Kux", "Kuy")]
    if name == "strain_invariant":
        missing = [] if have & {"sigP", "shear"} else missing
    elif not x and (name in ("ld_x_proxy", "P_ld_est") or name in ("ld_mag_proxy", "tau_ld_est", "R_ld_budget") and not y):
        missing.append("KuxE or KuxN")
    if not y and name in ("ld_y_proxy", "P_ld_est"):
        missing.append("KuyE or KuyN")
    if missing:
        raise ValueError(f"{name} needs columns that aren't there: {', '.join(missing)}")
    size = lambda a, b: F.hypot(F.col(a).cast("double"), F.col(b).cast("double"))
    if name in STRESSES:
        return size(*wanted)
    if name == "ice_speed":
        return size("uvel", "vvel")
    if name == "rel_ice_ocean_speed":
        u, v = (F.col(f"{c}vel").cast("double") - F.col(f"{c}ocn").cast("double") for c in "uv")
        return F.hypot(u, v)
    if name == "strain_invariant":
        return F.col("sigP") if "sigP" in have else size("divu", "shear") if "divu" in have else F.abs("shear")
    px, py = mean_of_known(*x) if x else None, mean_of_known(*y) if y else None
    if name in ("ld_x_proxy", "ld_y_proxy"):
        return px if name == "ld_x_proxy" else py
    mag = F.hypot(px, py) if x and y else F.abs(px if x else py)
    if name == "ld_mag_proxy":
        return mag
    mass = ICE_DENSITY * F.col("hi").cast("double") * F.col("aice").cast("double")
    if name == "P_ld_est":
        return mass * px * F.col("uvel") + mass * py * F.col("vvel")
    tau = mass * mag
    return tau if name == "tau_ld_est" else tau / (sum((size(f"{STRESSES[n]}x", f"{STRESSES[n]}y") for n in ("tau_air", "tau_ocean", "tau_internal")), F.lit(0.0)) + F.lit(1e-12))


def persistence_difference(model: Column, obs: Column, tol: float = 1e-6) -> Column:
    """Model minus observation in [-1, 1]; NULL where both are nothing."""
    return F.when(~((F.abs(model) <= tol) & (F.abs(obs) <= tol)), clip(model - obs, -1.0, 1.0))


def agreement(diff: Column, limit: float = 0.5) -> Column:
    """0 agreement (limits included), 1 model excess, 2 observation excess."""
    return F.when(diff > limit, 1).when(diff < -limit, 2).when(diff.isNotNull(), 0)


def opacity(model: Column, obs: Column, mode: str = "max", start: float = 0.0, gamma: float = 1.0) -> Column:
    w = {"max": F.greatest(model, obs), "mean": (model + obs) / 2, "product": F.sqrt(model * obs)}[mode]
    return F.pow(clip((w - start) / (1.0 - start), 0.0, 1.0), F.lit(gamma))


def form_factor(value: Column, most: float | None = None) -> Column:
    """Non-negative and finite."""
    x = F.greatest(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return x if most is None else F.least(x, F.lit(most))


def combine(a: Column, b: Column, how: str) -> Column:
    return {"max": F.greatest(a, b), "mean": (a + b) / 2, "sum": a + b}[how]
