"""Names, aliases and settings that live on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

#: The spellings of methods, hemispheres and frequencies.
METHODS = {
    "raw": "raw", "daily": "raw", "day": "raw",
    "bin-days": "binary-days", "binary-days": "binary-days", "binary_days": "binary-days", "binary": "binary-days", "bin": "binary-days",
    "roll-mean": "rolling-mean", "rolling-mean": "rolling-mean", "rolling_mean": "rolling-mean", "rolling": "rolling-mean", "roll": "rolling-mean",
}
HEMISPHERES = {"sh": "SH", "south": "SH", "southern": "SH", "s": "SH", "nh": "NH", "north": "NH", "northern": "NH", "n": "NH"}
FREQUENCIES = {
    "d": "daily", "day": "daily", "days": "daily", "daily": "daily", "h": "hourly", "hour": "hourly", "hours": "hourly", "hourly": "hourly",
    "inst": "hourly", "instantaneous": "hourly",
}
#: B grid with missing corners kept, B grid with them as 0, by a regridder, and C grid.
GRID_TYPES = ("Ta", "Tb", "Tx", "Tc")

#: How the partitions of stores are named, by frequency.
STORES = {"daily": "%Y-%m", "hourly": "%Y_%m_%d"}

#: The named longitude and latitude boxes, edges included.
REGIONS = (
    ("DML", -19.0, 18.0, -80.0, -60.0),
    ("WIO", 27.0, 71.0, -80.0, -60.0),
    ("EIO", 74.0, 103.0, -80.0, -60.0),
    ("Aus", 103.0, 146.0, -80.0, -60.0),
    ("VOL", 146.0, 172.0, -80.0, -60.0),
    ("AS", -158.0, -102.0, -80.0, -60.0),
    ("BS", -102.0, -60.0, -80.0, -60.0),
    ("WS", -60.0, -27.0, -80.0, -60.0),
)


def canonical(value: str, names: dict[str, str], what: str) -> str:
    try:
        return names[value.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown {what}: {value!r}") from None


def method(value: str) -> str:
    return canonical(value, METHODS, "method")


def hemisphere(value: str) -> str:
    return canonical(value, HEMISPHERES, "hemisphere")


def frequency(value: str | None) -> str:
    """Daily unless something else is named."""
    return canonical((value or "daily").replace("_", "-"), FREQUENCIES, "frequency")


def grid_types(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """Ways to bring velocities to cell centres, distinct and in order; Tc unless something is named, and only alone."""
    tokens = value.replace(",", " ").split() if isinstance(value, str) else [str(v).strip() for v in value or ()]
    out = tuple(dict.fromkeys(t[0].upper() + t[1:] for t in tokens if t)) or ("Tc",)
    if unknown := [t for t in out if t not in GRID_TYPES]:
        raise ValueError(f"unknown grid type: {unknown[0]!r}")
    if "Tc" in out and len(out) > 1:
        raise ValueError("grid type Tc can't be joined with others")
    return out


def threshold_tag(value: float, decimals: int = 1) -> str:
    """5e-4 as '5.0e-4', without decimals as '5e-4'."""
    mantissa, power = f"{value:.{decimals}e}".split("e")
    return f"{mantissa}e{int(power)}"


def method_folder(name: str, cls: Classification) -> str:
    """The folder of a method and its settings."""
    kind = method(name)
    if kind == "binary-days":
        return f"bin-win-{cls.window:02d}_bin-min-{cls.least:02d}"
    return kind if kind == "raw" else f"roll-days-{cls.mean_window}"


def method_slug(name: str) -> str:
    return method(name).replace("-", "_")


def natural_key(text: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", text)]


@dataclass(frozen=True)
class Classification:
    """What turns fields into ice types."""

    concentration: float = 0.15
    speed: float = 5e-4
    window: int = 11
    least: int = 9
    mean_window: int = 15

    @property
    def padding_days(self) -> int:
        """Days to read besides those asked for, so that windows at the edges are full."""
        return max(self.window, self.mean_window) // 2


#: The names of metrics.
DOMAINS = {"F": "fast", "P": "pack", "S": "sea"}
CORE = ("IA", "IV", "IT", "IP", "IS", "ITVR", "IMVR", "ITAR", "IMAR")
SPATIAL = ("IHI", "IST", "ITVR_YR", "IMVR_YR", "ITAR_YR", "IMAR_YR")
REGIONAL = ("IA_by_region", "IT_by_region")
SUMMARY = tuple(f"I{v}_{s}_{m}" for v in "AT" for s in ("max", "min", "doy_max", "doy_min") for m in ("mean", "std"))
STRESS = tuple(f"IKu{c}_{m}" for c in ("xE", "yE", "xN", "yN", "E_mag", "N_mag") for m in ("mean", "abs_mean", "valid_area_m2"))
DIAGNOSTICS = (
    "ice_speed", "rel_ice_ocean_speed", "strain_invariant", "tau_air", "tau_ocean", "tau_internal", "tau_coriolis", "tau_tilt",
    "ld_x_proxy", "ld_y_proxy", "ld_mag_proxy", "tau_ld_est", "R_ld_budget", "P_ld_est",
)
DIAGS = tuple(f"I_{n}_mean" for n in DIAGNOSTICS)
#: Whole names, of fast ice only.
STABILITY = ("FIPSI", "persistent_winter_area", "ever_winter_area")
SKILL = tuple(f"{v}_{s}" for v in ("FIA", "FIT") for s in ("Bias", "RMSE", "MAE", "Corr"))
GROUPS = {"core": CORE, "spatial": SPATIAL, "regional": REGIONAL, "summary": SUMMARY, "stress": STRESS, "diags": DIAGS}
SPECIFIC = STABILITY + SKILL


def metric_names(names: tuple[str, ...] = (), groups: tuple[str, ...] = (), default: str = "F:core") -> list[str]:
    """Ordered distinct metric names; a group is 'F:core', 'S:stress' and so on, 'F:spec' of fast ice only."""
    out: dict[str, None] = dict.fromkeys(names)
    for g in groups or (() if names else (default,)):
        domain, _, group = g.partition(":")
        if g == "F:spec":
            out |= dict.fromkeys(SPECIFIC)
            continue
        if domain not in DOMAINS or group not in GROUPS:
            raise ValueError(f"unknown metric group: {g!r}")
        out |= dict.fromkeys(domain + n for n in GROUPS[group])
    return list(out)


def by_domain(names: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in names:
        domain = "F" if n in SPECIFIC else n[:1]
        if domain not in DOMAINS:
            raise ValueError(f"unknown metric domain: {n!r}")
        out.setdefault(domain, []).append(n)
    return out
