"""Scalar formulas of the process and geometry vocabulary."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Pulse power in watts, class intervals on r = peak / spacing, cycle levels, field of view.
POWER_W = 5.3333
CLASS_INTERVALS = [("m1", 0.75, 1.25), ("m2", 1.75, 2.25), ("m3", 2.75, 3.25)]
CYCLES_HIGH, CYCLES_LOW, FIELD_OF_VIEW = 2.0, 1.2, 17.834048


def process_coordinates(v: Column, f: Column, h: Column, n: Column, power: float = POWER_W) -> dict[str, Column]:
    return {
        "pulse_pitch": v / f, "areal_pulses": 1e6 * n * f / (v * h),
        "pulse_energy": 1000 * power / f, "areal_dose": 1000 * power * n / (v * h),
    }


def condition_key(parts: Sequence[Column], digits: int = 6) -> Column:
    return F.concat_ws(":", *[decimal_text(p, digits) for p in parts])


def decimal_text(value: Column, digits: int = 6) -> Column:
    """Exact decimal text with trailing zeros stripped."""
    text = value.cast(f"decimal(28,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def integer_distance(r: Column, targets: Sequence[int] = (1, 2, 3)) -> Column:
    return F.least(*[F.abs(r - t) for t in targets])


def axis_distance(theta: Column, period: float = 90.0) -> Column:
    m = F.pmod(theta, F.lit(period))
    return F.least(m, period - m)


def assign_class(r: Column, valid: Column) -> Column:
    out = F.when(~valid | r.isNull() | F.isnan(r), "INVALID")
    for name, lo, hi in CLASS_INTERVALS:
        out = out.when(r.between(lo, hi), name)
    return out.otherwise("OUT")


def cycles_level(wavelength: Column, fov: Column | float = FIELD_OF_VIEW) -> Column:
    cycles = fov / wavelength
    return F.when(cycles >= CYCLES_HIGH, "HIGH").when(cycles >= CYCLES_LOW, "LOW").otherwise("UNMEASURABLE")


def half_power_wavelength(sigma: Column) -> Column:
    return F.lit(2 * math.pi / math.sqrt(math.log(2))) * sigma


def saturate(s: Column, d: Column) -> Column:
    return d * (1 - F.exp(-s / d))


def wrap_axial(theta: Column) -> Column:
    """Fold an axis angle into (-90, 90]."""
    return 90 - F.pmod(90 - theta, F.lit(180.0))


def box_to_global(cx: Column, cy: Column, u: Column, v: Column, theta: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return cx + u * c - v * s, cy + u * s + v * c


def box_to_local(cx: Column, cy: Column, x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s


def view_length(width: Column, height: Column, theta: Column, margin: float) -> Column:
    c, s = F.abs(F.cos(F.radians(theta))), F.abs(F.sin(F.radians(theta)))
    return F.greatest(width * c + height * s, width * s + height * c) + 2 * margin


def array_transfer(k: Column, h: Column, n: Column) -> Column:
    """Power of n equal lines with pitch h at frequency k (cycles taken modulo 1 for stability)."""
    cycles = F.pmod(k * h, F.lit(1.0))
    steps = F.sequence(F.lit(0), (n - 1).cast("int"))
    part = lambda fn: F.aggregate(steps, F.lit(0.0), lambda acc, m: acc + fn(2 * math.pi * cycles * m))
    re, im = part(F.cos), part(F.sin)
    return re * re + im * im
