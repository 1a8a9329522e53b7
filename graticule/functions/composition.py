"""Five-part compositions: closure, zero replacement and orthonormal log-ratio coordinates."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The four sequential balances over (short, 8-16, 16-32, 32-64, long).
BALANCES = [
    [math.sqrt(6 / 5) * w for w in (1 / 2, 1 / 2, -1 / 3, -1 / 3, -1 / 3)],
    [math.sqrt(1 / 2) * w for w in (1, -1, 0, 0, 0)],
    [math.sqrt(2 / 3) * w for w in (0, 0, 1, -1 / 2, -1 / 2)],
    [math.sqrt(1 / 2) * w for w in (0, 0, 0, 1, -1)],
]
TINY = 1e-300


def closure(parts: Sequence[Column]) -> list[Column]:
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def zero_replaced(parts: Sequence[Column], threshold: float, delta: float) -> tuple[list[Column], Column]:
    """Parts below ``threshold`` become ``delta``; rows are closed again only if any changed."""
    hit = [p < threshold for p in parts]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    filled = closure([F.when(h, F.lit(delta)).otherwise(p) for h, p in zip(hit, parts)])
    return [F.when(any_hit, f).otherwise(p) for f, p in zip(filled, parts)], any_hit


def ilr(parts: Sequence[Column]) -> list[Column]:
    logs = [F.log(F.greatest(p, F.lit(TINY))) for p in parts]
    out = []
    for row in BALANCES:
        terms = [F.lit(w) * lg for w, lg in zip(row, logs) if w]
        out.append(sum(terms[1:], terms[0]))
    return out


def ilr_inverse(z: Sequence[Column]) -> list[Column]:
    raw = []
    for part in range(5):
        terms = [F.lit(BALANCES[k][part]) * z[k] for k in range(4) if BALANCES[k][part]]
        raw.append(F.exp(sum(terms[1:], terms[0])))
    return closure(raw)


def aitchison(a: Sequence[Column], b: Sequence[Column]) -> Column:
    squares = [(x - y) * (x - y) for x, y in zip(ilr(a), ilr(b))]
    return F.sqrt(sum(squares[1:], squares[0]))
