"""Separable linear transforms of fixed-shape maps, Arrow batch by Arrow batch.

A map is one row holding its flat row-major array, so a transform is a narrow operation: no
explode, no shuffle, one dense matrix product per batch.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_ARRAY = T.ArrayType(T.DoubleType())


def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix: row k is mode k."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    basis = np.sqrt(2.0 / n) * np.cos(np.pi * (i + 0.5) * k / n)
    basis[0] /= np.sqrt(2.0)
    return basis


def gaussian_basis(n: int, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalised Gaussian kernel of radius ``truncate * sigma`` with half-sample reflection."""
    radius = int(truncate * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    weights /= weights.sum()
    out = np.zeros((n, n))
    for row in range(n):
        at = (row + offsets) % (2 * n)
        np.add.at(out[row], np.where(at < n, at, 2 * n - 1 - at), weights)
    return out


def _stack(values: pd.Series, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Batch of complete maps; maps with missing cells are reported as not usable."""
    flat = np.full((len(values), rows * cols), np.nan)
    for at, v in enumerate(values):
        if v is not None and len(v) == rows * cols:
            flat[at] = np.asarray(v, dtype=float)
    usable = np.isfinite(flat).all(axis=1)
    return np.where(usable[:, None], flat, 0.0).reshape(-1, rows, cols), usable


def _emit(cube: np.ndarray, usable: np.ndarray) -> pd.Series:
    flat = cube.reshape(len(cube), -1)
    return pd.Series([row if ok else None for row, ok in zip(flat, usable)])


def separable(z: Column, left: np.ndarray, right: np.ndarray) -> Column:
    """left @ map @ right^T for every map."""
    rows, cols = left.shape[1], right.shape[1]

    @F.pandas_udf(_ARRAY)
    def apply(values: pd.Series) -> pd.Series:
        cube, usable = _stack(values, rows, cols)
        return _emit(left @ cube @ right.T, usable)

    return apply(z)


def dct2(z: Column, rows: int, cols: int) -> Column:
    return separable(z, dct_basis(rows), dct_basis(cols))


def band_filter(z: Column, rows: int, cols: int, pitch: float, lo: float, hi: float) -> Column:
    """Inverse DCT of the coefficients with wavelength in [lo, hi); DC counts as infinite."""
    fy = np.arange(rows) / (2 * rows * pitch)
    fx = np.arange(cols) / (2 * cols * pitch)
    freq = np.hypot(fy[:, None], fx[None, :])
    lam = np.divide(1.0, freq, out=np.full(freq.shape, np.inf), where=freq > 0)
    keep = (lam >= lo) & ((lam < hi) | np.isinf(hi))
    by, bx = dct_basis(rows), dct_basis(cols)

    @F.pandas_udf(_ARRAY)
    def apply(values: pd.Series) -> pd.Series:
        cube, usable = _stack(values, rows, cols)
        return _emit(by.T @ ((by @ cube @ bx.T) * keep) @ bx, usable)

    return apply(z)


def smooth(z: Column, rows: int, cols: int, sigma: float) -> Column:
    return separable(z, gaussian_basis(rows, sigma), gaussian_basis(cols, sigma))


def hann_power(z: Column, rows: int, cols: int) -> Column:
    """Power of the centred, Hann-windowed DFT divided by the window energy."""
    window = np.outer(np.hanning(rows), np.hanning(cols))

    @F.pandas_udf(_ARRAY)
    def apply(values: pd.Series) -> pd.Series:
        cube, usable = _stack(values, rows, cols)
        centred = cube - cube.mean(axis=(1, 2), keepdims=True)
        return _emit(np.abs(np.fft.fft2(centred * window)) ** 2 / (window**2).sum(), usable)

    return apply(z)


def band_and_direction(z: Column, rows: int, cols: int, pitch: float, bands, directions, theta_bins: int) -> Column:
    """struct(energies, directional) per complete map, NULL otherwise, in one pass over the batch.

    ``energies``: cosine-transform energy of each of ``bands``.  ``directional``: for each of ``directions``
    the axial order, angular entropy and energy of the Hann-windowed power, the first two NULL without energy.
    The band and angle of a mode are fixed for a raster, so every sum is a product with a fixed matrix.
    """
    window = np.outer(np.hanning(rows), np.hanning(cols))
    by, bx = dct_basis(rows), dct_basis(cols)
    wavelength = lambda fy, fx: 1 / np.maximum(np.hypot(fy[:, None], fx[None, :]), 1e-300)  # noqa: E731  the constant mode is in no band
    within = lambda lam, lo, hi: ((lam >= lo) & (lam < hi) & (lam < 1e299)).ravel().astype(float)
    lam = wavelength(np.arange(rows) / (2 * rows * pitch), np.arange(cols) / (2 * cols * pitch))
    member = np.column_stack([within(lam, lo, hi) for _, lo, hi in bands])
    fy, fx = np.fft.fftfreq(rows, pitch), np.fft.fftfreq(cols, pitch)
    theta = np.arctan2(fy[:, None], fx[None, :]).ravel()
    sector = np.minimum(np.floor(np.mod(theta, np.pi) / (np.pi / theta_bins) + 1e-9), theta_bins - 1).astype(int)
    sectors = np.eye(theta_bins)[sector]
    axial = np.column_stack([np.cos(2 * theta), np.sin(2 * theta)])

    @F.pandas_udf("energies array<double>, directional array<array<double>>")
    def apply(values: pd.Series) -> pd.DataFrame:
        cube, usable = _stack(values, rows, cols)
        energies = ((by @ cube @ bx.T).reshape(len(cube), -1) ** 2) @ member
        power = np.abs(np.fft.fft2((cube - cube.mean(axis=(1, 2), keepdims=True)) * window)).reshape(len(cube), -1) ** 2 / (window**2).sum()
        found = []
        for _, lo, hi in directions:
            inside = power * within(wavelength(fy, fx), lo, hi)
            total, turned, parts = inside.sum(axis=1), inside @ axial, inside @ sectors
            some = total > 0
            safe = np.where(some, total, 1.0)
            entropy = (np.log(safe) - np.where(parts > 0, parts * np.log(np.maximum(parts, 1e-300)), 0.0).sum(axis=1) / safe) / np.log(theta_bins)
            order = np.hypot(turned[:, 0], turned[:, 1]) / safe
            found.append([(a, e, t) if ok else (None, None, t) for ok, a, e, t in zip(some, order, entropy, total)])
        return pd.DataFrame({"energies": _emit(energies, usable), "directional": [[list(f[i]) for f in found] if ok else None for i, ok in enumerate(usable)]})

    return apply(z)


def autocorrelation(z: Column, rows: int, cols: int) -> Column:
    """Periodic autocorrelation (lag products summed over the map), lag (0,0) first."""

    @F.pandas_udf(_ARRAY)
    def apply(values: pd.Series) -> pd.Series:
        cube, usable = _stack(values, rows, cols)
        return _emit(np.fft.ifft2(np.abs(np.fft.fft2(cube)) ** 2).real, usable)

    return apply(z)


def phase_only(z: Column, rows: int, cols: int, eps: float = 1e-12) -> Column:
    """Map rebuilt from unit-modulus Fourier coefficients with the DC term removed."""

    @F.pandas_udf(_ARRAY)
    def apply(values: pd.Series) -> pd.Series:
        cube, usable = _stack(values, rows, cols)
        spectrum = np.fft.fft2(cube)
        spectrum = spectrum / (np.abs(spectrum) + eps)
        spectrum[:, 0, 0] = 0.0
        return _emit(np.fft.ifft2(spectrum).real, usable)

    return apply(z)
