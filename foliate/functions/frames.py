"""Structural similarity of grey frames (0 to 255, equal shape), and scaling. Cropping belongs to the decoding provider."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np

# Gaussian window and stabilisers.
SIZE, SIGMA, C1, C2 = 11, 1.5, 6.5025, 58.5225
ROWS = 16  # of a band of the blur
MOST_MOMENTS, MOST_SCORES = 32, 20_000  # remembered by a worker, 1.5 MB and 200 bytes each


@lru_cache(64)
def bands(n: int) -> list[tuple[slice, slice, np.ndarray]]:
    """The blur along an axis of n pixels as a banded matrix: rows out, rows in, and the weights of a band of rows."""
    half = SIZE // 2
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * SIGMA**2))
    kernel /= kernel.sum()
    at = np.pad(np.arange(n), half, mode="reflect")
    found = []
    for low in range(0, n, ROWS):
        high = min(low + ROWS, n)
        near = at[low : high + 2 * half]
        first = near.min()
        weights = np.zeros((high - low, near.max() + 1 - first))
        for k in range(SIZE):
            np.add.at(weights, (np.arange(high - low), near[k : k + high - low] - first), kernel[k])
        found.append((slice(low, high), slice(first, near.max() + 1), weights))
    return found


def blur(image: np.ndarray) -> np.ndarray:
    """Separable Gaussian with mirrored borders (the border pixel is not repeated)."""
    for _ in range(2):  # along columns, then, turned, along rows
        out = np.empty(image.shape)
        for to, of, weights in bands(len(image)):
            np.matmul(weights, image[of], out=out[to])
        image = out.T
    return image


def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A frame as floats, its local means and variances."""
    a = a.astype(np.float64)
    mean, var = blur(a), blur(a * a)
    var -= mean * mean
    return a, mean, var


def ssim_of(one: tuple, two: tuple) -> float:
    """Similarity of two frames' ``moments``, which a frame shares with both its neighbours."""
    (a, ma, va), (b, mb, vb) = one, two
    both, cov, squares, spread = ma * mb, blur(a * b), ma * ma, va + vb
    cov -= both
    squares += mb * mb
    for values, times, more in ((both, 2, C1), (cov, 2, C2), (squares, 1, C1), (spread, 1, C2)):
        values *= times
        values += more
    both *= cov
    squares *= spread
    both /= squares
    return float(both.mean())


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    return ssim_of(moments(a), moments(b))


# What a worker remembers, by the digests of a frame or of two, the oldest first.
_moments: dict[bytes, tuple] = {}
_scores: dict[bytes, float] = {}


def remembered(known: dict, most: int, key: bytes, make: Callable):
    """``make()``, or what it gave for this key, if that is among the latest ``most``."""
    if key in known:
        return known[key]
    value = make()
    if len(known) >= most:
        del known[next(iter(known))]
    known[key] = value
    return value


def successive(side: int) -> Callable[[int, int, bytes, bool], float | None]:
    """A function of one frame after the other (height, width, grey bytes, first of its film): similarity to the frame before, scaled to ``side``.

    Equal frames have 1. Films come back to the same pictures: the moments of a picture and the similarity of two are computed
    once, as long as the worker remembers them.
    """
    before = b"", ()

    def moments_of(digest: bytes, frame: tuple) -> tuple:
        height, width, pixels = frame
        return remembered(_moments, MOST_MOMENTS, digest, lambda: moments(resize(np.frombuffer(pixels, np.uint8).reshape(height, width), side)))

    def step(height: int, width: int, pixels: bytes, first: bool) -> float | None:
        nonlocal before
        if not 0 < height * width == len(pixels):
            raise ValueError(f"{len(pixels)} bytes for a frame of {height} x {width}")
        digest = blake2b(b"%d %d %d " % (side, height, width) + pixels, digest_size=16).digest()
        last, before = before, (digest, (height, width, pixels))
        if first:
            return None
        if digest == last[0]:
            return 1.0
        pair = min(digest, last[0]) + max(digest, last[0])
        return remembered(_scores, MOST_SCORES, pair, lambda: ssim_of(moments_of(*last), moments_of(*before)))

    return step


def resize(image: np.ndarray, side: int) -> np.ndarray:
    """A square of ``side`` pixels by bilinear interpolation between pixel centres, rounded to bytes."""
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return np.rint(image).astype(np.uint8)
