"""Image encoders: a plain bundled one, and any other by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np

#: Squares along a side, over each of which the bundled encoder averages.
SQUARES = 4


def pooled(tensors: np.ndarray) -> np.ndarray:
    """Mean and deviation of each band over a grid of squares, of tensors (n, 6, frames, side, side).

    It needs no weights; a learnt encoder does better.
    """
    n, bands, _, side, _ = tensors.shape
    step = side // SQUARES
    v = tensors[:, :, 0, : step * SQUARES, : step * SQUARES].reshape(n, bands, SQUARES, step, SQUARES, step)
    return np.concatenate([v.mean((3, 5)).reshape(n, -1), v.std((3, 5)).reshape(n, -1)], 1)


def load(name: str | None) -> Callable[[np.ndarray], np.ndarray]:
    """The encoder ``module:function``, which executors must be able to import; without a name the bundled one."""
    if not name:
        return pooled
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)
