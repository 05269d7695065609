"""Parameters that the queries and their SQL counterparts share.

Factor tables and network weights are simple functions of the indices in multiples
of 1/8, so dot products and their ties are exact in any engine.
"""

from __future__ import annotations

import numpy as np

# Fixed values.
MIN_USER = 20
MIN_ITEM = 20
DRIFT_EPOCH = 900_000_000
MF_DIM = 8
MF_INTERCEPT = -0.25
NCF_DIM = 4
NCF_UNITS = (4, 2)
NCF_EPSILON = 1e-3
SCALE = 8.0
SAMPLE_ROWS = 5_000
CAPPED_USERS = 150
SPLIT_SEED = 7
PASS_DIM = 4
PASS_BLOCKS = 4
PASS_STEP = 0.05
PASS_L2 = 0.01
LOOP_EPOCHS = 2
LONG_HISTORY = 80
HOT_ITEM = 40


def _grid(rows: int, cols: int, a: int, b: int, modulus: int) -> np.ndarray:
    i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return ((i * a + j * b) % modulus - modulus // 2) / SCALE


def dense_weights() -> list[dict[str, np.ndarray]]:
    """Weights of every hidden layer, by position only."""
    widths = [2 * NCF_DIM, *NCF_UNITS]
    layers = []
    for depth, (inputs, units) in enumerate(zip(widths, widths[1:], strict=False)):
        unit = np.arange(units)
        layers.append(
            {
                "weights": _grid(inputs, units, 3 + depth, 5, 7),
                "bias": (unit % 3) / SCALE,
                "scale": 1.0 + unit / SCALE,
                "shift": -unit / SCALE,
                "mean": unit / SCALE,
                "variance": 1.0 + unit,
            }
        )
    return layers


def output_weights() -> np.ndarray:
    return _grid(1, NCF_DIM + NCF_UNITS[-1], 1, 3, 7)[0]


OUTPUT_BIAS = 0.125


def vector_terms(side: str, dim: int) -> list[tuple[int, int, int]]:
    """(multiplier, addend, modulus) of each component: ((id * m + a) % q - q // 2) / 8."""
    if side == "user":
        return [(2 * d + 3, d, 17) for d in range(dim)]
    return [(3 * d + 5, 2 * d, 19) for d in range(dim)]
