"""Seeded integer hashing built from 64-bit arithmetic.

Every random choice in the engine (sampling, shuffling, picking users) is a
function of row values and a seed. A task that is run again after an executor is
lost therefore repeats its choices exactly, and any SQL engine can recompute them.

Columns are folded linearly modulo one prime and then pass two quadratic rounds
modulo two primes. Each round names its input twice, so the expression stays small
however many columns go in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two primes just below 2**31 and multipliers below them.
PRIME_A = 2_147_483_647
PRIME_B = 2_147_483_629
FOLD = 1_000_003
SHIFT_A = 1_664_525_021
SHIFT_B = 1_013_904_223


def seeded_hash_sql(seed: int, *values: str) -> str:
    """SQL text of :func:`seeded_hash`."""
    x = f"{seed % PRIME_A}L"
    for v in values:
        x = f"pmod({x} * {FOLD}L + bigint({v}), {PRIME_A}L)"
    x = f"({x} * ({x} + {SHIFT_A}L) % {PRIME_B}L)"
    return f"({x} * ({x} + {SHIFT_B}L) % {PRIME_A}L)"


def seeded_hash(seed: int, *values: str) -> Column:
    """BIGINT in [0, 2**31) that depends on ``seed`` and every value, in order.

    Values are column names or SQL expressions of an integer type.
    """
    return F.expr(seeded_hash_sql(seed, *values))
