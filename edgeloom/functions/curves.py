"""Space-filling curve keys as column expressions, and the sizes that go with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the curve: a row a state, for the bits (x, y) = 00, 01, 10, 11 the quadrant's place along the curve and
# the state inside it.
HILBERT = (
    ((0, 1), (1, 0), (3, 2), (2, 0)),
    ((0, 0), (3, 3), (1, 1), (2, 1)),
    ((2, 2), (1, 2), (3, 0), (0, 3)),
    ((2, 3), (3, 1), (1, 3), (0, 2)),
)
# The same, packed for shifts: for state s and bits (x, y), field 2 * (4 * s + 2 * x + y) of two bits.
HILBERT_DIGITS, HILBERT_STATES = (sum(cell[i] << 2 * (4 * s + b) for s, row in enumerate(HILBERT) for b, cell in enumerate(row)) for i in (0, 1))
# The masks that spread 21 bits to every third position, each with the shift before it.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
MORTON_BITS = 21
MOST_ORDER = 31


def power_of_two(n: int) -> int:
    """The smallest power of two that is at least ``n`` and at least 2."""
    return max(2, 1 << max(0, n - 1).bit_length())


def curve_order(n: int) -> int:
    """Levels of the curve over ``n`` vertices."""
    return power_of_two(n).bit_length() - 1


def block_width_fits(n: int, width: int) -> bool:
    """Whether ``width`` leaves at least eight blocks of vertices."""
    return width <= n // 8


def widest_block(n: int) -> int:
    """The width to use where a wider one doesn't fit."""
    return power_of_two(n // 16)


def check_block_width(n: int, width: int) -> None:
    if not block_width_fits(n, width):
        raise ValueError(f"block width {width} is too large for {n} vertices; use {widest_block(n)}")


def _order(order: int) -> int:
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"the order must be from 1 to {MOST_ORDER}")
    return order


def hilbert_key(x: Column | str, y: Column | str, order: int) -> Column:
    """Hilbert index of cell (x, y) on the 2 ** order grid, from (0, 0) to (2 ** order - 1, 0); all in the JVM."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"))

    def step(done: Column, bit: Column) -> Column:
        bx, by = (F.call_function("shiftright", c.cast("long"), bit).bitwiseAND(F.lit(1)) for c in (x, y))
        field = (done["s"] * 8 + bx * 4 + by * 2).cast("int")
        digit, state = (F.call_function("shiftright", F.lit(v).cast("long"), field).bitwiseAND(F.lit(3)) for v in (HILBERT_DIGITS, HILBERT_STATES))
        return F.struct((done["h"] * 4 + digit).alias("h"), state.alias("s"))

    return F.aggregate(F.sequence(F.lit(_order(order) - 1), F.lit(0), F.lit(-1)), start, step, lambda done: done["h"])


def hilbert_index(x: int, y: int, order: int) -> int:
    """The same of one cell, on the driver; of order 0 the whole grid is one cell."""
    h = state = 0
    for bit in range(order - 1, -1, -1):
        digit, state = HILBERT[state][2 * (x >> bit & 1) + (y >> bit & 1)]
        h = 4 * h + digit
    return h


def hilbert_key_batches(order: int):
    """The same as an Arrow batch function, quicker where the key is all that is computed: ``f(x, y)``."""
    _order(order)

    @F.pandas_udf("long")
    def key(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.to_numpy(np.int64), y.to_numpy(np.int64)
        h, state = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for bit in range(order - 1, -1, -1):
            field = 8 * state + 4 * (a >> bit & 1) + 2 * (b >> bit & 1)
            h, state = 4 * h + (HILBERT_DIGITS >> field & 3), HILBERT_STATES >> field & 3
        return pd.Series(h)

    return key


def hilbert_key_classic(x: Column | str, y: Column | str, order: int) -> Column:
    """The textbook form: a bit a level, with the quadrant's flip and transposition after it."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(done: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        rx, ry = ((done[c].bitwiseAND(side) > 0).cast("long") for c in ("x", "y"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, side - 1 - done[c].bitwiseAND(side - 1)).otherwise(done[c].bitwiseAND(side - 1)) for c in ("x", "y"))
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct(nx.alias("x"), ny.alias("y"), (done["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(_order(order) - 1), F.lit(0), F.lit(-1)), start, step, lambda done: done["d"])


def spread_by_three(a: Column) -> Column:
    """The low 21 bits, each to every third position."""
    spread = a.cast("long").bitwiseAND(F.lit((1 << MORTON_BITS) - 1))
    for shift, mask in SPREAD:
        spread = F.transform(F.array(spread), _spreader(shift, mask))[0]  # binds the value, which is used twice
    return spread


def _spreader(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))


def morton_key(x: Column | str, y: Column | str) -> Column:
    """Interleaved bits with a gap bit after each pair; ids of 2 ** 21 and more give null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    fits = F.greatest(x, y) < (1 << MORTON_BITS)
    return F.when(fits, spread_by_three(x).bitwiseOR(F.shiftleft(spread_by_three(y), 1)))
