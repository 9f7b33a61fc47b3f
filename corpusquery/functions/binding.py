"""Small building blocks for higher-order column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of the blocks a running fold is cut into.  A fold that appends to an
# array copies it once per step, so folding block by block keeps a line with
# hundreds of thousands of matches close to linear.
FOLD_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer column expression is evaluated again for every
    element.  Binding it as a lambda variable avoids that, and the optimizer
    cannot inline it away.
    """
    return F.transform(F.array(value), body).getItem(0)


def let2(first: Column, second: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``let`` for two values."""
    return let(first, lambda a: let(second, lambda b: body(a, b)))


def indices(values: Column) -> Column:
    """1-based positions of an array; an empty array gives an empty array."""
    size = F.size(values)
    return F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """Inclusive running fold: element k combines ``start`` with elements 1..k.

    ``step`` must be associative (sum, greatest) and keep the element type.
    """

    def fold(block: Column, seed: Column) -> Column:
        grown = F.aggregate(
            block,
            F.array(seed),
            lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, F.lit(-1)), x))),
        )
        return F.slice(grown, 2, F.size(block))

    def fold_blocks(bound: Column) -> Column:
        last_block = F.floor((F.size(bound) - 1) / FOLD_BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last_block),
            lambda b: F.slice(bound, b * FOLD_BLOCK + 1, FOLD_BLOCK),
        )

        def stitch(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, start, step))
            # Seed of block k is everything before it.
            seeds = F.aggregate(
                totals,
                F.array(start),
                lambda acc, t: F.concat(acc, F.array(step(F.element_at(acc, F.lit(-1)), t))),
            )
            return F.flatten(
                F.zip_with(parts, F.slice(seeds, 1, F.size(parts)), lambda p, seed: fold(p, seed))
            )

        return let(blocks, stitch)

    return let(
        values,
        lambda bound: F.when(F.size(bound) <= FOLD_BLOCK, fold(bound, start)).otherwise(
            fold_blocks(bound)
        ),
    )
