"""Random numbers from counters: a draw is a hash of the seed, the row's key and the number of the draw.

A draw does not depend on partitions, order or retries, and SQL can repeat it: the first 13 hex digits of
``md5('seed|key|...|draw')`` as a share of 2^52.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def share(digest: Column, start: int = 1) -> Column:
    """13 hex digits from ``start`` on as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("double") / float(2**52)


def poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson draw of mean 1, up to the last that a double below 1 can hold."""
    steps, term = [math.exp(-1)], math.exp(-1)
    for k in range(1, 40):
        term /= k
        total = steps[-1] + term
        if total >= 1 - 2.0**-52 or total == steps[-1]:
            break
        steps.append(total)
    return steps


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def poisson(uniform: Column) -> Column:
    """How many steps a uniform draw has passed."""
    return once(uniform, lambda u: sum(((u >= s).cast("int") for s in poisson_steps()), F.lit(0)))
