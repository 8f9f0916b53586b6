"""Linear hashing as column expressions, and the coefficients it needs.

All arithmetic is BIGINT with ``pmod``: the argument is reduced modulo ``p``
before it is multiplied, so neither large nor negative ids can overflow or
produce a negative colour, column or sign.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default prime modulus of every hash.
PRIME = 8191

# p below 2^31 keeps a*x+b below 2^62.
MAX_PRIME = 2**31


def _check_prime(p: int) -> None:
    if not 2 <= p <= MAX_PRIME:
        raise ValueError(f"p must be in [2, {MAX_PRIME}], got {p}")


def check_coefficients(a: int, b: int, p: int = PRIME) -> None:
    """Raise ValueError unless a is in [1, p-1] and b in [0, p-1]."""
    _check_prime(p)
    if not (1 <= a < p and 0 <= b < p):
        raise ValueError(f"need 1 <= a < {p} and 0 <= b < {p}, got a={a}, b={b}")


def check_positive(**values: int) -> None:
    """Raise ValueError for the first named value that is below 1."""
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be positive, got {value}")


def linear_hash(x: Column, a: int, b: int, p: int = PRIME) -> Column:
    """``(a*x + b) mod p`` as BIGINT in [0, p)."""
    return F.pmod(
        F.pmod(x.cast("bigint"), F.lit(p).cast("bigint")) * F.lit(a).cast("bigint")
        + F.lit(b).cast("bigint"),
        F.lit(p).cast("bigint"),
    )


def bucket_hash(x: Column, a: int, b: int, buckets: int, p: int = PRIME) -> Column:
    """``((a*x + b) mod p) mod buckets``: a vertex colour or a sketch column."""
    return F.pmod(linear_hash(x, a, b, p), F.lit(buckets).cast("bigint"))


def sign_hash(x: Column, a: int, b: int, p: int = PRIME) -> Column:
    """+1 where ``(a*x + b) mod p`` is odd, else -1."""
    odd = F.pmod(linear_hash(x, a, b, p), F.lit(2).cast("bigint")) == 1
    return F.when(odd, F.lit(1).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def draw_runs(runs: int, seed: int, p: int = PRIME) -> tuple[tuple[int, int], ...]:
    """One reproducible ``(a, b)`` pair per run."""
    check_positive(runs=runs)
    _check_prime(p)
    rng = random.Random(seed)
    return tuple((rng.randrange(1, p), rng.randrange(p)) for _ in range(runs))


@dataclass(frozen=True)
class SketchParams:
    """Shape and hash coefficients of a count sketch.

    ``rows`` holds one ``(ah, bh, ag, bg)`` tuple per sketch row: the column
    hash and the sign hash.
    """

    width: int
    rows: Sequence[tuple[int, int, int, int]]
    p: int = PRIME

    def __post_init__(self) -> None:
        object.__setattr__(self, "rows", tuple(tuple(row) for row in self.rows))
        check_positive(depth=len(self.rows), width=self.width)
        for ah, bh, ag, bg in self.rows:
            check_coefficients(ah, bh, self.p)
            check_coefficients(ag, bg, self.p)

    @property
    def depth(self) -> int:
        return len(self.rows)

    @classmethod
    def draw(cls, depth: int, width: int, seed: int, p: int = PRIME) -> SketchParams:
        """Reproducible coefficients for a ``depth x width`` sketch."""
        check_positive(depth=depth, width=width)
        _check_prime(p)
        rng = random.Random(seed)
        rows = [
            (rng.randrange(1, p), rng.randrange(p), rng.randrange(1, p), rng.randrange(p))
            for _ in range(depth)
        ]
        return cls(width, rows, p)
