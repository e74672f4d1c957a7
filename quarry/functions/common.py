"""Small deterministic column helpers shared by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up  # noqa: F401 (re-export)

# Fixed values of the reproducible split.
SPLIT_MULT = 2654435761
SPLIT_SEED = 42
SPLIT_PRIME = 1_000_003
SPLIT_TEST_PCT = 20


def split_bucket(id_col) -> Column:
    """0 to 99 from an id: a multiplicative hash of the id's residue (so that it
    never overflows a bigint), its upper bits taken mod 100. Ids in equal
    steps spread over all buckets."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.pmod(F.pmod(c, F.lit(SPLIT_PRIME)) * F.lit(SPLIT_MULT) + F.lit(SPLIT_SEED), F.lit(1 << 32))
    return F.pmod(F.shiftright(h, 16), F.lit(100))


def is_test(id_col, pct: int = SPLIT_TEST_PCT) -> Column:
    return split_bucket(id_col) < pct


def split_bucket_sql(e: str) -> str:
    return f"(((((({e}) % {SPLIT_PRIME}) * {SPLIT_MULT} + {SPLIT_SEED}) % {1 << 32}) // 65536) % 100)"
