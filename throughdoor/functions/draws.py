"""Seeded draws that depend on a row key and a salt, never on row order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2.0**52


def uniform(row_key, salt) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(key|salt)."""
    key = F.col(row_key) if isinstance(row_key, str) else row_key
    tail = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat_ws("|", key.cast("string"), tail.cast("string")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(_STEPS)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count belonging to the uniform ``u``."""
    term, upto, marks = 2.718281828459045**-1, 0.0, []
    for k in range(18):
        term = term / k if k else term
        upto += term
        marks.append(upto)
    count = F.lit(0)
    for m in marks:
        count = count + (u >= F.lit(m)).cast("int")
    return count
