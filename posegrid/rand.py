"""Seeded order and draws that do not depend on the engine: the first 32 bits of md5(seed|key)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str, *key: Column | str) -> Column:
    """An integer of 0 to 2^32 - 1 from the seed and the key's text."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *key: Column | str) -> Column:
    """A double in [0, 1)."""
    return seeded(seed, *key) / F.lit(4294967296.0)


def sql_seeded(seed: int | str, *key: str) -> str:
    """The same in DuckDB's SQL."""
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 8)) AS BIGINT)"
