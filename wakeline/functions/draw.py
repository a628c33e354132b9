"""Random draws as hashes of keys: they repeat, and any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str, seed: int) -> Column:
    """In (0, 1): the leading 52 bits of md5 over the parts as text, joined by colons."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform_sql(*parts: str, seed: int) -> str:
    """The same in SQL."""
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"((CAST('0x' || substr(md5({text} || ':{seed}'), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"
