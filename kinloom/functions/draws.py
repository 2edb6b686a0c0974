"""Random draws as hashes of a seed and keys: the same on any partitioning and on retry, and the same in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw; 13 fill a double's fraction.
DIGITS = 13


def uniform(seed: int, *keys) -> Column:
    """In [0, 1): the first DIGITS of the MD5 of seed and keys as text, joined by bars. Null keys count as empty text."""
    cols = [F.coalesce(k.cast("string"), F.lit("")) if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same draw in DuckDB; keys are SQL expressions."""
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)])
    return f"(CAST(('0x' || substr(md5({text}), 1, {DIGITS})) AS BIGINT)::DOUBLE / {16**DIGITS}::DOUBLE)"


def weighted(u: Column, weights: dict) -> Column:
    """The key whose range of cumulative weights u falls into."""
    total, upto, out = sum(weights.values()), 0.0, None
    for key, w in weights.items():
        upto += w / total
        out = F.when(u < upto, F.lit(key)) if out is None else out.when(u < upto, F.lit(key))
    return out.otherwise(F.lit(list(weights)[-1]))


def weighted_sql(u: str, weights: dict) -> str:
    total, upto, out = sum(weights.values()), 0.0, []
    for key, w in weights.items():
        upto += w / total
        out.append(f"WHEN {u} < {upto!r}::DOUBLE THEN {key!r}")
    return f"CASE {' '.join(out)} ELSE {list(weights)[-1]!r} END"


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))
