"""Result shape shared by a query and its SQL twin: column order, types and rounding.

A shape is text such as "lineage:s n_cells:i share:d kept:b".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Moves exact halves of the last decimal off the rounding edge, where the order of a sum would decide.
NUDGE = 2e-10


def columns(shape: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in shape.split()]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    make = {"s": lambda c: c.cast("string"), "i": lambda c: c.cast("bigint"), "b": lambda c: c.cast("boolean"),
            "d": lambda c: F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)}
    return df.select(*[make[t](F.col(n)).alias(n) for n, t in columns(shape)])


def shaped_sql(parts: list[str], source: str, shape: str) -> str:
    make = {"s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "b": "CAST({0} AS BOOLEAN)",
            "d": "round(CAST({0} AS DOUBLE) + " + f"{NUDGE}" + ", 6) + 0.0"}
    picked = ", ".join(f"{make[t].format(n)} AS {n}" for n, t in columns(shape))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {picked} FROM {source}"
