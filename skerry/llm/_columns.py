"""Small helpers for plans of DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(make: Callable[..., Column], **columns: Column) -> Column:
    """What ``make`` builds of ``columns``, each computed once, however often it occurs there."""
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return F.get(F.transform(F.array(one), lambda s: make(**{name: s[name] for name in columns})), F.lit(0))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, behind a generator: what uses them can't repeat their expressions."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    made = unused(df.columns, "made")
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.explode(F.array(one)).alias(made)).select(*kept, f"{made}.*")


def unused(columns: list[str], name: str) -> str:
    """``name`` with underscores until no column is called so (names don't tell capitals apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
