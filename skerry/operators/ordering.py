"""Dense numbers in an order, without bringing all rows into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import workspace

_IN_PARTITION = 33  # bits of monotonically_increasing_id that count rows within a partition


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", first: int = 0) -> DataFrame:
    """``rows`` with ``name``: their places in ``order``, counted from ``first``.

    Rows are dealt to ranges of the order, sorted there and written with their places within the range;
    what precedes a range is a sum over the sizes of those before it, of which the driver has one number
    each.  ``order`` should end in a key: rows that it doesn't tell apart stand in one range, in any order.
    Only the columns of ``rows`` are written, so pass keys and join what is wide.
    """
    at = name
    while at.lower() in {c.lower() for c in rows.columns}:
        at += "_"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = workspace.materialize(placed, "numbered")
    part = F.shiftright(at, _IN_PARTITION).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)), initial=first))
    base = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), part)
    number = base + F.col(at).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], number.alias(name))
