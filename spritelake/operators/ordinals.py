"""Row numbers without a task that holds all rows, or all rows of a group.

Rows are sorted by range partitions of group and order, so a large group lies in several of
them.  A row's place in its partition comes from the sort; what lies before the partition is a
running sum of one count for each group and partition.  Only those counts meet in one task a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

_PART = 33  # bits of the place within a partition


def ordinals(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "ordinal", total: str | None = None) -> DataFrame:
    """``df`` with the row's number in ``order`` from 0, within each group if there are any; ``total`` names the group's rows.

    ``df`` is read twice (ranges are sampled first), so it should be a table or a cheap plan.
    Rows that are equal in ``order`` follow in any order, each with a number of its own; null
    groups are one group.  The ordered rows are a written table: later reads give the same numbers.
    """
    taken = {*df.columns, name, total}
    tie, place, part, shift, held = (next(c for k in range(len(taken) + 1) if (c := f"{base}{k or ''}") not in taken) for base in ("tie", "place", "part", "shift", "held"))
    keys = [F.col(f"`{c}`") for c in within]
    by = [*keys, *order, F.col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(ranged.drop(tie).withColumn(place, F.monotonically_increasing_id()))
    of = F.shiftright(place, _PART)
    counts = placed.groupBy(of.alias(part), *keys).agg(F.count(F.lit(1)).alias(held), F.min(place).alias(shift))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum(held).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    renamed = {c: f"{part}_{k}" for k, c in enumerate(within)}
    starts = counts.select(part, *(F.col(f"`{c}`").alias(x) for c, x in renamed.items()), (before - F.col(shift)).alias(shift), F.sum(held).over(group).alias(held))
    same = of == starts[part]
    for c, x in renamed.items():
        same &= placed[f"`{c}`"].eqNullSafe(starts[x])
    own = [placed[f"`{c}`"] for c in df.columns]
    return placed.join(starts, same).select(*own, (F.col(place) + F.col(shift)).alias(name), *([F.col(held).alias(total)] if total else []))
