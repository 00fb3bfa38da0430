"""Running totals that never put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {
    "sum": (F.sum, lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))),
    "max": (F.max, F.greatest),
}


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   totals: dict[str, Column], cells: Sequence[Column], how: str = "sum",
                   inclusive: bool = True) -> DataFrame:
    """Per row, the total over all rows of its key up to (and, if ``inclusive``, with) itself.

    One window over a hot key would sort that key in a single task. Here the order is cut into
    ``cells``: numbers, coarse to fine, that never decrease along ``order`` (a minute of the event
    time, say). Rows are summed within ``keys + cells`` only, and each cell then receives the total
    of the cells before it: windows over pre-aggregated cells, coarse to fine, added up there. Rows meet
    these totals in one join. The largest task holds one finest cell, or the list of cells inside one
    coarser cell, whichever is greater.

    ``keys`` must not be null. ``how`` is ``sum`` or ``max``.
    """
    aggregate, join_up = _COMBINE[how]
    names = [f"_cell{i}" for i in range(len(cells))]
    parts = {name: f"_part_{name}" for name in totals}
    # Rows without an order value sort first; so does their cell.
    numbers = [F.coalesce(c.cast("bigint"), F.lit(-2**63)) for c in cells]
    base = df.withColumns({**dict(zip(names, numbers)), **{parts[n]: c for n, c in totals.items()}})

    summed = base.groupBy(*keys, *names).agg(
        *[aggregate(parts[name]).alias(parts[name]) for name in totals])
    offsets = None
    tables = [summed]       # finest first; each coarser one is summed from the one below
    for depth in range(len(names) - 1, 0, -1):
        tables.append(tables[-1].groupBy(*keys, *names[:depth]).agg(
            *[aggregate(parts[name]).alias(parts[name]) for name in totals]))
    for depth, cells_of in enumerate(reversed(tables)):
        on = [*keys, *names[:depth + 1]]
        before = (Window.partitionBy(*on[:-1]).orderBy(on[-1])
                  .rowsBetween(Window.unboundedPreceding, -1))
        here = cells_of.select(*on, *[aggregate(parts[n]).over(before).alias(f"_here_{n}") for n in totals])
        if offsets is not None:
            here = here.join(offsets, on[:-1])
            here = here.select(*on, *[join_up(F.col(f"_here_{n}"), F.col(f"_before_{n}")).alias(f"_here_{n}")
                                      for n in totals])
        offsets = here.withColumnsRenamed({f"_here_{n}": f"_before_{n}" for n in totals})

    # The window needs the rows as the join has dealt them: they are shuffled once.
    within = (Window.partitionBy(*keys, *names).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    if offsets is None:
        return base.withColumns({n: aggregate(parts[n]).over(within) for n in totals}).drop(*parts.values())
    return (base.join(offsets, [*keys, *names], "left")
            .withColumns({n: join_up(aggregate(parts[n]).over(within), F.col(f"_before_{n}")) for n in totals})
            .drop(*names, *parts.values(), *[f"_before_{n}" for n in totals]))
