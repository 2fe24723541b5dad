"""Nearest-in-time joins with a tolerance.

Spark has no as-of join. Both sides are stacked, and two windows per (key, span) find the
closest right row before and after each left row. What lies across the edge of a span comes
in one of two ways. Where the tolerance is short against the span, right rows are copied
into the spans their tolerance reaches: one shuffle, no join, few copies. Else a summary
with the first and last right row of each span is carried along the spans of the key: no
row is copied, and the width of the spans, hence the work of a task, does not depend on the
tolerance. Either way a span is complete by itself, and no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.timing import Duration, interval, slot, to_micros
from .spans import DEFAULT_SPAN, SPAN

# Right rows are copied only where a span is at least so many tolerances wide.
SPANS_PER_TOLERANCE = 16


def span_width(tolerance_us: int, width: Duration | None = None) -> int:
    """Span width in µs: given, or a multiple of the tolerance in whole seconds up to the usual width."""
    if width is not None:
        return to_micros(width)
    seconds = -(-tolerance_us * SPANS_PER_TOLERANCE // 1_000_000)
    return min(max(seconds, 60) * 1_000_000, to_micros(DEFAULT_SPAN))


def reached_spans(moment: Column, reach_us: int, width_us: int) -> Column:
    """All spans that a row within ``reach_us`` of ``moment`` can lie in."""
    reach = interval(reach_us)
    return F.sequence(slot(moment - reach, width_us), slot(moment + reach, width_us))


def looking_back(keys: Sequence[str], time: str) -> WindowSpec:
    """Rows at or before the current time."""
    by = Window.partitionBy(*keys, SPAN)
    return by.orderBy(F.col(time).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def looking_ahead(keys: Sequence[str], time: str) -> WindowSpec:
    """Rows at or after the current time; descending order keeps the frame a growing one."""
    by = Window.partitionBy(*keys, SPAN)
    return by.orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def closer(moment: Column, before: Column, after: Column, time: str, tolerance_us: int) -> Column:
    """The nearer of two candidate structs, the earlier one on a tie, null beyond the tolerance."""
    reach = interval(tolerance_us)
    to_before = moment - before[time]
    to_after = after[time] - moment
    pick_before = before.isNotNull() & (after.isNull() | (to_before <= to_after))
    return F.when(pick_before & (to_before <= reach), before).when(~pick_before & (to_after <= reach), after)


def with_neighbours(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    sought: Mapping[str, Column],
    reach_us: Mapping[str, int],
    width_us: int,
) -> DataFrame:
    """Attach to each row the nearest rows of each sought kind around it, as ``_back_<kind>`` and ``_ahead_<kind>``.

    ``sought`` gives a struct for each kind, null on rows that are not of it; the structs stand
    in columns ``_<kind>``. A row at the very time of the current one counts as both. What
    lies beyond the reach of its kind may be missing.
    """
    kinds = rows.select("*", *[found.alias(f"_{kind}") for kind, found in sought.items()])
    home = slot(F.col(time), width_us)
    in_span = {
        f"_{side}_{kind}": F.last(f"_{kind}", ignorenulls=True).over(w)
        for side, w in (("back", looking_back(keys, time)), ("ahead", looking_ahead(keys, time)))
        for kind in sought
    }
    if all(width_us >= SPANS_PER_TOLERANCE * reach_us[kind] for kind in sought):
        reached = [F.when(F.col(f"_{k}").isNotNull(), reached_spans(F.col(time), reach_us[k], width_us)) for k in sought]
        spread = kinds.withColumn(SPAN, F.explode(F.coalesce(*reached, F.array(home))))
        return spread.withColumns(in_span).filter(F.col(SPAN).eqNullSafe(home))
    placed = kinds.withColumn(SPAN, home)
    edges = carried_edges(placed, keys, time, list(sought)).withColumnRenamed(SPAN, "_of_span")
    # A struct of the keys compares nulls as equal, and stays a key of a plain equality join.
    key = F.struct(*[F.col(k) for k in keys])
    searched = placed.withColumns(in_span).withColumn("_key", key)
    joined = searched.join(edges, (searched["_key"] == edges["_of_key"]) & F.col(SPAN).eqNullSafe(F.col("_of_span")))
    across = {
        f"_{side}_{kind}": F.coalesce(f"_{side}_{kind}", f"_edge_{side}_{kind}")
        for side in ("back", "ahead")
        for kind in sought
    }
    gone = ["_key", "_of_key", "_of_span", *[f"_edge_{side}_{kind}" for side in ("back", "ahead") for kind in sought]]
    return joined.withColumns(across).drop(*gone)


def carried_edges(rows: DataFrame, keys: Sequence[str], time: str, kinds: Sequence[str]) -> DataFrame:
    """Per (key, span) the last row of each kind in any span before, and the first in any span after."""
    key = F.struct(*[F.col(k) for k in keys]).alias("_of_key")
    at = {kind: F.when(F.col(f"_{kind}").isNotNull(), F.col(time)) for kind in kinds}
    per_span = rows.groupBy(key, SPAN).agg(
        *[F.min_by(f"_{kind}", at[kind]).alias(f"_first_{kind}") for kind in kinds],
        *[F.max_by(f"_{kind}", at[kind]).alias(f"_last_{kind}") for kind in kinds],
    )

    def nearest(order: Column) -> WindowSpec:
        return Window.partitionBy("_of_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    up, down = nearest(F.col(SPAN).asc()), nearest(F.col(SPAN).desc())
    return per_span.select(
        "_of_key",
        SPAN,
        *[F.last(f"_last_{kind}", ignorenulls=True).over(up).alias(f"_edge_back_{kind}") for kind in kinds],
        *[F.last(f"_first_{kind}", ignorenulls=True).over(down).alias(f"_edge_ahead_{kind}") for kind in kinds],
    )


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    tolerance: Duration,
    keys: Sequence[str] = ("run_id",),
    payload: Sequence[str] | None = None,
    left_time: str = "timestamp",
    right_time: str = "timestamp",
    matched_time: str = "matched_time",
    width: Duration | None = None,
) -> DataFrame:
    """Each left row with the nearest right row of its key; nulls where none is within tolerance.

    The tolerance is inclusive. Right rows must be unique per (key, time), as a pivoted
    source is. Adds ``matched_time`` and the payload columns.
    """
    tolerance_us = to_micros(tolerance)
    width_us = span_width(tolerance_us, width)
    names = [c for c in right.columns if c not in (*keys, right_time)] if payload is None else list(payload)

    left_rows = left.select(*keys, F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_left"))
    right_rows = right.select(
        *keys, F.col(right_time).alias("_at"), F.struct(F.col(right_time).alias("_at"), *names).alias("_found")
    )
    stacked = left_rows.unionByName(right_rows, allowMissingColumns=True)
    found = with_neighbours(stacked, keys, "_at", {"right": F.col("_found")}, {"right": tolerance_us}, width_us)
    nearest = closer(F.col("_at"), F.col("_back_right"), F.col("_ahead_right"), "_at", tolerance_us)
    return found.filter(F.col("_left").isNotNull()).select("_left", nearest.alias("_match")).select(
        "_left.*",
        F.col("_match._at").alias(matched_time),
        *[F.col("_match")[n].alias(n) for n in names],
    )


def snap_samples(
    samples: DataFrame,
    reference: DataFrame,
    tolerance: Duration,
    keys: Sequence[str] = ("run_id",),
    payload: Sequence[str] | None = None,
    time: str = "timestamp",
    width: Duration | None = None,
) -> DataFrame:
    """Place each sparse sample on its nearest reference time.

    Samples without a reference time in tolerance are left out. Where several land on one
    reference time the earliest sample is kept whole, nulls included. One row per
    (key, reference time) comes back, named like the samples' time column.
    """
    names = [c for c in samples.columns if c not in (*keys, time)] if payload is None else list(payload)
    placed = match_nearest(
        samples.select(*keys, time, *names),
        reference.select(*keys, time),
        tolerance,
        keys,
        payload=[],
        left_time=time,
        right_time=time,
        matched_time="_place",
        width=width,
    ).filter(F.col("_place").isNotNull())
    # Times are unique per key, so every column comes from the same, earliest sample.
    earliest = [F.min_by(name, "_drawn").alias(name) for name in names]
    return (
        placed.withColumnRenamed(time, "_drawn")
        .groupBy(*keys, F.col("_place").alias(time))
        .agg(*earliest)
    )
