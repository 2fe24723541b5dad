"""Ordered work over long series, cut into time spans.

A window over a whole run puts that run into one task. Here a series is cut into spans of
fixed width, ordered work happens inside (key, span), and the little that must cross a span
edge comes from a summary with one row per (key, span). How large the summary of a key
gets depends on how long the key lasts, not on how densely it was logged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.timing import Duration, seconds_between, slot, to_micros

SPAN = "_span"
DEFAULT_SPAN = "6h"


def cut(df: DataFrame, width: Duration = DEFAULT_SPAN, time: str = "timestamp") -> DataFrame:
    return df.withColumn(SPAN, slot(F.col(time), to_micros(width)))


def with_span_context(
    df: DataFrame,
    keys: Sequence[str],
    summary: Sequence[Column],
    context: Callable[[WindowSpec], Sequence[Column]],
) -> DataFrame:
    """Attach to each row of a cut frame what its span needs to know about earlier spans.

    ``summary`` condenses each span; ``context`` turns the summaries, in span order, into
    the columns to attach.
    """
    per_span = df.groupBy(*keys, SPAN).agg(*summary)
    in_order = Window.partitionBy(*keys).orderBy(SPAN)
    attached = per_span.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, SPAN)], *context(in_order))
    # null-safe: rows without a key or a time belong to a series, or span, of their own
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, SPAN)]
    return df.join(attached, same).drop(*[f"_of_{k}" for k in (*keys, SPAN)])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    time: str = "timestamp",
    width: Duration = DEFAULT_SPAN,
) -> DataFrame:
    """Row number 1, 2, ... of each key in time order (``order`` must start with the time)."""
    placed = with_span_context(
        cut(df, width, time),
        keys,
        [F.count(F.lit(1)).alias("_rows")],
        lambda w: [
            F.coalesce(
                F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before")
        ],
    )
    inside = Window.partitionBy(*keys, SPAN).orderBy(*order)
    return placed.withColumn(name, F.row_number().over(inside) + F.col("_before")).drop(SPAN, "_before")


def every_nth(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("timestamp",),
    width: Duration = DEFAULT_SPAN,
) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of each series."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = numbered(df, keys, order, "_position", order[0], width)
    return rows.filter(F.pmod(F.col("_position") - 1, F.lit(n)) == 0).drop("_position")


def reading_gaps(
    df: DataFrame, keys: Sequence[str], time: str = "timestamp", width: Duration = DEFAULT_SPAN
) -> DataFrame:
    """Seconds from each reading to the one before it, as (keys, gap_s, readings) counts.

    The first reading of a key has no gap. Repeated times count as gaps of zero.
    """
    moments = cut(df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_rows")), width, time)
    placed = with_span_context(
        moments,
        keys,
        [F.max(time).alias("_last")],
        lambda w: [F.lag("_last").over(w).alias("_carried")],
    )
    inside = Window.partitionBy(*keys, SPAN).orderBy(time)
    before = F.coalesce(F.lag(time).over(inside), F.col("_carried"))
    gaps = placed.withColumn("_gap", seconds_between(F.col(time), before))
    both = F.array(
        F.struct(F.col("_gap").alias("gap_s"), F.lit(1).cast("bigint").alias("readings")),
        F.struct(F.lit(0.0).alias("gap_s"), (F.col("_rows") - 1).alias("readings")),
    )
    return (
        gaps.select(*keys, F.inline(both))
        .filter(F.col("gap_s").isNotNull() & (F.col("readings") > 0))
        .groupBy(*keys, "gap_s")
        .agg(F.sum("readings").alias("readings"))
    )
