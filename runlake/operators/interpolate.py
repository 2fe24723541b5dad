"""Linear interpolation of a dense series at given times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import Duration, seconds_between
from .nearest import looking_ahead, looking_back
from .spans import DEFAULT_SPAN, SPAN, cut


def interpolate_at(
    points: DataFrame,
    series: DataFrame,
    value: str,
    keys: Sequence[str] = ("run_id",),
    time: str = "timestamp",
    name: str = "interpolated",
    width: Duration = DEFAULT_SPAN,
) -> DataFrame:
    """Each point with the series' value at its time, held constant beyond both ends.

    ``series`` has one row per (key, time). Points of a key without a series get null.

    Neighbours may lie arbitrarily far away, so every span is handed the last series row
    before it and the first one after it, taken from a summary of one row per span.
    """
    known = series.filter(F.col(value).isNotNull())
    knots = cut(known, width, time).select(
        *keys, SPAN, F.col(time).alias("_at"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_knot")
    )
    asked = cut(points, width, time).select(
        *keys, SPAN, F.col(time).alias("_at"), F.struct(*points.columns).alias("_point")
    )
    edges = knots.groupBy(*keys, SPAN).agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
    wanted = asked.select(*keys, SPAN).distinct()
    in_order = Window.partitionBy(*keys).orderBy(SPAN)
    before = F.last("_last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy(*keys).orderBy(F.col(SPAN).desc())
    after = F.last("_first", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        wanted.withColumn("_asked", F.lit(True))
        .join(edges, [*keys, SPAN], "full_outer")
        .withColumns({"_before": before, "_after": after})
        .filter("_asked")
        .select(*keys, SPAN, F.explode(F.array("_before", "_after")).alias("_knot"))
        .filter(F.col("_knot").isNotNull())
        .select(*keys, SPAN, F.col("_knot.t").alias("_at"), "_knot")
    )
    stacked = knots.unionByName(carried).unionByName(asked, allowMissingColumns=True)
    found = stacked.withColumns(
        {
            "_lo": F.last("_knot", ignorenulls=True).over(looking_back(keys, "_at")),
            "_hi": F.last("_knot", ignorenulls=True).over(looking_ahead(keys, "_at")),
        }
    ).filter(F.col("_point").isNotNull())
    share = seconds_between(F.col("_at"), F.col("_lo.t")) / seconds_between(F.col("_hi.t"), F.col("_lo.t"))
    between = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * share
    at = (
        F.when(F.col("_lo").isNull(), F.col("_hi.v"))
        .when(F.col("_hi").isNull() | (F.col("_hi.t") == F.col("_lo.t")), F.col("_lo.v"))
        .otherwise(between)
    )
    return found.select("_point.*", at.alias(name))
