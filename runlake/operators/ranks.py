"""Exact medians of groups too large for one task, by radix selection.

Spark's exact ``percentile`` keeps all distinct values of a group in one place. Here equal
values are counted first. A value has an order-preserving 64-bit form, the one of IEEE
doubles with the sign folded in; its first 24 bits are the coarse prefix, its first 44 the
fine one. Counts per prefix say which prefix holds a rank, and only what shares that prefix
is looked at more closely: the coarse prefixes of a group, the fine prefixes of one coarse
prefix, the values of one fine prefix. Each step is partitioned by the prefix before it, so
no task holds more than 2^20 counts of a step (2^24 for the coarse one), however the values
of a group lie: nearly equal values differ in their fine prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits below the two prefixes.
COARSE_BITS, FINE_BITS = 40, 20


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that rises with it; both zeros give 0, NaN the largest.

    Built from exponent and mantissa, as Spark has no function for the bits. Powers of two
    and divisions by them are exact; only the logarithm may be off by one, which is mended.
    """
    size = F.abs(value)
    near = F.least(F.floor(F.log2(size)), F.lit(1023)).cast("int")
    two = F.lit(2.0)
    exponent = near - (F.pow(two, near) > size).cast("int") + (F.pow(two, near + 1) <= size).cast("int")
    mantissa = size / F.pow(two, exponent) - 1
    normal = ((exponent + 1023).cast("bigint") * F.lit(1 << 52)) + (mantissa * float(1 << 52)).cast("bigint")
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    infinite = F.lit(2047 << 52)
    bits = (
        F.when(F.isnan(value), infinite + 1)
        .when(size == float("inf"), infinite)
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return bits * F.when(value < 0, -1).otherwise(1)


def from_bits(bits: Column) -> Column:
    """The double of :func:`ordered_bits`; minus zero comes back as zero."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52).cast("int")
    part = (size.bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    value = (
        F.when(bits.isNull(), F.lit(None).cast("double"))
        .when(exponent == 0, part * 2.0**-1022)
        .when(exponent < 2047, (part + 1) * F.pow(F.lit(2.0), exponent - 1023))
        .when(part == 0, float("inf"))
        .otherwise(float("nan"))
    )
    return value * F.when(bits < 0, -1.0).otherwise(1.0)


def last_value(order: Column, value: Column) -> Column:
    """Aggregate: the value of the largest ``order`` (a long); of equal orders the larger value.

    Both are packed in one decimal, whose ``max`` is a hash aggregation, where ``max_by`` of a
    struct would sort all rows. Rows without a value do not count, nor do those without an order.
    """
    wide, half = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    packed = order.cast("decimal(19,0)") * wide + (ordered_bits(value).cast("decimal(20,0)") + half)
    top = F.max(packed.cast("decimal(38,0)"))
    rest = top - F.floor(top / wide) * wide
    return from_bits((rest - half).cast("bigint"))


def _counts(df: DataFrame, keys: Sequence[str], value: str, times: Column) -> DataFrame:
    """How often each value occurs, with its two prefixes."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_n"))
    bits = ordered_bits(F.col(value).cast("double"))
    return counts.withColumn("_fine", F.shiftright(bits, FINE_BITS)).withColumn(
        "_coarse", F.shiftright("_fine", COARSE_BITS - FINE_BITS)
    )


def _per_prefix(counts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows per coarse prefix, and per fine one; the first are added up from the second."""
    fine = counts.groupBy(*keys, "_coarse", "_fine").agg(F.sum("_n").alias("_n"))
    return fine.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n")), fine


def _middle(total: str) -> dict[str, Column]:
    """The two ranks whose values make the median; the same rank twice for odd totals."""
    return {"_lo": F.expr(f"({total} + 1) div 2"), "_hi": F.expr(f"({total} + 2) div 2")}


def _holding(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """The rows in which the middle ranks lie, with the rows of the key below them (``_below``).

    ``rows`` are counts whose ``_below`` says how many rows of the key lie below their group.
    """
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*group).orderBy(order))
    held = rows.withColumn("_upto", upto).filter("_upto >= _lo and _upto - _n < _hi")
    return held.withColumn("_below", F.col("_upto") - F.col("_n"))


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, name: str = "median"
) -> DataFrame:
    """(keys, median) with the mean of the two middle values for even counts.

    ``weight`` names a column that says how often a row counts.
    """
    keys = list(keys)
    counts = _counts(df, keys, value, F.sum(weight) if weight else F.count(F.lit(1)))
    coarse, fine = _per_prefix(counts, keys)
    found = ["_below", "_lo", "_hi"]
    whole = coarse.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))).withColumns(_middle("_total"))
    chosen = _holding(whole.withColumn("_below", F.lit(0).cast("bigint")), keys, "_coarse").select(*keys, "_coarse", *found)
    chosen = _holding(fine.join(chosen, [*keys, "_coarse"]), [*keys, "_coarse"], "_fine").select(*keys, "_fine", *found)
    held = _holding(counts.join(chosen, [*keys, "_fine"]), [*keys, "_fine"], value)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_upto") >= F.col(rank)) & (F.col("_below") < F.col(rank)), F.col(value)))

    return held.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(name))


def _before(group: Sequence[str], order: str) -> Column:
    """Rows of the group before the current one in order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(w), F.lit(0))


def _prefix_sums(counts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Coarse and fine prefixes with the rows of the key below each.

    What a partition of fine prefixes adds up by itself gets the offset of its coarse prefix
    added back.
    """
    coarse, fine = _per_prefix(counts, keys)
    coarse = coarse.withColumn("_below", _before(keys, "_coarse"))
    offsets = coarse.select(*keys, "_coarse", F.col("_below").alias("_offset"))
    fine = fine.join(offsets, [*keys, "_coarse"]).withColumn(
        "_below", F.col("_offset") + _before([*keys, "_coarse"], "_fine")
    )
    return coarse.drop("_n"), fine.drop("_n", "_offset")


def _rows_upto(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach how many rows of the key have this value or a smaller one."""
    _, fine = _prefix_sums(counts, keys)
    # rows of one value are peers in the range frame, so all of them count
    inside = Window.partitionBy(*keys, "_fine").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(fine.drop("_coarse"), [*keys, "_fine"])
    return placed.withColumn(name, F.sum("_n").over(inside) + F.col("_below")).drop("_below")


def _reached(targets: DataFrame, firsts: DataFrame, group: Sequence[str], found: str) -> DataFrame:
    """Give each target the ``found`` of the last of ``firsts`` in its group whose ``_rank`` is not above its own."""
    upwards = Window.partitionBy(*group).orderBy("_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = targets.withColumn("_target", F.lit(True)).unionByName(firsts, allowMissingColumns=True)
    placed = stacked.withColumn(found, F.last(found, ignorenulls=True).over(upwards))
    return placed.filter("_target").drop("_target")


def leave_one_out_median(
    df: DataFrame, keys: Sequence[str], member: str, value: str, name: str = "median_of_others"
) -> DataFrame:
    """(keys, member, median) over all rows of the group that do *not* belong to the member.

    No member is paired with the rows of the others. Along the sorted pool, let ``rest`` be
    the rows so far minus the member's own rows so far; it never falls. The k-th value of the
    rest then is the pool's value at rank k + c, where c counts the member's own rows up to
    its last value at which ``rest`` is still below k. Both row numbers come from the prefix
    sums above, and so does the value at a rank, so nothing is kept between the steps.
    """
    keys = list(keys)
    counts = _counts(df, [*keys, member], value, F.count(F.lit(1)))
    ranked = _rows_upto(counts, [*keys, member], value, "_own_upto")
    ranked = _rows_upto(ranked, keys, value, "_pool_upto")
    own = counts.groupBy(*keys, member).agg(F.sum("_n").alias("_own"))
    sizes = own.join(own.groupBy(*keys).agg(F.sum("_own").alias("_pool")), keys)
    sizes = sizes.select(*keys, member, (F.col("_pool") - F.col("_own")).alias("_others")).filter("_others > 0")

    def rank(middle: str) -> Column:
        short = F.col("_pool_upto") - F.col("_own_upto") < F.col(middle)
        return F.max(middle) + F.coalesce(F.max(F.when(short, F.col("_own_upto"))), F.lit(0))

    targets = (
        ranked.join(sizes.withColumns(_middle("_others")), [*keys, member])
        .groupBy(*keys, member)
        .agg(F.array(rank("_lo"), rank("_hi")).alias("_ranks"))
        .select(*keys, member, F.explode("_ranks").alias("_rank"))
    )
    # The prefix that reaches the rank, then the finer one, then the value.
    coarse, fine = _prefix_sums(counts, keys)
    first = (F.col("_below") + 1).alias("_rank")
    targets = _reached(targets, coarse.select(*keys, "_coarse", first), keys, "_coarse")
    targets = _reached(targets, fine.select(*keys, "_coarse", "_fine", first), [*keys, "_coarse"], "_fine")
    pool = counts.groupBy(*keys, "_fine", value).agg(F.sum("_n").alias("_n")).join(fine.drop("_coarse"), [*keys, "_fine"])
    at = F.col("_below") + _before([*keys, "_fine"], value) + 1
    values = pool.select(*keys, "_fine", at.alias("_rank"), F.col(value).alias("_at"))
    found = _reached(targets.withColumn("_at", F.lit(None).cast("double")), values, [*keys, "_fine"], "_at")
    return found.groupBy(*keys, member).agg(F.avg("_at").alias(name))
