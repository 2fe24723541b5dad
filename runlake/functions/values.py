"""Reading numbers and times from text, and writing numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value" in a delimited export.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def filled(text: Column) -> Column:
    """The text, or null where the cell stands for a missing value."""
    return F.when(F.find_in_set(F.trim(text), F.lit(",".join(MISSING_TEXTS))) == 0, text)


def to_number(text: Column) -> Column:
    """Double from text; anything that is not a plain number becomes null.

    Spark's own cast also takes Java forms such as ``12d``, ``1f`` and ``0x1p3`` and
    returns NaN for ``NaN``; all of these count as unreadable here. Infinities stay.
    """
    number = text.try_cast("double")
    low = F.lower(F.rtrim(text))
    java_only = (F.right(low, F.lit(1)).isin("d", "f") & ~low.endswith("inf")) | low.contains("x")
    return F.when(~java_only & ~F.isnan(number), number)


_PLAIN_TIME = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]+\d{1,2}:\d{1,2}(:\d{1,2}(\.\d*)?)?)?\s*$"


def to_moment(text: Column, where: Column) -> Column:
    """Zone-less timestamp from text. Empty cells give null, unreadable ones stop the job.

    A day is needed, and an offset or zone is not read: such a time would mean another moment.
    """
    complaint = F.raise_error(F.concat(where, F.lit(": cannot read a time from '"), text, F.lit("'")))
    plain = F.when(text.rlike(_PLAIN_TIME), text.try_cast("timestamp_ntz"))
    return F.coalesce(plain, F.when(filled(text).isNotNull(), complaint))


def whole_text(number: Column) -> Column:
    """Nearest whole number as text, ties to even."""
    return F.bround(number, 0).cast("bigint").cast("string")


def fixed_text(number: Column, digits: int) -> Column:
    """Text with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(number, digits))


def short_text(number: Column) -> Column:
    """Six significant digits without trailing zeros: 720.0 -> 720, 37.583333 -> 37.5833."""
    padded = F.format_string("%.6g", number)
    trimmed = F.regexp_replace(padded, r"(\.[0-9]*?)0+(?=e|$)", "$1")
    return F.when(number.isNotNull(), F.regexp_replace(trimmed, r"\.(?=e|$)", ""))


def stem_without(file_name: Column, suffix: str) -> Column:
    """Run id carried by a file name: the part before ``<suffix>.csv``; null if it does not fit."""
    tail = f"{suffix}.csv"
    return F.when(
        file_name.endswith(tail),
        F.substr(file_name, F.lit(1), F.length(file_name) - F.lit(len(tail))),
    )


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")
