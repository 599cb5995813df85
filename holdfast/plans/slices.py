"""Cut an ordered column into slices of similar size.

A running sum, a global rank or an exact quantile needs rows in order. A window
without a partition key would move the table to one task; a window over a group
would move a hot group to one task. Here the order column is cut at approximate
quantiles, so that (group, slice) is never much larger than 1/parts of the rows,
and what remains between slices is one total per (group, slice).

The slice of a row depends on its value only. Equal values share a slice, and a
task that is run again after an executor loss computes the same slices.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = "_slice"
MARKS = "_marks"


def default_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parts_for(df: DataFrame, rows: int, rows_per_part: int = 250_000) -> int:
    """Slices for a known row count: a small table needs one."""
    return min(default_parts(df), max(1, -(-rows // rows_per_part)))


def quantile_marks(df: DataFrame, value: str, parts: int, counts: list[str]) -> Column:
    """Scalar subquery: ``parts - 1`` approximate quantiles of ``value``.

    The sketch is bounded by its accuracy, whatever the table size. ``counts``
    are non-negative columns that the caller reads anyway; testing them keeps the
    column set of this branch equal to the caller's, so both share one exchange.
    """
    wanted = F.col(value)
    if counts:
        wanted = F.when(reduce(add, [F.col(c) for c in counts]) >= 0, wanted)
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return df.agg(F.percentile_approx(wanted, steps, F.lit(max(1000, 10 * parts))).alias(MARKS)).scalar()


def position(marks: Column, value: Column, size: int) -> Column:
    """How many of the sorted ``marks`` are below ``value``: binary search, log2(size) steps."""
    powers = [1 << k for k in reversed(range(size.bit_length()))]

    def advance(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead <= F.size(marks)) & (F.try_element_at(marks, ahead) < value), ahead).otherwise(at)

    return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), advance)


def add_slice(df: DataFrame, value: str, parts: int, counts: list[str] | None = None) -> DataFrame:
    """Add the slice number: a binary search written as one projection per step, so it stays in generated code.

    Each step names the one before three times. Rules that follow a join key down to its table would write all steps
    out, 3 to the power of their number, in the driver; they end at the ``explode`` of the one number found.
    """
    if parts <= 1:
        return df.withColumn(SLICE, F.lit(0))
    found = df.withColumn(MARKS, quantile_marks(df, value, parts, counts or [])).withColumn(SLICE, F.lit(0))
    marks, at = F.col(MARKS), F.col(SLICE)
    for power in (1 << k for k in reversed(range(parts.bit_length()))):
        ahead = at + power
        further = (ahead <= F.size(marks)) & (F.try_element_at(marks, ahead) < F.col(value))
        found = found.withColumn(SLICE, F.when(further, ahead).otherwise(at))
    return found.withColumn(SLICE, F.explode(F.array(SLICE))).drop(MARKS)


def ordinal(df: DataFrame, column: str) -> Column:
    """A number in the order of ``column`` (equal numbers are possible): its own value, or for text a code of the first
    six bytes after what all values begin with."""
    kind = dict(df.dtypes)[column]
    if kind != "string":
        return F.col(column)
    ends = df.agg(F.encode(F.min(column), "UTF-8").alias("low"), F.encode(F.max(column), "UTF-8").alias("high"))
    alike = F.filter(
        F.sequence(F.lit(1), F.least(F.length("low"), F.length("high")) + 1),
        lambda n: F.substring(F.col("low"), F.lit(1), n) == F.substring(F.col("high"), F.lit(1), n),
    )
    shared = ends.select(F.least(F.size(alike), F.length("low")).alias("n")).scalar()
    code = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), shared + 1, F.lit(6))), 12, "0")
    return F.conv(code, 16, 10).cast("bigint")
