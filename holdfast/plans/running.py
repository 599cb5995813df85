"""Running sums, ranks and exact quantiles over any number of rows, with or without groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.salted import join_salted
from holdfast.plans.slices import SLICE, add_slice, default_parts, ordinal


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``value`` order) and ``total_<c>`` per group.

    ``sums`` are non-negative columns, group keys are not null. Rows of equal
    ``value`` are ordered by ``ties``; pre-aggregate to one row per value if equal
    values must share one point. One shuffle of ``df`` by (groups, slice); the
    slice totals that are joined back number groups x parts.
    """
    parts = parts or default_parts(df)
    keys = [*groups, SLICE]
    sliced = add_slice(df, value, parts, list(sums))
    so_far = Window.partitionBy(*keys).orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = sliced.select("*", *[F.sum(c).over(so_far).alias(f"_in_{c}") for c in sums])

    per_slice = sliced.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per_slice.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    joined = inner.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def ranked(
    df: DataFrame, value: str, groups: Sequence[str] = (), ties: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Add ``rank`` (1..n in (value, ties) order per group) and ``group_rows``."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(counted, value, ["_one"], groups, ties, parts)
    return out.withColumnsRenamed({"cum__one": "rank", "total__one": "group_rows"}).drop("_one")


def ranked_through_ties(
    df: DataFrame, value: str, tie: str, groups: Sequence[str] = (), hot_rows: int = 1_000_000, parts: int | None = None
) -> DataFrame:
    """:func:`ranked` for values that very many rows of a group share: equal values are cut by ``tie`` as well.

    Rows are counted per (group, value) and the counts are run up, which gives the rank of the first row of each value.
    Values with more than ``hot_rows`` rows are ranked in slices of ``tie``, all others within their value. No task
    holds more than the larger of ``hot_rows`` and a slice.
    """
    at = [*groups, value]
    points = running_totals(df.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")), value, ["_n"], groups, parts=parts)
    before = points.select(*at, "_n", (F.col("cum__n") - F.col("_n")).alias("_before"), F.col("total__n").alias("group_rows"))
    hot = before.where(F.col("_n") > hot_rows).drop("_n").withColumn("_hot", F.lit(True))
    marked = join_salted(df, hot, at, [tie])
    light = marked.where(F.col("_hot").isNull()).drop("_before", "group_rows").join(before.where(F.col("_n") <= hot_rows), at)
    within = F.row_number().over(Window.partitionBy(*at).orderBy(tie))
    few = light.withColumn("rank", F.col("_before") + within)
    heavy = marked.where(F.col("_hot")).withColumnRenamed("group_rows", "_group_rows")
    cut = ranked(heavy.withColumn("_tie", ordinal(heavy, tie)), "_tie", at, [tie], parts)
    many = cut.withColumn("rank", F.col("_before") + F.col("rank")).withColumn("group_rows", F.col("_group_rows"))
    columns = [*df.columns, "rank", "group_rows"]
    return few.select(*columns).unionAll(many.select(*columns))


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value) with ``n``; nulls and NaN dropped, combined before the shuffle."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    return kept.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def pick_quantiles(points: DataFrame, value: str, count: str, qs: Sequence[float], groups: Sequence[str] = (), rule: str = "linear") -> DataFrame:
    """Exact quantiles from running totals: one row per group with an array ``quantiles``.

    ``rule`` is ``linear`` (rank (n-1)q) or ``mquantiles`` (rank n q + 0.4 + 0.2 q,
    the plotting position 0.4/0.4 that partial-dependence grids use).
    """
    n = F.col(f"total_{count}")
    last = F.col(f"cum_{count}")
    first = last - F.col(count)

    def ranks(q: float) -> tuple[Column, Column]:
        if rule == "linear":
            at = (n - 1) * F.lit(float(q))
            low = F.floor(at)
            return low, at - low
        at = n * F.lit(float(q)) + F.lit(0.4 + 0.2 * q)
        low = F.floor(F.greatest(F.lit(1.0), F.least(at, (n - 1).cast("double"))))
        return low - 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - low))

    picks = []
    for i, q in enumerate(qs):
        low, part = ranks(q)
        high = F.least(low + 1, n - 1)
        picks += [
            F.max(F.when((low >= first) & (low < last), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when((high >= first) & (high < last), F.col(value))).alias(f"_hi{i}"),
            F.max(part).alias(f"_part{i}"),
        ]
    found = points.where(n > 0).groupBy(*groups).agg(*picks)

    def blend(i: int) -> Column:
        lo, hi, part = (F.col(f"_{x}{i}").cast("double") for x in ("lo", "hi", "part"))
        return F.when(part < 0.5, lo + (hi - lo) * part).otherwise(hi - (hi - lo) * (1 - part))

    return found.select(*groups, F.array(*[blend(i) for i in range(len(qs))]).alias("quantiles"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    qs: Sequence[float],
    groups: Sequence[str] = (),
    rule: str = "linear",
    parts: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group without collecting a group's values in one task."""
    points = running_totals(value_counts(df, value, groups), value, ["n"], groups, parts=parts)
    return pick_quantiles(points, value, "n", qs, groups, rule)


def approx_quantiles(df: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Sketch-based counterpart: one pass, no order, error at most 1/accuracy in rank."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    sketch = F.percentile_approx(F.col(value), F.array(*[F.lit(float(q)) for q in qs]), F.lit(accuracy))
    return kept.groupBy(*groups).agg(sketch.alias("quantiles"))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value", kind: str = "double") -> DataFrame:
    """Unpivot columns to (name, value) rows of one type, so that many columns share one job."""
    cast = df.select(*keep, *[F.col(c).cast(kind).alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), name, value)


def quantile_row(df: DataFrame, columns: Sequence[str], qs: Sequence[float], parts: int | None = None) -> DataFrame:
    """One row per column name with its exact quantiles."""
    return exact_quantiles(long_form(df, columns), "value", qs, ["feature"], parts=parts)
