"""Drift against a fitted profile: the reference is read once, later tables are only counted into its cells.

A profile has one row per feature. Its grid are the decile edges of the reference and up to ``marks`` values at equal
steps of rank; the cells are the grid points themselves and the open stretches between, before and behind them. The
reference's rows per cell are stored. Any table becomes a tally, rows per (feature, cell), and tallies add up: over
micro-batches, days, or into the profile. PSI needs nothing but cells. The KS distance is taken at both ends of every
cell, so it is exact where a feature has few values and otherwise at most 1 / marks below the exact distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import half_even, ratio_or_null
from holdfast.operators.drift import drift_status, ks_p_value, shared_numeric
from holdfast.plans.running import long_form, pick_quantiles, running_totals, value_counts
from holdfast.plans.storage import stored

MARKS = 200


def _with_cell(df: DataFrame, most: int) -> DataFrame:
    """Add ``cell`` for ``value`` in ``grid`` (of at most ``most`` points): a binary search in generated code."""
    grid, value, at = F.col("grid"), F.col("value"), F.col("_at")
    found = df.withColumn("_at", F.lit(0))
    for power in (1 << k for k in reversed(range(most.bit_length()))):
        ahead = at + power
        found = found.withColumn("_at", F.when((ahead <= F.size(grid)) & (F.try_element_at(grid, ahead) < value), ahead).otherwise(at))
    on = F.coalesce(F.try_element_at(grid, at + 1) == value, F.lit(False))
    return found.withColumn("cell", 2 * at + F.when(on, 1).otherwise(0)).drop("_at")


def fit_drift_profile(ref: DataFrame, cols: Sequence[str] | None = None, bins: int = 10, marks: int = MARKS,
                      edge_digits: int | None = None, parts: int | None = None) -> DataFrame:
    """(feature, edges, grid, cells): one row per feature with a value, a few kilobytes each."""
    cols = shared_numeric(ref, ref, cols)
    counts = stored(value_counts(long_form(ref, cols), "value", ["feature"]), "drift-reference")
    points = running_totals(counts, "value", ["n"], ["feature"], parts=parts)
    rank = F.col("cum_n") * marks / F.col("total_n")
    crossed = F.floor(rank) > F.floor((F.col("cum_n") - F.col("n")) * marks / F.col("total_n"))
    steps = points.where(crossed).groupBy("feature").agg(F.collect_list("value").alias("steps"))
    found = pick_quantiles(points, "value", "n", [i / bins for i in range(bins + 1)], ["feature"])
    edge = F.col("quantiles") if edge_digits is None else F.transform("quantiles", lambda e: F.round(e, edge_digits))
    grids = found.join(steps, "feature").select(
        "feature",
        F.array_sort(F.array_distinct(edge)).alias("edges"),
        F.array_sort(F.array_distinct(F.concat(edge, "steps"))).alias("grid"),
    )
    # one row per column, at most marks + bins + 1 points in each
    held = _with_cell(counts.join(F.broadcast(grids), "feature"), marks + bins + 1).groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    tallied = held.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("held"))
    return grids.join(tallied, "feature").select(
        "feature", "edges", "grid",
        F.transform(F.sequence(F.lit(0), 2 * F.size("grid")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0))).alias("cells"),
    )


def tally(df: DataFrame, profile: DataFrame, cols: Sequence[str], most: int = MARKS + 32) -> DataFrame:
    """(feature, cell, n) of a table: combined in the scan tasks, no row is shuffled. ``most``: points of the largest grid."""
    long = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # one row per column: a profile is a few kilobytes a feature
    placed = _with_cell(long.join(F.broadcast(profile.select("feature", "grid")), "feature"), most)
    return placed.groupBy("feature", "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(tallies: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """Tallies added up."""
    every = tallies if isinstance(tallies, DataFrame) else reduce(DataFrame.unionByName, tallies)
    return every.groupBy("feature", "cell").agg(F.sum("n").alias("n"))


def extended(profile: DataFrame, more: DataFrame) -> DataFrame:
    """The profile with a tally added to its reference (the grid stays)."""
    added = more.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("more"))
    cells = F.transform("cells", lambda n, c: n + F.coalesce(F.try_element_at("more", c), F.lit(0)))
    return profile.join(added, "feature", "left").withColumn("cells", F.when(F.col("more").isNull(), F.col("cells")).otherwise(cells)).drop("more")


def audit_tally(profile: DataFrame, counted: DataFrame, eps: float = 1e-4, alpha: float = 0.05, high: float = fixed.PSI_HIGH,
                moderate: float = fixed.PSI_MODERATE) -> DataFrame:
    """PSI, KS and status per feature of the profile, from cells alone."""
    cells = profile.select("feature", "edges", "grid", F.posexplode("cells").alias("cell", "ref_n"))
    # the grid point of a cell, or the one before a stretch; nothing before the first
    at = F.floor((F.col("cell") - 1) / 2).cast("int")
    point = F.when(F.col("cell") > 0, F.try_element_at("grid", at + 1))
    both = (
        cells.join(counted, ["feature", "cell"], "left")
        .select("feature", "cell", "edges", point.alias("point"), "ref_n", F.coalesce("n", F.lit(0)).alias("cur_n"))
    )
    whole = Window.partitionBy("feature")
    so_far = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = both.select(
        "*", F.sum("ref_n").over(whole).alias("nr"), F.sum("cur_n").over(whole).alias("nc"),
        F.sum("ref_n").over(so_far).alias("cum_r"), F.sum("cur_n").over(so_far).alias("cum_c"),
    )
    edges, bins = F.col("edges"), F.size("edges") - 1
    below = F.size(F.filter(edges, lambda e: e <= F.col("point")))
    top = F.element_at(edges, -1)
    inside = (below >= 1) & (bins >= 1) & ((F.col("point") < top) | ((F.col("point") == top) & (F.col("cell") % 2 == 1)))
    placed = totals.withColumn("bin", F.when(inside, F.least(below, bins)))

    def smoothed(count: Column, total: str) -> Column:
        part = ratio_or_null(count, F.col(total))
        return F.when(part == 0, F.lit(eps)).otherwise(part)

    per_bin = placed.where(F.col("bin").isNotNull()).groupBy("feature", "bin", "nr", "nc").agg(F.sum("ref_n").alias("r"), F.sum("cur_n").alias("c"))
    shares = per_bin.select("feature", smoothed(F.col("r"), "nr").alias("r"), smoothed(F.col("c"), "nc").alias("c"))
    psi = shares.groupBy("feature").agg(half_even(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))), 4).alias("psi"))
    gap = F.abs(ratio_or_null(F.col("cum_r"), F.col("nr")) - ratio_or_null(F.col("cum_c"), F.col("nc")))
    ks = placed.groupBy("feature").agg(F.max(gap).alias("d"), F.max("nr").cast("double").alias("n"), F.max("nc").cast("double").alias("m"))
    some = (F.col("n") > 0) & (F.col("m") > 0)
    p = F.when(some, ks_p_value(F.col("d"), F.col("n"), F.col("m"))).otherwise(1.0)
    out = ks.join(psi, "feature", "left").select(
        "feature",
        F.coalesce("psi", F.lit(0.0)).alias("psi"),
        F.when(some, half_even(F.col("d"), 4)).otherwise(0.0).alias("ks_statistic"),
        half_even(p, 6).alias("p_value"),
        (p < alpha).alias("ks_drift_detected"),
    )
    return out.withColumn("drift_status", drift_status(F.col("psi"), high, moderate))
