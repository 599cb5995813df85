"""Fitted preprocessing: parameters are small tables (one row per column), applying them is a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import known, present
from holdfast.operators.quality import having
from holdfast.plans.running import approx_quantiles, long_form, quantile_row
from holdfast.plans.slices import parts_for
from holdfast.plans.storage import stored

MIN_SHARE = 0.001


def _quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], exact: bool, parts: int | None = None) -> DataFrame:
    return quantile_row(df, cols, qs, parts) if exact else approx_quantiles(long_form(df, cols), "value", qs, ["feature"])


def _column_stats(df: DataFrame, cols: Sequence[str], **stats) -> DataFrame:
    """One wide aggregate turned into one row per column: no unpivot of the data."""
    row = df.agg(
        *[
            F.struct(F.lit(c).alias("feature"), *[f(F.col(c).cast("double")).alias(n) for n, f in stats.items()]).alias(c)
            for c in cols
        ]
    )
    return row.select(F.inline(F.array(*[F.col(c) for c in cols])))


def as_map(params: DataFrame, name: str, *values: str) -> Column:
    """Scalar subquery: feature -> struct of parameters. Bounded by the number of columns."""
    entries = F.collect_list(F.struct(F.col(name), F.struct(*values)))
    return params.agg(F.map_from_entries(entries).alias("m")).scalar()


def _apply(df: DataFrame, params: DataFrame, values: Sequence[str], cols: Sequence[str], rule) -> DataFrame:
    with_params = df.withColumn("_params", as_map(params, "feature", *values))
    return with_params.withColumns({c: rule(F.col(c), F.col("_params")[c]) for c in cols}).drop("_params")


# ---- imputation -------------------------------------------------------------------------


def fit_impute(df: DataFrame, num_cols: Sequence[str] | None = None, cat_cols: Sequence[str] | None = None,
               strategy: str = "median", exact: bool = True) -> DataFrame:
    """(feature, number, text): median or mean per numeric column, most frequent value per category.

    Among equally frequent values the smallest is taken.
    """
    num_cols = list(num_cols if num_cols is not None else having(df, fixed.NUMERICAL))
    cat_cols = list(cat_cols if cat_cols is not None else having(df, fixed.CATEGORICAL))
    tables = []
    if num_cols:
        if strategy == "mean":
            numbers = _column_stats(df, num_cols, number=F.avg)
        else:
            numbers = _quantiles(df, num_cols, [0.5], exact).select("feature", F.col("quantiles")[0].alias("number"))
        tables.append(numbers.withColumn("text", F.lit(None).cast("string")))
    if cat_cols:
        long = long_form(df, cat_cols, kind="string").where(F.col("value").isNotNull())
        counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        modes = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("text"))
        tables.append(modes.select("feature", F.lit(None).cast("double").alias("number"), "text"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def apply_impute(df: DataFrame, params: DataFrame, num_cols: Sequence[str] | None = None, cat_cols: Sequence[str] | None = None) -> DataFrame:
    num_cols = list(num_cols if num_cols is not None else having(df, fixed.NUMERICAL))
    cat_cols = list(cat_cols if cat_cols is not None else having(df, fixed.CATEGORICAL))
    with_params = df.withColumn("_params", as_map(params, "feature", "number", "text"))
    numbers = {c: F.coalesce(known(F.col(c).cast("double")), F.col("_params")[c]["number"]) for c in num_cols}
    texts = {c: F.coalesce(F.col(c), F.col("_params")[c]["text"]) for c in cat_cols}
    return with_params.withColumns({**numbers, **texts}).drop("_params")


# ---- scaling, clipping ------------------------------------------------------------------------


def _unit_if_zero(scale: Column) -> Column:
    return F.when(scale == 0, 1.0).otherwise(scale)


def fit_robust(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(feature, center, scale): median and interquartile range, a zero range counts as 1."""
    cols = list(cols or having(df, fixed.NUMERICAL))
    q = F.col("quantiles")
    found = _quantiles(df, cols, [0.25, 0.5, 0.75], exact)
    return found.select("feature", q[1].alias("center"), _unit_if_zero(q[2] - q[0]).alias("scale"))


def fit_standard(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, center, scale): mean and population deviation, a zero deviation counts as 1."""
    cols = list(cols or having(df, fixed.NUMERICAL))
    return _column_stats(df, cols, center=F.avg, scale=F.stddev_pop).withColumn("scale", _unit_if_zero(F.col("scale")))


def apply_scale(df: DataFrame, params: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or having(df, fixed.NUMERICAL))
    return _apply(df, params, ["center", "scale"], cols, lambda x, p: (x - p["center"]) / p["scale"])


def fit_clip_bounds(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """(feature, lower, upper): quartiles widened by ``factor`` interquartile ranges."""
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    cols = list(cols or [c for c, k in df.dtypes if k in numeric])
    q = F.col("quantiles")
    reach = (q[1] - q[0]) * factor
    return _quantiles(df, cols, [0.25, 0.75], exact).select("feature", (q[0] - reach).alias("lower"), (q[1] + reach).alias("upper"))


def clip_outliers(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values outside the bounds move to the bound; nulls stay null, NaN becomes null."""

    def clip(x: Column, p: Column) -> Column:
        return F.when(present(x.cast("double")), F.least(F.greatest(x.cast("double"), p["lower"]), p["upper"]))

    return _apply(df, params, ["lower", "upper"], cols, clip)


# ---- class weights -----------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str = fixed.TARGET) -> DataFrame:
    """Balanced weights n / (classes x n_class): one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select(label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))


def add_balanced_weight(df: DataFrame, label: str = fixed.TARGET, out: str = "weight") -> DataFrame:
    stats = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).alias("s")).scalar()
    n, p = F.col("_s.n"), F.col("_s.p")
    size = F.greatest(F.when(F.col(label) == 1, p).otherwise(n - p), F.lit(1))
    return df.withColumn("_s", stats).withColumn(out, n / (F.lit(2.0) * size)).drop("_s")


def add_positive_weight(df: DataFrame, ratio: float, label: str = fixed.TARGET, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, float(ratio)).otherwise(1.0))


# ---- the fitted preprocessor as a savable pipeline -------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessor(train: DataFrame, num_cols: Sequence[str] | None = None, cat_cols: Sequence[str] | None = None,
                     scaler: str = "robust", impute: str = "median", exact: bool = True, min_share: float = MIN_SHARE) -> PipelineModel:
    """Impute, scale and one-hot encode, fitted on ``train`` only. NaN is missing.

    A category has a position of its own if at least ``min_share`` of the rows that have any carry it, so a column has at
    most 1 / min_share positions; rarer ones encode as zeros, like unknown ones.

    The fitted numbers (one row per column) become constants of a SQL projection,
    so the result is an ordinary ``PipelineModel``: it saves, loads and scores in
    code generation. Unknown categories encode as zeros.
    """
    num_cols = list(num_cols if num_cols is not None else having(train, fixed.MODEL_NUMERICAL))
    cat_cols = list(cat_cols if cat_cols is not None else having(train, fixed.CATEGORICAL))
    center, scale, fill = _fit_numbers(train, num_cols, scaler, impute, exact) if num_cols else ({}, {}, {})
    values = _fit_categories(train, cat_cols, min_share) if cat_cols else {}
    parts = ["*"]
    for c in num_cols:
        parts.append(f"(coalesce(nullif(cast(`{c}` as double), double('NaN')), {fill[c]!r}D) - {center[c]!r}D) / {scale[c]!r}D as `num__{c}`")
    for c in cat_cols:
        parts.append(f"coalesce(cast(`{c}` as string), {_quoted(values[c][0])}) as `cat__{c}`")
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")]
    inputs = [f"num__{c}" for c in num_cols]
    if cat_cols:
        names, indexed, encoded = ([f"{p}__{c}" for c in cat_cols] for p in ("cat", "ix", "onehot"))
        # the labels are known already: index a table of labels instead of passing over the data again
        longest = max(len(values[c][1]) for c in cat_cols)
        labels = [tuple(values[c][1][i % len(values[c][1])] for c in cat_cols) for i in range(longest)]
        table = train.sparkSession.createDataFrame(labels, ", ".join(f"`{n}` string" for n in names)).coalesce(1)
        indexer = StringIndexer(inputCols=names, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc").fit(table)
        encoder = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True).fit(indexer.transform(table))
        stages += [indexer, encoder]
        inputs += encoded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return PipelineModel(stages=stages)


def _fit_numbers(train: DataFrame, cols: list[str], scaler: str, impute: str, exact: bool):
    """Centre, scale and fill value per column. Scaling sees the filled column; columns without gaps need no second pass."""
    train = train.select(*[known(F.col(c).cast("double")).alias(c) for c in cols])
    *missing, rows = train.agg(*[F.count_if(F.col(c).isNull()) for c in cols], F.count(F.lit(1))).first()
    gaps, parts = dict(zip(cols, missing, strict=True)), parts_for(train, rows * len(cols))
    found = {r["feature"]: r["quantiles"] for r in _quantiles(train, cols, [0.25, 0.5, 0.75], exact, parts).collect()}
    moments = {}
    if impute == "mean" or scaler != "robust":
        moments = {r["feature"]: r for r in fit_standard(train, cols).collect()}
    fill = {c: (moments[c]["center"] if impute == "mean" else found.get(c, [0.0] * 3)[1]) or 0.0 for c in cols}
    filled = [c for c in cols if gaps[c] > 0]
    if filled:
        whole = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(c) for c in filled])
        if scaler == "robust":
            found |= {r["feature"]: r["quantiles"] for r in _quantiles(whole, filled, [0.25, 0.5, 0.75], exact, parts).collect()}
        else:
            moments |= {r["feature"]: r for r in fit_standard(whole, filled).collect()}
    if scaler == "robust":
        center = {c: float(found[c][1]) for c in cols}
        scale = {c: float(found[c][2] - found[c][0]) or 1.0 for c in cols}
    else:
        center = {c: float(moments[c]["center"]) for c in cols}
        scale = {c: float(moments[c]["scale"]) for c in cols}
    return center, scale, {c: float(v) for c, v in fill.items()}


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The dictionary of every column as a table: (feature, value, n, share), nulls left out."""
    long = long_form(df, cols, kind="string").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(totals), "feature").select("feature", "value", "n", (F.col("n") / F.col("_total")).alias("share"))


def _fit_categories(train: DataFrame, cols: list[str], min_share: float) -> dict[str, tuple[str, list[str]]]:
    """Most frequent value and the alphabetic list of frequent values per column. The dictionary stays a table; what
    reaches the driver are the values with ``min_share`` or more, at most 1 / min_share of a column, and one mode."""
    counted = stored(category_counts(train, cols), "categories")
    modes = {r["feature"]: r["mode"] for r in counted.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()}
    labels: dict[str, list[str]] = {}
    for r in counted.where(F.col("share") >= min_share).select("feature", "value").orderBy("feature", "value").collect():
        labels.setdefault(r["feature"], []).append(r["value"])
    return {c: (modes.get(c, ""), labels.get(c, [""])) for c in cols}


def helper_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("num__", "cat__", "ix__", "onehot__"))]


def apply_preprocessor(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``features``; the same output for one row or for all."""
    out = model.transform(df)
    return out.drop(*helper_columns(out))


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector positions: numeric columns, then ``cat__<column>_<value>``."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    indexers = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"]
    labels = dict(zip(indexers[0].getInputCols(), indexers[0].labelsArray)) if indexers else {}
    names: list[str] = []
    for c in assembler.getInputCols():
        if c.startswith("onehot__"):
            source = c.replace("onehot__", "cat__", 1)
            names += [f"{source}_{v}" for v in labels[source]]
        else:
            names.append(c)
    return names


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
