"""Simple linear models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlog.functions.numeric import ratio


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x per group, with standard errors and t values.

    All figures follow from one aggregation of sums; rows with an unknown value are left
    out. A group needs two different x, and three rows for the errors.
    """
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    sums = df.groupBy(*by).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_avgx(yc, xc).alias("_mean_x"),
        F.regr_sxx(yc, xc).alias("_sxx"),
        F.regr_syy(yc, xc).alias("_syy"),
        F.regr_sxy(yc, xc).alias("_sxy"),
    )
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    freedom = F.when(F.col("n") > 2, F.col("n") - 2)
    variance = ratio(residual, freedom)
    return (
        sums.withColumn("slope_se", F.sqrt(ratio(variance, "_sxx")))
        .withColumn(
            "intercept_se",
            F.sqrt(variance * (ratio(F.lit(1), "n") + ratio(F.pow("_mean_x", F.lit(2)), "_sxx"))),
        )
        .withColumn("slope_t", ratio("slope", "slope_se"))
        .withColumn("intercept_t", ratio("intercept", "intercept_se"))
        .drop("_mean_x", "_sxx", "_syy", "_sxy")
    )


def coefficient_table(df: DataFrame, y: str, x: str) -> DataFrame:
    """Coefficients of one model with standard error, t and p value, one row per term."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")).dropna()
    table = VectorAssembler(inputCols=["_x"], outputCol="_features").transform(rows)
    model = LinearRegression(featuresCol="_features", labelCol="_y", solver="normal").fit(table)
    summary = model.summary
    estimates = [float(model.coefficients[0]), float(model.intercept)]
    terms = zip([x, "(intercept)"], estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues)
    return df.sparkSession.createDataFrame(
        [(term, *(float(v) for v in values)) for term, *values in terms],
        "term string, estimate double, std_error double, t double, p double",
    )
