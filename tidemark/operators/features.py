"""Feature tables with a chronological split, preprocessing fitted on the training part, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, full, lagged, prior_mean, ratio, rolling_mean, trailing

NAMES = ("ret_1", "ret_5", "ret_20", "vol_20", "sma_gap_50", "relative_volume_20", "flow_20")


def assemble(bars: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """symbol, ts, NAMES, target (whether the next close is higher; null at the end) and period. The last row of a part, whose
    target reaches into the next, is purged."""
    df = bars.withColumns({f"ret_{k}": F.round(F.try_divide(F.col("close"), lagged("close", k)) - 1, 10) for k in (1, 5, 20)} | {"__signed": F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0)) * F.col("volume")})
    df = df.withColumns(
        {
            "vol_20": full(F.stddev_samp("ret_1"), F.col("ret_1"), trailing(20), 20), "sma_gap_50": ratio(F.col("close"), rolling_mean("close", 50)) - 1, "relative_volume_20": ratio(F.col("volume"), prior_mean("volume", 20)),
            "flow_20": ratio(full(F.sum("__signed"), F.col("close"), trailing(20), 20), F.sum("volume").over(trailing(20))), "target": (F.lead("close").over(by()) > F.col("close")).cast("int"),
            "__i": F.row_number().over(by()), "__n": F.count("*").over(Window.partitionBy("symbol")),
        }
    )
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * (train + validation))
    i = F.col("__i")
    period = F.when(i <= a - 1, "train").when(i <= a, "purged").when(i <= b - 1, "validation").when(i <= b, "purged").otherwise("test")
    return df.select("symbol", "ts", *NAMES, "target", period.alias("period"))


def preprocess(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing values become the training median with a flag, then values are standardised by training mean and deviation (1 where
    that is 0). The fitted row is joined, not collected."""
    train = F.col("period") == "train"
    medians = df.agg(*[F.median(F.when(train, F.col(c))).alias(f"__m_{c}") for c in names])
    filled = df.crossJoin(F.broadcast(medians)).select("symbol", "ts", "period", "target", *[F.coalesce(c, f"__m_{c}").alias(c) for c in names], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in names])
    fitted = filled.agg(*[F.avg(F.when(train, F.col(c))).alias(f"__a_{c}") for c in names], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"__d_{c}") for c in names])
    scale = lambda c: F.when(F.col(f"__d_{c}") == 0, 1.0).otherwise(F.col(f"__d_{c}"))
    return filled.crossJoin(F.broadcast(fitted)).select("symbol", "ts", "period", "target", *[((F.col(c) - F.col(f"__a_{c}")) / scale(c)).alias(c) for c in names], *[f"{c}_missing" for c in names])


def _fit(df: DataFrame, names: tuple[str, ...], classifier) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=[*names, *[f"{c}_missing" for c in names]], outputCol="features").transform(df)
    model = classifier.fit(vectors.where("period = 'train' and target is not null").withColumn("label", F.col("target").cast("double")))
    p = vector_to_array("probability")[1]
    state = F.when(p > 0.5, "LONG").otherwise("FLAT")
    return model.transform(vectors).select("symbol", "ts", "period", "target", p.alias("probability"), state.alias("state"))


def logistic_probabilities(df: DataFrame, names: tuple[str, ...], c: float = 1.0) -> DataFrame:
    """L2 logistic regression on the training rows; the penalty is 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression

    n = df.where("period = 'train' and target is not null").count()
    return _fit(df, names, LogisticRegression(regParam=1.0 / (c * max(1, n)), maxIter=200, standardization=False))


def forest_probabilities(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier

    return _fit(df, names, RandomForestClassifier(numTrees=300, maxDepth=4, minInstancesPerNode=50, featureSubsetStrategy="sqrt", seed=7))
