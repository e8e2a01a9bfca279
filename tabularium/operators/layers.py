"""Networks of several layers for classification, by Spark's own trainer."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_layers(rows: DataFrame, features: int, classes: int, hidden: tuple[int, ...] = (16,), steps: int = 100, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """Trains on rows (features array<double>, label double)."""
    data = rows.select(array_to_vector("features").alias("features"), "label")
    return MultilayerPerceptronClassifier(layers=[features, *hidden, classes], maxIter=steps, seed=seed).fit(data)


def predict_layers(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> DataFrame:
    """Adds prediction, the class with the largest probability."""
    out = model.transform(rows.withColumn("__v", array_to_vector("features")).withColumnRenamed("features", "__f").withColumnRenamed("__v", "features"))
    return out.drop("features", "rawPrediction", "probability").withColumnRenamed("__f", "features").withColumn("prediction", F.col("prediction").cast("double"))
