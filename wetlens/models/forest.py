"""Random forest on chip features, through MLlib."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetlens.constants import SEED, THRESHOLD, TREES
from wetlens.operators.evaluation import class_weights


def train(chips: DataFrame, trees: int = TREES, seed: int = SEED, depth: int = 30, collapse: bool = False) -> RandomForestClassificationModel:
    """A forest fitted to chips (features array<double>, label); classes weigh alike.

    ``collapse`` turns label 2 into 1 first.  Rows without label or features are left
    out.  Both classes must be there.
    """
    d = chips.select("features", F.col("label").cast("int").alias("label")).filter("label is not null and features is not null and not exists(features, v -> v is null or isnan(v))")
    if collapse:
        d = d.withColumn("label", F.least("label", F.lit(1)))
    w = class_weights(d, "label")
    if w.count() < 2:
        raise ValueError("training needs at least two classes")
    d = d.join(F.broadcast(w.select("label", "weight")), "label").select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"), "weight")
    return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, seed=seed, maxDepth=depth, featureSubsetStrategy="sqrt").fit(d)


def predict(model: RandomForestClassificationModel, chips: DataFrame) -> DataFrame:
    """chips with predicted (the label), confidence (its probability) and p1 (that of label 1)."""
    out = model.setFeaturesCol("x").transform(chips.withColumn("x", array_to_vector("features")))
    p = vector_to_array("probability")
    label = F.col("prediction").cast("int")
    return out.select(*chips.columns, label.alias("predicted"), F.element_at(p, label + 1).alias("confidence"), F.element_at(p, F.lit(2)).alias("p1"))


def detected(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of label 1 with at least the threshold's confidence."""
    return scored.filter((F.col("predicted") == 1) & (F.col("confidence") >= threshold))
