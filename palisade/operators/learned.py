"""A learned scorer for the cascade: hashed words, inverse document frequencies and multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from .detector import Scorer

FEATURES = 1 << 12


def train(labelled: DataFrame, seed: int = 42) -> PipelineModel:
    """From text and label (0, 1, 2 in the order of the labels)."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="__words", pattern=r"\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=FEATURES),
        IDF(inputCol="__tf", outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__prediction", family="multinomial", regParam=0.01, maxIter=20),
    ]
    return Pipeline(stages=stages).fit(labelled)


def scorer(model: PipelineModel) -> Scorer:
    """JVM-side scorer for the detector; a null text scores as an empty one."""

    def run(df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        known = df.withColumn("__text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
        out = model.transform(known).withColumn("probs", vector_to_array("__p")).withColumn("text", F.col("__text"))
        return out.drop("__words", "__tf", "__features", "__p", "__raw", "__prediction", "__text")

    return run
