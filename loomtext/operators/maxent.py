"""Maximum entropy (multinomial logistic regression) over sets of nominal features, trained and applied by Spark's own library.

Instances are (doc_id, label, features ARRAY<STRING>). Features are counted to a vocabulary by the library, which keeps the
`vocabulary` most frequent; rarer ones don't take part, in training or in use. Everything is distributed but the weights.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(instances: DataFrame, iterations: int = 100, penalty: float = 0.0, vocabulary: int = 1 << 18) -> PipelineModel:
    """A model of label by features: a feature counts once, however often it occurs. Rows without a label or features are an error of
    the caller's; labels are numbered in order, so ties of probability go to the lowest."""
    labels = StringIndexer(inputCol="label", outputCol="__label", stringOrderType="alphabetAsc").fit(instances)
    words = CountVectorizer(inputCol="features", outputCol="__x", binary=True, vocabSize=vocabulary)
    fit = LogisticRegression(featuresCol="__x", labelCol="__label", predictionCol="__k", probabilityCol="__p", rawPredictionCol="__raw", family="multinomial", maxIter=iterations, regParam=penalty)
    names = IndexToString(inputCol="__k", outputCol="output", labels=labels.labels)
    return Pipeline(stages=[labels, words, fit, names]).fit(instances)


def apply(instances: DataFrame, model: PipelineModel) -> DataFrame:
    """(doc_id, output, p): the most probable label of each instance, and its probability. The label column isn't used."""
    blank = instances.select("doc_id", F.lit(None).cast("string").alias("label"), "features")
    scored = PipelineModel(model.stages[1:]).transform(blank.drop("label"))
    return scored.select("doc_id", "output", F.array_max(vector_to_array("__p")).alias("p"))
