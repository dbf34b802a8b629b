"""State classifiers over embedding columns with pyspark.ml, and batch models over window rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from eventloom.functions.parse import gated


def _vectors(rows: DataFrame, features: str) -> DataFrame:
    return rows.withColumn("__vector", array_to_vector(F.col(features).cast("array<double>")))


def train_state_classifier(rows: DataFrame, classes: list[str], features: str = "embedding", label: str = "state", max_iter: int = 1000) -> PipelineModel:
    """Standardised logistic regression with class-balanced weights and an L2 penalty of 1, on rows with features and label.

    rows are the training split. ValueError: no rows, labels not in classes, or under two of them. Only counts per label come to the driver.
    The scaler takes the sample deviation.
    """
    rows = rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    odd = rows.filter(~F.col(label).isin(*classes)).select(label).limit(1).collect()
    if odd:
        raise ValueError(f"unknown label {odd[0][0]}")
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError(f"two classes are needed, {len(counts)} found")
    weight = F.coalesce(*[F.when(F.col(label) == c, F.lit(n / (len(counts) * k))) for c, k in counts.items()])
    stages = [
        StringIndexer(inputCol=label, outputCol="__class", stringOrderType="alphabetAsc"),
        StandardScaler(inputCol="__vector", outputCol="__scaled", withMean=True, withStd=True),
        # balanced weights add up to n, and Spark divides the loss by their sum
        LogisticRegression(featuresCol="__scaled", labelCol="__class", weightCol="__weight", regParam=1.0 / n, standardization=False, maxIter=max_iter, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__prediction"),
    ]
    model = Pipeline(stages=stages).fit(_vectors(rows, features).select(label, "__vector", weight.alias("__weight")))
    # its training summary holds the session, which tasks cannot take along once metrics are observed
    model.stages[-1]._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict_state(model: PipelineModel, rows: DataFrame, features: str = "embedding", least: float = 0.6, margin: float = 0.15) -> DataFrame:
    """rows with p_<class>, confidence (the highest) and predicted, uncertain under least or with a lead under margin. Rows without features are left out."""
    names = class_names(model)
    ready = _vectors(rows.filter(F.col(features).isNotNull()), features)
    scored = PipelineModel(model.stages[1:]).transform(ready).withColumn("__p", vector_to_array("__p"))
    p = [F.col("__p")[i] for i in range(len(names))]
    return scored.select(*rows.columns, *[c.alias(f"p_{n}") for n, c in zip(names, p, strict=True)], F.greatest(*p).alias("confidence"), gated(names, p, least, margin).alias("predicted"))


def save_model(spark: SparkSession, model: PipelineModel, path: str, encoder: str, version: str) -> None:
    """The model and one metadata row, in a shared folder."""
    model.write().overwrite().save(f"{path}/model")
    row = (encoder, version, model.stages[1].mean.size, class_names(model))
    spark.createDataFrame([row], "encoder string, version string, dim int, classes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, encoder: str, version: str, dim: int, classes: list[str]) -> PipelineModel:
    """The saved model. ValueError where encoder, version, dimension or a class differ from what is asked."""
    row = spark.read.schema("encoder string, version string, dim int, classes array<string>").json(f"{path}/metadata").first()
    for name, want, got in (("encoder", encoder, row["encoder"]), ("version", version, row["version"]), ("dimension", dim, row["dim"])):
        if want != got:
            raise ValueError(f"{name} is {got}, not {want}")
    if not set(row["classes"]) <= set(classes):
        raise ValueError(f"classes {row['classes']} are not all among {classes}")
    return PipelineModel.load(f"{path}/model")


def score_windows(rows: DataFrame, make_predict: Callable, features: str, dim: int, classes: list[str], batch: int = 256) -> DataFrame:
    """rows with p_<class> from a user's model; make_predict runs once per Python worker and returns a function from a (rows, dim) array to (rows, classes)."""
    scores = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[dim]])
    scored = rows.withColumn("__p", scores(F.col(features)))
    return scored.select(*rows.columns, *[F.col("__p")[i].alias(f"p_{c}") for i, c in enumerate(classes)])
