"""Prediction experiments with built-in models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.vectors import as_doubles
from smudgelab.operators.columns import feature_stages, ready_for_stages
from smudgelab.operators.corruption import corrupt_by_mode
from smudgelab.operators.encoders import FitPredictor
from smudgelab.operators.profiles import run_profile
from smudgelab.operators.sampling import Prepared, assign_folds
from smudgelab.operators.scores import (
    class_scores,
    regression_scores,
    roc_auc,
    roc_auc_one_vs_rest,
    with_prediction,
)
from smudgelab.plans import search
from smudgelab.sources.schemas import CLASSIFICATION, conform
from smudgelab.sources.tables import append, with_experiment_id

#: Most optimizer steps of a fit in the search (fixed value).
SEARCH_ROUNDS = 1_000


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keeps a frame for the many passes of a fit; lost parts are computed again."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass(frozen=True)
class LogisticPredictor:
    """The built-in classifier: MLlib's logistic regression on encoded features."""

    classes: tuple[str, ...]
    model: PipelineModel
    prepare: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.prepare(df))
        return scored.withColumn("probabilities", vector_to_array("probability"))


def logistic_predictor(train: DataFrame, dataset: S.DatasetSpec, regularization: float = 0.01) -> LogisticPredictor:
    """Fitted to the labelled train rows; scoring runs inside the tasks."""

    def prepare(df: DataFrame) -> DataFrame:
        return ready_for_stages(df, dataset, train)

    indexer = StringIndexer(inputCol="label__", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    learner = LogisticRegression(
        featuresCol="features", labelCol="label_index", regParam=regularization, maxIter=100
    )
    labelled = prepare(train).withColumn("label__", F.col(dataset.target).cast("string"))
    labels = indexer.fit(labelled)
    with held(labels.transform(labelled)) as indexed:
        model = Pipeline(stages=[*feature_stages(dataset).getStages(), learner]).fit(indexed)
    return LogisticPredictor(tuple(labels.labels), model, prepare)


def class_probabilities(
    data: DataFrame, dataset: S.DatasetSpec, fit: FitPredictor = logistic_predictor
) -> tuple[DataFrame, list[str]]:
    """(key, label, probabilities) of the test rows and the class order."""
    predictor = fit(data.where("split = 'train'"), dataset)
    scored = predictor.transform(data.where("split = 'test'"))
    label = F.col(dataset.target).cast("string").alias("label")
    return scored.select(dataset.key, label, "probabilities"), list(predictor.classes)


def score_predictions(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: ROC AUC, accuracy, recall, precision, F1.

    Two classes are judged by the second one; more by micro averages and by the
    mean of one against the rest.
    """
    predicted = with_prediction(scored, "probabilities", classes).withColumn("one", F.lit(1))
    binary = len(classes) == 2
    if binary:
        hits = predicted.withColumns(
            {"hit": (F.col("label") == classes[1]).cast("int"), "p": F.col("probabilities")[1]}
        )
        auc = roc_auc(hits, ["one"], "hit", "p")
    else:
        auc = roc_auc_one_vs_rest(predicted, ["one"], "label", "probabilities", classes)
    positive = F.lit(classes[1]) if binary else None
    scores = class_scores(predicted, ["one"], "label", "prediction", positive)
    return scores.join(F.broadcast(auc), "one", "left").drop("one")


def classification_run(
    prepared: Prepared,
    seed: int,
    mode: str,
    spec: S.CorruptionSpec,
    folder: str | None = None,
    fit: FitPredictor = logistic_predictor,
) -> DataFrame:
    """Damage, fit, predict and score; a row of the classification table."""
    damaged = corrupt_by_mode(prepared, mode, spec)
    scored, classes = class_probabilities(damaged.data, prepared.dataset, fit)
    facts = run_profile(prepared.data, prepared.dataset).select("train_size", "test_size").first()
    row = score_predictions(scored, classes).withColumns(
        {
            "dataset_name": F.lit(prepared.dataset.name),
            "train_size": F.lit(facts["train_size"]),
            "test_size": F.lit(facts["test_size"]),
            "used_default_split": F.lit(False),
            "random_seed": F.lit(seed),
            "tag": F.lit(mode),
            "error_type": F.lit(spec.kind),
            "row_corruption_percent": F.lit(spec.row_percent),
            "column_corruption_percent": F.lit(spec.column_percent),
        }
    )
    row = conform(with_experiment_id(row), CLASSIFICATION)
    if folder is not None:
        append(row, folder, "classification_experiments")
    return row


def dealt(rows: DataFrame) -> DataFrame:
    """Rows for many passes, over all tasks that run at once: a small file is read by one or two."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def probe_accuracy(embeddings: DataFrame, label: str, is_test: str, regularization: float = 0.0) -> DataFrame:
    """Accuracy on the test rows of a logistic regression on vectors."""
    rows = embeddings.select(
        array_to_vector(as_doubles(F.col("embedding"))).alias("features"),
        F.col(label).cast("string").alias("label"),
        F.col(is_test).alias("is_test"),
    )
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    indexer = StringIndexer(inputCol="label", outputCol="label_index", handleInvalid="keep").fit(train)
    with held(dealt(indexer.transform(train))) as indexed:
        model = LogisticRegression(labelCol="label_index", regParam=regularization).fit(indexed)
    predicted = model.transform(indexer.transform(test))
    return predicted.agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double")).alias("accuracy"))


def regression_run(data: DataFrame, dataset: S.DatasetSpec) -> DataFrame:
    """Mean squared error and R² on the test rows of a linear regression on features."""
    ready = ready_for_stages(data, dataset, data.where("split = 'train'")).withColumn(
        "truth", F.col(dataset.target).cast("double")
    )
    learner = LinearRegression(featuresCol="features", labelCol="truth", solver="normal")
    with held(ready.where("split = 'train'")) as train:
        model = Pipeline(stages=[*feature_stages(dataset).getStages(), learner]).fit(train)
    predicted = model.transform(ready.where("split = 'test'")).withColumn("one", F.lit(1))
    return regression_scores(predicted, ["one"], "truth", "prediction").drop("one")


def embedding_regression(embeddings: DataFrame, target: str, is_test: str) -> DataFrame:
    """R² on the test rows of a linear regression on vectors."""
    rows = embeddings.select(
        array_to_vector(as_doubles(F.col("embedding"))).alias("features"),
        F.col(target).cast("double").alias("truth"),
        F.col(is_test).alias("is_test"),
    )
    model = LinearRegression(labelCol="truth", regParam=1e-9, solver="normal").fit(rows.where("NOT is_test"))
    predicted = model.transform(rows.where("is_test")).withColumn("one", F.lit(1))
    return regression_scores(predicted, ["one"], "truth", "prediction").drop("one")


def search_wide_model(
    train: DataFrame,
    dataset: S.DatasetSpec,
    seed: int,
    alphas: Sequence[float] = search.ALPHAS,
    folds: int = 5,
    parallelism: int = 4,
) -> tuple[PipelineModel, str]:
    """Best of logistic and hinge loss over the strengths by mean ROC AUC, on sparse features.

    For tables with more features than ``search.search`` sums curvature for. Folds come from
    the row digest, so the choice does not depend on partitioning.
    """
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    prepared = feature_stages(dataset)
    folded = assign_folds(train, dataset.key, seed, folds)
    with held(folded):
        return _best_model(folded, prepared, evaluator, alphas, folds, parallelism)


def _best_model(
    folded: DataFrame,
    prepared: Pipeline,
    evaluator: BinaryClassificationEvaluator,
    alphas: Sequence[float],
    folds: int,
    parallelism: int,
) -> tuple[PipelineModel, str]:
    learners = {
        "logistic": LogisticRegression(labelCol="label", maxIter=SEARCH_ROUNDS),
        "hinge": LinearSVC(labelCol="label", maxIter=SEARCH_ROUNDS),
    }
    # Features are fitted once per fold; every learner and strength then fits the same vectors.
    found: dict[tuple[str, float], list[float]] = {}
    for fold in range(folds):
        features = prepared.fit(folded.where(F.col("fold") != fold))
        learn, judge = (
            features.transform(side).select("label", "features")
            for side in (folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold))
        )
        with held(learn), held(judge):
            for name, learner in learners.items():

                def judged(alpha: float, learner=learner, learn=learn, judge=judge) -> float:
                    model = learner.fit(learn, {learner.regParam: alpha})
                    return evaluator.evaluate(model.transform(judge))

                with ThreadPool(parallelism) as pool:
                    for alpha, value in zip(alphas, pool.map(judged, alphas), strict=True):
                        found.setdefault((name, alpha), []).append(value)
    means = {setting: sum(values) / len(values) for setting, values in found.items()}
    name, alpha = max(means, key=means.get)
    learner = learners[name].copy({learners[name].regParam: alpha})
    return Pipeline(stages=[*prepared.getStages(), learner]).fit(folded), name


def baseline_report(
    spark: SparkSession,
    data: DataFrame,
    dataset: S.DatasetSpec,
    seed: int,
    alphas: Sequence[float] = search.ALPHAS,
    folds: int = 5,
) -> DataFrame:
    """Search on the train rows, ROC AUC of the best model on the test rows: (loss, roc_auc)."""
    found = search.search_report(spark, data, dataset, seed, alphas=alphas, folds=folds)
    if found is not None:
        return found.select("loss", "roc_auc")
    ready = ready_for_stages(data, dataset, data.where("split = 'train'")).withColumn(
        "label", F.col(dataset.target).cast("double")
    )
    model, loss = search_wide_model(ready.where("split = 'train'"), dataset, seed, alphas, folds)
    scored = model.transform(ready.where("split = 'test'")).select(
        F.lit(loss).alias("loss"), "label", vector_to_array("rawPrediction")[1].alias("score")
    )
    return roc_auc(scored, ["loss"], "label", "score")
