"""The churn model and the topic model, trained and applied on the cluster."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.plans.scoring import FEATURES
from holdfast.session import spread_small, use_checkpoints


def split_by_hash(
    labelled: DataFrame, key: str, label: str, share: float = rules.TRAIN_SHARE, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out rows, drawn at the same share within every label.

    The draw is the MD5 of seed, label and key as text, so a retried task, a second run
    and any SQL engine give the same split, and no label has to pass through one task to
    be counted off.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("int").cast("string"), F.col(key).cast("string"))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    drawn = labelled.withColumn("_train", bucket < int(share * 10_000))
    return drawn.where("_train").drop("_train"), drawn.where("NOT _train").drop("_train")


def training_rows(flagged: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Training rows, dealt over all cores, and hold-out rows.

    A written table of narrow rows has few files, and every level of every tree is a pass over all training rows.
    """
    train, held_out = split_by_hash(flagged, key, "label")
    return spread_small(train, key=key), held_out


def train_churn(flagged: DataFrame, key: str = "customer_id", **settings) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees on the churn features; returns the model and a one-row report with the hold-out AUC.

    ``flagged`` is read several times (fit, evaluation, counts), so hand over a written
    table (``session.materialize``) rather than the plan that makes it.
    """
    use_checkpoints(flagged.sparkSession)
    chosen = {**rules.TREE_SETTINGS, **settings}
    train, held_out = training_rows(flagged, key)
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", cacheNodeIds=False, checkpointInterval=10, **chosen
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(train)
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(
        model.transform(held_out)
    )
    report = (
        train.groupBy().count().withColumnRenamed("count", "n_train")
        .crossJoin(held_out.groupBy().count().withColumnRenamed("count", "n_test"))
        .withColumns({
            "n_trees": F.lit(chosen["maxIter"]), "max_depth": F.lit(chosen["maxDepth"]),
            "learning_rate": F.lit(chosen["stepSize"]), "test_auc": F.lit(float(auc)),
        })
    )
    return model, report


def score_customers(model: PipelineModel, flagged: DataFrame) -> DataFrame:
    """Raw churn probability of every customer, including those the model was trained on."""
    return model.transform(flagged).withColumn("raw_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def train_topic_model(
    labelled: DataFrame, text: str, label: str, n_features: int = 1 << 16, max_iter: int = 20
) -> PipelineModel:
    """Text classifier that learns the topics from calls that already carry one.

    ``labelled`` is read once for the labels, once for the frequencies and once per step of the fit, so hand over a
    written table.
    """
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(labelled)
    return Pipeline(stages=[
        index,
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=n_features),
        IDF(inputCol="_counts", outputCol="_weights", minDocFreq=2),
        LogisticRegression(featuresCol="_weights", labelCol="_label", predictionCol="_prediction",
                           rawPredictionCol="_raw", probabilityCol="_probability", maxIter=max_iter, regParam=0.01),
        IndexToString(inputCol="_prediction", outputCol="predicted_topic", labels=index.labels),
    ]).fit(labelled)


def label_topics(model: PipelineModel, texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Topic for every text, with the model's confidence."""
    stages = PipelineModel(model.stages[1:])  # unlabelled texts have nothing to index
    scored = stages.transform(texts.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    confidence = F.round(F.array_max(vector_to_array("_probability")), 6)
    return scored.select(*keep, "predicted_topic", confidence.alias("confidence"))
