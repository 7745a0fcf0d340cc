"""Training, evaluation and bulk scoring of the mail classifier with spark.ml."""

from __future__ import annotations

from collections.abc import Iterable
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_exact
from ..functions.scoring import active_features, decision, risk_tier, top_signals
from ..session import ensure_checkpoint_dir
from .dataset import stratified_folds
from .features import align
from .trees import Node, model_nodes, used_columns, with_probability

STAGES = 200
CV_STAGES = 100
STEP = 0.1
DEPTH = 3
SEED = 42
# Rows of one task of a fit, which holds them in memory.
ROWS_A_TASK = 250_000


def boosted_trees(max_iter: int = STAGES, features_col: str = "features", label_col: str = "label") -> GBTClassifier:
    return GBTClassifier(
        featuresCol=features_col, labelCol=label_col, maxIter=max_iter, stepSize=STEP,
        maxDepth=DEPTH, seed=SEED, checkpointInterval=10)


def training_table(features: DataFrame, columns: Iterable[str], keep: Iterable[str] = ("mail_id", "label")) -> DataFrame:
    """Assembled vectors, written once to the checkpoint folder so that no
    iteration repeats the feature extraction."""
    ensure_checkpoint_dir(features.sparkSession)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(features).select(*keep, "features").checkpoint()


def settled(rows: DataFrame) -> DataFrame:
    """Rows to fit on, dealt out evenly and written to the checkpoint folder. A fit is
    hundreds of short jobs, and each of their tasks carries the plan that led to the rows;
    one with joins in it takes longer to unpack than a tree level to grow. What the joins
    leave may be one or two partitions, and every tree would grow in that few tasks: there
    is one a core, and more where they would hold over ``ROWS_A_TASK`` rows."""
    ensure_checkpoint_dir(rows.sparkSession)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(tasks).checkpoint()


def cross_validate(train: DataFrame, folds: int = 5, max_iter: int = CV_STAGES,
                   parallelism: int = 5) -> DataFrame:
    """Accuracy of each held-out fold. ``train`` comes from ``training_table``;
    fits are independent Spark jobs and may run side by side."""
    spark = train.sparkSession
    folded = settled(stratified_folds(train, folds).select("features", "label", "fold"))

    def one(k: int) -> tuple[int, float]:
        model = boosted_trees(max_iter).fit(folded.filter(F.col("fold") != k))
        held = model.transform(folded.filter(F.col("fold") == k))
        hit = (F.col("prediction") == F.col("label")).cast("double")
        return k, held.agg(F.avg(hit).alias("a")).first()["a"]

    with ThreadPool(min(parallelism, folds)) as pool:
        scores = pool.map(one, range(folds))
    return spark.createDataFrame(scores, "fold int, accuracy double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("accuracy").alias("mean_accuracy"),
                      F.stddev_pop("accuracy").alias("std_accuracy"),
                      F.count(F.lit(1)).alias("folds"))


def fit_mail_model(train: DataFrame, columns: Iterable[str], max_iter: int = STAGES) -> PipelineModel:
    """Fit on a ``training_table``; the returned pipeline carries the column
    list in its assembler, so saving it saves the list."""
    columns = list(columns)
    model = boosted_trees(max_iter).fit(settled(train.select("features", "label")))
    return PipelineModel([VectorAssembler(inputCols=columns, outputCol="features"), model])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_columns(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score_mails(model: PipelineModel | Iterable[Node], features: DataFrame, keep: Iterable[str] = ("mail_id",)) -> DataFrame:
    """Probability of class 1 (4 decimals), tier and decision, from a fitted model or the
    node table of one. Narrow: works on streams too; filters on kept columns reach the
    scan. Feature columns stay for the signal lists."""
    fitted = isinstance(model, PipelineModel)
    nodes = model_nodes(model) if fitted else list(model)
    columns = model_columns(model) if fitted else used_columns(nodes)
    scored = with_probability(align(features, columns, keep), nodes, "_p")
    return scored.select(
        *keep, *columns,
        round_exact(F.col("_p"), 4).alias("phishing_probability"),
        risk_tier(F.col("_p"), "PHISHING").alias("risk_tier"),
        decision(F.col("_p"), "phishing", "legitimate").alias("prediction"),
    )


def importances(model: PipelineModel) -> dict[str, float]:
    """Column -> importance; as many entries as features."""
    return dict(zip(model_columns(model), map(float, model.stages[-1].featureImportances.toArray()), strict=True))


def with_top_signals(features: DataFrame, importances: dict[str, float]) -> DataFrame:
    """Add ``top_risk_signals`` and ``top_trust_signals`` to a feature table."""
    df = features.withColumn("_active", active_features(importances))
    return df.withColumns(top_signals(F.col("_active"))).drop("_active")


def top_importances(model: PipelineModel, spark, n: int = 15) -> DataFrame:
    rows = list(importances(model).items())
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(n))


# --- Evaluation -------------------------------------------------------------


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _counts(label: str, prediction: str, positive: int):
    hit, said = F.col(label) == positive, F.col(prediction) == positive
    return (F.count_if(hit & said), F.count_if(~hit & said), F.count_if(hit & ~said), F.count_if(~hit & ~said))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one aggregate."""
    tp, fp, fn, tn = _counts(label, prediction, 1)
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        F.round(_ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(prediction) == 0).alias("predicted_0"),
        F.count_if(F.col(prediction) == 1).alias("predicted_1")))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted
    averages. Four counters per class are all that leaves the first aggregate."""
    per_class = []
    for cls in (0, 1):
        tp, fp, fn, _ = _counts(label, prediction, cls)
        per_class.append(F.struct(F.lit(str(cls)).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    rows = df.agg(F.array(*per_class).alias("r")).select(F.inline("r")).select(
        "class",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )
    measures = ("precision", "recall", "f1")
    macro = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures],
                     F.sum("support").alias("support"))
    weighted = rows.agg(
        F.lit("weighted avg").alias("class"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    return out.withColumns({m: F.round(m, 6) for m in measures})


__all__ = ["boosted_trees", "class_report", "confusion_matrix", "cross_validate", "cv_summary",
           "evaluate", "fit_mail_model", "importances", "load_model", "model_columns", "save_model",
           "score_mails", "settled", "top_importances", "training_table", "with_top_signals"]
