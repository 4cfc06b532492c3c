"""The cart-abandonment classifier."""

from __future__ import annotations

import math
import uuid
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.shared import cut, scratch
from rillwork.operators import boosting

# The model's inputs in order, and each algorithm's settings.
CONFIG: dict[str, Any] = {
    "algorithm": "xgboost",
    "test_fraction": 0.2,
    "features": ["start_hour", "event_count", "n_views", "n_carts", "n_items", "n_categories", "views_per_item"],
    "params": {
        "xgboost": {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.1},
        "lightgbm": {"n_estimators": 200, "max_depth": -1, "learning_rate": 0.1},
        "random_forest": {"n_estimators": 300, "max_depth": 12},
        "logistic": {"C": 1.0, "max_iter": 1000},
    },
}


Model = PipelineModel | boosting.Boosted
#: Rows of a task of the forest, where the cluster has tasks enough: each row meets every tree.
ROWS = 2000
#: What is fitted where all algorithms are compared.
COMPARED = ("xgboost", "random_forest", "logistic")


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """base with the settings of over, level by level."""
    both = dict(base)
    for name, value in (over or {}).items():
        inner = isinstance(value, dict) and isinstance(base.get(name), dict)
        both[name] = merged(base[name], value) if inner else value
    return both


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:
        return merged(CONFIG, yaml.safe_load(f))


def booster(algorithm: str, params: dict[str, Any]) -> boosting.Settings:
    """How the two boosters grow, by the settings that their names stand for: xgboost level by level to a depth, with an L2
    penalty; lightgbm the best of 31 leaves first, from the base rate, a depth of -1 being no bound."""
    own = {"trees": params["n_estimators"], "rate": params["learning_rate"], "max_depth": max(0, params["max_depth"])}
    if algorithm == "xgboost":
        return boosting.Settings(**own, l2=params.get("reg_lambda", 1.0), least_hessian=params.get("min_child_weight", 1.0))
    return boosting.Settings(**own, leaves=params.get("num_leaves", 31), l2=params.get("reg_lambda", 0.0), least_hessian=1e-3, least_rows=params.get("min_child_samples", 20), from_mean=True)


def build_model(algorithm: str, params: dict[str, Any], rows: int = 1):
    """The estimator of a name, or the settings of a booster. ValueError for an unknown name.

    rows turns the inverse penalty C into the regularisation of a mean loss.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    if algorithm in ("xgboost", "lightgbm"):
        return booster(algorithm, params)
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=params["n_estimators"], maxDepth=params["max_depth"], seed=42, **common)
    if algorithm == "logistic":
        return LogisticRegression(regParam=1.0 / (params["C"] * max(1, rows)), maxIter=params["max_iter"], standardization=False, **common)
    raise ValueError(f"unknown algorithm: {algorithm}")


def at_risk(sessions: DataFrame) -> DataFrame:
    return sessions.where("n_carts > 0")


def _up_to(counts: DataFrame, column: str) -> DataFrame:
    """counts (column, n) with `end`: the sum of n up to each value, its own included.

    Spark samples splitters that cut the values into ranges of about as many values each, wherever they crowd. The order
    within a range is a window of its own, and only the totals of the ranges are summed in one task.
    """
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(counts.repartitionByRange(ranges, column).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy(F.col("_part").alias("_of")).agg(F.sum("n").alias("_all"))
    before = totals.select("_of", (F.sum("_all").over(Window.orderBy("_of")) - F.col("_all")).alias("_before"))  # a row a range
    inside = parted.withColumn("_inside", F.sum("n").over(Window.partitionBy("_part").orderBy(column)))
    return inside.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn("end", F.col("_before") + F.col("_inside")).drop("_part", "_of", "_all", "_before", "_inside")


def _edge(rows: DataFrame, column: str, at: int) -> tuple[Any, int] | None:
    """The value of the row that is number `at` (from 0) in order of the column, and how many rows are before its value's first."""
    ends = _up_to(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column)
    found = ends.where(F.col("end") > at).orderBy(column).first()
    return None if found is None else (found[column], found["end"] - found["n"])


def time_split(df: DataFrame, test_fraction: float = 0.2, time: str = "start_time", tie: str = "session_id") -> DataFrame:
    """df with is_train: the earliest part of the rows, in order of time and tie.

    The time at which the parts meet is found among the counts of rows for each time; only rows of that time are ordered by
    the tie, in the same way. Of rows that are alike in both, as many as there is room for are in the first part.
    """
    rows = cut(df)
    total = rows.count()
    at = int(total * (1 - test_fraction) + 1e-9)
    edge = _edge(rows, time, at) if at < total else None
    if edge is None:
        return rows.withColumn("is_train", F.lit(True))
    moment, before = edge
    level = rows.where(F.col(time).eqNullSafe(F.lit(moment)))
    who, earlier = _edge(level, tie, at - before)
    here, room = F.col(time).eqNullSafe(F.lit(moment)), at - before - earlier
    same = here & F.col(tie).eqNullSafe(F.lit(who))
    out = rows.where(~same).withColumn("is_train", F.coalesce((F.col(time) < F.lit(moment)) | (here & (F.col(tie) < F.lit(who))), F.col(time).isNull() | here))
    place = F.row_number().over(Window.partitionBy(time, tie).orderBy(F.lit(0)))  # rows that nothing tells apart
    return out.unionByName(rows.where(same).withColumn("_place", place).withColumn("is_train", F.col("_place") <= room).drop("_place"))


def metrics(scored: DataFrame, score: str = "score", label: str = "label", rows: str | None = None) -> DataFrame:
    """One row: precision and recall at 0.5 (0 without any), and the area under the ROC curve, to four digits.

    The area is that of the rank sum; rows of one score share their mean rank, so only counts by score are sorted. `rows`
    names a column that says for how many rows each stands (None: itself).
    """
    each = F.lit(1) if rows is None else F.col(rows)
    by_score = scored.groupBy(F.col(score).alias("s")).agg(F.sum(each).alias("n"), F.sum(F.col(label).cast("long") * each).alias("p"))
    ranked = _up_to(by_score, "s").withColumn("below", F.col("end") - F.col("n"))
    rank_sum = F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2.0))
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    hit = F.sum(F.when(F.col("s") >= 0.5, F.col("p")).otherwise(0))
    said = F.sum(F.when(F.col("s") >= 0.5, F.col("n")).otherwise(0))
    area = F.when((pos > 0) & (neg > 0), (rank_sum - pos * (pos + 1) / 2.0) / (pos * neg).cast("double"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b.cast("double")).otherwise(0.0), 4)
    return ranked.agg(rate(hit, said).alias("precision"), rate(hit, pos).alias("recall"), F.round(area, 4).alias("auc"))


def _labelled(sessions: DataFrame) -> DataFrame:
    return at_risk(sessions).withColumn("label", F.col("abandoned").cast("double"))


def score(model: Model, rows: DataFrame) -> DataFrame:
    """rows with score: the probability of abandonment."""
    if isinstance(model, boosting.Boosted):
        return model.score(rows)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _stored(model: PipelineModel) -> PipelineModel:
    """The model as it is read again: a fitted forest still holds its summary, and with it the session, which can't be sent to tasks."""
    path = f"{scratch(SparkSession.active())}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel.load(path)


def parted(sessions: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """The sessions at risk with label and is_train, written once for all classifiers that are trained on them."""
    return cut(time_split(_labelled(sessions), merged(CONFIG, config)["test_fraction"]))


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """rows, so many, dealt over tasks by their number: in bytes they are so few that they would be read in one or two."""
    return rows.repartition(max(1, min(math.ceil(count / ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def _alike(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows of equal features and label as one, with their number: there are far fewer of these than sessions."""
    return rows.groupBy(*features, "label").agg(F.count(F.lit(1)).alias("n"))


def train(sessions: DataFrame | None, config: dict[str, Any] | None = None, algorithm: str | None = None, parts: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model fitted on the earlier sessions, and its metrics on the later ones; parts are those of `parted`, where they are made already.

    Equal rows are scored once, and the logistic loss is that of distinct rows times their numbers. The forest draws from
    the rows themselves.
    """
    config = merged(CONFIG, config)
    algorithm = algorithm or config["algorithm"]
    parts = parted(sessions, config) if parts is None else parts
    train_rows = parts.where("is_train")
    count = train_rows.count()
    estimator = build_model(algorithm, config["params"].get(algorithm, {}), count)
    if isinstance(estimator, boosting.Settings):
        model: Model = boosting.fit(train_rows, config["features"], estimator)
    else:
        if algorithm == "logistic":
            train_rows = cut(_alike(train_rows, config["features"]))
            estimator.setWeightCol("n")
        else:
            train_rows = _dealt(train_rows, count)
        model = _stored(Pipeline(stages=[VectorAssembler(inputCols=config["features"], outputCol="features"), estimator]).fit(train_rows))
    scored = cut(score(model, cut(_alike(parts.where("NOT is_train"), config["features"]))).select("score", "label", "n"))
    return model, metrics(scored, rows="n").select(F.lit(algorithm).alias("algorithm"), "*")


def save_model(model: Model, path: str) -> None:
    if isinstance(model, boosting.Boosted):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)


def predict(spark: SparkSession, path: str, features: dict[str, float]) -> float:
    """The probability of abandonment of one session, to four digits; FileNotFoundError before a model is saved."""
    from rillwork.sources.files import exists

    if not exists(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    row = spark.createDataFrame([tuple(float(features[k]) for k in CONFIG["features"])], CONFIG["features"])
    model = PipelineModel.load(path) if exists(spark, f"{path}/metadata") else boosting.Boosted.load(spark, path)
    return round(score(model, row).first()["score"], 4)
