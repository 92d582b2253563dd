"""Learning a trial's metric from its parameters.

Spark has no multi-layer perceptron for regression: gradient-boosted trees over scaled features with
three-fold cross-validation stand in for it.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans import facts, templates


def parse_log(lines: DataFrame, prefix: str, value: str = "value") -> DataFrame:
    """features and target of the log lines with a prefix: comma-separated numbers behind it, the last one the target."""
    rest = F.substring(F.col(value), len(prefix) + 1, 1 << 30)
    numbers = F.transform(F.filter(F.split(rest, r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = lines.filter(F.col(value).startswith(prefix)).select(numbers.alias("n")).filter(F.size("n") >= 2)
    return rows.select(F.slice("n", 1, F.size("n") - 1).alias("features"), F.element_at("n", -1).alias("target"))


def columns(rows: DataFrame, width: int) -> DataFrame:
    """features as columns f0, f1, ...; rows of another width are left out."""
    same = rows.filter(F.size("features") == width)
    return same.select(*[F.col("features")[i].alias(f"f{i}") for i in range(width)], "target")


def forest(width: int, trees: int = 50, seed: int = 7) -> Pipeline:
    model = RandomForestRegressor(labelCol="target", featuresCol="x", featureSubsetStrategy="log2", minInstancesPerNode=2, numTrees=trees, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"f{i}" for i in range(width)], outputCol="x"), model])


def boosted(width: int, rounds: int = 30, seed: int = 7) -> Pipeline:
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(width)], outputCol="raw")
    model = GBTRegressor(labelCol="target", featuresCol="x", maxIter=rounds, seed=seed)
    return Pipeline(stages=[assembler, MinMaxScaler(inputCol="raw", outputCol="x"), model])


def cross_validated(rows: DataFrame, width: int, metric: str = "mae", seed: int = 7):
    """The boosted model with the better depth of two by three folds."""
    pipeline = boosted(width)
    depths = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, [2, 4]).build()
    judge = RegressionEvaluator(labelCol="target", metricName=metric)
    return CrossValidator(estimator=pipeline, estimatorParamMaps=depths, evaluator=judge, numFolds=3, seed=seed).fit(rows)


def accepted(model, train: DataFrame, test: DataFrame, least: float = 0.7) -> bool:
    """Whether the model explains more than `least` of the variance (R2) of both the rows it has seen and those it has not."""
    judge = RegressionEvaluator(labelCol="target", metricName="r2")
    return all(judge.evaluate(model.transform(rows)) > least for rows in (train, test))


def sweep(model, row: dict[str, float], name: str, values: list[float], spark) -> DataFrame:
    """Predictions for one row with one feature swept over values."""
    rows = spark.createDataFrame([{**row, name: float(v)} for v in values])
    return model.transform(rows).select(name, "prediction")


#: What a plan is to the model: its template, the sizes of its steps and the facts of its partition.
SIZES = ("multiple", "height", "least", "size")
NAMES = tuple(templates.TEMPLATES)
WIDTH = len(NAMES) + len(SIZES) + len(facts.FACTS) + len(facts.MORE)


def plan_features(plan, own: dict) -> list[float]:
    """Numbers of a plan and its facts; counts as logarithms."""
    name = templates.AS.get(plan.strategy, plan.strategy)
    sizes = {k: v for s in plan.levels for k, v in s.params.items() if k in SIZES}
    scaled = [math.log1p(float(own[f] or 0)) for f in (*facts.FACTS, *facts.MORE)]
    return [*(float(name == n) for n in NAMES), *(math.log1p(sizes.get(k, 0)) for k in SIZES), *scaled]


def surrogate(log: DataFrame, width: int = WIDTH, least: float = 0.7, seed: int = 7):
    """A model of a log (features, target), or None where it does not explain both what it has seen and what it has not."""
    rows = columns(log, width)
    train, test = rows.randomSplit([0.8, 0.2], seed=seed)
    if train.count() < 8 or test.count() < 2:
        return None
    model = forest(width, trees=40, seed=seed).fit(train)
    return model if accepted(model, train, test, least) else None


def predicted(model, rows: list[list[float]], spark) -> list[float]:
    """The model's metric for each list of features, a handful of plans."""
    if not rows:
        return []
    width = len(rows[0])
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"f{k} double" for k in range(width)))
    return [r["prediction"] for r in model.transform(table).select("i", "prediction").orderBy("i").collect()]


def in_order(model, plans: list[tuple], spark) -> list[tuple]:
    """(plan, features) by falling prediction, equal ones in list order; as they are without a model."""
    if model is None or not plans:
        return plans
    scores = predicted(model, [own for _, own in plans], spark)
    return [plans[i] for i in sorted(range(len(plans)), key=lambda i: (-scores[i], i))]
