"""Boosted trees for counts: Newton steps on the Poisson likelihood, each step one Spark ML tree."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.session import use_checkpoints

#: Rounds between checkpoints of the running margin.
CUT_EVERY = 10
#: The second derivative is taken this much further along the exponential, which keeps early steps short.
MAX_STEP = 0.7


SETTINGS = "inputs array<string>, prediction string, base double, step double, n_trees int"


@dataclass
class PoissonTrees:
    """exp(base + step * sum of trees)."""

    inputs: list[str]
    prediction: str
    base: float
    step: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c != "inputs"]
        scored = VectorAssembler(inputCols=self.inputs, outputCol="inputs").transform(rows.select(*kept))
        margin = F.lit(self.base)
        for i, tree in enumerate(self.trees):
            scored = tree.copy().setPredictionCol(f"_tree{i}").transform(scored)
            margin = margin + F.lit(self.step) * F.col(f"_tree{i}")
        return scored.select(*kept, F.exp(margin).alias(self.prediction))

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees and settings below ``path``."""
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{i:04d}")
        row = [(self.inputs, self.prediction, self.base, self.step, len(self.trees))]
        spark.createDataFrame(row, SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PoissonTrees:
        row = spark.read.parquet(f"{path}/settings").first()
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree-{i:04d}") for i in range(row["n_trees"])]
        return PoissonTrees(list(row["inputs"]), row["prediction"], row["base"], row["step"], trees)


def fit_poisson_trees(rows: DataFrame, key: list[str], inputs: list[str], label: str, prediction: str, *, rounds: int,
                      depth: int, step: float, subsample: float, min_rows: int) -> PoissonTrees:
    """Each round fits a tree to (y - mu) / h with weight h, so a leaf holds the Newton step of its rows.

    ``rows`` should be a stored table.  The margin is carried as a column and cut from its lineage by a reliable
    checkpoint every few rounds, so a lost executor repeats few trees.  Whether a row takes part in a round follows
    from the hash of its ``key``.
    """
    use_checkpoints(rows.sparkSession)
    mean = rows.agg(F.avg(label)).first()[0] or 0.0
    model = PoissonTrees(inputs, prediction, math.log(max(mean, 1e-6)), step)
    state = VectorAssembler(inputCols=inputs, outputCol="inputs").transform(rows).select(
        "inputs", F.col(label).cast("double").alias("y"), F.xxhash64(*key).alias("id"),
        F.lit(model.base).alias("margin"))
    for i in range(rounds):
        mu = F.exp("margin")
        part = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) < int(subsample * 1000)
        work = state.filter(part).withColumn("h", mu * F.lit(math.exp(MAX_STEP))).withColumn(
            "z", (F.col("y") - mu) / F.col("h"))
        tree = DecisionTreeRegressor(featuresCol="inputs", labelCol="z", weightCol="h", predictionCol="_step",
                                     maxDepth=depth, minInstancesPerNode=min_rows, seed=42).fit(work)
        model.trees.append(tree)
        state = tree.transform(state).withColumn("margin", F.col("margin") + F.lit(step) * F.col("_step")).drop("_step")
        if (i + 1) % CUT_EVERY == 0:
            state = state.checkpoint()
    return model
