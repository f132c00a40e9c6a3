"""A classifier of future value clusters from the first window's scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.evaluation import split
from tallyfold.operators.scoring import SEGMENTS, segment_onehot

LABEL = "ltv_cluster"
# Rounds, step and depth of the boosted trees, and the split.
ROUNDS, STEP, DEPTH, TEST_PERCENT, SEED = 100, 1.0, 5, 20, 0


def ltv_features(ltv: DataFrame, keep_id_feature: bool = False) -> DataFrame:
    """Customer, numeric features, and the label; future revenue is left out.

    With ``keep_id_feature`` the customer id is a feature too and must be a number.
    """
    df = segment_onehot(ltv).drop("future_revenue")
    if keep_id_feature:
        df = df.withColumn("id_feature", F.col("customerid").cast("double"))
    return df


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("customerid", LABEL, "is_test")]


def train_predict(
    ltv: DataFrame,
    algo: str = "boosted",
    rounds: int = ROUNDS,
    keep_id_feature: bool = False,
    test: int = TEST_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Train on the larger part, predict for every customer.

    Rows are (customerid, is_test, label, prediction). "boosted" trains one boosted
    model per class, as Spark's boosting is binary; "forest" is one random forest of
    as many trees, several times faster.
    """
    features = split(ltv_features(ltv, keep_id_feature), test=test, seed=seed)
    assembler = VectorAssembler(inputCols=feature_columns(features), outputCol="features")
    rows = assembler.transform(features.withColumn("label", F.col(LABEL).cast("double")))
    if algo == "boosted":
        learner = OneVsRest(
            classifier=GBTClassifier(maxIter=rounds, stepSize=STEP, maxDepth=DEPTH, seed=seed),
            parallelism=features.select(LABEL).distinct().count(),
        )
    elif algo == "forest":
        learner = RandomForestClassifier(numTrees=rounds, maxDepth=DEPTH, seed=seed)
    else:
        raise ValueError("algo must be boosted or forest")
    train = rows.filter(~F.col("is_test")).select("features", "label")
    return (
        learner.fit(train)
        .transform(rows)
        .select(
            "customerid",
            "is_test",
            F.col("label").cast("int").alias("label"),
            F.col("prediction").cast("int").alias("prediction"),
        )
    )
